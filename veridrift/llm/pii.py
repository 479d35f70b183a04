"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Values are found by pattern and validated: card numbers (Luhn's check), bank accounts (IBAN, its
check digits), telephone numbers (with a country code, or of the North American plan), IPv4 and
IPv6 addresses, social security numbers (areas, groups and serials that are given out), days of the
calendar, mail addresses and assigned secrets.  What fails its check is left alone.  Numbers and
dates pass through a keyed Feistel network over exactly the values of their own format: digits stay
digits, a valid card number or account stays valid, an address stays an address, a date stays a
date of the same notation.  The network is a permutation, so equal values stay equal in every
document, and different ones stay different.  Mail addresses get a keyed user name at a reserved
domain, and secrets keyed characters of their own kind, so that these stay linked as well.

A Feistel step on a pair (left, right), each below its own modulus, adds a keyed function of one
half to the other.  That is a bijection for any two moduli, so a domain of a*b values needs no
search for a value in range: digits are split in the middle, an IPv4 address into two halves of
65536, a North American number into 800 areas times 800 exchanges with their lines, and the days
from 1900 to 2099, 73,049, into 17 times 4297.  An IPv6 address is two networks, of its prefix and
of its interface, the second keyed by the first; it comes back in full notation.

How it scales.  A map over the documents without shuffle or state; the patterns run once over a
text.

Edge cases.  A null text stays null with no findings; an empty one stays empty.  Texts without
findings come back as they were, byte for byte.  Secrets are replaced to their end, however long.
Repeated rows get the same result.  Days and months without zeros are read day first where that is
a day.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: First and last day of the permuted range; their number is the product of the moduli.
FIRST_DAY, DAYS, DAY_MODULI = "1900-01-01", 73_049, (17, 4297)
KINDS = ("mail", "secret", "iban", "ip", "date", "phone", "ssn", "number")
#: Areas or exchanges of the North American plan (200 to 999), and exchanges with their lines.
AREAS, LINES = 800, 8_000_000
#: Stands around findings while a text is cut; texts that hold it are cut in two passes.
EDGE = "\u0001"

# English months
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"

# Patterns of findings, in the order in which they are tried at a place
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,20}+"
SECRET_NAME = r"(?i:\b(?:token|secret|password|passwd|api_?key|access_?key|auth)\b\"?'?\s{0,3}[=:]\s{0,3})"
QUOTED = SECRET_NAME + r"[\"'][^\"'\s]{8,}+[\"']"
#: Parts joined by dots are one secret, as in signed tokens; a dot at the end isn't part of it.
BODY = r"[A-Za-z0-9+/_-]{8,}+(?:\.[A-Za-z0-9+/_-]++)*+=*+"
BARE = SECRET_NAME + r"(?=[A-Za-z+/_.-]*+[0-9])" + BODY
ACCESS = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = "|".join((QUOTED, BARE, ACCESS))
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
HEX = "[0-9A-Fa-f]{1,4}"
IP6 = rf"(?<![0-9A-Za-z:.])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}})(?![0-9A-Za-z:]|\.[0-9])"
YEAR = "(?:19|20)[0-9]{2}"
DAY = "[0-3]?[0-9]"
DATE = (
    rf"(?<![0-9])(?:{YEAR}-[0-1][0-9]-[0-3][0-9]|[0-3][0-9][./](?:0[1-9]|1[0-2])[./]{YEAR})(?![0-9])"
    rf"|(?<![0-9/])(?:{DAY}/{DAY}/{YEAR})(?![0-9/])|\b(?:{MONTHS}) {DAY}, {YEAR}(?![0-9])|(?<![0-9]){DAY} (?:{MONTHS}) {YEAR}(?![0-9])"
)
#: A country code; or an area and an exchange of the North American plan.
ABROAD = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"
AT_HOME = r"(?<![0-9(])\([2-9][0-9]{2}\) ?[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[2-9][0-9]{2}[.-][2-9][0-9]{2}[.-][0-9]{4}(?![0-9]|[.-][0-9])"
PHONE = f"{ABROAD}|{AT_HOME}"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
NUMBER = r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ANY = "|".join((MAIL, SECRET, IBAN, IP6, IP, DATE, PHONE, SSN, NUMBER))
#: What a text must hold for any of them: a cheap first test.
HINT = r"@|[0-9]{3}|[0-9]\.[0-9]|[=:]\s{0,3}[\"'A-Za-z0-9+/_-]|::|AKIA"


def keyed(key: str, *parts: Column) -> Column:
    """A whole number of 48 bits from a keyed SHA-256 of the parts."""
    text = F.concat_ws(":", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: Column, b: Column, key: str, kind: str) -> Column:
    """struct(l, r): the pair, permuted among all pairs with l below a and r below b.

    Rounds are folded over a short array, so that each is computed once.
    """
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def step(at: Column, i: Column) -> Column:
        l, r = at["l"], at["r"]  # noqa: E741
        new_l = F.pmod(l + keyed(key, F.lit(kind), a, b, i, r), a)
        new_r = F.pmod(r + keyed(key, F.lit(kind), a, b, i, l), b)
        even = i % 2 == 0
        return F.struct(F.when(even, new_l).otherwise(l).cast("long").alias("l"), F.when(even, r).otherwise(new_r).cast("long").alias("r"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, step)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 36 digits as another of the same length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    a, b = F.pow(F.lit(10.0), half).cast("long"), F.pow(F.lit(10.0), n - half).cast("long")
    left, right = F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long")
    made = feistel(left, right, a, b, key, kind)
    return F.concat(F.lpad(made["l"].cast("string"), half, F.lit("0")), F.lpad(made["r"].cast("string"), n - half, F.lit("0")))


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum, with every second digit doubled from the ``shift``-th last on."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda d: d != "")), lambda d, i: F.when((i + shift) % 2 == 1, 2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def luhn_valid(digits: Column) -> Column:
    return luhn_sum(digits, 0) % 10 == 0


def permute_number(digits: Column, key: str) -> Column:
    """A valid card number as another valid one."""
    new = permute_digits(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
    check = F.pmod(-luhn_sum(new, 1), F.lit(10))
    return F.concat(new, check.cast("string"))


def mod97(account: Column) -> Column:
    """The rest of an account, its country and check digits moved behind, in the numbers of its letters."""
    moved = F.filter(F.split(F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4))), ""), lambda c: c != "")

    def step(rest: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.when(digit, (rest * 10 + F.try_to_number(F.when(digit, c), F.lit("9")).cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(moved, F.lit(0), step)


def plain_account(value: Column) -> Column:
    return F.translate(value, " ", "")


def permute_iban(value: Column, key: str) -> Column:
    """An account of the same country, letters and notation, with its own check digits."""
    rest = F.substr(value, F.lit(5))
    new = fill(rest, permute_digits(digits_of(rest), key, "iban"))
    country = F.substr(value, F.lit(1), F.lit(2))
    check = 98 - mod97(F.concat(country, F.lit("00"), plain_account(new)))
    return F.concat(country, F.lpad(check.cast("string"), 2, F.lit("0")), new)


def fill(format_of: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``format_of``."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("at"))

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        one = F.when(is_digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)
        return F.struct(F.concat(acc["s"], one).alias("s"), (acc["at"] + F.when(is_digit, 1).otherwise(0)).alias("at"))

    return F.aggregate(F.split(format_of, ""), start, put, lambda acc: acc["s"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permute_phone(value: Column, key: str) -> Column:
    """The subscriber's part; the country code and the punctuation stay.

    Numbers of the North American plan stay such, and are the same with and without their code.
    """
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    code = F.when(~value.startswith("+"), "").when(code == "", F.substr(value, F.lit(1), F.lit(2))).otherwise(code)
    rest = F.substr(value, F.length(code) + 1)
    digits = digits_of(rest)
    home = code.isin("", "+1") & digits.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    number = F.when(home, digits).otherwise("2002000000").cast("long")
    made = feistel(F.floor(number / 10_000_000) - 200, number % 10_000_000 - 2_000_000, F.lit(AREAS).cast("long"), F.lit(LINES).cast("long"), key, "home")
    at_home = F.concat((made["l"] + 200).cast("string"), (made["r"] + 2_000_000).cast("string"))
    return F.concat(code, fill(rest, F.when(home, at_home).otherwise(permute_digits(digits, key, "phone"))))


def permute_ssn(value: Column, key: str) -> Column:
    """Another one that is given out: 898 areas times 99 groups, with 9999 serials each."""
    area, group, serial = (F.substr(value, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    left = (area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1
    made = feistel(left, serial - 1, F.lit(898 * 99).cast("long"), F.lit(9999).cast("long"), key, "ssn")
    new = F.floor(made["l"] / 99) + 1
    new = new + F.when(new >= 666, 1).otherwise(0)
    shown = lambda x, n: F.lpad(x.cast("long").cast("string"), n, F.lit("0"))
    return F.concat_ws("-", shown(new, 3), shown(made["l"] % 99 + 1, 2), shown(made["r"] + 1, 4))


def groups_of_ip6(value: Column) -> Column:
    """The eight groups of an address, as numbers; fewer or more where it isn't one."""
    sides = F.split(value, "::")
    some = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ":"), lambda g: g != "")
    left, right = some(F.get(sides, F.lit(0))), some(F.get(sides, F.lit(1)))
    gap = F.array_repeat(F.lit("0"), F.when(F.size(sides) > 1, F.greatest(F.lit(1), 8 - F.size(left) - F.size(right))).otherwise(F.lit(0)))
    return F.transform(F.concat(left, gap, right), lambda g: F.conv(g, 16, 10).cast("long"))


def permute_ip6(value: Column, key: str) -> Column:
    g = groups_of_ip6(value)
    wide = F.lit(1 << 32).cast("long")
    two = lambda i: F.get(g, F.lit(i)) * 65536 + F.get(g, F.lit(i + 1))
    front = feistel(two(0), two(2), wide, wide, key, "ip6")
    back = feistel(F.pmod(two(4) + keyed(key, front["l"], front["r"]), wide), two(6), wide, wide, key, "ip6b")
    shown = lambda x: F.concat_ws(":", F.lpad(F.lower(F.hex(F.floor(x / 65536))), 4, F.lit("0")), F.lpad(F.lower(F.hex(x % 65536)), 4, F.lit("0")))
    return F.concat_ws(":", shown(front["l"]), shown(front["r"]), shown(back["l"]), shown(back["r"]))


def permute_ip(value: Column, key: str) -> Column:
    o = F.split(value, r"\.")
    part = lambda i: o[i].cast("long") * 256 + o[i + 1].cast("long")
    made = feistel(part(0), part(2), F.lit(65536).cast("long"), F.lit(65536).cast("long"), key, "ip")
    out = [F.floor(made["l"] / 256), made["l"] % 256, F.floor(made["r"] / 256), made["r"] % 256]
    return F.concat_ws(".", *[x.cast("long").cast("string") for x in out])


def day_of(value: Column) -> Column:
    """(form, day): how a date is written, and its number from ``FIRST_DAY`` on; null if it is no such day."""
    known = F.lit(FIRST_DAY).cast("date")
    form = (
        F.when(value.rlike("^[0-9]{4}-"), "yyyy-MM-dd")
        .when(value.rlike("^[0-9]{2}[.]"), "dd.MM.yyyy")
        .when(value.rlike("^[0-9]{2}/(?:0[1-9]|1[0-2])/"), "dd/MM/yyyy")
        .when(value.rlike("^[A-Z]"), "MMMM d, yyyy")
        .when(value.contains(" "), "d MMMM yyyy")
        .when(F.try_to_date(value, "d/M/yyyy").isNotNull(), "d/M/yyyy")
        .otherwise("M/d/yyyy")
    )
    forms = ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d/M/yyyy", "M/d/yyyy")
    read = F.coalesce(*[F.when(form == f, F.try_to_date(value, f)) for f in forms])
    day = F.datediff(read, known)
    return F.struct(form.alias("form"), F.when(day.between(0, DAYS - 1), day).alias("day"))


def permute_date(value: Column, key: str) -> Column:
    """A date in its own notation."""
    at = day_of(value)
    a, b = DAY_MODULI
    made = feistel(F.floor(at["day"] / b), at["day"] % b, F.lit(a).cast("long"), F.lit(b).cast("long"), key, "date")
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), (made["l"] * b + made["r"]).cast("int"))
    shown = [F.when(at["form"] == f, F.date_format(new, f)) for f in ("yyyy-MM-dd", "dd.MM.yyyy", "dd/MM/yyyy", "MMMM d, yyyy", "d MMMM yyyy", "d/M/yyyy", "M/d/yyyy")]
    return F.coalesce(*shown)


def hide_mail(value: Column, key: str) -> Column:
    made = F.sha2(F.concat_ws(":", F.lit(key), F.lit("mail"), F.lower(value)), 256)
    return F.concat(F.lit("user-"), F.substring(made, 1, 16), F.lit("@mail.invalid"))


def hide_secret(value: Column, key: str) -> Column:
    """The secret itself as keyed hex digits of its length, in capitals if it has capitals only."""
    quoted = value.rlike("[\"']$")
    body = (
        F.when(quoted, F.regexp_extract(value, "[\"']([^\"'\\s]{8,}+)[\"']$", 1))
        .when(value.startswith("AKIA") & (F.length(value) == 20), F.substr(value, F.lit(5)))
        .otherwise(F.regexp_extract(value, rf"^{SECRET_NAME}({BODY})$", 1))
    )
    tail = F.when(quoted, 1).otherwise(0)
    head = F.substr(value, F.lit(1), F.length(value) - F.length(body) - tail)
    blocks = F.concat(*[F.sha2(F.concat_ws(":", F.lit(key), F.lit(f"secret{i}"), body), 256) for i in range(4)])
    # beyond 256 characters from the digest of the secret, taken once, so that time grows with the length
    last = F.ceil(F.length(body) / 64).cast("int") - 1
    block = lambda i, d: F.sha2(F.concat_ws(":", F.lit(key), F.concat(F.lit("secret"), i.cast("string")), d), 256)
    more = F.transform(F.array(F.sha2(body, 256)), lambda d: F.array_join(F.transform(F.sequence(F.lit(4), F.greatest(last, F.lit(4))), lambda i: block(i, d)), ""))
    blocks = F.when(last < 4, blocks).otherwise(F.concat(blocks, more[0]))
    new = F.substr(blocks, F.lit(1), F.length(body))
    new = F.when(body == F.upper(body), F.upper(new)).otherwise(new)
    return F.concat(head, new, F.substr(value, F.length(value) - tail + 1))


def kind_of(value: Column) -> Column:
    """The kind of a finding, null where it fails the check of its kind."""
    whole = lambda p: value.rlike(f"^(?:{p})$")
    account = plain_account(value)
    return (
        F.when(value.contains("@") & whole(MAIL), "mail")
        .when(value.rlike(f"[\"']$|^{SECRET_NAME}|^AKIA[0-9A-Z]{{16}}$"), "secret")
        .when(value.rlike("^[A-Z]{2}[0-9]{2}"), F.when(F.length(account).between(15, 34) & (F.length(digits_of(F.substr(account, F.lit(5)))) >= 2) & (mod97(account) == 1), "iban"))
        .when(value.contains(":"), F.when((F.size(groups_of_ip6(value)) == 8) & value.rlike("[0-9]") & value.rlike(f"(?:{HEX}:.*){{2}}"), "ip"))
        .when(whole(IP), "ip")
        .when(whole(DATE), F.when(day_of(value)["day"].isNotNull(), "date"))
        .when(whole(PHONE), "phone")
        .when(whole(SSN), "ssn")
        .otherwise(F.when(luhn_valid(digits_of(value)), "number"))
    )


def pseudonym(value: Column, key: str, kind: Column) -> Column:
    """The pseudonym of one finding; itself where it has no kind."""
    return (
        F.when(kind == "mail", hide_mail(value, key))
        .when(kind == "secret", hide_secret(value, key))
        .when(kind == "iban", permute_iban(value, key))
        .when((kind == "ip") & value.contains(":"), permute_ip6(value, key))
        .when(kind == "ip", permute_ip(value, key))
        .when(kind == "date", permute_date(value, key))
        .when(kind == "phone", permute_phone(value, key))
        .when(kind == "ssn", permute_ssn(value, key))
        .when(kind == "number", fill(value, permute_number(digits_of(value), key)))
        .otherwise(value)
    )


def cut(text: Column) -> Column:
    """The text in pieces: what lies between findings at even places, findings at odd ones."""
    between, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    twice = F.flatten(F.zip_with(between, found, lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    once = F.split(F.regexp_replace(text, ANY, f"{EDGE}$0{EDGE}"), EDGE, -1)
    return F.when(text.rlike(HINT), F.when(text.contains(EDGE), twice).otherwise(once)).otherwise(F.array(text))


def replaced(pieces: Column, key: str) -> Column:
    """(kind, text) of every piece; pieces between findings have no kind."""

    def one(piece: Column, i: Column) -> Column:
        kind = F.when((i % 2 == 1) & (piece != ""), kind_of(piece))
        # the kind is a field first, so that it is found once
        return F.transform(F.array(F.struct(kind.alias("kind"), piece.alias("text"))), lambda x: F.struct(x["kind"].alias("kind"), pseudonym(x["text"], key, x["kind"]).alias("text")))[0]

    return F.transform(pieces, one)


def pseudonymize(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """The documents with ``column`` replaced; all other columns as they were."""
    return docs.withColumn(column, hide(F.col(column), key))


def hide(text: Column, key: str) -> Column:
    """The text with every finding replaced."""
    return F.array_join(F.transform(replaced(cut(text), key), lambda x: x["text"]), "")


def _same(name: str):
    return lambda k: k == name


def report(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_found, one count per kind, changed) of every row."""
    made = docs.select("doc_id", F.col("text").isNull().alias("none"), replaced(cut(F.col("text")), key).alias("pieces"))
    kinds = F.coalesce(F.filter(F.transform("pieces", lambda x: x["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    text = F.when(~F.col("none"), F.array_join(F.transform("pieces", lambda x: x["text"]), ""))
    listed = made.select("doc_id", text.alias("text"), kinds.alias("kinds"))
    counts = [F.size(F.filter("kinds", _same(n))).cast("long").alias(f"n_{n}") for n in KINDS]
    return listed.select("doc_id", "text", F.size("kinds").cast("long").alias("n_found"), *counts).withColumn("changed", F.col("n_found") > 0)
