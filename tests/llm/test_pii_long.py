"""Secrets of any length and of several parts."""

import hashlib
import random
import re

from test_pii import KEY, hidden


def test_secrets_are_replaced_to_their_end(spark):
    r = random.Random(2)
    word = lambda n: "".join(r.choice("abcXYZ019_-") for _ in range(n - 1)) + "7"
    parts = [word(40), word(250), word(43)]
    secrets = [word(n) for n in (8, 64, 65, 200, 201, 300, 5000, 200_000)] + [".".join(parts), "a" * 150 + "1" * 10]
    for before, after in (('token = "', '" end'), ("password=", " end"), ("api_key: ", ". End"), ("secret='", "', x")):
        got = hidden(spark, [before + s + after for s in secrets])
        for s, g in zip(secrets, got, strict=True):
            assert g.startswith(before) and g.endswith(after) and len(g) == len(before + s + after)
            digest = hashlib.sha256(s.encode()).hexdigest()
            blocks = "".join(hashlib.sha256(f"{KEY}:secret{i}:{s if i < 4 else digest}".encode()).hexdigest() for i in range(-(-len(s) // 64)))
            assert g[len(before) : -len(after)] == blocks[: len(s)]
    padded = hidden(spark, ["token=QWxhZGRpbjpvcGVuIHNlc2FtZTEy== x"])
    assert re.fullmatch(r"token=[0-9a-f]{30} x", padded[0])


def test_upper_case_stays(spark):
    assert re.fullmatch(r"TOKEN=[0-9A-F]{300}", hidden(spark, ["TOKEN=" + "AB1" * 100])[0])
