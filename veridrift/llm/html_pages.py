"""Made-up pages with known main text, to train the extractor on.

No page of the corpus is labelled, so the training pages are drawn from a grammar of layouts:
menus, page headers, sidebars, notices, adverts, forms, comment threads and footers, by element
or by attribute, or told by nothing but their links and length, around an article in a named
container, in a plain one, in a table cell or in the body itself.  Text is invented.  Everything
follows from the seed.
"""

from __future__ import annotations

import random
import re

_SYLLABLES = "an ba ce do el fi go hu in ja ko le mi no or pa qu re si to un ve wa xi yo za".split()


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _sentence(r: random.Random, low: int = 3, high: int = 18) -> str:
    words = [_word(r) for _ in range(r.randint(low, high))]
    if r.random() < 0.1:
        words[r.randrange(len(words))] += r.choice(["###", "***", "&amp;&amp;", "%%%"])
    return " ".join(words).capitalize() + r.choice([".", ".", ".", "?", "!", ","])


def _text(r: random.Random, sentences: int) -> str:
    return " ".join(_sentence(r) for _ in range(sentences))


def _attr(r: random.Random, names: str, always: bool = False) -> str:
    if not always and r.random() < 0.3:
        return ""
    name = r.choice(names.split())
    if r.random() < 0.3:
        name = f"{r.choice(['c', 'site', 'x', 'page', 'box'])}{r.choice('-_')}{name}"
    return f' {r.choice(["class", "class", "id", "role"])}="{name}"'


def _links(r: random.Random, low: int, high: int) -> str:
    items = [f'<a href="/{_word(r)}">{_word(r)}</a>' for _ in range(r.randint(low, high))]
    return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else " | ".join(items)


def _named(r: random.Random, tag: str, names: str, inner: str) -> str:
    """The inner part in its own element, or in a plain one that only its attribute tells."""
    if r.random() < 0.55:
        return f"<{tag}{_attr(r, names)}>{inner}</{tag}>"
    plain = r.choice(["div", "section", "div"])
    return f"<{plain}{_attr(r, names, always=True)}>{inner}</{plain}>"


def _clutter(r: random.Random, kind: str) -> str:
    if kind == "menu":
        return _named(r, "nav", "menu nav navbar navigation breadcrumb toc", _links(r, 2, 9))
    if kind == "header":
        inner = r.choice([f"<h1>{_word(r)}</h1>", f"<p>{_sentence(r, 1, 5)}</p>", f"<span>{_word(r)}</span>"])
        return _named(r, "header", "header masthead topbar site-header", inner + (_links(r, 1, 4) if r.random() < 0.5 else ""))
    if kind == "footer":
        inner = f"&copy; {_word(r)}.example.com &middot; {_text(r, r.randint(1, 4))}"
        return _named(r, "footer", "footer foot copyright legal", inner if r.random() < 0.6 else f"<p>{inner}</p>" + _links(r, 1, 4))
    if kind == "sidebar":
        inner = f"<h3>{_sentence(r, 1, 3)}</h3>" + (_links(r, 2, 6) if r.random() < 0.5 else f"<p>{_text(r, r.randint(1, 3))}</p>")
        return _named(r, "aside", "sidebar related widget recommended trending side", inner)
    if kind == "notice":
        return f"<div{_attr(r, 'cookie consent notice banner gdpr alert popup modal newsletter subscribe', always=True)}><p>{_text(r, r.randint(1, 2))}</p>{r.choice(['', '<button>ok</button>', '<a href=x>more</a>'])}</div>"
    if kind == "ad":
        return f"<{(tag := r.choice(['div', 'div', 'aside', 'section', 'ins']))}{_attr(r, 'ad ads advert advertisement sponsored promo banner-ad adslot', always=True)}>{r.choice([_text(r, r.randint(1, 3)), f'<p>{_text(r, 1)}</p>', f'<a href=x>{_sentence(r)}</a>'])}</{tag}>"
    if kind == "form":
        return f"<form{_attr(r, 'form login search signup contact')}><label>{_word(r)}</label><input name=q>{r.choice(['', f'<p>{_sentence(r)}</p>', '<select><option>one</option><option>two</option></select>'])}<button>{_word(r)}</button></form>"
    if kind == "share":
        return f"<div{_attr(r, 'share social tags byline-links pagination', always=True)}>{_links(r, 2, 5)}</div>"
    threads = "".join(f"<{(tag := r.choice(['div', 'li', 'article', 'p']))}{_attr(r, 'comment reply comment-body')}>{_word(r)}: {_text(r, r.randint(1, 3))}</{tag}>" for _ in range(r.randint(1, 5)))
    return f"<{(tag := r.choice(['div', 'section', 'ol']))}{_attr(r, 'comments comment-list discussion replies disqus', always=True)}>{threads}</{tag}>"


def _paragraph(r: random.Random) -> str:
    text = _text(r, r.randint(1, 8) if r.random() < 0.85 else r.randint(8, 40))
    if r.random() < 0.2:
        text += f' <a href="/{_word(r)}">{_sentence(r, 1, 4)}</a> {_sentence(r)}'
    if r.random() < 0.2:
        text = f"<b>{text}<br>"  # left open, as pages do
    elif r.random() < 0.2:
        text = f"<{(t := r.choice(['b', 'em', 'i', 'strong', 'span']))}>{_sentence(r)}</{t}> {text}"
    return text


def _article(r: random.Random) -> str:
    if r.random() < 0.06:  # hardly any text
        line = _sentence(r, 1, 2)
        return f"<h1>{line}</h1>" + r.choice(["", f"<p>{line}</p>", f"<p><b>{line}<br>", f"<p>{_sentence(r, 1, 3)}"])
    parts = [f"<h1>{_sentence(r)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.randint(1, 12)):
        kind = r.random()
        if kind < 0.75:
            parts.append(f"<p>{_paragraph(r)}" + ("</p>" if r.random() < 0.7 else ""))
        elif kind < 0.83:
            parts.append(f"<h2>{_sentence(r, 1, 6)}</h2>")
        elif kind < 0.9:
            parts.append("<ul>" + "".join(f"<li>{_sentence(r)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif kind < 0.94:
            parts.append(f"<blockquote>{_text(r, 2)}</blockquote>")
        elif kind < 0.97:
            parts.append(f"<table><tr><td>{_sentence(r)}</td><td>{_word(r)}</td></tr></table>")
        else:
            parts.append(f"<div>{_text(r, 3)}</div>")
    return "".join(parts)


#: Marks the main container of a training page; it isn't seen by the features.
MARK = "data-main"
#: Marks what is clutter, and is all that the labels go by; it isn't seen by the features either.
CLUTTER_MARK = "data-clutter"


def _loose(r: random.Random) -> str:
    """An article without elements of its own: text in the body, with inline elements and breaks."""
    parts = [f"<h1>{_sentence(r)}</h1>"] if r.random() < 0.5 else []
    for _ in range(r.randint(1, 8)):
        text = _text(r, r.randint(1, 8))
        if r.random() < 0.5:
            text += f" <{(t := r.choice(['b', 'em', 'i', 'strong', 'span']))}>{_sentence(r, 1, 3)}</{t}> {_text(r, r.randint(1, 4))}"
        if r.random() < 0.2:
            text += f' <a href="/{_word(r)}">{_sentence(r, 1, 3)}</a> {_sentence(r)}'
        parts.append(f"<p>{text}</p>" if r.random() < 0.2 else text + r.choice(["<br>", "<br><br>", "<hr>", "<p>"]))
    return "".join(parts)


def _marked(page: str, mark: str) -> str:
    """The first element of a part with a mark; a part that begins with text gets one of its own."""
    return re.sub(r"^<([a-z0-9]+)", rf"<\1 {mark}", page) if page.startswith("<") else f"<div {mark}>{page}</div>"


def _plain(r: random.Random) -> str:
    """Attributes that say nothing, or none."""
    return r.choice(["", "", f' class="{r.choice("abcxyz")}{r.randint(1, 99)}"', f' class="col-{r.randint(1, 12)} {_word(r)}"', f' id="{_word(r)}"', ' style="margin:0"', f' class="{r.choice(["wrap", "inner", "row", "grid", "section", "block", "left", "center", "holder"])}"'])


def _unnamed(r: random.Random) -> str:
    """Clutter that neither its element nor a name tells: lines of links, short bits and imprints."""
    inner = r.choice(
        [
            lambda: _links(r, 3, 9),
            lambda: " ".join(f'<a href="/{_word(r)}">{_word(r)}</a>' for _ in range(r.randint(2, 7))),
            lambda: f"&copy; {r.randint(1999, 2030)} {_word(r)}.example.com",
            lambda: f"<p>{_links(r, 2, 5)}</p>",
            lambda: f'<a href="/">{_word(r)}</a> <span>{_word(r)}</span>',
        ]
    )()
    return f"<{(t := r.choice(['div', 'div', 'p', 'center']))}{_plain(r)}>{inner}</{t}>"


def _headed(r: random.Random) -> str:
    """The article's own header."""
    more = r.choice(["", f"<p>{_sentence(r)}</p>", f"<h2>{_sentence(r, 2, 8)}</h2>", f"<div>{_sentence(r, 2, 6)}</div>"])
    return f"<header{r.choice(['', _plain(r), ' class="entry-header"', ' class="post-header"'])}><h1>{_sentence(r)}</h1>{more}</header>"


def make_page(r: random.Random) -> str:
    layout = r.choice(["named", "named", "named", "body", "plain", "table", "loose"])
    if layout == "named":
        tag, names = r.choice([("article", "post entry story"), ("article", "post entry"), ("main", "content main"), ("div", "content article post-body entry-content main-text story-body"), ("section", "content article story")])
        open_ = f"<{tag}{_attr(r, names, always=tag in ('div', 'section'))}"
    else:
        tag = r.choice(["article", "main", "div", "div", "div", "section"]) if layout == "plain" else "td"
        open_ = f"<{tag}{_plain(r)}"
    inner = _loose(r) if layout == "loose" else _article(r)
    if layout != "loose" and r.random() < 0.25:
        inner = _headed(r) + inner.split("</h1>", 1)[-1]
    if layout not in ("loose", "body") and r.random() < 0.12:  # paragraphs by breaks
        inner = _loose(r)
    if r.random() < 0.25:  # clutter inside the article's container
        inner += _marked(_clutter(r, r.choice(["ad", "share", "comments", "form", "sidebar", "notice"])), CLUTTER_MARK)
    some = lambda kinds: [_marked(_clutter(r, k), CLUTTER_MARK) for k in kinds if r.random() < 0.45]
    before = some(("header", "menu", "notice", "ad", "form"))
    after = some(("sidebar", "comments", "ad", "share", "form", "footer"))
    before += [_marked(_unnamed(r), CLUTTER_MARK) for _ in range(2) if r.random() < 0.2]
    after += [_marked(_unnamed(r), CLUTTER_MARK) for _ in range(2) if r.random() < 0.2]
    r.shuffle(before)
    if layout in ("loose", "body"):
        return _page(r, f" {MARK}", "".join(before) + inner + "".join(after))
    if layout == "table":
        cells = [f"<td{_plain(r)} {CLUTTER_MARK}>{''.join(x)}</td>" if x else "" for x in (before[:1], after[:1])]
        body = f"<table{_plain(r)}><tr>{cells[0]}{open_} {MARK}>{inner}</td>{cells[1]}</tr></table>"
        before, after = before[1:], after[1:]
    else:
        body = f"{open_} {MARK}>{inner}</{tag}>"
    for _ in range(r.choice([0, 0, 0, 1, 1, 2])):
        body = f"<div{r.choice([_plain(r), _attr(r, 'wrapper container page layout row')])}>{body}</div>"
    if r.random() < 0.15:  # a loose line that is clutter
        after.append(r.choice([f"&copy; {_word(r)}.example.com", f"{_word(r)} | {_word(r)} | {_word(r)}", f"<br>&copy; {_sentence(r, 1, 4)}"]))
    return _page(r, "", "".join(before) + body + "".join(after))


def _page(r: random.Random, attributes: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>{_sentence(r)}</title></head><body{attributes}>{body}</body></html>"


def training_pages(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return [make_page(r) for _ in range(n)]
