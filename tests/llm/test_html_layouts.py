"""Hand-written pages of many layouts; none comes from the generator that the trees learn from."""

import pytest

from veridrift.llm import html_extract as h

HEAD = "Bridge closed after the flood"
ONE = "The river rose again last night, and the town closed both of its bridges before the morning came."
TWO = "People who live near the old mill were asked to leave, but most of them stayed, as they did before."
THREE = "Officials said that the water would fall by Sunday; until then the schools in the valley remain shut."
NAV = '<nav><a href="/">Home</a> <a href="/news">News</a> <a href="/sport">Sport</a></nav>'
FOOT = "<footer><p>&copy; 2024 Valley Times. All rights reserved.</p></footer>"
BODY = f"<h1>{HEAD}</h1><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
WANT = "\n".join([HEAD, ONE, TWO, THREE])

PAGES = {
    "body": (f"<html><body>{BODY}</body></html>", WANT),
    "body, menu and footer": (f"<html><body>{NAV}{BODY}{FOOT}</body></html>", WANT),
    "plain div": (f"<body><div>{BODY}</div></body>", WANT),
    "plain div, menu and footer": (f"<body>{NAV}<div>{BODY}</div>{FOOT}</body>", WANT),
    "nested divs": (f'<body><div id="x1"><div><div class="q7">{BODY}</div></div></div>{FOOT}</body>', WANT),
    "table": (f'<body><table><tr><td><a href="/">Home</a><br><a href="/n">News</a></td><td>{BODY}</td></tr></table></body>', WANT),
    "article": (f"<body>{NAV}<article>{BODY}</article>{FOOT}</body>", WANT),
    "header in the article": (f"<body>{NAV}<article><header><h1>{HEAD}</h1></header><p>{ONE}</p><p>{TWO}</p><p>{THREE}</p></article>{FOOT}</body>", WANT),
    "main": (f'<body><header class="masthead"><a href="/">Valley Times</a></header><main>{BODY}</main>{FOOT}</body>', WANT),
    "odd classes": (f'<body><div class="jx-22 kk"><div class="zq-main-8 fl">{BODY}</div></div></body>', WANT),
    "section": (f"<body><section>{BODY}</section>{FOOT}</body>", WANT),
    "sidebar": (f'<body><div id="content">{BODY}</div><div id="sidebar"><h3>Most read</h3><ul><li><a href="/1">Fire in the harbour</a></li><li><a href="/2">New school opens</a></li></ul></div></body>', WANT),
    "advert": (f'<body><article>{BODY}<div class="advert">Buy two lamps and get one for free.</div></article></body>', WANT),
    "comments": (f'<body><article>{BODY}</article><div class="comments"><div class="comment">Ann: I saw it too, it was terrible.</div><div class="comment">Bob: Stay safe, all of you.</div></div></body>', WANT),
    "cookie notice": (f'<body><div class="cookie-notice"><p>We use cookies to make this site better for you.</p><button>Accept</button></div><div class="article-body">{BODY}</div></body>', WANT),
    "search form": (f'<body><form action="/s"><label>Search</label><input name="q"><button>Go</button></form><div class="story">{BODY}</div></body>', WANT),
    "list and heading": (f"<body><article><h1>{HEAD}</h1><p>{ONE}</p><h2>What is shut</h2><ul><li>Both bridges in the town.</li><li>All schools in the valley.</li></ul><p>{TWO}</p></article></body>", "\n".join([HEAD, ONE, "What is shut", "Both bridges in the town.", "All schools in the valley.", TWO])),
    "inline links": (f'<body><div class="entry"><h1>{HEAD}</h1><p>The <a href="/r">river</a> rose <em>again</em> last night, and the <a href="/t">town</a> closed both of its bridges before the morning came.</p><p>{TWO}</p></div></body>', "\n".join([HEAD, ONE, TWO])),
    "breaks": (f"<body>{NAV}<div><b>{HEAD}</b><br><br>{ONE}<br><br>{TWO}</div></body>", f"{HEAD} {ONE} {TWO}"),
    "open paragraphs": (f"<body><article><h1>{HEAD}</h1><p>{ONE}<p>{TWO}<p>{THREE}</article></body>", WANT),
    "unquoted script": (f"<body><script src=/a/>var x = 1;</script><article>{BODY}</article></body>", WANT),
    "bare text and paragraphs": (f"<body>{ONE}<p>{TWO}</p>{THREE}</body>", "\n".join([ONE, TWO, THREE])),
    "quote": (f"<body><article><h1>{HEAD}</h1><p>{ONE}</p><blockquote>{TWO}</blockquote><p>{THREE}</p></article></body>", WANT),
    "menu of a list": (f'<body><ul class="menu"><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport</a></li></ul><div>{BODY}</div></body>', WANT),
    "only clutter": (f"<body>{NAV}{FOOT}</body>", ""),
}


@pytest.mark.parametrize("name", PAGES)
def test_layout(name):
    page, want = PAGES[name]
    assert h.extract([page], h.trained()) == [want]


def test_a_tag_that_never_ends_takes_nothing_with_it():
    got = h.extract([f"<body><article>{BODY}<p>{ONE} <a href=\"x\" And more, as it seems, was said there in the evening"], h.trained())[0]
    assert got == f"{WANT}\n{ONE} And more, as it seems, was said there in the evening"


def test_unclosed_foreign_and_raw_elements():
    assert h.extract([f'<body><article><svg width="1"/>{BODY}</article></body>'], h.trained()) == [WANT]
    assert h.extract([f"<body><article><object>{BODY}</article></body>"], h.trained()) == [WANT]
    assert h.extract([f"<body><article>{BODY}</article><script>var x;"], h.trained()) == [WANT]
