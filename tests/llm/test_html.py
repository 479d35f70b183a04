import random

import pytest

from veridrift.llm import html_extract as h
from veridrift.llm.html_pages import training_pages

PAGE = (
    '<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- ad --><div class="ad">Buy this now.</div>'
    "<article><h1>Head &amp; line</h1><p><b>First  part\n of it, which goes on for a while.<br><p>Second &lt;one&gt;, with some more words.</p></article>"
    "<footer>&copy; x.example.com &middot; All rights.</footer></body></html>"
)


def test_extracts_article():
    assert h.extract([PAGE, None, "", PAGE.replace("</body></html>", "")], h.trained()) == [
        "Head & line\nFirst part of it, which goes on for a while.\nSecond <one>, with some more words.", "", "",
        "Head & line\nFirst part of it, which goes on for a while.\nSecond <one>, with some more words.",
    ]


def test_held_out_pages():
    right = 0
    pages = training_pages(150, 12345)
    for page in pages:
        tree = h.parse(page)
        want = h.main_text(tree, h.training_labels(tree).astype(bool).tolist())
        right += h.extract([h.unmarked(page)], h.trained())[0] == want
    assert right >= 0.95 * len(pages)


def test_decoding_is_hierarchical_and_best():
    import itertools
    import math

    import numpy as np

    r = random.Random(2)
    for _ in range(40):
        n = r.randint(2, 8)
        tree = h.Tree(["div"] * n, [-1] + [r.randrange(i) for i in range(1, n)], [""] * n, [])
        chance = np.array([r.uniform(0.05, 0.95) for _ in range(n)])
        keep = h.decode(tree, chance)
        score = lambda k: sum(math.log(c if x else 1 - c) for x, c in zip(k[1:], chance[1:], strict=True))
        legal = [(True, *k) for k in itertools.product([False, True], repeat=n - 1)]
        legal = [k for k in legal if all(not k[i] or k[tree.parents[i]] for i in range(1, n))]
        assert tuple(keep) in legal and score(keep) == pytest.approx(max(map(score, legal)))


@pytest.mark.parametrize("page", ["<", "<p", "a < b", "<p>x</div></p>", "<!--", "<script>", "<a href='x>y", "text only", "<p>" * 5000, "<div>" * 3000 + "x", "&#0;&#x110000;", "<p class=\"a'>q</p>"])
def test_broken_pages(page):
    assert isinstance(h.extract([page], h.trained())[0], str)


def test_query_rows(spark):
    rows = [(1, "u", PAGE, 3), (1, "u", PAGE, 3), (None, None, None, 3), (3, "v", "just text", 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = h.main_texts(df).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] == 3} == {"just text"}
    assert h.main_texts(df.limit(0)).count() == 0
