"""Articles whose text stands in the body itself."""

from veridrift.llm import html_extract as h
from veridrift.llm.html_pages import MARK, training_pages

ONE = "The river rose again last night, and the town closed both of its bridges before the morning came."
TWO = "People who live near the old mill were asked to leave, but most of them stayed, as they did before."


def test_text_in_the_body_is_kept():
    page = f'<html><body><nav><a href="/a">Home</a> <a href="/b">News</a></nav>{ONE} <b>Nobody</b> was hurt.<br>{TWO}<hr>{TWO} <i>{ONE}</i></body></html>'
    assert h.extract([page], h.trained()) == [f"{ONE} Nobody was hurt. {TWO}\n{TWO} {ONE}"]


def test_held_out_pages_with_text_in_the_body():
    pages = [p for p in training_pages(400, 777) if f"<body {MARK}>" in p]
    assert len(pages) > 50
    right = 0
    for page in pages:
        tree = h.parse(page)
        want = h.main_text(tree, h.training_labels(tree).astype(bool).tolist())
        right += h.extract([h.unmarked(page)], h.trained())[0] == want
    assert right >= 0.9 * len(pages), right / len(pages)
