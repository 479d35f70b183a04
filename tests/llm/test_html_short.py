"""Pages with little text: nothing outside clutter is lost."""

import pytest

from veridrift.llm import html_extract as h

LONG = "The river rose again last night, and the town closed both of its bridges before the morning came, as it had done the year before."
NAV = '<nav><a href="/a">Home</a> <a href="/b">News</a></nav><header>Site name</header>'


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>Only a title</h1></article>", "Only a title"),
        ("<body><p>Hi.</p></body>", "Hi."),
        (f"<body>{NAV}<main><p>Ok.</p></main><footer>About us</footer></body>", "Ok."),
        (f'<body>{NAV}<article><header><h1>Short</h1></header></article><div class="cookie-banner">We use cookies.</div></body>', "Short"),
        (f"<body>{NAV}<form><label>Name</label><button>Send</button></form></body>", ""),
        (f"<article><h1>A head</h1><p>{LONG}</p><figure><img src=x><figcaption>The old bridge.</figcaption></figure><p>{LONG}</p></article>", f"A head\n{LONG}\nThe old bridge.\n{LONG}"),
        (f'<article><p>{LONG}</p><p>{LONG}</p><a href="x', f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><p>{LONG}</p><a href='x y z", f"{LONG}\n{LONG}"),
        ("", ""),
        (None, ""),
        ("<p></p>", ""),
        ("plain text alone", "plain text alone"),
    ],
)
def test_short_pages(page, text):
    assert h.extract([page], h.trained()) == [text]
