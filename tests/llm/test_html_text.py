"""Hand-made pages with their main text, cases of broken markup, and times."""

import time

import pytest

from tessera.llm import html_text

PAGES = [
    (
        '<!DOCTYPE html><html><head><title>Harbour news</title><meta charset="utf-8"><script>var a = "<p>no</p>";</script></head><body class="home page">'
        '<div id="topbar"><a href="/">Harbour Post</a></div><ul class="menu"><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li></ul>'
        '<main><h1>Ferry returns to the bay</h1><p>The old ferry crossed the bay on Monday for the first time in ten years.</p>'
        '<p>Its crew of <em>twelve</em> said the engine &mdash; a rebuilt diesel &mdash; ran well.</p></main>'
        '<aside><h3>Most read</h3><ul><li><a href="/x">Ten bridges</a></li></ul></aside><footer><p>&copy; 2024 Harbour Post</p></footer></body></html>',
        "Ferry returns to the bay\nThe old ferry crossed the bay on Monday for the first time in ten years.\nIts crew of twelve said the engine — a rebuilt diesel — ran well.",
    ),
    (
        '<html><body><div class="cookie-banner"><p>We use cookies to improve this site.</p><button>Accept</button></div><article class="post"><h2>Bread without kneading</h2>'
        "<p>Mix flour, water, salt and yeast, then wait a day.</p><ol><li>Fold the dough twice.</li><li>Bake it in a hot pot.</li></ol></article>"
        '<section class="comments"><h3>Comments</h3><p>Worked for me!</p><p>Too wet.</p></section></body></html>',
        "Bread without kneading\nMix flour, water, salt and yeast, then wait a day.\nFold the dough twice.\nBake it in a hot pot.",
    ),
    (
        '<nav><a href="#">Start</a> <a href="#">Shop</a></nav><article><p>Ein Satz, der lang genug ist, um als Text zu gelten.</p><div class="ad-box"><p>Jetzt kaufen und sparen!</p></div>'
        "<p>Ein zweiter Satz folgt nach der Anzeige, und er ist auch lang.</p></article><div class='newsletter'><form><label>Name</label><input></form></div>",
        "Ein Satz, der lang genug ist, um als Text zu gelten.\nEin zweiter Satz folgt nach der Anzeige, und er ist auch lang.",
    ),
    (
        "<body><div class='content'><h1>Table of rivers</h1><table><tr><td>Rhine</td><td>1233 km</td></tr></table><blockquote>All rivers run to the sea, said the old man.</blockquote></div>"
        "<div class='related'><a href='/1'>Lakes</a><a href='/2'>Seas</a></div></body>",
        "Table of rivers\nRhine\n1233 km\nAll rivers run to the sea, said the old man.",
    ),
]


@pytest.fixture(scope="module")
def model():
    return html_text.model()


@pytest.mark.parametrize("page,want", PAGES)
def test_hand_made_pages(model, page, want):
    assert html_text.main_text(page, *model) == want


TEXT = "A sentence of the article that is long enough to read."
LAST = "One more sentence of the same article, at its end."


@pytest.mark.parametrize(
    "markup",
    [
        f'<article data-note="hidden gem"><p>{TEXT}</p><p>{LAST}</p></article>',
        f"<article title='a style=\"display:none\" class=ad'><p>{TEXT}</p><p>{LAST}</p></article>",
        f"<article><p>{TEXT}</p><video><p>{LAST}</p></article>",
        f"<article><p>{TEXT}</p><noscript><p>{LAST}</p></article>",
        f"<article><p>{TEXT}</p><title><p>{LAST}</p></article>",
        f"<article><p>{TEXT}</p><textarea></textarea><p>{LAST}</p></article>",
        f'<article><p>{TEXT}</p><a href="x>y">z</a><p>{LAST}</p></article>'.replace(">z</a>", "></a>"),
        f"<article><p>{TEXT}</p><svg class=icon /><p>{LAST}</p></article>",
        f"<article><p>{TEXT}</p><p>{LAST}</p></article><p class=\"",
    ],
)
def test_nothing_else_is_dropped(model, markup):
    assert html_text.main_text(markup, *model).split("\n") == [TEXT, LAST]


def test_formulas_and_signs_stay(model):
    page = "<article><p>Here <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds for all of us.</p><p>Prices &lt; 5 and x < y in all of the shops.</p></article>"
    assert html_text.main_text(page, *model) == "Here E=m holds for all of us.\nPrices < 5 and x < y in all of the shops."


def test_attributes_by_name():
    means = html_text._meanings
    assert means(' data-note="hidden gem" data-class="sidebar"') == (frozenset(), False)
    assert means(" hidden")[1] and means(' style="x:y; display : none"')[1] and means(" aria-hidden='true'")[1]
    assert means(' class="left sidebar" id=mainNav')[0] == {"has_side", "has_main", "has_nav"}


@pytest.mark.parametrize("unit", ["<a ", '<p title="', "<!", "</a ", "<a b='", "<", "<b>", "</x>", "<title>", '<p title="x>', "&amp", "<b><p>x</p>"])
def test_time_in_proportion(unit):
    took = []
    for size in (24_000, 240_000):
        began = time.process_time()
        html_text.blocks(unit * (size // len(unit)) + "text")
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 0.05 and took[1] < 2


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", PAGES[0][0], "x", 1), (1, "u", PAGES[0][0], "x", 1), (None, None, None, None, None), (2, "v", "", None, None)]
    pages = spark.createDataFrame(rows, schema)
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert got == [(1, PAGES[0][1], len(PAGES[0][1]))] * 2 + [(None, "", 0), (2, "", 0)]
    assert html_text.extract(pages.limit(0)).collect() == []
