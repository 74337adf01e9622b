"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read once by a tolerant scanner that keeps a stack of open elements; every run of text
between block-level tags is a leaf block. Features are the ancestors' tags, the meaning of words in
their class, id and role attributes, and the block's text. The field (labels: main text or not) is
trained on generated, labelled pages of many layouts and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html
import random
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import crf

_TAG = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
#: The same without quotes, for what follows a tag that never ends: it looks no farther than the next '<'.
_LOOSE = re.compile(r"""<!--|<!\[CDATA\[|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>""")
_TITLE_ENDS = re.compile("</title", re.I)
_OPENS = re.compile(r"<[/!?a-zA-Z]")
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Elements whose content is no markup and no text of the page; without an end tag it is the rest of the page.
RAW = {"script", "style"}
#: Elements that seldom hold text of the page; the field decides.
EMBEDDED = {"title", "textarea", "template", "noscript", "iframe", "object", "svg", "math", "canvas", "select", "audio", "video"}
#: Of these and what is inside them, a tag that ends in '/' opens nothing.
FOREIGN = {"svg", "math"}
VOID = {"br", "img", "meta", "link", "input", "hr", "area", "base", "col", "embed", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "button", "math", "mi", "mn", "mo", "ms", "mrow", "mtext"}
_ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "section", "article", "aside", "nav", "footer", "header", "main", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "figure", "hr", "address", "details", "fieldset"}
_SAME = {"li", "dt", "dd", "tr", "td", "th", "option"}
#: Words in class, id and role attributes, by what they say about the content.
MEANING = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs toc pager pagination tabs toolbar skip",
    "ad": "ad ads adv advert adverts advertisement adsense banner sponsor sponsored promo promotion promoted dfp",
    "side": "sidebar side aside rail widget widgets related recommended trending popular complementary teaser more",
    "foot": "footer foot copyright legal colophon contentinfo bottom",
    "head": "header masthead topbar logo branding top",
    "notice": "cookie cookies consent notice notices gdpr newsletter subscribe subscription popup modal overlay alert warning disclaimer paywall",
    "comment": "comment comments commentlist reply replies respond disqus discussion reviews feedback thread responses",
    "share": "share sharing social follow tags meta byline author",
    "form": "form login signin signup search register contact",
    "main": "article content main post entry story text body prose page markdown",
}
_MEANS = {w: k for k, ws in MEANING.items() for w in ws.split()}
_TAGS = {"article", "main", "section", "nav", "footer", "header", "aside", "form", "ul", "ol", "li", "table", "dl", "blockquote", "figure", "figcaption", "address", "dialog", "details", "button", "fieldset", "menu"}


@functools.lru_cache(8192)
def _meanings(attrs: str) -> tuple[frozenset, bool]:
    """(meanings of the attributes' words, whether the element is hidden)."""
    found, hidden = set(), False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= bool(_NONE.search(value))
        elif name in ("class", "id", "role"):
            for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower()):
                if w in _MEANS:
                    found.add("has_" + _MEANS[w])
    return frozenset(found), hidden


def blocks(page: str | None) -> list[tuple[str, str, frozenset, int]]:
    """(text, own tag, ancestors' features, characters in links) of the leaf blocks with text, in page order.

    Null and empty pages have none. Unclosed, crossed and unknown tags, a page that breaks off and a
    tag that never ends are read as far as they go; a '<' that starts no tag is text. What stands in the head, and a title
    before any text, is no text of the page. Every character is looked at a bounded number of times.
    """
    page = page or ""
    out: list[tuple[str, str, frozenset, int]] = []
    stack: list[tuple[str, frozenset, str]] = []  # tag, features, nearest block-level tag
    open_: dict[str, int] = {}
    parts: list[str] = []
    links, linked, at = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, stack[-1][2] if stack else "body", stack[-1][1] if stack else frozenset(), linked))
            parts.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece:
            parts.append(piece)
            if links:
                linked += len(piece)

    def pop(tag: str) -> None:
        while stack:
            t = stack.pop()[0]
            open_[t] -= 1
            if t == tag:
                return

    tag_at, seen, titles = _TAG, 0, True
    while (start := page.find("<", max(at, seen))) >= 0:
        m = tag_at.match(page, start)
        if not m and tag_at is _TAG and _OPENS.match(page, start):
            tag_at = _LOOSE  # no quoted reading of this tag ends before the page does
            m = tag_at.match(page, start)
        if not m:
            seen = start + 1
            continue
        add(page[at:start])
        at = seen = m.end()
        closing, tag, attrs = m.groups()
        if not tag:
            if (mark := m.group()) in ("<!--", "<![CDATA["):
                end = page.find("-->" if mark == "<!--" else "]]>", at)
                at = len(page) if end < 0 else end + 3
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            flush()
            continue
        if tag == "title" and not closing and not out and not parts and not open_.get("body") and not open_.get("svg"):
            if titles and (end := _TITLE_ENDS.search(page, at)):
                at = end.start()
            else:
                titles = False  # none ends any more
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if closing:
            if open_.get(tag):
                pop(tag)
                links = open_.get("a", 0)
            continue
        if tag in _ENDS_P and open_.get("p"):
            pop("p")
        elif tag in _SAME and stack and stack[-1][0] == tag:
            pop(tag)
        links = open_.get("a", 0)
        if attrs.endswith("/") and (tag in INLINE or tag in FOREIGN or any(open_.get(t) for t in FOREIGN)):
            continue
        means, hidden = _meanings(attrs) if attrs else (frozenset(), False)
        above = stack[-1][1] if stack else frozenset()
        extra = means | ({"in_" + tag} if tag in _TAGS or tag in EMBEDDED else set()) | ({"hidden"} if hidden else set())
        if tag == "head" and not closing:
            extra = extra | {"in_head"}
        elif tag == "body":
            extra = extra - {"has_main"}
        block = tag if tag not in INLINE else stack[-1][2] if stack else "body"
        stack.append((tag, above if extra <= above else above | extra, block))
        open_[tag] = open_.get(tag, 0) + 1
        links = open_.get("a", 0)
    last = page.rfind("<")
    add(page[at:last] if last >= at and _OPENS.match(page, last) else page[at:])  # a tag that the page's end cuts off
    flush()
    return [b for b in out if "in_head" not in b[2]]


def features(found: list[tuple[str, str, frozenset, int]]) -> list[list[str]]:
    out = []
    last = len(found) - 1
    for k, (text, own, above, linked) in enumerate(found):
        n = text.count(" ") + 1
        size = "1" if n == 1 else "2-4" if n < 5 else "5-11" if n < 12 else "12-39" if n < 40 else "40+"
        dense = 2 * linked > len(text)
        fs = ["bias", f"own_{own}", f"size_{size}", *above]
        fs += [f"{x}+article" for x in above if x != "in_article" and "in_article" in above]
        if "has_main" in above and "in_article" not in above:
            fs.append("main_by_name")
        if dense:
            fs.append("dense_links")
        fs.append("ends" if text[-1] in ".!?…:;\"'»)" else "open_end")
        if "©" in text or "copyright" in text.lower():
            fs.append("copyright")
        if not above:
            fs.append(f"bare+{size}")
        if k == 0:
            fs.append("first")
        if k == last:
            fs.append("last")
        out.append(fs)
    return out


def labelled_pages(n: int = 700, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Generated pages of many layouts with the label of each of their leaf blocks (1: main text)."""
    rng = random.Random(seed)
    syll = ["ba", "ren", "to", "ing", "mo", "ka", "sel", "u", "dri", "pa", "é", "ön", "ta", "li", "ver"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    any_of = lambda kind: rng.choice(MEANING[kind].split())
    out = []
    for _ in range(n):
        page: list[str] = []
        labels: list[int] = []

        def put(markup: str, label: int) -> None:
            page.append(markup)
            labels.append(label)

        def sentence(a: int = 3, b: int = 60) -> str:
            return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?", "", "***", "$$$"])

        def attr(kind: str) -> str:
            return rng.choice([f' class="{any_of(kind)}"', f' id="{any_of(kind)}"', f" class='{word()} {any_of(kind)}'", f' class="{word()}-{any_of(kind)}"'])

        def menu() -> None:
            tag = rng.choice(["nav", "nav", "div"])
            page.append(f"<{tag}{attr('nav') if tag == 'div' or rng.random() < 0.3 else ''}><ul>")
            for _ in range(rng.randint(2, 7)):
                put(f'<li><a href="/{word()}">{words(1, 3)}</a></li>', 0)
            page.append(f"</ul></{tag}>")

        def boxed(kind: str, tags: list[str], label: int = 0, most: int = 2, a: int = 2, b: int = 25) -> None:
            tag = rng.choice(tags)
            page.append(f"<{tag}{attr(kind) if tag == 'div' or rng.random() < 0.5 else ''}>")
            for _ in range(rng.randint(1, most)):
                inner = rng.choice(["p", "p", "div", "h4", ""])
                text = sentence(a, b)
                if kind == "foot" and rng.random() < 0.7:
                    text = "&copy; " + text
                if rng.random() < 0.25:
                    text = f'<a href="#">{text}</a>'
                put(f"<{inner}>{text}</{inner}>" if inner else f"<div>{text}</div>", label)
            page.append(f"</{tag}>")

        def comments() -> None:
            page.append(f"<{(tag := rng.choice(['section', 'div', 'ol']))}{attr('comment')}>")
            for _ in range(rng.randint(1, 5)):
                put(rng.choice(["<p>{}</p>", "<div class='comment'><p>{}</p></div>", "<li>{}</li>"]).format(sentence(2, 40)), 0)
            page.append(f"</{tag}>")

        def unseen() -> None:
            tag = rng.choice(["div", "section", "p", "span"])
            page.append(f"<{tag}{rng.choice([' hidden', ' style=\"display:none\"', ' aria-hidden=\"true\"'])}>")
            put(f"<div>{sentence(1, 40)}</div>", 0)
            page.append(f"</{tag}>")

        page.append(rng.choice(["<html><body>", "<!doctype html><html><head><title>" + words(1, 6) + "</title></head><body>", "<title>" + words(1, 6) + "</title><body>"]))
        for extra in rng.sample(["menu", "head", "ad", "notice"], rng.randint(1, 4)):
            if extra == "menu":
                menu()
            elif extra == "head":
                boxed("head", ["header", "header", "div"], a=1, b=8)
            elif extra == "ad":
                boxed("ad", ["div", "div", "aside"])
            else:
                boxed("notice", ["div", "section", "dialog"])
        if rng.random() < 0.3:
            boxed("side", ["aside", "div"], most=4)
        kind = rng.choice(["article", "article", "article", "main", "div", "article-in-main"])
        opening, closing = {"article": ("<article>", "</article>"), "main": ("<main>", "</main>"), "div": (f"<div{attr('main')}>", "</div>"), "article-in-main": ("<main><article>", "</article></main>")}[kind]
        page.append(opening)
        if rng.random() < 0.8:
            h = f"<h1>{words(2, 10)}{rng.choice(['', '.'])}</h1>"
            if rng.random() < 0.2:
                page.append("<header>")
                put(h, 1)
                page.append("</header>")
            else:
                put(h, 1)
        for _ in range(rng.randint(1, 14)):
            roll = rng.random()
            if roll < 0.72:
                put(f"<p>{rng.choice(['', '', '<b>'])}{sentence(1, rng.choice([6, 30, 120]))}</p>", 1)
            elif roll < 0.78:
                put(f"<h2>{words(1, 8)}</h2>", 1)
            elif roll < 0.84:
                page.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    put(f"<li>{sentence(1, 20)}</li>", 1)
                page.append("</ul>")
            elif roll < 0.88:
                put(f"<blockquote>{sentence(4, 30)}</blockquote>", 1)
            elif roll < 0.91:
                page.append("<table>")
                put(f"<tr><td>{words(1, 4)}</td></tr>", 1)
                page.append("</table>")
            elif roll < 0.93:
                unseen()
            else:
                boxed(rng.choice(["ad", "notice", "share", "side"]), ["div", "aside"])
        if rng.random() < 0.2:
            comments()
        page.append(closing)
        if rng.random() < 0.5:
            boxed("side", ["aside", "aside", "div"], most=4)
        if rng.random() < 0.4:
            comments()
        if rng.random() < 0.4:
            tag = rng.choice(["form", "div"])
            page.append(f"<{tag}{attr('form') if tag == 'div' else ''}>")
            put(f"<p><label>{words(1, 4)}</label></p>", 0)
            page.append(f"</{tag}>")
        if rng.random() < 0.85:
            boxed("foot", ["footer", "footer", "div"])
        page.append("</body></html>")
        out.append(("".join(page), labels))
    return out


@functools.cache
def model() -> tuple[dict[str, float], list[list[float]]]:
    """(how much each feature favours main text, transitions)."""
    data = []
    for page, labels in labelled_pages():
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"a generated page has {len(found)} blocks and {len(labels)} labels")
        data.append((features(found), labels))
    weights, chain = crf.train(data, 2, epochs=6, rate=0.15, decay=1e-3)
    return {f: float(w[1] - w[0]) for f, w in weights.items()}, chain.tolist()


def main_text(page: str | None, weights: dict[str, float], chain: list[list[float]]) -> str:
    found = blocks(page)
    if not found:
        return ""
    labels = crf.viterbi_two([sum(weights.get(f, 0.0) for f in fs) for fs in features(found)], chain)
    return "\n".join(b[0] for b, y in zip(found, labels) if y)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per input row; null or empty html gives the empty text.

    Repeated rows give repeated rows; other columns are not read; an empty table gives no rows. A page is
    read whole, however long, in time and memory in proportion to its length.
    """
    weights, chain = model()

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, weights, chain) for p in page], dtype=object)

    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
