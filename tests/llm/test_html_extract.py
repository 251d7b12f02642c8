import math
import re
import time
from html import unescape

from footfall.llm import html_extract as H
from footfall.llm import queries

LONG = "A long sentence, with some commas, that goes on; and on. It has a second part, too."


def test_article():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var t="</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">menu a</a><li><a>menu b</a></ul></nav><div class="ad">Buy this, now.</div>
    <article><h1>Head &amp; tail</h1><p><b>One  two\n three&nbsp;four<br><p>{LONG}</p><aside>side</aside><ul><li>item</li></ul>
    <form><p>mail me</p></form><div id="comments"><p>{LONG} says a reader</p></div></article>
    <section class="cookie-notice">We use cookies, and so on.</section><footer>&copy; x</footer>"""
    assert H.extract(page) == f"Head & tail\nOne two three four\n{LONG}\nitem"


def test_ratios_without_marks():
    body = "".join(f"<p>{LONG} {i}</p>" for i in range(6))
    page = f"<body><div><a href=x>home</a> <a href=y>news</a></div><table><tr><td>short<td>cell</table><div><h2>Title</h2>{body}</div><div>end note</div></body>"
    text = H.extract(page).split("\n")
    assert text == ["Title", *(f"{LONG} {i}" for i in range(6))]


def body(n=6):
    return "".join(f"<p>{LONG} {i}</p>" for i in range(n)), [f"{LONG} {i}" for i in range(n)]


def test_names_and_tags_only_weigh():
    paragraphs, want = body()
    cards = "".join(f'<article class="teaser"><h3><a href=x>Card {i}</a></h3><p>A short tease</p></article>' for i in range(2))
    page = f'<body><nav><a href=x>Home</a></nav><div class="content"><h1>Title</h1>{paragraphs}</div>{cards}<footer>end</footer></body>'
    assert H.extract(page).split("\n") == ["Title", *want]  # a body in a div beside teaser articles
    for name in ("no-sidebar", "right-sidebar", "content has-sidebar"):
        assert H.extract(f'<div class="{name}"><article>{paragraphs}</article></div>').split("\n") == want
    inside = '<p class="share-price">The price was 4.</p><div class="share-buttons">Tell all of them, now.</div>'
    assert H.extract(f"<article>{paragraphs}{inside}</article>").split("\n") == [*want, "The price was 4."]
    talk = "".join(f'<article class="comment-body"><p>{LONG} says {i}</p></article>' for i in range(20))
    for box in ('<div class="comment-list">', "<section id=comments>", "<div class='post-comments'>"):
        assert H.extract(f"<main>{paragraphs}{box}{talk}</main>").split("\n") == want
    assert H.extract(f"<form id=aspnetForm><main>{paragraphs}</main></form>").split("\n") == want
    assert H.extract(f"<article>{paragraphs}<p>All of <span class='widget-free'>it</span>.</p></article>").split("\n") == [*want, "All of it."]
    assert H.extract("<nav><p>Only a menu.</p></nav><footer>And an end.</footer>") == ""


def test_deep_and_wide_pages():
    for page, want in (
        ("<div>x" * 50_000, 50_000),
        ("<p><b>" * 50_000 + "y", 1),
        ("<div>" * 50_000 + "</p></li>" * 50_000 + "z", 1),
        ("<ul>" + "<li><div>i" * 30_000, 30_000),
    ):
        began = time.monotonic()
        assert len(H.blocks(page)[0]) == want
        H.extract(page)
        assert time.monotonic() - began < 15


def plain_ratios(found, paths):
    """The ratios from whole tuples of paths, every sum made anew."""

    def whole(k):
        return (*whole(paths.parent[k]), k) if k else ()

    where = [whole(b.path) for b in found]

    def around(prefix):
        inside = [b for b, w in zip(found, where, strict=True) if w[: len(prefix)] == prefix]
        chars, n = sum(len(b.text) for b in inside), len(inside)
        marks = sum(len(H.PUNCTUATION.findall(b.text)) for b in inside)
        return chars / n * (1 + marks / n) * (1 - sum(b.linked for b in inside) / chars)

    def mean(path, of):
        values = [of(b) for b, w in zip(found, where, strict=True) if w == path]
        return sum(values) / len(values)

    def smooth(i, of):
        near = [(j, 1 + (j == i)) for j in (i - 1, i, i + 1) if 0 <= j < len(found) and found[j].parent == found[i].parent]
        return sum(w * mean(where[j], of) for j, w in near) / sum(w for _, w in near)

    fused = {}
    for path in set(where):
        at = [i for i, w in enumerate(where) if w == path]
        own = sum(smooth(i, lambda b: len(b.text)) * (1 + smooth(i, lambda b: len(H.PUNCTUATION.findall(b.text)))) for i in at) / len(at)
        free = 1 - sum(found[i].linked for i in at) / sum(len(found[i].text) for i in at)
        fused[path] = math.sqrt(own * free * max(around(path[:k]) for k in range(max(1, len(path)))))  # the root is its own surrounding
    for i in range(len(found) - 2, -1, -1):
        if re.fullmatch("h[1-6]", paths.tag[found[i].path]) and found[i].parent == found[i + 1].parent:
            fused[where[i]] = max(fused[where[i]], fused[where[i + 1]])
    return {path[-1] if path else 0: v for path, v in fused.items()}


def test_ratios_against_a_plain_version(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    paragraphs, _ = body()
    pages += [f"<div><h2>a</h2><h3>b</h3>{paragraphs}<ul><li><a>x, y</a> z<li>w</ul></div>loose <i>end</i>", "no tags"]
    for page in pages:
        found, paths = H.blocks(page)
        got, _ = H.path_ratios(found, paths)
        want = plain_ratios(found, paths)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)


def test_odd_input():
    assert H.extract("") == "" and H.extract("<p></p>") == ""
    assert H.extract("just text & more &lt;b&gt;") == "just text & more <b>"
    assert H.extract("<p>a < b and c") == "a < b and c"
    assert H.extract("<p>bo<b>l</b>d</P><script>never closed <p>x") == "bold"
    assert H.extract("<a href='x>" * 3000 + "y") is not None
    assert H.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_pages(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = queries.op3_html(spark, folder).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*?)</article>", pages[row.page_id], re.S)[1]
        parts = (" ".join(unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", article))
        assert row.text == "\n".join(p for p in parts if p)
        assert row.n_chars == len(row.text)


def test_frames(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", None, "x"), (None, None, "<p>t", "y")], "page_id long, url string, html string, text string")
    out = H.main_text(pages, ["page_id", "url"])
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in out.collect()) == [(0, "t", 1), (1, "", 0), (1, "", 0)]
    assert H.main_text(pages.limit(0), ["page_id", "url"]).count() == 0
