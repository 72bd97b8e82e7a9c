"""Main text of pages: densities by hand, and pages whose parts are known."""

import itertools
import math
import random
import time

import pytest

from vireo.llm import html

TEXT = "This paragraph is the main text of the page and has no links in it at all. " * 4
LINKS = "".join(f'<li><a href="/{i}">Link {i}</a></li>' for i in range(12))
PAGE = f"""<!doctype html><html><head><title>Title</title><style>p {{ color: red }}</style><script>var x = "<p>no</p>";</script></head>
<body><nav><ul>{LINKS}</ul></nav><div id=main><h1>Heading</h1><p>{TEXT}</p><p>Second: {TEXT}<p>Third &amp; last: {TEXT}</div>
<div class=foot><a href=/>Home</a> | <a href=/about>About</a></div></body></html>"""


def test_density_by_hand():
    c, t, lc, lt, cb, lcb = 100, 4, 10, 2, 500, 50
    want = c / t * math.log(c / lc * t / lt) / math.log(math.log(c / (c - lc) * lc + lcb / cb * c + math.e))
    assert html.density(c, t, lc, lt, cb, lcb) == pytest.approx(want)
    assert html.density(0, 4, 0, 0, 500, 50) == 0 and html.density(100, 0, 100, 0, 100, 100) < html.density(100, 0, 0, 0, 100, 0)


def test_main_text_is_found():
    out = html.extract(PAGE)
    assert "Heading" in out or out.startswith("This paragraph")
    assert out.count("This paragraph is the main text") == 12 and "Third & last" in out
    assert "Link 3" not in out and "About" not in out and "color" not in out and "var x" not in out and "Title" not in out
    assert "\nSecond:" in "\n" + out and "\nThird" in out


@pytest.mark.parametrize(
    "page,text",
    [
        (None, None),
        ("", ""),
        ("<html></html>", ""),
        ("<div><script>x</script><!-- note --></div>", ""),
        ("no tags at all", "no tags at all"),
        ("<p>unclosed <b>bold", "unclosed bold"),
        ("<p>a &lt; b &amp; c</p>", "a < b & c"),
        ("text <!-- never closed", "text"),
        ("<body><p>one</p><p>two</p></body>", "one\ntwo"),
        ("<p>x < y</p>", "x < y"),
        ('<p title="a > b">Hello', "Hello"),
        ("<p title='a > b' class=x>Hello", "Hello"),
        ("<p title=it's>one</p><p>two</p>", "one\ntwo"),
        ('<p title="never closed>one</p><p>two</p>', "one\ntwo"),
        ("<head><title>t</title><p>text</p>", "text"),
        ("<html><head><title>t<div>text</div>", "text"),
        ("<head><meta charset=utf-8><script>x</script>loose text", "loose text"),
        ("<head><title>t</title></head><p>text", "text"),
        ("<i>a<b>b</i>c</b>", "abc"),
    ],
)
def test_small_pages(page, text):
    assert html.extract(page) == text


def test_deep_and_long_pages():
    deep = "<div>" * 5000 + TEXT + "</div>" * 5000
    assert html.extract(deep).strip() == TEXT.strip()
    long = f"<body>{'<p>' + TEXT + '</p>'}" * 3000
    assert html.extract(long).count("main text") == 12_000
    assert html.extract("<" * 100_000) is not None and html.extract("<a " * 100_000) is not None


@pytest.mark.parametrize("n", [4000, 40_000])
def test_pages_that_never_close_take_linear_time(n):
    pages = ["<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<hr>" * n, '<a x="' * n, "<a x='>" * n, "<b>" * n + "<p>x" * n]
    for page in pages:
        began = time.process_time()
        assert html.extract(page + "text") is not None
        assert time.process_time() - began < n * 2e-4 + 1


def brute(body):
    """The marked texts of a tree (tag, children), children being trees or words: every rule by its definition, recursively."""
    nodes = []

    def walk(node, path):
        path = [*path, node]
        nodes.append((node, path))
        for c in node[1]:
            if isinstance(c, tuple):
                walk(c, path)

    walk(body, [])
    below = lambda x: [y for c in x[1] if isinstance(c, tuple) for y in (c, *below(c))]
    words = lambda x, link=False: sum(len(c) * (not link or x[0] == "a") if isinstance(c, str) else words(c, link) if x[0] != "a" else words(c) for c in x[1])

    def link_chars(x, inside):
        inside = inside or x[0] == "a"
        return sum((len(c) if inside else 0) if isinstance(c, str) else link_chars(c, inside) for c in x[1])

    whole = words(body), link_chars(body, False)
    density = {}
    for x, path in nodes:
        inner = below(x)
        density[id(x)] = html.density(words(x), len(inner), link_chars(x, any(p[0] == "a" for p in path)), sum(y[0] == "a" for y in inner), *whole)
    total = {id(x): sum(density[id(c)] for c in x[1] if isinstance(c, tuple)) for x, _ in nodes}
    best = lambda x: max([x, *below(x)], key=lambda y: total[id(y)])  # noqa: E731 - the first of equals, in document order
    top = best(body)
    threshold = min(density[id(p)] for x, path in nodes if x is top for p in path)
    marked = set()

    def mark(x):
        if density[id(x)] >= threshold - 1e-9:
            if total[id(best(x))] > 0 or x is body and words(body) and best(body) is body:
                marked.add(id(best(x)))
            for c in x[1]:
                if isinstance(c, tuple):
                    mark(c)

    mark(body)
    return [c for x, path in nodes if any(id(p) in marked for p in path) for c in x[1] if isinstance(c, str)]


def test_marking_equals_brute_force():
    rng = random.Random(2)
    number = itertools.count()

    def tree(depth, link):
        tag = rng.choice(["div", "section", "span", "em"] + ["a"] * (not link))
        kids = []
        for _ in range(rng.randrange(0, 4)):
            kids.append(tree(depth - 1, link or tag == "a") if depth and rng.random() < 0.6 else f"w{next(number)}x" + "y" * rng.randrange(0, 40))
        return tag, kids

    def page(x):
        return f"<{x[0]}>" + "".join(f" {c} " if isinstance(c, str) else page(c) for c in x[1]) + f"</{x[0]}>"

    part = 0
    for _ in range(600):
        body = "body", [tree(4, False) for _ in range(rng.randrange(1, 5))]
        got, want = html.extract(page(body)).split(), brute(body)
        assert sorted(got) == sorted(want)
        part += 0 < len(want) < page(body).count("x")
    assert part > 100


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", None), (1, "u", PAGE, "x")], "page_id bigint, url string, html string, text string")
    out = html.extracted(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 4
    assert {(r.page_id, r.url, r.n_chars) for r in out.collect()} == {(1, "u", len(html.extract(PAGE))), (2, None, None), (None, "v", 0)}
    assert html.extracted(pages.limit(0)).count() == 0
