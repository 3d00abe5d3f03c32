"""HTML to Markdown: fixed cases, documents built beside their Markdown, and broken markup."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmill.functions import canonical as C
from postmill.functions.markup import MOST_DEPTH, _convert, markdown, markdown_all

CASES = {
    "<h2>Role</h2>\n<p>Tom &amp; Jerry</p>": "## Role\n\nTom & Jerry",
    "<h2>About</h2>\n<p>Hello <strong>world</strong> and <em>soft</em>.</p>\n<ul><li>A</li><li>B</li></ul>\n<ol><li>One</li><li>Two</li></ol>\n<p><a href='https://example.invalid/x'>link</a></p>":
        "## About\n\nHello **world** and *soft*.\n\n* A\n* B\n\n1. One\n2. Two\n\n[link](https://example.invalid/x)",
    "line one<br>line two": "line one\nline two",
    "<p>a</p>\n\n\n\n\n<p>b</p>": "a\n\nb",
    "abc\r\ndef\rghi": "abc\ndef\nghi",
    "<p>line one   </p>\n<p>line two</p>": "line one\n\nline two",
    "\n\n<p>Hello</p>\n\n": "Hello",
    "<p>Hello</p><script>if (a < b) x()</script><style>p {}</style><p>after</p>": "Hello\n\nafter",
    "<p>Café résumé naïve</p>": "Café résumé naïve",
    "": "",
    "<ul><li>a<ul><li>b</li><li>c<ol start=9><li>d</li><li>e<p>f</p></li></ol></li></ul></li><li>g</li></ul>tail": "* a\n  * b\n  * c\n    9. d\n    10. e\n\n        f\n* g\n\ntail",
    "<table><tr><th>a</th><th>b</th></tr><tr><td>c<br>d</td><td>e</td></tr></table>x": "| a | b |\n| --- | --- |\n| c d | e |\n\nx",
    "<table><tbody><tr><td>1</td></tr><tr><td>2</td></tr></tbody></table>": "|  |\n| --- |\n| 1 |\n| 2 |",
    "<table><thead><tr><td>1</td></tr></thead><tbody><tr><td>2</td></tr></tbody></table>": "| 1 |\n| --- |\n| 2 |",
    "<pre><code>a  b\n  c</code></pre>t <code>x`y</code>": "```\na  b\n  c\n```\n\nt `` x`y ``",
    "<a href=u>u</a> <a href=u title='q\"'> z </a><a>n</a><a href=u></a>": '<u>  [z](u "q\\"") n',
    "<blockquote><p>a</p><p>b</p></blockquote>c<hr>d <img src=s alt=l>": "> a\n>\n> b\n\nc\n\n---\n\nd ![l](s)",
    "<h1>a<br>b <p>c</p></h1><dl><dt>t</dt><dd>d</dd></dl>": "# a b c\n\nt\n:   d",
    "<p>a<p>b<b>c": "a\n\nb**c**",  # what is left open ends with the page
    "</p></div>a</b><br/>b</br>": "a\nb",
    "<![if x]>y<!-- c --> z<![endif]><!x><?p q>": "y z",
    "a < b <": "a < b <",
}


@pytest.fixture(scope="module")
def converted(spark):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*CASES, None])], "i int, html string").repartition(3)
    return {r["i"]: r["md"] for r in rows.select("i", C.block(markdown("html")).alias("md")).collect()}


def test_cases(converted):
    assert [converted[i] for i in range(len(CASES))] == list(CASES.values())
    assert converted[len(CASES)] is None


def test_parts(spark):
    d = spark.createDataFrame([(["<p>a</p>", None, ""],), (None,), ([],)], "parts array<string>")
    assert [r["md"] for r in d.select(markdown_all("parts").alias("md")).collect()] == [["a", None, ""], None, []]


WORDS = st.text("abc éß漢.,!-", min_size=1, max_size=12).map(lambda x: " ".join(x.split())).filter(bool)
SPANS = st.one_of(
    WORDS.map(lambda w: (w, w)), WORDS.map(lambda w: (f"<b>{w}</b>", f"**{w}**")), WORDS.map(lambda w: (f"<em>{w}</em>", f"*{w}*")), WORDS.map(lambda w: (f"<code>{w}</code>", f"`{w}`")),
    WORDS.map(lambda w: (f'<a href="/x">{w}</a>', f"[{w}](/x)")), WORDS.map(lambda w: (f"<span>{w}</span>", w)),
)
LINE = st.lists(SPANS, min_size=1, max_size=4).map(lambda xs: tuple(" ".join(part) for part in zip(*xs, strict=True)))


def listed(items, tag):
    """Items as (html, lines of Markdown): the lines below an item's first one stand under its text."""
    html, lines = "", []
    for i, (inside, own) in enumerate(items):
        mark = "* " if tag == "ul" else f"{i + 1}. "
        html += f"<li>{inside}</li>"
        lines += [mark + own[0], *(" " * len(mark) + x for x in own[1:])]
    return f"<{tag}>{html}</{tag}>", lines


ITEMS = st.recursive(
    LINE.map(lambda x: (x[0], [x[1]])),
    lambda below: st.tuples(LINE, st.lists(below, min_size=1, max_size=3), st.sampled_from(("ul", "ol"))).map(
        lambda x: (x[0][0] + listed(x[1], x[2])[0], [x[0][1], *listed(x[1], x[2])[1]])
    ),
    max_leaves=8,
)
LISTED = st.tuples(st.lists(ITEMS, min_size=1, max_size=4), st.sampled_from(("ul", "ol"))).map(lambda x: listed(*x)).map(lambda x: (x[0], "\n".join(x[1])))
GRID = st.integers(1, 3).flatmap(lambda n: st.lists(st.lists(LINE, min_size=n, max_size=n), min_size=1, max_size=4))


def tabled(rows):
    html = "".join("<tr>" + "".join(f"<{'td' if i else 'th'}>{c[0]}</{'td' if i else 'th'}>" for c in r) + "</tr>" for i, r in enumerate(rows))
    lines = ["| " + " | ".join(c[1] for c in r) + " |" for r in rows]
    return f"<table>{html}</table>", "\n".join([lines[0], "| " + " | ".join("---" for _ in rows[0]) + " |", *lines[1:]])


BLOCK = st.one_of(
    LINE.map(lambda x: (f"<p>{x[0]}</p>", x[1])), LINE.map(lambda x: (f"<div><section>{x[0]}</section></div>", x[1])), st.tuples(st.integers(1, 6), LINE).map(lambda x: (f"<h{x[0]}>{x[1][0]}</h{x[0]}>", "#" * x[0] + " " + x[1][1])),
    LISTED, GRID.map(tabled), LINE.map(lambda x: (f"<blockquote><p>{x[0]}</p></blockquote>", "> " + x[1])), st.just(("<hr>", "---")),
)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(BLOCK, min_size=1, max_size=6), st.sampled_from(("", "\n", "  \r\n\t")), st.booleans())
def test_documents(blocks, between, wrapped):
    """Blocks stand an empty line apart, whatever white space or wrapper their markup has."""
    html = between.join(b[0] for b in blocks)
    assert _convert(f"<html><body>{html}</body></html>" if wrapped else html) == "\n\n".join(b[1] for b in blocks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"ab \n", "<p>", "</p>", "<li>", "</li>", "<ul>", "</ul>", "<td>", "<tr>", "</table>", "<b>", "</b>", "<pre>", "</pre>", "<br>", "<!--", "-->", "<![", "&amp", "<", "<h1>", "</h1>", "<ol start=x>"]), max_size=40))
def test_anything_ends(parts):
    assert isinstance(_convert("".join(parts)), str)


def test_deep_and_long():
    assert _convert("<p>" * 20_000 + "x" + "</p>" * 20_000 + "y") == "x\n\ny"
    assert _convert("<ul><li>word " * (5 * MOST_DEPTH)).count("word") == 5 * MOST_DEPTH  # elements below the depth lose no text
    long = _convert("<p>a word</p>" * 200_000)
    assert long.count("a word") == 200_000 and long.startswith("a word\n\na word")


def test_elements_left_open_at_any_depth():
    """Below a depth of 200 none loses its marks."""
    assert _convert("<p><b>a " * 3 * MOST_DEPTH).count("**") == 6 * MOST_DEPTH
    assert _convert("<b>x" * 100_000) == "**x" * 100_000 + "**" * 100_000


def test_pages_of_many_open_elements_and_a_cut_reference(spark, tmp_path):
    """html_markdown against its SQL: more than 200 open elements, and a title that ends within a reference."""
    import duckdb

    from postmill import catalogue

    head = '<!DOCTYPE html><html lang="en"><head><title>{0}</title></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav><!-- ad --><div class="ad">b</div><article><h1>{0}</h1>'
    pages = [(0, head.format("t = &quot") + "<p><b>a.<br></article></body></html>"), (1, head.format("t") + "<p><b>a.<br>" * 300 + "<p>c</p></article></body></html>"), (2, head.format("t &quot;e") + "<p>c &am</p></article>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["markdown"] for r in catalogue.QUERIES["html_markdown"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == dict(c.execute(catalogue.ORACLES["html_markdown"]).fetchall())
