import re
import time
from html import unescape

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakescan.llm.html_extract import HEADINGS, HOLDERS, LESS, PARAGRAPHS, _by_name, _Page, _points, blocks_of, main_text
from lakescan.llm.queries import op1_html_extract

LONG = "This is a paragraph of the article, with commas, and with enough words to count as text."


def planted(html):
    """The article of a generated page: its h1 and paragraphs, in order."""
    body = html.split("<article>")[1].split("</article>")[0]
    parts = re.split(r"</?(?:h1|p)>", body)
    texts = [" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
    return "\n\n".join(t for t in texts if t)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.001"])
def test_generated_pages(spark, sf):
    d = f"/root/testdata/{sf}"
    want = {i: planted(h) for i, h in duckdb.sql(f"SELECT page_id, html FROM '{d}/pages.parquet'").fetchall()}
    got = op1_html_extract(spark, d).collect()
    assert {g.page_id: g.text for g in got} == want
    assert all(g.n_chars == len(g.text) for g in got)


def test_surroundings_are_left_out():
    page = f"""<!doctype html><html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head>
    <body class="with-sidebar"><header><h1>Site name</h1><p>{LONG}</p></header>
    <div id="main-menu"><a href="/">Home</a> <a href="/b">B</a></div>
    <div class="cookie-notice"><p>{LONG} cookies</p></div>
    <main><article class="post"><header><h2>Head &amp; line</h2><p>by Someone</p></header>
    <p>First{LONG}<br>more&nbsp;&nbsp;words <a href="x">link</a>.<p>Second {LONG} &lt;b&gt; &#233;&#x1F642;
    <ul><li>one item, {LONG}<li>another item, {LONG}</ul>
    <div class="ad-slot"><p>{LONG} advert</p></div>
    <form><p>{LONG} form</p><input name=q></form><style>p {{}}</style>
    <ul><li><a href=1>rel one</a></li><li><a href=2>rel two</a></li></ul>
    <blockquote>Quoted, {LONG}</blockquote><table><tr><td>c1<td>c2</table></article>
    <section id="comments"><p>{LONG} said a reader</p></section></main>
    <aside><p>{LONG} aside</p></aside><footer>&copy; {LONG}</footer></body></html>"""
    assert blocks_of(page) == [
        "Head & line", f"First{LONG} more words link.", f"Second {LONG} <b> é🙂", f"one item, {LONG}", f"another item, {LONG}", f"Quoted, {LONG}", "c1", "c2",
    ]


def test_containers_without_article_elements():
    p = f"<p>{LONG}</p>"
    page = f"<body><div class=menu>{p}</div><div class=wrap><div class=left><a href=a>x</a><a href=b>y</a></div><div class=content><h1>H</h1>{p * 3}<p>Short.</p></div></div></body>"
    assert blocks_of(page) == ["H", LONG, LONG, LONG, "Short."]
    assert blocks_of(f"<div>{LONG}<br><br>{LONG}</div>") == [f"{LONG} {LONG}"]
    sections = f"<body><div id=x><section>{p * 2}</section><section>{p * 2}</section></div></body>"
    assert blocks_of(sections) == [LONG] * 4


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!-- never closed", "<script>x", "<p a='x>y", "</div></p>", "&", "<a <b <c>", "<" * 3000, "<div>" * 3000, "<b>" * 3000 + "x" + "</b>" * 3000])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)
    assert main_text(f"{page or ''}") == main_text(page)


WRAPPERS = [
    'class="content has-sidebar"', 'class="post no-comments"', 'class="single ad-free"', 'id="page" class="with-sidebar"',
    'class="container has-sidebar"', "class=no-sidebar", 'class="layout-with-nav"', 'class="post promoted"', 'class="search-result"', 'id="page-with-comments"',
]


@pytest.mark.parametrize("name", WRAPPERS)
def test_names_of_wrappers_do_not_drop_the_article(name):
    p = f"<p>{LONG}</p>"
    extra = f"<div class=sidebar>{p}</div><div class='ad'>{p}</div><section id=comments>{p}</section>"
    want = ["H", LONG, LONG, LONG]
    assert blocks_of(f"<body><div {name}><article><h1>H</h1>{p * 3}<div class=ad>{p}</div></article>{extra}</div></body>") == want
    assert blocks_of(f"<body><div {name}><main><h1>H</h1>{p * 3}</main></div>{extra}</body>") == want
    assert blocks_of(f"<body><div {name}><h1>H</h1>{p * 3}</div></body>") == want
    assert blocks_of(f"<body><div {name}><div><h1>H</h1>{p * 5}</div></div>{extra}</body>") == ["H"] + [LONG] * 5


def test_long_comments_beside_an_article_are_left_out():
    p = f"<p>{LONG}</p>"
    assert blocks_of(f"<body><article><h1>H</h1>{p * 2}</article><section id=comments>{p * 30}</section></body>") == ["H", LONG, LONG]
    assert blocks_of(f"<body><article><h1>H</h1>{p * 2}</article><div id=comments>{f'<article class=comment>{p}</article>' * 30}</div></body>") == ["H", LONG, LONG]
    assert blocks_of(f"<body><article><h1>H</h1>{p * 2}</article><div id=comments>{f'<article>{p}</article>' * 30}</div></body>") == ["H", LONG, LONG]
    assert blocks_of(f"<body><div class=has-sidebar><article><h1>H</h1>{p * 2}</article><div id=comments>{p * 30}</div></div></body>") == ["H", LONG, LONG]


def plain(page):
    """The scoring with a walk over the ancestors of every block, and of every element for what is left out by name."""
    p = _Page()
    p.read(page)

    def above(n):
        while n > 0:
            yield n
            n = p.parents[n]

    def total(of, n):
        return sum(of(b) for b in blocks if n in above(b[0]))

    left_out, less = _by_name(p)
    blocks = [b for b in p.blocks if not left_out & set(above(b[0]))]
    size, link = (lambda b: len(b[1])), (lambda b: b[2])
    lists = {n for n, t in enumerate(p.tags) if t in ("ul", "ol", "dl", "table") and total(link, n) > 0.6 * total(size, n)}
    blocks = [b for b in blocks if not lists & set(above(b[0]))]
    score = {}
    for owner, text, links in blocks:
        if p.tags[owner] not in HEADINGS:
            for level, n in enumerate(above(p.parents[owner] if p.tags[owner] in PARAGRAPHS else owner)):
                score[n] = score.get(n, 0) + _points(text, links) / 2**level
    if not score:
        return [t for _, t, links in blocks if 2 * links <= len(t)]
    score = {n: x * (1 - total(link, n) / max(total(size, n), 1)) * (LESS if n in less else 1) for n, x in score.items()}
    best = max(score, key=lambda n: (round(score[n], 9), n))
    holder = next((n for n in above(p.parents[best]) if p.tags[n] in HOLDERS and 2 * total(size, best) >= total(size, n)), None)
    if holder:
        score[holder], best = max(score.get(holder, 0), score[best]), holder
    kept = {best} | {n for n, x in score.items() if p.parents[n] == p.parents[best] and x >= 0.25 * score[best] - 1e-9}
    kept |= {n for n, text, links in blocks if p.parents[n] == p.parents[best] and p.tags[n] == "p" and len(text) > 80 and 4 * links < len(text)}
    return [text for owner, text, _ in blocks if kept & set(above(owner))]


SOUP = ["<div>", "</div>", "<div class=sidebar>", "<div class='post no-comments'>", "<section>", "</section>", "<article>", "</article>", "<p>", "</p>", "<ul>", "<li>", "</ul>", "<a href=x>", "</a>", "<h2>", "</h2>", "<table><tr><td>", "</table>", "<b>", "</b>", LONG, f"<p>{LONG}</p>", "short", "a, b, c"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(SOUP), max_size=40))
def test_scoring_equals_plain_walks(parts):
    assert blocks_of("".join(parts)) == plain("".join(parts))


MB = 1_000_000
LONG_PAGES = {
    "nested": "<div>x" * (MB // 6), "nested, closed": "<div>x" * (MB // 12) + "</div>" * (MB // 12), "named": "<div class=sidebar>x" * (MB // 20),
    "inline": "<b>x" * (MB // 4), "open tags": "<a " * (MB // 3), "declarations": "<!x " * (MB // 4), "quotes": "<a '\">" * (MB // 6), "one quote": "<a '>" * (MB // 5) + "'",
    "paragraphs in buttons": "<p><button>" * (MB // 11), "lists": "<ul><li>x" * (MB // 9), "tables": "<table><tr><td>x" * (MB // 16), "comments": "<!--" * (MB // 4), "ends": "</p>" * (MB // 4), "less": "<" * MB,
    "articles": "<article>x" * (MB // 10), "headers": "<header><h1>x" * (MB // 13), "scripts": "<script>x</script>" * (MB // 18), "attributes": "<p " + "a=b " * (MB // 4) + ">x", "spaces": "<p a" + " " * MB + "b>x",
}


@pytest.mark.parametrize("name", LONG_PAGES)
def test_time_grows_with_the_length_of_odd_pages(name):
    begin = time.process_time()
    main_text(LONG_PAGES[name])
    assert time.process_time() - begin < 10


def test_plain_text_and_entities():
    assert main_text("just &eacute; text\n\twith   space") == "just é text with space"


def test_odd_rows(spark, tmp_path):
    rows = [(1, None, None), (None, "u", "<p>x</p>"), (2, "u", ""), (2, "u", ""), (3, "u", f"<p>{'word, ' * 60000}</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars").write.parquet(f"{tmp_path}/pages.parquet")
    got = op1_html_extract(spark, str(tmp_path)).collect()
    assert sorted((str(g.page_id), g.n_chars) for g in got) == [("1", 0), ("2", 0), ("2", 0), ("3", 359999 - 0), ("None", 1)]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/e/pages.parquet")
    assert op1_html_extract(spark, f"{tmp_path}/e").count() == 0
