import math

import pytest

from papyra.llm import html

from .conftest import prose, rows

ARTICLE = "<article><h1>T &amp; u</h1><p>one\n two&nbsp;<b>three</b><br>four<p>five &lt;x&gt; &#233;</article>"
MAIN = "T & u\none two three four\nfive <x> é"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), (f"<body><nav>menu</nav>{ARTICLE}<footer>f</footer>", MAIN),
        ("<header><h1>site</h1></header>" + ARTICLE, MAIN), ("<script>var t='</p><article>no';</script>" + ARTICLE, MAIN), ("<style>p{}</style><!-- <article>no</article> -->" + ARTICLE, MAIN),
        (ARTICLE.replace("</article>", '<aside>a</aside><div class="reader-comments"><p>c</p></div><form><p>f</p><button>b</button></form></article>'), MAIN),
        (ARTICLE + '<div id="cookieNotice">n</div><section class="comments"><article><p>reply</p></article></section>', MAIN),
        ("<body><div class='ad'>buy</div><p>a</p><div>b<div>c</div>d</div>", "a\nb\nc\nd"), ("<main><p>in</p></main><p>out</p>", "in"), ("<div role=main><p>in</p></div><p>out</p>", "in"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><header><h1>kept</h1></header></article>", "a\nb\nc\nd\nkept"), ("<p>a<b>b</p><p>c</b>d</p>", "ab\ncd"), ("<p hidden>x</p><p style='display: none'>y</p><p>z</p>", "z"),
        ("<p>3 < 4 & 5 > 2 <3</p>", "3 < 4 & 5 > 2 <3"), ("<p>open <!-- never", "open"), ('<p title="un>text</p><p>b', "text\nb"), ("<p title='un>text", "text"), ('<p title="a>b" id=c>text', "text"), ('<p data-x="1" "odd>text', "text"), ("<p it's>text</p><p>it's", "text\nit's"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x</annotation></math> holds</p>", "so x=1 holds"), ("<p>a <svg><text>no</text></svg>b<script>no</script> c <button>no</button>d <input>e</p>f", "a b c d e\nf"),
        ("<p>a <svg/>b</p><p><select><option>x</select>c</p>", "a b\nc"), ("<div><svg><p>no</div><p>b</p>", "b"), ("<article><p>a</article", "a</article"), ("<p>" + "w " * 50000 + "</p>", " ".join(["w"] * 50000)),
    ],
)
def test_extract(page, text):
    assert html.extract(page) == text


def test_style_tree(spark):
    """A branch that says the same on every page of its host goes; a paragraph of the article that repeats stays."""
    same = "<p>Stay in touch with all our news</p>"
    pages = [(i, f"http://a.example/{i}", f"<body><div class='box{i}'><div class='box7'>{same}</div></div><article><div class='promo-free strip'>read more here</div><p>{prose(i, 12)}</p><p>shared line</p></article>") for i in range(30)]
    pages += [(100 + i, f"http://b.example/{i}", f"<body><div class='strip'>{prose(50 + i, 5)}</div><p>{prose(80 + i, 9)}</p>") for i in range(10)]
    pages += [(200, None, "<p>x</p>"), (201, "no url", None), (200, None, "<p>x</p>"), (None, "http://a.example/", "<p>y</p>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, host string")
    out = {(r.page_id, r.url): r for r in html.main_text(df).collect()}
    assert out[3, "http://a.example/3"].text == f"{prose(3, 12)}\nshared line"
    assert out[103, "http://b.example/3"].text == f"{prose(53, 5)}\n{prose(83, 9)}"
    assert out[200, None].text == "x" and out[201, "no url"].text == "" and out[None, "http://a.example/"].n_chars == 1
    assert html.main_text(df).count() == len(pages)
    assert html.main_text(df.limit(0)).count() == 0
    tree = {(r.host, r.path): r for r in html.importance(df.select("html", html.F.lit("h").alias("host"))).collect()}
    assert tree["h", "/body/article/p"].importance > 0.8 and tree["h", "/body/div.box0/div.box0/p"].importance < 0.1


LONG = "words of the article that are many more than all others on this page"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div class='content-sidebar-wrap'><article><p>{LONG}</p></article><div class='sidebar'>links</div></div>", LONG), (f"<div class='layout no-sidebar'><p>{LONG}</p></div><p>b</p>", f"{LONG}\nb"),
        (f"<article class='post ad-free'><p>{LONG}</p></article>", LONG), (f"<main class='search-results'><p>{LONG}</p></main><p>b</p>", LONG), (f"<div class='sidebar'><main><p>a</p></main></div><p>{LONG}</p>", f"a\n{LONG}"),
        (f"<article><div class='article-header'><h1>T</h1></div><p>{LONG}</p></article>", f"T\n{LONG}"), (f"<div class='banner'><p>{LONG}</p><div class='ad'>buy</div></div><p>b</p>", f"{LONG}\nb"),
        *((f"<article><div class='{w}'>t</div><p>{LONG}</p></article>", f"t\n{LONG}") for w in ("side", "form", "notice", "tags", "share", "toc", "discussion")),
        (f"<article class='sponsored'><p>a</p></article><div class='related'><p>{LONG}</p></div>", "a"), (f"<article><p>a</p><div class='comments'>{LONG}</div></article>", "a"),
        (f"<article><p>{LONG}</p></article><article class='comment'><p>b</p></article><div class='sidebar'><article>c</article></div>", LONG), (f"<div class='text'><p>{LONG}</p></div><div id='comments'><article>b</article></div>", LONG),
        (f"<p>{LONG}</p><div class='sidebar-wrapper'>s</div><div class='site-header'>h</div><div role='search'>r</div><div class='ad-container'>x</div><div class='hidden'>y</div>", LONG),
        (f"<div class='comment'><p>{LONG}</p></div><div class='comment'><p>{LONG}</p></div>", f"{LONG}\n{LONG}"),
    ],
)
def test_names(page, text):
    """A name alone drops neither the article nor most of the text; negated, layout and weak names drop nothing."""
    assert html.extract(page) == text


def test_lists_of_every_page(spark):
    """m is pages, however many texts a branch holds; what holds a page's own text is not taken along."""
    items = "".join(f"<li>Department {'abcdef'[k]}</li>" for k in range(6))
    many = "".join(f"<li>{prose(900 + k, 2)}</li>" for k in range(60))
    lines = "".join(f"<p>legal line {'abc'[k]}</p>" for k in range(3))
    pages = [(i, f"http://a.example/{i}", f"<body><ul class='depts'>{items}</ul><div class='text'><p>{prose(i, 12)}</p></div><div class='small'>{lines}</div>") for i in range(100)]
    pages += [(200 + i, f"http://b.example/{i}", f"<body><div id='wrap'><ul>{many}</ul><p>{prose(300 + i, 12)}</p></div>") for i in range(8)]
    pages += [(300 + i, f"http://c.example/{i}", f"<body><div id='wrap'><script>{i}</script><ul>{items}</ul><article><p>the same notice</p></article></div>") for i in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert all(out[i] == prose(i, 12) for i in range(100))
    assert all(out[200 + i] == prose(300 + i, 12) for i in range(8))
    assert all(out[300 + i] == "the same notice" for i in range(9))
    tree = {r.path: r for r in html.importance(df.where("page_id < 100").select("html", html.F.lit("h").alias("host"))).collect()}
    assert tree["/body"].m == tree["/body/ul.depts"].m == tree["/body/ul.depts/li"].m == 100 and tree["/body/ul.depts"].importance < 0.01


def plain_importance(pages):
    """Of each node of one host's pages: distinct pages, and importance, from dictionaries of sets."""
    texts, shown = {}, {}
    for k, page in enumerate(dict.fromkeys(p for p in pages if p)):
        own = {}
        for node, t in html.content(page):
            parts = node.path.split("/")
            for n in range(2, len(parts) + 1):
                texts.setdefault("/".join(parts[:n]), {}).setdefault((node.path, t), set()).add(k)
            if node.children:
                own.setdefault(node.path, set()).add(tuple(dict.fromkeys(node.children)))
        for path, x in own.items():
            for c in x:
                shown.setdefault(path, {}).setdefault(c, set()).add(k)
    out = {}
    for path, by in texts.items():
        m = len(set.union(*by.values()))
        content = 1 - sum(math.log(len(p)) for p in by.values()) / len(by) / math.log(m) if m > 1 else 1
        n = [len(p) for p in shown.get(path, {}).values()]
        presentation = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(sum(n)) if sum(n) > 1 else 0
        out[path] = m, 1.0 if m == 1 else 0.1 * presentation + 0.9 * max(0.0, content)
    return out


def test_importance_against_plain(spark, sf):
    pages = [f"<body><div class='a{i}'><p>{prose(i % 3, 4)}</p>{'<ul><li>x</ul>' * (i % 2)}tail</div><div id=b>{prose(7, 3)}<p>{prose(i, 3)}</p></div>" for i in range(12)] * 2
    pages += [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").limit(60).collect()] + [None, ""]
    tree = html.importance(spark.createDataFrame([("h", p) for p in pages], "host string, html string")).collect()
    want = plain_importance(pages)
    assert {r.path for r in tree} == set(want)
    for r in tree:
        assert (r.m, r.importance) == (want[r.path][0], pytest.approx(want[r.path][1], abs=1e-9)), r.path


def test_low_branches_against_plain(spark):
    """Low with all below them, on enough pages, of those that may go the topmost; inside an article counted from there."""
    weight = {"/body": 0.1, "/body/div": 0.1, "/body/div/p": 0.1, "/body/div/ul": 0.05, "/body/div.x": 0.1, "/body/div.x/p": 0.9, "/body/div.x/ul": 0.1, "/body/div.x/ul/li": 0.1, "/body/main": 0.1, "/body/main/p": 0.0, "/body/main/div": 0.0, "/body/main/div/div": 0.0, "/body/section": 0.0, "/body/section/article": 0.0, "/body/section/article/div": 0.0}
    tree = spark.createDataFrame([("h", p, 9, w) for p, w in weight.items()] + [("k", "/div", 9, 0.0), ("k", "/div/p", 3, 0.0), ("k", "/ul", 9, 0.0)], "host string, path string, m long, importance double")
    got = rows(html.low_branches(tree))
    assert got == [("h", x) for x in ("/body/div", "/body/div.x/ul", "/body/main/div", "/body/section", "/body/section/article/div")] + [("k", "/ul")]


def test_the_tree_decides(spark):
    """Pages without an article or telling names: with no branch low enough, menus stay."""
    pages = [(i, f"http://a.example/{i}", f"<body><div class='one'><p>home</p><p>all topics</p></div><div class='two'><p>{prose(i, 20)}</p></div>") for i in range(20)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    on, off = ({r.page_id: r.text for r in html.main_text(df, least=x).collect()} for x in (html.LEAST, 0.0))
    assert all(on[i] == prose(i, 20) and off[i] == f"home\nall topics\n{prose(i, 20)}" for i in range(20))


def test_tables(spark, sf):
    import re
    from html import unescape

    from papyra.llm.queries import op1_html

    got = {r.page_id: r for r in op1_html(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = r.html[r.html.index("<article>") + 9 :].split("</article>")[0].split("<footer")[0]
        blocks = [" ".join(unescape(x).split()) for x in re.split("<[^>]*>", re.sub("</?b(r)?>", " ", body))]
        want = "\n".join(x for x in blocks if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)
    assert rows(op1_html(spark, sf), "page_id")
