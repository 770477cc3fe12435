import duckdb
import pytest

from grainmill.llm import html_text, url_filter

PAGE = """<html><head><title>x</title><style>p{}</style></head><body class="nav-open"><header>H</header><nav><a>m</a></nav><div id=cookie-notice>We use</div>
<main><h1>T &amp; U</h1><p>one<br>two&nbsp;&lt;b&gt;<ul><li>a<li>b</ul><script>var x="<p>no</p>";</script><div class="comments"><p>nice</div><section class="post-body">end <a href=x>li</a>nk</section><form>f</form></main><footer>F"""


def test_main_text():
    assert html_text.main_text(PAGE, 0, frozenset()) == "T & U\n\none two <b>\n\na\n\nb\n\nend link"
    for odd, want in ((None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<p>a <!-- x", "a"), ("<article><p>t</p></article><p>u", "t"), ("a <b", "a"), ("1 < 2", "1 < 2")):
        assert html_text.main_text(odd, 0, frozenset()) == want


def test_embedded_elements():
    for page, want in (
        ("<article><p>a <svg viewBox='0 0 1 1'/> b</p><p>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p><svg><path d=x><p>b</p></article>", "a\n\nb"),
        ("<p>a</p><svg><svg><text>x</text></svg><text>y</text></svg><p>b", "a\n\nb"),
        ("<p>a</p><svg><svg/><text>x</text></svg><p>b", "a\n\nb"),
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds <math/>too</p>", "so x=2 holds too"),
        ("<p>a</p><video src=x><p>b</p>", "a\n\nb"), ("<p>a</p><script>x = '<p>b</p>'", "a"),
    ):
        assert html_text.main_text(page, 0, frozenset()) == want


def test_site_style_tree(spark):
    same = "<div class=box>Read our other stories now</div>"
    rows = [(i, f"http://h.net/{i}", f"<body><section>{same}</section><section class=c><p>text {i}</p><p>{'x' * i} y</p></section>") for i in range(30)]
    rows += [(100, None, "<p>a"), (101, "http://q.net/", None), (102, "http://q.net/", ""), (103, "http://one.net/", f"<body>{same}<p>b"), (0, "http://h.net/0", rows[0][2])]
    rows += [(200 + i, f"http://copies.net/{i}", "<div class=t>Only this</div>") for i in range(20)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    for most in (html_text.BROADCAST_PATHS, 0):
        html_text.BROADCAST_PATHS, kept = most, html_text.BROADCAST_PATHS
        got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
        html_text.BROADCAST_PATHS = kept
        assert got[3] == "text 3\n\nxxx y" and got[0] == "text 0\n\ny"
        assert got[100] == "a" and got[101] == got[102] == "" and got[103] == "Read our other stories now\n\nb" and got[205] == "Only this"
    assert html_text.extract(df).count() == len(rows) and html_text.extract(df.limit(0)).count() == 0


def test_urls(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet'")
    want = con.execute(url_filter.OP4_SQL).fetchall()
    assert sorted(map(tuple, url_filter.op4_url_filters(spark, sf_dir).collect()), key=str) == sorted(want, key=str)


def test_aliases(spark):
    rows = [
        (0, "https://a.net/x", "<link rel=canonical href='https://B.example.org/es/1'>"), (1, "https://b.example.org/es/1#q", None), (2, "http://c.net/", '<meta http-equiv="refresh" content="0; url=https://a.net/x">'),
        (3, "http://d.net/y", '<link href="/z" rel="canonical">'), (4, "http://d.net/z", '<!-- <link rel="canonical" href="http://c.net/"> -->'), (5, None, None), (6, "nothing", ""),
        (7, "http://f.net/1", '<link rel="canonical" href="//x.com/fr/2">'), (8, "http://g.net/1", '<link rel="canonical" href="http://f.net/1"><link rel=canonical href=http://y.com/de/1>'), (1, "https://b.example.org/es/1", None),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, host string")
    many = [*url_filter.RULES, *[(f"h{i}.net", "/", "block") for i in range(300)]]
    for rules in (url_filter.RULES, many):
        got = {r["page_id"]: (r["verdict"], r["reason"], r["rule"]) for r in url_filter.filter_urls(df, rules).collect()}
        assert got[0] == got[2] == ("block", "alias", None) and got[1] == ("block", "rule", "example.org/es/")
        assert got[3] == got[4] == got[5] == got[6] == ("allow", "default", None)
        assert got[7] == got[8] == ("allow", "alias", None)  # an allowed member outweighs a blocked one
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}
    assert url_filter.filter_urls(df.limit(0), url_filter.RULES).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="layout has-sidebar"><article><p>body</p></article></div>', "body"),
        ('<article><div class="elementor-widget-container"><p>body</p></div></article>', "body"),
        ("<form><div><p>one</p><p>two</p></div></form>", "one\n\ntwo"),
        ("<main><p>" + "long text " * 100 + "</p><article class=teaser>see also</article></main>", "long text " * 99 + "long text\n\nsee also"),
        ("<main><p>short</p><article>the article</article></main>", "the article"),
        ("<p>Let <script>x</script>it<select><option>1</select> be</p>", "Let it be"),
        ("<article><p>a</p><svg class=i /><p>b</p><p>c</p></article>", "a\n\nb\n\nc"),
        ("<article><p>a</p></article><form>name</form><nav>menu</nav>", "a"),
        ("<nav>menu</nav><footer>foot</footer>", ""),
        ("<article><p>" + "word " * 200_000 + "</p></article>", ("word " * 200_000).strip()),
    ],
)
def test_weak_signs(page, text):
    assert html_text.main_text(page, 1, frozenset()) == text
