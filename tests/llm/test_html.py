from paysift.llm.html import host, main_text, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/x>menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><div id="cookieNotice">We use cookies</div>
<article class="post post-{n}"><h1>Title &amp; more</h1><p><b>Bold   start.<br><p>Second&nbsp;para &lt;3 &#x41;{n}</p><ul><li>one</li><li>two <a href=#>link</a></li></ul>
<form><input><p>Sign up</p></form><aside>Side</aside><div class="comments"><p>First!</p></div></article><aside class="sidebar">More</aside><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\nBold start.\nSecond para <3 A{n}\none\ntwo link"


def page(n):
    return PAGE.replace("{n}", str(n))


def test_article():
    p = parse(page(1))
    assert p.text(None) == TEXT.replace("{n}", "1")
    assert [path for path, _ in p.votes()][0].endswith("article.post.post-#")


def test_hosts_agree(spark):
    rows = [(i, f"https://User@A.example.com:80/{i}", page(i), "x", 1) for i in range(12)]
    # a page whose own best container is elsewhere is read by its host's path
    odd = '<html><body><div class="x"><p>' + "long text " * 40 + '</p></div><article class="post post-9"><p>short</p></article></body></html>'
    rows += [(12, "http://a.example.com/", odd, "x", 1), (13, "http://b.example.com/", odd, "x", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, salt int")
    got = {r.page_id: r for r in main_text(frame).collect()}
    assert all(got[i].text == TEXT.replace("{n}", str(i)) for i in range(12))
    assert got[12].text == "short" and got[13].text.startswith("long text") and "short" not in got[13].text
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain text"), (4, "http://h/", "<p>a<p>b"), (None, "http://h/", "<div><div><p>deep</div>"), (5, "http://h/", "<script>x"), (6, "http://h/", "a < b <> c </ d <!-- open"), (7, "http://h/", "<p>" + "y" * 300_000), (8, "http://h/", "&amp;&bogus;&#0;"), (4, "http://h/", "<p>a<p>b"), (9, "http://[", "<table><tr><td>c1<td>c2</table>"), (10, "u", "<p title='a>b'>q</p>")]
    got = sorted((str(r.page_id), r.text) for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert len(got) == len(rows)
    found = dict(got)
    assert found["1"] == found["2"] == found["5"] == "" and found["3"] == "plain text" and found["4"] == "a\nb" and found["None"] == "deep" and len(found["7"]) == 300_000
    assert found["9"] == "c1\nc2" and found["10"] == "q" and found["6"].startswith("a < b")


def test_nothing(spark):
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_host():
    assert host("HTTP://u:p@Ex.com:8/p?q") == "ex.com" and host("nothing") == host(None) == ""
