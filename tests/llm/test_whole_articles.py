from paysift.llm.html import main_text, parse

LONG = "<p>" + "body words " * 60 + "</p>"
BODY = " ".join(["body words"] * 60)
NESTED = f'<html><body><div class="top">x</div><article><h1>Head</h1><p>Intro</p><div class="content">{LONG}</div></article></body></html>'
SECTIONS = f'<html><body><div class="top">x</div><article><section class="intro"><p>Intro</p></section><section class="body">{LONG}</section></article></body></html>'
PLAIN = f'<html><body><div class="top">x</div><div class="page"><h1>Head</h1><div class="intro"><p>Intro</p></div><div class="content">{LONG}</div></div></body></html>'


def test_one_page():
    assert parse(NESTED).text(None) == f"Head\nIntro\n{BODY}"
    assert parse(SECTIONS).text(None) == f"Intro\n{BODY}"
    assert parse(PLAIN).text(None) == f"Head\nIntro\n{BODY}"


def test_pages_of_a_host(spark):
    rows = [(10 * k + i, f"http://h{k}/{i}", page) for k, page in enumerate((NESTED, SECTIONS, PLAIN)) for i in range(5)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(5):
        assert got[i] == got[20 + i] == f"Head\nIntro\n{BODY}" and got[10 + i] == f"Intro\n{BODY}"


def test_articles_of_a_page_stay_apart():
    two = f'<body><main><article class="a">{LONG}</article><article class="b">{LONG}</article><div class="related">x</div></main></body>'
    assert parse(two).text(["body>main>article.a", "body>main>article.b"]) == f"{BODY}\n{BODY}"
