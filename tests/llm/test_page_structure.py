"""Pages whose structure is deep or whose class words are misleading, and all given pages against a plain reading."""

import html as entities
import re
import time

import pytest

from paysift.llm.common import table
from paysift.llm.html import main_text, parse
from tests.conftest import SF

LONG = "body words " * 60


def article(inside, before=""):
    return f'<html><body>{before}<article><h1>Head</h1><p>{LONG}</p>{inside}</article></body></html>'


@pytest.mark.parametrize("name", ["related-work", "notice-board", "share", "related", "share-holders", "menu-item-prices", "login-tutorial", "newsletter-history", "comment-policy", "comment-on-budget", "cookie-recipes", "adsorption"])
def test_words_in_names_take_nothing_from_an_article(name):
    found = parse(article(f'<div class="{name}"><p>Kept text</p></div>')).text(None)
    assert found.endswith("\nKept text")


@pytest.mark.parametrize("name", ["ad", "comments", "comment-list", "cookie-banner", "sidebar-left", "notice", "nav", "newsletter-signup", "post-comments", "cookieNotice", "ad-slot-2"])
def test_names_of_adverts_comments_and_notices_do(name):
    assert "Gone" not in parse(article(f'<div class="{name}"><p>Gone text</p></div>')).text(None)
    assert "Gone" not in parse(article(f'<section class="{name}">' + "<p>Gone, said a reader</p>" * 80 + "</section>")).text(None)


@pytest.mark.parametrize("line", ["one <script>x</script> two", "one <style>x</style>two", "one <svg><text>x</text></svg> two", "one <noscript>x</noscript> two", "one <picture><img></picture> two", "<acronym>one</acronym> two", "<nobr>one</nobr> two", "<my-word>one</my-word> two", "one <select><option>x</select> two", "one <button>x</button>two", "one <select><option>x</option></select> two"])
def test_a_line_goes_on(line):
    assert parse(article(f"<p>{line}</p>")).text(None).endswith("\none two")


def test_formulas_are_text():
    formula = "<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding='tex'>x = 1</annotation></math>"
    assert parse(article(f"<p>so {formula} holds</p>")).text(None).endswith("\nso x=1 holds")


def test_links_count_at_any_depth():
    deep = "".join(f"<li><a href=/{i}><span><b><i><em><u>Gone elsewhere</u></em></i></b></span></a></li>" for i in range(5))
    assert "Gone" not in parse(article(f'<ul class="related">{deep}</ul>')).text(None)
    listed = "<ul>" + "".join(f"<li><a href=/{i}><span><b><i><em>{LONG}</em></i></b></span></a></li>" for i in range(5)) + "</ul>"
    page = f'<body><div class="links">{listed}</div><div class="story"><p>{LONG}</p></div></body>'
    assert parse(page).text(None) == LONG.strip()


def test_a_word_in_a_name_needs_evidence():
    links = "<a href=/>Gone elsewhere</a> " * 5
    assert "Gone" not in parse(article(f'<div class="newsletter-history">{links}</div>')).text(None)
    assert "Gone" not in parse(article('<div class="newsletter-history">Gone: your address <input> <button>Go</button></div>')).text(None)
    assert "Kept" in parse(article(f'<div class="newsletter-history"><p>Kept {LONG}</p><input></div>')).text(None)


def test_link_lists_go():
    assert "Gone" not in parse(article('<div class="related"><a href=/>Gone elsewhere</a></div>')).text(None)


def test_a_marking_name_around_all_text_is_the_article():
    page = f'<body><div class="top">x</div><article><div class="ad"><p>{LONG}</p></div></article></body>'
    assert parse(page).text(None) == LONG.strip()


def test_pages_stay_by_their_host(spark):
    rows = [(i, "http://h/x", article(f'<div class="related-work"><p>Kept {i}</p></div><div class="share"><p>and {i}</p></div>', '<div class="menu">m</div>')) for i in range(8)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Head\n{LONG.strip()}\nKept {i}\nand {i}" for i in range(8))


@pytest.mark.parametrize("deep", ["<div><p>word ", '<div class="c1 d2">word ', "<b>", "<b><p>", "<section><a href=x>l</a>", "<ul><li>x", "</i></div>", "<table><tr><td>x", "<article>x", "<p title='"])
def test_time_is_linear_in_depth(deep):
    def seconds(n):
        page = "<body>" + deep * n
        began = time.perf_counter()
        p = parse(page)
        p.votes()
        p.text([])
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 20 * seconds(5_000) + 1


def test_joined_paths_give_the_same(spark, monkeypatch):
    pages = table(spark, SF, "pages")
    want = sorted(main_text(pages).collect())
    monkeypatch.setattr("paysift.llm.html.BROADCAST_BYTES", 0)
    assert sorted(main_text(pages).collect()) == want


def plain_reading(page):
    """The blocks of the one article of a page of the given tables, by patterns alone."""
    inner = re.search(r"<article[^>]*>(.*?)</article>", page or "", re.S)
    if inner is None:
        return None
    body = re.sub(r"<!--.*?-->|<(script|style|form|aside|nav|footer|header)\b.*?</\1>", "", inner[1], flags=re.S)
    blocks = re.split(r"</?(?:p|h\d|div|section|ul|ol|li|blockquote|pre|table|tr|td|figure|figcaption)\b[^>]*>", body)
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_given_pages_equal_a_plain_reading(spark):
    html = {r.page_id: r.html for r in table(spark, SF, "pages").collect()}
    got = {r.page_id: r.text for r in main_text(table(spark, SF, "pages")).collect()}
    want = {i: plain_reading(h) for i, h in html.items()}
    read = [i for i in want if want[i] is not None]
    assert len(read) == len(html) > 0 and [i for i in read if got[i] != want[i]] == []
