"""Article extraction: kept and cut parts, references, broken pages, edge rows."""

import pytest
from conftest import rows_of

from tablewright.llm.html_text import extract_text, main_text

LONG = "A long paragraph, with commas, and words enough to look like a part of some article in full."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize("clutter", [
    f"<nav><ul><li><a href='/'>{LONG}</a></ul></nav>", f"<header><h1>Site</h1><p>{LONG}</p></header>",
    f"<footer><p>{LONG}</p></footer>", f"<aside>{LONG}</aside>", f"<div class='sidebar'><p>{LONG}</p></div>",
    f"<div id='cookie-notice'><p>{LONG}{LONG}{LONG}</p></div>", f"<div class='ad'>{LONG}</div>",
    f"<form><label>{LONG}</label><input></form>", f"<script>var t='</p>{LONG}'</script>", f"<!-- {LONG} -->",
    f"<section class='comments'><article class='comment'><p>{LONG}</p></article></section>",
    f"<div role='banner'>{LONG}</div>", f"<div hidden>{LONG}</div>", f"<div style='display: none'>{LONG}</div>",
    f"<noscript><p>{LONG}</p></noscript>", f"<div class='newsletterSignup'>{LONG}</div>",
    "<div class='x'><a href='/1'>one</a> <a href='/2'>two</a> <a href='/3'>three</a></div>"])
def test_parts_beside_the_article_go(clutter):
    article = f"<article><h1>Head &amp; line</h1><p>{LONG}</p><p>Short.</p></article>"
    want = f"Head & line\n{LONG}\nShort."
    assert main_text(page(clutter + article)) == want
    assert main_text(page(article + clutter)) == want
    inner = article.replace("<p>Short.", clutter + "<p>Short.")
    if not clutter.startswith("<header"):
        assert main_text(page(inner)) == want


def test_container_without_article_element_wins_by_points():
    body = f"<div class='teaser'><p>Little.</p></div><div class='x'><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div>"
    assert main_text(page(body)) == f"T\n{LONG}\n{LONG}"
    links = f"<div><p><a href='/'>{LONG}</a></p><p><a href='/'>{LONG}</a></p><p><a href='/'>{LONG}</a></p></div>"
    assert main_text(page(links + body)) == f"T\n{LONG}\n{LONG}"


def test_siblings_of_the_best_container_are_kept():
    long, short = f"<p>{LONG}</p>" * 9, f"<p>{LONG}</p>" * 3
    body = f"<div><h1>T</h1><div>{long}</div><p>{LONG}</p><p>Part.</p><p>no sentence</p><div>{short}</div><div><p>x</p></div></div>"
    assert main_text(page(body)).split("\n") == ["T"] + [LONG] * 10 + ["Part."] + [LONG] * 3


def test_article_holds_all_its_sections():
    body = f"<article><h1>T</h1><section><h2>A</h2><p>{LONG}</p></section><section><h2>B</h2><p>x</p></section></article>"
    assert main_text(page(body)) == f"T\nA\n{LONG}\nB\nx"


def test_classes_that_only_mention_a_part_do_not_cut():
    body = f"<div class='content has-sidebar no-comments'><p>{LONG}</p></div>"
    assert main_text(page(body)) == LONG
    assert main_text(f"<body class='page with-ads'><main id='main-content'><p>{LONG}</p></main></body>") == LONG
    assert main_text(f"<form id='aspnet'><article><p>{LONG}</p></article></form>") == LONG


def test_references_and_white_space():
    assert main_text("<p>a&nbsp;&lt;b&gt; \n\t &#233;&#x20AC; &amp;amp; &am &copy x<br>y</p>") == "a <b> é€ &amp; &am © x y"


@pytest.mark.parametrize("source, want", [
    (None, ""), ("", ""), ("   ", ""), ("plain < text & more", "plain < text & more"), ("<p>a<p>b", "a\nb"),
    ("<p><b>a<br><p>b</p>", "a\nb"), ("<ul><li>a<li>b</ul>", "a\nb"), ("<p>cut <a hre", "cut"), ("<p>cut &am", "cut &am"),
    ("<p>a<!-- open", "a"), ("<script>x", ""), ("</div></p>a", "a"), ("<p title=it's>don't</p>", "don't"),
    ("<p title='a > b'>c</p>", "c"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), ("<head><p>x", "x"),
    ("<nav>a</nav><footer>b</footer>", ""), ("a\x00b", "a\x00b")])
def test_broken_and_empty_pages(source, want):
    assert main_text(source) == want


@pytest.mark.parametrize("piece", ["<div>", "<p>", "</div>", '<a href="', "<a '", "<!--", "<td>", "&am", "<", "<span class=ad>"])
def test_long_pages_take_linear_time(piece):
    main_text(piece * 100_000)


def test_long_text_is_whole():
    text = " ".join(f"w{i}" for i in range(200_000))
    assert main_text(page(f"<article><p>{text}</p></article>")) == text


def test_rows(spark):
    rows = [(1, "u", page(f"<article><p>{LONG}</p></article>")), (2, None, None), (None, "u", ""), (1, "u", "<p>é")]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars", "3 as best")
    got = rows_of(extract_text(df), "page_id", "url", "text", "n_chars")
    want = [(1, "u", LONG, len(LONG)), (2, None, "", 0), (None, "u", "", 0), (1, "u", "é", 1)]
    assert got == sorted(want * 2, key=repr)
    assert extract_text(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="overwritten"):
        extract_text(df, keep=("page_id", "text"))
