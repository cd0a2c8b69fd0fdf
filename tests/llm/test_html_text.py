"""HTML extraction: constructed pages with known articles, and the page table."""

import html
import re

from churnlake.llm import html_text as H

LONG = "A sentence of the article, with commas, and enough words to count as prose, that goes on for a while longer."


def page(article, **around):
    return (f"<html><head><title>t</title><style>p{{}}</style><script>var a='<p>no</p>';</script></head><body>"
            f"<header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></li></ul></nav>"
            f"<div class='cookie-notice'><p>{LONG} cookies</p></div>{around.get('before', '')}{article}{around.get('after', '')}"
            f"<aside><p>{LONG} aside</p></aside><form><p>{LONG} form</p></form>"
            f"<div id=comments><div class='comment'><p>{LONG} reader</p><p>{LONG} reader</p></div></div>"
            f"<footer><p>{LONG} footer</p></footer></body></html>")


def test_article_element():
    got = H.main_text(page(f"<article><h1>Head</h1><p>{LONG}<p>Short.<ul><li>one<li>two</ul></article>"))
    assert got == f"Head\n{LONG}\nShort.\none\ntwo"


def test_container_without_article_and_siblings():
    got = H.main_text(page(f"<div class=content><p>{LONG} 1</p><p>{LONG} 2</p></div><p>{LONG} tail</p>"))
    assert got == f"{LONG} 1\n{LONG} 2\n{LONG} tail"


def test_divs_and_line_breaks_without_paragraphs():
    end = "<div class=end><p>Printed in Leipzig.</p></div>"
    got = H.main_text(page(f"<div class=entry><div>{LONG} 1</div><div>{LONG} 2</div></div>{end}"))
    assert got.startswith(f"{LONG} 1\n{LONG} 2")
    got = H.main_text(page(f"<div class=entry>{LONG} 1<br><br><b>{LONG}</b> 2<br> <br>{LONG} 3</div>{end}"))
    assert got.startswith(f"{LONG} 1 {LONG} 2 {LONG} 3")
    got = H.main_text(page(f"<div class=entry>{LONG} 1<blockquote>Quoted.</blockquote>{LONG} 2</div>{end}"))
    assert got.startswith(f"{LONG} 1\nQuoted.\n{LONG} 2")


def test_short_parts_beside_the_best_container_stay():
    section = "One paragraph of a second section, which is about a hundred and fifty characters long and so has few points; "
    links = "".join(f"<li><a href=x>{LONG}</a></li>" for _ in range(3))
    text = "".join(f"<p>{LONG}</p>" for _ in range(6))
    got = H.main_text(page(
        f"<h1>Title</h1><p>Lead.</p><div>{text}</div><h2>Second</h2><div><p>{section}</p></div>"
        f"<ul>{links}</ul><ul><li>one<li>two</ul> bare <b>text</b> <table><tr><td>cell</table><p>Short.</p><h3>More</h3>"
        f"<div>{links}</div>"))
    assert got == f"Title\nLead.\n{chr(10).join([LONG] * 6)}\nSecond\n{section.strip()}\none\ntwo\nbare text\ncell\nShort."


def test_title_in_a_box_of_its_own():
    got = H.main_text(page(f"<div class=top><h1>Title</h1></div><div><p>{LONG} 1</p><p>{LONG} 2</p></div>"))
    assert got == f"Title\n{LONG} 1\n{LONG} 2"


def test_links_count_against_a_container():
    links = "".join(f"<p><a href=x>{LONG}</a></p>" for _ in range(9))
    assert H.main_text(page(f"<div>{links}</div><div><p>{LONG} real</p></div>")) == f"{LONG} real"


def test_references_and_white_space():
    got = H.main_text("<article><p>  a&nbsp;&amp;\n\n b&#233;<br>c<!-- no --> <b>d</b>e  </p></article>")
    assert got == "a & bé c de"


def test_marked_wrapper_of_the_article_stays():
    got = H.main_text(f"<body><div class='has-sidebar'><h1>T</h1><div><p>{LONG}</p><p>{LONG}</p></div>"
                      f"<div class='sidebar'><p>{LONG} side</p></div></div></body>")
    assert "side" not in got and got.count(LONG) == 2


def test_sections_named_like_page_parts_stay_in_an_article():
    parts = ['<section id="discussion"><p>{}</p></section>', '<h2 id="search">{}</h2>', '<p id="related-work">{}</p>', '<p class="notice">{}</p>',
             '<h2 id="ad-hoc-queries">{}</h2>', '<section class="alert-system"><p>{}</p></section>', '<div id="social-history"><p>{}</p></div>',
             '<header><h1>{}</h1><p>Lead.</p></header>', '<li id="reply">{}</li>']
    for part in parts:
        got = H.main_text(page(f"<article><p>{LONG} 1</p>{part.format('Part of it.')}<p>{LONG} 2</p></article>"))
        want = [f"{LONG} 1", "Part of it.", *(["Lead."] if "Lead" in part else []), f"{LONG} 2"]
        assert got == "\n".join(want), part


def test_page_parts_inside_an_article_go():
    link = f"<a href=x>{LONG}</a>"
    parts = [f'<section id="comments"><p>{LONG} c</p></section>', f'<div class="ad"><p>{LONG}</p></div>', f'<div id="related">{link}</div>',
             f'<div id="search"><p>Find</p><form><input name=q></form></div>', f'<div class="share-buttons">{link}</div>',
             f'<article class="comment"><p>{LONG} c</p></article>', '<div class="social-links"><span>like</span></div>',
             f'<div class="newsletter-box"><p>{LONG}</p></div>', "<header><span>12 May</span></header>", f'<div hidden><p>{LONG}</p></div>']
    for part in parts:
        got = H.main_text(page(f"<article><p>{LONG} 1</p>{part}<p>{LONG} 2</p></article>"))
        assert got == f"{LONG} 1\n{LONG} 2", part


def test_drawings_that_close_themselves():
    for drawing in ("<svg/>", "<math/>", "<svg><path d='m'/><g><circle/></g><text>no</text></svg>", "<svg viewBox='0 0 1 1' />"):
        got = H.main_text(f"<article><p>{LONG} 1 {drawing} on</p><p>{LONG} 2</p><div/><p>{LONG} 3</p></article>")
        assert got == f"{LONG} 1 on\n{LONG} 2\n{LONG} 3", drawing


def test_deep_nesting_takes_linear_time():
    import time
    for opening in ("<div>", "<div><b>", "<ul><li>", "<section><h1>x"):
        began = time.perf_counter()
        assert "deep" in H.main_text(opening * (50_000 // opening.count("<")) + f"deep {LONG}" + "</section></em>" * 10_000)
        assert time.perf_counter() - began < 6, opening


def test_odd_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text(" \n") == H.main_text("<html></html>") == ""
    assert H.main_text("just text") == "just text"
    assert H.main_text("<p>a</div></p></p>b<") .startswith("a")
    assert H.main_text("<div>" * 3000 + "deep") == "deep"
    assert H.main_text("<script>var x = '</p>'; if (a < b) {}</script>") == ""


def test_page_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in H.extract(rows, carry=("url",)).collect()}
    for r in rows.collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = (html.unescape(re.sub(r"<[^>]+>", " ", x)) for x in re.split(r"</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n".join(x for x in (" ".join(p.split()) for p in parts) if x)


def test_awkward_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, f"<p>{LONG}</p>", "x"), (1, None, "x")],
                               "page_id long, html string, text string")
    assert sorted((r.page_id or 0, r.text) for r in H.extract(df).collect()) == [(0, LONG), (1, ""), (1, ""), (1, "")]
    assert H.extract(df.limit(0)).count() == 0
