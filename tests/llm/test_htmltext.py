from __future__ import annotations

import re

from tabmill.llm import htmltext
from tabmill.llm.queries import op10_page_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0} .ad, #x {display:none}</style></head><body>
<div class="big ad">AD</div><nav><ul><li>a<li>b<ul><li>b1<li>b2</ul><li>c</ul></nav><h1>Head &amp; more</h1><p><b>bold text<br>
<p>Two  spaces
here <span hidden>no</span><i>it</i>alic.</p><ol start=3><li>three<li>four</ol><table><tr><th>Name<th>N<tr><td>Alpha<td>1<tr>
<td>B<td>22</table><pre>
 x
   y</pre><script>var t="</p>";</script><p style="display: none">gone</p><details><summary>s</summary>closed</details><footer id=y>&copy; x</body></html>"""

TEXT = """- a
- b
  - b1
  - b2
- c

Head & more

bold text

Two spaces here italic.

3. three
4. four

Name  | N
Alpha | 1
B     | 22

 x
   y

s
© x"""


def test_layout():
    assert htmltext.page_text(PAGE) == TEXT


def test_bad_markup():
    assert htmltext.page_text("a</p>b<td>c</i><p>x<div>y</p>z") == "a\n\nbc\n\nx\n\ny\n\nz"
    assert htmltext.page_text("<p title='a>b") == "b"  # an open quote ends with the tag
    assert htmltext.page_text("1 < 2 <!-- x --> &lt;b&gt; <") == "1 < 2 <b> <"
    assert htmltext.page_text("<b>" * 50_000 + "deep" + "</b>" * 50_000) == "deep"
    assert htmltext.page_text(None) == htmltext.page_text("") == ""


def test_every_visible_word_once(spark, sf):
    """Against plain regular expressions: on these pages, the words left after scripts, styles and tags."""
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_page_text(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(html)
    from html import unescape

    for r in rows:
        plain = re.sub(r"(?is)<head.*?</head>|<script.*?</script>|<!--.*?-->", " ", html[r.page_id])
        plain = unescape(re.sub(r"<[^>]*>?", lambda m: " " if re.match(r"</?(p|li|ul|div|h\d|br|article|nav|footer|body|html|!)", m.group()) else "", plain))
        got = [w for line in r.page_text.split("\n") for w in re.sub(r"^- ", "", line).split()]
        assert got == plain.split()


def test_odd_rows(spark):
    d = spark.createDataFrame([(1, None, "x"), (None, "", None), (2, "<p>a", "y"), (2, "<p>a", "y")], "page_id long, html string, tag string")
    assert sorted((r.page_id or 0, r.page_text, r.n_lines) for r in htmltext.extract(d).collect()) == [(0, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert htmltext.extract(d.limit(0)).count() == 0


def styled(css, body):
    return htmltext.page_text(f"<head><style>{css}</style></head><body>{body}").split()


def test_rules_of_other_media_hide_nothing():
    body = "<p class=nav>nav<p class=wide>wide<p class=c>c"
    assert styled("@media print { .nav { display:none } } @media (max-width:600px) { .wide { display:none } } .c{display:none}", body) == ["nav", "wide"]
    assert styled("@import url(x.css); @media screen and (min-width: 40em) { .nav { display:none } .wide{color:red} } .c{}", body) == ["wide", "c"]
    assert styled("@media not print { .nav{display:none} } @supports (display:grid) { @media print { .c{display:none} } .wide{display:none} }", body) == ["c"]
    assert styled("@media (width >= 600px) { .nav{display:none} } @media (400px <= width < 700px) { .c{display:none} } @keyframes x { from { visibility:hidden } }", body) == ["wide", "c"]
    assert htmltext.page_text("<style media=print>p{display:none}</style><p>a") == "a"


def test_rules_override_each_other():
    assert styled(".a{display:none} .a{display:block} .b{display:block} .b{display:none}", "<p class=a>a<p class=b>b") == ["a"]
    assert styled("#i{display:block} .a{display:none} p{display:none}", "<p class=a id=i>a<p>b<div class=a>c</div>") == ["a"]
    assert styled(".a{display:none} .b{display:none !important}", "<p class=a style='display:block'>a<p class=b style='display:block'>b") == ["a"]
    assert styled(".a{display:none; display:flexx} .b{display:block}", "<p class=a>a<p hidden class=b>b<p hidden>c<p style='display:none;display:block'>d") == ["b", "d"]
    assert styled(".a{visibility:hidden} .a{display:block} .b{content:'}'; display:none} .c{color:red; .d{display:none}}", "<p class=a>a<p class=b>b<p class=c>c<p class=d>d") == ["c", "d"]


def test_text_of_drawings_and_formulas():
    assert htmltext.page_text("<p>x <svg><title>t</title><style>p{}</style><defs><text>no</text></defs><path d='M0 0'/><defs/><text>A</text><text>B</text></svg> y<svg/> z") == "x A B y z"
    assert htmltext.page_text("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow><annotation>tex</annotation></semantics></math> holds") == "so x=1 holds"


def test_cells_keep_their_blocks_and_places():
    page = "<table><tr><td>a<td>b<p>two</p><tr><td rowspan=2>long cell<td>c<tr><td>d<br>e|<td>f</table>"
    assert htmltext.page_text(page) == "a         | b\n          |\n          | two\nlong cell | c\n          | d   | f\n          | e|"
    # a page laid out in a table keeps its paragraphs and lists
    assert htmltext.page_text("<table><tr><td><p>One.</p><p>Two.</p><ul><li>x<li>y</ul></td></tr></table>after") == "One.\n\nTwo.\n\n- x\n- y\n\nafter"
    assert htmltext.page_text("<table><tr><td rowspan=2 colspan=2>ab<td>1<tr><td>2<tr><td>x<td>y<td>z</table>") == "ab    | 1\n      | 2\nx | y | z"
    nested = "<table><tr><td>k<td><table><tr><td>a<td>b<tr><td>cc<td>d</table><tr><td>m<td>n</table>"
    assert htmltext.page_text(nested) == "k | a  | b\n  | cc | d\nm | n"


def test_visible_inside_invisible():
    assert htmltext.page_text("<div style='visibility:hidden'>no<br><b style='visibility:visible'>yes <i>too</i></b> no</div>on") == "yes too\non"
    assert htmltext.page_text("<div style='display:none'>no <b style='visibility:visible'>no</b></div>on") == "on"


def test_long_pages_take_linear_time():
    import time

    began = time.time()
    for css in ("a" * 1_000_000, "a " * 500_000, "a;" * 500_000, "p{x:y}" * 150_000, '"' + '\\"' * 400_000, "'" * 500_001, "@media x{" * 100_000):
        assert htmltext.page_text(f"<style>{css}</style>x") == "x"
    for bad in ("<a " * 300_000, "<b '" * 200_000, "<style>" * 100_000):
        assert htmltext.page_text(bad).strip() == ""
    assert time.time() - began < 60


def test_names_that_clash(spark):
    d = spark.createDataFrame([(1, "<p>a", "x", 5)], "page_id long, html string, page_text string, n_lines long")
    assert htmltext.extract(d).collect() == [(1, "a", 1)]
