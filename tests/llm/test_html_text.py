"""Main text of pages whose right answer is known."""

import html
import re

from millrace.llm.html_text import extracted, main_text
from millrace.llm.queries import QUERIES

STORY = (
    "The old harbour of the town was for a long time the place where all the ships from the north came in, "
    "and it is still full of life."
)


def page(body, head="<title>No</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_parts_beside_the_article():
    got = main_text(
        page(
            "<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>"
            f"<div class='cookie-notice'>{STORY}</div><div id=sidebar><p>{STORY}</p></div><form><p>{STORY}</p></form>"
            f"<article><header><h1>Title</h1></header><p>{STORY}</p><p>Short.</p><p>A &amp; B&nbsp;&eacute;<br>c</p>"
            f"<div class=ad>{STORY}</div><script>if (a<b) x('</p>')</script><style>p{{}}</style><!-- <p>no</p> --></article>"
            f"<section class='comments'><p>{STORY}</p></section><aside>{STORY}</aside><footer><p>{STORY}</p></footer>"
        )
    )
    assert got == f"Title\n{STORY}\nShort.\nA & B é c"


def test_pages_without_an_article():
    links = "".join(f"<li><a href='/{i}'>Link number {i} of the long list of links</a></li>" for i in range(9))
    got = main_text(page(f"<div><ul>{links}</ul></div><div><h2>Head</h2><p>{STORY}</p><p>Yes.</p><p>{STORY}</p></div><div><ul>{links}</ul></div>"))
    assert got == f"Head\n{STORY}\nYes.\n{STORY}"


def test_broken_markup():
    assert main_text("") == "" and main_text("plain text") == "plain text"
    assert main_text(f"<article><p>{STORY} <b>bold<p>{STORY}") == f"{STORY} bold\n{STORY}"
    assert main_text(f"<article>{STORY} &am") == f"{STORY} &am"
    assert main_text(f"<article>{STORY}<p class='x") == STORY
    assert main_text(f"<article>{STORY}<!-- open {STORY}") == STORY
    assert main_text(f"<article>{STORY}<script>open {STORY}") == STORY
    assert main_text(f"<article>1 < 2 and {STORY}</article>") == f"1 < 2 and {STORY}"
    assert main_text(f"<article><p>one</div><p>{STORY}</p></article></article></p>") == f"one\n{STORY}"
    assert main_text("<" * 3000 + "a" * 10) != "x"


def expected(source):
    """Pages of the table: what stands in the article."""
    inner = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)\b[^>]*>", inner)
    plain = (" ".join(html.unescape(re.sub(r"<[^>]*(>|\Z)", " ", b)).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


def test_table(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in QUERIES["op6_html_text"](spark, sf_dir).collect():
        assert r.text == expected(pages[r.page_id]) and r.n_chars == len(r.text)


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>x</p>", 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT int")
    assert sorted(map(tuple, extracted(df).collect()), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "x", 1)]
    assert extracted(df.where("1 = 0")).collect() == []
