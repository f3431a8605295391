"""The page reader on scripts, quotes, open ends and deep pages, and the registered query against a truth by rule."""

import html
import re
import time

import pytest

from packetloom.llm import html_seed, html_tree

from ..conftest import DATA

GOOD = "<article><h1>On rivers</h1><p>Rivers run to the sea, and the sea does not fill.</p><p>Two banks, one stream: so it goes.</p></article>"
TEXT = "On rivers Rivers run to the sea, and the sea does not fill. Two banks, one stream: so it goes."


@pytest.fixture(scope="module")
def model():
    return html_tree.PageModel(html_seed.labelled_pages())


@pytest.mark.parametrize(
    "before",
    [
        """<script>for(i=0;i<n;i++){x("a")}</script>""",
        "<script>if(i<n)q()</script>",
        """<script>if(i<len){b="x'"}</script>""",
        """<script>var s="<!-- "; document.write('<div>');</script>""",
        "<script>a='</p></scripts>'</script >",
        "<style>a>b{content:'<div'}</style>",
        '<script src="a.js"/>',
        "<script src=/js/>var x = 1</script>",
        '<script src="a.js" />var x = 1;</script>',
        "<!--><!---><!-- <p>x</p> --!>",
        "<textarea><article><p>no</textarea>",
        """<div data-x=">" title='a"b' hidden></div>""",
        "<a href=foo\"bar></a>",
        "</p></div></nope>",
        "<head><title>t</title>",
        "<head><title>t</title><meta charset=x><style>p{}</style>",
    ],
)
def test_what_stands_before_an_article(model, before):
    assert model.main_text(f"<html><body>{before}{GOOD}</body></html>") == TEXT
    assert model.main_text(before + GOOD) == TEXT


P = "<p>Rivers run to the sea, and the sea does not fill.</p>"


@pytest.mark.parametrize(
    "page",
    [
        f"<article>{P}<button>Subscribe now</button></article>",
        f"<article>{P}<p><button type=button>Read more</button></p></article>",
        f"<article>{P}<dialog><p>Accept our terms and conditions to go on.</p></dialog></article>",
        f"<dialog open><p>Accept our terms.</p><button>Yes</button></dialog><article>{P}</article>",
    ],
)
def test_buttons_and_dialogs_outside_forms(model, page):
    assert model.main_text(f"<html><body>{page}</body></html>") == "Rivers run to the sea, and the sea does not fill."


def test_text_after_an_open_head(model):
    assert model.main_text("<html><head><title>t</title><h1>Rivers</h1><p>They run to the sea.</p>") == "Rivers They run to the sea."


@pytest.mark.parametrize(
    "shape",
    [
        lambda n: "<div>" * n + "</p>" * n,
        lambda n: "<div>" * n + "<li></li>" * n,
        lambda n: "<li><ul>" + "<div>" * n + "<li></li>" * n,
        lambda n: "<div>" * n + "<body>" * n,
        lambda n: '<a ="' * n,
        lambda n: "<a ='\"" * n,
        lambda n: "<a " * n,
        lambda n: "<" * n,
        lambda n: "<!--" * n,
        lambda n: "<script" * n,
        lambda n: "<script>" * n,
        lambda n: '<script src="x"/>' * n,
        lambda n: "<p>" * n + "x" + "</p>" * n,
    ],
)
def test_time_is_linear(shape):
    page = shape(100_000)
    began = time.process_time()
    html_tree.Tree(page)
    assert time.process_time() - began < 10


def test_deep_pages(model):
    assert model.main_text("<div>" * 100_000 + GOOD + "</p>" * 100_000) is not None


def rule_text(page):
    """The article of a made page: blocks end at every tag but inline ones and line breaks."""
    article = re.search(r"(?s)<article>(.*?)</article>", page)
    blocks = re.split(r"(?i)</?(?:p|h1|h2|ul|li|div|article)\b[^>]*>", re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", article[1] if article else ""))
    plain = [" ".join(html.unescape(re.sub(r"</?b>|</?a\b[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
    return " ".join(b for b in plain if b)


def test_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = html_tree.op4_html_text(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.text == rule_text(pages[r.page_id].html or "") and r.n_chars == len(r.text)
