"""Extraction: windows decide, names do not drop dense text, broken markup is read on."""

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import extract
from ledgerlens.llm.extract import extract as text_of

LONG = "A paragraph of the article that has a good number of words in it, so that its windows are dense. " * 3


def test_names_that_may_be_text_are_judged_by_density():
    page = f"<article><p>{LONG}</p><div class='side-effects'>{LONG}</div><p class='discussion'>{LONG}</p><p>end</p></article>"
    assert text_of(page) == " ".join([LONG.strip()] * 3 + ["end"])
    assert text_of("<article><p>start text</p><div class='side-effects'>side text</div><p class='discussion'>more text</p><p>end</p></article>") == "start text side text more text end"
    assert text_of(f"<article><p>{LONG}</p><div class='notice'>Short.</div><p>{LONG}</p></article>") == f"{LONG.strip()} {LONG.strip()}"
    assert text_of(f"<body><p>{LONG}</p><div class='related'><a href='/'>{LONG}</a></div><p>{LONG}</p></body>") == f"{LONG.strip()} {LONG.strip()}"


def test_plain_names_of_furniture_leave_whatever_their_density():
    page = f"<body><article><p>{LONG}</p><section class='comments'><p>{LONG}</p></section></article><div id='cookie-banner'>{LONG}</div></body>"
    assert text_of(page) == LONG.strip()


@pytest.mark.parametrize("tag", ["<p title='it's fine'>", '<p title="broken>', "<p data-x=a'b>", "<p 'x>"])
def test_broken_quotes_end_at_the_tag(tag):
    assert text_of(f"<body>{tag}one two three</p><p class=\"a\">four</p></body>") == "one two three four"


def test_windows_decide_on_pages_that_name_articles():
    teasers = "".join(f"<article><h3>Teaser {k}</h3></article>" for k in range(9))
    assert text_of(f"<body><article><h1>Head</h1><p>{LONG}</p><p>end</p></article>{teasers}</body>") == f"Head {LONG.strip()} end"
    wrong = f"<body><article>Tiny.</article><div>{f'<p>{LONG}</p>' * 5}</div></body>"
    assert text_of(wrong).count("A paragraph of") == 15


def test_surge_and_dive_decide_on_pages_without_articles():
    gap = "<nav><a href='/x'>x</a></nav>"
    page = f"<body><div>Top line</div>{gap}<div><p>{LONG}</p><p>Short end.</p></div>{gap}<div>Last line</div></body>"
    assert text_of(page) == f"{LONG.strip()} Short end."
    assert [k for k in extract.runs([5, 0, 0, 0, 0, 90, 80, 0, 0, 0, 0, 4]) if k[2] > 9] == [(3, 9, 170)]
    assert extract.runs([0, 0, 0]) == [] and extract.densest([1, 2, 3, 4]) == 9


def test_pages_of_any_kind(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, "u", "<p>one</p>", "clash", "x"), (1, "u", "<p>one</p>", "clash", "x"), (None, None, None, None, None), (2, "", "", "", ""), (3, "v", f"<p>{'long ' * 60000}</p>", "", ""), (4, "w", "<div><p>cut <b>off", "", "")]
    got = extract.extract_pages(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r["page_id"] or 0, r["text"][:7], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, "one", 3), (1, "one", 3), (2, "", 0), (3, "long lo", 299999), (4, "cut off", 7)]
    assert extract.extract_pages(spark.createDataFrame([], schema)).agg(F.count("*")).first()[0] == 0
