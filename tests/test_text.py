"""Text functions over generated and boundary values."""

import random
import re
import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from shelfmark.functions import text as X

RNG = random.Random(22)


def each(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_normalised_text_is_stable_and_has_no_trailing_blanks(spark):
    texts = ["".join(RNG.choice(["q", "r7", " ", "\t", "\r\n", "\n", "\\#", "　", "水", "温 度"]) for _ in range(25)) for _ in range(60)]
    once = each(spark, texts, X.normalize_text("v"))
    assert each(spark, once, X.normalize_text("v")) == once
    for text in once:
        assert "\r" not in text and "\n\n\n" not in text and not re.search(r"[ \t]\n", text) and text == text.strip(" \t\n")


@pytest.mark.parametrize(("mark", "shown"), [("&lt;", "<"), ("&amp;gt;", "&gt;"), ("<b>in</b>", "in"), ("<script>gone()</script>", ""), ("<style>gone</style>", "")])
def test_html_marks(spark, mark, shown):
    assert each(spark, [f"<div>left {mark} right</div>"], X.html_to_text("v"))[0].split() == f"left {shown} right".split()


def test_kinds_by_ending_whatever_its_case(spark):
    for kind, endings in {"pdf": ["pdf"], "image": ["png", "jpg"], "text": ["txt", "csv"], "office": ["xlsx", "pptx"], None: ["zip", "bin", ""]}.items():
        for ending in endings:
            for name in (f"deep/er.dir/file.{ending}", f"FILE.{ending.upper()}"):
                assert each(spark, [name], X.source_kind("v")) == [kind], name


def test_slugs_are_made_of_letters_digits_and_single_dashes(spark):
    titles = ["".join(RNG.choice("Az09 -_:/é水Ⅷ！") for _ in range(RNG.randint(1, 12))) for _ in range(80)]
    for title, slug in zip(titles, each(spark, titles, X.slugify("v", F.lit("2031-12-09").cast("date"))), strict=True):
        if slug != "note-2031-12-09":
            assert not slug.startswith("-") and not slug.endswith("-") and "--" not in slug
            assert all(c == "-" or unicodedata.category(c)[0] in "LN" for c in slug) and slug == slug.lower()
        else:
            assert not any(c.isalnum() for c in unicodedata.normalize("NFKC", title))


def test_tags_and_shelves_are_told_apart_once(spark):
    assert each(spark, [["Cold Saw", "cold-saw", "", "mill"]], X.normalize_tags("v"), "array<string>") == [["cold-saw", "mill"]]
    assert each(spark, [["Tools", "TOOLS", " tools  ", "Bench  two"]], X.normalize_shelves("v"), "array<string>") == [["Tools", "Bench two"]]


def test_path_endings_grow_by_one_part(spark):
    parts = ["srv", "store", "2031", "plan.txt"]
    for depth in range(1, 5):
        assert each(spark, ["/" + "/".join(parts)], X.source_path("v", depth)) == ["/".join(parts[-depth:])]
    assert each(spark, ["upload:plan.txt"], X.source_path("v", 2)) == ["plan.txt"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=15))
def test_page_runs_name_each_page_once(spark, pages):
    shown = each(spark, [pages], X.page_runs("v"), "array<int>")[0]
    back = [n for run in shown.split(", ") for a, _, b in [run.partition("-")] for n in range(int(a), int(b or a) + 1)]
    assert back == sorted(set(pages)) and len(shown.split(", ")) == sum(p - 1 not in pages for p in set(pages))


def test_sizes_keep_two_digits(spark):
    found = each(spark, [0, 1, 999, 5_400, 54_000, 540_000, 5_400_000, 54_000_000_000], X.human_size("v"), "long")
    assert [f.split()[1] for f in found] == ["B", "B", "B", "KB", "KB", "KB", "MB", "GB"]
    assert found[3] == "5.4 KB" and found[4] == "54 KB"


def test_padding_counts_wide_characters_twice(spark):
    for value, wide in (("水轮", 4), ("ab", 2), ("a水", 3)):
        shown = each(spark, [value], X.pad_display("v", 9))[0]
        assert shown == value + " " * (9 - wide)


def test_native_text_decides_the_ocr_languages(spark):
    found = lambda native, cjk, kind, configured: each(spark, [0], X.ocr_languages(F.lit(configured), F.lit(kind), F.lit(native), F.lit(cjk)), "int")[0]
    assert found(10_000, 0, "pdf", "eng+jpn") == "eng" and found(10_000, 400, "pdf", "eng+jpn") == "eng+jpn"
    assert found(10_000, 0, "image", "eng+jpn") == "eng+jpn" and found(0, 0, "pdf", "eng+jpn") == "eng+jpn" and found(10_000, 0, "pdf", "jpn") == "jpn"
