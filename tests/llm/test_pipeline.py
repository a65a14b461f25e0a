import pathlib
import random

import corpus_pipeline
import pytest
from shelfmark.session import shared_folder
from tests.llm.rows import awkward, frame, words
from tests.llm.test_duplicates import cut_of, groups_of


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward(n=90), ["kept", "rejected"]).selectExpr("*", "CAST(length(text) AS long) AS n_chars")


def test_stages_keep_the_columns(spark, docs, tmp_path):
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, "/root/testdata/sf0.001")
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == list(corpus_pipeline.COLUMNS) and 0 < after.count() <= docs.count()
            docs = after
    assert after.count() > 0


def test_stages_of_nothing(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("doc_id < -5"), "/root/testdata/sf0.001").count() == 0, name


def test_one_of_each_group_stays(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted({i for i, _, c in groups_of(rows, 5, 80) if i == c and i >= 0})
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in found.where("doc_id IS NOT NULL").collect()) == want


def test_passages_go(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(k.decode(errors="ignore") for _, _, _, k in cut_of(rows, 400) if k.decode(errors="ignore").strip(" \t\n\r\x0b\x0c"))
    found = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert sorted(r["text"] for r in found) == want and all(len(r["text"]) == r["n_chars"] for r in found)


def test_short_passages_go_by_their_words(spark):
    """51 words of any length go wherever they are repeated, 50 stay."""
    rng = random.Random(12)
    some = [" ".join(rng.choice(["a", "of", "wé", "tin", "zu"]) + rng.choice("abcdefgh") for _ in range(n)) for n in (51, 50, 64)]
    rows, want = [], []
    for i in range(12):
        before, after = (words(rng, rng.randint(20, 40), lang) for lang in ("en", "de"))
        passage = some[i % 3] if i < 9 else ""
        rows.append((i, f"{before}x{i} {passage if i else passage.replace(' ', chr(10))} y{i}{after}", "en", "host"))
        want.append((i, [*f"{before}x{i}".split(), *(passage.split() if i % 3 == 1 else ()), *f"y{i}{after}".split()]))
    assert max(len(p.encode()) for p in some) < 400
    docs = frame(spark, rows).selectExpr("*", "CAST(length(text) AS long) AS n_chars")
    found = corpus_pipeline.repeated_passages(spark, docs, "").collect()
    assert sorted((r["doc_id"], r["text"].split()) for r in found) == want


def test_near_duplicates_leave_only_what_they_answer(spark, docs):
    """Frames of the join are deleted: what stays is the ids that go and the ids that several rows share."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    stay = corpus_pipeline.near_duplicates(spark, docs, "")
    assert len(set(folder.iterdir()) - before) == 2 and stay.count() > 0


def test_run(spark):
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert pieces.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).where("`sum(length)` <> `max(doc_tokens)`").count() == 0
