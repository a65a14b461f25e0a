"""Two small knowledge bases end to end, with a concept-counting embedder and a scripted model."""

import datetime as dt
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from shelfmark.library import KnowledgeBase, Library
from shelfmark.operators import evaluation as E, semantic as S
from shelfmark.operators.chunking import chunk_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TEXTS = {
    "k-1": ("qt310.md", "docs", "# Limits\n\n工作温度范围 -40 到 85"),
    "k-2": ("can.md", "docs", "# CAN\n\nSet up CAN bus arbitration before use."),
    "k-3": ("flash.md", "docs", "# Flash\n\nErase a sector, then program it."),
    "w-1": ("Lunch", "wiki", "# Lunch\n\nNoodles at noon."),
}


def embed(texts):
    concepts = ["温度|heat|warm", "can|总线|bus|arbitration", "擦|写入|erase|flash"]
    return np.array([[len(re.findall(c, t.lower())) for c in concepts] + [0.01] for t in texts], dtype=float)


@pytest.fixture(scope="module")
def base(spark):
    rows = [(i, t, c, f"/x/{t}", None, dt.datetime(2024, 1, 1), x) for i, (t, c, x) in TEXTS.items()]
    docs = spark.createDataFrame(rows, "doc_id string, title string, collection string, source string, pages int, added_at timestamp_ntz, text string")
    chunks = chunk_texts(docs).join(docs.select("doc_id", "title"), "doc_id").withColumn("chunk_id", F.concat_ws("#", "doc_id", F.col("seq").cast("string")))
    shelves = spark.createDataFrame([("k-2", "Boards")], "doc_id string, shelf string")
    none = spark.createDataFrame([], "chunk_id string, doc_id string, model string, vec array<float>")
    vectors = S.embed_pending(chunks, none, spark.createDataFrame([], "doc_id string"), "toy", embed)
    return KnowledgeBase(docs, chunks, shelves, vectors, "toy", embed, 0.5)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def test_find_crosses_languages(spark, base):
    q = asked(spark, "operating heat", "CAN bus", "擦除")
    rows = base.find(q).orderBy("query_id", "rank").collect()
    got = {i: [(r["doc_id"], r["match"]) for r in rows if r["query_id"] == i] for i in range(3)}
    assert got == {0: [("k-1", "semantic")], 1: [("k-2", "both")], 2: [("k-3", "semantic")]}
    words = KnowledgeBase(base.docs, base.chunks, base.shelves)
    assert [r["doc_id"] for r in words.find(q).collect()] == ["k-2"]


def test_shelves_and_collections(spark, base):
    q = asked(spark, "arbitration", "noodles")
    assert [r["doc_id"] for r in base.search(q, any_of=[]).collect()] == ["w-1"]
    assert [r["doc_id"] for r in base.search(q, only="boards").collect()] == ["k-2"]
    assert [r["doc_id"] for r in base.search(q, collection="wiki").collect()] == ["w-1"]


def test_library_and_answer(spark, base):
    lib = Library(base, project=base, shelves=["other"])
    hits = lib.search(asked(spark, "arbitration"))
    assert [r["scope"] for r in hits.collect()] == ["project"]
    assert [r["scope"] for r in lib.search(asked(spark, "arbitration"), shelf="Boards").collect()] == ["global"]
    assert [r["part"] for r in lib.unmentioned(asked(spark, "QT-550 or qt310?")).collect()] == ["QT-550"]

    def model(system, text, limit):
        return '{"queries": ["bus arbitration", "erase sector"]}' if system == "plan" else "Set it [2], see [1][9]."

    none = spark.createDataFrame([], "doc_id string")
    got = Library(base).ask(spark, "how do I set the CAN bus, or erase a sector?", model, "plan", "answer", none)
    assert got["answer"] == "Set it [1], see [2]."
    assert [(s["n"], s["title"]) for s in got["sources"]] == [(1, "flash.md"), (2, "can.md")]


def test_overview_and_retrieval_stay_within_the_shelves(spark, base):
    assert "can;" in Library(base).overview() and "can;" not in Library(base, shelves=["Others"]).overview()
    assert "can;" in Library(base, shelves=["boards"]).overview()
    searches = spark.createDataFrame([(1, ["arbitration"]), (2, ["operating heat"]), (3, ["zzzz"])], "question_id long, searches array<string>")
    found = {(r["question_id"], r["chunk_id"].split("#")[0]) for r in Library(base).retrieve(searches, 8).collect()}
    assert {f for f in found if f[0] == 1} == {(1, "k-2")} and (2, "k-1") in found


def test_evaluation_of_every_mode(spark, base):
    lines = [(1, "operating heat | k-1"), (2, "CAN bus | can.md; k-9"), (3, "erase a sector | k-9 p. 4"), (4, "zebra stripes | -"), (5, "no bar")]
    parsed = E.parse_questions(spark.createDataFrame(lines, "line long, text string"))
    done = E.run_eval(Library(base), *E.expected_rows(parsed))
    ranks = {(r["mode"], r["query_id"]): r["rank"] for r in done.collect()}
    assert ranks == {("keyword", 1): 0, ("hybrid", 1): 1, ("semantic", 1): 1} | {(m, 2): 1 for m in E.MODES} | {(m, q): 0 for m in E.MODES for q in (3, 4)}
    measured = {r["mode"]: (r["answerable"], r["hit1"], r["unanswerable"], r["quiet"]) for r in E.metrics(done).collect()}
    assert measured == {"keyword": (3, 1, 1, 1), "hybrid": (3, 2, 1, 0), "semantic": (3, 2, 1, 0)}
    words = E.run_eval(KnowledgeBase(base.docs, base.chunks, base.shelves), *E.expected_rows(parsed))
    assert {r["mode"] for r in words.collect()} == {"keyword"}


def test_notes_that_find_each_other_by_title(spark):
    texts = {"n1": ("warm board", "heat sink"), "n2": ("too much heat", "it was warm"), "n3": ("flash trouble", "erase"), "n4": ("bus", "can"), "n5": ("flash writes", "erase first")}
    rows = [(i, t, "wiki", x) for i, (t, x) in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id string, title string, collection string, text string")
    chunks = chunk_texts(docs).join(docs.select("doc_id", "title"), "doc_id").withColumn("chunk_id", F.concat_ws("#", "doc_id", F.col("seq").cast("string")))
    none = spark.createDataFrame([], "chunk_id string, doc_id string, model string, vec array<float>")
    vectors = S.embed_pending(chunks, none, spark.createDataFrame([], "doc_id string"), "toy", embed)
    wiki = KnowledgeBase(docs, chunks, spark.createDataFrame([], "doc_id string, shelf string"), vectors, "toy", embed, 0.5)
    assert sorted(tuple(r) for r in wiki.mutual_notes().collect()) == [("n1", "n2"), ("n3", "n5")]
    assert KnowledgeBase(docs, chunks, wiki.shelves).mutual_notes().collect() == []
