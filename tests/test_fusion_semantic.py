import numpy as np
import pytest

from shelfmark.functions import vectors as V
from shelfmark.operators import fusion as F_, semantic as S
from pyspark.sql import functions as F

RANKED = "query_id long, chunk_id long, rank long"


def ranked(spark, *lists):
    return [spark.createDataFrame([(q, c, i + 1) for q, cs in x.items() for i, c in enumerate(cs)], RANKED) for x in lists]


def test_rrf_order_and_labels(spark):
    kw, sem = ranked(spark, {0: [1, 2, 3]}, {0: [3, 4]})
    got = F_.rrf(kw, sem).orderBy("pos").collect()
    assert [(r["chunk_id"], r["match"]) for r in got] == [(3, "both"), (1, "keyword"), (2, "keyword"), (4, "semantic")]
    assert got[0]["score"] == pytest.approx(1 / 63 + 1 / 61)


def test_hybrid_caps_what_only_meaning_finds(spark):
    kw, sem = ranked(spark, {0: [1, 2]}, {0: [10, 11, 12, 13, 1], 1: list(range(20, 30))})
    got = F_.hybrid(kw, sem).orderBy("query_id", "rank").collect()
    first = [r["chunk_id"] for r in got if r["query_id"] == 0]
    assert first == [1, 10, 2, 11, 12] and [r["chunk_id"] for r in got if r["query_id"] == 1] == list(range(20, 25))


def test_scopes_merge_by_rank_project_first(spark):
    mine, all_ = ranked(spark, {0: [1, 2]}, {0: [7, 8, 9]})
    got = F_.merge_scopes(mine, all_, 4).orderBy("rank").collect()
    assert [(r["scope"], r["chunk_id"]) for r in got] == [("project", 1), ("global", 7), ("project", 2), ("global", 8)]


def test_searches_merge(spark):
    rows = [(0, 0, "global", 5, 1), (0, 0, "global", 6, 2), (0, 1, "global", 6, 1), (0, 1, "global", 7, 2)]
    hits = spark.createDataFrame(rows, "question_id long, search int, scope string, chunk_id long, rank long")
    got = F_.merge_searches(hits, 2).orderBy("pos").collect()
    assert [r["chunk_id"] for r in got] == [6, 5] and got[0]["score"] == pytest.approx(1 / 61 + 1 / 60)
    none = spark.createDataFrame([(1, 9)], "question_id long, chunk_id long")
    found = spark.createDataFrame([(0, 9)], "question_id long, chunk_id long")
    assert F_.with_fallback(found, none.unionByName(found)).count() == 2


@pytest.mark.parametrize("block, shared", [(7, 3), (1000, 3), (7, 100)])
def test_nearest_equals_brute_force(spark, block, shared):
    rng = np.random.default_rng(0)
    items, asked = rng.normal(size=(60, 5)), rng.normal(size=(9, 5))
    vec = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(items)] + [(99, [1.0])], "chunk_id long, vec array<float>")
    q = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(asked)], "query_id long, vec array<float>")
    got = S.nearest(q, vec, 4, vector_block=block, query_block=2, shared_queries=shared).collect()
    for i, v in enumerate(asked):
        want = list(np.argsort(-(items.astype("f4").astype("f8") @ v.astype("f4").astype("f8")))[:4])
        assert [r["chunk_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == want


def test_vector_upkeep(spark):
    chunks = spark.createDataFrame([(1, 1, "t", "", "a"), (2, 1, "t", "", "b"), (3, 2, "t", "", "c")], "chunk_id long, doc_id long, title string, heading string, content string")
    vectors = spark.createDataFrame([(1, 1, "m", [1.0])], "chunk_id long, doc_id long, model string, vec array<float>")
    waiting = spark.createDataFrame([(2,)], "doc_id long")
    todo = S.next_pending(chunks, vectors, waiting, "m", 9)
    assert [r["chunk_id"] for r in todo.collect()] == [2]
    assert S.progress(chunks, vectors, waiting, "m").first().asDict() == {"done": 1, "total": 2}
    made = S.embed(S.pending(chunks, vectors, waiting, "m"), lambda texts: np.array([[3.0, 4.0]] * len(texts)))
    assert made.first()["vec"] == pytest.approx([0.6, 0.8])
    stale = made.withColumn("text", F.lit("old"))
    assert S.put_vectors(vectors, stale, chunks, "m").count() == 1
    assert S.put_vectors(vectors, made, chunks, "m").count() == 2
    assert S.purge_other_models(vectors, "x").count() == 0


def test_profiles():
    assert V.profile_for("onnx/Granite-Embedding-97M-multilingual-R2").min_score == 0.84
    assert V.profile_for("qwen3-embedding-4b").min_score is None
    assert V.model_key("api", "m", "http://h") == "api:http://h|m" and V.model_key("local", "bge-m3") == "local:bge-m3#cls"
