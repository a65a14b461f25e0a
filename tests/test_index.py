"""The persisted index: the same matches as reading the texts, before and after changes, deletions and compaction."""

import random
import tempfile

import pytest

from shelfmark.operators import index as I, keyword as K
from tests.test_search import COLUMNS, corpus, overlapping

NEEDLES = ["spi", "clock", "aa", "a", "aaa", "aaaa", "voltage", "ctrl_reg", "供电电压范围", "供电", "电", "guide.md", "3.3v", "nothing", "up", "k s", "𝕏y", "𝕏", "", None]


def brute(rows, needles):
    out = []
    for chunk, doc, _, *texts in rows:
        low = [(t or "").lower() for t in texts]
        for n in set(needles) - {None, ""}:
            if any(n in t for t in low):
                occ = sum(w * overlapping(t, n) for w, t in zip((3, 2, 1), low)) if len(n) >= 3 else 0
                out.append((chunk, doc, n, occ))
    return sorted(out)


def found(spark, index, needles=NEEDLES):
    df = I.match(index, spark.createDataFrame([(n,) for n in needles], "needle string"))
    return sorted((r["chunk_id"], r["doc_id"], r["needle"], r["occ"]) for r in df.collect())


def folder():
    return tempfile.mkdtemp(prefix="index-")


@pytest.mark.parametrize(("chars", "named"), [(1 << 18, 256), (200, 256), (200, 0)])
def test_matches_are_those_of_the_texts(spark, monkeypatch, chars, named):
    monkeypatch.setattr(I, "BLOCK_CHARS", chars)
    monkeypatch.setattr(I, "NAMED_GRAMS", named)
    rows = corpus(chars) + [(900, 300, None, "", None, None), (901, 300, 1, "𝕏y", "𝕏", "aa𝕏y"), (902, 301, 1, "AAA", "B", "x" * 5000 + "Clock SPI")]
    made = I.build(spark.createDataFrame(rows, COLUMNS), folder())
    assert found(spark, made) == brute(rows, NEEDLES)


def test_sync_and_compaction_are_a_rebuild(spark, monkeypatch):
    monkeypatch.setattr(I, "BLOCK_CHARS", 300)
    rng = random.Random(4)
    rows = corpus(5)
    made = I.build(spark.createDataFrame(rows, COLUMNS), folder())
    for step in range(3):
        gone = set(rng.sample(range(20), 3)) | {999}
        edited = set(rng.sample([d for d in range(25) if d not in gone], 4))
        fresh = [(c, d, p, t, h, x + " flash") for c, d, p, t, h, x in corpus(50 + step, 75) if d in edited]
        rows = [r for r in rows if r[1] not in gone | edited] + fresh
        made = I.update(made, spark.createDataFrame(fresh, COLUMNS), spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        assert found(spark, made) == brute(rows, NEEDLES)
        if step == 1:
            made = I.compact(made, spark)
            assert len(made.generations) == 1 and found(spark, made) == brute(rows, NEEDLES)
    chunks = spark.createDataFrame(rows, COLUMNS)
    assert made.stats(spark).first() == K.corpus_stats(chunks).first()
    queries = spark.createDataFrame([(1, "flash clock"), (2, "the pin"), (3, "供电电压范围"), (4, "aa")], "query_id long, query string")
    again = K.search(chunks, queries, how=I.build(chunks, folder())).collect()
    assert K.search(chunks, queries, how=made).collect() == again == K.search(chunks, queries, how="automaton").collect() and len(again) > 8


def test_an_empty_index_finds_nothing(spark):
    empty = spark.createDataFrame([], COLUMNS)
    made = I.build(empty, folder())
    assert found(spark, made) == []
    rows = [(1, 1, 1, "t", None, "clock")]
    assert found(spark, I.update(made, spark.createDataFrame(rows, COLUMNS))) == brute(rows, NEEDLES)


def test_ids_may_be_strings(spark):
    rows = [("c1", "d1", 1, "t", "h", "clock"), ("c2", "d2", 1, "t", "h", "clocks")]
    df = spark.createDataFrame(rows, COLUMNS.replace("long", "string"))
    assert found(spark, I.update(I.build(df, folder()), df.limit(0), df.where("doc_id = 'd1'")), ["clock"]) == [("c2", "d2", "clock", 1)]


def test_no_needles_find_nothing(spark):
    made = I.build(spark.createDataFrame(corpus(2, 5), COLUMNS), folder())
    assert found(spark, made, [None, ""]) == []


def test_packed_places_come_back():
    import numpy as np

    rows = [[0], [5, 6, 300, 70_000], [2**31 - 1], [1, 2**28, 2**30]]
    flat = np.array([p for r in rows for p in r], np.int64)
    packed = I._packed(flat, np.array([0, 1, 5, 6]))
    places, first = I._unpacked(packed.slice(1))
    assert [places[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == rows[1:]
    assert len(packed.buffers()[2]) == 1 + (1 + 1 + 2 + 3) + 5 + (1 + 4 + 5)


def test_an_index_is_written_once_and_small(spark):
    """Places cost two bytes a character at most, and a build leaves nothing but the index in the shared folder."""
    import os

    from shelfmark.session import shared_folder

    rng = random.Random(1)
    words = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(2000)]
    rows = [(i, i, 1, f"t{i}", "", " ".join(rng.choices(words, k=200))) for i in range(500)]
    size = lambda at: sum(os.path.getsize(os.path.join(r, f)) for r, _, fs in os.walk(at) for f in fs)
    at, before = folder(), size(shared_folder(spark))
    I.build(spark.createDataFrame(rows, COLUMNS).coalesce(2), at)
    assert size(at) < 2 * sum(len(r[5]) for r in rows) and size(shared_folder(spark)) == before


def test_rows_of_a_common_gram_are_unpacked_a_few_at_a_time():
    """A batch may hold a gram's places in thousands of blocks; what tasks hold at once does not grow with their number."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    n, each = 400, 20_000
    flat = np.tile(np.arange(0, 3 * each, 3, dtype=np.int64), n)
    places = I._packed(flat, np.arange(0, n * each, each))
    block, bits = pa.array(np.arange(n)), pa.array(np.full(n, 8, np.int32))
    dead = pa.array([bytes([1 + 4]) if i % 2 else None for i in range(n)], pa.binary())  # segments 0 and 2
    postings = pa.RecordBatch.from_arrays([pa.array(np.full(n, 7)), block, bits, places, dead], ["gram", "block", "bits", "places", "dead"])
    hits = pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int32)), places], ["off", "places"])
    listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), hits)
    asked = pa.RecordBatch.from_arrays([pa.array(["the"] * n), block, bits, pa.array(np.ones(n, np.int32)), listed], ["needle", "block", "bits", "parts", "rows"])
    per_segment = np.bincount(flat[:each] >> 8)

    def held(run, batch):
        tracemalloc.start()
        try:
            out = list(run(iter([batch.slice(3)])))
            return pa.Table.from_batches(out), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    alive, most = held(I._alive, postings)
    assert most < 200 << 20 and alive.column("block").to_pylist() == list(range(3, n))
    back, first = I._unpacked(alive.column("places").combine_chunks())
    kept = [p for p in flat[:each].tolist() if p >> 8 not in (0, 2)]
    assert all(back[a:b].tolist() == (kept if i % 2 else flat[:each].tolist()) for i, a, b in zip(range(3, n, 57), first[:-1:57], first[1::57]))
    found, most = held(I._counted, asked)
    assert most < 200 << 20 and len(found) == (n - 3) * len(per_segment)
    assert found.column("times").to_numpy().reshape(n - 3, -1).tolist() == [per_segment.tolist()] * (n - 3)


def test_postings_are_not_shuffled(spark):
    """Building, updating and compacting move nothing: a gram of every block lies in every file, sorted, and is found in all."""
    import glob

    import pyarrow.parquet as pq

    rows = corpus(9)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    made = I.build(df, folder())
    made = I.update(made, df.where("doc_id < 3"), spark.createDataFrame([(5,)], "doc_id long"))
    files = glob.glob(f"{made.path}/{made.generations[0]}/rows/part=postings/*.parquet")
    grams = [pq.read_table(f, partitioning=None).column("gram").to_pylist() for f in files]
    assert len(grams) == 3 and all(g == sorted(g) for g in grams) and set(grams[0]) & set(grams[1]) & set(grams[2])
    kept = [r for r in rows if r[1] != 5]
    assert found(spark, made) == brute(kept, NEEDLES) == found(spark, I.compact(made, spark))
