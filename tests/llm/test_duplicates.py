import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfmark.llm import components as components_
from shelfmark.llm import jaccard_join, suffix_dedup
from shelfmark.llm.components import components
from tests.llm.rows import WORD, awkward, frame, words


def sets_of(rows, width):
    for i, text, *_ in rows:
        found = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
        yield i, {tuple(found[k : k + width]) for k in range(len(found) - width + 1)} if len(found) >= width else ({tuple(found)} if found else set())


def groups_of(rows, width, percent):
    sets, parent = list(sets_of(rows, width)), {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if None not in (i, j) and x and y and 100 * len(x & y) >= percent * len(x | y):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return sorted((i if i is not None else -1, len(x), root(i) if i is not None else -1) for i, x in sets)


def family(seed):
    """Near copies of several texts, at all distances from the base, and unlike texts with common lines."""
    rng = random.Random(seed)
    rows = []
    for _ in range(4):
        base = words(rng, 150).split()
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(len(own))] = words(rng, 1)
            rows.append(" ".join(own))
    line = words(rng, 12)
    rows += [words(rng, 60) + "\n" + line for _ in range(30)]
    rng.shuffle(rows)
    return [(i, t, None, None) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("width", "percent", "rounds"), [(3, 90, 3), (5, 80, 1), (2, 60, 1)])
def test_components_are_brute_forces(spark, monkeypatch, width, percent, rounds):
    monkeypatch.setattr(jaccard_join, "PIVOT_ROUNDS", rounds)
    rows = family(width)
    found = jaccard_join.jaccard_components(frame(spark, rows), width, percent).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == groups_of(rows, width, percent)


def test_awkward_rows(spark):
    rows = awkward()
    found = jaccard_join.jaccard_query(frame(spark, rows, ["id", "n", "token", "label"])).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((none(r["doc_id"]), r["n_shingles"], none(r["component_id"])) for r in found) == groups_of(rows, 3, 90)
    assert jaccard_join.jaccard_query(frame(spark, [])).collect() == []


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 2), (200, 150), (150, 170)]
    found = {r["id"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    found = {i: found.get(i, i) for i in range(201)}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 140)} == {100} and {found[i] for i in (150, 170, 200)} == {150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_in_many_tasks_and_in_one(spark, monkeypatch):
    """A round of few edges is one partition and shuffles nothing; with more, the answer is the same."""
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(120), rng.randrange(120)) for _ in range(90)], "a long, b long")
    one = sorted(components(edges).collect())
    monkeypatch.setattr(components_, "TASK_EDGES", 9)
    assert sorted(components(edges).collect()) == one
    both = components_._either(edges.coalesce(1), F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    assert both.count() == 180 and "Exchange" not in both.groupBy("u").agg(F.min("v"))._jdf.queryExecution().toString()


def test_many_pairs_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FEW_PAIRS", 0)
    rows = family(4) + [(3, "some words of another text of the same id", None, None)]
    found = jaccard_join.jaccard_components(frame(spark, rows), 3, 90).collect()
    few = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found)
    assert [r[::2] for r in few] == [r[::2] for r in groups_of(rows, 3, 90)]


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=60) | st.text("ab", max_size=80).map(str.encode))
def test_suffix_array(data):
    array = suffix_dedup.suffix_array(data, 1000)
    assert array.tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_sliding_least_and_regions():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 200).astype(np.uint64)
    for width in (1, 2, 7, 200):
        assert suffix_dedup.sliding_least(values, width).tolist() == [int(values[i : i + width].min()) for i in range(201 - width)]
    data = np.frombuffer(words(random.Random(1), 300).encode(), np.uint8)
    row, first, starts, _ = suffix_dedup.regions(data, np.array([0, 30, 700, len(data)]), 90)
    assert starts.sum() == sum(max(0, n - 89) for n in (30, 670, len(data) - 700)) and (starts <= 90 - suffix_dedup.GRAM + 1).all() and 0 not in row


def cut_of(rows, length):
    seen, texts = Counter(), [(i, (t or "").encode()) for i, t, *_ in rows]
    for _, t in texts:
        seen.update(t[k : k + length] for k in range(len(t) - length + 1))
    for i, t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        yield i if i is not None else -1, sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(t, gone, strict=True) if not g)


@pytest.mark.parametrize(("array_bytes", "step"), [(1 << 20, 64), (1500, 16), (200, 16)])
def test_removal_is_brute_forces(spark, monkeypatch, array_bytes, step):
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array_bytes)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rng = random.Random(8)
    base = [words(rng, 60) for _ in range(4)]
    rows = [r for r in awkward(n=20) if len(r[1] or "") < 4000]
    for i in range(60):
        text = rng.choice(base)
        a = rng.randrange(len(text))
        rows.append((1000 + i, words(rng, rng.randint(0, 9)) + text[a : a + rng.randint(0, 300)] + words(rng, rng.randint(0, 9)), None, None))
    rows += [(2000, "é" * 90, None, None), (2001, "ab" * 80, None, None)]
    found = suffix_dedup.remove_repeats(frame(spark, rows, ["kept", "key", "id", "anchor"]), 60).collect()
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), bytes(r["kept"])) for r in found)
    assert got == sorted(cut_of(rows, 60)) and {r["anchor"] for r in found} == {"own"}


def test_removal_of_nothing(spark):
    assert suffix_dedup.dedup_query(frame(spark, [])).collect() == []
    row = suffix_dedup.dedup_query(frame(spark, [(1, None, None, None)])).first()
    assert (row["n_bytes"], row["n_removed"], row["n_spans"]) == (0, 0, 0)


def under_passages(rows, least):
    """Bytes of each row under passages of ``least`` words that start twice, by trying all."""
    found = [(i, [(m.start(), m.end(), m.group()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())]) for i, t, *_ in rows]
    seen = Counter(tuple(w[2] for w in ws[k : k + least]) for _, ws in found for k in range(len(ws) - least + 1))
    for i, ws in found:
        gone = set()
        for k in range(len(ws) - least + 1):
            if seen[tuple(w[2] for w in ws[k : k + least])] > 1:
                gone.update(range(ws[k][0], ws[k + least - 1][1]))
        yield i if i is not None else -1, len(gone)


@pytest.mark.parametrize(("array_bytes", "task_bytes"), [(1 << 20, 1 << 18), (2000, 500), (150, 500)])
def test_query_tells_short_passages(spark, monkeypatch, array_bytes, task_bytes):
    """Passages of some words count whatever blanks part them; what is removed are still the strings alone."""
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array_bytes)
    monkeypatch.setattr(suffix_dedup, "TASK_BYTES", task_bytes)
    monkeypatch.setattr(suffix_dedup, "STEP", 16)
    rng = random.Random(3)
    base = [words(rng, 30) for _ in range(4)]
    rows = [r for r in awkward(n=20) if len(r[1] or "") < 4000]
    for i in range(80):
        some = rng.choice(base).split()
        a = rng.randrange(len(some))
        rows.append((1000 + i, f"{words(rng, rng.randint(0, 5))} {rng.choice([' ', '  ', chr(10)]).join(some[a : a + rng.randint(0, 25)])} é{i} {words(rng, 3)}", None, None))
    rows += [(2000, "a b " * 30, None, None), (2001, "x " * 40, None, None)]
    found = suffix_dedup.dedup_query(frame(spark, rows), least_words=8).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_passage_bytes"]) for r in found) == sorted(under_passages(rows, 8))
    cut = [(i, len((t or "").encode()), n, k, hashlib.sha256(left).hexdigest()) for (i, n, k, left), (_, t, *_) in zip(cut_of(rows, 400), rows, strict=True)]
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, *r[1:5]) for r in found]
    assert sorted(got) == sorted(cut)


def test_only_repeated_hashes_are_sorted(monkeypatch):
    """Regions without a string that may occur twice reach no suffix array; one task's array is bounded by bytes of regions."""
    made = []
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda data, depth, real=suffix_dedup.suffix_array: made.append(len(data)) or real(data, depth))
    rng = random.Random(4)
    alone = [(rng.randbytes(700), 301) for _ in range(50)]
    assert all(not len(s) for s in suffix_dedup.repeated_starts(alone, 400)) and not made
    shared = rng.randbytes(600)
    found = suffix_dedup.repeated_starts([*alone, (b"x" + shared, 202), (b"yy" + shared, 203)], 400)
    assert [s.tolist() for s in found[-2:]] == [list(range(1, 202)), list(range(2, 203))] and not any(len(s) for s in found[:-2])
    assert sum(made) < 2000
