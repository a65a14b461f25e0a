import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmark.llm import embedding_dedup as E


def brute(rows, threshold):
    """(id, links, component, kept) of all pairs in double precision, sorted."""

    def fine(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    parent, links = {}, [0] * len(rows)

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, (i, x) in enumerate(rows):
        for b in range(a):
            j, y = rows[b]
            if i is None or j is None or not fine(x) or not fine(y) or len(x) != len(y):
                continue
            x64, y64 = np.array(x, np.float32).astype(np.float64), np.array(y, np.float32).astype(np.float64)
            if x64 @ y64 / np.linalg.norm(x64) / np.linalg.norm(y64) >= threshold:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    out = [(i, n, None if i is None else root(i)) for (i, _), n in zip(rows, links, strict=True)]
    return sorted((i if i is not None else -1, n, c if c is not None else -1, c == i) for i, n, c in out)


def result(df):
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1, r["kept"]) for r in df.collect())


def clouds(rng, dim, families, size, alone):
    """Families around random directions, at all distances about the threshold, and vectors that stand alone."""
    rows = []
    for _ in range(families):
        base = rng.standard_normal(dim)
        for _ in range(size):
            rows.append(base + rng.uniform(0, 0.75) * rng.standard_normal(dim))
    rows += list(rng.standard_normal((alone, dim)))
    rng.shuffle(rows)
    return [(k, [float(np.float32(x)) for x in row * rng.uniform(0.1, 9)]) for k, row in enumerate(rows)]


SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize(("dim", "block", "small", "bucket"), [(24, 4096, 48, 2048), (24, 16, 2, 2048), (70, 64, 4, 8), (3, 32, 8, 4)])
def test_links_are_brute_forces(spark, monkeypatch, dim, block, small, bucket):
    for name, value in (("BLOCK", block), ("SMALL", small), ("BUCKET", bucket), ("MISSED", 1e-6)):
        monkeypatch.setattr(E, name, value)
    rows = clouds(np.random.default_rng(dim), dim, 5, 25, 90)
    assert result(E.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows, 0.9)


def test_awkward_vectors(spark):
    rng = random.Random(3)
    one = [rng.gauss(0, 1) for _ in range(8)]
    nan, inf = float("nan"), float("inf")
    rows = [(1, one), (2, [2 * x for x in one]), (3, one), (3, one), (4, None), (5, []), (6, [0.0] * 8), (7, [nan] * 8), (8, [inf, *one[1:]]), (9, [None, *one[1:]])]
    rows += [(None, one), (None, None), (10, one[:7]), (11, [-x for x in one]), (12, [1e30 * x for x in one]), (3, [-x for x in one]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]), (15, [5.0]), (16, [2.0])]
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", component_id string")
    assert result(E.near_duplicates(df)) == brute(rows, 0.9)
    assert E.near_duplicates(df.limit(0)).collect() == []
    doubles = df.selectExpr("vec_id", "cast(embedding as array<double>) as embedding")
    assert result(E.near_duplicates(doubles)) == brute(rows, 0.9)


@settings(deadline=None, max_examples=30)
@given(st.integers(1, 130), st.integers(0, 10**6), st.floats(0.3, 0.99))
def test_bounds_never_rule_out_a_link(dim, seed, threshold):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((1, dim))
    units = E._units(base + rng.uniform(0, 1.2, (60, 1)) * rng.standard_normal((60, dim)))
    code, corner = E.codes(units)
    queries = E.Queries(units)
    i, j = np.arange(60)[:, None], np.arange(60)[None, :]
    some = E.open_pairs(E.estimates(code, queries, i, j, dim), corner, queries, i, j, dim, threshold)
    cosine = units @ units.T
    own = np.clip(corner, 1e-9, 1.0)[:, None]
    assert some[cosine >= threshold].all() or E.SPREADS * np.sqrt((1 - own**2) / max(dim - 1, 1)).min() < 0.02


def test_estimates_have_no_bias_and_the_stored_spread():
    """Over many rotations of pairs with a given cosine, the estimate's mean is the cosine; its errors are as wide as stored."""
    rng = np.random.default_rng(5)
    dim, n = 64, 4000
    x = E._units(rng.standard_normal((n, dim)))
    y = E._units(0.7 * x + math.sqrt(0.51) * E._units(rng.standard_normal((n, dim))))
    code, corner = E.codes(np.concatenate((x, y)))
    queries = E.Queries(np.concatenate((x, y)))
    i, j = np.arange(n), n + np.arange(n)
    error = E.estimates(code, queries, i, j, dim) / corner[i] - (x * y).sum(1)
    spread = np.sqrt((1 - corner[i] ** 2) / (dim - 1) + queries.lost[j] ** 2 / dim) / corner[i]
    assert abs(error.mean()) < 4 * error.std() / math.sqrt(n) + 0.003
    assert 0.5 < error.std() / spread.mean() < 1.2 and (np.abs(error) < E.SPREADS * spread).all()


def test_share_of_pairs_at_the_threshold_that_meet():
    """Pairs exactly at the threshold meet in some table as often as promised, with buckets named by two coordinates."""
    rng = np.random.default_rng(6)
    x = E._units(rng.standard_normal((3000, 64)))
    away = rng.standard_normal((3000, 64))
    away = E._units(away - (away * x).sum(1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(0.19) * away
    for levels in (1, 2):
        a, b = E.bucket_names(x, levels, 0.9), E.bucket_names(y, levels, 0.9)
        met = (a[:, :, :, None] == b[:, :, None, :]).any((1, 2, 3)).mean()
        assert met > 0.995
