"""Titles by order of arrival, against a plain loop over the documents in that order."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import versions as V


def _parts(source):
    return [p for p in re.split(r"[\\\\/]+", source.removeprefix("upload:")) if p]


def _ending(source, k):
    return "/".join(_parts(source)[-(1 if source.startswith("upload:") else k):])


def in_turn(docs):
    """Every document's title after all have come, one at a time."""
    titles = {}
    source_of = {i: s or "" for i, s, _ in docs}
    for i, source, _ in sorted(docs, key=lambda d: (d[2], d[0])):
        source, taken = source or "", set(titles.values())
        name, upload = _ending(source, 1), source.startswith("upload:")
        same = [d for d, t in titles.items() if (t == name or t.endswith("/" + name)) and not source_of[d].startswith("upload:")]
        if name not in taken and (upload or not same):
            titles[i] = name
            continue
        for k in range(2, 1 if upload else len(_parts(source)) + 1):
            ending = _ending(source, k)
            if ending in taken or any(_ending(source_of[d], k) == ending for d in same):
                continue
            for d in same:
                if titles[d] == name and _ending(source_of[d], k) not in taken:
                    titles[d] = _ending(source_of[d], k)
            titles[i] = ending
            break
        else:
            n = 2
            while f"{name} ({n})" in taken:
                n += 1
            titles[i] = f"{name} ({n})"
    return titles


def found(spark, docs, **how):
    rows = spark.createDataFrame(docs, "doc_id long, source string, arrived long").withColumn("title", F.lit("clashing name"))
    return {r["doc_id"]: r["title"] for r in V.titles_by_arrival(rows, **how).collect()}


def test_later_files_rename_only_what_they_clash_with(spark):
    docs = [(1, "/a/alpha/README.md", 1), (2, "/a/beta/README.md", 2), (3, "/b/beta/README.md", 3), (4, "/x/one.md", 4), (5, "upload:README.md", 5), (6, "upload:README.md", 6)]
    want = {1: "alpha/README.md", 2: "beta/README.md", 3: "b/beta/README.md", 4: "one.md", 5: "README.md", 6: "README.md (2)"}
    assert found(spark, docs) == want == in_turn(docs)
    assert found(spark, docs[:1]) == {1: "README.md"} and found(spark, []) == {}


@pytest.mark.parametrize("seed", range(4))
def test_as_one_after_the_other(spark, seed):
    """Groups of one name each: bare, in folders of up to four, whole paths again, uploads before, between and after; ties and nulls."""
    rng, docs = random.Random(seed), [(-1, None, 3), (-2, None, 3), (-3, "/", 9)]
    for group in range(60):
        for _ in range(rng.randint(1, 9)):
            folders = [rng.choice("ab") for _ in range(rng.choice([0, 1, 1, 2, 3, 4]))]
            kind = rng.random()
            path = rng.choice(["/", "C:\\\\", ""]) + rng.choice(["/", "//"]).join([*folders, f"n{group}.md"])
            docs.append((len(docs), f"upload:n{group}.md" if kind < 0.25 else path, rng.randint(0, 200)))
    want = in_turn(docs)
    assert found(spark, docs) == want
    assert found(spark, docs, block=F.floor(F.col("arrived") / 10)) == want
