"""Streams give after every batch, and after a restart, what the batch query gives for all that has come."""

import json
import os
import random
import tempfile
import time

from pyspark.sql import functions as F

from shelfmark.operators import dialogue as D
from shelfmark.sources.files import MANIFEST
from shelfmark.streaming import arrivals as A, nudges as N, sync as Y

MESSAGES = "conv_id long, turn int, role string, text string, tool string, call_id string, is_error boolean, arguments string, kind string"
NAMES = ("save_note", "notes_", "reminder")


def conversation(rng, conv, n):
    rows = []
    for turn in range(n):
        kind = rng.choice(["user", "user", "bash", "result", "result", "edit", "note", "custom"])
        call = f"c{conv}-{rng.randrange(max(1, turn))}"
        rows.append({
            "user": (conv, turn, "user", rng.choice(["from now on use tabs", "what is it", None]), None, None, None, None, None),
            "bash": (conv, turn, "assistant", None, rng.choice(["bash", "read", "notes_find"]), f"c{conv}-{turn}", None, rng.choice(["sed -i s/a/b/ x", "ls", None]), None),
            "result": (conv, turn, "toolResult", None, "bash", call, rng.choice([True, False, None]), None, None),
            "edit": (conv, turn, "toolResult", None, "edit", None, rng.choice([True, False]), None, None),
            "note": (conv, turn, "assistant", None, "save_note" if rng.random() < 0.2 else "grep", None, None, "{}", None),
            "custom": (conv, turn, "custom", None, None, None, None, None, rng.choice(["reminder", "other", "other"])),
        }[kind])
    return rows


def test_nudges_of_every_prefix(spark):
    rng = random.Random(6)
    root = tempfile.mkdtemp(prefix="nudges-")
    rows = [conversation(rng, c, rng.randint(1, 24)) for c in range(60)]
    seen = []
    for step in range(3):
        part = [r for conv in rows for r in conv[step * 8 : step * 8 + 8]]
        rng.shuffle(part)
        seen += part
        # Two files a run: two batches, of conversations apart from each other.
        for half in (0, 1):
            spark.createDataFrame([r for r in part if r[0] % 2 == half], MESSAGES).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(MESSAGES).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        N.follow_nudges(stream, f"{root}/out", f"{root}/state", *NAMES)
        got = N.current_nudges(spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out"))
        want = D.note_nudges(spark.createDataFrame(seen, MESSAGES), *NAMES)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 3


def test_manifests_and_texts_wait_for_each_other(spark):
    root = tempfile.mkdtemp(prefix="arrivals-")
    for folder in ("m", "t"):
        os.mkdir(f"{root}/{folder}")
    start = time.time() - 40 * 86400

    def put(path, text, day):
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
        os.utime(f"{root}/{path}", (start + day * 86400,) * 2)

    def manifest(i, day, **more):
        put(f"m/{i}.json", json.dumps({"id": i, "path": f"/x/{i}", "title": i, **more}), day)

    def whole():
        A.follow_documents(spark, f"{root}/m", f"{root}/t", f"{root}/out", f"{root}/state", "7 days")
        return sorted((r["id"], r["text"]) for r in spark.read.option("basePath", f"{root}/out").parquet(f"{root}/out").collect())

    manifest("first", 0)
    put("m/broken.json", "{", 0)
    put("t/broken.md", "x", 0)
    manifest("orphan", 0)
    put("t/second.md", "two\nlines", 0)
    assert whole() == []
    put("t/first.md", "one", 1)
    manifest("second", 1)
    manifest("other", 1, path=None)
    put("t/other.md", "x", 1)
    assert whole() == [("first", "one"), ("second", "two\nlines")]
    # Much later files move the time on; what waited too long is forgotten.
    manifest("third", 20)
    put("t/third.md", "three", 20)
    assert ("third", "three") in whole()
    put("t/orphan.md", "too late", 21)
    assert whole() == [("first", "one"), ("second", "two\nlines"), ("third", "three")]


def test_records_of_one_id_in_one_batch(spark):
    root = tempfile.mkdtemp(prefix="sync-")
    blank = {f.name: None for f in MANIFEST.fields}
    for order in ([1, 2], [2, 1]):
        rows = [json.dumps({k: v for k, v in (blank | {"id": "a", "path": f"/p{n}"}).items() if v is not None}) for n in order]
        box = tempfile.mkdtemp(prefix="inbox-")
        with open(f"{box}/x.json", "w") as f:
            f.write("\n".join(rows))
        table = tempfile.mkdtemp(prefix="table-") + "/t"
        Y.follow_manifests(spark, box, table, tempfile.mkdtemp(prefix="state-"))
        assert [r["path"] for r in Y.current_manifests(spark, table).select(F.col("path")).collect()] == ["/p2"]
    assert root
