"""Token counts: batches of about equal bytes through a tokenizer inside Arrow functions; only lengths come back."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import plus, small_batches, texts
from shelfmark.llm.segments import spans

#: Characters encoded by one call, and of one span of a long text.
CALL_CHARS = 200_000
SPAN_CHARS = 20_000

_loaded: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per worker. Spark's tasks are the parallelism, so its own threads stay off."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _loaded[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            loaded = Tokenizer.from_file(path)
            loaded.no_truncation()
            loaded.no_padding()
            _loaded[path] = loaded
    return _loaded[path]


def _lengths(path: str, batch: list[str]) -> list[int]:
    if path.endswith(".model"):
        return [len(ids) for ids in tokenizer(path).encode(batch, num_threads=1)]
    return [len(e) for e in tokenizer(path).encode_batch_fast(batch, add_special_tokens=False)]


def balanced(parts: list[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """Runs of parts whose characters add up to about ``most``; a longer part is a run of its own."""
    run, size = [], 0
    for part in parts:
        if run and size + len(part[1]) > most:
            yield run
            run, size = [], 0
        run.append(part)
        size += len(part[1])
    if run:
        yield run


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of each text.

    ``path`` is a ``tokenizers`` JSON file of a byte-level BPE, whose long texts are split where no pre-token can
    cross, or a ``sentencepiece`` model, whose texts are encoded whole. No begin, end or other special tokens are added;
    special strings inside a text are treated as the library does by default. Null and empty texts count 0. Every row
    is kept, repeated rows included; all columns pass through. A column called ``out`` is replaced. No shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names = docs.columns
    split = not path.endswith(".model")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = texts(batch.column(names.index(text)))
            totals = [0] * len(rows)
            parts = [(i, s) for i, t in enumerate(rows) if t for s in (spans(t, SPAN_CHARS) if split else [t])]
            for run in balanced(parts, CALL_CHARS):
                for (i, _), n in zip(run, _lengths(path, [s for _, s in run]), strict=True):
                    totals[i] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(totals, pa.int64())], [*names, out])

    return docs.mapInArrow(count, plus(docs.schema, **{out: "long"}))


def token_count_query(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """One row per document: bytes of its text, its tokens, and whether they exceed ``limit``."""
    counted = count_tokens(docs.select("doc_id", "text"), path)
    return counted.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
