"""Language ID by compression: the language whose dictionary makes the text smallest.

Each language has one raw-content zstandard dictionary, cut from a bounded sample of its labelled texts. A text is
compressed, block by block, with every dictionary; the smallest total names the language. If the runner-up is hardly
larger, the answer is not to be trusted and the row is marked as rejected.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.common import documents, fold, plus, small_batches, texts

#: Bound of the training sample: distinct texts a language, each read whole.
SAMPLE_TEXTS = 128
#: A text is cut into stretches of so many characters over its whole length; a dictionary is full at so many of them.
STRETCH_CHARS = 256
DICTIONARY_STRETCHES = 512
#: Characters of a block that is compressed on its own, so that a long text cannot become its own dictionary.
BLOCK_CHARS = 4096
#: A runner-up that is larger by less than this share of its size makes the answer narrow.
MARGIN = 0.01
LEVEL = 9

_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case letters with one blank for whatever stands between: marks and digits say nothing of the language."""
    return _OTHER.sub(" ", text.lower())


@dataclass(frozen=True)
class LanguageModel:
    """A dictionary's content for each language, of at most DICTIONARY_STRETCHES * STRETCH_CHARS characters."""

    content: dict[str, bytes]


def _stretches(text: str) -> list[str]:
    """Stretches of the whole text's letters by their hashes, as many as fill a dictionary: a stretch's place does not matter."""
    plain = letters(text)
    cut = [plain[i : i + STRETCH_CHARS] for i in range(0, len(plain), STRETCH_CHARS)]
    return heapq.nsmallest(DICTIONARY_STRETCHES, cut, key=lambda s: (xxhash.xxh64_intdigest(s), s))


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE_TEXTS) -> LanguageModel:
    """Dictionaries from rows with a text and a language; other rows teach nothing.

    The sample is bounded: ``sample`` distinct texts a language at most, those with the smallest hashes. Distinct hashes
    are counted by language first, as copies share one, and the scan keeps only as large a share of the hashes as holds the
    sample, so few rows are left however large the table. A sampled text counts whole: it is cut into stretches over its
    whole length, and every text gives the stretch of its smallest hash, then that of the second, and so on until the
    dictionary is full. No rows: a model without languages.
    """
    small_batches(labelled.sparkSession)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    hashed = F.xxhash64(F.col(text))
    counts = {r[0]: r[1] for r in known.select(F.col(lang).alias("lang"), hashed.alias("h")).distinct().groupBy("lang").count().collect()}
    limits = {name: min(2**63 - 1, -(2**63) + int(min(1.0, 2 * sample / n) * 2**64)) for name, n in counts.items()}
    wanted: Column = F.lit(False)
    for name, limit in limits.items():
        wanted |= (F.col(lang) == name) & (hashed <= F.lit(limit))
    rows = known.where(wanted).select(F.col(lang).alias("lang"), hashed.alias("h"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in batches:
            langs, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, of in enumerate(zip(langs, hashes, strict=True)):
                if of in met:
                    continue
                met.add(of)
                found = _stretches(batch.column(2)[at].as_py())
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([of[0]] * n, pa.string()), pa.array([of[1]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(found, pa.string())], ["lang", "h", "turn", "stretch"])

    found = rows.mapInArrow(cut, "lang string, h long, turn int, stretch string").dropDuplicates(["lang", "h", "turn"])
    texts_of = F.dense_rank().over(Window.partitionBy("lang").orderBy("h"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "h"))
    full = found.withColumn("_text", texts_of).where(F.col("_text") <= sample).withColumn("_place", place).where(F.col("_place") <= DICTIONARY_STRETCHES)
    content: dict[str, list[str]] = {}
    for row in full.select("lang", "stretch").orderBy("lang", "_place").collect():
        content.setdefault(row["lang"], []).append(row["stretch"])
    return LanguageModel({name: "\n".join(of).encode() for name, of in content.items()})


def _sizes(model: LanguageModel) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for name, content in model.content.items():
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(level=LEVEL)
        out[name] = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False)
    return out


def classify(docs: DataFrame, model: LanguageModel, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` to every row.

    ``lang_pred`` is the language of the smallest total; of equal totals the first name. Texts that are null, empty or
    without a letter, and all texts if the model has no language, are ``und`` with score 0 and rejected. ``score`` is the
    runner-up's size over the sum of both (0.5: no difference; 1 if there is one language). ``rejected`` is also set
    where the runner-up is larger by less than ``margin`` of its size. Whole texts are read, lower-cased and by their letters alone; rows and other columns stay
    as they are, columns of the added names are replaced. No shuffle.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _sizes(model)
        for batch in batches:
            langs, scores, rejects = [], [], []
            for row in texts(batch.column(at)):
                if not compressors or not _LETTER.search(row):
                    langs.append("und"), scores.append(0.0), rejects.append(True)
                    continue
                lower = letters(row)
                blocks = [lower[i : i + BLOCK_CHARS].encode() for i in range(0, len(lower), BLOCK_CHARS)]
                totals = sorted((sum(len(c.compress(b)) for b in blocks), name) for name, c in compressors.items())
                best, second = totals[0][0], totals[1][0] if len(totals) > 1 else None
                langs.append(totals[0][1])
                scores.append(second / (best + second) if second else 1.0)
                rejects.append(second is not None and second - best < margin * second)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejects, pa.bool_())], [*names, "lang_pred", "score", "rejected"])

    return docs.mapInArrow(run, plus(docs.schema, lang_pred="string", score="double", rejected="boolean"))


def training_rows(docs: DataFrame) -> DataFrame:
    """The learning fold: crc32 of the id modulo 4 is not 2."""
    return docs.where(fold("doc_id", 4) != 2)


def language_query(spark, sf_dir: str) -> DataFrame:
    """One row per document: fold, predicted language, score, and whether the margin was narrow."""
    model = train(training_rows(documents(spark, sf_dir, "doc_id", "text", "lang")))
    found = classify(documents(spark, sf_dir, "doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
