"""Quality rules with host verdicts, in DataFrame functions alone.

Each document is measured against a few rules. Their failures are summed up by host; a beta prior fitted to all hosts'
failure rates draws the rates of small hosts towards the whole, and hosts whose drawn-in rate is too high lose all their
documents. Verdicts are joined back to the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.session import checkpoint

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    """Limits. The first two are the base rules; percentages are of words, of letters or of lines."""

    least_words: int = 10
    most_repeated: int = 20  # % of words in repeated windows
    most_symbols: int = 25  # symbols per 100 words
    most_dup_lines: int = 50  # % of lines that repeat an earlier one
    most_capitals: int = 50  # % of characters in words
    least_mean, most_mean = 2, 15  # characters a word
    host_limit: float = 0.5  # drawn-in failure rate from which a host is blocked


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS), "")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read. Null and empty texts have no words and count 0 throughout.

    Every step stays a column expression over one row: there is no shuffle, and a text of any length costs time in
    proportion to its words (and a sort of its windows, if any repeat).
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("__quality_text", whole)
    df = df.withColumn("__quality_words", _words(F.col("__quality_text"))).withColumn("n_words", F.size("__quality_words").cast("long"))
    df = df.withColumn("__quality_hashed", F.transform("__quality_words", lambda w: F.xxhash64(w)))
    ahead = lambda i, k: F.get(F.col("__quality_hashed"), i + F.lit(k))
    df = df.withColumn(
        "__quality_windows",
        F.transform(
            F.slice("__quality_hashed", 1, F.greatest(F.size("__quality_hashed") - (WINDOW - 1), F.lit(0))),
            lambda w, i: F.xxhash64(w, *[ahead(i, k) for k in range(1, WINDOW)]),
        ),
    )
    placed = F.sort_array(F.transform("__quality_windows", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))
    repeats = F.size(F.array_distinct("__quality_windows")) < F.size("__quality_windows")
    df = df.withColumn("__quality_placed", F.when(repeats, placed).otherwise(F.array().cast("array<struct<h:bigint,at:int>>")))
    same = lambda x, i, k: F.coalesce(F.get(F.col("__quality_placed"), i + F.lit(k))["h"] == x["h"], F.lit(False))
    df = df.withColumn("__quality_at", F.sort_array(F.transform(F.filter("__quality_placed", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x["at"])))
    df = df.withColumn("__quality_lines", F.filter(F.split("__quality_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    covered = F.transform("__quality_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__quality_at"), i + F.lit(1)) - x, F.lit(WINDOW))))
    keep = [c for c in docs.columns if c not in MEASURES]
    return df.select(
        *keep,
        "n_words",
        F.length(F.array_join("__quality_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__quality_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("__quality_lines") - F.size(F.array_distinct("__quality_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("__quality_lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("__quality_text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def base_failed(rules: Rules) -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))


def soft_failed(rules: Rules) -> Column:
    """Any other rule: symbols, repeated lines, capitals, odd word lengths."""
    return (
        (100 * F.col("n_symbols") > rules.most_symbols * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > rules.most_dup_lines * F.col("n_lines"))
        | (100 * F.col("n_capitals") > rules.most_capitals * F.col("word_chars"))
        | (F.col("word_chars") < rules.least_mean * F.col("n_words"))
        | (F.col("word_chars") > rules.most_mean * F.col("n_words"))
    )


def host_verdicts(judged: DataFrame, host: str, limit: float) -> DataFrame:
    """One row per host: documents, failures, the drawn-in failure rate, and whether it exceeds ``limit``.

    The prior beta(a, b) is fitted by moments over hosts: its mean m is that of all documents, its spread what the
    variance of the hosts' rates leaves after their sampling noise; a + b stays within 1 and 10,000. Only these two
    numbers come to the driver. A null host is a host of its own.
    """
    hosts = judged.groupBy(host).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("failed").cast("long")).alias("failures"))
    rate = F.col("failures") / F.col("docs")
    first = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("hosts"), F.sum(1 / F.col("docs")).alias("inv"), F.sum(rate).alias("r"), F.sum(rate * rate).alias("rr")).first()
    mean, size = 0.5, 1.0
    if first["n"]:
        mean = first["f"] / first["n"]
        spread = first["rr"] / first["hosts"] - (first["r"] / first["hosts"]) ** 2 - mean * (1 - mean) * first["inv"] / first["hosts"]
        size = min(10_000.0, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 10_000.0
    drawn = (F.col("failures") + F.lit(mean * size)) / (F.col("docs") + F.lit(size))
    return hosts.select(host, "docs", "failures", drawn.alias("rate"), (drawn > limit).alias("blocked"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:
    """Add the measures, ``base_failed``, ``failed`` (any rule), ``host_rate``, ``host_blocked`` and ``kept``.

    ``kept`` is false for a document that fails a rule itself, and for all documents of a blocked host. Rows are kept
    and repeated rows judged alike; columns of the added names are replaced; an empty table gives an empty one. The
    measured rows are written to the shared folder once, without the text unless ``with_text``; hosts are joined by name, and a host with
    a large share of the rows is pre-aggregated in each task and only meets one row.
    """
    added = {*MEASURES, "base_failed", "failed", "host_rate", "host_blocked", "kept"}
    keep = [c for c in docs.columns if c not in added]
    measured = measures(docs.select(*keep), text)
    measured = measured.withColumn("base_failed", base_failed(rules)).withColumn("failed", F.col("base_failed") | soft_failed(rules))
    measured = checkpoint(measured if with_text else measured.drop(text))
    hosts = host_verdicts(measured, host, rules.host_limit).select(F.col(host).alias("__quality_host"), F.col("rate").alias("host_rate"), F.col("blocked").alias("host_blocked"))
    joined = measured.join(hosts, measured[host].eqNullSafe(hosts["__quality_host"]), "left").drop("__quality_host")
    return joined.withColumn("kept", ~F.col("failed") & ~F.col("host_blocked"))


def quality_query(docs: DataFrame) -> DataFrame:
    """One row per document: its base measures, whether the base rules fail, and the verdict."""
    judged = judge(docs.select("doc_id", "text", "source"), with_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_blocked")
