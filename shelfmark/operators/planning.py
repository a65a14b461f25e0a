"""Searches planned by a language model, and answers with citations. The model is a callable the user injects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.text import clean_question, digit_mask, short_title, squeeze

# How much is asked, shown and passed on.
MAX_SEARCHES = 4
SEARCH_CHARS = 80
PER_SEARCH = 10
MAX_PASSAGES = 8
MAX_RESULTS = 20
PASSAGE_CHARS = 1500
CONTENTS_CHARS = 5000
CITED = r"\[(\d+(?:\s*[,，、]\s*\d+)*)\]"

Model = Callable[[str, str, int], str]


def parse_searches(reply: Column | str, question: Column | str) -> Column:
    """The question, then up to four tidy searches out of a model's reply (JSON somewhere in it)."""
    reply = F.col(reply) if isinstance(reply, str) else reply
    question = F.col(question) if isinstance(question, str) else question
    raw = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    listed = F.try_variant_get(F.try_parse_json(F.when(raw != "", raw)), "$.queries", "array<variant>")
    texts = F.filter(listed, lambda v: F.schema_of_variant(v) == "STRING")
    tidy = F.transform(texts, lambda v: F.substring(squeeze(F.try_variant_get(v, "$", "string")), 1, SEARCH_CHARS))
    kept = F.slice(F.filter(tidy, lambda q: q != ""), 1, MAX_SEARCHES)
    return F.array_distinct(F.concat(F.array(question), F.coalesce(kept, F.array().cast("array<string>"))))


def title_groups(titles: DataFrame) -> DataFrame:
    """Distinct titles that differ only in numbers as one line: mask, titles, first, line."""
    short = titles.select(short_title("title").alias("t")).distinct().withColumn("mask", digit_mask("t"))
    sums = short.groupBy("mask").agg(F.count(F.lit(1)).alias("titles"), F.min("t").alias("first"), F.max("t").alias("last"))
    few = (
        short.join(sums.filter("titles <= 3").select("mask"), "mask", "left_semi")
        .groupBy("mask")
        .agg(F.array_join(F.sort_array(F.collect_list("t")), "; ").alias("listed"))
    )
    many = F.concat(
        "mask", F.lit(" ×"), F.col("titles").cast("string"), F.lit(" ("), "first", F.lit(" … "), "last", F.lit(")")
    )
    return sums.join(few, "mask", "left").select("mask", "titles", "first", F.coalesce("listed", many).alias("line"))


def contents(titles: DataFrame, budget: int = CONTENTS_CHARS) -> DataFrame:
    """What a knowledge base holds, for a planner: the title lines, in order, that fit a budget of characters.

    Every line takes at least three characters, so only the first lines can fit and be looked at.
    """
    lines = title_groups(titles).orderBy("first").limit(budget // 3 + 1)
    order = Window.orderBy("first")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.length("line") + 2).over(upto)
    # The first line pays for a divider it does not get; later ones are charged as they are joined.
    over = F.when(F.row_number().over(order) == 1, used).otherwise(used - 2) > budget
    marked = lines.select("mask", "titles", "first", "line", over.alias("_over"), F.row_number().over(order).alias("pos"))
    stopped = marked.withColumn("_stop", F.max("_over").over(upto.orderBy("pos")))
    return stopped.filter(~F.col("_stop")).select(F.col("pos").cast("bigint").alias("pos"), "mask", "titles", "line")


def passages(hits: DataFrame, chunks: DataFrame, unreviewed: DataFrame, limit: int = MAX_PASSAGES) -> DataFrame:
    """Numbered passages for an answer: question_id, n, doc_id, title, page, heading, unreviewed, text.

    ``hits``: question_id, pos, chunk_id. ``unreviewed``: doc_id.
    """
    top = hits.filter(F.col("pos") <= limit).select("question_id", F.col("pos").alias("n"), "chunk_id")
    flags = unreviewed.select("doc_id").distinct().withColumn("_u", F.lit(True))
    texts = chunks.select("chunk_id", "doc_id", "title", "page", "heading", F.substring("content", 1, PASSAGE_CHARS).alias("text"))
    return (
        top.join(texts, "chunk_id")
        .join(flags, "doc_id", "left")
        .select("question_id", "n", "doc_id", "title", "page", "heading", F.coalesce("_u", F.lit(False)).alias("unreviewed"), "text")
    )


def cited_numbers(answer: Column | str, count: Column | int) -> Column:
    """Passage numbers an answer cites, in order of first use, real passages only."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    count = F.lit(count) if isinstance(count, int) else count
    groups = F.regexp_extract_all(answer, F.lit(CITED), F.lit(1))
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*[,，、]\s*")))
    values = F.transform(numbers, lambda n: n.try_cast("int"))
    return F.array_distinct(F.filter(values, lambda n: n.isNotNull() & (n >= 1) & (n <= count)))


def renumber(answer: Column | str, count: Column | int) -> Column:
    """The answer with its citations numbered by first use; numbers of no passage are dropped."""
    answer = F.col(answer) if isinstance(answer, str) else answer
    used = cited_numbers(answer, count)
    text = F.trim(answer)
    # The text between citations, and each citation's new numbers, take turns.
    between = F.split(text, CITED)
    groups = F.regexp_extract_all(text, F.lit(CITED), F.lit(1))

    def marks(group: Column) -> Column:
        new = F.transform(F.split(group, r"\s*[,，、]\s*"), lambda n: F.array_position(used, n.try_cast("int")))
        shown = F.transform(F.filter(new, lambda p: p > 0), lambda p: F.concat(F.lit("["), p.cast("string"), F.lit("]")))
        return F.array_join(shown, "")

    tail = F.concat(F.transform(groups, marks), F.array(F.lit("")))
    return F.array_join(F.zip_with(between, tail, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def plan_searches(model: Model, prompt: str, question: str, overview: str) -> str:
    """Ask the model for searches; its reply goes to ``parse_searches``."""
    return model(prompt, f"Knowledge base:\n{overview}\n\nQuestion: {question}", 1000)


def answer_question(model: Model, prompt: str, question: str, rows: list, missing: list[str]) -> str:
    """Ask the model to answer from at most eight numbered passages (rows of ``passages``, by n)."""
    if not rows:
        return ""
    parts = []
    for r in rows:
        where = (f" p.{r['page']}" if r["page"] else "") + (f" § {r['heading']}" if r["heading"] else "")
        parts.append(f"[{r['n']}] {r['title']}{where}{' (unreviewed note)' if r['unreviewed'] else ''}\n{r['text']}")
    warning = f"\n\nNo passage mentions {', '.join(missing)}: say so, and give no other item's values." if missing else ""
    return model(prompt, f"Question: {question}{warning}\n\nPassages:\n\n" + "\n\n".join(parts), 1500)


__all__ = [
    "answer_question", "cited_numbers", "clean_question", "contents", "parse_searches", "passages",
    "plan_searches", "renumber", "title_groups",
]
