"""Query terms: planning, matching, scoring and snippets as Column expressions.

One implementation serves a single query (a one-row frame) and a whole table of questions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shelfmark.functions.text import _c, squeeze

# Words that carry no topic.
STOP_WORDS = (
    "a an and are as at be but by can could do does did for from had has have how i if in into is it its "
    "me my no not of on or our should so that the their them then there these they this to was we were "
    "what when where which who why will with would you your"
).split()
# Chinese question words, and the characters a query is split on.
CJK_QUESTION = "怎么样|怎么|怎样|如何|什么|为什么|为何|哪些|哪个|是否|能不能|可不能|吗|呢"
SEPARATORS = r"""[\s\x{00a0}\x{3000},，。、;；:：!！?？"'“”‘’()（）\[\]【】<>《》]+"""
CJK = r"[㐀-鿿豈-﫿]"

GRAM = 3
SNIPPET_WIDTH = 360
EMPTY = "array<string>"


def is_cjk(term: Column) -> Column:
    return term.rlike(CJK)


def grams(term: Column, n: int = GRAM) -> Column:
    """Overlapping n-grams of a short term, by code point."""
    steps = F.sequence(F.lit(1), F.length(term) - (n - 1))
    pieces = F.transform(steps, lambda i: F.substring(term, i, F.lit(n)))
    return F.when(F.length(term) >= n, pieces).otherwise(F.array().cast(EMPTY))


def text_grams(text: Column, n: int = GRAM) -> Column:
    """Distinct n-grams of a long text in one linear pass."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def query_terms(query: Column | str) -> Column:
    """Distinct terms in order, without stop words unless nothing else is left."""
    low = F.regexp_replace(F.lower(_c(query)), CJK_QUESTION, " ")
    words = F.array_distinct(F.filter(F.split(low, SEPARATORS), lambda t: t != ""))
    topical = F.filter(words, lambda t: ~t.isin(STOP_WORDS) & ~(is_cjk(t) & (F.length(t) == 1)))
    return F.when(F.size(topical) > 0, topical).otherwise(words)


def phrases(terms: Column) -> Column:
    """What the substring index is asked for: terms of three characters up, long CJK terms also by trigram."""
    long = F.filter(terms, lambda t: F.length(t) >= GRAM)
    parts = F.transform(
        long,
        lambda t: F.when(is_cjk(t) & (F.length(t) > 4), F.concat(F.array(t), grams(t))).otherwise(F.array(t)),
    )
    return F.array_distinct(F.flatten(parts))


def short_terms(terms: Column) -> Column:
    return F.filter(terms, lambda t: F.length(t) < GRAM)


def plan_query(query: Column | str) -> Column:
    """A query as struct(terms, phrases, short)."""
    planned = F.transform(
        F.array(query_terms(query)),
        lambda t: F.struct(t.alias("terms"), phrases(t).alias("phrases"), short_terms(t).alias("short")),
    )
    return F.element_at(planned, 1)


def quoted(text: Column) -> Column:
    """Text as a literal inside a regular expression."""
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def contains_term(text: Column, term: Column) -> Column:
    """Whether lower-case text holds a term.

    English matches at a word start (one or two letters: the whole word), plural endings optional;
    everything else matches as a substring. A plural's stem is a prefix of it, so the shortest
    stem alone decides.
    """
    stem = (
        F.when(term.rlike("^[a-z]{4,}es$"), F.substring(term, F.lit(1), F.length(term) - 2))
        .when(term.rlike("^[a-z]{4,}s$"), F.substring(term, F.lit(1), F.length(term) - 1))
        .otherwise(term)
    )
    end = F.when(F.length(term) <= 2, "(?![a-z0-9])").otherwise("")
    plain = ~term.rlike("^[a-z0-9]") | is_cjk(term)
    return F.when(plain, F.contains(text, term)).otherwise(
        F.rlike(text, F.concat(F.lit("(?<![a-z0-9])"), quoted(stem), end))
    )


def term_score(text: Column, term: Column) -> Column:
    """1 for a term present, the share of trigrams present for a CJK term, else 0."""
    pieces = grams(term)
    found = F.size(F.filter(pieces, lambda g: F.contains(text, g)))
    share = F.when(is_cjk(term) & (F.size(pieces) > 0), found / F.size(pieces)).otherwise(0.0)
    return F.when(contains_term(text, term), 1.0).otherwise(share)


def term_scores(text: Column, terms: Column) -> Column:
    return F.transform(terms, lambda t: term_score(text, t))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def coverage(scores: Column) -> Column:
    """Mean of the per-term scores."""
    return F.when(F.size(scores) == 0, 0.0).otherwise(total(scores) / F.greatest(F.size(scores), F.lit(1)))


def snippet(content: Column, terms: Column, width: int = SNIPPET_WIDTH) -> Column:
    """About ``width`` characters around the first place any term (or CJK trigram) occurs."""
    low = F.lower(content)
    more = F.flatten(F.transform(terms, lambda t: F.when(is_cjk(t), grams(t)).otherwise(F.array().cast(EMPTY))))
    places = F.filter(F.transform(F.concat(terms, more), lambda n: F.position(n, low)), lambda p: p > 0)
    at = F.coalesce(F.array_min(places), F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - width // 3)
    body = squeeze(F.substring(content, start + 1, F.lit(width)))
    return F.concat(
        F.when(start > 0, "…").otherwise(""),
        body,
        F.when(start + width < F.length(content), "…").otherwise(""),
    )


def lead(content: Column, width: int = SNIPPET_WIDTH) -> Column:
    """The start of a chunk, for hits found by meaning."""
    text = squeeze(content)
    return F.concat(F.substring(text, 1, width), F.when(F.length(text) > width, "…").otherwise(""))


def part_numbers(text: Column | str) -> Column:
    """Part numbers in a text: a letter first, two letters and a digit, four characters or more."""
    pattern = r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*"
    found = F.regexp_extract_all(_c(text), F.lit(pattern), F.lit(0))
    return F.array_distinct(
        F.filter(found, lambda t: (F.length(t) >= 4) & t.rlike("[0-9]") & t.rlike("[A-Za-z].*[A-Za-z]"))
    )


def part_spellings(part: Column | str) -> Column:
    """How a part number may be written: as typed, bare, or split once at a letter-digit boundary."""
    part = _c(part)
    bare = F.regexp_replace(part, r"[-_\s]", "")

    def cut(i: Column) -> Column:
        left, right = F.substring(bare, F.lit(1), i), F.substring(bare, i + 1, F.length(bare))
        turns = F.substring(bare, i, F.lit(1)).rlike("[0-9]") != F.substring(bare, i + 1, F.lit(1)).rlike("[0-9]")
        both = F.array(F.concat(left, F.lit("-"), right), F.concat(left, F.lit(" "), right))
        return F.when(turns, both).otherwise(F.array().cast(EMPTY))

    cuts = F.when(
        F.length(bare) > 1, F.flatten(F.transform(F.sequence(F.lit(1), F.length(bare) - 1), cut))
    ).otherwise(F.array().cast(EMPTY))
    spellings = F.array_distinct(F.concat(F.array(part, bare), cuts))
    return F.filter(spellings, lambda s: F.length(s) >= GRAM)
