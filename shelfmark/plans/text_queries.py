"""Text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import terms as K, text as X
from shelfmark.plans import tables as B
from shelfmark.plans.registry import register

RX = "regexp_replace"


@register(
    "normalize_text",
    f"SELECT doc_id, md5({B.NORM_SQL}) AS digest, length({B.NORM_SQL}) AS chars FROM documents",
)
def normalize_text(spark, sf):
    t = B.spread(B.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    n = t.select("doc_id", X.normalize_text("text").alias("n"))
    return n.select("doc_id", F.md5("n").alias("digest"), F.length("n").cast("bigint").alias("chars"))


HTML_SQL = (
    f"replace(replace(replace(replace(replace({RX}({RX}({RX}({RX}(html, '(?is)<script.*?</script>', '', 'g'), "
    "'(?is)<style.*?</style>', '', 'g'), '(?i)<(br|/p|/div|/li|/tr|/h[1-6])\\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g'), "
    "'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&')"
)


@register("html_to_text", f"SELECT page_id, {HTML_SQL} AS text FROM pages")
def html_to_text(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", X.html_to_text("html").alias("text"))


@register(
    "page_slugs",
    "SELECT page_id, regexp_replace(substr(regexp_replace(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), "
    "'^-+|-+$', '', 'g'), 1, 60), '-+$', '') AS slug FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) "
    "AS title FROM pages)",
)
def page_slugs(spark, sf):
    p = B.read(spark, sf, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))
    return p.select("page_id", X.slugify("title").alias("slug"))


def _in(exts: list[str]) -> str:
    return "(" + ", ".join(f"'{e}'" for e in exts) + ")"


@register(
    "source_kinds",
    f"""SELECT page_id, CASE WHEN ext IN {_in(X.PDF_EXT)} THEN 'pdf' WHEN ext IN {_in(X.OFFICE_EXT)} THEN 'office'
  WHEN ext IN {_in(X.IMAGE_EXT)} THEN 'image' WHEN ext IN {_in(X.HTML_EXT + X.PROSE_EXT + X.DATA_EXT + X.CODE_EXT)} THEN 'text' END AS kind,
  CAST(ext IN {_in(X.MARKDOWN_EXT)} AS INT) AS markdown,
  CAST(ext IN {_in(X.PDF_EXT + X.OFFICE_EXT + X.IMAGE_EXT + X.PROSE_EXT + X.HTML_EXT)} AS INT) AS document
  FROM (SELECT page_id, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/\\\\](\\.[^./\\\\]*)$', 1)) AS ext FROM pages)""",
)
def source_kinds(spark, sf):
    p = B.read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return p.select(
        "page_id",
        X.source_kind("path").alias("kind"),
        X.is_markdown("path").cast("int").alias("markdown"),
        X.looks_like_document("path").cast("int").alias("document"),
    )


@register(
    "ocr_languages",
    """SELECT lang, count(*) AS docs, sum(CAST(native >= 200 AS BIGINT)) AS with_text,
  sum(CAST(native >= 200 AND cjk < 3 AS BIGINT)) AS without_cjk FROM (SELECT lang,
  length(regexp_replace(text, '\\s', '', 'g')) AS native,
  len(regexp_extract_all(text, '[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{ac00}-\\x{d7af}]')) AS cjk FROM documents) GROUP BY lang""",
    big=["with_text", "without_cjk"],
)
def ocr_languages(spark, sf):
    d = B.read(spark, sf, "documents")
    m = d.select("lang", X.native_chars("text").alias("native"), X.cjk_count("text").alias("cjk"))
    langs = X.ocr_languages(F.lit("eng+chi_sim"), F.lit("pdf"), F.col("native"), F.col("cjk"))
    return m.groupBy("lang").agg(
        F.count(F.lit(1)).alias("docs"),
        F.sum(X.has_text_layer("native").cast("bigint")).alias("with_text"),
        F.sum((langs == "eng").cast("bigint")).alias("without_cjk"),
    )


@register(
    "source_paths",
    """SELECT page_id, array_to_string(p[greatest(len(p) - 1, 1):], '/') AS last_two, p[len(p)] AS last_one FROM (
  SELECT page_id, list_filter(string_split_regex(url, '[\\\\/]+'), lambda x: x <> '') AS p FROM pages)""",
)
def source_paths(spark, sf):
    p = B.read(spark, sf, "pages")
    return p.select("page_id", X.source_path("url", 2).alias("last_two"), X.source_path("url", 1).alias("last_one"))


@register(
    "citations",
    f"""WITH {B.DOCS} SELECT doc_id, CASE WHEN pages IS NOT NULL THEN '[' || title || ' p.' || pages || ']'
  ELSE '[' || title || ']' END AS citation FROM docs""",
)
def citations(spark, sf):
    return B.docs(spark, sf).select("doc_id", X.citation("title", "pages").alias("citation"))


@register(
    "tags",
    """SELECT p_partkey, array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c <> a AND c <> b THEN c END],
  lambda x: x IS NOT NULL), ',') AS tags FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[\\s,\\[\\]]+', '-', 'g') AS a,
  regexp_replace(lower(p_brand), '[\\s,\\[\\]]+', '-', 'g') AS b, regexp_replace(lower(p_type), '[\\s,\\[\\]]+', '-', 'g') AS c FROM part)""",
)
def tags(spark, sf):
    p = B.read(spark, sf, "part")
    raw = F.array("p_name", F.concat(F.lit("  "), "p_brand"), "p_type", F.upper("p_name"), F.lit(" "))
    return p.select("p_partkey", F.array_join(X.normalize_tags(raw), ",").alias("tags"))


@register(
    "shelf_names",
    """SELECT c_custkey, trim(regexp_replace(c_mktsegment, '\\s+', ' ', 'g')) AS shelves, 1 AS n FROM customer""",
)
def shelf_names(spark, sf):
    c = B.read(spark, sf, "customer")
    raw = F.array(F.concat(F.lit('["'), "c_mktsegment", F.lit('"]')), F.lower("c_mktsegment"), F.lit("-"), F.lit(" , "))
    names = X.normalize_shelves(raw)
    return c.select("c_custkey", F.array_join(names, "|").alias("shelves"), F.size(names).alias("n"))


@register(
    "plain_snippets",
    """SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text,
  '(^|\\s)#{1,6}\\s+', '\\1', 'g'), '**', ''), '\\|?\\s*(?:-{3,}\\s*\\|\\s*)+', '| ', 'g'), '(?:\\s*\\|\\s*){2,}', ' | ', 'g'),
  '\\s+', ' ', 'g'))) AS digest FROM documents""",
)
def plain_snippets(spark, sf):
    d = B.spread(B.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.md5(X.plain_snippet("text")).alias("digest"))


@register(
    "text_windows",
    "SELECT doc_id, md5(substr(text, 1, 30000)) AS digest, CAST(length(text) > 30000 AS INT) AS truncated FROM documents",
)
def text_windows(spark, sf):
    w = B.read(spark, sf, "documents").select("doc_id", X.window_text("text").alias("w"))
    return w.select("doc_id", F.md5("w.text").alias("digest"), F.col("w.truncated").cast("int").alias("truncated"))


@register(
    "document_sizes",
    """SELECT doc_id, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR) || ' B' WHEN n < 10000 THEN printf('%.1f', round(n / 1000.0, 1)) || ' KB'
  ELSE CAST(CAST(floor(n / 1000.0 + 0.5) AS BIGINT) AS VARCHAR) || ' KB' END AS size, n + 2 AS columns
  FROM (SELECT doc_id, n_chars AS n FROM documents)""",
)
def document_sizes(spark, sf):
    d = B.read(spark, sf, "documents")
    width = X.display_width(X.pad_display(F.lit("文"), F.col("n_chars").cast("int") + 2)).cast("bigint")
    return d.select("doc_id", X.human_size("n_chars").alias("size"), width.alias("columns"))


@register(
    "questions_cleaned",
    """SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 500) AS question FROM conversations""",
)
def questions_cleaned(spark, sf):
    c = B.read(spark, sf, "conversations")
    return c.select("conv_id", "turn", X.clean_question("text").alias("question"))


PARTS_SQL = """part_words AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^A-Za-z0-9])([A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*)', 1)) AS part
  FROM documents), parts_found AS (SELECT DISTINCT doc_id, part FROM part_words WHERE length(part) >= 4
  AND regexp_matches(part, '[0-9]') AND regexp_matches(part, '[A-Za-z].*[A-Za-z]'))"""


@register("part_numbers", f"WITH {PARTS_SQL} SELECT doc_id, part FROM parts_found")
def part_numbers(spark, sf):
    d = B.spread(B.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return d.select("doc_id", F.explode(K.part_numbers("text")).alias("part"))


@register(
    "part_spellings",
    f"""WITH {PARTS_SQL}, p AS (SELECT DISTINCT part, regexp_replace(part, '[-_\\s]', '', 'g') AS bare FROM parts_found),
  cuts AS (SELECT part, bare, unnest(range(1, length(bare))) AS i FROM p)
  SELECT part, part AS spelling FROM p UNION SELECT part, bare FROM p
  UNION SELECT part, substr(bare, 1, i) || sep || substr(bare, i + 1) FROM cuts, (VALUES ('-'), (' ')) s(sep)
  WHERE regexp_matches(substr(bare, i, 1), '[0-9]') <> regexp_matches(substr(bare, i + 1, 1), '[0-9]')""",
)
def part_spellings(spark, sf):
    parts = part_numbers(spark, sf).select("part").distinct()
    return parts.select("part", F.explode(K.part_spellings("part")).alias("spelling"))


@register(
    "contained_terms",
    """WITH t(term, stem) AS (VALUES ('anble', 'anble'), ('ertions', 'ertion'), ('in', 'in'), ('ti', 'ti'), ('thouses', 'thous'), ('hest', 'hest'))
  SELECT term, count(*) AS docs FROM documents, t WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || stem ||
  CASE WHEN length(term) <= 2 THEN '([^a-z0-9]|$)' ELSE '' END) GROUP BY term""",
)
def contained_terms(spark, sf):
    words = ["anble", "ertions", "in", "ti", "thouses", "hest"]
    d = B.spread(B.read(spark, sf, "documents").select("doc_id", F.lower("text").alias("t")), "doc_id")
    hits = [F.when(K.contains_term(F.col("t"), F.lit(w)), F.lit(w)) for w in words]
    return d.select(F.explode(F.array_compact(F.array(*hits))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("docs")
    )


@register(
    "planned_terms",
    """WITH words AS (SELECT item_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT item_id,
  string_split_regex(lower(text), '[\\s,;:!?"''()\\[\\]<>]+') AS w FROM benchmark))
  SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY min(pos)) AS ord, CASE WHEN length(term) < 3 THEN 'short' ELSE 'phrase' END AS kind
  FROM words WHERE term <> '' AND term NOT IN (""" + ", ".join(f"'{w}'" for w in K.STOP_WORDS) + """) GROUP BY item_id, term""",
)
def planned_terms(spark, sf):
    b = B.read(spark, sf, "benchmark")
    t = b.select("item_id", F.posexplode(K.query_terms("text")).alias("i", "term"))
    kind = F.when(F.length("term") < 3, "short").otherwise("phrase")
    return t.select("item_id", "term", (F.col("i") + 1).cast("bigint").alias("ord"), kind.alias("kind"))


@register(
    "page_runs",
    """WITH d AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day FROM events),
  g AS (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day) AS island FROM d),
  r AS (SELECT user_id, min(day) AS lo, max(day) AS hi FROM g GROUP BY user_id, island)
  SELECT user_id, string_agg(CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS runs
  FROM r GROUP BY user_id""",
)
def page_runs(spark, sf):
    """Days with events as runs per user; distinct days come first, so a busy user is at most one row per day."""
    e = B.read(spark, sf, "events")
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    days = e.select("user_id", day.alias("day")).distinct()
    return days.groupBy("user_id").agg(X.page_runs(F.collect_list("day")).alias("runs"))
