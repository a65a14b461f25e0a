"""The given tables read as a knowledge base, in Spark and as SQL common table expressions.

documents: documents and notes (English texts are documents, the others notes); their source is the
folder, and the label rows say which shelves and marks they have.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfmark.functions.text import normalize_text
from shelfmark.operators import index
from shelfmark.operators.chunking import chunk_texts, with_chunk_id
from shelfmark.session import kept, shared_folder, spread

# Queries asked of the document texts: words of the texts, a plural, short terms, stop words.
SEARCHES = [(1, "the anble edtion"), (2, "thble"), (3, "in ou"), (4, "inble, ertions of ering"), (5, "what is nthe ti")]


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _title() -> Column:
    return F.concat("source", F.lit("/"), "lang", F.lit("-"), F.col("doc_id").cast("string"), F.lit(".md"))


_repeated: dict[tuple[str, str], bool] = {}


def repeated_ids(spark: SparkSession, sf: str) -> bool:
    """Whether documents share an id; found once per application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _repeated:
        twice = read(spark, sf, "documents").where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        _repeated[key] = bool(twice.limit(1).collect())
    return _repeated[key]


def docs(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Documents, with further columns of the table."""
    d = read(spark, sf, "documents")
    wiki = F.col("lang") != "en"
    word = F.lower(F.regexp_extract("text", r"\p{L}+", 0))
    return d.select(
        "doc_id",
        _title().alias("title"),
        F.when(wiki, "wiki").otherwise("docs").alias("collection"),
        F.when(wiki, "note").otherwise("text").alias("kind"),
        F.concat(F.lit("/kb/"), "source", F.lit("/"), "lang", F.lit("/"), word, F.lit(".md")).alias("source"),
        F.when(~wiki, F.ceil(F.col("n_chars") / 1500)).alias("pages"),
        F.col("n_chars").alias("chars"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("added_at"),
        *more,
    )


DOCS = """docs AS (SELECT doc_id, source || '/' || lang || '-' || doc_id || '.md' AS title,
  CASE WHEN lang <> 'en' THEN 'wiki' ELSE 'docs' END AS collection,
  CASE WHEN lang <> 'en' THEN 'note' ELSE 'text' END AS kind,
  '/kb/' || source || '/' || lang || '/' || lower(regexp_extract(text, '\\p{L}+')) || '.md' AS source,
  CASE WHEN lang = 'en' THEN CAST(ceil(n_chars / 1500.0) AS BIGINT) END AS pages, n_chars AS chars,
  TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS added_at FROM documents)"""


def shelves(spark: SparkSession, sf: str) -> DataFrame:
    """Good documents stand on a shelf named after their source, toxic ones also on one of their own."""
    labels = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    good = labels.filter("quality = 1").select("doc_id", F.initcap("source").alias("shelf"))
    toxic = labels.filter("toxic = 1").select("doc_id", F.lit("Flagged").alias("shelf"))
    return good.unionByName(toxic)


SHELVES = """shelves AS (SELECT doc_id, upper(substr(source, 1, 1)) || substr(source, 2) AS shelf
  FROM labels JOIN documents USING (doc_id) WHERE quality = 1
  UNION ALL SELECT doc_id, 'Flagged' FROM labels JOIN documents USING (doc_id) WHERE toxic = 1)"""


def ocr_pending(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "labels").filter("quality = 0").select("doc_id").distinct()


PENDING = "pending AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0)"


def make_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with the titles of their documents, which go with the texts; those of repeated ids are joined, each with each."""
    titled = read(spark, sf, "documents").select("doc_id", "text", _title().alias("title")).where("doc_id is not null")
    clean = spread(titled, "doc_id").select("doc_id", normalize_text("text").alias("text"), "title")
    if repeated_ids(spark, sf):
        made = with_chunk_id(chunk_texts(clean)).join(titled.select("doc_id", "title"), "doc_id")
    else:
        made = with_chunk_id(chunk_texts(clean, keep=("title",)))
    return made.select("chunk_id", "doc_id", "page", "title", "heading", "content")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk table: built once per application, read by every search."""
    return kept(lambda: make_chunks(spark, sf), spark, f"chunks:{sf}")


_indexes: dict[tuple[str, str], index.SearchIndex] = {}


def search_index(spark: SparkSession, sf: str) -> index.SearchIndex:
    """The index of the chunk table: built once per application, read by every search."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _indexes:
        _indexes[key] = index.build(chunks(spark, sf), f"{shared_folder(spark)}/index-{uuid.uuid4().hex}")
    return _indexes[key]


BLANK_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288) || chr(65279)"
NORM_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), "
    "'\\\\([\\\\`*_{}\\[\\]()#+\\-.!|<>~])', '\\1', 'g'), '[ \\t]+\\n', chr(10), 'g'), "
    f"'\\n{{3,}}', chr(10) || chr(10), 'g'), {BLANK_SQL})"
)

# Blocks to pieces of at most 1200 characters, then pieces to chunks: the same two greedy steps.
CHUNKS = f"""norm AS (SELECT doc_id, {NORM_SQL} AS text FROM documents),
blocks AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\\n{{2,}}'),
    lambda b: trim(b, {BLANK_SQL})), lambda b: b <> '') AS blocks FROM norm),
cut AS (SELECT doc_id, flatten(list_transform(blocks, lambda b: CASE WHEN length(b) <= 1200 THEN [b] ELSE
  list_filter(list_append(list_reduce(flatten(list_transform(string_split(b, chr(10)), lambda l: CASE WHEN length(l) > 1200
      THEN list_transform(range(0, length(l), 1200), lambda i: {{'out': []::VARCHAR[], 'cur': '', 't': substr(l, CAST(i AS BIGINT) + 1, 1200), 'hard': true}})
      ELSE [{{'out': []::VARCHAR[], 'cur': '', 't': l, 'hard': false}}] END)),
    lambda a, x: CASE
      WHEN x.hard THEN {{'out': list_concat(a.out, [a.cur, x.t]), 'cur': '', 't': '', 'hard': false}}
      WHEN a.cur <> '' AND length(a.cur) + length(x.t) + 1 > 1200 THEN {{'out': list_append(a.out, a.cur), 'cur': x.t, 't': '', 'hard': false}}
      WHEN a.cur <> '' THEN {{'out': a.out, 'cur': a.cur || chr(10) || x.t, 't': '', 'hard': false}}
      ELSE {{'out': a.out, 'cur': x.t, 't': '', 'hard': false}} END,
    {{'out': []::VARCHAR[], 'cur': '', 't': '', 'hard': false}}).out,
   list_reduce(flatten(list_transform(string_split(b, chr(10)), lambda l: CASE WHEN length(l) > 1200
      THEN list_transform(range(0, length(l), 1200), lambda i: {{'out': []::VARCHAR[], 'cur': '', 't': substr(l, CAST(i AS BIGINT) + 1, 1200), 'hard': true}})
      ELSE [{{'out': []::VARCHAR[], 'cur': '', 't': l, 'hard': false}}] END)),
    lambda a, x: CASE
      WHEN x.hard THEN {{'out': a.out, 'cur': '', 't': '', 'hard': false}}
      WHEN a.cur <> '' AND length(a.cur) + length(x.t) + 1 > 1200 THEN {{'out': a.out, 'cur': x.t, 't': '', 'hard': false}}
      WHEN a.cur <> '' THEN {{'out': a.out, 'cur': a.cur || chr(10) || x.t, 't': '', 'hard': false}}
      ELSE {{'out': a.out, 'cur': x.t, 't': '', 'hard': false}} END,
    {{'out': []::VARCHAR[], 'cur': '', 't': '', 'hard': false}}).cur), lambda p: p <> '') END)) AS pieces FROM blocks),
packed AS (SELECT doc_id, list_reduce(list_transform(pieces, lambda p: {{'out': []::VARCHAR[], 'cur': '', 'size': 0, 't': p}}),
    lambda a, x: CASE
      WHEN a.size > 0 AND a.size + length(x.t) > 1200 THEN {{'out': list_append(a.out, a.cur), 'cur': x.t, 'size': length(x.t) + 2, 't': ''}}
      WHEN a.size > 0 THEN {{'out': a.out, 'cur': a.cur || chr(10) || chr(10) || x.t, 'size': a.size + length(x.t) + 2, 't': ''}}
      ELSE {{'out': a.out, 'cur': x.t, 'size': length(x.t) + 2, 't': ''}} END,
    {{'out': []::VARCHAR[], 'cur': '', 'size': 0, 't': ''}}) AS p FROM cut),
parts AS (SELECT doc_id, list_filter(list_transform(list_append(p.out, p.cur), lambda c: trim(c, {BLANK_SQL})),
    lambda c: c <> '') AS c FROM packed),
chunks AS (SELECT doc_id * 16777216 + i - 1 AS chunk_id, doc_id,
    source || '/' || lang || '-' || doc_id || '.md' AS title, '' AS heading, content
  FROM (SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) AS i FROM parts) JOIN documents USING (doc_id))"""


def values(rows: list[tuple], columns: str) -> str:
    """A VALUES list with quoted strings."""

    def cell(v) -> str:
        return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return f"{columns} AS (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + ")"


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Document vectors; each stands for its document's first chunk."""
    e = read(spark, sf, "embeddings")
    return e.select(
        (F.col("vec_id") * (1 << 24)).alias("chunk_id"),
        F.col("vec_id").alias("doc_id"),
        F.lit("local:toy#mean").alias("model"),
        F.col("embedding").alias("vec"),
        "label",
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """One query vector per label: the mean of its vectors."""
    parts = read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec")
    )


CENTROIDS = """centroids AS (SELECT CAST(label AS BIGINT) AS query_id, list(CAST(x AS FLOAT) ORDER BY i) AS vec FROM (
  SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings) GROUP BY label, i) GROUP BY label)"""
