"""Notes made of the documents, paged documents made of order lines, evaluation and dialogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.library import KnowledgeBase, Library
from shelfmark.operators import chunking, dialogue, evaluation as E, fusion, keyword, notes as N, planning, semantic, similarity
from shelfmark.plans import tables as B
from shelfmark.plans.registry import register
from shelfmark.plans.search_queries import search_sql
from shelfmark.session import checkpoint

# Every document as a note file: front matter by its labels, then links and citations of others.
# Ids of other documents are cut out of the note's own, so some exist and some do not.
def raw_notes(spark, sf):
    if B.repeated_ids(spark, sf):  # each with each
        d = B.docs(spark, sf).join(B.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    else:
        d = B.docs(spark, sf, "text").where("doc_id is not null")
    d = d.join(B.read(spark, sf, "labels"), "doc_id", "left")
    i = F.col("doc_id")
    s = lambda c: c.cast("string")
    raw = F.concat(
        F.lit('---\ntitle: "Say \\"'), "title", F.lit('\\""\n'),
        F.when(F.col("quality") == 1, F.concat(F.lit("tags: [good, '"), F.col("lang_tag"), F.lit("']\n"))).otherwise(""),
        F.lit("created: 2024-01-01\nupdated: "), F.date_format(F.col("added_at"), "yyyy-MM-dd"), F.lit("\n"),
        F.when(F.col("toxic") == 1, "shelves: [Lab, lab, Bench]\nreview: pending\n").otherwise(""),
        F.lit("---\n\nSee [[Note "), s(F.floor(i / 2)), F.lit("|other]] and [[n"), s(i * 2), F.lit(".md#top]].\r\nFrom [doc "),
        s(F.floor(i / 3)), F.lit(".pdf p.3-4], [doc "), s(i * 3), F.lit(".pdf] and [main.c]; [x] done, [site](http://a).\n\n"), "text", F.lit("\n"),
    )
    return d.withColumn("lang_tag", F.regexp_extract("title", "/([a-z]+)-", 1)).select(
        "doc_id", "added_at", F.when(F.col("collection") == "wiki", "project").otherwise("global").alias("scope"), raw.alias("raw")
    )


RAW = f"""raw AS (SELECT doc_id, added_at, quality, toxic, lang, title, text, CASE WHEN collection = 'wiki' THEN 'project' ELSE 'global' END AS scope,
  '---' || chr(10) || 'title: "Say \\"' || title || '\\""' || chr(10) || CASE WHEN quality = 1 THEN 'tags: [good, ''' || lang || ''']' || chr(10) ELSE '' END
  || 'created: 2024-01-01' || chr(10) || 'updated: ' || strftime(added_at, '%Y-%m-%d') || chr(10)
  || CASE WHEN toxic = 1 THEN 'shelves: [Lab, lab, Bench]' || chr(10) || 'review: pending' || chr(10) ELSE '' END AS front,
  'See [[Note ' || (doc_id // 2) || '|other]] and [[n' || doc_id * 2 || '.md#top]].' || chr(10) || 'From [doc ' || (doc_id // 3)
  || '.pdf p.3-4], [doc ' || doc_id * 3 || '.pdf] and [main.c]; [x] done, [site](http://a).' || chr(10) || chr(10)
  || replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10) AS body
  FROM docs JOIN documents USING (doc_id) LEFT JOIN labels USING (doc_id))"""
NOTES_SQL = f"WITH {B.DOCS}, {RAW}"


def parsed(spark, sf):
    r = raw_notes(spark, sf)
    return r.select("doc_id", "scope", "added_at", "raw", N.parse_note("raw", F.lit("untitled")).alias("n")).select("doc_id", "scope", "added_at", "raw", "n.*", "n")


@register(
    "parsed_notes",
    NOTES_SQL + f""" SELECT doc_id, 'Say "' || title || '"' AS title, CASE WHEN quality = 1 THEN 'good,' || lang ELSE '' END AS tags,
  strftime(added_at, '%Y-%m-%d') AS updated, CASE WHEN toxic = 1 THEN 'Lab|Bench' ELSE '' END AS shelves,
  CASE WHEN toxic = 1 THEN 'pending' END AS review, md5(trim(body, {B.BLANK_SQL})) AS body FROM raw""",
)
def parsed_notes(spark, sf):
    return parsed(spark, sf).select(
        "doc_id", "title", F.array_join("tags", ",").alias("tags"), "updated", F.array_join("shelves", "|").alias("shelves"), "review", F.md5("body").alias("body")
    )


@register(
    "rendered_notes",
    NOTES_SQL + f""" SELECT doc_id, md5('---' || chr(10) || 'title: "Say \\"' || title || '\\""' || chr(10) || CASE WHEN quality = 1 THEN 'tags: [good, ' || lang || ']' || chr(10) ELSE '' END
  || 'created: 2024-01-01' || chr(10) || 'updated: ' || strftime(added_at, '%Y-%m-%d') || chr(10)
  || CASE WHEN toxic = 1 THEN 'shelves: [Lab, Bench]' || chr(10) || 'review: pending' || chr(10) ELSE '' END || '---' || chr(10) || chr(10)
  || '# Say "' || title || '"' || chr(10) || chr(10) || trim(body, {B.BLANK_SQL}) || chr(10)) AS digest FROM raw""",
)
def rendered_notes(spark, sf):
    return parsed(spark, sf).select("doc_id", F.md5(N.render_note("n")).alias("digest"))


@register(
    "edited_front_matter",
    NOTES_SQL + """ SELECT doc_id, md5(replace(front, 'review: pending' || chr(10), '') || '---' || chr(10) || chr(10) || body) AS approved,
  md5(replace(front, 'review: pending' || chr(10), '') || 'review: pending' || chr(10) || '---' || chr(10) || chr(10) || body) AS doubted,
  md5(regexp_replace(front, 'updated: [0-9-]+', 'updated: 2030-01-01') || '---' || chr(10) || chr(10) || body) AS checked,
  md5(replace(front, 'shelves: [Lab, lab, Bench]' || chr(10), '') || 'shelves: [One, Two]' || chr(10) || '---' || chr(10) || chr(10) || body) AS shelved FROM raw""",
)
def edited_front_matter(spark, sf):
    return raw_notes(spark, sf).select(
        "doc_id",
        F.md5(N.without_review("raw")).alias("approved"),
        F.md5(N.with_review("raw")).alias("doubted"),
        F.md5(N.with_updated("raw", F.lit("2030-01-01"))).alias("checked"),
        F.md5(N.with_shelves("raw", F.array(F.lit("One"), F.lit("Two")))).alias("shelved"),
    )


@register(
    "note_index_texts",
    NOTES_SQL + f""" SELECT doc_id, md5(trim(body, {B.BLANK_SQL}) || CASE WHEN quality = 1 THEN chr(10) || chr(10) || '#good #' || lang ELSE '' END) AS digest FROM raw""",
)
def note_index_texts(spark, sf):
    return parsed(spark, sf).select("doc_id", F.md5(N.index_text(F.col("body"), F.col("tags"))).alias("digest"))


@register(
    "appended_sections",
    "SELECT conv_id, turn, md5('## 2024-05-01' || chr(10) || chr(10) || text) AS plain, md5('## ' || role || chr(10) || chr(10) || '_2024-05-01_' || chr(10) || chr(10) || trim(text)) AS headed FROM conversations",
)
def appended_sections(spark, sf):
    c = B.read(spark, sf, "conversations")
    day = F.lit("2024-05-01")
    headed = F.concat(F.lit("### "), "role", F.lit("\n\n"), "text")
    return c.select("conv_id", "turn", F.md5(N.append_section("text", day)).alias("plain"), F.md5(N.append_section(headed, day)).alias("headed"))


@register(
    "note_citations",
    NOTES_SQL + """ SELECT doc_id, 'doc ' || (doc_id // 3) || '.pdf' AS title, 3 AS page FROM raw UNION ALL
  SELECT doc_id, 'doc ' || doc_id * 3 || '.pdf', NULL FROM raw UNION ALL SELECT doc_id, 'main.c', NULL FROM raw""",
)
def note_citations(spark, sf):
    r = raw_notes(spark, sf)
    return r.select("doc_id", F.explode(N.note_citations(N.note_body("raw"))).alias("c")).select("doc_id", "c.title", "c.page")


def _named(spark, sf):
    """Notes as link targets: a path n<id>.md and a title "Note <id>"."""
    i = F.col("doc_id").cast("string")
    return raw_notes(spark, sf).select(
        "doc_id", "scope", "added_at", F.concat(F.lit("wiki/sub/N"), i, F.lit(".md")).alias("path"), F.concat(F.lit("NOTE "), i).alias("title")
    )


def _links(spark, sf):
    body = N.note_body("raw")
    return raw_notes(spark, sf).select(F.col("doc_id").alias("note_id"), "scope", F.explode(N.wiki_links(body)).alias("target"))


@register(
    "resolved_links",
    NOTES_SQL + """, l AS (SELECT doc_id AS note_id, scope, 'Note ' || (doc_id // 2) AS target, doc_id // 2 AS d FROM raw
  UNION ALL SELECT doc_id, scope, 'n' || doc_id * 2 || '.md', doc_id * 2 FROM raw)
  SELECT note_id, l.scope, target, r.doc_id AS to_id, r.scope AS to_scope FROM l LEFT JOIN raw r ON l.d = r.doc_id""",
)
def resolved_links(spark, sf):
    return N.resolve_links(_links(spark, sf), _named(spark, sf))


@register(
    "broken_links",
    NOTES_SQL + " SELECT doc_id AS note_id, 'n' || doc_id * 2 || '.md' AS target FROM raw WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)",
)
def broken_links(spark, sf):
    return N.resolve_links(_links(spark, sf), _named(spark, sf)).filter("to_id is null").select("note_id", "target")


def _sources(spark, sf):
    notes = parsed(spark, sf).select(F.col("doc_id").alias("note_id"), "body", "updated")
    docs = B.docs(spark, sf).filter("collection = 'docs'").select(
        "doc_id", F.concat(F.lit("DOC "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("title"), F.lit("global").alias("scope"), "added_at"
    )
    return N.note_sources(notes, docs)


SOURCES_SQL = """, c AS (SELECT doc_id AS note_id, added_at, doc_id // 3 AS d FROM raw UNION ALL SELECT doc_id, added_at, doc_id * 3 FROM raw)
  SELECT note_id, 'doc ' || c.d || '.pdf' AS title, r.doc_id, CASE WHEN r.doc_id IS NULL THEN 'missing' WHEN strftime(r.added_at, '%Y-%m-%d') > strftime(c.added_at, '%Y-%m-%d') THEN 'changed' END AS state
  FROM c LEFT JOIN (SELECT * FROM raw WHERE scope = 'global') r ON c.d = r.doc_id"""


@register("note_sources", NOTES_SQL + SOURCES_SQL)
def note_sources(spark, sf):
    return _sources(spark, sf).select("note_id", "title", "doc_id", "state")


@register(
    "lint_report",
    NOTES_SQL + """, l AS (SELECT doc_id AS note_id, scope, 'Note ' || (doc_id // 2) AS target, doc_id // 2 AS d FROM raw
  UNION ALL SELECT doc_id, scope, 'n' || doc_id * 2 || '.md', doc_id * 2 FROM raw),
  r AS (SELECT note_id, l.scope, target, r.doc_id AS to_id, r.scope AS to_scope FROM l LEFT JOIN raw r ON l.d = r.doc_id),
  t AS (SELECT min(doc_id) AS doc_id, regexp_replace(lower(substr(text, 1, 60)), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM raw GROUP BY 2 HAVING t <> ''),
  g AS (SELECT doc_id, CASE WHEN length(t) = 1 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS BIGINT), 2))) END AS g FROM t),
  same AS (SELECT t, min(doc_id) AS a FROM (SELECT doc_id, regexp_replace(lower(substr(text, 1, 60)), '[^\\p{L}\\p{N}]+', '', 'g') AS t FROM raw) GROUP BY t HAVING t <> ''),
  s AS (SELECT a.vec_id AS id, b.vec_id AS best, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id AND a.vec_id IN (SELECT doc_id FROM raw) AND b.vec_id IN (SELECT doc_id FROM raw)),
  best AS (SELECT id, best FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, best) = 1),
  twice AS (SELECT x.doc_id AS a, y.doc_id AS b FROM g x JOIN g y ON x.doc_id < y.doc_id WHERE 2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) >= 0.7
    UNION SELECT a, doc_id FROM raw JOIN same ON t = regexp_replace(lower(substr(text, 1, 60)), '[^\\p{L}\\p{N}]+', '', 'g') WHERE doc_id <> a
    UNION SELECT x.id, x.best FROM best x JOIN best y ON x.best = y.id AND y.best = x.id WHERE x.id < x.best)
  SELECT kind, count(*) AS n FROM (SELECT 'broken' AS kind FROM r WHERE to_id IS NULL UNION ALL SELECT 'private' FROM r WHERE scope = 'project' AND to_scope = 'global'
  UNION ALL SELECT 'untagged' FROM raw WHERE quality IS NULL OR quality <> 1 UNION ALL SELECT 'unreviewed' FROM raw WHERE toxic = 1
  UNION ALL SELECT 'duplicate' FROM twice UNION ALL SELECT 'stale' FROM (""" + SOURCES_SQL.replace(", c AS", "WITH c AS") + """) WHERE state IS NOT NULL) GROUP BY kind""",
)
def lint_report(spark, sf):
    p = parsed(spark, sf).drop("title")
    named = _named(spark, sf).select("doc_id", "path", "title")
    notes = p.join(named, "doc_id").withColumnRenamed("doc_id", "note_id")
    docs = B.docs(spark, sf).filter("collection = 'docs'").select(
        "doc_id", F.concat(F.lit("DOC "), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("title"), F.lit("global").alias("scope"), "added_at"
    )
    openings = checkpoint(B.read(spark, sf, "documents").select("doc_id", F.substring("text", 1, 60).alias("title")))
    alike = similarity.title_pairs(openings).select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")).unionByName(similarity.title_members(openings))
    vectors = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).join(openings.select(F.col("doc_id").alias("id")), "id", "left_semi")
    mutual = similarity.mutual_best(similarity.best_neighbour(vectors, floor=0.3))
    # Where every document has one title, pairs by title come once, and few others may repeat them.
    once = not B.repeated_ids(spark, sf)
    mutual = similarity.not_by_title(mutual, openings) if once else mutual
    return N.lint(notes, docs, alike, mutual, once=once).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@register(
    "annotated_hits",
    NOTES_SQL + f""", s AS ({SOURCES_SQL.replace(", c AS", "WITH c AS")}) SELECT doc_id, CAST(coalesce(toxic = 1, false) AS INT) AS unreviewed,
  (SELECT count(*) FROM s WHERE s.note_id = raw.doc_id AND state IS NOT NULL) AS stale FROM raw""",
)
def annotated_hits(spark, sf):
    p = parsed(spark, sf)
    a = N.annotate_hits(p.select("doc_id"), p.withColumnRenamed("doc_id", "note_id"), _sources(spark, sf))
    stale = F.coalesce(F.size("stale"), F.lit(0)).cast("bigint")
    return a.select("doc_id", F.col("unreviewed").cast("int").alias("unreviewed"), stale.alias("stale"))


# --- alike titles ---------------------------------------------------------------------------------

DICE_SQL = """t AS (SELECT regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') AS t, count(*) AS rows, min(p_partkey) AS doc_id FROM part GROUP BY 1),
  g AS (SELECT *, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS BIGINT), 2))) AS g FROM t)"""


@register(
    "alike_titles",
    f"""WITH {DICE_SQL} SELECT x.t AS a, y.t AS b, round(2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)), 6) AS score, x.rows AS rows_a, y.rows AS rows_b,
  x.doc_id AS doc_a, y.doc_id AS doc_b FROM g x JOIN g y ON x.t < y.t WHERE 2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g)) >= 0.7""",
)
def alike_titles(spark, sf):
    parts = B.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return similarity.title_pairs(parts).withColumn("score", F.round("score", 6))


@register("same_titles", f"WITH {DICE_SQL} SELECT t, rows, doc_id FROM t WHERE rows > 1")
def same_titles(spark, sf):
    parts = B.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return similarity.same_titles(parts)


ASKED_TITLES = [(1, "Small-Widgets"), (2, "old red plates"), (3, "hot gizmo!"), (4, "anvil, large")]


@register(
    "titles_like",
    f"""WITH {DICE_SQL}, q AS (SELECT query_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS BIGINT), 2))) AS q
    FROM (SELECT query_id, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM (VALUES (1, 'Small-Widgets'), (2, 'old red plates'), (3, 'hot gizmo!'), (4, 'anvil, large')) v(query_id, title))),
  p AS (SELECT p_partkey AS doc_id, g FROM part JOIN g ON g.t = regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]+', '', 'g'))
  SELECT query_id, doc_id, round(2.0 * len(list_intersect(q, g)) / (len(q) + len(g)), 6) AS score FROM q, p WHERE 2.0 * len(list_intersect(q, g)) / (len(q) + len(g)) >= 0.7""",
    big=["query_id"],
)
def titles_like(spark, sf):
    asked = spark.createDataFrame(ASKED_TITLES, "query_id bigint, title string").withColumn("exclude", F.lit(None).cast("bigint"))
    parts = B.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    return similarity.similar_to(asked, parts).withColumn("score", F.round("score", 6))


@register(
    "similar_notes",
    f"""WITH {B.CHUNKS}, {B.DOCS}, {DICE_SQL.replace("t AS (", "pt AS (", 1).replace("FROM t)", "FROM pt)")}, asked AS (SELECT * FROM (VALUES (1, 'Small-Widgets'), (2, 'old red plates'), (3, 'hot gizmo!'), (4, 'anvil, large')) v(query_id, title)),
  q AS (SELECT query_id, list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS BIGINT), 2))) AS q
    FROM (SELECT query_id, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS t FROM asked)),
  p AS (SELECT p_partkey AS doc_id, g FROM part JOIN g ON g.t = regexp_replace(lower(p_name), '[^\\p{{L}}\\p{{N}}]+', '', 'g')),
  alike AS (SELECT query_id, doc_id, 0 AS tier, -2.0 * len(list_intersect(q, g)) / (len(q) + len(g)) AS place, NULL AS match FROM q, p WHERE 2.0 * len(list_intersect(q, g)) / (len(q) + len(g)) >= 0.7),
  found AS (SELECT label + 1 AS query_id, vec_id AS doc_id, 1 AS tier, vec_id AS place, 'both' AS match FROM embeddings
    WHERE label < 4 AND embedding[1] > 0 AND vec_id IN (SELECT p_partkey FROM part)),
  o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, place, doc_id) AS pos FROM (SELECT query_id, doc_id, min(tier) AS tier, arg_min(place, tier) AS place, arg_min(coalesce(match, ''), tier) AS match
    FROM (SELECT * FROM alike UNION ALL SELECT * FROM found) GROUP BY query_id, doc_id))
  SELECT query_id, pos, doc_id, CASE WHEN tier = 0 THEN 'title' ELSE 'search' END AS why, CASE WHEN tier = 1 THEN match END AS match FROM o WHERE pos <= 60""",
    big=["query_id"],
)
def similar_notes(spark, sf):
    """Parts as notes; vector labels say which search found which note, some by meaning alone."""
    asked = spark.createDataFrame(ASKED_TITLES, "query_id bigint, title string").withColumn("exclude", F.lit(None).cast("bigint"))
    parts = B.read(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("title"))
    found = B.read(spark, sf, "embeddings").select(
        (F.col("label") + 1).cast("bigint").alias("query_id"), F.col("vec_id").alias("doc_id"), F.col("vec_id").alias("rank"),
        F.when(F.get("embedding", F.lit(0)) > 0, "both").otherwise("semantic").alias("match"),
    )
    return similarity.similar_notes(asked, parts, found, has_floor=False, limit=60)


@register(
    "mutual_neighbours",
    """WITH s AS (SELECT a.vec_id AS id, b.vec_id AS best, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
    FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
  t AS (SELECT id, best FROM s WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, best) = 1)
  SELECT x.id AS a, x.best AS b FROM t x JOIN t y ON x.best = y.id AND y.best = x.id WHERE x.id < x.best""",
)
def mutual_neighbours(spark, sf):
    v = B.read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return similarity.mutual_best(similarity.best_neighbour(v, floor=0.3))


# --- paged documents: one per order, one page per line --------------------------------------------

HEAD, RULE = "| part | qty | flag |", "|---|---|---|"


def line_pages(spark, sf):
    lines = B.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(
        F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s")
    )
    head = (F.col("page") == 1) | (F.col("f") == "R")
    row = F.concat(F.lit("| part"), F.col("p").cast("string"), F.lit(" | "), F.col("q").cast("string"), F.lit(" | "), "f", F.lit(" |"))
    titled = F.concat(F.lit("# Order "), F.col("doc_id").cast("string"), F.lit(f"\n\nLines\n\n{HEAD}\n{RULE}\n"), row)
    end = F.when((F.col("f") == "N") & (F.col("s") == "F"), "\n\nEnd of list.").otherwise("")
    text = F.concat(F.when(head, titled).otherwise(F.concat(row, F.lit(f"\n{RULE}"))), end)
    return checkpoint(lines.select("doc_id", (F.col("page") - 1).cast("bigint").alias("seq"), "page", text.alias("markdown")))


LINES_SQL = """l AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, min(l_partkey) AS p, CAST(min(l_quantity) AS INT) AS q, min(l_returnflag) AS f, min(l_linestatus) AS s FROM lineitem GROUP BY ALL),
  m AS (SELECT *, page = 1 OR f = 'R' AS head, f = 'N' AND s = 'F' AS ends, '| part' || p || ' | ' || q || ' | ' || f || ' |' AS row FROM l),
  b AS (SELECT *, CASE WHEN head OR coalesce(lag(page) OVER w <> page - 1, true) OR lag(ends) OVER w THEN 1 ELSE 0 END AS cut FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page)),
  i AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY page) AS island, max(CASE WHEN head THEN page END) OVER (PARTITION BY doc_id ORDER BY page) AS titled FROM b),
  c AS (SELECT *, NOT head AND first_value(head) OVER (PARTITION BY doc_id, island ORDER BY page) AS carried FROM i)"""


@register("carried_headers", f"WITH {LINES_SQL} SELECT doc_id, page - 1 AS seq, row, '{HEAD}' AS header FROM c WHERE carried", big=["seq"])
def carried_headers(spark, sf):
    return chunking.carried_table_headers(line_pages(spark, sf)).select("doc_id", "seq", "row", "header")


@register(
    "paged_chunks",
    f"""WITH {LINES_SQL} SELECT doc_id, page, CASE WHEN titled IS NOT NULL THEN 'Order ' || doc_id ELSE '' END AS heading,
  CASE WHEN head THEN '# Order ' || doc_id || chr(10) || chr(10) || 'Lines' || chr(10) || chr(10) || '{HEAD}' || chr(10) || '{RULE}' || chr(10) || row
   WHEN carried THEN '{HEAD}' || chr(10) || '{RULE}' || chr(10) || row ELSE row || chr(10) || '{RULE}' END || CASE WHEN ends THEN chr(10) || chr(10) || 'End of list.' ELSE '' END AS content FROM c""",
    big=["page"],
)
def paged_chunks(spark, sf):
    return chunking.chunk_pages(line_pages(spark, sf)).select("doc_id", "page", "heading", "content")


@register(
    "carried_reading",
    f"""WITH {LINES_SQL} SELECT doc_id, page, CASE WHEN carried THEN length(row) + {len(HEAD) + len(RULE) + 2} + CASE WHEN ends THEN 14 ELSE 0 END END AS chars FROM c WHERE carried""",
)
def carried_reading(spark, sf):
    """Page ranges as they are read: running tables with their header."""
    pages = line_pages(spark, sf)
    p = chunking.with_carried_headers(pages)
    own = pages.withColumnRenamed("markdown", "own")
    both = p.join(own, ["doc_id", "seq", "page"]).filter("own <> markdown")
    return both.select("doc_id", "page", F.length("markdown").cast("bigint").alias("chars"))


@register(
    "converted_files",
    f"""WITH {LINES_SQL} SELECT doc_id, md5('<!-- kb:source order ' || doc_id || ' -->' || chr(10) || chr(10) || string_agg('<!-- kb:page ' || page || ' -->' || chr(10) ||
  CASE WHEN q >= 25 THEN '<!-- kb:ocr ' || q || '/50 -->' || chr(10) ELSE '' END || row, chr(10) || chr(10) ORDER BY page) || chr(10)) AS digest,
  count(*) AS pages, sum(CASE WHEN q >= 25 THEN q ELSE 0 END) AS ocr_chars FROM c GROUP BY doc_id""",
    big=["ocr_chars"],
)
def converted_files(spark, sf):
    """Pages written as converted files and read back."""
    from shelfmark.sources.files import read_converted, render_converted

    lines = B.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")).agg(
        F.min("l_partkey").alias("p"), F.min("l_quantity").cast("int").alias("q"), F.min("l_returnflag").alias("f")
    )
    row = F.concat(F.lit("| part"), F.col("p").cast("string"), F.lit(" | "), F.col("q").cast("string"), F.lit(" | "), "f", F.lit(" |"))
    ocr = F.when(F.col("q") >= 25, F.col("q"))
    pages = lines.select("doc_id", F.col("page").alias("seq"), "page", row.alias("markdown"), ocr.alias("ocr_chars"), F.lit(50).alias("ocr_total"))
    titles = lines.select("doc_id").distinct().select("doc_id", F.concat(F.lit("order "), F.col("doc_id").cast("string")).alias("title"))
    files = render_converted(pages, titles)
    back = read_converted(files).groupBy("doc_id").agg(
        F.count("page").alias("pages"), F.coalesce(F.sum("ocr_chars"), F.lit(0)).alias("ocr_chars")
    )
    return files.select("doc_id", F.md5("text").alias("digest")).join(back, "doc_id")


# --- evaluation -----------------------------------------------------------------------------------
# Each benchmark item is a question (five of its words); documents that hold the item answer it.


def asked_questions(spark, sf):
    """query_id, question: some words of each benchmark item."""
    b = B.read(spark, sf, "benchmark")
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L} ]", ""), " +"), lambda w: w != "")
    return b.select((F.col("item_id") + 1).alias("query_id"), F.array_join(F.slice(words, 2, 5), " ").alias("question"))


def gold_rows(spark, sf):
    """query_id, doc, page: the documents that hold an item, one a row."""
    whole = B.spread(B.read(spark, sf, "documents").select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", F.lit("").alias("title"), F.lit("").alias("heading"), F.col("text").alias("content")
    )
    items = B.read(spark, sf, "benchmark").select("item_id", F.lower("text").alias("needle"))
    found = checkpoint(keyword.match_needles(whole, items).select("needle", "doc_id")).join(items, "needle")
    return found.select((F.col("item_id") + 1).alias("query_id"), F.col("doc_id").cast("string").alias("doc"), F.lit(None).cast("int").alias("page"))


QUESTIONS_SQL = """asked AS (SELECT item_id + 1 AS query_id, array_to_string(list_filter(string_split_regex(regexp_replace(text, '[^\\p{L} ]', '', 'g'), ' +'), lambda w: w <> '')[2:6], ' ') AS query FROM benchmark),
  gold AS (SELECT item_id + 1 AS query_id, doc_id FROM documents d, benchmark b WHERE contains(lower(d.text), lower(b.text)))"""


@register(
    "eval_questions",
    f"WITH {QUESTIONS_SQL} SELECT query_id AS line, query AS question, (SELECT count(*) FROM gold g WHERE g.query_id = a.query_id) AS expected, 0 AS bad FROM asked a",
)
def eval_questions(spark, sf):
    """The question file's lines, an answer a line, parsed back; questions without one say so."""
    q, gold = asked_questions(spark, sf), gold_rows(spark, sf)
    lines = q.join(gold, "query_id", "left").select(F.col("query_id").alias("line"), F.concat("question", F.lit(" | "), F.coalesce("doc", F.lit("-"))).alias("text"))
    parsed = E.parse_questions(lines)
    return parsed.groupBy("line", "question").agg(F.sum(F.size("expected")).cast("bigint").alias("expected"), F.max(F.col("bad").cast("int")).alias("bad"))


MODES = list(E.MODES)


def eval_ranks_frame(spark, sf):
    q, gold = checkpoint(asked_questions(spark, sf)), checkpoint(gold_rows(spark, sf))
    chunks = B.chunks(spark, sf)
    asked = q.select("query_id", F.col("question").alias("query"))
    kw = checkpoint(keyword.search(chunks, asked, limit=fusion.LIST_LENGTH, how="scan").select("query_id", "chunk_id", "rank"))
    asked = B.read(spark, sf, "embeddings").select((F.col("vec_id") + 1).alias("query_id"), F.col("embedding").alias("vec"))
    asked = asked.join(q.select("query_id"), "query_id", "left_semi")
    near = checkpoint(semantic.nearest(asked, B.vectors(spark, sf)).select("query_id", "chunk_id", "rank"))
    lists = kw.withColumn("mode", F.lit("keyword"))
    lists = lists.unionByName(near.withColumn("mode", F.lit("semantic")))
    lists = lists.unionByName(fusion.hybrid(kw, near).select("query_id", "chunk_id", "rank", F.lit("hybrid").alias("mode")))
    hits = lists.filter(F.col("rank") <= E.DEPTH).join(chunks.select("chunk_id", "doc_id", "title", "page"), "chunk_id")
    return E.ranks(q, gold, hits, MODES)


EVAL_SQL = f"""WITH {QUESTIONS_SQL}, {B.CHUNKS}, {search_sql("queries AS (SELECT query_id, query FROM asked)", limit=40)},
near AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
  SELECT a.vec_id + 1 AS query_id, b.vec_id * 16777216 AS chunk_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings a JOIN asked ON a.vec_id + 1 = query_id, embeddings b) QUALIFY rank <= 40),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, list, r) AS pos FROM (
  SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, CASE WHEN count(*) > 1 THEN 'both' WHEN min(list) = 0 THEN 'keyword' ELSE 'semantic' END AS match,
    min(list) AS list, arg_min(rank, list) AS r FROM (SELECT query_id, chunk_id, rank, 0 AS list FROM hits UNION ALL SELECT query_id, chunk_id, rank, 1 FROM near) GROUP BY query_id, chunk_id)),
capped AS (SELECT *, sum(CAST(match = 'semantic' AS INT)) OVER (PARTITION BY query_id ORDER BY pos) AS alone, max(CAST(match <> 'semantic' AS INT)) OVER (PARTITION BY query_id) AS any_kw FROM fused),
hyb AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank FROM capped WHERE match <> 'semantic' OR alone <= CASE WHEN any_kw = 1 THEN 3 ELSE 5 END),
lists AS (SELECT 'keyword' AS mode, query_id, chunk_id, rank FROM hits UNION ALL SELECT 'hybrid', query_id, chunk_id, rank FROM hyb UNION ALL SELECT 'semantic', query_id, chunk_id, rank FROM near),
judged AS (SELECT m.mode, a.query_id, coalesce(min(CASE WHEN g.doc_id IS NOT NULL OR t.title IS NOT NULL THEN l.rank END), 0) AS rank, count(DISTINCT l.rank) AS count,
    a.query_id IN (SELECT query_id FROM gold) AS answerable FROM asked a CROSS JOIN (VALUES ('keyword'), ('hybrid'), ('semantic')) m(mode)
  LEFT JOIN (SELECT l.*, doc_id, title FROM lists l JOIN chunks USING (chunk_id) WHERE rank <= 8) l ON l.mode = m.mode AND l.query_id = a.query_id
  LEFT JOIN gold g ON g.query_id = a.query_id AND g.doc_id = l.doc_id
  LEFT JOIN (SELECT DISTINCT query_id, c.title FROM gold JOIN (SELECT DISTINCT title FROM chunks) c ON contains(c.title, CAST(gold.doc_id AS VARCHAR))) t ON t.query_id = a.query_id AND t.title = l.title
  GROUP BY m.mode, a.query_id),
measured AS (SELECT mode, count(*) FILTER (answerable) AS answerable, count(*) FILTER (answerable AND rank = 1) AS hit1, count(*) FILTER (answerable AND rank BETWEEN 1 AND 3) AS hit3,
  count(*) FILTER (answerable AND rank BETWEEN 1 AND 8) AS hit8, coalesce(avg(CASE WHEN answerable THEN CASE WHEN rank > 0 THEN 1.0::DOUBLE / rank ELSE 0 END END), 0) AS mrr,
  count(*) FILTER (NOT answerable) AS unanswerable, count(*) FILTER (NOT answerable AND count = 0) AS quiet FROM judged GROUP BY mode)"""


@register("eval_ranks", EVAL_SQL + " SELECT mode, query_id, rank, count FROM judged")
def eval_ranks(spark, sf):
    return eval_ranks_frame(spark, sf).select("mode", "query_id", "rank", "count")


@register("eval_metrics", EVAL_SQL + " SELECT mode, answerable, hit1, hit3, hit8, round(mrr, 6) AS mrr, unanswerable, quiet FROM measured")
def eval_metrics(spark, sf):
    return E.metrics(eval_ranks_frame(spark, sf)).withColumn("mrr", F.round("mrr", 6))


@register("run_eval", EVAL_SQL + " SELECT mode, answerable, hit1, hit3, hit8, round(mrr, 6) AS mrr, unanswerable, quiet FROM measured WHERE mode = 'keyword'")
def run_eval(spark, sf):
    """The evaluation of a whole library, which has no vectors yet."""
    base = KnowledgeBase(B.docs(spark, sf), B.chunks(spark, sf), B.shelves(spark, sf), index="scan")
    done = E.run_eval(Library(base), checkpoint(asked_questions(spark, sf)), checkpoint(gold_rows(spark, sf)))
    return E.metrics(done).withColumn("mrr", F.round("mrr", 6))


# --- dialogue and planning ------------------------------------------------------------------------


@register(
    "note_nudges",
    """WITH u AS (SELECT user_id AS conv_id, max(event_id) AS at FROM events WHERE event_type = 'view' GROUP BY user_id),
  f AS (SELECT u.conv_id, min(CASE WHEN event_type = 'error' THEN event_id END) AS failed, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS edited,
    max(CAST(event_type = 'signup' AND value > 60 AS INT)) AS done FROM u LEFT JOIN events e ON e.user_id = u.conv_id AND e.event_id > u.at GROUP BY u.conv_id)
  SELECT f.conv_id, CASE WHEN failed < edited THEN 'debugged' ELSE 'told' END AS reason FROM f JOIN u USING (conv_id) JOIN events e ON e.event_id = u.at
  WHERE coalesce(done, 0) = 0 AND (coalesce(failed < edited, false) OR e.value < 40)""",
)
def note_nudges(spark, sf):
    """Events as messages: views are the user, errors failed tools, purchases edits, big signups saved notes."""
    e = B.read(spark, sf, "events")
    kind = F.col("event_type")
    m = e.select(
        F.col("user_id").alias("conv_id"),
        F.col("event_id").alias("turn"),
        F.when(kind == "view", "user").when(kind.isin("error", "purchase"), "toolResult").otherwise("assistant").alias("role"),
        F.when(F.col("value") < 40, "From now on use this").otherwise("what is it").alias("text"),
        F.when(kind == "purchase", "edit").when(kind == "error", "bash").when((kind == "signup") & (F.col("value") > 60), "save_note").alias("tool"),
        F.lit(None).cast("string").alias("call_id"),
        (kind == "error").alias("is_error"),
        F.lit("{}").alias("arguments"),
        F.lit(None).cast("string").alias("kind"),
    )
    return dialogue.note_nudges(m, "save_note", "notes_", "reminder")


@register("conversation_ends", "SELECT conv_id, max(turn) AS turn, CAST(regexp_matches(arg_max(text, turn), '(?i)from now on|going forward|in (?:the )?future|remember (?:that|this)|keep in mind') AS INT) AS lasting FROM conversations WHERE role = 'user' GROUP BY conv_id")
def conversation_ends(spark, sf):
    c = B.read(spark, sf, "conversations").filter("role = 'user'")
    last = c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("said"))
    return last.select("conv_id", "turn", F.rlike("said", F.lit(dialogue.LASTING)).cast("int").alias("lasting"))


@register(
    "planned_searches",
    """WITH w AS (SELECT conv_id, turn, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 500) AS q, list_filter(string_split_regex(regexp_replace(text, '[^\\p{L}]+', ' ', 'g'), ' +'), lambda x: x <> '') AS w FROM conversations),
  s AS (SELECT conv_id, turn, q, 0 AS pos FROM w UNION ALL SELECT conv_id, turn, w[i], i FROM w, (VALUES (1), (2), (3), (4)) v(i) WHERE len(w) >= i)
  SELECT conv_id, turn, q AS search, row_number() OVER (PARTITION BY conv_id, turn ORDER BY min(pos)) AS pos FROM s GROUP BY conv_id, turn, q""",
)
def planned_searches(spark, sf):
    """A model's replies, made of each message's words: numbers among the searches are not strings, extra ones are cut."""
    c = B.read(spark, sf, "conversations")
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " +"), lambda w: w != "")
    listed = F.array_join(F.transform(words, lambda w: F.concat(F.lit('" '), w, F.lit(' ", 7'))), ", ")
    reply = F.concat(F.lit("Thinking… {\"queries\": ["), listed, F.lit("]} done"))
    asked = c.select("conv_id", "turn", F.posexplode(planning.parse_searches(reply, planning.clean_question("text"))).alias("i", "search"))
    return asked.select("conv_id", "turn", "search", (F.col("i") + 1).cast("bigint").alias("pos"))


ANSWERS_SQL = """a AS (SELECT l_orderkey, l_linenumber AS n, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey, l_extendedprice) AS i FROM lineitem),
  u AS (SELECT l_orderkey, n, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(i)) AS new FROM a WHERE n BETWEEN 1 AND 5 GROUP BY l_orderkey, n)"""


def answers(spark, sf):
    """An answer per order that cites its line numbers in order of the parts."""
    parts = F.sort_array(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_suppkey", "l_extendedprice")))
    said = F.transform(parts, lambda p: F.concat(F.lit("part "), p["l_partkey"].cast("string"), F.lit(" ["), p["l_linenumber"].cast("string"), F.lit("]")))
    return B.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(said, "; ").alias("answer"))


@register("cited_numbers", f"WITH {ANSWERS_SQL} SELECT l_orderkey, n AS cited, new AS shown FROM u")
def cited_numbers(spark, sf):
    c = answers(spark, sf).select("l_orderkey", F.posexplode(planning.cited_numbers("answer", 5)).alias("i", "cited"))
    return c.select("l_orderkey", "cited", (F.col("i") + 1).cast("bigint").alias("shown"))


@register(
    "renumbered_answers",
    f"WITH {ANSWERS_SQL} SELECT l_orderkey, string_agg('part ' || l_partkey || ' ' || CASE WHEN new IS NOT NULL THEN '[' || new || ']' ELSE '' END, '; ' ORDER BY i) AS answer "
    "FROM a LEFT JOIN u USING (l_orderkey, n) GROUP BY l_orderkey",
)
def renumbered_answers(spark, sf):
    return answers(spark, sf).select("l_orderkey", planning.renumber("answer", 5).alias("answer"))
