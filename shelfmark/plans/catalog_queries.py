"""The catalogue, versions, titles and sync over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import catalog as C, chunking, planning, versions as V
from shelfmark.plans import tables as B
from shelfmark.plans.registry import register

WITH = f"WITH {B.DOCS}, {B.SHELVES}, {B.PENDING}"


@register(
    "stats",
    f"{WITH} SELECT sum(CAST(collection = 'docs' AS BIGINT)) AS docs, sum(CAST(collection = 'wiki' AS BIGINT)) AS wiki, "
    "sum(coalesce(pages, 0)) AS pages FROM docs",
    big=["docs", "wiki", "pages"],
)
def stats(spark, sf):
    return C.stats(B.docs(spark, sf))


@register("newest_notes", f"{WITH} SELECT doc_id, title, strftime(added_at, '%Y-%m-%d %H:%M') AS added FROM docs WHERE collection = 'wiki'")
def newest_notes(spark, sf):
    n = C.list_docs(B.docs(spark, sf), "wiki")
    return n.select("doc_id", "title", F.date_format("added_at", "yyyy-MM-dd HH:mm").alias("added"))


@register(
    "shelf_counts",
    f"{WITH} SELECT shelf AS name, sum(CAST(collection = 'docs' AS BIGINT)) AS docs, sum(CAST(collection = 'wiki' AS BIGINT)) AS notes, "
    "CAST(lower(shelf) IN ('src3', 'flagged') AS INT) AS used FROM shelves JOIN docs USING (doc_id) GROUP BY shelf",
    big=["docs", "notes"],
)
def shelf_counts(spark, sf):
    s = C.shelf_list(B.docs(spark, sf), B.shelves(spark, sf), ["SRC3", "Flagged"])
    return s.withColumn("used", F.col("used").cast("int"))


def _visible(name: str, where: str, **filters):
    @register(name, f"{WITH} SELECT doc_id, title FROM docs WHERE {where}")
    def query(spark, sf):
        return C.visible(B.docs(spark, sf), B.shelves(spark, sf), **filters).select("doc_id", "title")

    return query


NONE = "doc_id NOT IN (SELECT doc_id FROM shelves)"
_visible("visible_any", f"({NONE} OR doc_id IN (SELECT doc_id FROM shelves WHERE lower(shelf) IN ('src5', 'flagged')))", any_of=["src5", "FLAGGED"])
_visible("visible_only", "doc_id IN (SELECT doc_id FROM shelves WHERE lower(shelf) = 'flagged')", only="flagged")
_visible("visible_none", NONE, any_of=[])


@register("shelf_map", f"{WITH} SELECT doc_id, string_agg(shelf, ',' ORDER BY shelf) AS shelves FROM shelves GROUP BY doc_id")
def shelf_map(spark, sf):
    return C.shelf_map(B.shelves(spark, sf)).select("doc_id", F.array_join("shelves", ",").alias("shelves"))


@register("ocr_backlog", f"{WITH} SELECT doc_id, title FROM docs WHERE doc_id IN (SELECT doc_id FROM pending)")
def ocr_backlog(spark, sf):
    return C.ocr_backlog(B.docs(spark, sf), B.ocr_pending(spark, sf)).select("doc_id", "title")


def _scopes(spark, sf):
    d = B.docs(spark, sf)
    return d.filter("collection = 'wiki'"), d


@register(
    "visible_scopes",
    f"{WITH} SELECT 'project' AS scope, doc_id FROM docs WHERE collection = 'wiki' UNION ALL SELECT 'global', doc_id FROM docs "
    f"WHERE {NONE} OR doc_id IN (SELECT doc_id FROM shelves WHERE lower(shelf) = 'src7')",
)
def visible_scopes(spark, sf):
    project, everywhere = _scopes(spark, sf)
    return C.visible_scoped(project, everywhere, B.shelves(spark, sf), any_of=["src7"]).select("scope", "doc_id")


@register(
    "located",
    f"{WITH} SELECT doc_id, CASE WHEN collection = 'wiki' THEN 'project' ELSE 'global' END AS scope, title FROM docs",
)
def located(spark, sf):
    return C.locate(C.scoped(*_scopes(spark, sf))).select("doc_id", "scope", "title")


@register(
    "reachable_documents",
    f"{WITH} SELECT doc_id, CAST(collection = 'wiki' OR {NONE} OR doc_id IN (SELECT doc_id FROM shelves WHERE lower(shelf) = 'src7') AS INT) AS seen FROM docs",
)
def reachable_documents(spark, sf):
    rows = C.locate(C.scoped(*_scopes(spark, sf)))
    return C.reachable(rows, B.shelves(spark, sf), ["SRC7"]).select("doc_id", F.col("seen").cast("int").alias("seen"))


@register(
    "changed_collections",
    f"{WITH} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM pending) THEN 'wiki' ELSE collection END AS collection, "
    "CASE WHEN doc_id IN (SELECT doc_id FROM pending) THEN 'note' ELSE kind END AS kind FROM docs",
)
def changed_collections(spark, sf):
    return C.change_collection(B.docs(spark, sf), B.ocr_pending(spark, sf), "wiki").select("doc_id", "collection", "kind")


def _tables(spark, sf):
    return {
        "docs": B.docs(spark, sf).select("doc_id", "title"),
        "chunks": B.chunks(spark, sf).select("chunk_id", "doc_id", "title", "content"),
        "vectors": B.vectors(spark, sf).select("chunk_id", "doc_id"),
        "shelves": B.shelves(spark, sf),
        "pending": B.ocr_pending(spark, sf),
    }


def _sizes(tables):
    out = None
    for name, df in tables.items():
        one = df.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "doc_id", "n")
        out = one if out is None else out.unionByName(one)
    return out


def _sizes_sql(where: str) -> str:
    parts = [("docs", "docs"), ("chunks", "chunks"), ("vectors", "(SELECT vec_id AS doc_id FROM embeddings)"), ("shelves", "shelves"), ("pending", "pending")]
    return " UNION ALL ".join(f"SELECT '{n}' AS part, doc_id, count(*) AS n FROM {t} {where} GROUP BY doc_id" for n, t in parts)


@register("deleted_documents", f"{WITH}, {B.CHUNKS} " + _sizes_sql("WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"))
def deleted_documents(spark, sf):
    """Toxic documents gone from all five tables."""
    return _sizes(C.delete_docs(_tables(spark, sf), B.read(spark, sf, "labels").filter("toxic = 1")))


@register(
    "renamed_documents",
    f"{WITH}, {B.CHUNKS} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 'Renamed ' || title ELSE title END AS title, "
    "(SELECT count(*) FROM chunks c WHERE c.doc_id = docs.doc_id) AS chunks, CAST(doc_id IN (SELECT vec_id FROM embeddings) "
    "AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INT) AS vectors FROM docs",
)
def renamed_documents(spark, sf):
    t = _tables(spark, sf)
    new = t["docs"].join(B.read(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    out = C.rename_docs(t, new.select("doc_id", F.concat(F.lit("Renamed "), "title").alias("new_title")))
    chunks = out["chunks"].groupBy("doc_id", "title").agg(F.count(F.lit(1)).alias("chunks"))
    vectors = out["vectors"].groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("vectors"))
    return (
        out["docs"].join(chunks, ["doc_id", "title"], "left").join(vectors, "doc_id", "left")
        .select("doc_id", "title", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("vectors", F.lit(0)).alias("vectors"))
    )


@register(
    "edited_chunks",
    f"{WITH}, {B.CHUNKS} SELECT (SELECT count(*) FROM chunks WHERE doc_id IN (SELECT doc_id FROM pending)) AS edited, "
    "(SELECT count(*) FROM embeddings WHERE vec_id * 16777216 NOT IN (SELECT chunk_id FROM chunks WHERE doc_id IN (SELECT doc_id FROM pending))) AS vectors",
)
def edited_chunks(spark, sf):
    """New text for the chunks of documents that waited for OCR; only their vectors go."""
    t = _tables(spark, sf)
    edits = t["chunks"].join(t["pending"], "doc_id", "left_semi").select("chunk_id", F.concat(F.lit("OCR "), "content").alias("new_content"))
    out = C.set_chunk_contents(t, edits)
    return out["chunks"].agg(F.count_if(F.startswith("content", F.lit("OCR "))).alias("edited")).select(
        "edited", out["vectors"].agg(F.count(F.lit(1))).scalar().alias("vectors")
    )


@register(
    "replaced_documents",
    f"{WITH}, {B.CHUNKS} SELECT (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM pending)) "
    "+ (SELECT count(*) FROM pending) AS chunks, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM pending)) AS vectors",
)
def replaced_documents(spark, sf):
    """Documents read again as one chunk each: old chunks and vectors go with the old text."""
    t = _tables(spark, sf)
    again = t["docs"].join(t["pending"], "doc_id", "left_semi")
    fresh = again.select((F.col("doc_id") * (1 << 24)).alias("chunk_id"), "doc_id", "title", F.lit("new").alias("content"))
    out = C.put_docs(t, again, fresh)
    return out["docs"].agg(F.count(F.lit(1)).alias("docs")).select(
        "docs",
        out["chunks"].agg(F.count(F.lit(1))).scalar().alias("chunks"),
        out["vectors"].agg(F.count(F.lit(1))).scalar().alias("vectors"),
    )


@register(
    "reshelved",
    f"{WITH} SELECT doc_id, shelf FROM shelves WHERE doc_id NOT IN (SELECT doc_id FROM pending) UNION ALL SELECT doc_id, 'CHECK' FROM pending",
)
def reshelved(spark, sf):
    waiting = B.ocr_pending(spark, sf)
    fresh = waiting.select("doc_id", F.explode(F.array(F.lit("Check"), F.lit("CHECK"))).alias("shelf"))
    return C.set_shelves(B.shelves(spark, sf), waiting, fresh)


@register("pending_toggled", f"{WITH} SELECT doc_id FROM pending WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) "
          "UNION SELECT doc_id FROM labels WHERE quality = 1")
def pending_toggled(spark, sf):
    labels = B.read(spark, sf, "labels")
    off = C.set_pending(B.ocr_pending(spark, sf), labels.filter("toxic = 1"), False)
    return C.set_pending(off, labels.filter("quality = 1"), True)


@register("canonical_shelves", f"{WITH} SELECT doc_id, coalesce((SELECT min(shelf) FROM shelves s WHERE lower(s.shelf) = d.source), d.source) AS shelf FROM documents d")
def canonical_shelves(spark, sf):
    wanted = B.read(spark, sf, "documents").select("doc_id", F.concat(F.lit(" "), "source", F.lit(" ")).alias("shelf"))
    return C.canonical_shelves(wanted, B.shelves(spark, sf)).select("doc_id", "shelf")


@register(
    "renamed_shelf",
    f"{WITH} SELECT DISTINCT doc_id, CASE WHEN lower(shelf) = 'src1' THEN 'Flagged' ELSE shelf END AS shelf FROM shelves WHERE lower(shelf) <> 'src2'",
)
def renamed_shelf(spark, sf):
    """One shelf joined to another, one deleted."""
    return C.rename_shelf(C.rename_shelf(B.shelves(spark, sf), "src1", "Flagged"), "SRC2", None)


@register(
    "renamed_choices",
    "SELECT c_nationkey, string_agg(DISTINCT s, ',' ORDER BY s) AS shelves FROM (SELECT c_nationkey, CASE WHEN c_mktsegment = 'MACHINERY' "
    "THEN 'AUTOMOBILE' ELSE c_mktsegment END AS s FROM customer) GROUP BY c_nationkey",
)
def renamed_choices(spark, sf):
    """A shelf renamed in every project's choice; nations stand for projects, market segments for shelves."""
    c = B.read(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("shelves"))
    out = C.rename_choice(c, "machinery", "AUTOMOBILE")
    return out.select("c_nationkey", F.array_join(F.sort_array("shelves"), ",").alias("shelves"))


@register(
    "chosen_shelves",
    f"{WITH} SELECT source AS name, (SELECT min(shelf) FROM shelves JOIN docs USING (doc_id) WHERE lower(shelf) = d.source) AS shelf, n FROM "
    "(SELECT source, count(*) AS n FROM documents GROUP BY source) d",
)
def chosen_shelves(spark, sf):
    names = B.read(spark, sf, "documents").groupBy(F.col("source").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return C.choose_shelves(names, B.docs(spark, sf), B.shelves(spark, sf))


@register("matching", f"{WITH} SELECT doc_id, title FROM docs WHERE contains(lower(title), 'src1') OR contains(lower(source), 'src1')")
def matching(spark, sf):
    return C.matching(B.docs(spark, sf), " SRC1 ").select("doc_id", "title")


@register("list_page", f"{WITH} SELECT doc_id, title FROM docs ORDER BY collection, title, doc_id LIMIT 100 OFFSET 100")
def list_page(spark, sf):
    return C.list_page(B.docs(spark, sf), offset=100).select("doc_id", "title")


@register(
    "list_header",
    f"{WITH} SELECT docs, notes, 101 AS first, least(docs + notes, 200) AS last, docs + notes - least(docs + notes, 200) AS rest FROM "
    "(SELECT sum(CAST(collection = 'docs' AS BIGINT)) AS docs, sum(CAST(collection = 'wiki' AS BIGINT)) AS notes FROM docs)",
    big=["docs", "notes", "first", "last", "rest"],
)
def list_header(spark, sf):
    return C.list_header(B.docs(spark, sf), offset=100)


@register(
    "folder_groups",
    f"{WITH}, g AS (SELECT split_part(source, '/', -2) || '/' || split_part(source, '/', -3) AS name, count(*) AS n FROM docs WHERE collection = 'docs' GROUP BY 1) "
    "SELECT name, n, (SELECT count(*) FROM g) AS groups FROM g ORDER BY n DESC, name LIMIT 12",
)
def folder_groups(spark, sf):
    d = B.docs(spark, sf)
    parent = F.regexp_replace("source", "/[^/]*$", "")
    named = d.withColumn("folder", F.concat(C.folder_of("source"), F.lit("/"), C.folder_of(parent)))
    return C.top_groups(named, "folder")


@register(
    "shelf_groups",
    f"{WITH}, g AS (SELECT shelf AS name, count(*) AS n FROM shelves GROUP BY shelf) SELECT name, n, (SELECT count(*) FROM g) AS groups FROM g ORDER BY n DESC, name LIMIT 12",
)
def shelf_groups(spark, sf):
    return C.top_groups(B.shelves(spark, sf), "shelf")


@register("match_words", f"{WITH} SELECT doc_id, title FROM docs WHERE contains(lower(title || ' ' || doc_id), 'src3') AND contains(lower(title || ' ' || doc_id), 'en')")
def match_words(spark, sf):
    return C.match_docs(B.docs(spark, sf), " EN src3").select("doc_id", "title")


@register("match_title", f"{WITH} SELECT doc_id, title FROM docs WHERE lower(title) = 'src7/en-7.md' OR (NOT EXISTS (SELECT 1 FROM docs WHERE lower(title) = 'src7/en-7.md') AND contains(lower(title || ' ' || doc_id), 'src7/en-7.md'))")
def match_title(spark, sf):
    return C.match_docs(B.docs(spark, sf), "SRC7/EN-7.md").select("doc_id", "title")


@register("words_list", f"{WITH} SELECT doc_id, title FROM docs WHERE contains(lower(title || ' ' || doc_id), 'src') AND contains(lower(title || ' ' || doc_id), 'de') "
          "ORDER BY collection, added_at DESC, doc_id LIMIT 50")
def words_list(spark, sf):
    return C.words_list(B.docs(spark, sf), "src de").select("doc_id", "title")


@register(
    "catalog",
    f"""{WITH}, seen AS (SELECT * FROM docs WHERE {NONE} OR doc_id IN (SELECT doc_id FROM shelves WHERE lower(shelf) = 'src5')),
  f AS (SELECT sum(CAST(collection = 'docs' AS BIGINT)) AS docs, sum(CAST(collection = 'wiki' AS BIGINT)) AS wiki, sum(coalesce(pages, 0)) AS pages FROM seen),
  r AS (SELECT collection, title, doc_id, row_number() OVER (PARTITION BY collection ORDER BY added_at DESC, doc_id) AS pos FROM seen)
  SELECT CASE WHEN collection = 'wiki' THEN 'note' ELSE 'recent' END AS part, pos, title, doc_id, docs, wiki, pages,
  (SELECT count(*) FROM docs) - f.docs - f.wiki AS hidden FROM r, f WHERE pos <= CASE WHEN collection = 'wiki' THEN 40 ELSE 15 END""",
    big=["docs", "wiki", "pages", "hidden"],
)
def catalog(spark, sf):
    return C.catalog(B.docs(spark, sf), B.shelves(spark, sf), any_of=["src5"])


@register("suggested_shelves", f"{WITH} SELECT doc_id, CASE WHEN source LIKE '/kb/%/%' THEN split_part(source, '/', 3) END AS shelf FROM docs")
def suggested_shelves(spark, sf):
    return B.docs(spark, sf).select("doc_id", C.folder_shelf("/kb", "source").alias("shelf"))


@register(
    "browse_rows",
    f"{WITH} SELECT doc_id, CASE WHEN collection = 'wiki' THEN CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN kind ELSE '' END END AS tags, "
    "CAST(collection = 'wiki' AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS INT) AS unreviewed, "
    "CAST(collection = 'docs' AND doc_id IN (SELECT doc_id FROM pending) AS INT) AS reading FROM docs",
)
def browse_rows(spark, sf):
    notes = B.read(spark, sf, "labels").select(
        "doc_id", F.array(F.lit("note")).alias("tags"), F.when(F.col("toxic") == 1, "pending").alias("review")
    )
    r = C.browse_rows(B.docs(spark, sf), notes, B.ocr_pending(spark, sf))
    return r.select(
        "doc_id", F.array_join("tags", ",").alias("tags"), F.col("unreviewed").cast("int").alias("unreviewed"), F.col("reading").cast("int").alias("reading")
    )


@register(
    "status",
    f"{WITH}, {B.CHUNKS} SELECT sum(CAST(collection = 'docs' AS BIGINT)) AS docs, sum(CAST(collection = 'wiki' AS BIGINT)) AS wiki, sum(coalesce(pages, 0)) AS pages, "
    "(SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT shelf) FROM shelves) AS shelves, (SELECT count(*) FROM pending) AS reading FROM docs",
    big=["docs", "wiki", "pages"],
)
def status(spark, sf):
    return C.status(B.docs(spark, sf), B.chunks(spark, sf), B.shelves(spark, sf), B.ocr_pending(spark, sf))


@register(
    "ocr_classes",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= l_discount * 500 THEN 'mostly' WHEN l_quantity >= 20 THEN 'some' END AS ocr, count(*) AS n FROM lineitem GROUP BY ALL",
)
def ocr_classes(spark, sf):
    """Line quantities as OCR characters of pages."""
    r = B.read(spark, sf, "lineitem")
    c = C.ocr_class(F.col("l_quantity"), F.col("l_discount") * 1000)
    return r.groupBy("l_orderkey", "l_linenumber", c.alias("ocr")).agg(F.count(F.lit(1)).alias("n"))


# --- identity, versions, titles -------------------------------------------------------------------


@register(
    "exact_duplicates",
    "SELECT 'k-' || substr(sha256(text), 1, 12) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text",
)
def exact_duplicates(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id", "text", F.col("doc_id").alias("added_at"))
    return V.exact_duplicates(d, "text")


@register("note_ids", f"{WITH} SELECT doc_id, 'w-' || substr(sha256(source), 1, 12) AS id, 'w-' || substr(sha256('project:' || source), 1, 12) AS project_id FROM docs")
def note_ids(spark, sf):
    return B.docs(spark, sf).select("doc_id", V.note_id("source").alias("id"), V.note_id("source", True).alias("project_id"))


@register(
    "import_status",
    "SELECT doc_id, CASE WHEN text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) THEN 'in_other_scope' "
    "WHEN text IN (SELECT text FROM documents JOIN labels USING (doc_id)) THEN 'exists' ELSE 'added' END AS status FROM documents",
)
def import_status(spark, sf):
    files = B.read(spark, sf, "documents").select("doc_id", V.content_key("text").alias("content_key"))
    known = files.join(B.read(spark, sf, "labels"), "doc_id")
    return V.import_status(files, known, known.filter("toxic = 1")).select("doc_id", "status")


@register(
    "import_summary",
    "SELECT status, count(*) AS n FROM (SELECT CASE WHEN text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1) THEN 'in_other_scope' "
    "WHEN text IN (SELECT text FROM documents JOIN labels USING (doc_id)) THEN 'exists' ELSE 'added' END AS status FROM documents) GROUP BY status",
)
def import_summary(spark, sf):
    return C.import_summary(import_status(spark, sf))


def _files_sql(file_id: str, only: str) -> str:
    return f"""files AS (SELECT {file_id} AS file_id, CASE WHEN collection = 'wiki' THEN 'upload:' || split_part(source, '/', -1) ELSE source END AS source FROM docs),
  old AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM pending) THEN 'upload:' || split_part(source, '/', -1) ELSE source END AS source, title, added_at FROM docs),
  pairs AS (SELECT file_id, doc_id, title, added_at FROM files f JOIN old o ON CASE WHEN f.source LIKE 'upload:%'
    THEN regexp_replace(split_part(o.source, '/', -1), '^upload:', '') = substr(f.source, 8)
    ELSE o.source = f.source OR o.source = 'upload:' || split_part(f.source, '/', -1) END{only})"""


FILES_SQL = _files_sql("CASE WHEN doc_id IN (SELECT doc_id FROM pending) THEN doc_id ELSE -1 - doc_id END", "\n    WHERE file_id NOT IN (SELECT doc_id FROM docs)")
ALL_FILES_SQL = _files_sql("doc_id", "")


def _files(spark, sf, edited: bool = True):
    """Every document's file again: as it is where the document waits for OCR, with new content elsewhere if ``edited``."""
    d = B.docs(spark, sf)
    up = F.concat(F.lit("upload:"), F.substring_index("source", "/", -1))
    known = d.join(B.ocr_pending(spark, sf).withColumn("w", F.lit(True)), "doc_id", "left")
    own = F.when(F.col("w"), F.col("doc_id")).otherwise(-1 - F.col("doc_id")) if edited else F.col("doc_id")
    files = known.select(own.alias("file_id"), F.when(F.col("collection") == "wiki", up).otherwise(F.col("source")).alias("source"))
    waits = B.ocr_pending(spark, sf).withColumn("w", F.lit(True))
    old = d.join(waits, "doc_id", "left").select("doc_id", F.when(F.col("w"), up).otherwise(F.col("source")).alias("source"), "title", "added_at")
    return files, old


@register(
    "previous_versions",
    f"{WITH}, {ALL_FILES_SQL} SELECT file_id, count(*) AS versions, arg_min(title, added_at) AS first_title, arg_max(doc_id, added_at) AS last_id FROM pairs GROUP BY file_id",
)
def previous_versions(spark, sf):
    """What each document's file would replace, whether its content is known or not."""
    return V.previous_versions(*_files(spark, sf, edited=False), known=True)


@register(
    "import_plan",
    f"{WITH}, {FILES_SQL} SELECT file_id, CASE WHEN source LIKE '/kb/src1/%' THEN 'project' ELSE 'global' END AS scope, "
    "CASE WHEN source LIKE '/kb/%/%' THEN split_part(source, '/', 3) END AS shelf, coalesce(n, 0) AS versions "
    "FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM pairs GROUP BY file_id) USING (file_id)",
)
def import_plan(spark, sf):
    return V.import_plan(*_files(spark, sf), project_root="/kb/src1/", added_folder="/kb")


@register(
    "replaced_versions",
    f"{WITH} SELECT source, arg_max(doc_id, doc_id) AS doc_id, arg_min(title, doc_id) AS title, count(*) AS versions FROM docs GROUP BY source",
)
def replaced_versions(spark, sf):
    return V.replace_versions(B.docs(spark, sf)).drop("added_at")


@register("merged_shelves", f"{WITH} SELECT DISTINCT source, shelf FROM docs JOIN shelves USING (doc_id)")
def merged_shelves(spark, sf):
    return V.merged_shelves(B.docs(spark, sf), B.shelves(spark, sf))


@register(
    "distinct_titles",
    """WITH p AS (SELECT page_id AS doc_id, list_filter(string_split_regex(u, '[\\\\/]+'), lambda x: x <> '') AS parts FROM (
    SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS u FROM pages)),
  e AS (SELECT doc_id, k, array_to_string(parts[len(parts) - k + 1:], '/') AS ending FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)),
  u AS (SELECT ending, min(doc_id) AS doc_id, min(k) AS k FROM e GROUP BY ending HAVING count(*) = 1),
  best AS (SELECT doc_id, arg_min(ending, k) AS title FROM u GROUP BY doc_id)
  SELECT doc_id, coalesce(title, CASE WHEN n = 1 THEN name ELSE name || ' (' || n || ')' END) AS title FROM (
    SELECT doc_id, title, parts[len(parts)] AS name, row_number() OVER (PARTITION BY parts[len(parts)], title IS NULL ORDER BY doc_id) AS n
    FROM p LEFT JOIN best USING (doc_id))""",
)
def distinct_titles(spark, sf):
    u = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return V.distinct_titles(B.read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), u.alias("source")))


@register(
    "titles_by_arrival",
    """WITH s AS (SELECT page_id AS doc_id, -page_id AS arrived, page_id % 7 = 3 AS up,
    regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '([0-9])[0-9]*/?$', '\\1.md') AS path FROM pages),
  p AS (SELECT doc_id, arrived, up, list_filter(string_split_regex(path, '[\\\\/]+'), lambda x: x <> '') AS parts FROM s),
  f AS (SELECT *, parts[len(parts)] AS name, row_number() OVER (PARTITION BY parts[len(parts)], up ORDER BY arrived) AS nth FROM p),
  e AS (SELECT doc_id, arrived, k, array_to_string(parts[len(parts) - k + 1:], '/') AS ending FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS k FROM f WHERE NOT up)),
  own AS (SELECT doc_id, arg_min(ending, k) AS own, min(k) AS k FROM (SELECT *, row_number() OVER (PARTITION BY ending ORDER BY arrived) AS n FROM e) WHERE n = 1 GROUP BY doc_id),
  one AS (SELECT * FROM f WHERE NOT up AND nth = 1),
  next AS (SELECT name, min(arrived) AS arrived, arg_min(k, arrived) AS k FROM f JOIN own USING (doc_id) WHERE nth > 1 GROUP BY name),
  ups AS (SELECT f.doc_id, row_number() OVER (PARTITION BY f.name ORDER BY f.arrived) AS n FROM f LEFT JOIN one USING (name) LEFT JOIN next USING (name)
    WHERE f.up AND (one.name IS NULL OR f.arrived < one.arrived OR (len(one.parts) > 1 AND f.arrived > next.arrived))),
  early AS (SELECT name FROM f JOIN one USING (name) WHERE f.up AND f.arrived < one.arrived),
  t AS (SELECT f.doc_id, f.arrived, f.name, CASE WHEN ups.doc_id IS NOT NULL OR (NOT f.up AND nth = 1 AND f.name NOT IN (FROM early) AND (next.k IS NULL OR len(parts) = 1)) THEN f.name
      WHEN NOT f.up AND nth = 1 AND f.name NOT IN (FROM early) THEN array_to_string(parts[greatest(len(parts) - next.k + 1, 1):], '/') ELSE own END AS title
    FROM f LEFT JOIN own USING (doc_id) LEFT JOIN next ON f.name = next.name LEFT JOIN ups ON f.doc_id = ups.doc_id AND ups.n = 1)
  SELECT doc_id, coalesce(title, name || ' (' || (1 + row_number() OVER (PARTITION BY name, title IS NULL ORDER BY arrived)) || ')') AS title FROM t""",
)
def titles_by_arrival(spark, sf):
    """Pages as files in folders, the newest first; each seventh is an upload."""
    u = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    path = F.regexp_replace(u, "([0-9])[0-9]*/?$", "$1.md")
    source = F.when(F.col("page_id") % 7 == 3, F.concat(F.lit("upload:"), path)).otherwise(path)
    return V.titles_by_arrival(B.read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), source.alias("source"), (-F.col("page_id")).alias("arrived")))


OLD_SQL = """old AS (SELECT doc_id, CASE WHEN quality = 0 AND toxic = 0 THEN 'old ' || title ELSE title END AS title,
  CASE WHEN toxic = 1 THEN chars - 1 ELSE chars END AS chars FROM docs JOIN labels USING (doc_id))"""


@register(
    "synced_documents",
    f"{WITH}, {OLD_SQL} SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' "
    "WHEN n.chars <> o.chars THEN 'reindex' WHEN n.title <> o.title THEN 'rename' ELSE 'keep' END AS action "
    "FROM (SELECT * FROM docs WHERE pages IS NULL OR pages > 1) n FULL JOIN old o ON n.doc_id = o.doc_id",
)
def synced_documents(spark, sf):
    """Manifests against an older index: labelled documents only, some with another title or length."""
    d = B.docs(spark, sf)
    labels = B.read(spark, sf, "labels")
    no = F.lit(False).alias("pending")
    old = d.join(labels, "doc_id").select(
        "doc_id",
        F.when((F.col("quality") == 0) & (F.col("toxic") == 0), F.concat(F.lit("old "), "title")).otherwise(F.col("title")).alias("title"),
        F.when(F.col("toxic") == 1, F.col("chars") - 1).otherwise(F.col("chars")).alias("chars"),
        no,
    )
    return V.sync_documents(d.filter("pages is null or pages > 1").select("doc_id", "title", "chars", no), old)


@register(
    "synced_notes",
    "SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' WHEN toxic = 1 THEN 'reindex' ELSE 'keep' END AS action "
    "FROM (SELECT doc_id FROM documents WHERE lang <> 'en') n FULL JOIN labels o ON n.doc_id = o.doc_id",
)
def synced_notes(spark, sf):
    d = B.read(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"))
    old = d.join(B.read(spark, sf, "labels"), "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "old").otherwise(F.col("hash")).alias("hash")
    )
    return V.sync_notes(d.filter("lang <> 'en'"), old)


@register(
    "stamp_changes",
    "SELECT coalesce(a.page_id, b.page_id) AS path, CASE WHEN a.page_id IS NULL THEN 'added' WHEN b.page_id IS NULL THEN 'removed' ELSE 'changed' END AS change "
    "FROM (SELECT * FROM pages WHERE url LIKE 'https%') a FULL JOIN (SELECT * FROM pages WHERE url LIKE '%example.com%') b ON a.page_id = b.page_id "
    "WHERE a.page_id IS NULL OR b.page_id IS NULL OR a.url LIKE '%/en/%'",
)
def stamp_changes(spark, sf):
    p = B.read(spark, sf, "pages").select(F.col("page_id").alias("path"), F.length("html").alias("size"), F.lit(1).alias("mtime"), "url")
    now = p.filter("url like '%example.com%'").withColumn("mtime", F.when(F.col("url").like("%/en/%"), 2).otherwise(1))
    return V.stamp_changes(p.filter("url like 'https%'"), now)


@register(
    "moved_documents",
    f"{WITH}, t AS (SELECT doc_id, regexp_replace(source, '^.*/', '') AS title, collection FROM docs) SELECT doc_id, CASE WHEN out = 'moved' OR out = 'there' THEN 'global' ELSE 'project' END AS scope, out AS outcome FROM ("
    "SELECT doc_id, CASE WHEN collection = 'docs' THEN 'there' WHEN lower(title) IN (SELECT lower(title) FROM t WHERE collection = 'docs') THEN 'title_taken' ELSE 'moved' END AS out FROM t "
    "WHERE doc_id IN (SELECT doc_id FROM labels))",
)
def moved_documents(spark, sf):
    rows = B.docs(spark, sf).select(
        "doc_id", F.substring_index("source", "/", -1).alias("title"), F.when(F.col("collection") == "wiki", "project").otherwise("global").alias("scope")
    )
    return V.move_scope(rows, B.read(spark, sf, "labels"), "global")


@register(
    "listed_everything",
    f"{WITH} SELECT doc_id, title, CASE WHEN collection = 'wiki' THEN 'project' ELSE 'global' END AS scope, CASE WHEN collection = 'docs' THEN s END AS shelves "
    "FROM docs LEFT JOIN (SELECT doc_id, string_agg(DISTINCT shelf, ',' ORDER BY shelf) AS s FROM shelves GROUP BY doc_id) USING (doc_id)",
)
def listed_everything(spark, sf):
    """Notes are the project's, documents global; the shelves of the former are not shown."""
    d = B.docs(spark, sf)
    rows = C.list_everything(d.filter("collection = 'wiki'"), d.filter("collection = 'docs'"), B.shelves(spark, sf))
    return rows.select("doc_id", "title", "scope", F.array_join("shelves", ",").alias("shelves"))


@register(
    "library_status",
    f"{WITH}, {B.CHUNKS}, own AS (SELECT *, CASE WHEN collection = 'wiki' THEN 'project' ELSE 'global' END AS scope FROM docs), "
    "c AS (SELECT scope, count(*) AS chunks, sum(CAST(doc_id NOT IN (SELECT doc_id FROM pending) AS BIGINT)) AS ready FROM chunks JOIN own USING (doc_id) GROUP BY scope) "
    "SELECT scope, sum(CAST(collection = 'docs' AS BIGINT)) AS docs, sum(CAST(collection = 'wiki' AS BIGINT)) AS wiki, sum(coalesce(pages, 0)) AS pages, "
    "(SELECT chunks FROM c WHERE c.scope = own.scope) AS chunks, (SELECT ready FROM c WHERE c.scope = own.scope) AS ready, "
    "(SELECT count(DISTINCT shelf) FROM shelves JOIN own AS o USING (doc_id) WHERE o.scope = own.scope) AS shelves, "
    "(SELECT count(*) FROM pending JOIN own AS o USING (doc_id) WHERE o.scope = own.scope) AS reading, "
    "(SELECT count(*) FROM embeddings JOIN own AS o ON vec_id = o.doc_id WHERE o.scope = own.scope) AS done FROM own GROUP BY scope",
    big=["docs", "wiki", "pages", "chunks", "ready", "shelves", "reading", "done"],
)
def library_status(spark, sf):
    d = B.docs(spark, sf)
    tables = {"docs": d, "chunks": B.chunks(spark, sf), "shelves": B.shelves(spark, sf), "ocr_pending": B.ocr_pending(spark, sf), "vectors": B.vectors(spark, sf)}
    owned = {"project": d.filter("collection = 'wiki'").select("doc_id"), "global": d.filter("collection = 'docs'").select("doc_id")}
    return C.library_status({scope: {name: t.join(ids, "doc_id", "left_semi") for name, t in tables.items()} for scope, ids in owned.items()}, "local:toy#mean")


@register(
    "shelves_after_move",
    f"{WITH}, t AS (SELECT doc_id, lower(regexp_replace(source, '^.*/', '')) AS title, collection FROM docs), "
    "gone AS (SELECT doc_id FROM t JOIN labels USING (doc_id) WHERE collection = 'docs' AND title NOT IN (SELECT title FROM t WHERE collection = 'wiki')) "
    "SELECT doc_id, shelf FROM shelves WHERE doc_id NOT IN (FROM gone)",
)
def shelves_after_move(spark, sf):
    """All labelled documents are asked to move to the project."""
    rows = B.docs(spark, sf).select(
        "doc_id", F.substring_index("source", "/", -1).alias("title"), F.when(F.col("collection") == "wiki", "project").otherwise("global").alias("scope")
    )
    return V.shelves_after_move(B.shelves(spark, sf), V.move_scope(rows, B.read(spark, sf, "labels"), "project"))


@register(
    "placement_counts",
    f"{WITH}, {FILES_SQL} SELECT scope, min(shelf) AS shelf, count(*) AS files, sum(CAST(versions > 0 AS BIGINT)) AS replacing FROM ("
    "SELECT CASE WHEN source LIKE '/kb/src1/%' THEN 'project' ELSE 'global' END AS scope, CASE WHEN source LIKE '/kb/%/%' AND source NOT LIKE '/kb/src1/%' THEN split_part(source, '/', 3) END AS shelf, "
    "coalesce(n, 0) AS versions FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM pairs GROUP BY file_id) USING (file_id)) GROUP BY scope, lower(shelf)",
    big=["replacing"],
)
def placement_counts(spark, sf):
    return V.placement_counts(V.import_plan(*_files(spark, sf), project_root="/kb/src1/", added_folder="/kb"))


@register(
    "mirrored_notes",
    "SELECT d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN 'added' WHEN l.toxic = 1 THEN 'updated' ELSE 'exists' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def mirrored_notes(spark, sf):
    d = B.read(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    copies = d.join(B.read(spark, sf, "labels").withColumnRenamed("doc_id", "path"), "path").select(
        "path", F.when(F.col("toxic") == 1, F.lit("")).otherwise(F.col("content")).alias("content")
    )
    return V.mirror_status(d, copies).select("path", "status")


@register(
    "unused_names",
    f"{WITH} SELECT page_id FROM pages WHERE regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') NOT IN (SELECT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') FROM pages WHERE url LIKE 'http:%')",
)
def unused_names(spark, sf):
    p = B.read(spark, sf, "pages").select("page_id", "url", F.regexp_replace("url", "[?#].*$", "").alias("s"))
    p = p.withColumn("source", F.regexp_replace("s", "^.*/$", "/ "))
    return C.unused_names(p, p.filter("url like 'http:%'")).select("page_id")


@register(
    "latest_texts",
    "SELECT conv_id AS doc_id, max(turn) AS stage, md5(arg_max(text, turn)) AS digest FROM conversations GROUP BY conv_id",
)
def latest_texts(spark, sf):
    c = B.read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("stage"), "text")
    return V.latest_text(c).select("doc_id", "stage", F.md5("text").alias("digest"))


@register(
    "rechunked",
    f"{WITH}, {B.CHUNKS} SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND count(*) > 1 THEN 'rebuild' "
    "WHEN doc_id IN (SELECT doc_id FROM pending) THEN 'edit' ELSE 'same' END AS action FROM chunks GROUP BY doc_id",
)
def rechunked(spark, sf):
    """An older chunking against the present one: other texts for some documents, chunks missing for others."""
    new = B.chunks(spark, sf).select("doc_id", (F.col("chunk_id") - F.col("doc_id") * (1 << 24)).alias("ord"), "page", "heading", "content")
    marks = B.read(spark, sf, "labels").select("doc_id", "quality", "toxic")
    old = new.join(marks, "doc_id", "left").withColumn(
        "content", F.when(F.col("quality") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    ).filter("coalesce(toxic, 0) = 0 or ord = 0")
    return chunking.diff_chunks(old, new).select("doc_id", "action")


# --- titles for a planner -------------------------------------------------------------------------

GROUPS_SQL = """t AS (SELECT DISTINCT regexp_replace(regexp_replace(p, '/(?:README|readme|CHANGELOG|index)\\.(?:md|markdown)$', ''), '(?i)\\.(?:md|markdown|mdx|txt|pdf)$', '') AS t
    FROM (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS p FROM pages)),
  g AS (SELECT regexp_replace(t, '\\d+', '#', 'g') AS mask, count(*) AS titles, min(t) AS first, max(t) AS last, string_agg(t, '; ' ORDER BY t) AS listed FROM t GROUP BY 1),
  l AS (SELECT mask, titles, first, CASE WHEN titles > 3 THEN mask || ' ×' || titles || ' (' || first || ' … ' || last || ')' ELSE listed END AS line FROM g)"""


def _titles(spark, sf):
    return B.read(spark, sf, "pages").select(
        F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "").alias("title")
    )


@register("title_groups", f"WITH {GROUPS_SQL} SELECT mask, titles, line FROM l")
def title_groups(spark, sf):
    return planning.title_groups(_titles(spark, sf)).select("mask", "titles", "line")


@register(
    "planner_contents",
    f"""WITH {GROUPS_SQL}, n AS (SELECT *, row_number() OVER (ORDER BY first) AS pos, sum(length(line) + 2) OVER (ORDER BY first) AS used FROM l),
  o AS (SELECT *, max(CAST(CASE WHEN pos = 1 THEN used ELSE used - 2 END > 5000 AS INT)) OVER (ORDER BY pos) AS stop FROM n)
  SELECT pos, mask, titles, line FROM o WHERE stop = 0""",
)
def planner_contents(spark, sf):
    return planning.contents(_titles(spark, sf))
