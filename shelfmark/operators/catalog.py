"""The catalogue: documents and notes, shelves, listings and counts.

``docs``: doc_id, title, collection ('docs' or 'wiki'), kind, source, path, pages, chars, hash,
added_at.  ``shelves``: doc_id, shelf (case does not matter).  ``ocr_pending``: doc_id.
Changes are new snapshots made by joins; nothing is updated in place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.text import normalize_shelves, page_runs, source_path
from shelfmark.operators.semantic import progress

LIST_LIMIT = 100
SHORT_LIST = 50
GROUPS = 12


def list_docs(docs: DataFrame, collection: str | None = None) -> DataFrame:
    """Newest first; without a collection, documents before notes."""
    if collection:
        return docs.filter(F.col("collection") == collection).orderBy(F.desc("added_at"), "doc_id")
    return docs.orderBy("collection", F.desc("added_at"), "doc_id")


def stats(docs: DataFrame) -> DataFrame:
    """One row: docs, wiki, pages. Several knowledge bases: pass their union."""

    def of(kind: str) -> Column:
        return F.coalesce(F.sum((F.col("collection") == kind).cast("bigint")), F.lit(0)).alias(kind)

    pages = F.coalesce(F.sum(F.coalesce(F.col("pages"), F.lit(0)).cast("bigint")), F.lit(0))
    return docs.agg(of("docs"), of("wiki"), pages.alias("pages"))


def shelf_counts(docs: DataFrame, shelves: DataFrame) -> DataFrame:
    """Per shelf: name, docs, notes."""
    on = shelves.join(docs.select("doc_id", "collection"), "doc_id")
    return on.groupBy(F.lower("shelf").alias("folded")).agg(
        F.min("shelf").alias("name"),
        F.sum((F.col("collection") == "docs").cast("bigint")).alias("docs"),
        F.sum((F.col("collection") == "wiki").cast("bigint")).alias("notes"),
    ).select("name", "docs", "notes")


def shelf_list(docs: DataFrame, shelves: DataFrame, used: list[str] | None) -> DataFrame:
    """The shelves with their sizes, and whether a project that chose ``used`` uses each."""
    flag = F.lit(True) if used is None else F.lower("name").isin([u.lower() for u in used])
    return shelf_counts(docs, shelves).withColumn("used", flag)


def visible(docs: DataFrame, shelves: DataFrame, any_of: list[str] | None = None, only: str | None = None) -> DataFrame:
    """Documents a shelf filter lets through.

    ``only``: those on that shelf. ``any_of``: those on no shelf or on one of these (an empty list:
    on none). Neither: all.
    """
    if only is not None:
        return docs.join(shelves.filter(F.lower("shelf") == only.lower()).select("doc_id"), "doc_id", "left_semi")
    if any_of is None:
        return docs
    chosen = F.lower("shelf").isin([s.lower() for s in any_of]) if any_of else F.lit(False)
    placed = shelves.groupBy("doc_id").agg(F.max(chosen).alias("_chosen"))
    return docs.join(placed, "doc_id", "left").filter(F.coalesce("_chosen", F.lit(True))).drop("_chosen")


def shelf_map(shelves: DataFrame) -> DataFrame:
    """doc_id and its shelves, sorted."""
    return shelves.groupBy("doc_id").agg(F.sort_array(F.collect_set("shelf")).alias("shelves"))


def scoped(project: DataFrame | None, everywhere: DataFrame) -> DataFrame:
    """One frame over both knowledge bases with their scope."""
    rows = everywhere.withColumn("scope", F.lit("global"))
    return rows if project is None else project.withColumn("scope", F.lit("project")).unionByName(rows)


def visible_scoped(
    project: DataFrame | None,
    everywhere: DataFrame,
    shelves: DataFrame,
    any_of: list[str] | None = None,
    only: str | None = None,
) -> DataFrame:
    """What can be found here: the project's own and the visible of the global; one shelf asked for is global only."""
    seen = visible(everywhere, shelves, any_of, only)
    return scoped(None if only is not None else project, seen)


def list_everything(project: DataFrame | None, everywhere: DataFrame, shelves: DataFrame, collection: str | None = None) -> DataFrame:
    """All documents of both knowledge bases, whatever shelves are in use, with ``scope`` and ``shelves``.

    Shelves group the global knowledge base only: a project's document has none (null), also if a global one has its id.
    """
    rows = scoped(project, everywhere).drop("shelves")
    rows = rows.filter(F.col("collection") == collection) if collection else rows
    return rows.join(shelf_map(shelves).withColumn("scope", F.lit("global")), ["doc_id", "scope"], "left")


def locate(rows: DataFrame) -> DataFrame:
    """Per doc_id the row of the first scope that has it (project before global)."""
    first = F.when(F.col("scope") == "project", 0).otherwise(1)
    whole = F.struct(*[c for c in rows.columns if c != "doc_id"])
    return rows.groupBy("doc_id").agg(F.min_by(whole, first).alias("r")).select("doc_id", "r.*")


def reachable(rows: DataFrame, shelves: DataFrame, used: list[str] | None) -> DataFrame:
    """Whether each located document (doc_id, scope) may be seen: a project's own, or global ones on no or a used shelf."""
    if used is None:
        return rows.withColumn("seen", F.lit(True))
    placed = shelves.groupBy("doc_id").agg(F.max(F.lower("shelf").isin([u.lower() for u in used])).alias("_used"))
    seen = (F.col("scope") == "project") | F.coalesce("_used", F.lit(True))
    return rows.join(placed, "doc_id", "left").withColumn("seen", seen).drop("_used")


def change_collection(docs: DataFrame, ids: DataFrame, to: str) -> DataFrame:
    """Documents made notes, or notes documents."""
    hit = ids.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    kind = "note" if to == "wiki" else "text"
    return (
        docs.join(hit, "doc_id", "left")
        .withColumn("collection", F.when(F.col("_hit"), to).otherwise(F.col("collection")))
        .withColumn("kind", F.when(F.col("_hit"), kind).otherwise(F.col("kind")))
        .select(docs.columns)
    )


def ocr_backlog(docs: DataFrame, ocr_pending: DataFrame) -> DataFrame:
    return docs.join(ocr_pending.select("doc_id"), "doc_id", "left_semi").orderBy("added_at", "doc_id")


# --- snapshots ------------------------------------------------------------------------------------


def replace_rows(table: DataFrame, ids: DataFrame, fresh: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``table`` without the rows of ``ids`` (column ``key``), plus the fresh ones."""
    kept = table.join(ids.select(key).distinct(), key, "left_anti")
    return kept if fresh is None else kept.unionByName(fresh)


def put_docs(tables: dict[str, DataFrame], docs: DataFrame, chunks: DataFrame) -> dict[str, DataFrame]:
    """Replace documents with all their chunks; their vectors go, to be made again."""
    return {
        **tables,
        "docs": replace_rows(tables["docs"], docs, docs),
        "chunks": replace_rows(tables["chunks"], docs, chunks),
        "vectors": replace_rows(tables["vectors"], docs),
    }


def delete_docs(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Documents gone from every table."""
    return {name: replace_rows(table, ids) for name, table in tables.items()}


def rename_docs(tables: dict[str, DataFrame], titles: DataFrame) -> dict[str, DataFrame]:
    """New titles (doc_id, new_title) on documents and chunks; the vectors of these go."""

    def retitled(df: DataFrame) -> DataFrame:
        named = df.join(titles.select("doc_id", "new_title"), "doc_id", "left")
        return named.withColumn("title", F.coalesce("new_title", "title")).drop("new_title").select(df.columns)

    return {
        **tables,
        "docs": retitled(tables["docs"]),
        "chunks": retitled(tables["chunks"]),
        "vectors": replace_rows(tables["vectors"], titles),
    }


def set_chunk_contents(tables: dict[str, DataFrame], edits: DataFrame) -> dict[str, DataFrame]:
    """New texts for chunks (chunk_id, new_content); only their vectors go."""
    chunks = tables["chunks"]
    edited = (
        chunks.join(edits.select("chunk_id", "new_content"), "chunk_id", "left")
        .withColumn("content", F.coalesce("new_content", "content"))
        .select(chunks.columns)
    )
    return {**tables, "chunks": edited, "vectors": replace_rows(tables["vectors"], edits, key="chunk_id")}


def set_shelves(shelves: DataFrame, ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """Put documents on exactly these shelves; spellings that differ in case only count once."""
    new = fresh.groupBy("doc_id", F.lower("shelf").alias("_f")).agg(F.min("shelf").alias("shelf")).drop("_f")
    return replace_rows(shelves, ids, new.select(shelves.columns))


def set_pending(ocr_pending: DataFrame, ids: DataFrame, pending: bool) -> DataFrame:
    rest = replace_rows(ocr_pending, ids)
    return rest.unionByName(ids.select("doc_id").distinct()) if pending else rest


def canonical_shelves(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """Shelves (doc_id, shelf) spelled as an existing shelf of the same name; new ones as given."""
    spelled = known.groupBy(F.lower("shelf").alias("_f")).agg(F.min("shelf").alias("_known"))
    clean = wanted.withColumn("shelf", F.explode(normalize_shelves(F.array("shelf"))))
    return (
        clean.withColumn("_f", F.lower("shelf"))
        .join(spelled, "_f", "left")
        .withColumn("shelf", F.coalesce("_known", "shelf"))
        .drop("_f", "_known")
    )


def rename_shelf(shelves: DataFrame, old: str, new: str | None) -> DataFrame:
    """A shelf renamed everywhere, or deleted; a document on both names ends on one."""
    hit = F.lower("shelf") == old.lower()
    if new is None:
        return shelves.filter(~hit)
    moved = shelves.withColumn("shelf", F.when(hit, F.lit(new)).otherwise(F.col("shelf")))
    return moved.groupBy("doc_id", F.lower("shelf").alias("_f")).agg(F.min("shelf").alias("shelf")).select(shelves.columns)


def rename_choice(choices: DataFrame, old: str, new: str | None) -> DataFrame:
    """The same change in every project's chosen shelves (array column ``shelves``)."""
    kept = F.filter("shelves", lambda s: F.lower(s) != old.lower())
    if new is None:
        return choices.withColumn("shelves", kept)
    swapped = F.transform("shelves", lambda s: F.when(F.lower(s) == old.lower(), F.lit(new)).otherwise(s))
    return choices.withColumn("shelves", F.array_distinct(swapped))


def choose_shelves(names: DataFrame, docs: DataFrame, shelves: DataFrame) -> DataFrame:
    """A project's choice checked: name as typed, the shelf's own spelling, or null for an unknown one."""
    known = shelf_counts(docs, shelves).select(F.lower("name").alias("_f"), F.col("name").alias("shelf"))
    return names.withColumn("_f", F.lower(F.trim("name"))).join(known, "_f", "left").drop("_f")


# --- listings -------------------------------------------------------------------------------------


def matching(docs: DataFrame, match: str | None) -> DataFrame:
    """Title or source holds the text, ignoring case; everything for a blank one."""
    word = (match or "").strip().lower()
    if not word:
        return docs
    return docs.filter(F.contains(F.lower("title"), F.lit(word)) | F.contains(F.lower("source"), F.lit(word)))


def list_page(docs: DataFrame, match: str | None = None, offset: int = 0, limit: int = LIST_LIMIT) -> DataFrame:
    """A page of the listing: documents then notes, each by title."""
    return matching(docs, match).orderBy("collection", "title", "doc_id").offset(max(0, offset)).limit(limit)


def list_header(docs: DataFrame, match: str | None = None, offset: int = 0, limit: int = LIST_LIMIT) -> DataFrame:
    """One row: docs, notes, first and last number shown, and how many are left."""
    found = matching(docs, match).agg(
        F.count_if(F.col("collection") == "docs").alias("docs"), F.count_if(F.col("collection") == "wiki").alias("notes")
    )
    n = F.col("docs") + F.col("notes")
    last = F.least(n, F.lit(offset + limit).cast("bigint"))
    return found.select(
        "docs", "notes", F.lit(offset + 1).cast("bigint").alias("first"), last.alias("last"), (n - last).alias("rest")
    )


def folder_of(source: Column | str, collection: Column | str = "collection") -> Column:
    """The folder a document was imported from; null for notes and for bare names."""
    parts = F.filter(F.split(source, r"[\\/]"), lambda p: p != "")
    col = F.col(collection) if isinstance(collection, str) else collection
    return F.when((col == "docs") & (F.size(parts) > 1), F.get(parts, F.size(parts) - 2))


def top_groups(rows: DataFrame, name: str, limit: int = GROUPS) -> DataFrame:
    """The largest groups by a name column: name, n; and how many groups there are in all (``groups``)."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("g")).scalar()
    return counts.orderBy(F.desc("n"), "name").limit(limit).select("name", "n", total.alias("groups"))


def match_docs(docs: DataFrame, query: str) -> DataFrame:
    """What a query names: its id, else its exact title, else every title (or id) with all its words."""
    q = query.strip().lower()
    if not q:
        return docs
    both = F.lower(F.concat_ws(" ", "title", F.col("doc_id").cast("string")))
    words = F.lit(True)
    for word in q.split():
        words = words & F.contains(both, F.lit(word))
    tier = (
        F.when(F.lower(F.col("doc_id").cast("string")) == q, 1).when(F.lower("title") == q, 2).when(words, 3)
    )
    tiered = docs.withColumn("_tier", tier).filter("_tier is not null")
    return tiered.filter(F.col("_tier") == tiered.agg(F.min("_tier")).scalar()).drop("_tier")


def words_list(docs: DataFrame, query: str, limit: int = SHORT_LIST) -> DataFrame:
    """A short list: all words in the title or id."""
    both = F.lower(F.concat_ws(" ", "title", F.col("doc_id").cast("string")))
    for word in query.lower().split():
        docs = docs.filter(F.contains(both, F.lit(word)))
    return docs.orderBy("collection", F.desc("added_at"), "doc_id").limit(limit)


def catalog(
    docs: DataFrame, shelves: DataFrame, any_of: list[str] | None = None, max_notes: int = 40, max_docs: int = 15
) -> DataFrame:
    """The newest notes and documents with the counts around them: part, pos, title, doc_id, docs, wiki, pages, hidden."""
    seen = visible(docs, shelves, any_of)
    facts = stats(seen)
    everything = docs.agg(F.count(F.lit(1)).alias("n")).scalar()

    def newest(kind: str, part: str, limit: int) -> DataFrame:
        top = seen.filter(F.col("collection") == kind).orderBy(F.desc("added_at"), "doc_id").limit(limit)
        order = Window.orderBy(F.desc("added_at"), "doc_id")
        return top.select(
            F.lit(part).alias("part"), F.row_number().over(order).cast("bigint").alias("pos"), "title", "doc_id"
        )

    rows = newest("wiki", "note", max_notes).unionByName(newest("docs", "recent", max_docs))
    counted = rows.select("*", *[facts.select(c).scalar().alias(c) for c in ("docs", "wiki", "pages")])
    return counted.withColumn("hidden", everything - F.col("docs") - F.col("wiki"))


def folder_shelf(root: str, path: Column | str) -> Column:
    """The shelf suggested for a file below an added folder: its first subfolder, if it is in one."""
    path = F.col(path) if isinstance(path, str) else path
    base = root.rstrip("/") + "/"
    rest = F.substring(path, F.lit(len(base) + 1), F.length(path))
    return F.when(F.startswith(path, F.lit(base)) & F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1))


def browse_rows(docs: DataFrame, notes: DataFrame, ocr_pending: DataFrame) -> DataFrame:
    """Every document and note with tags and unreviewed flag (notes) or OCR flag (documents).

    ``notes``: doc_id, tags, review.
    """
    waiting = ocr_pending.select("doc_id").distinct().withColumn("_wait", F.lit(True))
    wiki = F.col("collection") == "wiki"
    return (
        docs.join(notes.select("doc_id", "tags", "review"), "doc_id", "left")
        .join(waiting, "doc_id", "left")
        .withColumn("tags", F.when(wiki, F.coalesce("tags", F.array().cast("array<string>"))))
        .withColumn("unreviewed", wiki & F.coalesce(F.col("review") == "pending", F.lit(False)))
        .withColumn("reading", ~wiki & F.col("_wait").isNotNull())
        .drop("_wait", "review")
    )


def status(docs: DataFrame, chunks: DataFrame, shelves: DataFrame, ocr_pending: DataFrame) -> DataFrame:
    """One row: docs, wiki, pages, chunks, shelves, reading."""
    one = stats(docs)
    return one.select(
        "*",
        chunks.agg(F.count(F.lit(1))).scalar().alias("chunks"),
        shelf_counts(docs, shelves).agg(F.count(F.lit(1))).scalar().alias("shelves"),
        docs.join(ocr_pending, "doc_id", "left_semi").agg(F.count(F.lit(1))).scalar().alias("reading"),
    )


def library_status(scopes: dict[str, dict[str, DataFrame]], model: str) -> DataFrame:
    """A row for each scope: docs, wiki, pages, chunks, shelves, reading as in ``status``, and how far the vectors are:
    ``done`` of ``ready`` chunks (those whose document does not wait for OCR) have one of this model.

    ``scopes``: a name ("project", "global") with its tables docs, chunks, shelves, ocr_pending, vectors. Each row is made
    of whole counts; nothing but them leaves its task.
    """
    made = []
    for name, t in scopes.items():
        far = progress(t["chunks"], t["vectors"], t["ocr_pending"], model)
        row = status(t["docs"], t["chunks"], t["shelves"], t["ocr_pending"]).select("*", far.select("done").scalar().alias("done"), far.select("total").scalar().alias("ready"))
        made.append(row.withColumn("scope", F.lit(name)))
    return reduce(DataFrame.unionByName, made)


def ocr_class(chars: Column, total: Column) -> Column:
    """How much of a page's text came from OCR: 'mostly' (half or more), 'some' (20 characters or more) or null."""
    return F.when(chars >= total * 0.5, "mostly").when(chars >= 20, "some")


def import_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def result_groups(hits: DataFrame) -> DataFrame:
    """Hits of a query grouped for display: one entry per (collection, title) in rank order with its pages."""
    return hits.groupBy("query_id", "collection", "title").agg(
        F.min("rank").alias("rank"), F.sort_array(F.collect_set("page")).alias("pages")
    )


#: Entries of a result line; the others are only counted.
SHOWN = 3


def result_lines(hits: DataFrame, shown: int = SHOWN) -> DataFrame:
    """What a search's result says in one line: query_id, hits, entries (the first ``shown`` documents and notes in rank
    order, documents with their pages as runs), more (how many entries are left out).

    ``hits``: query_id, rank, collection, title, page.
    """
    groups = result_groups(hits)
    pages = page_runs(F.filter("pages", lambda p: p.isNotNull()))
    named = F.when((F.col("collection") != "wiki") & (pages != ""), F.concat("title", F.lit(" p."), pages)).otherwise(F.col("title"))
    order = Window.partitionBy("query_id").orderBy("rank", "collection", "title")
    first = groups.select("query_id", named.alias("entry"), F.row_number().over(order).alias("at")).filter(F.col("at") <= shown)
    first = first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "entry"))), lambda x: x["entry"]).alias("entries"))
    counts = groups.groupBy("query_id").agg(F.count(F.lit(1)).alias("groups"))
    total = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    whole = total.join(counts, "query_id").join(first, "query_id")
    return whole.select("query_id", "hits", "entries", F.greatest(F.col("groups") - shown, F.lit(0)).cast("bigint").alias("more"))


#: Names a notice gives; the others are only counted.
NAMED = 5


def search_notices(queries: DataFrame, missing: DataFrame, importing: DataFrame, reading: DataFrame, named: int = NAMED) -> DataFrame:
    """What must be said beside a search's hits: query_id, unknown (parts nothing mentions, in order, as one text or null),
    importing and importing_names (files not searchable yet), reading and reading_names (documents whose pictures OCR has
    not read yet), each with the first few names by time and an ellipsis if there are more.

    ``queries``: query_id. ``missing``: query_id, part, ord. ``importing`` and ``reading``: name, at.
    """
    parts = missing.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("ord", "part"))).alias("p"))
    unknown = F.array_join(F.transform("p", lambda x: x["part"]), ", ")

    def waiting(files: DataFrame, what: str) -> DataFrame:
        total = files.agg(F.count(F.lit(1)).alias("n"))
        first = files.orderBy("at", "name").limit(named).agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("f"))
        text = F.concat(F.array_join(F.transform("f", lambda x: x["name"]), ", "), F.when(F.col("n") > named, ", …").otherwise(""))
        return total.select("n", first.scalar().alias("f")).select(F.col("n").alias(what), F.when(F.col("n") > 0, text).alias(f"{what}_names"))

    out = queries.select("query_id").join(parts, "query_id", "left").select("query_id", unknown.alias("unknown"))
    for facts in (waiting(importing, "importing"), waiting(reading, "reading")):
        out = out.select("*", *[facts.select(c).scalar().alias(c) for c in facts.columns])
    return out


def unused_names(files: DataFrame, docs: DataFrame) -> DataFrame:
    """Files whose base name is not yet a document's source name."""
    have = docs.select(source_path("source", 1).alias("_name")).distinct()
    return files.withColumn("_name", source_path("source", 1)).join(have, "_name", "left_anti").drop("_name")
