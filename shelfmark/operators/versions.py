"""Identity, duplicates, versions, titles that can be told apart, and incremental sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfmark.functions.text import source_path
from shelfmark.session import checkpoint


def content_id(content: Column | str) -> Column:
    """The id shown for a content. Twelve digits do not tell contents apart at scale; ``content_key`` does."""
    return F.concat(F.lit("k-"), F.substring(F.sha2(content, 256), 1, 12))


def content_key(content: Column | str) -> Column:
    """What contents are grouped and joined by: the whole SHA-256."""
    return F.sha2(content, 256)


def note_id(path: Column | str, project: bool = False) -> Column:
    """From the path inside the content folder; a project's notes hash differently."""
    path = F.col(path) if isinstance(path, str) else path
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    salted = F.concat(F.lit("project:"), path) if project else path
    return F.concat(F.lit("w-"), F.substring(F.sha2(salted, 256), 1, 12))


def exact_duplicates(rows: DataFrame, content: str, order: str = "added_at") -> DataFrame:
    """One row per content: content_id, the first doc_id to bring it, how many copies. Equal means equal in all 256 bits.

    Copies are counted map-side, so a text with any number of copies costs one row per task.
    """
    return (
        rows.select(content_key(content).alias("_key"), "doc_id", order)
        .groupBy("_key")
        .agg(F.min_by("doc_id", F.struct(order, "doc_id")).alias("doc_id"), F.count(F.lit(1)).alias("copies"))
        .select(F.concat(F.lit("k-"), F.substring("_key", 1, 12)).alias("content_id"), "doc_id", "copies")
    )


def import_status(files: DataFrame, known: DataFrame, other_scope: DataFrame) -> DataFrame:
    """New files (content_key, ...) marked ``exists``, ``in_other_scope`` or ``added``.

    ``known`` and ``other_scope``: content_key, the whole digest.
    """
    here = known.select("content_key").distinct().withColumn("_here", F.lit(True))
    there = other_scope.select("content_key").distinct().withColumn("_there", F.lit(True))
    state = F.when(F.col("_there"), "in_other_scope").when(F.col("_here"), "exists").otherwise("added")
    marked = files.join(here, "content_key", "left").join(there, "content_key", "left")
    return marked.withColumn("status", state).drop("_here", "_there")


def previous_versions(files: DataFrame, docs: DataFrame, known: bool = False) -> DataFrame:
    """What a new file would replace: per file the number of versions, the first one's title and the newest id.

    ``files``: file_id (as its content's id), source; ``docs``: doc_id, source, title, added_at. A path replaces documents
    of the same path or an upload of the same name; an upload replaces any document of that name. A file whose content
    is a document already replaces nothing and is left out, unless ``known`` asks for all files.
    Documents are reduced to one row per key before the join, so a name many share stays one row.
    """

    def keyed(key: Column) -> DataFrame:
        return docs.withColumn("_key", key).groupBy("_key").agg(
            F.count(F.lit(1)).alias("n"),
            F.min(F.struct("added_at", "doc_id", "title")).alias("first"),
            F.max(F.struct("added_at", "doc_id")).alias("last"),
        )

    upload = F.startswith("source", F.lit("upload:"))
    name = source_path("source", 1)
    fresh = files if known else files.join(docs.select(F.col("doc_id").alias("file_id")).distinct(), "file_id", "left_anti")
    asked = fresh.select("file_id", "source", upload.alias("up"), name.alias("name"))
    by_name = asked.filter("up").select("file_id", F.concat(F.lit("name:"), "name").alias("_key"))
    by_path = asked.filter("not up").select(
        "file_id",
        F.explode(
            F.array(F.concat(F.lit("path:"), "source"), F.concat(F.lit("path:upload:"), "name"))
        ).alias("_key"),
    )
    groups = keyed(F.concat(F.lit("name:"), name)).unionByName(keyed(F.concat(F.lit("path:"), "source")))
    return (
        by_name.unionByName(by_path)
        .join(groups, "_key")
        .groupBy("file_id")
        .agg(
            F.sum("n").alias("versions"),
            F.min("first")["title"].alias("first_title"),
            F.max("last")["doc_id"].alias("last_id"),
        )
    )


def replace_versions(docs: DataFrame, key: str = "source") -> DataFrame:
    """Versions of one source folded into the newest: it takes the oldest one's title.

    Returns key, doc_id (newest), title, versions, added_at. Shelves are unioned by ``merged_shelves``.
    """
    return docs.groupBy(key).agg(
        F.max_by("doc_id", F.struct("added_at", "doc_id")).alias("doc_id"),
        F.min_by("title", F.struct("added_at", "doc_id")).alias("title"),
        F.count(F.lit(1)).alias("versions"),
        F.max("added_at").alias("added_at"),
    )


def merged_shelves(docs: DataFrame, shelves: DataFrame, key: str = "source") -> DataFrame:
    """key, shelf: every shelf one of the versions is on."""
    return docs.select("doc_id", key).join(shelves, "doc_id").select(key, "shelf").distinct()


def numbered(df: DataFrame, key: str, order: str, block: Column, out: str = "n") -> DataFrame:
    """Number rows within ``key`` by ``order``, without one task per key.

    ``block`` must not fall as ``order`` rises; rows are counted per block, and only the block
    counts are summed up along a key.
    """
    marked = df.withColumn("_block", block)
    counts = marked.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(key, "_block").orderBy(order)
    return (
        marked.join(offsets, [key, "_block"])
        .withColumn(out, F.row_number().over(inside) + F.col("_offset"))
        .drop("_block", "_offset")
    )


def distinct_titles(docs: DataFrame, block: Column | None = None) -> DataFrame:
    """doc_id, title: the file name, or the shortest path ending that no other same-named document has.

    Uploads (and documents whose whole path repeats) are numbered instead. ``docs``: doc_id, source.
    Every ending is counted once, map-side; unique endings name their document without joining the
    crowd back.
    """
    if block is None:  # neighbours in the order of ids, which may be names
        named = docs.schema["doc_id"].dataType.simpleString() == "string"
        block = F.substring("doc_id", 1, 5) if named else F.floor(F.col("doc_id") / 65536)
    upload = F.startswith("source", F.lit("upload:"))
    parts = F.size(F.filter(F.split("source", r"[\\/]+"), lambda p: p != ""))
    depth = F.when(upload, 1).otherwise(F.greatest(parts, F.lit(1)))
    endings = docs.select("doc_id", upload.alias("up"), F.explode(F.sequence(F.lit(1), depth)).alias("k"), "source")
    named = endings.select("doc_id", "k", source_path("source", F.col("k")).alias("ending"))
    unique = named.groupBy("ending").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id"), F.min("k").alias("k")
    ).filter("n = 1")
    best = unique.groupBy("doc_id").agg(F.min_by("ending", "k").alias("title"))
    told = docs.select("doc_id", source_path("source", 1).alias("name")).join(best, "doc_id", "left")
    crowd = numbered(told.filter("title is null"), "name", "doc_id", block)
    n = F.col("n")
    counted = crowd.select(
        "doc_id",
        F.when(n == 1, F.col("name")).otherwise(F.concat("name", F.lit(" ("), n.cast("string"), F.lit(")"))).alias("title"),
    )
    return told.filter("title is not null").select("doc_id", "title").unionByName(counted)


#: Parts that uploads are dealt to when they meet what is known of their name.
UPLOAD_PARTS = 32


def titles_by_arrival(docs: DataFrame, block: Column | None = None) -> DataFrame:
    """doc_id, title: titles as they stand when documents came one after the other and only clashing ones were renamed.

    ``docs``: doc_id, source, arrived (not null; ties by doc_id); other columns are left out, a null source counts as
    empty. The first file of a name is called by it. A later one gets the shortest ending of two parts or more that no
    earlier file of the name has, so its title never changes again; the first such one makes the first file show as many
    folders. A file whose endings all came before is numbered, and so is an upload while its name is in use; once the first
    file shows its folders, the next upload may have the bare name. Numbers follow the arrival, from 2.

    Nothing is done in order: of every ending the earliest holder is a minimum, taken in each task first, and a file's
    title is the shortest ending that it is the earliest holder of. A name that a third of all files have is one row
    where it meets others, its numbered files are counted by block (``block`` must not fall as arrivals rise).
    """
    if block is None:
        times = docs.schema["arrived"].dataType.simpleString() in ("date", "timestamp", "timestamp_ntz")
        block = F.date_trunc("hour", "arrived") if times else F.floor(F.col("arrived") / 65536)
    source = F.coalesce("source", F.lit(""))
    rows = docs.select("doc_id", F.struct("arrived", "doc_id").alias("at"), source.alias("source"), block.alias("block"))
    parts = F.size(F.filter(F.split("source", r"[\\/]+"), lambda p: p != ""))
    rows = rows.withColumn("up", F.startswith("source", F.lit("upload:"))).withColumn("depth", parts).withColumn("name", source_path("source", 1))
    endings = rows.filter("not up and depth > 1").select("at", "source", F.explode(F.sequence(F.lit(2), "depth")).alias("k"))
    held = endings.select("at", "k", source_path("source", F.col("k")).alias("ending")).groupBy("ending").agg(F.min("at").alias("at"), F.min("k").alias("k"))
    own = held.groupBy(F.col("at.doc_id").alias("doc_id")).agg(F.min_by("ending", "k").alias("own"), F.min("k").alias("k"))
    told = checkpoint(rows.join(own, "doc_id", "left"))

    first = told.groupBy("name").agg(F.min(F.when(~F.col("up"), F.struct("at", "source", "depth"))).alias("file"), F.min(F.when(F.col("up"), F.col("at"))).alias("upload"))
    two = told.filter("own is not null").select("name", "at", "k", F.row_number().over(Window.partitionBy("name").orderBy("at")).alias("n")).filter("n <= 2")
    second = two.join(first, "name").filter(F.col("at") > F.col("file.at")).groupBy("name").agg(F.min(F.struct("at", "k")).alias("next"))
    names = first.join(second, "name", "left")
    upload_first = F.col("upload").isNotNull() & (F.col("file").isNull() | (F.col("upload") < F.col("file.at")))
    bare = F.col("file").isNotNull() & ~upload_first
    moved = bare & F.col("next").isNotNull() & (F.col("file.depth") > 1)
    after = names.filter(moved & F.col("upload").isNotNull()).select("name", F.col("next.at").alias("after"), F.explode(F.sequence(F.lit(0), F.lit(UPLOAD_PARTS - 1))).alias("part"))
    uploads = told.filter("up").select("name", "at", F.pmod(F.xxhash64("doc_id"), F.lit(UPLOAD_PARTS)).cast("int").alias("part"))
    freed = uploads.join(after, ["name", "part"]).filter(F.col("at") > F.col("after")).groupBy("name").agg(F.min("at").alias("at"))
    firsts = (
        names.filter(bare).select("file.at.doc_id", F.when(moved, source_path("file.source", F.col("next.k"))).otherwise(F.col("name")).alias("first"))
        .unionByName(names.filter(upload_first).select("upload.doc_id", F.col("name").alias("first")))
        .unionByName(freed.select("at.doc_id", F.col("name").alias("first")))
    )
    titled = told.join(firsts, "doc_id", "left").withColumn("title", F.coalesce("first", "own"))
    crowd = numbered(titled.filter("title is null").select("doc_id", "at", "name", "block"), "name", "at", F.col("block"))
    counted = crowd.select("doc_id", F.concat("name", F.lit(" ("), (F.col("n") + 1).cast("string"), F.lit(")")).alias("title"))
    return titled.filter("title is not null").select("doc_id", "title").unionByName(counted)


def sync_documents(manifests: DataFrame, index: DataFrame) -> DataFrame:
    """What sync does per document: insert, reindex, rename, delete or keep.

    Both: doc_id, title, chars, pending (waiting for OCR).
    """
    new = manifests.select("doc_id", F.struct("title", "chars", "pending").alias("new"))
    old = index.select("doc_id", F.struct("title", "chars", "pending").alias("old"))
    changed = (F.col("new.chars") != F.col("old.chars")) | (F.col("new.pending") != F.col("old.pending"))
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "delete")
        .when(changed, "reindex")
        .when(F.col("new.title") != F.col("old.title"), "rename")
        .otherwise("keep")
    )
    return new.join(old, "doc_id", "full_outer").select("doc_id", action.alias("action"))


def sync_notes(files: DataFrame, index: DataFrame) -> DataFrame:
    """The same for notes (doc_id, hash), by content hash."""
    both = files.select("doc_id", F.col("hash").alias("new")).join(
        index.select("doc_id", F.col("hash").alias("old")), "doc_id", "full_outer"
    )
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("new").isNull(), "delete")
        .when(F.col("new") != F.col("old"), "reindex")
        .otherwise("keep")
    )
    return both.select("doc_id", action.alias("action"))


def stamp_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files (path, size, mtime) that came, went or changed between two looks."""
    a = before.select("path", F.struct("size", "mtime").alias("a"))
    b = now.select("path", F.struct("size", "mtime").alias("b"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed")
    both = a.join(b, "path", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
    return both.select("path", change.alias("change"))


def import_scope(path: Column | str, project_root: str | None) -> Column:
    """Files inside the project go to its knowledge base, others to the global one."""
    if project_root is None:
        return F.lit("global")
    path = F.col(path) if isinstance(path, str) else path
    root = project_root.rstrip("/")
    inside = (path == root) | F.startswith(path, F.lit(root + "/"))
    return F.when(inside & ~path.rlike(r"(^|/)\.\.(/|$)"), "project").otherwise("global")


def move_scope(rows: DataFrame, ids: DataFrame, to: str) -> DataFrame:
    """Documents moved to another scope: moved, or refused where the target has the same title.

    ``rows``: doc_id, title, scope. Returns doc_id, scope, outcome for the ids asked for.
    """
    asked = rows.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    taken = rows.filter(F.col("scope") == to).select(F.lower("title").alias("_t")).distinct().withColumn("_taken", F.lit(True))
    marked = asked.withColumn("_t", F.lower("title")).join(taken, "_t", "left")
    outcome = F.when(F.col("scope") == to, "there").when(F.col("_taken"), "title_taken").otherwise("moved")
    return marked.select("doc_id", F.when(outcome == "moved", F.lit(to)).otherwise(F.col("scope")).alias("scope"), outcome.alias("outcome"))


def shelves_after_move(shelves: DataFrame, moved: DataFrame) -> DataFrame:
    """The shelves (doc_id, shelf) once ``move_scope`` has answered: a document that went to the project leaves its
    shelves, as they group the global knowledge base only; refused ones and those that went to the global one keep them."""
    gone = moved.filter("outcome = 'moved' AND scope = 'project'").select("doc_id").distinct()
    return shelves.join(gone, "doc_id", "left_anti")


def mirror_status(files: DataFrame, copies: DataFrame) -> DataFrame:
    """Another tool's notes (path, content) against their copies: added, updated or exists."""
    both = files.join(copies.select("path", F.col("content").alias("_old")), "path", "left")
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("content"), "exists").otherwise("updated")
    return both.withColumn("status", state).drop("_old")


def latest_text(stages: DataFrame) -> DataFrame:
    """Two-step import: the text of the latest stage per document (text layer 0, OCR 1)."""
    return stages.groupBy("doc_id").agg(F.max_by("text", "stage").alias("text"), F.max("stage").alias("stage"))


def import_plan(files: DataFrame, docs: DataFrame, project_root: str | None, added_folder: str) -> DataFrame:
    """Per file (file_id, source): scope, shelf by folder, how many versions it would replace."""
    from shelfmark.operators.catalog import folder_shelf

    found = previous_versions(files, docs).select("file_id", "versions")
    return files.join(found, "file_id", "left").select(
        "file_id",
        import_scope("source", project_root).alias("scope"),
        folder_shelf(added_folder, "source").alias("shelf"),
        F.coalesce("versions", F.lit(0)).alias("versions"),
    )


def placement_counts(plan: DataFrame) -> DataFrame:
    """How many files of an ``import_plan`` go where: scope, shelf, files, replacing (those with earlier versions).

    Only files for the global knowledge base are put on shelves; the others, and those in no folder, count under null.
    Names that differ in case only are one shelf, spelt as the smallest of them.
    """
    shelf = F.when(F.col("scope") == "global", F.col("shelf"))
    rows = plan.select("scope", shelf.alias("name"), (F.col("versions") > 0).cast("long").alias("replaces"))
    found = rows.groupBy("scope", F.lower("name").alias("folded")).agg(F.min("name").alias("shelf"), F.count(F.lit(1)).alias("files"), F.sum("replaces").alias("replacing"))
    return found.select("scope", "shelf", "files", "replacing")
