"""Reading files, converted documents, manifests, notes and questions; writing reports and logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from shelfmark.functions.text import (
    extension,
    html_to_text,
    is_markdown,
    mark_figures,
    normalize_text,
    source_kind,
    strip,
    HTML_EXT,
)
from shelfmark.session import checkpoint

# Marks in converted files, and wiki files that are no notes.
PAGE_MARK = r"(?m)^<!-- kb:page (\d+) -->$"
PAGE_SPLIT = r"(?m)(?=^<!-- kb:page \d+ -->$)"
OCR_MARK = r"(?m)^<!-- kb:ocr (\d+)/(\d+) -->\n?"
SOURCE_LINE = r"^<!-- kb:source .* -->\n*"
WIKI_META = ["index.md", "log.md", "SCHEMA.md"]

MANIFEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "title", "collection", "kind", "source", "path")]
    + [T.StructField("pages", T.IntegerType()), T.StructField("chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in ("hash", "added_at")]
    + [T.StructField("shelves", T.ArrayType(T.StringType())), T.StructField("ocr", T.StringType())]
)


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder: path, kind, length, modificationTime, content.

    Dot entries and node_modules are left out. Unused columns, the bytes among them, are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_replace("path", r"^\w+:/+", "/")
    root = folder.rstrip("/")
    below = F.substring(name, F.lit(len(root) + 2), F.length(name))
    hidden = below.rlike(r"(^|/)(\.[^/]*|node_modules)(/|$)")
    return files.select(name.alias("path"), source_kind(name).alias("kind"), "length", "modificationTime", "content").filter(
        ~hidden & F.col("kind").isNotNull()
    )


def folder_size(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def read_texts(files: DataFrame) -> DataFrame:
    """Text files as unpaged pages (path, page, markdown); HTML is reduced to its text."""
    raw = F.decode("content", "UTF-8")
    text = F.when(extension("path").isin(HTML_EXT), html_to_text(raw)).otherwise(raw)
    return files.filter("kind = 'text'").select(
        "path", F.lit(None).cast("int").alias("page"), normalize_text(text).alias("markdown")
    )


PageReader = Callable[[bytes, str], list[dict]]


def read_paged(files: DataFrame, reader: PageReader) -> DataFrame:
    """PDF, office and image files as pages, by a reader the user plugs in (bytes, kind to page dicts)."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for row in frame.itertuples(index=False):
                pages = reader(row.content, row.kind)
                yield pd.DataFrame(
                    {
                        "path": [row.path] * len(pages),
                        "page": pd.array([None if row.kind == "image" else p["page"] for p in pages], dtype="Int32"),
                        "markdown": [p["markdown"] for p in pages],
                        "ocr_chars": [int(p.get("ocr_chars", 0)) for p in pages],
                        "ocr_total": [int(p.get("ocr_total", 0)) for p in pages],
                    }
                )

    paged = files.filter("kind <> 'text'").select("path", "kind", "content").mapInPandas(
        run, "path string, page int, markdown string, ocr_chars int, ocr_total int"
    )
    return paged.withColumn("markdown", mark_figures(normalize_text("markdown")))


def split_converted(markdown: Column | str) -> Column:
    """A converted file as array<struct(page, markdown, ocr_chars, ocr_total)>."""
    text = F.regexp_replace(markdown, SOURCE_LINE, "")

    def read(part: Column) -> Column:
        page, chars, total = (
            F.regexp_extract(part, PAGE_MARK, 1),
            F.regexp_extract(part, OCR_MARK, 1),
            F.regexp_extract(part, OCR_MARK, 2),
        )
        body = strip(F.regexp_replace(F.regexp_replace(part, PAGE_MARK, ""), OCR_MARK, ""))
        return F.struct(
            F.when(page != "", page).cast("int").alias("page"),
            body.alias("markdown"),
            F.when(chars != "", chars).cast("int").alias("ocr_chars"),
            F.when(total != "", total).cast("int").alias("ocr_total"),
        )

    parts = F.transform(F.split(text, PAGE_SPLIT), read)
    paged = F.exists(parts, lambda p: p["page"].isNotNull())
    # A paged document starts with an empty part before its first mark.
    return F.filter(parts, lambda p: ~paged | p["page"].isNotNull())


def read_converted(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pages of converted files: key, seq, page, markdown, ocr_chars, ocr_total."""
    return texts.select(key, F.posexplode(split_converted(text)).alias("seq", "p")).select(
        key, F.col("seq").cast("bigint").alias("seq"), "p.*"
    )


def render_pages(page: Column, markdown: Column, ocr_chars: Column, ocr_total: Column) -> Column:
    """One page as it stands in a converted file."""
    ocr = F.when(
        ocr_chars > 0,
        F.concat(F.lit("<!-- kb:ocr "), ocr_chars.cast("string"), F.lit("/"), ocr_total.cast("string"), F.lit(" -->\n")),
    ).otherwise("")
    mark = F.when(page.isNotNull(), F.concat(F.lit("<!-- kb:page "), page.cast("string"), F.lit(" -->\n"))).otherwise("")
    return F.concat(mark, F.coalesce(ocr, F.lit("")), markdown)


def render_converted(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id, text: a document's pages as one converted file (the row is the file, as in the source)."""
    body = pages.select(
        "doc_id", "seq", render_pages(F.col("page"), F.col("markdown"), F.col("ocr_chars"), F.col("ocr_total")).alias("m")
    )
    joined = body.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "m"))).alias("p"))
    return joined.join(titles.select("doc_id", "title"), "doc_id").select(
        "doc_id",
        F.concat(F.lit("<!-- kb:source "), "title", F.lit(" -->\n\n"), F.array_join("p.m", "\n\n"), F.lit("\n")).alias("text"),
    )


def read_pages(pages: DataFrame, doc_id, first: int, last: int) -> DataFrame:
    """A page range of one document, tables that run on with their header; the end is clamped to what is there.

    ``pages``: doc_id, seq, page, markdown. A range without pages is refused: the error says which there are.
    """
    from shelfmark.operators.chunking import with_carried_headers

    own = pages.filter(F.col("doc_id") == doc_id)
    read = checkpoint(with_carried_headers(own).filter(F.col("page").between(first, last)))
    if read.isEmpty():
        there = own.agg(F.min("page").alias("first"), F.max("page").alias("last")).first()
        has = f"pages {there['first']}-{there['last']}" if there["last"] is not None else "no pages"
        raise ValueError(f"{doc_id} has {has}, not {first}-{last}")
    return read.orderBy("page")


def read_manifests(spark: SparkSession, folder: str, file_per_document: bool = True) -> DataFrame:
    """Document manifests: broken JSON, an id that is not the file's name or a missing path are ignored.

    ``file_per_document=False`` reads JSON lines, as ``write_manifests`` writes them.
    """
    reader = spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED")
    if not file_per_document:
        return reader.json(folder).filter("id is not null and path is not null")
    rows = reader.option("multiLine", "true").json(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]*)\.json$", 1)
    return rows.withColumn("_name", name).filter("id is not null and path is not null and _name = id").drop("_name")


def write_manifests(docs: DataFrame, folder: str) -> None:
    """Append manifests as JSON lines: readers need one record, not one file, per document."""
    docs.write.mode("append").json(folder)


def scan_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown notes below a wiki folder (path, raw), without dot files and the root's index files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/")
    name = F.regexp_replace("path", r"^\w+:/+", "/")
    below = F.substring(name, F.lit(len(root) + 2), F.length(name))
    return files.select(below.alias("path"), F.decode("content", "UTF-8").alias("raw")).filter(
        is_markdown("path") & ~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").isin(WIKI_META)
    )


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A question file as line, text."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).withColumn(
        "line", F.col("line") + 1
    )


def append_log(entries: DataFrame, folder: str) -> None:
    """Add change-log entries (at, verb, file, title)."""
    entries.write.mode("append").json(folder)


def missing_rows(target: DataFrame, source: DataFrame, key: str = "path") -> DataFrame:
    """What a copy that overwrites nothing would add."""
    return source.join(target.select(key), key, "left_anti")


def markdown_report(summary: DataFrame, details: DataFrame, title: str) -> str:
    """An evaluation report as Markdown; both frames are as long as the question file a person wrote."""

    def table(df: DataFrame) -> list[str]:
        rows = df.collect()
        head = [f"| {' | '.join(df.columns)} |", f"|{'|'.join('---' for _ in df.columns)}|"]
        return head + ["| " + " | ".join(str(v) for v in r) + " |" for r in rows]

    return "\n".join([f"# {title}", "", *table(summary), "", "## Questions", "", *table(details), ""])


__all__ = [
    "append_log", "folder_size", "markdown_report", "missing_rows", "read_converted", "read_manifests",
    "read_paged", "read_pages", "read_questions", "read_texts", "render_converted", "render_pages", "scan_files",
    "scan_notes", "split_converted", "write_manifests",
]
