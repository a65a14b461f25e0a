"""Text cleaning and display strings as Column expressions.

Lengths count code points. Everything here stays in the JVM, except Unicode compatibility
folding, which Spark has no function for.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# The blanks a text is trimmed by.
BLANK = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

BLANKS = " \t\n\r\x0b\x0c\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))

# File extensions by kind of source.
PDF_EXT = [".pdf"]
OFFICE_EXT = [".doc", ".docx", ".odt", ".rtf", ".ppt", ".pptx", ".odp", ".xls", ".xlsx", ".ods"]
IMAGE_EXT = [".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp", ".gif"]
HTML_EXT = [".html", ".htm"]
PROSE_EXT = [".md", ".markdown", ".mdx", ".txt", ".rst", ".org", ".adoc", ".tex"]
DATA_EXT = [".log", ".csv", ".tsv", ".json", ".jsonl", ".yaml", ".yml", ".toml", ".ini", ".xml"]
CODE_EXT = [
    ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", ".go", ".rs", ".java", ".kt", ".swift",
    ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".rb", ".php", ".sh", ".sql", ".lua",
]
MARKDOWN_EXT = [".md", ".markdown", ".mdx"]

# Character ranges.
CJK_TEXT = r"\x{3400}-\x{9fff}\x{f900}-\x{faff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}"
CJK_SCRIPT = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
WIDE = (
    r"[\x{1100}-\x{115f}\x{2e80}-\x{a4cf}\x{ac00}-\x{d7a3}\x{f900}-\x{faff}"
    r"\x{fe30}-\x{fe4f}\x{ff00}-\x{ff60}\x{ffe0}-\x{ffe6}]"
)
CJK_LANGUAGES = ["chi_sim", "chi_tra", "jpn", "kor"]
PICTURE_LINK = r"!\[[^\]\n]*\]\(img_p\d+_\d+\.[a-z]+\)"

NATIVE_TEXT_MIN = 200
CJK_MIN = 3


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim every kind of blank from both ends."""
    return F.btrim(_c(text), F.lit(BLANKS))


def squeeze(text: Column | str) -> Column:
    """Collapse runs of blanks to one space and trim."""
    return F.trim(F.regexp_replace(_c(text), f"{BLANK}+", " "))


def _where(text: Column, needed: Callable[[Column], Column], pattern: str, by: str) -> Column:
    """``regexp_replace`` of texts that ``needed`` holds for, which is much cheaper than the pattern; the text is computed once."""
    return F.get(F.transform(F.array(text), lambda t: F.when(needed(t), F.regexp_replace(t, pattern, by)).otherwise(t)), F.lit(0))


def normalize_text(text: Column | str) -> Column:
    """Make extracted text searchable: line ends, Markdown escapes, gaps between CJK characters."""

    def holds(*parts: str) -> Callable[[Column], Column]:
        return lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in parts])

    out = _where(_c(text), holds("\r"), r"\r\n?", "\n")
    out = _where(out, holds("\\"), r"\\([\\`*_{}\[\]()#+\-.!|<>~])", "$1")
    out = _where(out, lambda t: (F.octet_length(t) > F.length(t)) & t.rlike(f"[{CJK_TEXT}][ \\t]"), f"([{CJK_TEXT}])[ \\t]+(?=[{CJK_TEXT}])", "$1")
    out = _where(out, holds(" \n", "\t\n"), r"[ \t]+\n", "\n")
    out = _where(out, holds("\n\n\n"), r"\n{3,}", "\n\n")
    return strip(out)


def mark_figures(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), PICTURE_LINK, "[figure]")


def drop_pictures(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), PICTURE_LINK, "")


def html_to_text(html: Column | str) -> Column:
    """Plain text of a page: no scripts or styles, block ends as line breaks, five entities read."""
    out = F.regexp_replace(_c(html), r"(?i)<(script|style)[\s\S]*?</\1>", "")
    out = F.regexp_replace(out, r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\s*/?>", "\n")
    out = F.regexp_replace(out, r"<[^>]+>", "")
    # The ampersand comes last, so "&amp;lt;" reads "&lt;".
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def extension(path: Column | str) -> Column:
    """Lower-case extension with its dot; empty for names such as ".bashrc"."""
    return F.lower(F.regexp_extract(_c(path), r"[^/\\](\.[^./\\]*)$", 1))


def source_kind(path: Column | str) -> Column:
    ext = extension(path)
    return (
        F.when(ext.isin(PDF_EXT), "pdf")
        .when(ext.isin(OFFICE_EXT), "office")
        .when(ext.isin(IMAGE_EXT), "image")
        .when(ext.isin(HTML_EXT + PROSE_EXT + DATA_EXT + CODE_EXT), "text")
    )


def is_markdown(path: Column | str) -> Column:
    return extension(path).isin(MARKDOWN_EXT)


def looks_like_document(name: Column | str) -> Column:
    """Whether a name reads as a document's title, also with the " (2)" of a repeated upload."""
    ext = extension(F.regexp_replace(_c(name), r"\s+\(\d+\)$", ""))
    return ext.isin(PDF_EXT + OFFICE_EXT + IMAGE_EXT + PROSE_EXT + HTML_EXT)


def native_chars(text: Column | str) -> Column:
    """Characters that are not blank."""
    return F.length(F.regexp_replace(_c(text), BLANK, ""))


def has_text_layer(native: Column | str) -> Column:
    """Whether a document's summed non-blank characters are enough to search before OCR."""
    return _c(native) >= NATIVE_TEXT_MIN


def ocr_languages(configured: Column | str, kind: Column | str, native: Column, cjk_chars: Column) -> Column:
    """OCR languages for a document: CJK models go when its own text is plentiful and has no CJK."""
    langs = F.filter(F.split(_c(configured), r"\+"), lambda x: x != "")
    others = F.filter(langs, lambda x: ~F.regexp_replace(x, "_vert$", "").isin(CJK_LANGUAGES))
    keep = (
        (_c(kind) == "image")
        | (F.size(others) == 0)
        | (F.size(others) == F.size(F.split(_c(configured), r"\+")))
        | (native < NATIVE_TEXT_MIN)
        | (cjk_chars >= CJK_MIN)
    )
    return F.when(keep, _c(configured)).otherwise(F.array_join(others, "+"))


def cjk_count(text: Column | str) -> Column:
    return F.regexp_count(_c(text), F.lit(CJK_SCRIPT))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))


def slugify(title: Column | str, today: Column | None = None, fold: bool = True) -> Column:
    """File name for a note title; ``fold`` adds compatibility folding (an Arrow batch step)."""
    low = F.lower(_c(title))
    low = nfkc(low) if fold else low
    slug = F.regexp_replace(low, r"[^\p{L}\p{N}]+", "-")
    slug = F.regexp_replace(slug, "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, 60), "-+$", "")
    stamp = F.date_format(today if today is not None else F.current_date(), "yyyy-MM-dd")
    return F.when(slug == "", F.concat(F.lit("note-"), stamp)).otherwise(slug)


def normalize_tags(tags: Column | str) -> Column:
    clean = F.transform(_c(tags), lambda t: F.regexp_replace(F.lower(strip(t)), r"[\s,\[\]]+", "-"))
    return F.array_distinct(F.filter(clean, lambda t: t != ""))


def clean_shelf(name: Column) -> Column:
    out = F.regexp_replace(name, r'[,\[\]"]+', " ")
    return F.substring(squeeze(out), 1, 40)


def normalize_shelves(names: Column | str) -> Column:
    """Shelf names as stored; of spellings that differ in case only, the first stays."""
    clean = F.filter(F.transform(_c(names), clean_shelf), lambda n: (n != "") & (n != "-"))
    folded = F.transform(clean, lambda n: F.lower(n))
    return F.filter(clean, lambda n, i: F.array_position(folded, F.lower(n)) == i + 1)


def source_path(source: Column | str, depth: int | Column) -> Column:
    """The last ``depth`` parts of a source path; an upload has only its name."""
    path = F.regexp_replace(_c(source), "^upload:", "")
    parts = F.filter(F.split(path, r"[\\/]+"), lambda p: p != "")
    take = F.least(F.lit(depth) if isinstance(depth, int) else depth, F.size(parts))
    return F.when(F.size(parts) == 0, "").otherwise(F.array_join(F.slice(parts, F.size(parts) - take + 1, take), "/"))


def citation(title: Column | str, page: Column | str) -> Column:
    page = _c(page)
    where = F.when(page.isNotNull() & (page != 0), F.concat(F.lit(" p."), page.cast("string"))).otherwise("")
    return F.concat(F.lit("["), _c(title), where, F.lit("]"))


def plain_snippet(snippet: Column | str) -> Column:
    """A snippet without heading marks, bold marks and table rules."""
    out = F.regexp_replace(_c(snippet), r"(^|\s)#{1,6}\s+", "$1")
    out = F.replace(out, F.lit("**"), F.lit(""))
    out = F.regexp_replace(out, r"\|?\s*(?:-{3,}\s*\|\s*)+", "| ")
    out = F.regexp_replace(out, r"(?:\s*\|\s*){2,}", " | ")
    return squeeze(out)


def short_title(title: Column | str) -> Column:
    """A title without its extension and without README-like file names."""
    out = F.regexp_replace(_c(title), r"/(?:README|readme|CHANGELOG|index)\.(?:md|markdown)$", "")
    return F.regexp_replace(out, r"(?i)\.(?:md|markdown|mdx|txt|pdf)$", "")


def digit_mask(title: Column | str) -> Column:
    return F.regexp_replace(_c(title), r"\d+", "#")


def clean_question(question: Column | str, limit: int = 500) -> Column:
    return F.substring(squeeze(question), 1, limit)


def human_size(num: Column | str) -> Column:
    """"610 MB", "1.1 GB": one decimal below ten, from kilobytes up."""
    n = _c(num).cast("double")
    power = F.when(n < 1e3, 0).when(n < 1e6, 1).when(n < 1e9, 2).otherwise(3)
    scaled = n / F.pow(F.lit(1000.0), power)
    unit = F.element_at(F.array(*map(F.lit, ["B", "KB", "MB", "GB"])), power + 1)
    tenth = F.format_string("%.1f", F.round(scaled, 1))
    whole = F.floor(scaled + 0.5).cast("string")
    return F.concat(F.when((power > 0) & (scaled < 10), tenth).otherwise(whole), F.lit(" "), unit)


def display_width(text: Column | str) -> Column:
    """Terminal columns: CJK and full-width characters take two."""
    return F.length(_c(text)) + F.regexp_count(_c(text), F.lit(WIDE))


def pad_display(text: Column | str, width: int | Column) -> Column:
    width = F.lit(width) if isinstance(width, int) else width
    return F.concat(_c(text), F.repeat(F.lit(" "), F.greatest(F.lit(1), width - display_width(text))))


def page_runs(pages: Column | str) -> Column:
    """"1-3, 7" from a short array of page numbers, sorted and distinct."""
    run = "struct<lo:bigint,hi:bigint>"
    ordered = F.transform(F.array_sort(F.array_distinct(_c(pages))), lambda p: p.cast("bigint"))

    def extend(acc: Column, page: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.array(F.struct(page.alias("lo"), page.alias("hi")))
        grown = F.array(F.struct(last["lo"].alias("lo"), page.alias("hi")))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), grown)
        return F.when(F.size(acc) == 0, one).when(last["hi"] + 1 == page, joined).otherwise(F.concat(acc, one))

    runs = F.aggregate(ordered, F.array().cast(f"array<{run}>"), extend)
    return F.array_join(F.transform(runs, run_label), ", ")


def run_label(run: Column) -> Column:
    return F.when(run["lo"] == run["hi"], run["lo"].cast("string")).otherwise(
        F.concat(run["lo"].cast("string"), F.lit("-"), run["hi"].cast("string"))
    )


def window_text(text: Column | str, offset: int = 0, width: int = 30000) -> Column:
    """A slice for reading a long text in parts, and whether more follows."""
    text = _c(text)
    return F.struct(
        F.substring(text, offset + 1, width).alias("text"),
        (F.length(text) > offset + width).alias("truncated"),
    )


def hit_line(rank: Column, title: Column, page: Column, doc_id: Column, marks: list[Column], snippet: Column) -> Column:
    """A hit as two lines: number, citation, id and its marks (nulls left out), then the snippet."""
    head = F.concat(rank.cast("string"), F.lit(". "), citation(title, page), F.lit(" id="), doc_id.cast("string"))
    return F.concat(F.concat_ws(" · ", head, *marks), F.lit("\n   "), snippet)
