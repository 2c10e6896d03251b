"""Page text to chunks: footers, soft wraps, private-use glyphs, page kinds, re-paired score tables.

All functions are column expressions over whole pages, so cleaning is one narrow pass next to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.periods import page_id

# What a footer line, a list start, a glyph and a page kind look like.
FOOTERS = (
    r"^\s*\d+\s*$",
    r"^\s*[页第]\s*$",
    r"(?i)Copyright|All rights reserved",
)
LIST_START = r"(?:[（(]\s*\d+\s*[)）]|[⚫◆●•·]|[-–—]\s|\d+\s*[.、])"
GLYPHS = {"\uf06c": "●", "\uf075": "◆"}
PRIVATE_USE = "[\ue000-\uf8ff]"
CJK_WRAP = "(?<=[一-鿿])\\s*\\n\\s*(?=[一-鿿])"
SCORE = r"\d+\.\d+"
FULL_NAME = "[一-鿿]+?国际机场"
SHORT_NAME = "[一-鿿]+?机场"
AVERAGE = "平均"
MIN_CHARS = 120
MIN_MARKS = 20
BLANK, DATA, TEXT, PAIRED = "空白页", "数据页", "叙述页", "数据页·已配对"


def is_footer(line: Column, extra: tuple[str, ...] = ()) -> Column:
    """``extra`` has the patterns of one publisher, such as its own source line."""
    out = F.lit(False)
    for p in (*FOOTERS, *extra):
        out = out | line.rlike(p)
    return out


def body_lines(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Lines without trailing space, blank lines and footers."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))
    return F.filter(lines, lambda x: (x != "") & ~is_footer(x, extra))


def strip_footers(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Footers gone, line structure kept."""
    return F.array_join(body_lines(text, extra), "\n")


def merge_wraps(text: Column, extra: tuple[str, ...] = ()) -> Column:
    """Footers gone and soft wraps joined; a list item starts a new line."""
    trimmed = F.transform(body_lines(text, extra), lambda x: F.regexp_replace(x, r"^\s+", ""))
    return F.regexp_replace(F.array_join(trimmed, "\n"), rf"\n(?!{LIST_START})", "")


def map_glyphs(text: Column) -> Column:
    return F.translate(text, "".join(GLYPHS), "".join(GLYPHS.values()))


def unmapped_glyphs(pages: DataFrame, key: str, text: str = "raw") -> DataFrame:
    """Private-use characters without a mapping: (key, glyph, n). Such pages must not be cleaned silently."""
    left = F.regexp_extract_all(map_glyphs(F.col(text)), F.lit(PRIVATE_USE), F.lit(0))
    return pages.select(key, F.explode(left).alias("glyph")).groupBy(key, "glyph").agg(F.count(F.lit(1)).alias("n"))


def join_vertical(text: Column) -> Column:
    """Characters typeset one per line become one word again."""
    return F.regexp_replace(text, CJK_WRAP, "")


def squash(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def page_kind(text: Column, name: str = FULL_NAME, min_chars: int = MIN_CHARS, min_marks: int = MIN_MARKS) -> Column:
    marks = F.regexp_count(text, F.lit(SCORE)) + F.regexp_count(text, F.lit(name))
    return F.when(F.length(squash(text)) < min_chars, BLANK).when(marks >= min_marks, DATA).otherwise(TEXT)


def split_at_average(text: Column) -> tuple[Column, Column]:
    """(text before the line that states the average, that line and all after it); NULLs without an anchor."""
    at = F.instr(text, AVERAGE)
    line = F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1))
    start = at - line + 1  # first character of the anchor line
    found = at > 0
    return F.when(found, F.substring(text, F.lit(1), start - 1)), F.when(found, F.substring(text, start, F.length(text)))


def repair_score_table(text: Column, name: str = SHORT_NAME) -> Column:
    """All scores, then all names, as one ``name score`` line each; NULL when the counts differ.

    Only scores before the average count, only names after it.
    """
    head, tail = split_at_average(text)
    scores = F.regexp_extract_all(head, F.lit(SCORE), F.lit(0))
    names = F.regexp_extract_all(squash(F.array_join(body_lines(tail), "")), F.lit(name), F.lit(0))
    pairs = F.zip_with(names, scores, lambda n, s: F.concat(n, F.lit(" "), s))
    return F.when((F.size(scores) > 0) & (F.size(scores) == F.size(names)), F.array_join(pairs, "\n"))


def build_chunks(pages: DataFrame, name: str = FULL_NAME, short_name: str = SHORT_NAME, min_chars: int = MIN_CHARS,
                 min_marks: int = MIN_MARKS, extra: tuple[str, ...] = ()) -> DataFrame:
    """``pages(period, page_no, raw)`` to chunks; blank pages are dropped, score tables re-paired when they can be."""
    raw = map_glyphs(F.col("raw"))
    kind = page_kind(F.col("raw"), name, min_chars, min_marks)
    staged = pages.withColumn("kind", kind).filter(F.col("kind") != BLANK).withColumn(
        "pairs", F.when(F.col("kind") == DATA, repair_score_table(raw, short_name)))
    text = (
        F.when(F.col("pairs").isNotNull(), strip_footers(F.col("pairs"), extra))
        .otherwise(merge_wraps(raw, extra))  # an unpaired data page, too
    )
    out = staged.select(
        page_id(F.col("period"), F.col("page_no")).alias("chunk_id"), "period", "page_no",
        F.when(F.col("pairs").isNotNull(), PAIRED).otherwise(F.col("kind")).alias("page_kind"), text.alias("text"))
    return out.withColumn("n_chars", F.length("text"))


def quality_problems(chunks: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Chunks that still hold a private-use glyph or a footer line, or hold nothing."""
    lines = F.split("text", "\n")
    problem = (
        F.when(F.trim("text") == "", "blank")
        .when(F.col("text").rlike(PRIVATE_USE), "glyph")
        .when(F.exists(lines, lambda x: is_footer(x, extra)), "footer")
    )
    return chunks.select("chunk_id", problem.alias("problem")).filter(F.col("problem").isNotNull())


def chunk_statistics(chunks: DataFrame, by: str = "period") -> DataFrame:
    """Count, shortest, upper median and longest chunk per group.

    The median comes from the counts per length, so a group is never sorted row by row.
    """
    sizes = chunks.groupBy(by, "n_chars").agg(F.count(F.lit(1)).alias("k"))
    upto = F.sum("k").over(W.partitionBy(by).orderBy("n_chars"))
    total = F.sum("k").over(W.partitionBy(by))
    ranked = sizes.select(by, "n_chars", "k", upto.alias("upto"), total.alias("n"))
    at_middle = (F.col("upto") > F.floor(F.col("n") / 2)) & (F.col("upto") - F.col("k") <= F.floor(F.col("n") / 2))
    return ranked.groupBy(by).agg(
        F.max("n").alias("n"), F.min("n_chars").alias("shortest"),
        F.max(F.when(at_middle, F.col("n_chars"))).alias("median"), F.max("n_chars").alias("longest"))


def page_text(html: Column) -> Column:
    """Visible text of a web page, a line per element."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    lined = F.regexp_replace(bare, r"<[^>]*>", "\n")
    return F.trim(F.regexp_replace(lined, r"\s*\n\s*", "\n"))
