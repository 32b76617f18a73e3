"""Segmentation of anchored Markdown and extraction of its sections, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from claimforge.functions.text import let, strip_space

# The markers of anchored Markdown.
ANCHOR = r"<!--\s*source-anchor:\s*([^\s>]+)\s*-->"
ANCHORED_HEADING = r"(?m)^#{2,4}[^\S\n]+[^\n]+\n\n?(?=<!--\s*source-anchor:)"
PAGE_HEADING = r"(?m)^## 第 \d+ 页\s*$"
LEVEL_TWO = r"(?m)^##\s+[^\n]+$"
CUT = "\u0001"


def packed(sections: Column, total: Column, limit: int) -> Column:
    """Sections joined by blank lines into segments of about equal length.

    The target is the text's length over the fewest segments that the limit allows; once all but one of those are
    closed, the last takes the rest whatever its length. Sections come without blanks at their ends; empty ones are left
    out. The fold keeps numbers only, and each segment is joined once."""
    count = F.ceil(total / limit).cast("int")
    given = F.struct(F.filter(sections, lambda s: F.length(s) > 0).alias("sections"), count.alias("count"), F.ceil(total / count).alias("target"))

    def fold(x):
        start = F.struct(F.array().cast("array<int>").alias("begins"), F.lit(0).alias("open"), F.lit(0).alias("n"))

        def step(acc, length):
            joined = acc["open"] + 2 + length
            begin = (acc["n"] == 0) | ((joined > x["target"]) & (F.size(acc["begins"]) < x["count"]))
            return F.struct(F.when(begin, F.concat(acc["begins"], F.array(acc["n"]))).otherwise(acc["begins"]).alias("begins"), F.when(begin, length).otherwise(joined).alias("open"), (acc["n"] + 1).alias("n"))

        begins = F.aggregate(F.transform(x["sections"], F.length), start, step, lambda acc: F.concat(acc["begins"], F.array(acc["n"])))
        return F.struct(x["sections"].alias("sections"), begins.alias("bounds"))

    def cut(x):
        spans = F.zip_with(x["bounds"], F.slice(x["bounds"], F.lit(2), F.size(x["bounds"])), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        return F.transform(F.filter(spans, lambda s: s["b"].isNotNull()), lambda s: F.array_join(F.slice(x["sections"], s["a"] + 1, s["b"] - s["a"]), "\n\n"))

    return let(let(given, fold), cut)


def sections(text: Column) -> Column:
    """The text cut at anchored headings, else at page headings, else whole; what precedes the first belongs to it.

    Where a level-two heading stands between two cuts, the later section begins at the last such heading."""
    heading = F.when(text.rlike(ANCHORED_HEADING), F.regexp_replace(text, rf"({ANCHORED_HEADING})", CUT + "$1")).otherwise(F.regexp_replace(text, rf"({PAGE_HEADING})", CUT + "$1"))
    parts = F.split(heading, CUT)
    first = F.concat(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
    rest = F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0)))
    # a heading of level two that is no cut itself, in the body of the section before, opens the next one
    parent = r"(?ms)^(.+?\n)(##\s+[^\n]+\n(?:(?!^##\s).)*)\z"

    def halves(part):
        body, moved = F.regexp_extract(part, parent, 1), F.regexp_extract(part, parent, 2)
        move = (F.length(body) > 0) & ~moved.rlike(r"<!--\s*source-anchor:") & ~moved.rlike(r"\A## 第 \d+ 页")
        return F.struct(F.when(move, body).otherwise(part).alias("own"), F.when(move, moved).otherwise("").alias("moved"))

    cut = F.transform(F.concat(F.array(first), rest), halves)
    last = F.struct(F.lit("").alias("own"), F.lit("").alias("moved"))
    before = F.slice(F.concat(F.array(last), cut), F.lit(1), F.size(cut))
    joined = F.zip_with(before, cut, lambda b, c: F.struct(F.concat(b["moved"], c["own"]).alias("section"), c["moved"].alias("moved")))
    end = F.element_at(joined, -1)
    whole = F.concat(F.transform(F.slice(joined, F.lit(1), F.size(joined) - 1), lambda x: x["section"]), F.array(F.concat(end["section"], end["moved"])))
    return F.transform(whole, strip_space)


def segment(packages: DataFrame, limit: int, text: str = "full_markdown") -> DataFrame:
    """(…, index, total, label, markdown, cited_anchors): a text within the limit, or without headings, is one segment."""
    whole = F.lit(limit <= 0) | (F.length(text) <= limit)
    parts = F.when(whole, F.array(F.col(text))).otherwise(packed(sections(F.col(text)), F.length(text), max(1, limit)))
    cut = packages.withColumn("total", F.size(parts)).select("*", F.posexplode(parts).alias("index", "markdown")).withColumn("index", F.col("index") + 1)
    cited = F.array_distinct(F.regexp_extract_all("markdown", F.lit(ANCHOR), F.lit(1)))
    return cut.withColumn("label", F.format_string("S%d/%d", "index", "total")).withColumn("cited_anchors", F.when(F.col("total") == 1, F.lit(None)).otherwise(cited)).drop(text)


def segment_anchors(segments: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """Anchors of the package that a segment cites; all of them for a text in one segment."""
    pairs = segments.select(key, "index", "cited_anchors").join(anchors, key)
    return pairs.where(F.col("cited_anchors").isNull() | F.array_contains("cited_anchors", F.col("anchor_id"))).drop("cited_anchors")


def anchor_sections(df: DataFrame, key: str | list[str], text: str) -> DataFrame:
    """(key columns, anchor_id, pos, section): text from an anchor to the next, trimmed; of a repeated id the last section."""
    key = [key] if isinstance(key, str) else key
    marked = F.regexp_replace(text, rf"({ANCHOR})", CUT + "$1")
    cut = df.select(*key, F.posexplode(F.slice(F.split(marked, CUT), 2, 1 << 30)).alias("pos", "raw"))
    named = cut.withColumn("anchor_id", F.regexp_extract("raw", ANCHOR, 1)).withColumn("section", strip_space(F.col("raw")))
    return named.groupBy(*key, "anchor_id").agg(F.max("pos").alias("pos"), F.max_by("section", "pos").alias("section"))


def document_sections(packages: DataFrame, key: str | list[str], text: str, anchors: str) -> DataFrame:
    """Anchor sections; a text without anchors whose package declares exactly one belongs to that one."""
    lone = packages.where(~F.col(text).rlike(ANCHOR) & (F.size(anchors) == 1))
    whole = lone.select(*([key] if isinstance(key, str) else key), F.get(F.col(anchors), F.lit(0))["anchor_id"].alias("anchor_id"), F.lit(0).alias("pos"), F.col(text).alias("section"))
    return anchor_sections(packages, key, text).unionByName(whole)


def cell(section: Column, column: str) -> Column:
    """The cell `- **B列**：…` of a table row's section, up to the next bullet or heading; null if absent or blank."""
    found = F.regexp_extract(section, rf"(?ms)^- \*\*{column}\*\*：(.*?)(?=^- \*\*|^#|\z)", 1)
    return F.nullif(strip_space(found), F.lit(""))
