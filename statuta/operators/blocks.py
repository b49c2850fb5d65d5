"""Structure of laid-out pages: blocks of text with size and weight to articles with their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import headings as h
from .sequences import RANGE_ROWS, carried, counted, ranged

# Sizes in points from which on a bold block is a subpart, a section, an article's heading;
# up to which a block belongs to the page; from which on it is an article's text.
SUBPART_SIZE, SECTION_SIZE, ARTICLE_SIZE = 19.5, 17.5, 13.0
PAGE_SIZE, BODY_SIZE = 9.5, 9.5
# Starts of paragraphs (numbers, lettered and bracketed items, notes, dashes), the note's
# whatever its case; and a short numbered line.
PARAGRAPH_START = (
    r"^\d+(\.\d+)*\s+\S",
    r"^[a-z]\.\s",
    r"^\([a-z0-9]{1,4}\)\s",
    r"^[a-z]\)",
    r"^[—–\-•]\s",
)
NOTE_START = r"^Note\b"
SECTION_LINE = r"^\d+\s+[A-Z][^.]{2,60}$"


# How far a paragraph is set in, by how it begins; bracketed letters that are Roman numbers.
LETTERED = (r"^[a-z]\.\s", r"^[a-z]\)", r"^\([a-z]{1,3}\)\s")
ROMAN = r"(?i)^\((i{1,4}|iv|vi{0,3}|ix|x{1,3})\)\s"
BRACKETED_NUMBER = r"^\(\d+\)\s"


def shown_as(kind: Column, body: Column) -> Column:
    """How an element is shown: heading, table, note, or a paragraph set in by 0 to 3 steps: letters by
    one, bracketed numbers by two, bracketed Roman numbers by three."""
    steps = F.when(body.rlike(r"^\([a-z]{1,3}\)\s") & body.rlike(ROMAN), "indent-3").when(h.like_any(body, LETTERED), "indent-1").when(body.rlike(BRACKETED_NUMBER), "indent-2").when(body.rlike("(?i)" + NOTE_START), "note").otherwise("plain")
    return F.when(kind == "text", steps).otherwise(kind)


def table_cells(kind: Column, body: Column) -> Column:
    """The rows of a table as arrays of cells; null for other elements."""
    return F.when(kind == "table", F.transform(F.split(body, "\n"), lambda line: F.split(line, "\t")))


def structured(blocks: DataFrame, doc: str, pos: str, rows: int = RANGE_ROWS) -> DataFrame:
    """Blocks (doc, pos, text, size, bold) without page noise, each with its role (structure,
    article, body or null) and with what is in force there: subpart, section, in_toc and article,
    the place of the article's heading.

    Articles count from the first heading that opens a part; a subpart ends the section before it.
    A small-print heading is an article by its form, and lets small text be body. Places and labels are
    carried through a document by ranges of ``rows`` positions, so a long one is several tasks' work.
    """
    text, printed = F.trim("text"), F.col("size") > PAGE_SIZE
    large = F.col("bold") & (F.col("size") >= SECTION_SIZE)
    b = blocks.where(~h.is_page_head(F.col("text"))).withColumns(
        {
            "_opens": large & h.label(text).rlike(h.OPENING),
            "_small": F.col("bold") & h.like_any(text, h.SMALL_PRINT, "(?iU)") & h.heading_type(text).isNotNull(),
            "_named": F.col("bold") & printed & ~large & (F.col("size") >= ARTICLE_SIZE) & h.heading_type(h.typed_line(text)).isNotNull(),
        }
    )
    b = b.withColumn("_name", F.when(large, h.label(text)))  # where the text is: the ends of ranges need no text
    b = carried(ranged(b, [doc], pos, rows), [doc], pos, {"_opened": F.when(F.col("_opens"), F.lit(True))}, here=False, rows=rows)
    b = b.withColumn("in_toc", F.col("_opened").isNull())
    small = F.col("_small") & ~F.col("in_toc")
    b = b.withColumn("role", F.when(small, "article").when(large, "structure").when(~F.col("in_toc") & F.col("_named"), "article"))
    b = b.withColumn("_label", F.when(F.col("role") == "structure", F.struct(F.col(pos).alias("p"), F.col("_name").alias("t"))))
    state = F.when(F.col("role").isNotNull(), F.struct(F.when(F.col("role") == "article", F.col(pos)).alias("article"), small.alias("small")))
    top = F.col("size") >= SUBPART_SIZE
    b = carried(b, [doc], pos, {"_state": state, "_sub": F.when(top, F.col("_label")), "_sec": F.when(~top, F.col("_label"))}, rows=rows)
    section = F.when(F.col("_sub").isNull() | (F.col("_sec.p") > F.col("_sub.p")), F.col("_sec.t"))
    body = F.col("role").isNull() & F.col("_state.article").isNotNull() & printed & (F.col("_state.small") | (F.col("size") >= BODY_SIZE))
    b = b.withColumns({"role": F.when(body, "body").otherwise(F.col("role")), "article": F.col("_state.article"), "subpart": F.col("_sub.t"), "section": section, "small": F.col("_small")})
    return b.drop("_at", "_opens", "_opened", "_small", "_named", "_name", "_label", "_state", "_sub", "_sec")


def articles(blocks: DataFrame, doc: str, pos: str, title: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(doc, pos, node_type, reference_code, title, hierarchy_path, content_text): one row an
    article heading with its body. Those whose reference has no digit, or that have no text, go; of
    a type and reference the last of a document stays. title: the column with the document's title.
    """
    s = structured(blocks, doc, pos, rows).where("role IN ('article', 'body')")
    head = F.regexp_replace(F.when(F.col("small"), F.trim("text")).otherwise(h.typed_line(F.trim("text"))), "\n", " ")
    at = lambda c: F.max(F.when(F.col("role") == "article", c))
    path = F.array_join(F.filter(F.array(title, "subpart", "section"), lambda x: x.isNotNull() & (x != "")), " / ")
    lines = F.sort_array(F.collect_list(F.when(F.col("role") == "body", F.struct(F.col(pos).alias("p"), F.trim("text").alias("t")))))
    g = s.groupBy(doc, F.col("article").alias("pos")).agg(at(head).alias("heading"), at(path).alias("hierarchy_path"), lines.alias("_b"))
    parts = h.heading_parts(F.col("heading"))
    g = g.select(doc, "pos", h.heading_type(F.col("heading")).alias("node_type"), parts["reference_code"].alias("reference_code"), parts["title"].alias("title"), "hierarchy_path", F.trim(F.array_join("_b.t", "\n")).alias("content_text"))
    good = g.where(F.col("reference_code").rlike(r"\d") & (F.col("content_text") != ""))
    last = F.max("pos").over(Window.partitionBy(doc, "node_type", "reference_code"))
    return good.withColumn("_last", last).where("pos = _last").drop("_last")


def paragraphs(lines: DataFrame, doc: str, pos: str, text: str, rows: int = RANGE_ROWS) -> DataFrame:
    """(doc, element, kind, body, shown, cells) of plain lines: wrapped lines joined with blanks, neighbouring
    lines with tabs as one table (rows stay lines), short numbered lines as headings. Blank lines
    and starts of paragraphs part elements; footers of the publisher go."""
    line = lines.select(doc, pos, F.trim(text).alias("line")).where(~F.col("line").rlike(r"(?i)^Powered by EASA\b"))
    kind = F.when(F.col("line") == "", "blank").when(F.col("line").contains("\t"), "table").otherwise("text")
    marked = carried(ranged(line.withColumn("kind", kind), [doc], pos, rows), [doc], pos, {"_was": F.col("kind")}, here=False, rows=rows)
    begins = ~F.col("_was").eqNullSafe(F.col("kind")) | ((F.col("kind") == "text") & (h.like_any(F.col("line"), PARAGRAPH_START) | F.col("line").rlike("(?i)" + NOTE_START)))
    numbered = counted(marked, [doc], pos, begins, "element", rows).drop("_at").where("kind <> 'blank'")
    g = numbered.groupBy(doc, "element", "kind").agg(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("line").alias("t")))).alias("_l"))
    body = F.when(F.col("kind") == "table", F.array_join("_l.t", "\n")).otherwise(F.array_join("_l.t", " "))
    shown = F.when((F.col("kind") == "text") & body.rlike(SECTION_LINE), "heading").otherwise(F.col("kind"))
    g = g.select(doc, "element", shown.alias("kind"), body.alias("body"))
    return g.withColumns({"shown": shown_as(F.col("kind"), F.col("body")), "cells": table_cells(F.col("kind"), F.col("body"))})
