"""Topics of a document to typed nodes: overrides of type, appendices of articles, spurious ones removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import references as r
from ..functions.headings import with_parent
from .sequences import RANGE_ROWS, nearest_before

# Titles that name the article of an appendix; codes of an older numbering, which are no
# article's; a title or reference of an appendix.
NAMES_ARTICLE = r"(?iU)\bto\s+(?:AMC|GM|CS)\b"
OLD_CODE = r"\b25[A-Z]\d|\b[A-Z]25\."
IS_APPENDIX = r"(?iU)^Appendix\b"
TYPES = ("AMC", "GM", "IR", "CS")


def starts_appendix(title: Column) -> Column:
    """Whether a title begins as an appendix does, with a blank or a no-break space after it."""
    return F.upper(F.regexp_replace(title, r"(?U)^\s+", "")).rlike("^APPENDIX[  ]")


def refined_type(found: Column, title: Column, said: Column, stack: Column, default: str) -> Column:
    """a topic's type where its title leaves the document's default: what the contents say of it, if
    that is a type; and for an appendix that is still of the default, GM or AMC by what is said or
    by the headings above it, else AMC."""
    told = F.upper(F.coalesce(said, F.lit("")))
    first = F.when((found == default) & told.isin(*TYPES), told).otherwise(found)
    above = F.upper(F.concat_ws(" ", stack))
    note = F.when(told.contains("GM") | above.contains("GM"), "GM").otherwise("AMC")
    return F.when(starts_appendix(title) & (first == default), note).otherwise(first)


def typed_topics(topics: DataFrame, default: str, doc: str = "path", pos: str = "pos", rows: int = RANGE_ROWS) -> DataFrame:
    """The nodes (doc, pos, node_type, reference_code, title) of a document's topics.

    topics: (doc, pos, title, type_of_content, heading_stack, has_text). Titles without a code, and
    topics without text, are no nodes; of topics with one type and reference the first is. A
    standalone appendix gets the nearest article before it under the same headings into its
    reference: titles of appendices that name no article, and codes of the old numbering, are passed
    over; of appendices with one reference the first that has such an article decides, and the last node
    of the reference is the one that is renamed. A CS appendix whose reference an AMC or GM of
    the document has goes.
    """
    c = r.classified(F.col("title"), default)
    t = topics.withColumn("_c", c).select(
        F.col(doc).alias("doc"), F.col(pos).alias("pos"), "heading_stack", "has_text", F.col("title").alias("raw"), F.col("_c.node_type").alias("found"), F.col("_c.code").alias("code"), F.col("_c.title").alias("title"),
        refined_type(F.col("_c.node_type"), F.col("title"), F.col("type_of_content"), F.col("heading_stack"), default).alias("node_type"),
    )
    t = t.withColumns({"loose": starts_appendix(F.col("raw")) & ~F.col("raw").rlike(NAMES_ARTICLE), "by_title": r.reference_code(F.col("found"), F.col("code"), F.col("raw")), "reference_code": r.reference_code(F.col("node_type"), F.col("code"), F.col("raw"))})
    article = ~F.col("loose") & F.col("found").isin(*TYPES) & F.col("code").rlike(r.CODE) & ~F.col("code").rlike(OLD_CODE)
    t = nearest_before(t, ["doc", "heading_stack"], "pos", article, F.col("by_title"), "parent", rows)
    of = t.where("loose AND parent IS NOT NULL AND found IS NOT NULL").groupBy("doc", F.col("by_title").alias("reference_code")).agg(F.min_by("parent", "pos").alias("parent"))
    whole = t.where("has_text AND node_type IS NOT NULL AND code IS NOT NULL")
    first = whole.groupBy("doc", "node_type", "reference_code").agg(F.min_by(F.struct("pos", "title"), "pos").alias("f")).select("doc", "node_type", "reference_code", "f.pos", "f.title")
    last = F.max("pos").over(Window.partitionBy("doc", "reference_code"))
    named = first.withColumn("_last", last).join(of, ["doc", "reference_code"], "left")
    named = named.withColumn("reference_code", F.when(F.col("pos") == F.col("_last"), with_parent(F.col("reference_code"), F.col("parent"))).otherwise(F.col("reference_code")))
    notes = F.max(F.col("node_type").isin("AMC", "GM")).over(Window.partitionBy("doc", "reference_code"))
    kept = named.withColumn("_noted", notes).where(~((F.col("node_type") == "CS") & F.col("reference_code").rlike(IS_APPENDIX) & F.col("_noted")))
    return kept.select("doc", "pos", "node_type", "reference_code", "title")
