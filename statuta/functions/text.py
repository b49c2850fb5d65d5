"""Text, version and date functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .references import extracted

# How editions are named.
VERSION = r"(?i)\b(Amendment|Revision|Issue)\s+(\d+)"
PROBES = (r"(?i)(amendment\s+\d+)", r"(?i)(issue\s+\d+)", r"(?i)(revision\s+\d+)", r"(?i)(initial\s+issue)")
PROBE_CHARS = 32768


def normalised(text: Column) -> Column:
    """runs of blanks and tabs become one blank, lines are trimmed, empty ones go."""
    lines = F.transform(F.split(F.regexp_replace(text, r"[ \t]+", " "), r"\r\n|\r|\n"), lambda x: F.btrim(x, F.lit(" \t")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def first_upper(s: Column) -> Column:
    """First letter upper, the others lower."""
    return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))


def version_label(text: Column) -> Column:
    """the first edition named in a text."""
    return F.when(extracted(text, VERSION, 1).isNotNull(), F.concat(first_upper(extracted(text, VERSION, 1)), F.lit(" "), extracted(text, VERSION, 2)))


def probed_version(page: Column) -> Column:
    """The first of the ordered patterns that a page's head has, its first letter upper."""
    head = F.substring(page, 1, PROBE_CHARS)
    hit = F.coalesce(*[extracted(head, p, 1) for p in PROBES])
    return F.concat(F.upper(F.substring(hit, 1, 1)), F.substring(hit, 2, 1 << 30))


def outdated(local: Column, remote: Column) -> Column:
    """both known, and different but for case."""
    return F.coalesce(F.lower(local) != F.lower(remote), F.lit(False))


def latest_version(amended_by: Column) -> Column:
    """Of ``;``-separated tokens the edition with the highest number, the first on ties."""
    tokens = F.transform(F.split(amended_by, ";"), lambda t: F.struct(F.regexp_extract(t, VERSION, 2).try_cast("int").alias("n"), first_upper(F.regexp_extract(t, VERSION, 1)).alias("w")))
    best = F.aggregate(tokens, F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("w")), lambda a, t: F.when(t["n"].isNotNull() & (t["n"] > a["n"]), t).otherwise(a))
    return F.when(best["n"] >= 0, F.concat(best["w"], F.lit(" "), best["n"]))


def latest_date(dates: Column) -> Column:
    """The latest of ``;``-separated dates like ``22 February, 2021``; others are skipped."""
    return F.array_max(F.transform(F.split(dates, ";"), lambda t: F.to_date(F.try_to_timestamp(F.trim(t), F.lit("d MMMM, yyyy")))))


# Short names of months in British English and French.
MONTHS_EN = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sept", "Oct", "Nov", "Dec")
MONTHS_FR = ("janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc.")


def _month(date: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in names]), F.month(date))


def shown_day(date: Column) -> Column:
    """``5 Sept 2024``; nothing for no date."""
    return F.when(date.isNull(), "").otherwise(F.concat_ws(" ", F.dayofmonth(date).cast("string"), _month(date, MONTHS_EN), F.year(date).cast("string")))


def shown_month(date: Column) -> Column:
    """the French ``sept. 2024``; a dash for no date."""
    return F.when(date.isNull(), "—").otherwise(F.concat_ws(" ", _month(date, MONTHS_FR), F.year(date).cast("string")))


def breadcrumb(root: Column, path: Column, ref: Column, title: Column) -> Column:
    """``root > path > ref — title``, empty parts left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.concat(F.concat_ws(" > ", some(root), some(path), ref), F.when(some(title).isNotNull(), F.concat(F.lit(" — "), title)).otherwise(F.lit("")))


def page_kind(pages: Column) -> Column:
    """A long PDF is a consolidated edition, a short one a delta."""
    return F.when(pages > 200, "consolidated").when(pages > 0, "delta").otherwise("unknown")


def sniffed(content: Column, content_type: Column) -> Column:
    """PDF by type or magic bytes, HTML by type, else an archive."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(kind.contains("pdf") | (F.substring(content, 1, 4) == F.lit(b"%PDF")), "pdf").when(kind.contains("html"), "html").otherwise("zip")


def provider(url: Column) -> Column:
    """the kind of chat service behind an address."""
    u = F.lower(url)
    return F.when(u.contains("groq"), "groq").when(u.contains("openai"), "openai").when(u.contains("localhost") | u.contains("127.0.0.1") | u.contains("ollama"), "local").otherwise("other")


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity in double; null where a vector is zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def paragraph_level(line: Column) -> Column:
    """depth of a labelled paragraph: (a) 1, (1) 2, (i) 3, a dash 4, other text 0."""
    return F.when(line.rlike(r"^\s*\((?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\)"), 3).when(line.rlike(r"^\s*\([a-z]\)"), 1).when(line.rlike(r"^\s*\(\d+\)"), 2).when(line.rlike(r"^\s*[—–-]\s"), 4).otherwise(0)
