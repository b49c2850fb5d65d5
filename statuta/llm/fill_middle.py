"""Operator 11: fill-in-the-middle transformation by escaped marker injection.

A delimiter that the text cannot hold after escaping is put behind every line by one
regexp_replace; counting it counts the lines, and substring_index cuts the text after any
number of them. Prefix, middle and suffix are unescaped and put together in the order of the
form. Everything is a column expression of the row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

#: Ends every unit of a marked text, and what stands for itself and for the delimiter in an escaped one.
DELIMITER, ESCAPE = "\x1e", "\x1b"
UNIT = r"[^\n]*\n|[^\n]+"
#: Marks of the parts in an output; a text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "7:"


def escaped(text: Column) -> Column:
    """The text with no DELIMITER in it; unescaped() gives it back."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def marked(text: Column, unit: str = UNIT) -> Column:
    """The escaped text with DELIMITER behind each match of ``unit``."""
    return F.regexp_replace(escaped(text), unit, "$0" + DELIMITER)


def n_units(mark: Column) -> Column:
    return F.octet_length(mark) - F.octet_length(F.replace(mark, F.lit(DELIMITER), F.lit("")))


def _head(mark: Column, n: Column) -> Column:
    """The first n units of a marked text, delimiters between them."""
    return F.call_function("substring_index", mark, F.lit(DELIMITER), n)


def _tail(mark: Column, n: Column) -> Column:
    """The last n units of a text that ends without its last delimiter."""
    return F.call_function("substring_index", mark, F.lit(DELIMITER), -n)


def _plain(mark: Column) -> Column:
    return unescaped(F.replace(mark, F.lit(DELIMITER), F.lit("")))


def draws(key: Column, seed: str = SEED, n: int = 4) -> Column:
    """Array of n unsigned 32-bit numbers from the sha256 of seed and key; a null key counts as the text 'null'."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(n)])


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 100, spm_percent: int = 50, seed: str = SEED) -> DataFrame:
    """docs with fim_units, fim_form (plain, psm or spm), fim_prefix, fim_middle, fim_suffix and fim_output.

    Of the texts that can be cut, ``percent`` in a hundred are, and ``spm_percent`` of those with the
    suffix first; cuts fall behind whole lines, at hash-drawn places. Null and empty texts and
    texts that hold one of the three marks stay plain: their output is the text ('' for null), their
    parts are null. A text of any length is one row's work, some copies of it in memory. Rows with
    one key are cut alike where their texts are equal. Texts may hold DELIMITER and ESCAPE. An
    empty table gives no rows. Where docs has columns of these names, the new ones get an underscore.
    """
    units, form, prefix, middle, suffix, output = free_name(docs, "fim_units", "fim_form", "fim_prefix", "fim_middle", "fim_suffix", "fim_output")
    draw, mark, low, high = free_name(docs, "fim_draw", "fim_mark", "fim_low", "fim_high")
    c = lambda name: F.col(f"`{name}`")
    whole = F.coalesce(c(text), F.lit(""))
    rows = docs.withColumns({draw: draws(c(key), seed), mark: marked(whole)})
    rows = rows.withColumn(units, n_units(c(mark)).cast("long"))
    cut = lambda k: F.pmod(F.get(c(draw), F.lit(k)), c(units) + 1)
    holds = whole.contains(PREFIX) | whole.contains(SUFFIX) | whole.contains(MIDDLE)
    stays = (whole == "") | holds | (F.get(c(draw), F.lit(2)) % 100 >= percent)
    spm = F.get(c(draw), F.lit(3)) % 100 < spm_percent
    rows = rows.withColumns({low: F.least(cut(0), cut(1)).cast("int"), high: F.greatest(cut(0), cut(1)).cast("int"), form: F.when(stays, "plain").when(spm, "spm").otherwise("psm")})
    to_high = _head(c(mark), c(high))
    all_units = _head(c(mark), c(units).cast("int"))
    part = lambda x: F.when(c(form) != "plain", _plain(x))
    rows = rows.withColumns({prefix: part(_head(c(mark), c(low))), middle: part(_tail(to_high, c(high) - c(low))), suffix: part(_tail(all_units, c(units).cast("int") - c(high)))})
    psm = F.concat(F.lit(PREFIX), c(prefix), F.lit(SUFFIX), c(suffix), F.lit(MIDDLE), c(middle))
    spm_first = F.concat(F.lit(SUFFIX), c(suffix), F.lit(PREFIX), c(prefix), F.lit(MIDDLE), c(middle))
    rows = rows.withColumn(output, F.when(c(form) == "psm", psm).when(c(form) == "spm", spm_first).otherwise(whole))
    return rows.drop(draw, mark, low, high)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of transform() was made of."""
    cut = lambda x, at, n: F.substring_index(x, at, n)
    head, middle = cut(output, MIDDLE, 1), cut(output, MIDDLE, -1)
    psm = F.concat(F.replace(cut(head, SUFFIX, 1), F.lit(PREFIX), F.lit("")), middle, cut(head, SUFFIX, -1))
    spm = F.concat(cut(head, PREFIX, -1), middle, F.replace(cut(head, PREFIX, 1), F.lit(SUFFIX), F.lit("")))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every row of
    docs; cases as in transform()."""
    rows = transform(docs.select("doc_id", "text"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return rows.select(
        "doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.char_length("fim_prefix").cast("long").alias("prefix_chars"), F.char_length("fim_middle").cast("long").alias("middle_chars"),
        digest(F.col("fim_output")).alias("output_sha256"), digest(restored(F.col("fim_output"), F.col("fim_form"))).alias("restored_sha256"),
    )
