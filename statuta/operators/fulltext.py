"""Full-text search: a postings table with positions, questions, and cover density.

The index has a row for every occurrence of a term: (term, node_id, field, pos), positions from 1 with
stop words counted. Stored, it holds lists of nodes and positions, is partitioned by a hash of the term and sorted by term within, so a
question reads the files of its terms alone. Matching and ranking are joins, aggregates and
windows over these few rows; texts are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.english import TOKEN, lexeme, lexemes, may_be, words_of

FIELDS = ("content_text", "title")
#: Files of a stored index hold the terms whose crc32 agrees modulo this.
BUCKETS = 64
#: Words whose lists are put together at a time.
BLOCK_WORDS = 1 << 22
#: What a cover without other words between its terms adds to a rank.
WEIGHT = 0.1
_SHIFT = 1 << 31


def postings(nodes: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "node_id", only: list[str] | None = None) -> DataFrame:
    """(term, node_id, field, pos) of every word of the fields that is no stop word, or of some terms
    ``only``. Rows without text have none; a text of any length is one row's work."""
    if only is not None:
        # words that cannot have an asked stem go where the text is; the others are few
        word = F.transform("words", lambda w, i: F.struct(w.alias("word"), (i + 1).alias("pos")))
        some = _fields(nodes, fields, key).select("node_id", "field", words_of(F.col("text")).alias("words"))
        some = some.select("node_id", "field", F.explode(F.filter(word, lambda x: may_be(x["word"], only))).alias("p"))
        return some.select(F.get(lexemes(F.array("p.word"), only), F.lit(0)).alias("term"), "node_id", "field", "p.pos").where("term IS NOT NULL")
    placed = F.filter(F.transform("terms", lambda t, i: F.struct(t.alias("term"), (i + 1).alias("pos"))), lambda x: x["term"].isNotNull())
    terms = _fields(nodes, fields, key).select("node_id", "field", lexemes(words_of(F.col("text"))).alias("terms"))
    return terms.select("node_id", "field", F.explode(placed).alias("p")).select("p.term", "node_id", "field", "p.pos")


def _fields(nodes: DataFrame, fields: tuple[str, ...], key: str) -> DataFrame:
    of = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("f")
    return nodes.select(F.col(key).alias("node_id"), of).select("node_id", "f.field", "f.text")


def listed(nodes: DataFrame, fields: tuple[str, ...] = FIELDS, key: str = "node_id") -> DataFrame:
    """postings() in lists (term, field, held: (node_id, positions)): a row for each term and field of an Arrow
    batch of texts. They are put together where the texts are, so that few rows are shuffled and sorted."""
    rows = _fields(nodes, fields, key).select("node_id", "field", words_of(F.col("text")).alias("words"))
    kind = rows.schema["node_id"].dataType.simpleString()
    return rows.mapInArrow(_lists, f"term string, field string, held array<struct<node_id:{kind},positions:array<int>>>")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.r_[0, batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64).cumsum()]
        a = 0
        while a < batch.num_rows:  # as many rows as have BLOCK_WORDS, or one
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + BLOCK_WORDS, "right")) - 1)
            yield _list(batch.slice(a, b - a), ends[a : b + 1] - ends[a])
            a = b


def _list(batch: pa.RecordBatch, ends: np.ndarray) -> pa.RecordBatch:
    """The lists of some rows, whose words are ends[i]:ends[i + 1] of all."""
    words, field = batch.column(2).flatten().dictionary_encode(), batch.column(1).dictionary_encode()
    terms = pa.array([lexeme(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
    code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)[words.indices.to_numpy()]
    row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
    at = np.flatnonzero(code >= 0)
    fields, row = len(field.dictionary), row[at]
    group = code[at] * np.int64(fields) + field.indices.to_numpy()[row]
    order = np.argsort(group, kind="stable")  # rows and positions stay in order
    group, row, pos = group[order], row[order], (at - ends[row] + 1)[order]
    new = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new | np.r_[True, row[1:] != row[:-1]]) if len(group) else np.zeros(0, dtype=np.int64)
    heads = np.flatnonzero(new[first])
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(group)], pa.int32()), pa.array(pos, pa.int32()))
    held = pa.StructArray.from_arrays([batch.column(0).take(pa.array(row[first])), places], ["node_id", "positions"])
    held = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(first)], pa.int32()), held)
    group = group[first[heads]]
    return pa.record_batch([terms.dictionary.take(pa.array(group // fields)), field.dictionary.take(pa.array(group % fields)), held], ["term", "field", "held"])


def _bucket(term: Column, buckets: int) -> Column:
    return F.crc32(term.cast("binary")) % buckets


def write_postings(rows: DataFrame, path: str, buckets: int = BUCKETS, files: int = 1) -> None:
    """Stores postings or listed() in lists: a row for a term and field of a task's texts, its nodes with their positions
    in order. A bucket is written by ``files`` tasks, dealt by what the list begins with, so that a frequent term is no
    single task's."""
    if "held" not in rows.columns:
        one = rows.groupBy("term", "node_id", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
        rows = one.select("term", "field", F.array(F.struct("node_id", "positions")).alias("held"))
    rows = rows.withColumn("bucket", _bucket(F.col("term"), buckets))
    # by number: by hash some tasks would get several buckets
    task = F.col("bucket") * files + F.pmod(F.xxhash64(F.col("held")[0]["node_id"]), F.lit(files))
    rows.repartitionById(buckets * files, task.cast("int")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The postings of some terms: their partitions, and of these the row groups that may hold them."""
    wanted = sorted({zlib.crc32(t.encode()) % buckets for t in terms})
    rows = spark.read.parquet(path).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
    rows = rows.select("term", "field", F.explode("held").alias("h"))
    return rows.select("term", "h.node_id", "field", F.explode("h.positions").alias("pos"))


@dataclass(frozen=True)
class Operand:
    """Terms at fixed distances: one word, or a phrase whose stop words leave gaps."""

    terms: tuple[tuple[str, int], ...]

    @property
    def width(self) -> int:
        return self.terms[-1][1] + 1


def _operand(words: str) -> Operand | None:
    found = [(lexeme(w), i) for i, w in enumerate(re.findall(r"[^\W_]+", words.lower()))]
    found = [(t, i) for t, i in found if t is not None]
    return Operand(tuple((t, i - found[0][1]) for t, i in found)) if found else None


def parsed(question: str) -> list[list[tuple[bool, Operand]]]:
    """a question as alternatives of (wanted, operand): words must all be there, ``or`` parts
    alternatives, a hyphen before a word or quoted phrase forbids it; the words of a quoted phrase, or
    of one word such as a code, stand as far apart as in the question. Stop words ask for nothing.
    Alternatives that want nothing are left out."""
    out: list[list[tuple[bool, Operand]]] = [[]]
    for part in re.findall(r'-?"[^"]*"|\S+', question):
        if part.lower() == "or":
            out.append([])
        elif (o := _operand(part)) is not None and (not part.startswith("-"), o) not in out[-1]:
            out[-1].append((not part.startswith("-"), o))
    return [g for g in out if any(wanted for wanted, _ in g)]


def asked_terms(question: str) -> list[str]:
    """Every term that a question asks for or forbids."""
    return sorted({t for g in parsed(question) for _, o in g for t, _ in o.terms})


def _occurrences(rows: DataFrame, operands: list[Operand]) -> DataFrame:
    """(node_id, field, k, s, e): where operand k stands, first and last position. A term's postings
    propose the starts that fit its place in the operand; those that all terms propose are meant."""
    places: dict[str, list[tuple[int, int]]] = {}
    for k, o in enumerate(operands):
        for term, offset in o.terms:
            places.setdefault(term, []).append((k, offset))
    table = F.create_map(*[x for t, ps in places.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(k).alias("k"), F.lit(o).alias("o")) for k, o in ps]))])
    starts = rows.where(F.col("term").isin(list(places))).select("node_id", "field", "pos", F.explode(F.element_at(table, F.col("term"))).alias("p"))
    starts = starts.select("node_id", "field", F.col("p.k").alias("k"), (F.col("pos") - F.col("p.o")).alias("s"), F.col("p.o").alias("o"))
    size = F.element_at(F.array(*[F.lit(len(o.terms)) for o in operands]), F.col("k") + 1)
    width = F.element_at(F.array(*[F.lit(o.width) for o in operands]), F.col("k") + 1)
    whole = starts.groupBy("node_id", "field", "k", "s").agg(F.count_distinct("o").alias("n")).where(F.col("n") == size)
    return whole.select("node_id", "field", "k", "s", (F.col("s") + width - 1).alias("e"))


def covers(found: DataFrame, groups: list[tuple[list[int], list[int]]]) -> DataFrame:
    """(node_id, field, g, s, e, noise) of every minimal stretch that holds all wanted operands of an alternative g, in
    fields that hold no forbidden one; noise: positions in it that no operand fills. groups: (wanted, forbidden)
    operands of each alternative; all are found in one pass.

    In order of ends the latest start of each operand is known at every row; the least of these begins
    the shortest stretch that ends there, and the first row at which a begin comes up makes it
    minimal. One sort by field and alternative; its rows are the occurrences of the asked words in one field.
    """
    use = {}  # operand -> (alternative, place among its wanted operands, -1 if forbidden)
    for g, (wanted, forbidden) in enumerate(groups):
        for k, i in (*((k, i) for i, k in enumerate(wanted)), *((k, -1) for k in forbidden)):
            use.setdefault(k, []).append((g, i))
    table = F.create_map(*[x for k, us in use.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(g).alias("g"), F.lit(i).alias("i")) for g, i in us]))])
    found = found.select("node_id", "field", "k", "s", "e", F.explode(F.element_at(table, F.col("k"))).alias("u")).select("node_id", "field", "u.g", "u.i", "k", "s", "e")
    one = Window.partitionBy("node_id", "field", "g")
    if any(forbidden for _, forbidden in groups):
        found = found.withColumn("bad", F.max(F.col("i") < 0).over(one)).where("NOT bad")
    found = found.where("i >= 0")
    sweep = one.orderBy("e", "s", "k")
    so_far = sweep.rowsBetween(Window.unboundedPreceding, 0)
    rows = found.withColumn("filled", F.sum(F.col("e") - F.col("s") + 1).over(so_far))
    # a begin and what was filled before it, in one number: both grow along the sweep
    code = F.col("s").cast("long") * _SHIFT + F.col("filled") - (F.col("e") - F.col("s") + 1)
    most, none = max(len(wanted) for wanted, _ in groups), F.lit(1 << 62)
    asked = F.element_at(F.array(*[F.lit(len(wanted)) for wanted, _ in groups]), F.col("g") + 1)
    latest = [F.when(asked <= i, none).otherwise(F.max(F.when(F.col("i") == i, code)).over(so_far)) for i in range(most)]
    rows = rows.select("node_id", "field", "g", "k", "s", "e", "filled", *[x.alias(f"at{i}") for i, x in enumerate(latest)])
    names = [f"at{i}" for i in range(most)]
    begin = F.when(F.greatest(*[F.col(n).isNull().cast("int") for n in names], F.lit(0)) == 0, F.least(*[F.col(n) for n in names], none))
    rows = rows.select("node_id", "field", "g", "k", "s", "e", "filled", begin.alias("begin"))
    rows = rows.withColumn("last", F.lag("begin").over(sweep)).where("begin IS NOT NULL AND NOT begin <=> last")
    first = F.shiftright("begin", 31)
    inside = F.col("filled") - F.col("begin") % _SHIFT
    return rows.select("node_id", "field", "g", first.alias("s"), "e", F.greatest(F.lit(0), F.col("e") - first + 1 - inside).alias("noise"))


def search(rows: DataFrame, question: str) -> DataFrame:
    """(node_id, rank) of the nodes of which a field fits the question, from postings.

    rank is cover density: WEIGHT / (1 + noise) summed over the covers of all alternatives, of the
    better field. A question of stop words alone finds nothing.
    """
    groups = parsed(question)
    if not groups:
        return rows.select("node_id", F.lit(0.0).alias("rank")).limit(0)
    operands = list(dict.fromkeys(o for g in groups for _, o in g))
    uses = [tuple([operands.index(o) for wanted, o in g if wanted == yes] for yes in (True, False)) for g in groups]
    parts = covers(_occurrences(rows, operands), uses)
    fields = parts.groupBy("node_id", "field").agg(F.sum(F.lit(WEIGHT) / (1 + F.col("noise"))).alias("rank"))
    # rounded, so that equal ranks stay equal in whatever order they were summed
    return fields.groupBy("node_id").agg(F.round(F.max("rank"), 9).alias("rank"))


__all__ = ["FIELDS", "TOKEN", "asked_terms", "covers", "listed", "parsed", "postings", "read_postings", "search", "write_postings"]
