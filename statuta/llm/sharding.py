"""Operator 7: sharding by extendible hashing.

The directory is indexed by the leading bits of a hash of the document id. A bucket whose
bytes are above the limit is split on one more bit; the others keep their depth. Buckets
that hold one id only cannot be split by bits and are cut into parts instead.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_broadcast, free_name, matched, staged

SHARD_BYTES = 4 << 20
BITS = 60
#: Levels of the directory that one pass over the sizes settles beyond the expected depth.
MORE_BITS = 4


def hash_bits(key: Column) -> Column:
    """BITS leading bits of the md5 of the key's text; a null key counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, BITS // 4), 16, 10).cast("long")


def _leaves(pending: DataFrame, first: int, last: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves with a depth in first..last, and the buckets of depth ``last`` still too large."""
    bins = pending.groupBy(F.shiftright("h", BITS - last).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.count("*").alias("docs"))
    up = bins.withColumn("depth", F.explode(F.sequence(F.lit(first), F.lit(last))))
    up = up.withColumn("prefix", F.expr(f"shiftright(prefix, {last} - depth)"))
    nodes = up.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("docs").alias("docs"))
    closed = (F.col("bytes") <= limit) | (F.col("lo") == F.col("hi"))
    nodes = staged(nodes.withColumn("closed", closed), "shard-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("closed").alias("up_closed"))
    joined = nodes.where("closed").withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left")
    leaves = joined.where((F.col("depth") == first) | ~F.col("up_closed")).select("depth", "prefix", "bytes", "docs")
    return leaves, nodes.where((F.col("depth") == last) & ~F.col("closed")).select("prefix")


def directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The leaves (depth, prefix, bytes, docs) over sizes (h, bytes): buckets within the limit, or of
    one hash. Each later round splits what was too large for the one before it."""
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    last = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + MORE_BITS)
    first, pending, out = 0, sizes, None
    while True:
        leaves, large = _leaves(pending, first, last, limit)
        leaves = staged(leaves, "shard-leaves")
        out = leaves if out is None else out.unionByName(leaves)
        large = staged(large, "shard-large")
        if last == BITS or large.isEmpty():
            return out
        pending = matched(pending, F.shiftright("h", BITS - last), large, "left_semi")
        first, last = last + 1, min(BITS, last + 12)


def _placed(rows: DataFrame, h: str, leaves: DataFrame, leaf: str) -> DataFrame:
    """rows with the column ``leaf``, the leaf of their hash ``h``.

    Leaves are looked up by the bits of the shallowest of them: under such a slot stand the few
    leaves that hashing has split further. Where the slots are too many to broadcast, rows meet
    them in a shuffle by bucket, as writing shards needs anyway; AQE divides a hot one.
    """
    least = leaves.agg(F.min("depth")).first()[0] or 0
    [slot] = free_name(rows, "shard_slot")
    slots = leaves.groupBy(F.expr(f"shiftright(prefix, depth - {least})").alias(slot)).agg(F.collect_list(F.struct("depth", "prefix", "bytes", "docs")).alias(leaf))
    slots, _ = bounded_broadcast(slots)
    found = rows.join(slots, F.shiftright(rows[h], BITS - least) == slots[slot], "left").drop(slot)
    return found.withColumn(leaf, F.expr(f"get(filter(`{leaf}`, l -> shiftright(`{h}`, {BITS} - l.depth) = l.prefix), 0)"))


def _code(leaf: Column) -> Column:
    """The bits of a leaf's prefix, as many as it is deep."""
    return F.when(leaf["depth"] == 0, F.lit("")).otherwise(F.lpad(F.bin(leaf["prefix"]), leaf["depth"].cast("int"), F.lit("0")))


def shard(docs: DataFrame, limit: int = SHARD_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with columns shard (its prefix bits), shard_depth, shard_bytes and doc_bytes.

    Null texts weigh 0 bytes. A single text above the limit is a shard of its own. Rows that
    repeat an id stay together while they fit; the rows of ids that alone pass the limit are
    sharded by the bits of a hash of their whole content instead (``t.`` and bits), and equal rows
    above it are dealt to numbered parts. What rows a shard has depends on the table alone, so
    reruns and retried tasks agree. An empty table gives no shards. Clashing column names are
    prefixed.
    """
    h, leaf = free_name(docs, "shard_h", "shard_leaf")
    out, depth, total, own = free_name(docs, "shard", "shard_depth", "shard_bytes", "doc_bytes")
    names = [F.col(f"`{c}`") for c in docs.columns]
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    bits = hash_bits(F.col(key))
    sizes = staged(docs.select(bits.alias("h"), size.alias("bytes")), "shard-sizes")
    leaves = directory(sizes, limit)
    rows = _placed(docs.withColumns({h: bits, own: size}), h, leaves, leaf)
    over = lambda c: (c["bytes"] > limit) & (c["docs"] > 1)
    deep = F.col(f"{leaf}.depth").cast("int").alias(depth)
    plain = rows.where(~over(F.col(leaf))).select(*names, _code(F.col(leaf)).alias(out), deep, F.col(f"{leaf}.bytes").alias(total), own)
    if leaves.where((F.col("bytes") > limit) & (F.col("docs") > 1)).isEmpty():
        return plain
    # ids above the limit: by content
    content = F.shiftrightunsigned(F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]), 64 - BITS)
    many = staged(rows.where(over(F.col(leaf))).select(*names, own, content.alias(h), deep), "shard-repeats")
    leaves = directory(many.select(F.col(h).alias("h"), F.col(own).alias("bytes")), limit)
    many = _placed(many, h, leaves, leaf)
    code = F.concat(F.lit("t."), _code(F.col(leaf)))
    plain = plain.unionByName(many.where(~over(F.col(leaf))).select(*names, code.alias(out), depth, F.col(f"{leaf}.bytes").alias(total), own))
    if leaves.where((F.col("bytes") > limit) & (F.col("docs") > 1)).isEmpty():
        return plain
    # equal rows: numbered within the task that read them, then after the tasks before it
    salt, nth, before = free_name(docs, "shard_salt", "shard_nth", "shard_before")
    equal = staged(many.where(over(F.col(leaf))).select(*names, own, h, depth, leaf, F.spark_partition_id().alias(salt)), "shard-equal")
    held = equal.groupBy(h, salt).agg(F.count("*").alias(nth))
    earlier = Window.partitionBy(h).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(h, salt, F.coalesce(F.sum(nth).over(earlier), F.lit(0)).alias(before))
    equal = equal.withColumn(nth, F.row_number().over(Window.partitionBy(h, salt).orderBy(own)) - 1).join(held, [h, salt])
    a_part = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.col(own)).cast("long"))
    at = F.col(nth) + F.col(before)
    part = F.floor(at / a_part).cast("long")
    weight = F.least(a_part, F.col(f"{leaf}.docs") - part * a_part) * F.col(own)
    return plain.unionByName(equal.select(*names, F.concat_ws(".", code, part.cast("string")).alias(out), depth, weight.alias(total), own))
