"""Helpers that several operators use: shared staging tables, size checks, word splitting."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
WS = r"\x20\x09-\x0D"
_TRIM = " \t\n\x0b\x0c\r"

#: Tables that staged() has written, by session, for sweep().
_written: weakref.WeakKeyDictionary[SparkSession, list[str]] = weakref.WeakKeyDictionary()

#: Rows and bytes up to which a lookup table may be broadcast; its size is measured first.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

#: Bits of the bitmap that thins rows before a shuffle: at most 8,192 rows of 4 KB, whatever the data.
BITMAP_BITS = 1 << 28
_BITS_A_ROW = 4096 * 8

#: A key with more than rows / HOT_KEYS rows is joined from a broadcast table, which has fewer than
#: HOT_KEYS rows whatever the data.
HOT_KEYS = 1 << 16


def stage_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. A session of one machine that has not
    set it gets a folder of its own; a cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="statuta-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: cuts the lineage, and a lost
    executor costs no recomputation of what stands above."""
    path = f"{stage_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(df.sparkSession, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], buckets: int, name: str) -> tuple[str, DataFrame]:
    """(table, df read back from it): df written once to the shared folder, in buckets by keys. A join
    on these keys leaves the table where it is and shuffles the other side alone. The caller
    drops the table; its files go with sweep()."""
    spark = df.sparkSession
    at, path = f"statuta_{name}_{uuid.uuid4().hex}", f"{stage_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(at, format="parquet")
    _written.setdefault(spark, []).append(path)
    return at, spark.table(at)


def bounded_broadcast(df: DataFrame) -> tuple[DataFrame, bool]:
    """df with a broadcast hint if its rows and bytes are measured to be few; else df and False."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        if f.dataType.typeName() in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
    rows, held = df.select(size.cast("long").alias("size")).limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    small = rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES
    return (F.broadcast(df), True) if small else (df, False)


def matched(rows: DataFrame, key: Column, side: DataFrame, how: str) -> DataFrame:
    """rows whose key is in side, a table of one column (how: left_semi), or is not (left_anti).

    A small side is broadcast. Beyond that a bitmap of fixed size, made of side's hashes, parts the
    rows: those it does not hold are settled where they are, and only the others, side's own
    partners and few more, are shuffled to meet side. A hot key of rows is split by AQE, which
    may divide the left side of these joins; side has one row a key.
    """
    [name] = side.columns
    small, fits = bounded_broadcast(side)
    if fits:
        return rows.join(small, key == small[name], how)
    at, bits = free_name(rows, "bitmap_row", "bitmap_bits")
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(BITMAP_BITS))
    row = lambda k: (place(k) / _BITS_A_ROW).cast("long")  # noqa: E731, below 2 ** 28, so exact
    bitmap = side.groupBy(row(F.col(name)).alias(at)).agg(F.bitmap_construct_agg(place(F.col(name)) % _BITS_A_ROW).alias(bits))
    near = rows.join(F.broadcast(bitmap), row(key) == bitmap[at], "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (place(key) % _BITS_A_ROW / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (place(key) % 8).cast("int")) == 1, F.lit(False))
    names = [F.col(f"`{c}`") for c in rows.columns]
    met = near.where(held).select(*names).join(side, key == side[name], how)
    return met if how == "left_semi" else near.where(~held).select(*names).unionByName(met)


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], total: int, members: str = "members", how: str = "inner") -> DataFrame:
    """The inner or left join of rows with keyed, which has one row a key and in ``members`` how many
    of the ``total`` rows have it, or more. Hot keys are joined where their rows are; of the others
    no key brings a task more than total / HOT_KEYS rows. Keys of rows are not null."""
    if total <= HOT_KEYS:
        return rows.join(F.broadcast(keyed), on, how)
    is_hot = F.col(members) > total / HOT_KEYS
    hot, cold = F.broadcast(keyed.where(is_hot)), keyed.where(~is_hot)
    return rows.join(hot, on).unionByName(rows.join(F.broadcast(keyed.where(is_hot).select(*on)), on, "left_anti").join(cold, on, how))


def words(text: Column | str) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    text = F.col(text) if isinstance(text, str) else text
    trimmed = F.btrim(text, F.lit(_TRIM))
    return F.when(trimmed.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{WS}]+"))


def n_words(text: Column | str) -> Column:
    """Number of words without building them."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WS}]+")), F.lit(0)).cast("long")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that df does not use, whatever extra columns it has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        name = w
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sweep(spark: SparkSession) -> None:
    """Removes the tables that staged() wrote for this session; call it when results are written."""
    jvm, mine = spark._jvm, _written.get(spark, [])
    while mine:
        path = jvm.org.apache.hadoop.fs.Path(mine.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
