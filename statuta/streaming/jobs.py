"""Structured Streaming: an incremental harvest with its events, progress, and event windows (an extension)."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType


#: Parts by key of every delta and base.
BUCKETS = 32


def first_seen(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once; keys are forgotten when the watermark has passed them."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


@dataclass(frozen=True)
class ChangeLog:
    """A keyed table as a log of runs, with what each run changed.

    A run's delta has a row for each key that it touched: the row's new state, or its removal, and the
    event. Deltas and bases lie in buckets of keys; a part counts once its _SUCCESS is there.
    folder: shared by driver and executors; doc: the column of the document that a row is of; digest:
    of its content; order: which of several rows of a key in a run comes first.
    """

    folder: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    doc: str = "source_doc_id"
    digest: str = "content_hash"
    buckets: int = BUCKETS

    def _runs(self, spark: SparkSession, kind: str) -> dict[int, list[int]]:
        """The finished runs of a kind (delta, base) and their buckets."""
        hadoop = spark._jvm.org.apache.hadoop.fs.Path
        top = hadoop(f"{self.folder.rstrip('/')}/{kind}")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        names = lambda p: [str(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
        out = {}
        for name in names(top):
            inside = names(hadoop(top, name))
            if "=" in name and "_SUCCESS" in inside:
                out[int(name.split("=")[1])] = sorted(int(x.split("=")[1]) for x in inside if x.startswith("bucket="))
        return dict(sorted(out.items()))

    def _read(self, spark: SparkSession, kind: str, parts: list[tuple[int, int]], schema: StructType) -> DataFrame:
        top = f"{self.folder.rstrip('/')}/{kind}"
        whole = StructType([*schema.fields, *_EVENT.fields, StructField("batch_no", LongType()), StructField("bucket", IntegerType())])
        if not parts:
            return spark.createDataFrame([], whole)
        return spark.read.schema(whole).option("basePath", top).parquet(*[f"{top}/batch_no={n}/bucket={b}" for n, b in parts])

    def state(self, spark: SparkSession, schema: StructType, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the table, or as they were before a run; none if there was no run yet. A key's latest
        row counts, in the latest base of its bucket and the deltas after it."""
        asked = lambda n, b: (before is None or n < before) and (buckets is None or b in buckets)
        base = {b: n for n, bs in self._runs(spark, "base").items() for b in bs if asked(n, b)}
        deltas = [(n, b) for n, bs in self._runs(spark, "delta").items() for b in bs if asked(n, b) and n > base.get(b, -1)]
        rows = self._read(spark, "base", [(n, b) for b, n in base.items()], schema).unionByName(self._read(spark, "delta", deltas, schema))
        rest = F.struct(*[c for c in rows.columns if c not in (*self.keys, "batch_no")])
        last = rows.groupBy(*self.keys).agg(F.max_by(rest, "batch_no").alias("r")).where("NOT r.removed")
        return last.select(*[F.col(c) if c in self.keys else F.col(f"r.{c}") for c in schema.fieldNames()])

    def apply(self, batch: DataFrame, number: int) -> None:
        """Writes run ``number``: the batch's rows against the state before it, so that a run that is
        repeated after a failure writes the same.

        A key that the state lacks is added, one with another digest modified, else unchanged; of a
        key that comes several times in a run the first row is the event and the last one the state
        (repeats: the others). Stored keys of the batch's documents that it has not are deleted;
        keys of other documents stay. One full outer join on the key.
        """
        keys, spark = list(self.keys), batch.sparkSession
        place, rest = F.struct(*self.order), F.struct(*[c for c in batch.columns if c not in self.keys])
        now = batch.groupBy(*keys).agg(F.min_by(self.digest, place).alias("new_hash"), F.max_by(rest, place).alias("now"), (F.count("*") - 1).alias("repeats"))
        touched = batch.groupBy(F.col(self.doc).alias("_doc")).agg(F.lit(True).alias("_touched"))
        old = self.state(spark, batch.schema, before=number)
        old = old.join(touched, old[self.doc] == touched["_doc"], "left").select(*keys, F.struct(*[c for c in batch.columns if c not in self.keys]).alias("old"), F.coalesce("_touched", F.lit(False)).alias("touched"))
        both = now.join(old, keys, "full_outer").where("now IS NOT NULL OR touched")
        was = F.col(f"old.{self.digest}")
        kind = F.when(F.col("now").isNull(), "deleted").when(F.col("old").isNull(), "added").when(F.col("new_hash").eqNullSafe(was), "unchanged").otherwise("modified")
        value = lambda c: F.when(F.col("now").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"now.{c}")).alias(c)
        rows = both.select(
            *[F.col(c) if c in self.keys else value(c) for c in batch.columns], F.col("now").isNull().alias("removed"), kind.alias("change_type"), was.alias("old_hash"), "new_hash", F.coalesce("repeats", F.lit(0)).cast("long").alias("repeats"),
            F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int").alias("bucket"),
        )
        self._write(rows, f"delta/batch_no={number}")

    def _write(self, rows: DataFrame, part: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder.rstrip('/')}/{part}")

    def events(self, spark: SparkSession, schema: StructType, number: int | None = None) -> DataFrame:
        """(batch_no, keys, change_type, old_hash, new_hash, repeats) of one run or of all."""
        parts = [(n, b) for n, bs in self._runs(spark, "delta").items() for b in bs if number is None or n == number]
        return self._read(spark, "delta", parts, schema).select("batch_no", *self.keys, "change_type", "old_hash", "new_hash", "repeats")

    def compact(self, spark: SparkSession, schema: StructType) -> None:
        """Folds the buckets that have deltas after their base into a new base of the latest run; the
        others stay where they are. Nothing happens without a run. Older parts may then be removed."""
        runs, base = self._runs(spark, "delta"), {b: n for n, bs in self._runs(spark, "base").items() for b in bs}
        changed = sorted({b for n, bs in runs.items() for b in bs if n > base.get(b, -1)})
        if not changed:
            return
        rows = self.state(spark, schema, buckets=changed)
        event = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "removed" else F.lit(False).alias("removed") for f in _EVENT.fields]
        self._write(rows.select("*", *event, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")), f"base/batch_no={max(runs)}")


_EVENT = StructType([StructField("removed", BooleanType()), StructField("change_type", StringType()), StructField("old_hash", StringType()), StructField("new_hash", StringType()), StructField("repeats", LongType())])


def harvest(stream: DataFrame, log: ChangeLog, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of the stream is a run of the log."""
    return stream.writeStream.foreachBatch(lambda batch, number: log.apply(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_counters(events: DataFrame) -> DataFrame:
    """Of each run how many keys were added, modified, unchanged (repeats count as such) and deleted."""
    n = lambda k: F.count_if(F.col("change_type") == k)
    return events.groupBy("batch_no").agg(n("added").alias("nodes_added"), n("modified").alias("nodes_modified"), (n("unchanged") + F.sum("repeats")).alias("nodes_unchanged"), n("deleted").alias("nodes_deleted"))


class ProgressLog(StreamingQueryListener):
    """The last lines on the progress of a session's streams, at most ``most`` of them. Register
    with spark.streams.addListener()."""

    def __init__(self, most: int = 200):
        self._lines: deque[tuple[int, str]] = deque(maxlen=most)
        self._seen = 0

    def _add(self, line: str) -> None:
        self._seen += 1
        self._lines.append((self._seen, line))

    def onQueryStarted(self, event) -> None:
        self._add(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._add(f"run {p.batchId} of {p.name or p.id}: {p.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._add(f"ended {event.id}" + (f": {event.exception}" if event.exception else ""))

    def table(self, spark: SparkSession) -> DataFrame:
        """(line_no, line) of what is held."""
        return spark.createDataFrame(list(self._lines), "line_no long, line string")


def event_windows(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events by type and window of event time; works on streams and tables."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return df.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """A user's events without a pause longer than gap, as sessions."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_table_as_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)

