"""Batch twins of the streaming jobs (the reference has no streams; these are an extension)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import shared_folder
from ..sources import views as v
from ..streaming.jobs import ChangeLog, event_windows, run_counters, sessions
from . import query


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 2) AS total FROM events GROUP BY 1, 2")
def events_window(spark, sf_dir):
    """Tumbling windows."""
    return event_windows(v.read(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, MIN(ts) AS start, MAX(ts) + INTERVAL '30 minutes' AS "end", COUNT(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf_dir):
    """Session windows."""
    return sessions(v.read(spark, sf_dir, "events"))


_RUNS = """
r AS (SELECT 0 AS batch_no, 'REF.' || doc_id AS reference_code, source AS doc, md5(CASE WHEN doc_id % 7 = 0 THEN 'Prior. ' || text ELSE text END) AS h, 0 AS place FROM documents WHERE doc_id % 10 <> 3
  UNION ALL SELECT 1, 'REF.' || doc_id, source, md5(text), 1 FROM documents WHERE doc_id % 10 <> 5 AND source <> 'src3'
  UNION ALL SELECT 1, 'REF.' || doc_id, source, md5('Again. ' || text), 2 FROM documents WHERE doc_id % 50 = 1 AND source <> 'src3'),
k AS (SELECT batch_no, reference_code, ARG_MIN(h, place) AS first_hash, ARG_MAX(h, place) AS last_hash, ANY_VALUE(doc) AS doc, COUNT(*) - 1 AS repeats FROM r GROUP BY ALL),
e AS (SELECT 0 AS batch_no, reference_code, 'added' AS change_type, NULL AS old_hash, first_hash AS new_hash, repeats FROM k WHERE batch_no = 0
  UNION ALL SELECT 1, COALESCE(b.reference_code, a.reference_code), CASE WHEN b.reference_code IS NULL THEN 'deleted' WHEN a.reference_code IS NULL THEN 'added' WHEN a.last_hash = b.first_hash THEN 'unchanged' ELSE 'modified' END, a.last_hash, b.first_hash, COALESCE(b.repeats, 0)
  FROM (FROM k WHERE batch_no = 0) a FULL JOIN (FROM k WHERE batch_no = 1) b ON a.reference_code = b.reference_code WHERE b.reference_code IS NOT NULL OR a.doc IN (SELECT doc FROM k WHERE batch_no = 1))"""


def _log(spark, sf_dir):
    """Two runs over the texts: all documents, then new versions of all but one, some rows twice."""
    d = v.read(spark, sf_dir, "documents")
    log = ChangeLog(shared_folder(spark, "change-log"), ("reference_code",), ("place",))
    row = lambda df, text, place: df.select(F.concat(F.lit("REF."), "doc_id").alias("reference_code"), F.col("source").alias("source_doc_id"), F.md5(text).alias("content_hash"), F.lit(place).alias("place"))
    first = row(d.where("doc_id % 10 <> 3"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("Prior. "), "text")).otherwise(F.col("text")), 0)
    log.apply(first, 0)
    later = d.where("source <> 'src3'")
    log.apply(row(later.where("doc_id % 10 <> 5"), F.col("text"), 1).unionByName(row(later.where("doc_id % 50 = 1"), F.concat(F.lit("Again. "), "text"), 2)), 1)
    return log, first.schema


@query(f"WITH {_RUNS} SELECT * FROM e")
def change_events(spark, sf_dir):
    """What two runs of the incremental harvest added, modified, left and deleted."""
    log, schema = _log(spark, sf_dir)
    return log.events(spark, schema).withColumn("batch_no", F.col("batch_no").cast("int"))


@query(f"""WITH {_RUNS} SELECT batch_no, COUNT(*) FILTER (change_type = 'added') AS nodes_added, COUNT(*) FILTER (change_type = 'modified') AS nodes_modified,
(COUNT(*) FILTER (change_type = 'unchanged') + SUM(repeats))::BIGINT AS nodes_unchanged, COUNT(*) FILTER (change_type = 'deleted') AS nodes_deleted FROM e GROUP BY batch_no""")
def change_counters(spark, sf_dir):
    """The counters of each run."""
    log, schema = _log(spark, sf_dir)
    return run_counters(log.events(spark, schema)).withColumn("batch_no", F.col("batch_no").cast("int"))


@query(f"""WITH {_RUNS} SELECT reference_code, last_hash AS content_hash FROM k WHERE batch_no = 1
UNION ALL SELECT reference_code, last_hash FROM k WHERE batch_no = 0 AND doc NOT IN (SELECT doc FROM k WHERE batch_no = 1) AND reference_code NOT IN (SELECT reference_code FROM k WHERE batch_no = 1)""")
def change_state(spark, sf_dir):
    """The table after both runs, compacted in between."""
    log, schema = _log(spark, sf_dir)
    log.compact(spark, schema)
    return log.state(spark, schema).select("reference_code", "content_hash")
