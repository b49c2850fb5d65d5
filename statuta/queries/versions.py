"""Change detection, histories, keyed writes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.diff import word_diff as diff_words
from ..functions.text import outdated
from ..operators import versions as o
from ..plans import harvest
from ..sources import views as v
from . import query

_CHANGED = v.OLD_NEW + """,
changed AS (SELECT COALESCE(a.reference_code, b.reference_code) AS reference_code, COALESCE(a.doc_key, b.doc_key) AS doc_key,
  CASE WHEN a.reference_code IS NULL THEN 'added' WHEN b.reference_code IS NULL THEN 'deleted' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'modified' END AS change_type,
  a.content_hash AS old_hash, b.content_hash AS new_hash FROM old_nodes a FULL OUTER JOIN new_nodes b ON a.reference_code = b.reference_code)"""


@query(f"WITH {_CHANGED} SELECT reference_code, change_type, old_hash, new_hash FROM changed")
def change_detect(spark, sf_dir):
    """J20."""
    return o.changes(*v.old_and_new(spark, sf_dir))


@query(f"""WITH {_CHANGED} SELECT COUNT(*) FILTER (change_type = 'added') AS nodes_added, COUNT(*) FILTER (change_type = 'modified') AS nodes_modified, COUNT(*) FILTER (change_type = 'unchanged') AS nodes_unchanged,
COUNT(*) FILTER (change_type = 'deleted') AS nodes_deleted, COUNT(*) AS nodes_total FROM changed""")
def change_counts(spark, sf_dir):
    """A7."""
    return o.counters(o.changes(*v.old_and_new(spark, sf_dir)))


@query(f"""WITH {v.OLD_NEW}, f AS (SELECT COALESCE(a.doc_key, b.doc_key) AS doc_key, a.reference_code AS x, b.reference_code AS y, a.content_hash AS h, b.content_hash AS g FROM old_nodes a FULL OUTER JOIN new_nodes b ON a.reference_code = b.reference_code)
SELECT doc_key, COUNT(*) FILTER (y IS NULL) AS only_old, COUNT(*) FILTER (x IS NULL) AS only_new, COUNT(*) FILTER (h = g) AS same, COUNT(*) FILTER (h <> g) AS different FROM f GROUP BY doc_key""")
def version_compare(spark, sf_dir):
    """Set comparison of two parses, per document."""
    a, b = v.old_and_new(spark, sf_dir)
    a, b = (x.select("reference_code", F.col("doc_key").alias(f"d{k}"), F.col("content_hash").alias(f"h{k}")) for k, x in enumerate((a, b)))
    f = a.join(b, "reference_code", "full_outer")
    return f.groupBy(F.coalesce("d0", "d1").alias("doc_key")).agg(F.count_if(F.col("h1").isNull()).alias("only_old"), F.count_if(F.col("h0").isNull()).alias("only_new"), F.count_if(F.col("h0") == F.col("h1")).alias("same"), F.count_if(F.col("h0") != F.col("h1")).alias("different"))


@query(f"""WITH {v.OLD_NEW}, batch AS (SELECT * FROM new_nodes WHERE content_hash < '8')
SELECT reference_code, doc_key FROM old_nodes a WHERE doc_key IN (SELECT doc_key FROM batch) AND NOT EXISTS (SELECT 1 FROM batch b WHERE b.reference_code = a.reference_code AND b.doc_key = a.doc_key)""")
def stale_nodes(spark, sf_dir):
    """K4."""
    a, b = v.old_and_new(spark, sf_dir)
    return o.stale(a, b.where("content_hash < '8'"), "doc_key", ["reference_code"]).select("reference_code", "doc_key")


def _event_versions(spark, sf_dir):
    """Events as node versions: a user's value is the content."""
    return v.read(spark, sf_dir, "events").select(F.col("user_id").alias("node_id"), F.col("event_type").alias("version_label"), F.col("ts").alias("fetched_at"), "event_id", F.floor("value").cast("int").alias("content"))


@query("""SELECT user_id AS node_id, event_id, event_type AS version_label, ROW_NUMBER() OVER w AS version_num,
CASE WHEN LAG(event_id) OVER w IS NULL THEN 'added' WHEN LAG(FLOOR(value)::INTEGER) OVER w = FLOOR(value)::INTEGER THEN 'unchanged' ELSE 'modified' END AS change_type
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def node_history(spark, sf_dir):
    """The versions of every node, each against the one before."""
    w = Window.partitionBy("node_id").orderBy("fetched_at", "event_id")
    kind = F.when(F.lag("event_id").over(w).isNull(), "added").when(F.lag("content").over(w) == F.col("content"), "unchanged").otherwise("modified")
    return _event_versions(spark, sf_dir).select("node_id", "event_id", "version_label", F.row_number().over(w).cast("long").alias("version_num"), kind.alias("change_type"))


@query(f"""WITH {v.RUNS}, {v.HARVEST_DOCS} SELECT r.doc_key, d.title, r.day, r.nodes_added, r.nodes_modified, r.nodes_total, r.fetched_at FROM runs r JOIN harvest_docs d ON d.doc_id = r.doc_key
WHERE d.title ILIKE '%src1%' OR d.version_label ILIKE 'issue%' OR EXISTS (SELECT 1 FROM documents n WHERE n.source = d.doc_id AND 'Corpus ' || n.source = 'Corpus src4')""")
def run_history(spark, sf_dir):
    """Runs of the documents whose title or label matches, or that have the root."""
    d, r = v.harvest_docs(spark, sf_dir), v.runs(spark, sf_dir)
    roots = v.read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.concat(F.lit("Corpus "), F.col("source")).alias("root")).distinct()
    flag = roots.where("root = 'Corpus src4'").select("doc_id", F.lit(True).alias("has_root"))
    d = d.join(flag, "doc_id", "left").where(F.col("title").ilike("%src1%") | F.col("version_label").ilike("issue%") | F.coalesce("has_root", F.lit(False)))
    return r.join(d.select(F.col("doc_id").alias("doc_key"), "title"), "doc_key").select("doc_key", "title", "day", "nodes_added", "nodes_modified", "nodes_total", "fetched_at")


_EDITIONS = """
editions AS (SELECT 'src' || (o_custkey % 25) AS source_key, 'Amendment ' || (o_orderkey % 30) AS version_label, MAX(o_orderdate)::DATE AS pub_date,
  CASE WHEN o_orderkey % 3 = 0 THEN 'xml' ELSE 'pdf' END AS doc_type, 'u' || MIN(o_orderkey) AS url, MAX(o_orderkey % 30) = 29 AS is_latest_pdf FROM orders GROUP BY 1, 2, 4)"""


def _editions(spark, sf_dir):
    k = F.col("o_orderkey")
    return (
        v.read(spark, sf_dir, "orders")
        .groupBy(F.concat(F.lit("src"), F.col("o_custkey") % 25).alias("source_key"), F.concat(F.lit("Amendment "), k % 30).alias("version_label"), F.when(k % 3 == 0, "xml").otherwise("pdf").alias("doc_type"))
        .agg(F.to_date(F.max("o_orderdate")).alias("pub_date"), F.concat(F.lit("u"), F.min("o_orderkey")).alias("url"), (F.max(k % 30) == 29).alias("is_latest_pdf"))
    )


@query(f"""WITH {_EDITIONS}, {v.HARVEST_DOCS} SELECT e.source_key, e.version_label, e.doc_type, e.pub_date, e.url, NULLIF(CASE WHEN e.doc_type = 'xml' THEN COALESCE(d.n, 0) ELSE 0 END, 0) AS node_count
FROM editions e LEFT JOIN harvest_docs d ON d.doc_id = e.source_key""")
def edition_history(spark, sf_dir):
    """Editions with the number of nodes of their document, none shown as null."""
    d = v.harvest_docs(spark, sf_dir).select(F.col("doc_id").alias("source_key"), "n")
    e = _editions(spark, sf_dir).join(d, "source_key", "left")
    count = F.when(F.col("doc_type") == "xml", F.coalesce("n", F.lit(0))).otherwise(0)
    return e.select("source_key", "version_label", "doc_type", "pub_date", "url", F.nullif(count.cast("long"), F.lit(0)).alias("node_count"))


@query(f"""WITH {_EDITIONS} SELECT source_key, version_label, doc_type, pub_date, ROW_NUMBER() OVER (PARTITION BY source_key ORDER BY pub_date DESC NULLS LAST, version_label DESC, doc_type) AS place FROM editions""")
def edition_order(spark, sf_dir):
    """The order in which editions are listed, as a rank."""
    w = Window.partitionBy("source_key").orderBy(F.col("pub_date").desc_nulls_last(), F.col("version_label").desc(), "doc_type")
    return _editions(spark, sf_dir).select("source_key", "version_label", "doc_type", "pub_date", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {_EDITIONS}, x AS (SELECT * FROM editions WHERE doc_type = 'xml'), p AS (SELECT * FROM editions WHERE doc_type = 'pdf')
SELECT COALESCE(x.source_key, p.source_key) AS source_key, COALESCE(x.version_label, p.version_label) AS version_label, x.url AS xml_url, p.url AS pdf_url FROM x FULL OUTER JOIN p ON x.source_key = p.source_key AND x.version_label = p.version_label""")
def edition_twin(spark, sf_dir):
    """J26."""
    return o.with_twin(_editions(spark, sf_dir))


@query(f"""WITH {_EDITIONS} SELECT source_key, version_label, doc_type, CASE WHEN doc_type = 'xml' THEN TRUE ELSE NOT (SELECT bool_or(b.doc_type = 'xml') FROM editions b WHERE b.source_key = e.source_key) AND is_latest_pdf END AS is_indexed FROM editions e""")
def is_indexed(spark, sf_dir):
    """F39."""
    return o.indexed_rule(_editions(spark, sf_dir)).select("source_key", "version_label", "doc_type", "is_indexed")


@query(f"""WITH {v.OLD_NEW} SELECT COALESCE(b.reference_code, a.reference_code) AS reference_code, COALESCE(b.doc_key, a.doc_key) AS doc_key, COALESCE(b.content_hash, a.content_hash) AS content_hash,
CASE WHEN a.reference_code IS NULL THEN 2 ELSE 1 END AS created_run, CASE WHEN b.reference_code IS NULL THEN 1 ELSE 2 END AS updated_run FROM old_nodes a FULL OUTER JOIN new_nodes b ON a.reference_code = b.reference_code""")
def upsert_nodes(spark, sf_dir):
    """K3: created_at stays, the rest is new."""
    a, b = (x.select("reference_code", "doc_key", "content_hash", F.lit(k).alias("created_run"), F.lit(k).alias("updated_run")) for k, x in enumerate(v.old_and_new(spark, sf_dir), 1))
    return o.upsert(a, b, ["reference_code"], keep_old=("created_run",))


@query(f"""WITH {v.EDGES}, old_e AS (SELECT *, 'old' AS notes FROM edges WHERE substring(source_node_id, 2)::BIGINT % 2 = 0)
SELECT * FROM old_e UNION ALL SELECT DISTINCT source_node_id, target_node_id, relation, 'new' AS notes FROM edges e WHERE NOT EXISTS (SELECT 1 FROM old_e x WHERE x.source_node_id = e.source_node_id AND x.target_node_id = e.target_node_id AND x.relation = e.relation)""")
def upsert_edges(spark, sf_dir):
    """K6: on conflict do nothing."""
    e = v.edges(spark, sf_dir)
    old = e.where(F.substring("source_node_id", 2, 20).cast("long") % 2 == 0).withColumn("notes", F.lit("old"))
    return o.insert_missing(old, e.withColumn("notes", F.lit("new")), ["source_node_id", "target_node_id", "relation"])


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'x' || c_custkey END AS link FROM customer WHERE c_custkey % 5 <> 0),
b AS (SELECT c_custkey AS k, c_mktsegment AS name, CASE WHEN c_custkey % 3 = 0 THEN 'y' || c_custkey END AS link FROM customer WHERE c_custkey % 7 <> 0)
SELECT COALESCE(a.k, b.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name, COALESCE(b.link, a.link) AS link FROM a FULL OUTER JOIN b ON a.k = b.k""")
def upsert_coalesce(spark, sf_dir):
    """A null of the new row leaves the stored link."""
    c, k = v.read(spark, sf_dir, "customer"), F.col("c_custkey")
    a = c.where(k % 5 != 0).select(k.alias("k"), F.col("c_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit("x"), k)).alias("link"))
    b = c.where(k % 7 != 0).select(k.alias("k"), F.col("c_mktsegment").alias("name"), F.when(k % 3 == 0, F.concat(F.lit("y"), k)).alias("link"))
    return o.upsert(a, b, ["k"], fill=("link",))


#: SQL: words of a text x as the diff sees them.
_WORDS = r"regexp_extract_all({x}, '\S+')"


def _replayed(df, *names):
    """names, and of the column diff its sizes in words and what its runs replay on either side."""
    size = lambda op: F.aggregate(F.filter("diff", lambda d: d["op"] == op), F.lit(0), lambda n, d: n + F.regexp_count(d["text"], F.lit(r"(?U)\S+"))).cast("long")
    side = lambda skip: F.md5(F.array_join(F.transform(F.filter("diff", lambda d: d["op"] != skip), lambda d: d["text"]), " "))
    return df.select(*names, size("equal").alias("n_equal"), size("delete").alias("n_deleted"), size("insert").alias("n_inserted"), side("insert").alias("old_md5"), side("delete").alias("new_md5"))


@query(f"""WITH {v.OLD_NEW} SELECT o.reference_code, len(w.n)::BIGINT AS n_equal, 1::BIGINT AS n_deleted, 0::BIGINT AS n_inserted, md5(array_to_string(list_prepend('Prior.', w.n), ' ')) AS old_md5, md5(array_to_string(w.n, ' ')) AS new_md5
FROM old_nodes o JOIN new_nodes n ON o.reference_code = n.reference_code AND o.content_hash <> n.content_hash, LATERAL (SELECT {_WORDS.format(x='n.content_text')} AS n) w""")
def word_diff(spark, sf_dir):
    """the whole diff of every modified node's two texts, by what its runs replay and how long they are."""
    a, b = v.old_and_new(spark, sf_dir)
    j = a.select("reference_code", F.col("content_text").alias("old_text"), F.col("content_hash").alias("h")).join(b.select("reference_code", "content_text", "content_hash"), "reference_code").where("h <> content_hash")
    return _replayed(j.select("reference_code", diff_words("old_text", "content_text").alias("diff")), "reference_code")


_EDITIONS_OF = f"""
w AS (SELECT doc_id, {_WORDS.format(x='text')} AS w FROM documents),
versions AS (SELECT doc_id, 1 AS version_num, w FROM w UNION ALL SELECT doc_id, 2, list_transform(w, lambda x, i: CASE WHEN i % 17 = 0 THEN '@@' ELSE x END) FROM w
  UNION ALL SELECT doc_id, 3, list_filter(list_transform(w, lambda x, i: CASE WHEN i % 17 = 0 THEN '@@' ELSE x END), lambda x, i: i % 23 <> 0) FROM w)"""


@query(f"""WITH {_EDITIONS_OF}, s AS (SELECT *, LAG(w) OVER (PARTITION BY doc_id ORDER BY version_num) AS o FROM versions)
SELECT doc_id, version_num, CASE version_num WHEN 1 THEN 0 WHEN 2 THEN len(w) - len(w) // 17 ELSE len(w) END AS n_equal, CASE version_num WHEN 1 THEN 0 WHEN 2 THEN len(w) // 17 ELSE len(o) - len(w) END AS n_deleted,
CASE version_num WHEN 1 THEN len(w) WHEN 2 THEN len(w) // 17 ELSE 0 END AS n_inserted, md5(COALESCE(array_to_string(o, ' '), '')) AS old_md5, md5(COALESCE(array_to_string(w, ' '), '')) AS new_md5 FROM s""")
def history_diffs(spark, sf_dir):
    """Of every text's three versions the diff against the version before it."""
    d = v.read(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"(?U)(\S+)"), F.lit(1)).alias("w"))
    second = F.transform("w", lambda x, i: F.when((i + 1) % 17 == 0, "@@").otherwise(x))
    third = F.filter(second, lambda x, i: (i + 1) % 23 != 0)
    text = F.explode(F.array(*[F.struct(F.lit(k + 1).alias("version_num"), F.array_join(x, " ").alias("content_text")) for k, x in enumerate((F.col("w"), second, third))])).alias("v")
    return _replayed(o.history_diffs(d.select("doc_id", text).select("doc_id", "v.*"), ["doc_id"], "version_num"), "doc_id", "version_num")


@query(f"""WITH {v.HARVEST_DOCS} SELECT d.doc_id, d.title, d.n AS node_count, d.version_label AS local_version, CASE WHEN k % 2 = 0 THEN upper(d.version_label) WHEN k % 3 = 0 THEN 'Amendment 99' END AS remote_version,
COALESCE(lower(d.version_label) <> lower(CASE WHEN k % 2 = 0 THEN upper(d.version_label) WHEN k % 3 = 0 THEN 'Amendment 99' END), FALSE) AS outdated
FROM (SELECT *, substring(doc_id, 4, 9)::INTEGER AS k FROM harvest_docs) d WHERE d.n > 0 AND d.is_latest""")
def version_check(spark, sf_dir):
    """Stored documents with nodes, against the version found remotely."""
    d = v.harvest_docs(spark, sf_dir).where("is_latest AND n > 0")
    k = F.substring("doc_id", 4, 9).cast("int")
    d = d.withColumn("remote_version", F.when(k % 2 == 0, F.upper("version_label")).when(k % 3 == 0, "Amendment 99"))
    return d.select("doc_id", "title", F.col("n").alias("node_count"), F.col("version_label").alias("local_version"), "remote_version", outdated(F.col("version_label"), F.col("remote_version")).alias("outdated"))


@query(f"""WITH {v.OLD_NEW}, o AS (SELECT * FROM old_nodes), j AS (SELECT COALESCE(o.reference_code, n.reference_code) AS reference_code,
  CASE WHEN o.reference_code IS NULL THEN 'added' WHEN n.reference_code IS NULL THEN 'deleted' WHEN o.content_hash = n.content_hash THEN 'unchanged' ELSE 'modified' END AS change_type,
  COALESCE(n.content_text, o.content_text) AS content_text, COALESCE(n.content_hash, o.content_hash) AS content_hash
  FROM o FULL JOIN new_nodes n ON n.reference_code = o.reference_code WHERE n.reference_code IS NOT NULL OR o.doc_key IN (SELECT doc_key FROM new_nodes))
SELECT reference_code, change_type, 'v2' AS version_label, content_hash, md5(content_text) AS text_md5 FROM j WHERE change_type <> 'unchanged'""")
def harvest_snapshots(spark, sf_dir):
    """K5: the snapshots that a harvest run appends: added, modified and deleted nodes with content."""
    return _run(spark, sf_dir)["versions"].select(F.split_part("k", F.lit("\u0001"), F.lit(2)).alias("reference_code"), "change_type", "version_label", "content_hash", F.md5("content_text").alias("text_md5"))


@query(f"""WITH {v.OLD_NEW}, j AS (SELECT o.reference_code AS a, n.reference_code AS b, o.content_hash = n.content_hash AS same FROM old_nodes o FULL JOIN new_nodes n ON n.reference_code = o.reference_code
  WHERE n.reference_code IS NOT NULL OR o.doc_key IN (SELECT doc_key FROM new_nodes))
SELECT COUNT(*) FILTER (a IS NULL) AS nodes_added, COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND NOT same) AS nodes_modified, COUNT(*) FILTER (a IS NOT NULL AND b IS NOT NULL AND same) AS nodes_unchanged,
  COUNT(*) FILTER (b IS NULL) AS nodes_deleted, COUNT(*) AS nodes_total FROM j""")
def harvest_run(spark, sf_dir):
    """K7: the counters of a harvest run."""
    return _run(spark, sf_dir)["run"]


def _run(spark, sf_dir):
    shape = lambda d: d.select(F.lit("IR").alias("node_type"), "reference_code", F.col("doc_key").alias("source_doc_id"), "content_text", "content_hash")
    old, new = v.old_and_new(spark, sf_dir)
    # the position of a row is the number in its code
    return harvest.ingest(shape(old), shape(new).withColumn("pos", F.split_part("reference_code", F.lit("."), F.lit(2)).cast("long")), "v2")
