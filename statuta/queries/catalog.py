"""The catalogue, documents and the tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.references import article_code, doc_label
from ..operators import catalog as c
from ..operators import tree as t
from ..operators.graph import type_rank
from ..sources import views as v
from . import query

# A small catalogue with title patterns and reference patterns.
ENTRIES = [
    ("rules-1", "Initial", "%src1%", r"^CS 2[5-7]\.", "airworthiness"),
    ("rules-2", "Continuing", "easy rules src2", None, "airworthiness"),
    ("rules-3", "Operations", "%SRC3", r"^(AMC|GM) ", "operations"),
    ("rules-4", "Aerodromes", "%src4%", r"\.1\d\d$", "aerodromes"),
    ("rules-5", "None", "%nowhere%", None, "operations"),
]
_ENTRIES = "entries(id, name, title_pat, ref_pat, domain) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in e) + ")" for e in ENTRIES) + ")"


def entries(spark):
    return spark.createDataFrame(ENTRIES, "id string, name string, title_pat string, ref_pat string, domain string")


def _keyed(spark, sf_dir):
    n = v.nodes(spark, sf_dir, text=False)
    return n.select(F.col("source_doc_id").alias("doc_id"), "reference_code", F.concat_ws(" / ", F.get(F.split("hierarchy_path", " / "), F.lit(0)), F.get(F.split("hierarchy_path", " / "), F.lit(1))).alias("root"))


_KEYED = "keyed AS (SELECT source_doc_id AS doc_id, reference_code, split_part(hierarchy_path, ' / ', 1) || ' / ' || split_part(hierarchy_path, ' / ', 2) AS root FROM nodes)"


@query(f"""WITH {v.NODES}, {v.HARVEST_DOCS}, {_ENTRIES}, {_KEYED},
per AS (SELECT e.id, k.root, COUNT(*) AS n FROM entries e JOIN harvest_docs d ON d.title ILIKE e.title_pat JOIN keyed k ON k.doc_id = d.doc_id AND (e.ref_pat IS NULL OR regexp_matches(k.reference_code, e.ref_pat)) GROUP BY 1, 2)
SELECT e.id, COALESCE(SUM(p.n), 0)::BIGINT AS node_count, ARG_MIN(p.root, (-p.n, p.root)) AS root FROM entries e LEFT JOIN per p ON p.id = e.id GROUP BY e.id""")
def catalog_pattern_counts(spark, sf_dir):
    """J9, A6, P8."""
    e = entries(spark).select("id", "title_pat", "ref_pat")
    return c.entry_counts(e, v.harvest_docs(spark, sf_dir).select("doc_id", "title"), _keyed(spark, sf_dir))


@query(f"""WITH {v.NODES}, {_KEYED}, per AS (SELECT doc_id, root, COUNT(*) AS n FROM keyed GROUP BY 1, 2) SELECT doc_id, SUM(n)::BIGINT AS node_count, ARG_MIN(root, (-n, root)) AS root FROM per GROUP BY doc_id""")
def catalog_mode_root(spark, sf_dir):
    """A5."""
    return c.mode_root(_keyed(spark, sf_dir))


@query(f"""WITH {v.HARVEST_DOCS}, {_ENTRIES} SELECT e.id, ARG_MIN(d.doc_id, (-d.n, d.doc_id)) AS doc_id, MAX(d.n) AS node_count FROM entries e JOIN harvest_docs d ON d.title ILIKE e.title_pat GROUP BY e.id""")
def catalog_best_doc(spark, sf_dir):
    """J10, O15."""
    return c.best_documents(entries(spark).select("id", "title_pat"), v.harvest_docs(spark, sf_dir))


@query(f"""WITH {v.HARVEST_DOCS}, {_ENTRIES}, k AS (SELECT *, 'src' || substring(id, 7) AS harvest_key FROM entries)
SELECT k.id, k.name, k.domain, d.version_label, d.is_latest, d.doc_id IS NOT NULL AS harvested FROM k LEFT JOIN harvest_docs d ON d.doc_id = k.harvest_key""")
def catalog_source_status(spark, sf_dir):
    """J11."""
    d = v.harvest_docs(spark, sf_dir).select(F.col("doc_id").alias("harvest_key"), "version_label", "is_latest", F.lit(True).alias("h"))
    e = entries(spark).withColumn("harvest_key", F.concat(F.lit("src"), F.substring("id", 7, 9)))
    return e.join(d, "harvest_key", "left").select("id", "name", "domain", "version_label", "is_latest", F.coalesce("h", F.lit(False)).alias("harvested"))


@query(f"""WITH {v.NODES} SELECT split_part(hierarchy_path, ' / ', 1) AS root, COUNT(*) AS nodes FROM nodes WHERE node_type <> 'GROUP' GROUP BY 1""")
def documents_summary(spark, sf_dir):
    """A21, A3."""
    root = F.split_part("hierarchy_path", F.lit(" / "), F.lit(1))
    return v.nodes(spark, sf_dir, text=False).where("node_type <> 'GROUP'").groupBy(doc_label(root).alias("root")).agg(F.count("*").alias("nodes"))


@query(f"""WITH {v.NODES}, k AS (SELECT *, split_part(hierarchy_path, ' / ', 1) AS root, upper(split_part(hierarchy_path, ' / ', 2)) AS subpart_key, split_part(hierarchy_path, ' / ', 3) AS section FROM nodes)
SELECT root, subpart_key, upper(section) AS section_key, COUNT(*) AS nodes, COUNT(DISTINCT bare_code) AS articles, MIN(replace(bare_code, '.', '')::BIGINT) AS min_article, MIN(section) AS section_label FROM k GROUP BY 1, 2, 3""")
def tree_counts(spark, sf_dir):
    """A22, A27."""
    return t.tree_counts(v.nodes(spark, sf_dir, text=False))


@query(f"""WITH {v.NODES}, r AS (SELECT *, string_split(hierarchy_path, ' / ') AS p FROM nodes)
SELECT p[1] AS root, upper(p[2]) AS subpart_key, upper(p[3]) AS section_key, bare_code AS article, FALSE AS last, split_part(bare_code, '.', 2)::BIGINT AS number,
  string_agg(node_id, ',' ORDER BY CASE node_type WHEN 'AMC' THEN 1 WHEN 'GM' THEN 2 ELSE 0 END, reference_code, node_id) AS nodes FROM r GROUP BY ALL""")
def tree_nested(spark, sf_dir):
    """The whole tree, an article a row with its nodes in order."""
    r = t.nested_tree(v.nodes(spark, sf_dir, text=False))
    return r.withColumn("nodes", F.array_join(F.transform("nodes", lambda n: n["node_id"]), ","))


@query(f"""WITH {v.NODES} SELECT source_doc_id, string_agg(DISTINCT node_type, ',' ORDER BY node_type) AS types, COUNT(DISTINCT reference_code) AS refs FROM nodes GROUP BY 1""")
def type_presence(spark, sf_dir):
    """A25."""
    return v.nodes(spark, sf_dir, text=False).groupBy("source_doc_id").agg(F.array_join(F.sort_array(F.collect_set("node_type")), ",").alias("types"), F.count_distinct("reference_code").alias("refs"))


@query(f"""WITH {v.NODES} SELECT node_id, split_part(bare_code, '.', 2)::BIGINT AS article_number, ROW_NUMBER() OVER (PARTITION BY source_doc_id ORDER BY split_part(bare_code, '.', 2)::BIGINT, bare_code,
CASE node_type WHEN 'IR' THEN 0 WHEN 'CS' THEN 0 WHEN 'AMC' THEN 1 ELSE 2 END, reference_code, node_id) AS place FROM nodes""")
def natural_sort(spark, sf_dir):
    """The display order of a document's nodes as a rank."""
    n = v.nodes(spark, sf_dir, text=False).withColumn("article", article_code(F.col("reference_code")))
    number = F.regexp_replace(F.element_at(F.split("article", r"\."), -1), "[^0-9]", "").cast("long")
    w = Window.partitionBy("source_doc_id").orderBy("article_number", "article", type_rank(F.col("node_type")), "reference_code", "node_id")
    return n.withColumn("article_number", number).select("node_id", "article_number", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH p AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '10 CRITERIA' WHEN 1 THEN '2 SCOPE' WHEN 2 THEN 'GENERAL' WHEN 3 THEN 'Other' ELSE p_brand END AS name FROM part),
r AS (SELECT DISTINCT name, CASE WHEN upper(name) = 'OTHER' THEN 2 WHEN name LIKE 'GENERAL%' THEN 1 ELSE 0 END AS trail, TRY_CAST(regexp_extract(name, '^(\\d+)[\\s.]', 1) AS INTEGER) AS num FROM p)
SELECT name, ROW_NUMBER() OVER (ORDER BY trail, num IS NULL, COALESCE(num, 0), name) AS place FROM r""".replace("\\\\", "\\"))
def subpart_order(spark, sf_dir):
    """The order of distinct subpart names, a table of names only."""
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, "10 CRITERIA").when(k == 1, "2 SCOPE").when(k == 2, "GENERAL").when(k == 3, "Other").otherwise(F.col("p_brand"))
    names = v.read(spark, sf_dir, "part").select(name.alias("name")).distinct()
    return names.select("name", F.row_number().over(Window.orderBy(t.subpart_rank(F.col("name")))).cast("long").alias("place"))


@query(f"""WITH {v.NODES} SELECT node_type, source_doc_id, COUNT(*) AS n FROM nodes WHERE node_type NOT IN ('GM') AND source_doc_id NOT IN ('src0', 'src9') AND contains(lower(reference_code || ' ' || title), 'th') GROUP BY ALL""")
def facet_filter(spark, sf_dir):
    """Exclusion facets and a text box."""
    n = v.nodes(spark, sf_dir).where(~F.col("node_type").isin("GM") & ~F.col("source_doc_id").isin("src0", "src9"))
    return n.where(F.contains(F.lower(F.concat_ws(" ", "reference_code", "title")), F.lit("th"))).groupBy("node_type", "source_doc_id").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT 'p' || p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '%' || upper(substring(p_name, 3, 7)) || '%' WHEN p_partkey % 3 = 1 THEN substring(p_name, 1, 4) || '_%' || right(p_name, 3) ELSE '%' || substring(p_type, 1, 3) || '%' END AS title_pat FROM part WHERE p_partkey % 20 = 0)
SELECT e.id, COUNT(*) AS n, MIN(p.p_partkey) AS first_key FROM e JOIN part p ON p.p_name ILIKE e.title_pat GROUP BY e.id""")
def title_patterns(spark, sf_dir):
    """Every name against the patterns made of every twentieth part, by their rarest runs; equal
    names and equal patterns meet once."""
    p, k = v.read(spark, sf_dir, "part"), F.col("p_partkey")
    kind = F.when(k % 3 == 0, F.concat(F.lit("%"), F.upper(F.substring("p_name", 3, 7)), F.lit("%"))).when(k % 3 == 1, F.concat(F.substring("p_name", 1, 4), F.lit("_%"), F.right("p_name", F.lit(3)))).otherwise(F.concat(F.lit("%"), F.substring("p_type", 1, 3), F.lit("%")))
    e = p.where(k % 20 == 0).select(F.concat(F.lit("p"), "p_partkey").alias("id"), kind.alias("title_pat"))
    count = lambda: [F.count("*").alias("n"), F.min("p_partkey").alias("first_key")]
    total = lambda: [F.sum("n").alias("n"), F.min("first_key").alias("first_key")]
    return c.pattern_groups(e, p.select("p_partkey", F.col("p_name").alias("title")), count, total)
