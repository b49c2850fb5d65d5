"""Hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import cosine
from ..operators import fulltext as ft
from ..operators import retrieval as r
from ..operators.dedup import keep_unseen
from ..plans import ask as plan
from ..sources import views as v
from . import query
from .fulltext import POSTINGS, ranks


def _vector(spark, sf_dir, vec_id=0):
    return v.read(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, ROUND(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 20""")
def knn_cosine(spark, sf_dir):
    """The 20 nearest, exact."""
    return r.nearest(v.read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 20).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
SELECT vec_id, label, ROUND(1 - list_cosine_similarity(embedding::DOUBLE[], q), 6) AS distance FROM embeddings, q WHERE label = 3 ORDER BY 1 - list_cosine_similarity(embedding::DOUBLE[], q), vec_id LIMIT 10""")
def knn_filtered(spark, sf_dir):
    """A metadata filter below the top-n."""
    return r.nearest(v.read(spark, sf_dir, "embeddings"), _vector(spark, sf_dir), 10, F.col("label") == 3).select("vec_id", "label", F.round("distance", 6).alias("distance"))


@query(f"""WITH {v.NODES} SELECT node_id, reference_code, source_doc_id FROM nodes WHERE (reference_code IN ('CS 25.100', '26.101') OR regexp_matches(reference_code, '25\\.10[12]', 'i')) AND source_doc_id IN (SELECT source FROM documents WHERE lang = 'en')""".replace("\\\\", "\\"))
def code_lookup(spark, sf_dir):
    """Exact codes or a pattern, within documents that exist."""
    n = v.nodes(spark, sf_dir).where(F.col("reference_code").isin("CS 25.100", "26.101") | F.col("reference_code").rlike(r"(?i)25\.10[12]"))
    docs = v.read(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("source_doc_id")).distinct()
    return n.join(docs, "source_doc_id", "left_semi").select("node_id", "reference_code", "source_doc_id")


_QUESTIONS = """q AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'How is 25.' || (1300 + conv_id % 50) || ' met by CS-25 and Part 21?' WHEN 1 THEN 'what about the Part M and Part-CAT rules' WHEN 2 THEN 'Explain 21.A.91 and A.101 for CS ACNS' ELSE 'the and for' END AS question FROM conversations)"""


def _questions(spark, sf_dir):
    k = F.col("turn") % 4
    q = F.when(k == 0, F.concat(F.lit("How is 25."), 1300 + F.col("conv_id") % 50, F.lit(" met by CS-25 and Part 21?"))).when(k == 1, "what about the Part M and Part-CAT rules").when(k == 2, "Explain 21.A.91 and A.101 for CS ACNS").otherwise("the and for")
    return v.read(spark, sf_dir, "conversations").select("conv_id", "turn", q.alias("question"))


@query(f"""WITH {_QUESTIONS} SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '25.' || (1300 + conv_id % 50) WHEN 2 THEN 'A.91,A.101' ELSE '' END AS codes, CASE turn % 4 WHEN 0 THEN 'easa-cs25,easa-part21' WHEN 1 THEN 'easa-airworthiness,easa-ops' WHEN 2 THEN 'easa-csacns' ELSE '' END AS docs,
CASE turn % 4 WHEN 0 THEN 'is 25.' || (1300 + conv_id % 50) || ' met by ?' WHEN 1 THEN 'rules' WHEN 2 THEN '21.A.91 A.101 CS ACNS' ELSE 'the and for' END AS cleaned FROM q""")
def doc_mentions(spark, sf_dir):
    """Codes, documents and the cleaned text of every question."""
    q = F.col("question")
    return _questions(spark, sf_dir).select("conv_id", "turn", F.array_join(r.asked_codes(q), ",").alias("codes"), F.array_join(r.asked_documents(q), ",").alias("docs"), r.cleaned_question(q).alias("cleaned"))


@query("""WITH h AS (SELECT vec_id, 'p' || (vec_id % 40) AS parent_id, embedding[1]::DOUBLE AS distance, embedding[2]::DOUBLE AS d2, 'q' || label AS list FROM embeddings),
b AS (SELECT list, parent_id, MIN(distance) AS place FROM h GROUP BY 1, 2), k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY list ORDER BY place, parent_id) - 1 AS r FROM b)
SELECT parent_id, ROUND(SUM(1.0::DOUBLE / (60.0::DOUBLE + r)), 9) AS rrf_score, COUNT(*) AS n_lists FROM k GROUP BY parent_id""")
def rrf_fuse(spark, sf_dir):
    """Fusion of a ranked list per label."""
    h = v.read(spark, sf_dir, "embeddings").select(F.concat(F.lit("p"), F.col("vec_id") % 40).alias("parent_id"), F.col("embedding")[0].cast("double").alias("d"), F.concat(F.lit("q"), F.col("label")).alias("list"))
    return r.fuse(h.groupBy("list", "parent_id").agg(F.min("d").alias("place")))


@query("""SELECT parent_id, MIN(pos) AS pos, ARG_MIN(vec_id, (distance, pos)) AS vec_id, MIN(distance) AS distance FROM (SELECT vec_id, 'p' || (vec_id % 100) AS parent_id, vec_id AS pos, embedding[1]::DOUBLE AS distance FROM embeddings) GROUP BY parent_id""")
def best_per_parent(spark, sf_dir):
    """A16, A17."""
    h = v.read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("p"), F.col("vec_id") % 100).alias("parent_id"), F.col("vec_id").alias("pos"), F.col("embedding")[0].cast("double").alias("distance"))
    return r.best_per_parent(h).select("parent_id", "pos", "vec_id", "distance")


@query("""WITH RECURSIVE h AS (SELECT label, vec_id, vec_id % 11 AS parent, vec_id * 7 % 13 AS ref, ROW_NUMBER() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings),
k AS (SELECT label, 0::BIGINT AS place, []::BIGINT[] AS ids, []::BIGINT[] AS refs, FALSE AS kept, NULL::BIGINT AS vec_id FROM (SELECT DISTINCT label FROM h)
  UNION ALL SELECT label, place, CASE WHEN new THEN list_append(ids, parent) ELSE ids END, CASE WHEN new THEN list_append(refs, ref) ELSE refs END, new, vec_id FROM (
    SELECT h.label, h.place, h.parent, h.ref, k.ids, k.refs, h.vec_id, NOT list_contains(k.ids, h.parent) AND NOT list_contains(k.refs, h.ref) AS new FROM k JOIN h ON h.label = k.label AND h.place = k.place + 1 WHERE h.place <= 20))
SELECT k.label, k.vec_id, k.vec_id % 11 AS parent, k.vec_id * 7 % 13 AS ref FROM k WHERE kept""")
def source_dedup(spark, sf_dir):
    """Per label the pool of the first 20 hits (the method's), without those whose parent
    or base reference was kept."""
    h = v.read(spark, sf_dir, "embeddings").select("label", "vec_id", F.struct("vec_id", (F.col("vec_id") % 11).alias("parent"), (F.col("vec_id") * 7 % 13).alias("ref")).alias("h"))
    h = h.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("place <= 20")
    g = h.groupBy("label").agg(F.sort_array(F.collect_list("h")).alias("hits"))
    return g.select("label", F.explode(keep_unseen(F.col("hits"), lambda x: x["parent"], lambda x: x["ref"])).alias("k")).select("label", "k.vec_id", "k.parent", "k.ref")


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'See cs 25.' || (conv_id % 9) || ' and AMC 25.' || (turn % 5) || '.' ELSE text END AS answer FROM conversations),
h AS (SELECT conv_id, k, CASE k % 3 WHEN 0 THEN 'CS 25.' || k WHEN 1 THEN 'AMC 25.' || k ELSE 'CS 25.' || k || '(a)' END AS reference_code FROM (SELECT DISTINCT conv_id FROM conversations), (SELECT UNNEST(range(0, 12)) AS k))
SELECT DISTINCT a.conv_id || ':' || a.turn AS answer_id, h.reference_code FROM a JOIN h ON a.conv_id = h.conv_id WHERE NOT regexp_matches(h.reference_code, '\\([a-z0-9]+\\)\\s*$', 'i') AND contains(lower(a.answer), lower(h.reference_code))""".replace("\\\\", "\\"))
def citations(spark, sf_dir):
    """J22, F26."""
    c = v.read(spark, sf_dir, "conversations")
    answer = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("See cs 25."), F.col("conv_id") % 9, F.lit(" and AMC 25."), F.col("turn") % 5, F.lit("."))).otherwise(F.col("text"))
    a = c.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("answer_id"), answer.alias("answer"))
    k = F.explode(F.sequence(F.lit(0), F.lit(11)))
    h = a.select("answer_id", k.alias("k"))
    n = F.col("k").cast("string")
    h = h.select("answer_id", F.when(F.col("k") % 3 == 0, F.concat(F.lit("CS 25."), n)).when(F.col("k") % 3 == 1, F.concat(F.lit("AMC 25."), n)).otherwise(F.concat(F.lit("CS 25."), n, F.lit("(a)"))).alias("reference_code"))
    return r.cited(a, h)


@query(f"""WITH {v.NODES},{POSTINGS.replace("@nodes", "nodes")},{ranks([([[("ther", 0)], [("erth", 0)]], [])])},
pool AS (SELECT r.node_id, n.content_text, ROW_NUMBER() OVER (ORDER BY rank DESC, r.node_id) AS nth FROM ranked r JOIN nodes n ON n.node_id = r.node_id QUALIFY nth <= 12),
s AS (SELECT node_id, nth, FLOOR(((contains(lower(content_text), 'ther')::INTEGER) + (contains(lower(content_text), 'erth')::INTEGER) + (contains(lower(content_text), 'inging')::INTEGER)) * 10 / 3.0)::INTEGER AS score FROM pool),
k AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, nth) AS place FROM s) SELECT node_id, score, place::INTEGER AS place FROM k WHERE place = 1 OR (score >= 6 AND place <= 4)""")
def rerank_topk(spark, sf_dir):
    """The twelve best full-text hits, reranked by the lexical stand-in."""
    nodes, question = v.nodes(spark, sf_dir), "the thers of erthing"
    hits = ft.search(ft.postings(nodes, only=ft.asked_terms(question)), question).orderBy(F.col("rank").desc(), "node_id").limit(12)
    pool = hits.withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("rank").desc(), "node_id")))
    pool = nodes.select("node_id", "content_text").join(F.broadcast(pool), "node_id").select("node_id", "content_text", "pos")
    return r.rerank(pool, r.lexical_score(F.col("content_text"), ["ther", "erth", "inging"])).select("node_id", "score", "place")


@query("""SELECT a.vec_id, b.vec_id AS other_id, ROUND(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id = a.vec_id + 10""")
def vector_similarity(spark, sf_dir):
    """similarity of paired vectors."""
    e = v.read(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 10).alias("vec_id"), "label", F.col("vec_id").alias("other_id"), F.col("embedding").alias("other"))
    return e.join(b, ["vec_id", "label"]).select("vec_id", "other_id", F.round(cosine(F.col("embedding"), F.col("other")), 6).alias("similarity"))


_ASKED = "25.101 or CS 26.102 or therer erth in Part 21"
_INSIDE = {"easa-part21": [f"src{k}" for k in range(12)]}


@query(f"""WITH {v.NODES}, inside AS (SELECT * FROM nodes WHERE substring(source_doc_id, 4)::INTEGER < 12),
coded AS (SELECT node_id FROM inside WHERE reference_code IN ('25.101', '26.102') OR regexp_matches(reference_code, '25\\.101|26\\.102', 'i') ORDER BY reference_code, node_id LIMIT 6),
{POSTINGS.replace("@nodes", "inside")},{ranks([([[("25", 0), ("101", 1)]], []), ([[("102", 0)]], []), ([[("therer", 0)], [("erth", 0)]], [])])},
texts AS (SELECT node_id FROM ranked WHERE rank IS NOT NULL AND node_id NOT IN (FROM coded) ORDER BY rank DESC, node_id LIMIT 8),
q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
near AS (SELECT 'n' || (vec_id // 2) AS node_id, MIN(1 - list_cosine_similarity(embedding::DOUBLE[], q)) AS distance FROM embeddings, q WHERE vec_id // 2 % 20 < 12
  AND 'n' || (vec_id // 2) NOT IN (FROM coded) AND 'n' || (vec_id // 2) NOT IN (FROM texts) GROUP BY 1 ORDER BY 2, 1 LIMIT 20),
every AS (SELECT node_id, 0.0::DOUBLE AS distance, 0 AS stage FROM coded UNION ALL SELECT node_id, 0.05::DOUBLE, 1 FROM texts UNION ALL SELECT node_id, distance, 2 FROM near),
fused AS (SELECT e.*, n.reference_code, n.node_type, n.hierarchy_path, n.content_text, CASE WHEN stage = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / (60.0::DOUBLE + ROW_NUMBER() OVER (PARTITION BY stage ORDER BY distance, e.node_id) - 1) END AS rrf FROM every e JOIN nodes n ON n.node_id = e.node_id),
pool AS (SELECT *, FLOOR(list_sum([contains(lower(reference_code || ' ' || content_text), t)::INTEGER FOR t IN ['25', '101', '102', 'therer', 'erth']]) * 10 / 5.0)::INTEGER AS score FROM fused QUALIFY ROW_NUMBER() OVER (ORDER BY rrf DESC, stage, node_id) <= 12),
placed AS (SELECT *, ROW_NUMBER() OVER (ORDER BY score DESC, rrf DESC, stage, node_id) AS place FROM pool),
kept AS (SELECT *, trim(regexp_replace(reference_code, '\\s*\\([^)]*\\)\\s*$', '')) AS ref FROM placed WHERE place = 1 OR (score >= 6 AND place <= 6)),
sources AS (SELECT * FROM kept WHERE place <= 6 QUALIFY ROW_NUMBER() OVER (PARTITION BY ref ORDER BY place) = 1),
a AS (SELECT string_agg('[' || ref || '] ' || substring(content_text, 1, 200), chr(10) || chr(10) ORDER BY place) AS answer FROM (SELECT * FROM sources ORDER BY place LIMIT 2))
SELECT place::INTEGER AS place, node_id, ref AS reference_code, node_type, hierarchy_path, ROUND(1 - distance, 3) AS score, contains(lower(answer), lower(ref)) AS cited, answer FROM sources, a""".replace("\\\\", "\\"))
def ask_hybrid(spark, sf_dir):
    """The flagship: codes, full text and vectors within the named document, fused, reranked and
    deduplicated. Two vectors a node; a vector's source is its number's."""
    e = v.read(spark, sf_dir, "embeddings")
    parent = F.expr("vec_id div 2")
    vectors = e.select(F.concat(F.lit("n"), parent).alias("node_id"), "vec_id", F.concat(F.lit("src"), parent % 20).alias("source_doc_id"), "embedding")
    # postings of the asked terms are made where the texts are; only they meet the nodes that are stored
    rows = v.node_rows(spark, sf_dir).where(F.col("source_doc_id").isin([s for k in _INSIDE.values() for s in k]))
    index = ft.postings(rows, only=ft.asked_terms(plan.cleaned(_ASKED)))
    return plan.ask(v.nodes(spark, sf_dir), vectors, _ASKED, _vector(spark, sf_dir), _INSIDE, index=index)
