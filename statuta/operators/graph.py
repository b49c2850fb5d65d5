"""Edges between nodes: building, resolving, neighbours, visibility."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.references import bare_code, base_bare


def neighbours(edges: DataFrame, nodes: DataFrame, node_ids: DataFrame | Column, direction: str = "out") -> DataFrame:
    """(node_id, relation, neighbour ...) for the edges that leave or enter the wanted nodes.

    node_ids: a condition on node_id, or a table with that column.
    """
    near, far = ("source_node_id", "target_node_id") if direction == "out" else ("target_node_id", "source_node_id")
    e = edges.select(F.col(near).alias("node_id"), F.col(far).alias("neighbour_id"), "relation")
    e = e.where(node_ids) if isinstance(node_ids, Column) else e.join(node_ids.select("node_id"), "node_id", "left_semi")
    n = nodes.select(F.col("node_id").alias("neighbour_id"), F.col("node_type").alias("neighbour_type"), F.col("reference_code").alias("neighbour_ref"))
    return e.join(n, "neighbour_id").select("node_id", "relation", "neighbour_id", "neighbour_type", "neighbour_ref")


# The order in which relations are shown.
RELATION_ORDER = ("IMPLEMENTS", "ACCEPTABLE_MEANS", "GUIDANCE_FOR", "REFERENCES", "REQUIRES", "EQUIVALENT_TO", "SUPERSEDES", "CONTAINS")


def relation_rank(relation: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(r) for r in RELATION_ORDER]), relation)
    return F.when(at > 0, at).otherwise(len(RELATION_ORDER) + 1).cast("int")


def type_rank(kind: Column) -> Column:
    """Base articles first, then AMC, then GM."""
    return F.when(kind.isin("IR", "CS"), 0).when(kind == "AMC", 1).when(kind == "GM", 2).otherwise(9)


def base_articles(nodes: DataFrame) -> DataFrame:
    """(ref, base_id) of the IR and CS nodes; the smallest id where a reference repeats."""
    return nodes.where(F.col("node_type").isin("IR", "CS")).groupBy(F.col("reference_code").alias("ref")).agg(F.min("node_id").alias("base_id"))


def base_article_edges(nodes: DataFrame) -> DataFrame:
    """AMC and GM nodes to the article that they explain: the bare code, its base without
    sub-paragraphs, then both after ``CS ``; the first that exists counts."""
    bare = bare_code(F.col("reference_code"))
    notes = nodes.where(F.col("node_type").isin("AMC", "GM")).select("node_id", "node_type", "reference_code", bare.alias("b")).where("b is not null")
    tries = F.array(F.col("b"), base_bare(F.col("b")), F.concat(F.lit("CS "), F.col("b")), F.concat(F.lit("CS "), base_bare(F.col("b"))))
    asked = notes.select("node_id", "node_type", "reference_code", F.posexplode(tries).alias("rank", "ref"))
    found = asked.join(base_articles(nodes), "ref").groupBy("node_id").agg(F.min_by(F.struct("node_type", "reference_code", "ref", "base_id"), "rank").alias("m"))
    relation = F.when(F.col("m.node_type") == "AMC", "ACCEPTABLE_MEANS").otherwise("GUIDANCE_FOR")
    return found.select(F.col("node_id").alias("source_node_id"), F.col("m.reference_code").alias("source_ref"), F.col("m.base_id").alias("target_node_id"), F.col("m.ref").alias("target_ref"), relation.alias("relation"))


def cross_references(texts: DataFrame, refs: DataFrame, pattern: str) -> DataFrame:
    """(source_ref, target_ref, mentions) for the codes in a text that name a base article,
    as they stand or else after ``CS ``; never the article itself.

    texts: (source_ref, content_text); refs: (ref). Codes are counted per text before the join.
    """
    found = texts.select("source_ref", F.explode(F.regexp_extract_all("content_text", F.lit(f"({pattern})"), F.lit(1))).alias("code")).groupBy("source_ref", "code").agg(F.count("*").alias("mentions"))
    tries = found.select("source_ref", "mentions", "code", F.posexplode(F.array(F.col("code"), F.concat(F.lit("CS "), F.col("code")))).alias("rank", "ref"))
    hit = tries.join(refs.select("ref").distinct(), "ref").where("ref <> source_ref").groupBy("source_ref", "code").agg(F.min_by("ref", "rank").alias("target_ref"), F.max("mentions").alias("mentions"))
    return hit.groupBy("source_ref", "target_ref").agg(F.sum("mentions").alias("mentions"))


def resolve(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends of (source_ref, target_ref, relation) to node ids, looking among IR, AMC,
    GM, CS in this order; unresolved edges and those to the node itself go."""
    rank = F.array_position(F.array(*[F.lit(t) for t in ("IR", "AMC", "GM", "CS")]), F.col("node_type"))
    best = nodes.where(rank > 0).groupBy("reference_code").agg(F.min_by("node_id", F.struct(rank, F.col("node_id"))).alias("id"))
    a = best.select(F.col("reference_code").alias("source_ref"), F.col("id").alias("source_node_id"))
    b = best.select(F.col("reference_code").alias("target_ref"), F.col("id").alias("target_node_id"))
    return edges.join(a, "source_ref").join(b, "target_ref").where("source_node_id <> target_node_id").select("source_node_id", "target_node_id", "relation")


def visible(nodes: DataFrame, edges: DataFrame, hidden_types: list[str], collapsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes not of a hidden type nor below a collapsed group, and the edges of which
    both ends are seen. collapsed: (group_id, node_id)."""
    seen = nodes.where(~F.col("node_type").isin(hidden_types)).join(collapsed.select("node_id").distinct(), "node_id", "left_anti")
    ids = seen.select("node_id")
    kept = edges.join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_semi").join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_semi")
    return seen, kept


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node has."""
    ids = nodes.select("node_id")
    no_source = edges.join(ids.withColumnRenamed("node_id", "source_node_id"), "source_node_id", "left_anti")
    no_target = edges.join(ids.withColumnRenamed("node_id", "target_node_id"), "target_node_id", "left_anti")
    return no_source.unionByName(no_target).distinct()


# Fixed value: a reference in running text.
MENTION = r"(?iU)\b((?:CS|AMC|GM|IR)\s+[\w.\-]+(?:\([^)]*\))*)\b"


def text_references(nodes: DataFrame, pattern: str = MENTION) -> DataFrame:
    """(source_ref, target_ref, relation): references that texts name, one row a pair, whether a
    node has them or not; a node's own goes."""
    named = nodes.select(F.col("reference_code").alias("source_ref"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("content_text", F.lit(pattern), F.lit(1)), lambda x: F.trim(x)))).alias("target_ref"))
    return named.where("target_ref <> source_ref").distinct().withColumn("relation", F.lit("REFERS_TO"))


def confident(relations: DataFrame, least: float = 0.7) -> DataFrame:
    """Relations without a confidence or with one of at least so much (an optional step)."""
    return relations.where(F.col("confidence").isNull() | (F.col("confidence") >= least))


def memberships(nodes: DataFrame, group: list[str]) -> DataFrame:
    """(group, node_id, reference_code, place, members): every node with its place in its group,
    in display order, and the group's size. As many rows as nodes: the siblings of one node are the
    other rows of its group (siblings_of)."""
    g = Window.partitionBy(*group)
    place = F.row_number().over(g.orderBy(type_rank(F.col("node_type")), "reference_code", "node_id"))
    return nodes.select(*group, "node_id", "reference_code", place.alias("place"), F.count("*").over(g).alias("members"))


def siblings_of(members: DataFrame, group: list[str], wanted: list[str]) -> DataFrame:
    """(node_id, sibling_id, sibling_ref, place) for some nodes that were asked for."""
    some = members.where(F.col("node_id").isin(wanted)).select(*group, F.col("node_id").alias("_of"))
    return members.join(F.broadcast(some), group).where("node_id <> _of").select(F.col("_of").alias("node_id"), F.col("node_id").alias("sibling_id"), F.col("reference_code").alias("sibling_ref"), "place")


def ranked_neighbours(hits: DataFrame) -> DataFrame:
    """neighbours() of nodes as rows in the order in which they are shown: relations in the fixed
    order, in each the neighbours by type and reference, with their number. A hub's neighbours
    stay rows."""
    one = Window.partitionBy("node_id", "relation")
    place = F.row_number().over(one.orderBy(type_rank(F.col("neighbour_type")), "neighbour_ref", "neighbour_id"))
    return hits.select("node_id", "relation", relation_rank(F.col("relation")).alias("relation_rank"), F.count("*").over(one).alias("neighbours"), place.alias("place"), "neighbour_ref", "neighbour_id")


#: Rows up to which what is asked for and the targets of linked() are broadcast; they are counted first. Targets
#: of one reference that a source meets at a time.
BROADCAST_ROWS, BLOCK = 500_000, 1000


def linked(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between all nodes of two references: (source_ref, target_ref, relation) asked for, by
    two equi-joins instead of a product with a filter. The result has as many rows as the product of two
    references' nodes. Where what is asked for and the targets are few they are broadcast: a source is
    shuffled once, whatever it is asked for, and dealt evenly, so that few references do not make few tasks. A task goes
    through the targets block by block, so that rows of the same targets lie together and their files are small."""
    ids = nodes.select("reference_code", "node_id")
    source = ids.select(F.col("reference_code").alias("source_ref"), F.col("node_id").alias("source_node_id"))
    target = ids.select(F.col("reference_code").alias("target_ref"), F.col("node_id").alias("target_node_id"))
    target = target.join(wanted.select("target_ref").distinct(), "target_ref", "left_semi")
    if any(df.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS for df in (wanted, target)):
        return wanted.join(source, "source_ref").join(target, "target_ref").select("source_node_id", "target_node_id", "relation")
    sizes = target.groupBy("target_ref").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    asked = wanted.join(F.broadcast(sizes), "target_ref").groupBy("source_ref", "target_ref", "blocks").agg(F.collect_list(F.struct("relation")).alias("relations"))
    targets = target.join(F.broadcast(sizes), "target_ref").select("target_ref", F.pmod(F.xxhash64("target_node_id"), "blocks").cast("int").alias("block"), "target_node_id")
    source = source.join(F.broadcast(wanted.select("source_ref").distinct()), "source_ref", "left_semi")
    dealt = source.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_node_id")
    begun = dealt.join(F.broadcast(asked), "source_ref").select("source_node_id", "target_ref", "relations", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    begun = begun.sortWithinPartitions("target_ref", "block").select("source_node_id", "target_ref", "block", F.inline("relations"))
    return begun.join(F.broadcast(targets), ["target_ref", "block"]).select("source_node_id", "target_node_id", "relation")
