"""Graphs as edge tables: nodes with stubs, degrees, PageRank, k-hop neighbourhoods, co-location classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estateloom.functions.skew import salted_join
from estateloom.session import checkpointed


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways, without loops and parallel edges."""
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return once.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))


def with_stubs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, stub): the nodes, and ends of edges that are no node as stubs."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    own = nodes.select("node").distinct()
    return own.withColumn("stub", F.lit(False)).unionByName(ends.join(own, "node", "left_anti").withColumn("stub", F.lit(True)))


def _split_links(edges: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(links, degrees) of the simple undirected graph: links are (src, part, dst), the links of a node in parts of about
    ``block``; degrees are (node, degree, n_parts). A hub is spread over its parts, other nodes have one."""
    both = undirected(edges)
    degrees = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree")).withColumn("n_parts", F.ceil(F.col("degree") / block).cast("int"))
    sized = salted_join(both, degrees.select(F.col("node").alias("src"), "n_parts"), ["src"], ["dst"], "inner")
    return sized.select("src", F.pmod(F.xxhash64("dst"), F.col("n_parts")).cast("int").alias("part"), "dst"), degrees


def _over_parts(nodes: DataFrame, *columns: str) -> DataFrame:
    """Rows (src, part, columns) that meet every part of a node's links; ``nodes`` has node and n_parts."""
    return nodes.select(F.col("node").alias("src"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"), *columns)


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, tolerance: float = 1e-10, block: int = 100_000) -> DataFrame:
    """(node, rank) of the undirected simple graph, ranks summing to 1; ``nodes`` (node) may name nodes without an edge.

    The ranks solve (I - damping M) rank = base, whose matrix is self-adjoint when products are weighted by 1 / degree, so
    conjugate gradients find them in far fewer joins than power iteration; they end when the ranks are within ``tolerance``
    (sum of absolute errors) of the solution. Mass of nodes without an edge is spread evenly, which gives base in closed form.
    A graph without edges has rank 0 everywhere.

    Links are kept partitioned by (node, part of a hub), so each step shuffles one row per node and part and map-side-combined
    sums; the state, one row per node, is checkpointed at each step, and only five sums come to the driver.
    """
    links, degrees = _split_links(edges, block)
    degrees = checkpointed(degrees)
    alone = None if nodes is None else nodes.select("node").where("node is not null").distinct().join(degrees, "node", "left_anti")
    linked, isolated = degrees.count(), 0 if alone is None else alone.count()
    if linked == 0:
        return (degrees.select("node") if alone is None else alone).withColumn("rank", F.lit(0.0))
    base = (1 - damping) / (linked + isolated - damping * isolated)
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = links.repartition(width, "src", "part").sortWithinPartitions("src", "part").persist()

    def spread_by(state: DataFrame, column: str) -> DataFrame:
        """``state`` with ``m``: what each node gets if all divide ``column`` among their neighbours."""
        sent = links.join(_over_parts(state.withColumn("given", F.col(column) / F.col("degree")), "given"), ["src", "part"])
        return state.join(sent.groupBy(F.col("dst").alias("node")).agg(F.sum("given").alias("m")), "node")

    start = spread_by(degrees.withColumn("x", F.lit(base)), "x").withColumn("r", base - F.col("x") + damping * F.col("m")).drop("m")
    state = start.withColumn("p", F.col("r"))
    while True:
        state = checkpointed(spread_by(state, "p").withColumn("q", F.col("p") - damping * F.col("m")).drop("m"))
        dot = lambda a, b: F.sum(F.col(a) * F.col(b) / F.col("degree"))
        rr, pq, rq, qq, left = state.agg(dot("r", "r"), dot("p", "q"), dot("r", "q"), dot("q", "q"), F.sum(F.abs("r"))).first()
        if left <= tolerance * (1 - damping) or pq <= 0:
            break
        alpha = rr / pq
        beta = max(rr - 2 * alpha * rq + alpha * alpha * qq, 0.0) / rr
        state = state.select("node", "degree", "n_parts", (F.col("x") + alpha * F.col("p")).alias("x"), (F.col("r") - alpha * F.col("q")).alias("r"), "p").withColumn("p", F.col("r") + beta * F.col("p"))
    links.unpersist()
    ranks = state.select("node", F.col("x").alias("rank"))
    return ranks if alone is None else ranks.unionByName(alone.withColumn("rank", F.lit(base)))


def neighbourhoods(edges: DataFrame, centres: DataFrame, depth: int = 2, block: int = 100_000) -> DataFrame:
    """(centre, depth, n_nodes): how many nodes lie at each distance from each centre, breadth first; visited nodes are not entered again.

    Hubs are met part by part, and each frontier is checkpointed, so it is reached once however deep the search goes.
    """
    links, degrees = _split_links(edges, block)
    links, degrees = checkpointed(links), checkpointed(degrees.select("node", "n_parts"))
    visited = frontier = centres.select(F.col("node").alias("centre"), "node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        at = _over_parts(salted_join(frontier.select("centre", "node"), degrees, ["node"], ["centre"], "inner"), "centre")
        reached = at.join(links, ["src", "part"]).select("centre", F.col("dst").alias("node")).distinct()
        frontier = checkpointed(reached.join(visited.select("centre", "node"), ["centre", "node"], "left_anti").withColumn("depth", F.lit(d)))
        visited = visited.unionByName(frontier)
    return visited.where("depth > 0").groupBy("centre", "depth").agg(F.count("*").alias("n_nodes"))


def colocation(members: DataFrame) -> DataFrame:
    """(place, member, n_links): members of a place with the number of others there, the class instead of its pairs."""
    distinct = members.select("place", "member").distinct()
    sizes = distinct.groupBy("place").agg((F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return salted_join(distinct, sizes, ["place"], ["member"], "inner")
