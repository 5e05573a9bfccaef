"""Approximate nearest neighbours by NN-descent, and queries by greedy search of the graph.

Equal vectors are one node, so copies neither crowd a node's neighbours nor a task. The graph starts from the nearest
among blocks of vectors that lie together in a few random orders. Then rounds of joins introduce the neighbours of each
node (and some of those it is a neighbour of) to each other, in the node's own group of a bounded number of vectors, pairs
that were introduced before left out; a node keeps its nearest, until hardly an edge changes. Only groups with a new edge
are formed, so rounds get cheaper. A query walks the graph from its own node and a few shared entries: it opens its
nearest unopened candidates, joins their neighbours and keeps the best, until nothing unopened is left among them.

What is bounded, whatever the table: DEGREE neighbours and REVERSE sampled reverse ones of a node in a round, BEST
introductions of a member in a group, the LINKS nearest of those that keep a node as a neighbour in the search (its own
neighbours are all searched), BEAM candidates of a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DEGREE = 32  # neighbours kept a node
REVERSE = 40  # nodes it is a neighbour of that are introduced, a round
ORDERS = 4  # random orders the graph starts from
BLOCK = 96  # vectors of a block in them
BEST = 16  # others that a node is introduced to in one group
CHANGED = 0.001  # share of the edges; the rounds end when fewer are new
BEAM = 100  # candidates a query keeps
OPEN = 50  # opened at once
ENTRIES = 16  # nodes all queries start from, besides their own
LINKS = 2 * DEGREE
SALTS = 64  # parts that a hub's reverse edges are ranked in first


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean, of all rows of x to all of y, in double precision; for choosing, not for reporting."""
    sq = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T
    return np.sqrt(np.maximum(sq, 0))


def _matrix(arr) -> np.ndarray:
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    n = len(arr)
    return np.asarray(arr.flatten(), dtype=np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    """(node, near, dist) of the k nearest of each row among the others."""
    d = distances(x, x)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    if k < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    row = np.repeat(np.arange(len(ids)), k)
    return ids[row], ids[at.ravel()], d[row, at.ravel()]


def _edges(node, near, dist) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(near, pa.int64()), pa.array(dist, pa.float64())], names=["node", "near", "dist"])


def _blocks(batches):
    """Vectors in order -> nearest within each BLOCK consecutive ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        while n >= 2 * BLOCK:
            t = pa.Table.from_batches(held).combine_chunks()
            yield _edges(*_nearest(np.asarray(t.column("node")[:BLOCK]), _matrix(t.column("v")[:BLOCK]), DEGREE))
            held, n = t.slice(BLOCK).to_batches(), n - BLOCK
    if n:
        t = pa.Table.from_batches(held)
        yield _edges(*_nearest(np.asarray(t.column("node")), _matrix(t.column("v")), DEGREE))


def _introduce(batches):
    """Rows (node, near, v, worst, new) sorted by node -> for each of those around a node the BEST nearest others there, of
    pairs with a new one, if they better the worst distance it keeps."""
    def give(node, near, v, worst, new):
        start = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        rows, cols, dist = [], [], []
        for s, e in zip(start, np.r_[start[1:], len(node)], strict=True):
            k = min(BEST, e - s - 1)
            fresh = new[s:e]
            if k < 1 or not fresh.any():
                continue
            d = distances(v[s:e], v[s:e])
            np.fill_diagonal(d, np.inf)
            d[~(fresh[:, None] | fresh[None, :])] = np.inf
            at = np.argpartition(d, k - 1, axis=1)[:, :k]
            i = np.repeat(np.arange(e - s), k)
            j = at.ravel()
            better = d[i, j] < worst[s:e][i]
            rows.append(near[s:e][i[better]])
            cols.append(near[s:e][j[better]])
            dist.append(d[i, j][better])
        one = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        rows, cols, dist = one(rows, np.int64), one(cols, np.int64), one(dist, np.float64)
        # The same pair often meets in neighbouring groups; once is enough.
        order = np.lexsort((cols, rows))
        once = order[np.r_[True, (np.diff(rows[order]) != 0) | (np.diff(cols[order]) != 0)]] if len(rows) else order
        return _edges(rows[once], cols[once], dist[once])

    held, n = [], 0
    for batch in batches:
        held.append([np.asarray(batch.column("node")), np.asarray(batch.column("near")), _matrix(batch.column("v")), np.asarray(batch.column("worst")), np.asarray(batch.column("new")) > 0])
        n += batch.num_rows
        if n >= 16384:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield give(*[c[:cut] for c in cols])
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if n:
        yield give(*[np.concatenate(c) for c in zip(*held, strict=True)])


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; a node has a bounded number of edges each round, whatever the table."""
    w = Window.partitionBy("node").orderBy("dist", "near")
    edges = edges.repartition(common.partitions(edges.sparkSession), "node")  # serves the grouping and the window
    return edges.groupBy("node", "near").agg(F.min("dist").alias("dist"), F.min("new").alias("new")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _back(graph: DataFrame, order: list, k: int) -> DataFrame:
    """Reverse edges, the k first of each node; a hub's are ranked in SALTS parts before the rest of them meet."""
    back = graph.select(F.col("near").alias("node"), F.col("node").alias("near"), "dist", "new").withColumn("salt", F.pmod(F.xxhash64("near"), F.lit(SALTS)))
    for by in (["node", "salt"], ["node"]):
        back = back.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("r") <= k)
    return back.select("node", "near", "new")


def usable(vectors: DataFrame, id_col: str, vec: str) -> DataFrame:
    """(id, v): rows whose vector is not null, empty or zero and has only finite components."""
    v = F.col(vec).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(fine & F.exists("v", lambda x: x != 0))


def build(rows: DataFrame, top: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rows: (id, v) of one dimension -> nodes (node, v), members (node, id, the `top` smallest ids of each), and the
    graph (node, near, dist)."""
    spark = rows.sparkSession
    parts = common.partitions(spark)
    whole = common.save(rows)
    nodes = common.save(whole.groupBy("v").agg(F.min("id").alias("node")).select("node", "v"))
    # Ids beyond the `top` smallest of equal vectors can't be among `top` results: ties go to the smaller id.
    by_node = whole.join(nodes, "v").select("node", "id")
    members = common.save(common.ranked(by_node, ["node"], ["id"], "r").filter(F.col("r") < top).select("node", "id"))
    width = nodes.select(F.size("v").alias("d")).limit(1).collect()  # all have the same
    dim = width[0]["d"] if width else 1
    rng = np.random.default_rng(5)
    starts = []
    for _ in range(ORDERS):
        planes = rng.normal(size=(7, dim))
        dot = lambda p: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in p]), lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
        code = sum((F.when(dot(p) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes[:6])), F.lit(0))
        placed = nodes.withColumn("c", code).withColumn("t", dot(planes[6]))
        starts.append(placed.repartitionByRange(parts, "c", "t", "node").sortWithinPartitions("c", "t", "node").select("node", "v")
                      .mapInArrow(_blocks, "node long, near long, dist double"))
    graph = starts[0]
    for s in starts[1:]:
        graph = graph.union(s)
    graph = common.save(_keep(graph.withColumn("new", F.lit(1)), DEGREE))
    small = common.save(nodes.select(F.col("node").alias("near"), F.col("v").cast("array<float>").alias("v")))
    turn = 0
    while True:
        worst = graph.groupBy("node").agg(F.max("dist").alias("worst"), F.count(F.lit(1)).alias("k")).select(
            F.col("node").alias("near"), F.when(F.col("k") < DEGREE, float("inf")).otherwise(F.col("worst")).alias("worst"))
        facts = small.join(worst, "near", "left").select("near", "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
        # A node that very many keep as a neighbour is introduced to a sample of them, new ones first: the method's own
        # sampling.
        back = _back(graph, [F.desc("new"), F.xxhash64("near", "node")], REVERSE)
        around = graph.select("node", "near", "new").union(back).union(nodes.select("node", F.col("node").alias("near"), F.lit(0).alias("new")))
        around = around.groupBy("node", "near").agg(F.max("new").alias("new"))
        if turn:  # in the first round every group has new edges
            fresh = graph.filter("new = 1")
            around = around.join(fresh.select("node").union(fresh.select("near")).distinct(), "node", "left_semi")
        met = (around.join(facts, "near").select("node", "near", "v", "worst", "new").repartition(parts, "node").sortWithinPartitions("node")
               .mapInArrow(_introduce, "node long, near long, dist double"))
        # An edge that betters a node's worst is rare after the first rounds, so little is shuffled.
        both = graph.withColumn("new", F.lit(0)).union(met.withColumn("new", F.lit(1)))
        new = common.save(_keep(both, DEGREE), free=turn < 2)
        common.drop(graph)
        graph, turn = new, turn + 1
        edges, fresh = graph.agg(F.count(F.lit(1)), F.coalesce(F.sum("new"), F.lit(0))).first()
        if fresh <= CHANGED * edges:
            for t in (whole, small):
                common.drop(t)
            return nodes, members, graph


def _distance(batches):
    """query_id, node, q, v -> query_id, node, opened, score."""
    for batch in batches:
        q, v = _matrix(batch.column("q")), _matrix(batch.column("v"))
        score = np.sqrt(((q - v) ** 2).sum(axis=1)) if batch.num_rows else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("node"), batch.column("opened"), pa.array(score)], names=["query_id", "node", "opened", "score"])


def search(queries: DataFrame, nodes: DataFrame, members: DataFrame, graph: DataFrame, top: int) -> DataFrame:
    """queries: (query_id, node, q) -> (query_id, rank, id, score): the `top` nearest members found, but not itself."""
    links = common.save(graph.select("node", "near").union(_back(graph.withColumn("new", F.lit(0)), ["dist", "near"], LINKS).select("node", "near")).distinct())
    few = nodes.select("node").orderBy(F.xxhash64("node")).limit(ENTRIES)  # a fixed bound
    known = queries.select("query_id", "node").union(queries.select("query_id").crossJoin(F.broadcast(few))).distinct().withColumn("opened", F.lit(False))
    vector = queries.select("query_id", "q")
    best = Window.partitionBy("query_id").orderBy("score", "node")

    def scored(df):
        return df.join(nodes, "node").join(vector, "query_id").select("query_id", "node", "opened", "q", "v").mapInArrow(
            _distance, "query_id long, node long, opened boolean, score double")

    beam = common.save(scored(known))
    while True:
        opened = beam.filter(~F.col("opened")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= OPEN).select("query_id", "node")
        fresh = (opened.join(links, "node").select("query_id", F.col("near").alias("node")).distinct()
                 .join(beam.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("opened", F.lit(False)))
        kept = beam.join(opened.withColumn("now", F.lit(True)), ["query_id", "node"], "left").select(
            "query_id", "node", (F.col("opened") | F.coalesce("now", F.lit(False))).alias("opened"), "score")
        new = common.save(kept.unionByName(scored(fresh)).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= BEAM).drop("r"))
        common.drop(beam)
        beam = new
        if not beam.filter(~F.col("opened")).limit(1).count():
            break
    common.drop(links)
    ranks = Window.partitionBy("query_id").orderBy("score", "id")
    found = beam.join(members, "node").filter("id != query_id").withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= top)
    return found.select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec: str = "embedding", top: int = 10) -> DataFrame:
    """query_id, rank (from 1), id_col, score: for each row that is_query holds for, its `top` nearest other rows found,
    by Euclidean distance in double precision on the original components, ties to the smaller id.

    Rows whose id or vector is null, or whose vector is empty, zero or has null or non-finite components, take no part.
    What a vector lacks of the table's longest one counts as zero. Equal vectors share a node. Of
    rows with one id the least vector counts, once. With fewer candidates all are returned. Other columns are ignored. An
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    common.ready(spark, 2000)
    rows = usable(vectors, id_col, vec)
    dim = rows.agg(F.max(F.size("v")).alias("d")).first()["d"] or 1
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).groupBy("id").agg(F.min("v").alias("v"))
    nodes, members, graph = build(rows, top + 1)
    asked = common.save(rows.filter(is_query(F.col("id"))).join(nodes, "v").select(F.col("id").alias("query_id"), "node", F.col("v").alias("q")))
    return search(asked, nodes, members, graph, top).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6 over embeddings: every hundredth vector against all others."""
    return nearest(common.documents(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0).select(
        F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), F.col("score").cast("double"))
