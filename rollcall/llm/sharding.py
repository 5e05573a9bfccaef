"""Sharding by Karmarkar-Karp differencing: tight byte balance for indivisible groups of equal texts.

`differencing` repeatedly combines the two partial partitions with the largest spread, the heavy parts of one with
the light parts of the other. It runs in three places with the same code: inside each task on blocks of groups, then
on the blocks' partial partitions, level by level, until one is left. No level gathers more than BLOCK entries.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 32768  # about twice as many groups as a task differences at once
FAN = 1024  # partial partitions combined at once on the levels above


def differencing(parts: list[list[int]]) -> list[list[int]]:
    """parts: partial partitions, each k sums. Returns for each part the final bin of each of its k bins.

    Ties in the spread go to the part given first; equal sums keep their order, so the result is deterministic.
    """
    if not parts:
        return []
    k = len(parts[0])
    nodes: list[tuple] = []  # (child, child's bins in sum order) twice, for combined nodes
    heap = []

    def push(sums: list[int], node: int) -> None:
        order = sorted(range(k), key=sums.__getitem__)
        low = sums[order[0]]
        heapq.heappush(heap, (low - sums[order[-1]], node, [sums[i] - low for i in order], order))

    for i, sums in enumerate(parts):
        nodes.append(())
        push(sums, i)
    while len(heap) > 1:
        _, a, sa, oa = heapq.heappop(heap)
        _, b, sb, ob = heapq.heappop(heap)
        sb.reverse()
        ob.reverse()
        nodes.append((a, oa, b, ob))
        push([x + y for x, y in zip(sa, sb, strict=True)], len(nodes) - 1)
    labels: list = [None] * len(nodes)
    labels[heap[0][1]] = list(range(k))
    for node in range(len(nodes) - 1, len(parts) - 1, -1):
        a, oa, b, ob = nodes[node]
        own = labels[node]
        for child, order in ((a, oa), (b, ob)):
            to = [0] * k
            for j, old in enumerate(order):
                to[old] = own[j]
            labels[child] = to
        labels[node] = None
    return labels[: len(parts)]


def _label_groups(k: int):
    def flush(rows: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(rows)
        out = differencing([[0] * (k - 1) + [int(s)] for s in pdf["group_size"]])
        return pdf.assign(bin=[x[k - 1] for x in out])

    def run(frames):
        held, block = [], None  # the rows of one block
        for pdf in frames:
            for own, part in pdf.groupby("block", sort=False):
                if held and own != block:
                    yield flush(held)
                    held = []
                held.append(part)
                block = own
        if held:
            yield flush(held)

    return run


def _combine(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("node")
    out = differencing([[int(x) for x in s] for s in pdf["sums"]])
    return pd.DataFrame({"node": pdf["node"], "parent": pdf["parent"], "sums": pdf["sums"], "to": out})


def assign_groups(groups: DataFrame, n_shards: int) -> DataFrame:
    """(key, group_size) with one row a key -> (key, shard). Blocks are cut by the keys' leading bytes, so the result is
    the same however Spark deals the rows."""
    groups = common.save(groups.select("key", "group_size"))
    blocks = left = max(1, -(-2 * groups.count() // BLOCK))  # half full on average
    block = F.expr("conv(hex(substring(key, 1, 6)), 16, 10)").cast("long") % F.lit(blocks)
    laid = groups.withColumn("block", block).repartition("block").sortWithinPartitions("block", F.desc("group_size"), "key")
    labelled = common.save(laid.mapInPandas(_label_groups(n_shards), "key binary, group_size long, block long, bin int"))
    sums = [F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("group_size"))), F.lit(0)) for i in range(n_shards)]
    level = common.save(labelled.groupBy(F.col("block").alias("node")).agg(F.array(*sums).alias("sums")))
    to = level.select(F.col("node").alias("block"), "node", F.array(*[F.lit(i) for i in range(n_shards)]).alias("to"))
    while left > 1:
        step = common.save(level.withColumn("parent", F.expr(f"node div {FAN}")).groupBy("parent").applyInPandas(
            _combine, "node long, parent long, sums array<long>, to array<int>"))
        to = to.join(step.select("node", "parent", F.col("to").alias("up")), "node").select(
            "block", F.col("parent").alias("node"), F.transform("to", lambda x: F.element_at("up", x + 1)).alias("to"))
        cells = step.select("parent", F.explode(F.arrays_zip("sums", "to")).alias("z"))
        sums = [F.coalesce(F.sum(F.when(F.col("z.to") == i, F.col("z.sums"))), F.lit(0)) for i in range(n_shards)]
        level = common.save(cells.groupBy("parent").agg(F.array(*sums).alias("sums")).withColumnRenamed("parent", "node"))
        left = -(-left // FAN)
    common.drop(groups)
    return labelled.join(to, "block").select("key", F.element_at("to", F.col("bin") + 1).alias("shard"))


def shard(docs: DataFrame, n_shards: int = 16, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row of docs with its shard and its place there; rows with equal texts always share a shard.

    Returns id_col, size, text_crc32, shard, slot. A row's size is its UTF-8 bytes plus 1, so empty texts count too.
    Null texts form one group with the empty text (size 1, checksum 0); repeated rows stay rows of their own, ties in
    id_col are ordered by checksum; null ids come first. The same rows get the same shards on any cluster. Other columns of docs are ignored, whatever they are called;
    an empty table gives no rows.
    """
    common.ready(docs.sparkSession, 10000)
    body = F.coalesce(F.col(text), F.lit(""))
    slim = common.save(docs.select(
        F.col(id_col), (F.octet_length(body) + F.lit(1)).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.unhex(F.sha2(body.cast("binary"), 256)).alias("key")))
    groups = slim.groupBy("key").agg(F.sum("size").alias("group_size"))
    placed = slim.join(assign_groups(groups, n_shards), "key").select(id_col, "size", "text_crc32", "shard")
    return common.ranked(placed, ["shard"], [id_col, "text_crc32"], "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: law `bytes` over documents, 16 shards."""
    return shard(common.documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
