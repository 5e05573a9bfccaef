"""Hard negatives: for each anchor and positive, the different-label rows that score almost as high as the positive.

Scores are exact integer inner products, worked out the Four-Russians way. A candidate's components are cut into bit planes
(two's complement) and each plane into bytes of eight dimensions; an anchor has, for each eight dimensions, a table of the
sums of all 256 subsets of its components. A plane's product is then one look-up a byte, and the planes are added up by
shifting. Candidates are packed once, in blocks; anchors form blocks too, and both meet on a grid whose cells are dealt out
by an equi-join, so every anchor is scored against every row and no task holds more than a block of each and, for each
anchor of a block, its best so far. Rows are read twice: for the positives, then for the negatives around their scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

CANDIDATES = 4096  # rows of a block
ANCHORS = 2048  # anchors of a block
HELD = 128  # candidate blocks a cell of the grid holds at most; they are kept while anchors pass by
LARGEST = 1 << 40  # components must be smaller than this

_BLOCK = "kind string, block long, n int, dims int, ids binary, labels binary, uids binary, bits int, data binary"
_FOUND = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, uid long, vec_id long, score long"


# ---------------------------------------------------------------- blocks

def planes(q: np.ndarray) -> np.ndarray:
    """(n, dims) integers -> (bits, n, dims / 8) bytes: bit i of byte g of plane p is bit p of component 8 g + i."""
    n, dims = q.shape
    bits = 1 if not q.size else 1 + max(int(q.max()).bit_length(), int(~q.min()).bit_length())
    wide = np.zeros((n, -(-dims // 8) * 8), dtype=np.int64)
    wide[:, :dims] = q
    return np.stack([np.packbits(((wide >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(bits)])


def scores(anchors: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Exact inner products of (a, dims) anchors and packed candidates, as (a, n)."""
    bits, n, groups = packed.shape
    a = np.zeros((len(anchors), 8 * groups), dtype=np.int64)
    shared = min(anchors.shape[1], 8 * groups)  # what a shorter vector lacks counts as zero
    a[:, :shared] = anchors[:, :shared]
    largest = int(np.abs(a).sum(axis=1).max(initial=0)) << bits
    if largest >= 1 << 62:
        raise ValueError("components are too large for exact 64-bit scores")
    kind = np.int32 if largest < 1 << 30 else np.int64
    table = np.zeros((groups, 256, len(a)), dtype=kind)  # sums of the subsets of each eight components, by their bits
    for b in range(8):
        table[:, 1 << b: 2 << b] = table[:, : 1 << b] + a[:, b::8].T[:, None, :].astype(kind)
    out = np.empty((len(a), n), dtype=kind)
    for lo in range(0, n, 256):
        part = packed[:, lo: lo + 256]
        sums = np.zeros((part.shape[0] * part.shape[1], len(a)), dtype=kind)
        for g in range(groups):
            sums += table[g][part[:, :, g].ravel()]
        sums = sums.reshape(*part.shape[:2], len(a))
        total = -sums[-1]  # the sign's plane
        for p in range(bits - 2, -1, -1):
            total = (total << 1) + sums[p]
        out[:, lo: lo + 256] = total.T
    return out


def _pack(anchor_size: int, candidate_size: int):
    """Rows (uid, vec_id, label, q, is_anchor) -> blocks of both kinds."""
    def block(kind: str, rows: pa.Table) -> pa.RecordBatch:
        q = [np.asarray(x, dtype=np.int64) for x in rows.column("q").to_pylist()]
        dims = max(map(len, q), default=0)
        wide = np.zeros((len(q), dims), dtype=np.int64)
        for i, x in enumerate(q):
            wide[i, : len(x)] = x
        if wide.size and max(int(wide.max()), -int(wide.min())) >= LARGEST:
            raise ValueError(f"components must be smaller than {LARGEST}")
        data = planes(wide) if kind == "candidate" else wide.astype(np.int32 if wide.size and np.abs(wide).max() < 1 << 31 else np.int64)
        raw = lambda c: np.asarray(rows.column(c).to_numpy(), dtype="<i8").tobytes()
        bits = len(data) if kind == "candidate" else data.dtype.itemsize * 8
        row = (kind, int(rows.column("uid")[0].as_py()), len(q), dims, raw("vec_id"), raw("label"), raw("uid"), bits, data.tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _TYPES, strict=True)], names=_NAMES)

    def run(batches):
        held = {"anchor": [], "candidate": []}
        for batch in batches:
            for kind, rows in (("candidate", batch), ("anchor", batch.filter(batch.column("is_anchor")))):
                most = anchor_size if kind == "anchor" else candidate_size
                held[kind] += [rows] if rows.num_rows else []
                while sum(b.num_rows for b in held[kind]) >= most:
                    t = pa.Table.from_batches(held[kind])
                    yield block(kind, t.slice(0, most))
                    held[kind] = t.slice(most).to_batches()
        for kind, rows in held.items():
            if sum(b.num_rows for b in rows):
                yield block(kind, pa.Table.from_batches(rows))

    return run


_NAMES = [f.split()[0] for f in _BLOCK.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]] for f in _BLOCK.split(", ")]


class _Anchors:
    def __init__(self, ids, labels, uids, data, bits, dims):
        self.ids, self.labels, self.uids = (np.frombuffer(x, dtype="<i8") for x in (ids, labels, uids))
        self.data = np.frombuffer(data, dtype=f"<i{bits // 8}").reshape(len(self.ids), dims)


class _Candidates:
    def __init__(self, ids, labels, uids, data, bits, dims):
        self.ids, self.labels, self.uids = (np.frombuffer(x, dtype="<i8") for x in (ids, labels, uids))
        self.data = np.frombuffer(data, dtype=np.uint8).reshape(bits, len(self.ids), -(-dims // 8))
        self.by_label = {x: np.flatnonzero(self.labels == x) for x in np.unique(self.labels).tolist()}


class _Best:
    """The `most` first of (score, vec_id, uid), highest score first, then smallest vec_id, then uid."""

    def __init__(self, most: int):
        self.most, self.rows = most, np.zeros((3, 0), dtype=np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, uids: np.ndarray) -> None:
        if len(score) > self.most:
            least = np.partition(score, len(score) - self.most)[len(score) - self.most]
            keep = score >= least
            score, ids, uids = score[keep], ids[keep], uids[keep]
        rows = np.concatenate([self.rows, [score.astype(np.int64), ids, uids]], axis=1)
        self.rows = rows[:, np.lexsort((rows[2], rows[1], -rows[0]))[: self.most]]


def _positives(a: _Anchors, i: int, s: np.ndarray, c: _Candidates, best: dict, most: int) -> None:
    at = c.by_label.get(int(a.labels[i]))
    if at is None:
        return
    at = at[c.uids[at] != a.uids[i]]
    best.setdefault((i, -1, -1, 0), _Best(most)).add(s[at], c.ids[at], c.uids[at])


def _negatives(wanted: dict, low: int, high: int):
    def add(a: _Anchors, i: int, s: np.ndarray, c: _Candidates, best: dict, most: int) -> None:
        mine = wanted.get(int(a.uids[i]))
        if not mine:
            return
        other = c.labels != a.labels[i]
        for uid, vec_id, positive in mine:
            # Rounded to the side on which whole scores satisfy low * positive <= 100 * score <= high * positive.
            at = np.flatnonzero(other & (s >= -(-low * positive // 100)) & (s <= high * positive // 100))
            if len(at):
                best.setdefault((i, uid, vec_id, positive), _Best(most)).add(s[at], c.ids[at], c.uids[at])
    return add


def _meet(most: int, low: int, high: int, negatives: bool):
    """Joined pairs of blocks, those of one anchor block mostly in a row -> each anchor's best of them."""
    def run(batches):
        key, a, best, add = None, None, {}, _positives

        def flush():
            cols = [[] for _ in range(8)]
            for (i, uid, vec_id, positive), b in best.items():
                for score, cid, cuid in b.rows.T.tolist():
                    for col, x in zip(cols, (int(a.uids[i]), int(a.ids[i]), uid, vec_id, positive, cuid, cid, score), strict=True):
                        col.append(x)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=[f.split()[0] for f in _FOUND.split(", ")])

        for batch in batches:
            for r in batch.to_pylist():
                if r["a_block"] != key:
                    if best:
                        yield flush()
                    key, best = r["a_block"], {}
                    a = _Anchors(r["a_ids"], r["a_labels"], r["a_uids"], r["a_data"], r["a_bits"], r["a_dims"])
                    if negatives:
                        wanted = {}
                        for w in r["wanted"]:
                            wanted.setdefault(w["anchor"], []).append((w["uid"], w["vec_id"], w["score"]))
                        add = _negatives(wanted, low, high)
                c = _Candidates(r["ids"], r["labels"], r["uids"], r["data"], r["bits"], r["dims"])
                for lo in range(0, len(a.ids), 64):
                    s = scores(a.data[lo: lo + 64], c.data)
                    for i in range(len(s)):
                        add(a, lo + i, s[i], c, best, most)
        if best:
            yield flush()

    return run


# ---------------------------------------------------------------- the operator

def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """Hard negatives of the anchors among `rows` (vec_id long, embedding array, label).

    Components become floor(scale * x). An anchor's positives are its first `positives` other rows of the same label, by
    falling score and then by vec_id; for each of them come the first `negatives` rows of other labels whose score s
    satisfies low * positive score <= 100 * s <= high * positive score. Returns anchor_id, positive_id, rank (from 1),
    negative_id, positive_score, negative_score.

    Rows take no part whose vec_id, label or vector is null or whose vector has a null or non-finite component. Rows, not
    ids, are told apart: rows that share a vec_id or are repeated wholly are each other's candidates and are each an
    anchor; among equal scores and ids the order is that of the rows in the table. Vectors may differ in length: what the
    shorter one lacks counts as zero (an empty one scores 0 with all). Components of 2^40 and more after scaling are
    refused. An anchor without positives, or a positive without negatives, has no row; an empty table gives none. Columns
    of other names don't matter.
    """
    spark = rows.sparkSession
    common.ready(spark)
    c = F.col
    sound = c("vec_id").isNotNull() & c("label").isNotNull() & c("embedding").isNotNull() & F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    # The anchors' mark is worked out before rows are left out, since numbering rows keeps filters where they are.
    flat = rows.select(c("vec_id").cast("long").alias("vec_id"), c("label").cast("long").alias("label"), "embedding", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")).filter(sound)
    flat = flat.select("vec_id", "label", q.alias("q"), "is_anchor", F.monotonically_increasing_id().alias("uid"))
    blocks = common.save(flat.mapInArrow(_pack(ANCHORS, CANDIDATES), _BLOCK))
    n = {r["kind"]: r["count"] for r in blocks.groupBy("kind").count().collect()}
    n_a, n_c = n.get("anchor", 0), n.get("candidate", 0)
    # A grid of `wide` x `high_` cells: enough to keep all cores busy, few enough to copy little, and no cell with too many blocks.
    cells = 2 * max(common.partitions(spark), spark.sparkContext.defaultParallelism)
    tall = max(1, min(n_c, cells), -(-n_c // HELD))
    wide = max(1, min(n_a, cells // tall))
    slot = lambda k: F.pmod(F.xxhash64("block"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    candidates = blocks.filter("kind = 'candidate'").withColumn("tall", slot(tall)).withColumn("wide", every(wide)).drop("kind", "block", "n")
    anchors = blocks.filter("kind = 'anchor'").select(c("block").alias("a_block"), slot(wide).alias("wide"), *[c(x).alias(f"a_{x}") for x in ("ids", "labels", "uids", "data", "bits", "dims")])

    def met(anchors: DataFrame, most: int, negatives: bool) -> DataFrame:
        left = anchors.withColumn("tall", every(tall))
        return left.hint("merge").join(candidates, ["wide", "tall"]).drop("wide", "tall").mapInArrow(_meet(most, low, high, negatives), _FOUND)

    def first(found: DataFrame, most: int, *keys: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "uid")
        return found.withColumn("rank", F.row_number().over(order)).filter(c("rank") <= most)

    best = common.save(first(met(anchors, positives, False), positives, "anchor"))
    # The positives of a block's anchors, `positives` for each of its ANCHORS at most.
    of = blocks.filter("kind = 'anchor'").select("block", "uids").mapInArrow(_members, "block long, anchor long")
    wanted = best.join(of, "anchor").groupBy(c("block").alias("a_block")).agg(F.collect_list(F.struct("anchor", "uid", "vec_id", "score")).alias("wanted"))
    found = first(met(anchors.join(wanted, "a_block"), negatives, True), negatives, "anchor", "positive")
    return found.select("anchor_id", "positive_id", c("rank").cast("int").alias("rank"), c("vec_id").alias("negative_id"), "positive_score", c("score").alias("negative_score"))


def _members(batches):
    for batch in batches:
        for r in batch.to_pylist():
            uids = np.frombuffer(r["uids"], dtype="<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(uids), r["block"])), pa.array(uids)], names=["block", "anchor"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12 over embeddings; every seventh row's label is turned into the next one."""
    rows = common.documents(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.select("vec_id", "embedding", label.alias("label")), F.col("vec_id") % 100 == 0)
