"""Toxicity by a second-order factorization machine over hashed terms.

A term is a lower-cased word or the head of one, hashed into 2**DIM_BITS buckets; a text is the set of its terms. Besides additive
weights the machine has a short vector per term, and the dot product of two terms' vectors is their interaction, so
an insult next to a group mention can weigh more than both alone. Both are learnt together for all terms, and both are
sparse: a weight by L1, a vector as a group, where its gradients don't add up to more than chance; so long texts collect
little noise from common words, and a pair of terms that are neutral alone can still be learnt.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DIM_BITS = 20
MAX_BYTES = 256 << 20  # bound of the sample's texts; beyond it fewer rows are taken, of both classes alike
MAX_ROWS = 20000  # bound of the labelled sample that is fitted; toxic rows come first, up to half of it
RANK = 8
HEADS = (4, 6)  # the first bytes of a longer word are terms too, so inflected forms share weight
MIN_ROWS = 8  # terms of fewer sample rows are left out: they would only memorise them
FIRST = 0.05  # deviation of the vectors' first values
SIGMAS = 1.25  # deviations from zero that the sum of a vector's gradients must pass; chosen on a fifth of the training fold
THRESHOLD = 0.7


def _terms(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, bucket), distinct and sorted, of a slice of rows; and the number of rows."""
    data, off = common.utf8(part.column("text"))
    row, h = common.words(data, off, punct=True, heads=HEADS)
    key = np.unique((row.astype(np.int64) << DIM_BITS) | (h >> np.uint64(64 - DIM_BITS)).astype(np.int64))
    return key >> DIM_BITS, key & ((1 << DIM_BITS) - 1), part.num_rows


def _training_rows(batches):
    for batch in batches:
        for part in common.pieces(batch):
            row, bucket, n = _terms(part)
            at = np.searchsorted(row, np.arange(n + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"),
                 pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(bucket.astype(np.int32)))],
                names=["doc_id", "toxic", "idx"])


def train(y: np.ndarray, rows: list[np.ndarray] | tuple[np.ndarray, np.ndarray], epochs: int = 6, again: int = 6, batch: int = 64, alpha: float = 0.5, l1: float = 8.0,
          l2: float = 1e-4, rate: float = 0.1, sigmas: float = SIGMAS, seed: int = 11) -> dict:
    """y: 0/1, rows: the distinct term buckets of each (or all of them and their numbers).

    Weights and vectors of all terms are learnt together, each from the error of the whole machine: weights by FTRL with
    L1, vectors by dual averaging of their gradients, shrunk to zero within `sigmas` deviations (times the root of the
    epoch, as rows that come again are no new evidence) and started from small random values that don't stay. Terms that
    keep a weight or a vector are the model's; `again` more epochs (AdaGrad, L2) undo the shrinking.
    """
    if isinstance(rows, list):
        rows = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32), np.array([len(r) for r in rows], dtype=np.int64)
    flat, lens = rows
    del rows
    vocab = np.flatnonzero(np.bincount(flat, minlength=1 << DIM_BITS) >= MIN_ROWS)
    place = np.full(1 << DIM_BITS, -1, dtype=np.int32)
    place[vocab] = np.arange(len(vocab), dtype=np.int32)
    compact = place[flat]
    del flat
    keep = compact >= 0
    lens = np.diff(np.r_[0, np.cumsum(keep)][np.r_[0, np.cumsum(lens)]])
    compact = compact[keep]
    ptr = np.r_[0, np.cumsum(lens)]
    d = len(vocab)
    local = np.zeros(d, dtype=np.int64)  # where a term is among those of a batch
    rng = np.random.default_rng(seed)
    base = float(np.clip(y.mean() if len(y) else 0.0, 1e-3, 1 - 1e-3))
    b, nb = np.log(base / (1 - base)), 1.0
    z, n = np.zeros(d), np.zeros(d)
    v0, gs, sv = rng.normal(0, FIRST, (d, RANK)), np.zeros((d, RANK)), np.ones((d, RANK))
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((1 + np.sqrt(n)) / alpha + l2))
    def some(ids):
        row = np.repeat(np.arange(len(ids)), lens[ids])
        held = np.concatenate([compact[ptr[i]: ptr[i + 1]] for i in ids])
        terms = np.flatnonzero(np.bincount(held, minlength=d))
        local[terms] = np.arange(len(terms))
        return ids, row, local[held], terms

    def errors(ids, row, at, w, x):
        """Error of the whole machine on these rows, and the sum of the vectors of each."""
        s = np.stack([np.bincount(row, x[at, f], len(ids)) for f in range(RANK)], axis=1)
        q = np.bincount(row, (x * x).sum(axis=1)[at], len(ids))
        return 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[at], len(ids)) + 0.5 * ((s * s).sum(axis=1) - q), -30, 30))) - y[ids], s

    def slopes(row, at, g, s, x):
        gw, pull = np.bincount(at, g[row], len(x)), g[:, None] * s
        return gw, np.stack([np.bincount(at, pull[row, f], len(x)) for f in range(RANK)], axis=1) - gw[:, None] * x

    def shrunk(total, square, c):
        norm = np.sqrt((total * total).sum(axis=1))
        kept = np.maximum(0.0, 1 - c * np.sqrt(square.sum(axis=1)) / np.maximum(norm, 1e-12))
        return -rate * total / np.sqrt(square) * kept[:, None]

    for epoch in range(epochs):
        sure = sigmas * np.sqrt(epoch + 1)  # rows that come again are no new evidence
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            ids, row, at, terms = some(order[lo: lo + batch])
            w, x = solve(z[terms], n[terms]), v0[terms] + shrunk(gs[terms], sv[terms], sure)
            g, s = errors(ids, row, at, w, x)
            gw, gv = slopes(row, at, g, s, x)
            z[terms] += gw - (np.sqrt(n[terms] + gw * gw) - np.sqrt(n[terms])) / alpha * w
            n[terms] += gw * gw
            gs[terms] += gv
            sv[terms] += gv * gv
            nb += g.sum() ** 2
            b -= 0.5 * g.sum() / np.sqrt(nb)
    w = solve(z, n)
    v = shrunk(gs, sv, sure) if epochs else v0 * 0
    live = np.flatnonzero((w != 0) | v.any(axis=1))
    place = np.full(d, -1, dtype=np.int32)
    place[live] = np.arange(len(live))
    compact = place[compact]
    keep = compact >= 0
    lens = np.diff(np.r_[0, np.cumsum(keep)][ptr])
    compact, w, v = compact[keep], w[live], v[live]
    ptr = np.r_[0, np.cumsum(lens)]
    sw, sv = np.ones(len(live)), np.ones(v.shape)
    for _ in range(again if len(live) else 0):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            ids, row, at, terms = some(order[lo: lo + batch])
            x, k = v[terms], len(terms)
            g, s = errors(ids, row, at, w[terms], x)
            gw, gv = slopes(row, at, g, s, x)
            gw = gw + 1e-3 * w[terms]
            gv = gv + 1e-2 * x
            sw[terms] += gw * gw
            sv[terms] += gv * gv
            w[terms] -= 0.2 * gw / np.sqrt(sw[terms])
            v[terms] -= 0.05 * gv / np.sqrt(sv[terms])
            nb += g.sum() ** 2
            b -= 0.1 * g.sum() / np.sqrt(nb)
    return {"bias": float(b), "bucket": vocab[live].astype(np.int64), "w": w, "v": v}


def _smallest(rows: DataFrame, n: int, most: int) -> DataFrame:
    """The `most` smallest hashes h of n rows; the margin is eight standard deviations."""
    if n <= most:
        return rows
    return rows.filter(F.col("h") <= min(1.0, (most + 8 * most ** 0.5 + 16) / n)).orderBy("h", "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, train_on, max_rows: int = MAX_ROWS) -> dict:
    """labels: doc_id, toxic. train_on: Column over doc_id. The sample is max_rows rows at most: the smallest hashes of
    doc_id of each class, with MAX_BYTES of text in all. Toxic rows fill up to half of it before clean ones (either more,
    where the other has fewer). Of rows with one doc_id the least text is learnt from."""
    known = (labels.filter(train_on & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("h", F.xxhash64("doc_id") / F.lit(2.0 ** 64) + 0.5))
    n = {bool(r["t"]): r["n"] for r in known.groupBy((F.col("toxic") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(True, 0), n.get(False, 0)
    most = min(toxic, max(max_rows // 2, max_rows - clean))
    quota = {True: most, False: min(clean, max_rows - most)}

    def sample():
        picked = [_smallest(known.filter((F.col("toxic") > 0) == t), n[t], quota[t]).select("doc_id", "toxic") for t in sorted(n)]
        picked = picked[0].union(picked[1]) if len(picked) == 2 else picked[0] if picked else known.select("doc_id", "toxic")
        # max_rows ids at most: the broadcast is bounded, and so is what is aggregated.
        return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    some = sample()
    if (share := common.byte_share(some, MAX_BYTES)) < 1:
        quota = {t: max(1, int(k * share)) if k else 0 for t, k in quota.items()}
        some = sample()
    got = some.mapInArrow(_training_rows, "doc_id long, toxic int, idx array<int>").toArrow().combine_chunks()
    lists = got.column("idx").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    values, off = np.asarray(lists.values), np.asarray(lists.offsets)
    y, ids = np.asarray(got.column("toxic")), np.asarray(got.column("doc_id"))
    # Copies count once, so that a large group of them cannot be learnt by heart.
    once = {(hashlib.sha256(values[off[i]: off[i + 1]].tobytes()).digest(), int(y[i])): i for i in np.argsort(ids, kind="stable")}
    kept = list(once.values())
    y = y[kept].astype(float)
    held = [(np.concatenate([*[values[off[i]: off[i + 1]] for i in kept], np.zeros(0, np.int32)]), np.diff(off)[kept] if kept else np.zeros(0, np.int64))]
    del got, lists, values, once
    common.tidy()
    model = train(y, held.pop())  # which lets go of the sample as soon as it can
    if n and quota != {True: toxic, False: clean} and all(quota.values()):
        # The classes were sampled at different rates, which moves nothing but the odds before any term is seen.
        model["bias"] += float(np.log(toxic / clean) - np.log(quota[True] / quota[False]))
    common.tidy()
    return model


def _score(model):
    def score(part):
        row, bucket, n = _terms(part)
        at = np.searchsorted(model["bucket"], bucket)
        at[at == len(model["bucket"])] = 0
        hit = model["bucket"][at] == bucket if len(model["bucket"]) else np.zeros(len(bucket), bool)
        row, at = row[hit], at[hit]
        v = model["v"][at]
        s = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], axis=1)
        q = np.bincount(row, (v * v).sum(axis=1), n)
        x = model["bias"] + np.bincount(row, model["w"][at], n) + 0.5 * ((s * s).sum(axis=1) - q)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch):
                keep = [c for c in part.schema.names]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(score(part), pa.float64())], names=[*keep, "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs with a score of 0..1 for each whole text (null or empty: that of no terms). A column `score` is replaced.

    Repeated rows and ids stay rows of their own; equal texts get equal scores; an empty table stays empty.
    """
    docs = docs.drop("score")
    return docs.mapInArrow(_score(model), common.schema_with(docs.schema, ("score", "double")))


def fold():
    return F.crc32(F.col("doc_id").cast("string")) % 3


def rate(docs: DataFrame, labels: DataFrame, sample_from: DataFrame | None = None) -> DataFrame:
    """docs with held_out, score and predicted (columns of these names are replaced); learnt from labels of documents
    outside the held-out fold. Rows with a null doc_id are neither learnt from nor held out; an id with several labels is
    toxic if one of them is. Repeated rows and very long texts are scored as they are."""
    common.ready(docs.sparkSession)
    model = fit(docs if sample_from is None else sample_from, labels, fold() != 1)
    return (score(docs, model).withColumn("held_out", F.coalesce(fold() == 1, F.lit(False)))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 over documents, learnt from labels."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    labels = common.documents(spark, sf_dir, "labels").select("doc_id", "toxic")
    return rate(docs, labels).select("doc_id", "held_out", "score", "predicted")
