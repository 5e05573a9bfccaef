"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

1. A bounded sample of labelled training rows per language is chosen by the smallest hashes of doc_id.
2. Document frequencies of hashed 1..3-grams are counted over every labelled training document (never the held-out fold).
3. Weights are learnt by follow-the-regularised-leader (FTRL-proximal) with L1 and L2 penalties; a fifth of the
   sample is kept out of it and sets the temperature that calibrates the softmax.
4. Every whole text is scored in Arrow batches; only the weights (bounded by DIM x languages) are shipped.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DIM_BITS = 16
DIM = 1 << DIM_BITS
ORDERS = (1, 2, 3)
SCALE = 20.0
PER_LANGUAGE = 1500  # bound of the labelled sample
MAX_BYTES = 128 << 20  # bound of its texts; beyond it fewer rows a language are taken


def _grams(batch: pa.RecordBatch):
    """Lower-cased characters of the batch -> (row starts, row ends, codes per order): one code a starting character."""
    texts = ["\n" + t.lower() + "\n" if t else "\n" for t in batch.column("text").to_pylist()]
    ends = np.cumsum([len(t) for t in texts])
    ch = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    a = ch * np.uint32(0x9E3779B1)
    codes = []
    h = np.zeros(len(ch), dtype=np.uint32)
    for n in ORDERS:
        h = (h * np.uint32(0x85EBCA6B)) ^ (np.concatenate([a[n - 1:], np.zeros(min(n - 1, len(a)), np.uint32)]) + np.uint32(n))
        x = h ^ (h >> np.uint32(15))
        x *= np.uint32(0x2C1B3C6D)
        codes.append(((x >> np.uint32(32 - DIM_BITS)).astype(np.int32), n))
    return np.r_[0, ends[:-1]].astype(np.int64), ends.astype(np.int64), codes


def _over(starts, ends, n):
    """Starting characters whose n-gram would run over the end of its row."""
    return np.concatenate([np.maximum(ends - i, starts) for i in range(1, n)]) if n > 1 else np.zeros(0, np.int64)


def _document_frequency(batches):
    df = np.zeros(DIM, dtype=np.int64)
    mark = np.zeros(DIM, dtype=np.int64)
    clock = 0
    for batch in batches:
        for part in common.pieces(batch):
            starts, ends, codes = _grams(part)
            for c, n in codes:
                c = c.copy()
                c[_over(starts, ends, n)] = -1
                for s, e in zip(starts, ends, strict=True):
                    own = c[s: max(s, e - n + 1)]
                    at = np.arange(clock, clock + len(own))
                    mark[own] = at
                    last = own[mark[own] == at]
                    df[last] += 1
                    clock += len(own) + 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["bucket", "df"])


def _training_rows(idf):
    def run(batches):
        for batch in batches:
            for part in common.pieces(batch):
                starts, ends, codes = _grams(part)
                idx, val = [], []
                for s, e in zip(starts, ends, strict=True):
                    own = np.concatenate([c[s: max(s, e - n + 1)] for c, n in codes])
                    u, k = np.unique(own, return_counts=True)
                    idx.append(u)
                    val.append((k * (SCALE / len(own)) * idf[u]).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("lang"), pa.array(idx, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))],
                    names=["doc_id", "lang", "idx", "val"])

    return run


def ftrl(rows: list, n_classes: int, alpha=0.5, beta=1.0, l1=0.01, l2=0.01, epochs=4, seed=7) -> tuple[np.ndarray, np.ndarray]:
    """rows: (class, idx, val). FTRL-proximal for the softmax loss -> (DIM x classes weights, biases)."""
    z, nn = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))
    zb, nb = np.zeros(n_classes), np.zeros(n_classes)
    solve = lambda z, n, a, b: np.where(np.abs(z) <= a, 0.0, -(z - np.sign(z) * a) / ((beta + np.sqrt(n)) / alpha + b))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            y, idx, val = rows[i]
            w, b = solve(z[idx], nn[idx], l1, l2), solve(zb, nb, 0.0, 0.0)
            s = val @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = val[:, None] * p
            z[idx] += g - (np.sqrt(nn[idx] + g * g) - np.sqrt(nn[idx])) / alpha * w
            nn[idx] += g * g
            zb += p - (np.sqrt(nb + p * p) - np.sqrt(nb)) / alpha * b
            nb += p * p
    return solve(z, nn, l1, l2), solve(zb, nb, 0.0, 0.0)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        s = s - s.max(axis=1, keepdims=True)
        return (np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean()

    lo, hi, r = -2.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fit(docs: DataFrame, train, per_language: int = PER_LANGUAGE) -> dict:
    """docs: doc_id, text, lang. train: Column, true for rows that may be learnt from. -> model of DIM weights a language.

    Rows without a language are not learnt from at all: neither their document frequencies nor their number count.
    """
    usable = docs.filter(train & F.col("lang").isNotNull())
    counts = usable.groupBy().agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if not counts:
        return {"langs": []}
    rows = usable.select("text").mapInArrow(_document_frequency, "bucket int, df long")
    df = np.zeros(DIM)
    for r in rows.groupBy("bucket").agg(F.sum("df").alias("df")).collect():  # DIM rows at most
        df[r["bucket"]] = r["df"]
    idf = np.log((1 + counts) / (1 + df)) + 1
    named = usable.select("doc_id", "lang").distinct().withColumn("h", F.xxhash64("doc_id") / F.lit(2.0 ** 64) + 0.5)
    share = named.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count(F.lit(1))).alias("share"))
    first = Window.partitionBy("lang").orderBy("h", "doc_id")

    def sample(most):
        picked = (named.join(share, "lang").filter("h <= share").withColumn("r", F.row_number().over(first))
                  .filter(F.col("r") <= most).select("doc_id", "lang"))
        # At most per_language ids a language, so the broadcast is bounded; of rows with one id the least text counts.
        rows = usable.select("doc_id", "text", "lang").join(F.broadcast(picked), ["doc_id", "lang"], "left_semi")
        return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))

    some = sample(per_language)
    if (part := common.byte_share(some, MAX_BYTES)) < 1:
        some = sample(max(5, int(per_language * part)))
    got = some.mapInArrow(_training_rows(idf), "doc_id long, lang string, idx array<int>, val array<float>").toArrow().to_pandas()
    got = got.sort_values("doc_id", kind="stable").reset_index(drop=True)
    langs = sorted(got["lang"].unique())
    sample = [(langs.index(y), i, v) for y, i, v in zip(got["lang"], got["idx"], got["val"], strict=True)]
    learn, hold = [s for k, s in enumerate(sample) if k % 5], sample[::5]
    w, b = ftrl(learn or hold, len(langs))
    logits = np.array([v @ w[i] + b for _, i, v in hold]).reshape(len(hold), len(langs))
    t = temperature(logits, np.array([y for y, _, _ in hold], dtype=int))
    del got, sample, learn, hold
    common.tidy()
    return {"langs": langs, "weights": (w * idf[:, None] * SCALE).astype(np.float32), "bias": b, "temperature": t,
            "nonzero": int((w != 0).any(axis=1).sum())}


def _predict(model, mark: str):
    langs = np.array(model["langs"], dtype=object)

    def score(part):
        starts, ends, codes = _grams(part)
        total = np.zeros((len(starts), len(langs)), dtype=np.float64)
        number = np.zeros(len(starts))
        for c, n in codes:
            drop = _over(starts, ends, n)
            for k in range(len(langs)):
                v = model["columns"][k][c]
                v[drop] = 0
                total[:, k] += np.add.reduceat(v, starts, dtype=np.float64)
            number += np.maximum(ends - starts - n + 1, 0)
        s = (total / np.maximum(number, 1)[:, None] + model["bias"]) / model["temperature"]
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return langs[p.argmax(axis=1)], p.max(axis=1)

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch):
                if len(langs):
                    lang, p = score(part)
                    letters = np.array(part.column(mark).to_pylist(), dtype=bool)
                    lang, p = np.where(letters, lang, "und"), np.where(letters, p, 0.0)
                else:
                    lang, p = ["und"] * part.num_rows, np.zeros(part.num_rows)
                keep = [c for c in part.schema.names if c != mark]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(lang, pa.string()), pa.array(p, pa.float64())],
                                                 names=[*keep, "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and score. `und` with score 0 where text is null or has no letter (or nothing was learnt).

    Columns of docs called lang_pred or score are replaced. Repeated rows and ids stay; equal texts get equal
    predictions; long texts are read whole; an empty table stays empty.
    """
    if model["langs"]:
        model = {k: v for k, v in model.items() if k != "weights"} | {"columns": [np.ascontiguousarray(c) for c in model["weights"].T]}
    docs = docs.drop("lang_pred", "score")
    mark = common.free_name(docs, "_letters")
    rows = docs.withColumn(mark, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return rows.mapInArrow(_predict(model, mark), common.schema_with(docs.schema, ("lang_pred", "string"), ("score", "double")))


def fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def identify(docs: DataFrame) -> DataFrame:
    """docs with held_out, lang_pred and score (columns of these names are replaced); learnt from rows with a language
    outside the held-out fold. Rows with a null doc_id are neither learnt from nor held out. Ties go to the language
    first in the alphabet."""
    common.ready(docs.sparkSession)
    model = fit(docs.select("doc_id", "text", "lang"), fold(5) != 0)
    return predict(docs, model).withColumn("held_out", F.coalesce(fold(5) == 0, F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8 over documents."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
