"""MinHash near-duplicates verified by odd sketches.

Every text becomes a set of word shingles, a MinHash of K samples, BANDS band keys of it, and an odd sketch: each sample
toggles one bit of a parity bitmap, so the population count of two bitmaps' XOR tells how many samples differ, and
estimates a high similarity more precisely than the bands do. Candidates from equal bands pass the sketch first and are
confirmed on their full sets. Texts with equal sets are one class from the start.

Groups of copies don't become all pairs: first each text is tried against one hub of its bands, a text that shares the
most bands with others, and the linked ones coalesce; then only texts of one band that are still in different components
are compared, each pair in the first band it shares. Texts tried against the same hub keep how they differ from it, and
from these short differences the join itself tells the exact similarity of the two.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BANDS, ROWS = 32, 4
BAND_SAMPLES = BANDS * ROWS
K = 512  # MinHash samples: the first BAND_SAMPLES make bands, all are folded into the sketch
BITS = 2048
MARGIN = 0.12  # a candidate is dropped if its estimate is below the threshold by more: 5 standard deviations
SET_BITS = 54
DELTA = 256  # a longer difference isn't carried; the full sets decide then

_rng = np.random.default_rng(97)
_A = (_rng.integers(0, 1 << 31, K, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


def sets(part: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row starts, hashes): the distinct shingles of each row, sorted; SET_BITS bits each."""
    data, off = common.utf8(part.column("text"))
    row, h = common.words(data, off)
    n = part.num_rows
    count = np.bincount(row, minlength=n)
    mult = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(width)], dtype=np.uint64)
    run = np.zeros(max(len(h) - width + 1, 0), dtype=np.uint64)
    for i in range(width):
        run += h[i: i + len(run)] * mult[i]
    whole = row[: len(run)] == row[width - 1: width - 1 + len(run)]
    rows, keys = [row[: len(run)][whole]], [run[whole]]
    short = np.flatnonzero((count > 0) & (count < width))  # fewer words: the whole sequence as one
    if len(short):
        first = np.r_[0, np.cumsum(count)][:-1][short]
        own = np.array([sum(int(h[f + i]) * int(mult[i]) for i in range(count[s])) + int(count[s]) & common.MASK64
                        for s, f in zip(short, first, strict=True)], dtype=np.uint64)
        rows.append(short)
        keys.append(own)
    key = (np.concatenate(rows).astype(np.uint64) << np.uint64(SET_BITS)) | (common.mix(np.concatenate(keys)) >> np.uint64(64 - SET_BITS))
    key = np.unique(key)
    starts = np.searchsorted(key >> np.uint64(SET_BITS), np.arange(n + 1, dtype=np.uint64))
    return starts, key & np.uint64((1 << SET_BITS) - 1)


def signatures(starts: np.ndarray, h: np.ndarray) -> np.ndarray:
    """K x rows MinHash samples; the rows must have shingles."""
    x = (common.mix(h) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((K, len(starts)), dtype=np.uint32)
    for j in range(0, K, 16):
        out[j: j + 16] = np.minimum.reduceat(x[None, :] * _A[j: j + 16, None] + _B[j: j + 16, None], starts, axis=1)
    return out


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """rows x BITS/64: sample j with value v toggles one bit chosen by (j, v)."""
    n = sig.shape[1]
    place = common.mix((sig.astype(np.uint64) << np.uint64(16)) | np.arange(K, dtype=np.uint64)[:, None]) % np.uint64(BITS)
    at = (np.arange(n)[None, :] * BITS + place.astype(np.int64)).ravel()
    odd = (np.bincount(at, minlength=n * BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, BITS), axis=1).view(np.int64)


def sketch_limit(similarity: float) -> int:
    """The most differing bits that a pair estimated at this similarity shows."""
    return math.floor(BITS / 2 * (1 - math.exp(-4 * K * (1 - similarity) / BITS)))


def set_keys(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set; `at` are the starts of sets that have shingles."""
    m = common.mix(h + np.uint64(1))
    return np.add.reduceat(m, at).view(np.int64), np.add.reduceat(common.mix(m ^ np.uint64(0x5851F42D4C957F2D)), at).view(np.int64)


def _features(width: int, carry: list[str]):
    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, most=1 << 19):
                for lo in range(0, part.num_rows, 1000):  # a row number has 64 - SET_BITS bits
                    p = part.slice(lo, 1000)
                    starts, h = sets(p, width)
                    n = np.diff(starts)
                    full = np.flatnonzero(n)
                    bands = np.zeros((p.num_rows, BANDS), np.int64)
                    odd = np.zeros((p.num_rows, BITS // 64), np.int64)
                    k1, k2 = np.zeros(p.num_rows, np.int64), np.zeros(p.num_rows, np.int64)
                    if len(full):
                        at = starts[:-1][full]
                        sig = signatures(at, h)
                        odd[full] = odd_sketch(sig)
                        b = np.zeros((BANDS, len(full)), np.uint64)
                        for r in range(ROWS):
                            b = common.mix(b + sig[r:BAND_SAMPLES:ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(BANDS, dtype=np.uint64)[:, None])
                        bands[full] = b.T.view(np.int64)
                        k1[full], k2[full] = set_keys(h, at)
                    flat = lambda x, k: pa.ListArray.from_arrays(pa.array(np.arange(p.num_rows + 1, dtype=np.int32) * k), pa.array(x.ravel()))
                    yield pa.RecordBatch.from_arrays([*(p.column(c) for c in carry), pa.array(n.astype(np.int64)), pa.array(k1), pa.array(k2), flat(bands, BANDS), flat(odd, BITS // 64)],
                                                     names=[*carry, "n", "k1", "k2", "bands", "odd"])

    return run


def _sets_only(width: int):
    """text -> the digests and the sorted hashes of its set, if that isn't empty."""
    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, most=1 << 19):
                for lo in range(0, part.num_rows, 1000):
                    starts, h = sets(part.slice(lo, 1000), width)
                    n = np.diff(starts)
                    at = starts[:-1][n > 0]
                    k1, k2 = set_keys(h, at) if len(at) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(n[n > 0].astype(np.int64)), pa.array(k1), pa.array(k2), pa.array([h[s: s + k].tobytes() for s, k in zip(at, n[n > 0], strict=True)], pa.binary())],
                                                     names=["n", "k1", "k2", "items"])

    return run


def _confirm(percent: int):
    """a, b and their sets x, y -> a, b, linked, and delta: what is in one set only, if that is short."""
    def run(batches):
        for batch in batches:
            linked, delta = [], []
            for p, q in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)])
                both.sort(kind="stable")
                same = both[1:] == both[:-1]
                n = int(same.sum())
                linked.append(100 * n >= percent * (len(both) - n))
                short = len(both) - 2 * n <= DELTA
                delta.append(both[~(np.r_[same, False] | np.r_[False, same])].view(np.int64) if short else None)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(delta, pa.list_(pa.int64()))],
                                             names=["a", "b", "linked", "delta"])

    return run


def _close(percent: int):
    """Column: the sketches x.odd and y.odd differ in few enough bits for the similarity, less MARGIN."""
    differ = F.aggregate(F.zip_with("x.odd", "y.odd", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, n: s + n)
    return differ <= sketch_limit(percent / 100 - MARGIN)


def _verify(near: DataFrame, items: DataFrame, percent: int) -> DataFrame:
    """near, a saved table of (a, b), with `linked` by their full sets, and `delta`."""
    both = (near.join(items.select(F.col("cid").alias("a"), F.col("items").alias("x")), "a")
            .join(items.select(F.col("cid").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y"))
    out = common.save(both.mapInArrow(_confirm(percent), "a long, b long, linked boolean, delta array<long>"), free=True)
    common.drop(near)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """docs: doc_id, text -> doc_id, columns of `carry`, n_shingles, component_id, kept, component, one row for each row of
    docs.

    Two texts are linked if their sets of `width`-word shingles have a Jaccard similarity of percent / 100 or more;
    component_id is the smallest doc_id reachable, and kept tells whether that is the row's own. Words are parted by ASCII
    white space, A-Z count as a-z. A text of fewer words is one shingle; null texts and texts without words have an empty
    set and are linked with nothing. Every row is judged by its own text, whatever rows share its doc_id; repeated rows
    have equal results. `component` tells components apart (null: empty set), also where an id occurs in several. A null
    doc_id is no one's smallest; a component of such rows alone has component_id null and they are kept. Very long texts
    are read whole. Other columns are ignored. An empty table gives no rows. A pair at the threshold is missed by all
    bands with a probability of 5e-8.
    """
    common.ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry)
    ids = ["doc_id", *carry]
    fields = [f for f in docs.schema if f.name in ids]
    made = common.save(docs.select(*ids, "text").mapInArrow(_features(width, ids), common.schema_with(
        fields, ("n", "long"), ("k1", "long"), ("k2", "long"), ("bands", "array<long>"), ("odd", "array<long>"))))
    # (k1, k2, n) identify a set; from here on a class of equal sets is one node, called by a number of its own.
    classes = made.filter("n > 0").groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct("bands", "odd")).alias("s"))
    reps = common.save(classes.select("k1", "k2", "n", "doc_id", "s.bands", "s.odd", F.monotonically_increasing_id().alias("cid")), free=True)
    bands = reps.select("cid", F.posexplode("bands").alias("nth", "band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    live = common.save(bands.join(shared, "band"), free=True)
    asked = reps.join(live.select("cid").distinct(), "cid", "left_semi").select("cid", "n", "k1", "k2", F.col("doc_id").alias("d"))
    # The sets of one text of each class, found by its smallest id; other texts of that id fall out by their digests.
    texts = docs.select("doc_id", "text").join(asked.select("d").distinct(), F.col("doc_id").eqNullSafe(F.col("d")), "left_semi").select("text")
    found = texts.mapInArrow(_sets_only(width), "n long, k1 long, k2 long, items binary").dropDuplicates(["n", "k1", "k2"])
    items = common.save(found.join(asked, ["n", "k1", "k2"]).select("cid", "items"), free=True)
    met = live.groupBy("cid").agg(F.sum("size").alias("met"))
    hubs = live.join(met, "cid").groupBy("band").agg(F.max_by("cid", F.struct("met", -F.col("cid"))).alias("hub"))
    tried = (live.join(hubs, "band").filter("cid != hub").groupBy("cid", "hub").count()
             .groupBy("cid").agg(F.max_by("hub", F.struct("count", -F.col("hub"))).alias("hub")))
    odd = reps.select("cid", "odd")
    x, y = odd.alias("x"), odd.alias("y")
    near = tried.join(x, tried.cid == F.col("x.cid")).join(y, (tried.hub == F.col("y.cid")) & _close(percent)).select(
        tried.cid.alias("a"), F.col("hub").alias("b"))
    first = _verify(common.save(near, free=True), items, percent)
    links = first.filter("linked").select("a", "b")
    comp = common.components(links)
    placed = live.select("band", "nth", "cid").join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    parts = placed.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("band").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("comp", F.struct("size", -F.col("comp"))).alias("main")).filter("parts > 1").select("band", "main")
    # How a text differs from its hub; a hub is its own.
    deltas = first.select(F.col("a").alias("cid"), F.col("b").alias("hub"), "delta").join(first.select(F.col("b").alias("cid")), "cid", "left_anti").union(
        first.select(F.col("b").alias("cid")).distinct().select("cid", F.col("cid").alias("hub"), F.array().cast("array<long>").alias("delta")))
    facts = reps.select("cid", "n", "odd", F.col("bands").alias("all")).join(deltas, "cid", "left")
    rest = placed.join(parts, "band").join(facts, "cid").withColumn("before", F.slice("all", F.lit(1), F.col("nth"))).drop("all")
    rest = common.save(rest, free=True)
    x, y = rest.filter("comp != main").alias("x"), rest.alias("y")
    # A pair meets in the first band it shares only; none is before the first.
    earlier = F.exists(F.zip_with("x.before", "y.before", lambda a, b: a.eqNullSafe(b)), lambda same: same)
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.cid") < F.col("y.cid"))
    total = F.col("x.n") + F.col("y.n")
    apart = F.size("x.delta") + F.size("y.delta") - 2 * F.size(F.array_intersect("x.delta", "y.delta"))
    known = (F.col("x.hub") == F.col("y.hub")) & F.col("x.delta").isNotNull() & F.col("y.delta").isNotNull()
    room = F.when(F.coalesce(known, F.lit(False)), (total - apart) * 100 >= (total + apart) * percent).otherwise(True)
    # Sizes alone rule most pairs of unlike texts out before their sketches are compared.
    sized = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp")) & once & sized & ~earlier & _close(percent) & room).select(
        F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    second = _verify(common.save(near, free=True), items, percent)
    old, comp = comp, common.components(links.union(second.filter("linked").select("a", "b")))
    for t in (rest, live, items, first, second, old):
        common.drop(t)
    read = [made, reps, comp]
    comp = comp.withColumnRenamed("node", "cid")
    least = reps.select("cid", "doc_id").join(comp, "cid").groupBy("comp").agg(F.min("doc_id").alias("least"))
    linked = comp.join(least, "comp").select("cid", "comp", "least")
    final = reps.select("k1", "k2", F.col("n").alias("rn"), "doc_id", "cid").join(linked, "cid", "left").select(
        "k1", "k2", "rn", F.coalesce("comp", "cid").alias("component"), F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("least"))
    m, f = made.select(*ids, "n", "k1", "k2").alias("m"), final.alias("f")
    both = m.join(f, (F.col("m.k1") == F.col("f.k1")) & (F.col("m.k2") == F.col("f.k2")) & (F.col("m.n") == F.col("f.rn")), "left")
    both = both.withColumn("_least", F.when(F.col("f.component").isNull(), F.col("m.doc_id")).otherwise(F.col("f.least")))
    out = both.select(*[F.col(f"m.`{c}`") for c in ids], F.col("m.n").alias("n_shingles"), F.col("_least").alias("component_id"),
                      F.col("_least").eqNullSafe(F.col("m.doc_id")).alias("kept"), F.col("f.component").alias("component"))
    out._reads = read  # for a caller that saves the result, and can drop them then
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2 over documents: two-word shingles, similarity 0.8."""
    return near_duplicates(common.documents(spark, sf_dir).select("doc_id", "text"), 2, 80).drop("component")
