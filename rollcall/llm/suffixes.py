"""Exact-substring removal: every byte covered by a LENGTH-byte string that also starts in an earlier document goes.

A suffix-sorting design over a cover of sampled positions. An arithmetic difference cover (every position whose residue
is in a small set) samples a fixed share of all suffixes: 2/3 for triples, 5/21 for the cover of 21. Here the cover is
chosen by content, which is far sparser and keeps its defining property: two equal LENGTH-byte strings hold a sampled
position at the same offset. A position is sampled if the hash of its GRAM-byte tuple is the least of some
LENGTH - GRAM + 1 consecutive ones.

1. The sampled tuples are dealt out by name (the tuple's hash), packed by the thousand, and sorted; names that occur in
   one document only are discarded.
2. Names are refined once: by the whole context that a LENGTH-byte string around the sample can reach, so equal refined
   names mean equal context. Within such a class all but the earliest document lose the context.
3. The remaining suffixes, those starting up to LENGTH - GRAM bytes before a sample, are merged in by their offset to it:
   where a name has several classes, the prefixes of each class's suffixes are sorted and compared with their neighbours.

Names are independent of each other, so a large input is worked on in slices of the names, one after the other: what is on
disk at once is a slice's share. Of a class a task sends only its earliest document, the others have lost already, so no
class is hot; the classes of a hot name are dealt out by their contexts. What a task holds besides is bounded by a document.
Equal contexts are told by 128 bits (name and context), whole copies by 128 bits of their SHA-256 (those within a task by
the 64 bits of tid), prefixes by 64 bits among the contexts of one name.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LENGTH = 50
GRAM = 20
SPAN = LENGTH - GRAM + 1  # consecutive tuples of which one is sampled; also the suffixes that share a sample
BACK = LENGTH - GRAM  # bytes before a sample that its context holds
BLOCK = 1 << 17  # rows of a batch that leaves a task
CHUNK = 1 << 20  # samples that a task packs at once
SLICES = 2  # of the names, for texts of LARGE bytes in all
LARGE = 1 << 26
BUCKET = 1 << 23  # bytes of text whose samples a task sorts at once, at most
SHARE = 32  # one of so many texts tells which names are hot
LIGHT = 1 << 12  # samples of a name that never make it hot
HOT = 1 << 15  # classes of one name beyond which its suffixes are compared by a grouped job instead of within a task


def _slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over every w consecutive entries, in log w passes."""
    cur = 1
    while cur * 2 <= w:
        a = f(a[:-cur], a[cur:])
        cur *= 2
    return f(a[: -(w - cur)], a[w - cur:]) if cur < w else a


def sample(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, position in it, name, context) of the sampled positions of concatenated rows."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(data) < LENGTH:
        return none
    prefix = common.Prefix(data)
    h = prefix.grams(GRAM)
    least = _slide(h, SPAN, np.minimum)
    edge = np.zeros(SPAN - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), SPAN, np.maximum) == h)
    row = np.searchsorted(off, at, "right") - 1
    inside = (at + GRAM <= off[row + 1]) & (off[row + 1] - off[row] >= LENGTH)
    at, row = at[inside], row[inside]
    lo, hi = np.maximum(at - BACK, off[row]), np.minimum(at + LENGTH, off[row + 1])
    context = common.mix(prefix.raw(lo, hi) + ((at - lo) * 128 + (hi - at)).astype(np.uint64) * np.uint64(0x5851F42D4C957F2D))
    return row, at - off[row], h[at], context


_SAMPLES = "kind int, name long, context long, tid long, doc_id long, pos int"
LATER, FIRST, SHOWN = 0, 1, 2  # kinds of samples: of a later document than the first of its class; of the first; the one whose bytes are looked at


def _slices(n_bytes: int) -> int:
    return SLICES if n_bytes >= LARGE else 1


def _texts(batches):
    """(tid, doc_id, samples) of pieces of the rows. Of copies in a task those after an earlier doc_id are left out."""
    seen: dict[int, int] = {}
    for batch in batches:
        for part in common.pieces(batch, most=1 << 19):
            tid, doc = np.asarray(part.column("tid")), np.asarray(part.column("doc_id"))
            new = np.zeros(len(tid), dtype=bool)
            for i, (t, d) in enumerate(zip(tid.tolist(), doc.tolist(), strict=True)):
                if d < seen.get(t, d + 1):
                    seen[t], new[i] = d, True
            if len(seen) > CHUNK:
                seen.clear()
            if not new.all():
                part, tid, doc = part.filter(pa.array(new)), tid[new], doc[new]
            yield tid, doc, sample(*common.utf8(part.column("text")))


def _planes(a: np.ndarray) -> bytes:
    """The entries' first bytes, then their second ones, and so on, which compress well."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


_PACKED = (("name", np.uint64), ("context", np.uint64), ("tid", np.int64), ("doc_id", np.int64), ("pos", np.int32))
_WIDTH = sum(np.dtype(t).itemsize for _, t in _PACKED)


def _pack(cols) -> bytes:
    return b"".join([c.tobytes() for c in cols[:3]] + [_planes(c) for c in cols[3:]])


def _unpack(blob: bytes) -> list[np.ndarray]:
    n, at, out = len(blob) // _WIDTH, 0, []
    for i, (_, kind) in enumerate(_PACKED):
        w = np.dtype(kind).itemsize
        raw = np.frombuffer(blob, np.uint8, n * w, at)
        out.append((raw if i < 3 else np.ascontiguousarray(raw.reshape(w, n).T)).reshape(-1).view(kind))
        at += n * w
    return out


def _among(a: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(a), dtype=bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, a), len(sorted_) - 1)] == a


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    new = np.ones(len(cols[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return np.flatnonzero(new)


def _spread(per_run: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(per_run, np.diff(np.r_[start, n]))


def _sampled(k: int, slices: int, parts: int, hot: np.ndarray):
    """Samples of the k-th slice of the names, packed by the part that sorts them. later: they belong to a later document
    than another one of their class in this task."""
    def packed(held):
        cols = [np.concatenate(c) for c in zip(*held, strict=True)]
        name, context, tid, doc, _ = cols
        order = np.argsort(name * np.uint64(0x9E3779B97F4A7C15) + context)
        start = _starts(name[order], context[order])
        later = np.zeros(len(name), dtype=bool)
        later[order] = doc[order] > _spread(np.minimum.reduceat(doc[order], start), start, len(name))
        part = name // np.uint64(slices) % np.uint64(parts)
        spread = _among(name, hot)
        part[spread] = common.mix(name[spread] + context[spread] * np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)
        part[later] = tid[later].view(np.uint64) % np.uint64(parts)
        part = part.astype(np.int64) * 2 + later
        order = np.argsort(part, kind="stable")
        cols = [c[order] for c in cols]
        start = _starts(part[order])
        made, n = [], 0
        for p, lo, hi in zip(part[order][start].tolist(), start.tolist(), [*start[1:].tolist(), len(order)], strict=True):
            made.append((p // 2, bool(p % 2), _pack([c[lo:hi] for c in cols])))
            n += hi - lo
            if n >= BLOCK or hi == len(order):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.int32(), pa.bool_(), pa.binary()), strict=True)],
                                                 names=["part", "later", "samples"])
                made, n = [], 0

    def run(batches):
        held, n = [], 0
        for tid, doc, (row, pos, name, context) in _texts(batches):
            mine = name % np.uint64(slices) == k
            row = row[mine]
            if len(row):
                held.append((name[mine], context[mine], tid[row], doc[row], pos[mine].astype(np.int32)))
                n += len(row)
            if n >= CHUNK:
                yield from packed(held)
                held, n = [], 0
        if held:
            yield from packed(held)

    return run


def _counted(batches):
    """How often each name occurs in each text."""
    for tid, _, (row, _, name, _) in _texts(batches):
        order = np.lexsort((name, row))
        row, name = row[order], name[order]
        start = _starts(row, name)
        yield pa.RecordBatch.from_arrays([pa.array(name[start].view(np.int64)), pa.array(tid[row[start]]), pa.array(np.diff(np.r_[start, len(row)]).astype(np.int64))],
                                         names=["name", "tid", "n"])


def _repeated(hot: np.ndarray):
    """Packed samples of whole names (of hot ones, of whole classes) -> those of classes with a later document, and, where
    classes of one name have different first documents, those of the first documents; one of each class is shown."""
    def batches_of(kind, cols):
        for lo in range(0, len(kind), BLOCK):
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c[lo: lo + BLOCK]).view(t)) for c, t in zip([kind, *cols], (np.int32, *[np.int64] * 4, np.int32), strict=True)],
                                             names=["kind", *(n for n, _ in _PACKED)])

    def lost(cols):
        """A text's samples lie together; what they were named doesn't matter any more."""
        order = np.argsort(cols[2], kind="stable")
        none = np.zeros(len(order), np.uint64)
        return batches_of(np.full(len(order), LATER, np.int32), [none, none, *(c[order] for c in cols[2:])])

    def run(batches):
        held, gone, n = [], [], 0
        for batch in batches:
            for later, samples in zip(batch.column("later").to_pylist(), batch.column("samples").to_pylist(), strict=True):
                cols = _unpack(samples)
                if not later:
                    held.append(cols)
                    continue
                gone.append(cols)
                n += len(cols[0])
                if n >= CHUNK:
                    yield from lost([np.concatenate(c) for c in zip(*gone, strict=True)])
                    gone, n = [], 0
        if held:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held = None
            order = np.argsort(cols[0])
            name, doc = cols[0][order], cols[3][order]
            start = _starts(name)
            wanted = (np.minimum.reduceat(doc, start) < np.maximum.reduceat(doc, start)) | _among(name[start], hot)
            order = order[_spread(wanted, start, len(order))]
            cols = [c[order] for c in cols]
            order = np.lexsort((cols[2], cols[4], cols[3], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            name, context, tid, doc, _ = cols
            n = len(name)
            if n:
                start = _starts(name, context)  # of classes, each led by its first document
                first, text = _spread(doc[start], start, n), _spread(tid[start], start, n)
                run_of = _starts(name)
                several = _spread((np.minimum.reduceat(first, run_of) < np.maximum.reduceat(first, run_of)) | _among(name[run_of], hot), run_of, n)
                kind = np.full(n, FIRST, np.int32)
                kind[start] = SHOWN
                later, stays = (doc > first) & (tid != text), (doc == first) & several  # copies of the first's text go as a whole
                yield from batches_of(kind[stays], [c[stays] for c in cols])
                gone.append([c[later] for c in cols])
        if gone:
            yield from lost([np.concatenate(c) for c in zip(*gone, strict=True)])

    return run


_CONTEXT = ("name", "context", "doc_id", "before", "after", "body")


def _contexts(batches):
    """doc_id, text, at: [(name, context, pos)] -> the bytes around each position, and how many lie before and from it."""
    for batch in batches:
        for part in common.pieces(batch, most=1 << 19):
            doc, name, context, before, after, body = [], [], [], [], [], []
            for d, t, at in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("at").to_pylist(), strict=True):
                data = (t or "").encode("utf-8")
                for a in at:
                    p = a["pos"]
                    lo, hi = max(0, p - BACK), min(len(data), p + LENGTH)
                    doc.append(d)
                    name.append(a["name"])
                    context.append(a["context"])
                    before.append(p - lo)
                    after.append(hi - p)
                    body.append((b"\0" * (BACK - p + lo) + data[lo:hi]).ljust(BACK + LENGTH, b"\0"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(name, pa.int64()), pa.array(context, pa.int64()), pa.array(doc, pa.int64()), pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(body, pa.binary())],
                names=list(_CONTEXT))


def _prefix_keys(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, key) of every LENGTH-byte prefix of the suffixes that start at or before a sample."""
    n = len(part["name"])
    text = np.frombuffer(b"".join(part["body"]), np.uint8).reshape(n, BACK + LENGTH)
    p, q = common._powers(BACK + LENGTH + 1)
    s = np.zeros((n, BACK + LENGTH + 1), np.uint64)
    np.cumsum(common._TABLE[text] * p[None, : BACK + LENGTH], axis=1, out=s[:, 1:])
    raw = (s[:, LENGTH: LENGTH + SPAN] - s[:, :SPAN]) * q[None, :SPAN]
    o = np.arange(SPAN)
    fits = (o[None, :] >= BACK - part["before"][:, None]) & (o[None, :] + GRAM <= part["after"][:, None])
    row, at = np.nonzero(fits)
    return row, at, common.mix(raw[row, at] + part["name"].view(np.uint64)[row] * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64))


def _covered(part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) offset of the prefixes that rows of whole names share with earlier documents, by comparing
    neighbours in sorted order. The strings at the offsets between them overlap, so one interval holds them all."""
    row, at, key = _prefix_keys(part)
    order = np.argsort(key, kind="stable")
    k = key[order]
    doc = part["doc_id"][row[order]]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(doc, start), np.diff(np.r_[start, len(k)])) if len(k) else doc
    hit = order[least < doc]
    row, at = row[hit], at[hit]
    lo, hi = np.full(len(part["name"]), SPAN), np.full(len(part["name"]), -1)
    np.minimum.at(lo, row, at)
    np.maximum.at(hi, row, at)
    lost = np.flatnonzero(hi >= 0)
    return lost, lo[lost], hi[lost]


def _columns(batch: pa.RecordBatch) -> list:
    return [np.asarray(batch.column(c)) if c != "body" else np.array(batch.column(c).to_pylist(), dtype=object) for c in _CONTEXT]


def _merge(batches):
    """Contexts sorted by name -> first and last shared offset of each that has one; whole names at a time."""
    def give(cols):
        row, lo, hi = _covered(dict(zip(_CONTEXT, cols, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(cols[0][row]), pa.array(cols[1][row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                                          names=["name", "context", "lo", "hi"])

    held, n = [], 0
    for batch in batches:
        held.append(_columns(batch))
        n += batch.num_rows
        if n >= 1 << 14:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], "left"))
            if cut:
                yield give([c[:cut] for c in cols])
            held, n = [[c[cut:] for c in cols]], len(cols[0]) - cut
    if n:
        yield give([np.concatenate(c) for c in zip(*held, strict=True)])


def _explode(batches):
    """Contexts of hot names -> one row a prefix."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = dict(zip(_CONTEXT, _columns(batch.slice(lo, 4096)), strict=True))
            row, at, key = _prefix_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(part["doc_id"][row]), pa.array(part["name"][row]), pa.array(part["context"][row]), pa.array(at.astype(np.int32))],
                                             names=["key", "doc_id", "name", "context", "at"])


def spans_of(n: int, lo: list, hi: list) -> list[tuple[int, int]]:
    """Maximal runs of the intervals, cut to [0, n); those shorter than LENGTH after the cut don't count."""
    a, b = np.maximum(np.asarray(lo, np.int64), 0), np.minimum(np.asarray(hi, np.int64), n)
    whole = b - a >= LENGTH
    a, b = a[whole], b[whole]
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    start = np.r_[True, a[1:] > b[:-1]]
    return list(zip(a[start].tolist(), b[np.r_[np.flatnonzero(start)[1:] - 1, len(b) - 1]].tolist(), strict=True))


def known(docs: DataFrame, text: str = "text", doc: str = "doc_id", tid: str = "tid") -> DataFrame:
    """docs with tid, a 64-bit hash of the text: (doc, tid) stands for the rows of an id that have one text."""
    return docs.withColumn(tid, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))


def _hot_names(docs: DataFrame, limit: int) -> np.ndarray:
    """Names of several texts that, going by one of SHARE texts, have more samples than the limit. They are few: together
    they can't have more than all samples. Only where samples are sorted hangs on them."""
    counts = docs.filter(F.pmod("tid", F.lit(SHARE)) == 0).mapInArrow(_counted, "name long, tid long, n long")
    names = (counts.groupBy("name", "tid").agg(F.max("n").alias("n")).groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
             .filter((F.col("n") * SHARE > limit) & (F.col("texts") > 1)).select("name").collect())
    return np.sort(np.array([r["name"] for r in names], np.int64).view(np.uint64))


def _slice(docs: DataFrame, once: DataFrame, k: int, slices: int, parts: int, hot: np.ndarray) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, tid, lo, hi) that texts lose by the k-th slice of the names, and the scratch tables that it reads."""
    spark = docs.sparkSession
    packed = docs.mapInArrow(_sampled(k, slices, parts, hot), "part int, later boolean, samples binary")
    found = common.save(packed.repartitionById(parts, "part").mapInArrow(_repeated(hot), _SAMPLES), free=True)
    asked = found.filter(F.col("kind") == SHOWN).groupBy("doc_id", "tid").agg(F.collect_list(F.struct("name", "context", "pos")).alias("at"))  # bounded by the document
    around = common.save(once.join(asked, ["doc_id", "tid"]).select("doc_id", "text", "at").mapInArrow(
        _contexts, "name long, context long, doc_id long, before int, after int, body binary"), free=True)
    # Written, so that joins with it are plain joins of shuffles, which Spark can split where a name is hot.
    many = common.save(around.groupBy("name").agg(F.count(F.lit(1)).alias("classes")).filter(F.col("classes") > HOT).select("name"))
    cold = around.join(many, "name", "left_anti").select(*_CONTEXT)
    by_prefix = cold.repartition(common.partitions(spark) * 2, "name").sortWithinPartitions("name").mapInArrow(_merge, "name long, context long, lo int, hi int")
    keyed = around.join(many, "name", "left_semi").select(*_CONTEXT).mapInArrow(_explode, "key long, doc_id long, name long, context long, at int")
    least = keyed.groupBy("name", "key").agg(F.min("doc_id").alias("least"))
    by_hot = keyed.join(least, ["name", "key"]).filter("least < doc_id").groupBy("name", "context").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    shared = common.save(by_prefix.unionByName(by_hot), free=True)
    common.drop(around)
    common.drop(many)
    back = F.col("pos") - BACK
    firsts = common.save(found.filter(F.col("kind") != LATER).join(shared, ["name", "context"]).select(
        "doc_id", "tid", (back + F.col("lo")).alias("lo"), (back + LENGTH + F.col("hi")).alias("hi")), free=True)
    common.drop(shared)
    lost = found.filter(F.col("kind") == LATER).select("doc_id", "tid", back.alias("lo"), (back + LENGTH + BACK).alias("hi")).unionByName(firsts)
    return lost, [found, firsts]


def _merged(batches):
    """Intervals of each text -> their maximal runs. Within their text they have LENGTH bytes and more, so its end doesn't matter yet."""
    for batch in batches:
        runs = [spans_of(1 << 40, lo, hi) for lo, hi in zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist(), strict=True)]
        ends = [pa.array([[r[i] for r in x] for x in runs], pa.list_(pa.int64())) for i in range(2)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), *ends], names=["doc_id", "tid", "lo", "hi"])


def intervals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id (not null), text, tid -> (doc_id, tid, lo, hi) with the ends of the runs that texts lose, not yet cut to
    the text; and the (doc_id, tid) whose text an earlier document has as a whole."""
    spark = docs.sparkSession
    slim = common.save(docs.select("doc_id", "tid", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"),
                                   F.substring(F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)), 1, 16).alias("sha")))
    firsts = slim.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = slim.join(firsts, "sha").filter("doc_id > first").select("doc_id", "tid").distinct()
    # Where rows are repeated as a whole, one of them shows the bytes around samples.
    repeated = slim.groupBy("doc_id", "tid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
    docs = docs.filter(F.octet_length("text") >= LENGTH)
    once = docs.dropDuplicates(["doc_id", "tid"]) if repeated else docs
    n = slim.agg(F.sum("n")).first()[0] or 0
    slices = _slices(n)
    parts = max(common.partitions(spark), -(-n // (slices * BUCKET)))
    hot = _hot_names(docs, max(LIGHT, n // (64 * slices * parts))) if n >= LARGE else np.zeros(0, np.uint64)
    lost, tables = zip(*[_slice(docs, once, k, slices, parts, hot) for k in range(slices)], strict=True)
    lists = reduce(DataFrame.unionByName, lost).groupBy("doc_id", "tid").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))  # bounded by the document
    out = common.save(lists.mapInArrow(_merged, "doc_id long, tid long, lo array<long>, hi array<long>"), free=True)
    for t in sum(tables, []):
        common.drop(t)
    return out, copies


def _cut(kept: list[str], text: str, marks: list[str], what: str):
    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, text):
                n, gone, spans, sha, texts = [], [], [], [], []
                cols = [part.column(c).to_pylist() for c in (text, *marks)]
                for t, lo, hi, copy in zip(*cols, strict=True):
                    data = (t or "").encode("utf-8")
                    runs = ([(0, len(data))] if copy and len(data) >= LENGTH else spans_of(len(data), lo or [], hi or []))
                    at, left = 0, []
                    for a, b in runs:
                        left.append(data[at:a])
                        at = b
                    left = b"".join([*left, data[at:]])
                    n.append(len(data))
                    gone.append(len(data) - len(left))
                    spans.append(len(runs))
                    if what == "digest":
                        sha.append(hashlib.sha256(left).hexdigest())
                    else:  # a character that lost some of its bytes goes as a whole
                        texts.append(None if t is None else left.decode("utf-8", "ignore") if runs else t)
                extra = [pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64())]
                last = pa.array(sha, pa.string()) if what == "digest" else pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + extra + [last], names=[*kept, "n_bytes", "n_removed", "n_spans", "kept_sha256" if what == "digest" else "kept_text"])

    return run


def remove_repeats(docs: DataFrame, what: str = "text") -> DataFrame:
    """docs (doc_id, text and any other columns) with n_bytes, n_removed, n_spans and kept_text, or for what="digest"
    kept_sha256 of the remaining bytes.

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id; texts are
    UTF-8 (null: empty) and are judged as they came in. Texts shorter than LENGTH bytes stay. Rows of one doc_id take
    nothing from each other, and each loses only what its own text shares with smaller ids; rows with a null doc_id count
    as one document after all others. Repetition within a document takes nothing. Repeated rows have equal results.
    Other columns stay, but for those with the names of results, which are replaced; an empty table stays empty.
    """
    common.ready(docs.sparkSession)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")
    doc, tid, lo, hi, copy = (common.free_name(docs, f"_{c}") for c in ("doc", "tid", "lo", "hi", "copy"))
    keyed = known(docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))), tid=tid)
    lost, copies = intervals(keyed.select(F.col(doc).alias("doc_id"), "text", F.col(tid).alias("tid")))
    found = lost.join(copies.withColumn("copy", F.lit(True)), ["doc_id", "tid"], "full_outer").select(
        F.col("doc_id").alias(doc), F.col("tid").alias(tid), F.col("lo").alias(lo), F.col("hi").alias(hi), F.col("copy").alias(copy))
    kept = [c for c in docs.columns if c != "text" or what != "digest"]
    last = "kept_sha256" if what == "digest" else "kept_text"
    schema = common.schema_with([f for f in docs.schema if f.name in kept], ("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), (last, "string"))
    marked = keyed.join(found, [doc, tid], "left").select(*[common.column(c) for c in docs.columns], lo, hi, copy)
    return marked.mapInArrow(_cut(kept, "text", [lo, hi, copy], what), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 over documents."""
    return remove_repeats(common.documents(spark, sf_dir).select("doc_id", "text"), "digest").select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
