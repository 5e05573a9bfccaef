"""The trie of conversations' beginnings, with totals over subtrees by time-forward processing.

Nodes are sorted by reverse level order (an external sort of Spark's); a node's totals are sent forward to its parent through
a priority queue that spills, so that whoever reads the nodes in order finds what a node's children sent at the queue's head.
This runs at once in shards, ranges of (conv_id, depth): a node is named by its smallest member and its depth, a member's
own nodes are a chain, and a chain's upper end hangs on a chain of a smaller conv_id, so totals only leave a shard for
earlier ones. What leaves a shard for the same node is one bundle. Bundles form a small tree over the shards; their totals
are summed up by doubling the distance they are sent, in as many rounds as the tree's depth has binary digits. A second
run of the shards then adds what their nodes get from outside.

Steps of a conversation are digested with their depth into 128 bits, and a beginning's name is the exclusive or of its
steps. Running values are formed in segments of SEGMENT steps, so that no conversation has to fit a task.
"""

from __future__ import annotations

import hashlib
import pickle
import tempfile
from heapq import heappop, heappush, merge

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SEGMENT = 256  # steps of a conversation whose running values are formed in one place
SHARD = 250_000  # nodes of a shard
QUEUE = 100_000  # messages a queue holds in memory
CHUNK = 4096  # identifiers joined into one string
SALTS = 16  # parts of the nodes that hang on the same node

c = F.col


# ---------------------------------------------------------------- time-forward processing in a shard

class Queue:
    """Messages (key, leaves, saved), taken out by rising key; those of one key are added up. Beyond `most` of them, sorted
    runs go to a temporary file that vanishes with the queue."""

    def __init__(self, most: int = QUEUE):
        self.most, self.heap, self.runs, self.file = most, [], [], None

    def push(self, key: tuple, leaves: int, saved: int) -> None:
        heappush(self.heap, (key, leaves, saved))
        if len(self.heap) > self.most:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.heap.sort()
        start = self.file.seek(0, 2)
        for lo in range(0, len(self.heap), 1000):
            pickle.dump(self.heap[lo: lo + 1000], self.file)
        run = self._read(self.file, start, self.file.tell())
        self.heap = []
        self.runs.append([next(run), run])
        self.runs.sort(key=_head)
        if len(self.runs) > 64:  # many short runs become one
            all_runs, self.runs = self.runs, []
            self._rewrite(merge(*[_chain(r) for r in all_runs]))

    def _rewrite(self, messages) -> None:
        old, self.file = self.file, tempfile.TemporaryFile()
        part, n = [], 0
        for m in messages:
            if part and part[-1][0] == m[0]:
                part[-1] = (m[0], part[-1][1] + m[1], part[-1][2] + m[2])
                continue
            if len(part) == 1000:
                pickle.dump(part, self.file)
                part = []
            part.append(m)
            n += 1
        if part:
            pickle.dump(part, self.file)
        old.close()
        run = self._read(self.file, 0, self.file.tell())
        self.runs = [[next(run), run]] if n else []

    @staticmethod
    def _read(file, at: int, end: int):
        while at < end:
            file.seek(at)
            part = pickle.load(file)
            at = file.tell()
            yield from part

    def take(self, key: tuple) -> tuple[int, int]:
        """The sums of all messages with this key, the least there is."""
        leaves = saved = 0
        while self.heap and self.heap[0][0] == key:
            _, a, b = heappop(self.heap)
            leaves, saved = leaves + a, saved + b
        while self.runs and self.runs[0][0][0] == key:
            head, run = self.runs[0]
            leaves, saved = leaves + head[1], saved + head[2]
            following = next(run, None)
            if following is None:
                self.runs.pop(0)
            else:
                self.runs[0][0] = following
            self.runs.sort(key=_head)
        return leaves, saved

    def close(self) -> None:
        if self.file:
            self.file.close()


def _head(run):
    return run[0]


def _chain(run):
    yield run[0]
    yield from run[1]


_FLAT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, ends_sha256 string"
_BUNDLE = "shard int, conv long, top long, bottom long, target_conv long, target_depth long, leaves long, saved long"
_TOTALS = f"{_FLAT}, n_leaves long, saved_tokens long"
_PA = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    names, types = zip(*[f.split() for f in ddl.split(", ")], strict=True)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, _PA[t]) for x, t in zip(cols, types, strict=True)], names=list(names))


def _forward(totals: bool):
    """Rows of whole shards, each by falling depth and then rising conv_id -> every node with its totals, or else what
    leaves each shard (bundles: conv null) and which of its chains hang together (conv, top, bottom: the bundle's target)."""
    def run(batches):
        shard, queue, out, outside, chains = None, None, [], {}, {}

        def end():
            """In order of their tops: a chain hangs on one whose top is higher, or its shard's outside."""
            queue.close()
            if not totals:
                to = {}
                for conv, (top, bottom, parent, inside) in sorted(chains.items(), key=lambda x: x[1][0]):
                    to[conv] = to[parent] if inside else (parent, None if parent is None else top - 1)
                    out.append((shard, conv, top, bottom, *to[conv], None, None))
                out.extend((shard, None, None, None, *t, a, b) for t, (a, b) in outside.items())

        for batch in batches:
            for r in batch.to_pylist():
                if r["shard"] != shard:
                    if queue:
                        end()
                    shard, queue, outside, chains = r["shard"], Queue(), {}, {}
                conv, depth, parent = r["conv_id"], r["depth"], r["parent_conv_id"]
                leaves, saved = queue.take((-depth, conv))
                leaves, saved = leaves + r["leaves"], saved + r["saved"]
                if r["inside"]:
                    queue.push((1 - depth, parent), leaves, saved)
                elif not totals:
                    at = (parent, None if parent is None else depth - 1)
                    a, b = outside.get(at, (0, 0))
                    outside[at] = (a + leaves, b + saved)
                if totals:
                    out.append((conv, depth, parent, r["n_convs"], r["n_children"], r["ends_sha256"], leaves, saved))
                else:
                    chains[conv] = (depth, chains[conv][1] if conv in chains else depth, parent, r["inside"])
            if len(out) >= 1000:
                yield _batch(out, _TOTALS if totals else _BUNDLE)
                out = []
        if queue:
            end()
        if out:
            yield _batch(out, _TOTALS if totals else _BUNDLE)

    return run


# ---------------------------------------------------------------- members of the nodes

def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), e1, e2 (digests of role and text), chars: the turns of each conversation in order."""
    text = lambda x: F.coalesce(c(x).cast("string"), F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        c("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).withColumn("_row", F.monotonically_increasing_id())
    placed = common.ranked(rows, ["conv_id"], ["turn", "role", "text", "_row"], "pos")
    return common.save(placed.select("conv_id", "pos", F.xxhash64("role", "text").alias("e1"), F.xxhash64(F.lit("second"), "text", "role").alias("e2"),
                                     F.length("text").cast("long").alias("chars")))


def rebuilt(turns: DataFrame, group: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(steps, conversations): conversation c as the first h turns of conversation c - c % group, then its own turns after
    its first h, with h = crc32(c) % kinds; all turns there are, if fewer, and none of a conversation that isn't there.

    steps: conv_id, depth (from 1), e1, e2, chars; conversations: conv_id. Every conversation has at most kinds - 1 turns of
    another; its own are matched in segments, however many it has.
    """
    h = F.pmod(F.crc32(c("conv_id").cast("string").cast("binary")), F.lit(kinds)).cast("long")
    source = c("conv_id") - c("conv_id") % group
    convs = common.save(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")))
    firsts = turns.filter((c("conv_id") % group == 0) & (c("pos") < kinds - 1)).groupBy(c("conv_id").alias("source")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "e1", "e2", "chars"))).alias("firsts"))
    shaped = common.save(convs.select("conv_id", "n", h.alias("h"), source.alias("source")).join(firsts, "source", "left").select(
        "conv_id", "n", "h", F.slice(F.coalesce("firsts", F.array()), F.lit(1), c("h").cast("int")).alias("firsts")))
    lent = shaped.select("conv_id", F.inline("firsts")).select("conv_id", (c("pos") + 1).alias("depth"), "e1", "e2", "chars")
    spans = shaped.select("conv_id", F.size("firsts").cast("long").alias("k"), F.explode(F.sequence(F.lit(0), F.floor((c("n") - 1) / SEGMENT))).alias("seg"))
    own = turns.withColumn("h", h).filter("pos >= h").withColumn("seg", F.floor(c("pos") / SEGMENT)).join(spans, ["conv_id", "seg"])
    own = own.select("conv_id", (c("k") + c("pos") - c("h") + 1).alias("depth"), "e1", "e2", "chars")
    return lent.unionByName(own), convs.select("conv_id")


def members(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, depth (from 0), x1, x2 (the name of its beginning of so many steps), p1, p2 (of one step less), chars."""
    seg = F.floor(c("depth") / SEGMENT)
    items = common.save(steps.select("conv_id", "depth", seg.alias("seg"), F.xxhash64("depth", "e1", "e2").alias("i1"), F.xxhash64("e2", "e1", "depth").alias("i2"), "chars"))
    sums = items.groupBy("conv_id", "seg").agg(F.bit_xor("i1").alias("s1"), F.bit_xor("i2").alias("s2"))
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "seg", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(b) for s, b in (("s1", "b1"), ("s2", "b2"))])
    running = Window.partitionBy("conv_id", "seg").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda b, i: c(b).bitwiseXOR(F.bit_xor(i).over(running))
    rows = items.join(sums, ["conv_id", "seg"]).select("conv_id", "depth", name("b1", "i1").alias("x1"), name("b2", "i2").alias("x2"), "i1", "i2", "chars")
    rows = rows.select("conv_id", "depth", "x1", "x2", c("x1").bitwiseXOR(c("i1")).alias("p1"), c("x2").bitwiseXOR(c("i2")).alias("p2"), "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    out = common.save(roots.unionByName(rows))
    common.drop(items)
    return out


# ---------------------------------------------------------------- digests of members' identifiers

def _joined(batches):
    """Rows by key and conv_id -> pieces of a key's identifiers, joined by commas."""
    key, first, ids = None, None, []
    for batch in batches:
        out = []
        for k1, k2, k3, conv in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if (k1, k2, k3) != key or len(ids) == CHUNK:
                if ids:
                    out.append((*key, first, ",".join(ids)))
                key, first, ids = (k1, k2, k3), conv, []
            ids.append(str(conv))
        if out:
            yield _batch(out, _PIECE)
    if ids:
        yield _batch([(*key, first, ",".join(ids))], _PIECE)


def _digests(batches):
    """Pieces by key and first conv_id -> the digest of each key's whole list."""
    key, digest = None, None
    for batch in batches:
        out = []
        for k1, k2, k3, _, ids in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
            if (k1, k2, k3) != key:
                if digest:
                    out.append((*key, digest.hexdigest()))
                key, digest = (k1, k2, k3), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield _batch(out, _DIGEST)
    if digest:
        yield _batch([(*key, digest.hexdigest())], _DIGEST)


_PIECE = "depth long, x1 long, x2 long, first long, ids string"
_DIGEST = "depth long, x1 long, x2 long, ends_sha256 string"


def ends(rows: DataFrame) -> DataFrame:
    """depth, x1, x2, ends_sha256 of the nodes at which conversations end. A node's identifiers are sorted over many tasks
    and joined there; only the joined pieces of one node meet, one at a time."""
    key = ["depth", "x1", "x2"]
    last = rows.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("last")).select("last.*", "conv_id")
    n = common.partitions(rows.sparkSession)
    pieces = last.repartitionByRange(n, *key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(_joined, _PIECE)
    return pieces.repartition(n, *key).sortWithinPartitions(*key, "first").mapInArrow(_digests, _DIGEST)


# ---------------------------------------------------------------- the trie

def trie(steps: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row a distinct beginning: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. steps: conv_id, depth (from 1, gapless), e1, e2 (digests), chars; conversations: conv_id.

    A shard holds, beside its queue, an entry for each of its chains in memory, SHARD or so at most.
    """
    spark = steps.sparkSession
    common.ready(spark, 2000)
    rows = members(steps, conversations)
    key = ["depth", "x1", "x2"]
    nodes = common.save(rows.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
                                               F.max("p1").alias("p1"), F.max("p2").alias("p2")).join(ends(rows), key, "left"))
    common.drop(rows)
    # The upper end of each chain looks its parent up; all other nodes hang on their own chain. Many ends may hang on one
    # node, so they find it in salted parts.
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")
    tops = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "p1", "p2")).alias("t")).filter("t.depth > 0").select(
        "conv_id", "t.depth", (c("t.depth") - 1).alias("above"), "t.p1", "t.p2", salt.alias("salt"))
    asked = tops.select("above", "p1", "p2", "salt").distinct()
    known = asked.join(nodes.select(c("depth").alias("above"), c("x1").alias("p1"), c("x2").alias("p2"), c("conv_id").alias("parent")), ["above", "p1", "p2"])
    tops = tops.join(known, ["above", "p1", "p2", "salt"]).select("conv_id", "depth", "parent")
    linked = nodes.join(tops, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", F.when(c("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", "chars", "ends_sha256")
    linked = common.save(linked)
    children = linked.filter("depth > 0").groupBy(c("parent_conv_id").alias("conv_id"), (c("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    n_children = F.coalesce("n_children", F.lit(0))
    whole = linked.join(children, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", n_children.alias("n_children"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.when(n_children == 0, 1).otherwise(0).cast("long").alias("leaves"), ((c("n_convs") - 1) * c("chars")).alias("saved"))
    n_shards = max(common.partitions(spark), linked.count() // SHARD + 1)
    flat = common.save(whole.repartitionByRange(n_shards, "conv_id", "depth").withColumn("shard", F.spark_partition_id()))
    common.drop(nodes)
    common.drop(linked)
    # One row a shard, of which there are as many as partitions.
    bounds = flat.groupBy("shard").agg(F.min(F.struct("conv_id", "depth")).alias("least"))
    inside = c("parent_conv_id").isNotNull() & (F.struct(c("parent_conv_id").alias("conv_id"), (c("depth") - 1).alias("depth")) >= c("least"))
    flat = flat.join(F.broadcast(bounds), "shard").withColumn("inside", inside).drop("least")

    def forward(nodes: DataFrame, totals: bool) -> DataFrame:
        laid = nodes.repartition(n_shards, "shard").sortWithinPartitions("shard", F.desc("depth"), "conv_id")
        return laid.mapInArrow(_forward(totals), _TOTALS if totals else _BUNDLE)

    found = common.save(forward(flat.select("shard", "conv_id", "depth", "parent_conv_id", "inside", "leaves", "saved"), False))
    bundles = _sum_up(found)
    sent = bundles.filter("target_conv is not null").groupBy(c("target_conv").alias("conv_id"), c("target_depth").alias("depth")).agg(
        F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    more = lambda a, b: (c(a) + F.coalesce(b, F.lit(0))).alias(a)
    full = flat.join(sent, ["conv_id", "depth"], "left").select(
        "shard", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "ends_sha256", "inside", more("leaves", "more_leaves"), more("saved", "more_saved"))
    return forward(full, True).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _sum_up(found: DataFrame) -> DataFrame:
    """target_conv, target_depth, leaves, saved of each bundle, with those of the bundles that hang on it, near or far.

    In round k a bundle that holds the sums of all within 2^k - 1 links below it sends them 2^k links up.
    """
    name = lambda shard, conv, depth: F.concat_ws("/", c(shard).cast("string"), F.coalesce(c(conv).cast("string"), F.lit("-")), F.coalesce(c(depth).cast("string"), F.lit("-")))
    own = found.filter("conv is null").select(name("shard", "target_conv", "target_depth").alias("id"), "target_conv", "target_depth", "leaves", "saved")
    chains = found.filter("conv is not null").select("conv", "top", "bottom", name("shard", "target_conv", "target_depth").alias("up"))
    on = (c("target_conv") == c("conv")) & (c("target_depth") >= c("top")) & (c("target_depth") <= c("bottom"))
    now = common.save(own.join(chains, on, "left").select("id", "target_conv", "target_depth", "leaves", "saved", "up"))
    while not now.filter("up is not null").isEmpty():
        sent = now.filter("up is not null").groupBy(c("up").alias("id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        beyond = now.select(c("id").alias("up"), c("up").alias("next"))
        step = now.join(sent, "id", "left").join(beyond, "up", "left").select(
            "id", "target_conv", "target_depth", *[(c(a) + F.coalesce(b, F.lit(0))).alias(a) for a, b in (("leaves", "l"), ("saved", "s"))], c("next").alias("up"))
        before, now = now, common.save(step)
        common.drop(before)
    return now


def prefix_trie(conversations: DataFrame, group: int = 100, kinds: int = 6) -> DataFrame:
    """The trie of the rebuilt conversations (see rebuilt()); conversations: conv_id, turn, role, text.

    Turns are in order of turn (null first), then of role and text; null role or text counts as empty, and repeated rows
    are turns of their own. Rows without a conv_id belong to no conversation. An empty table has no node, not even the
    root. Texts are digested whole. Columns of other names don't matter.
    """
    turns = numbered(conversations.select("conv_id", "turn", "role", "text"))
    return trie(*rebuilt(turns, group, kinds))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13 over conversations."""
    return prefix_trie(common.documents(spark, sf_dir, "conversations"))
