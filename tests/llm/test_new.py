"""Merge replay, hard negatives and the prefix trie against the library, loops over all pairs and plain recursion."""

import base64
import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import negatives, replay, trie

EMBEDDINGS = "vec_id long, embedding array<float>, label int, score string, rank int"
TURNS = "conv_id long, turn long, role string, text string, depth string"


# ---------------------------------------------------------------- op11

@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _texts():
    rng = random.Random(11)
    odd = [0x1C, 0x85, 0xA0, 0x200B, 0x3000, 0x1F600, 10, 13, 32, 32, 0x4E00, 0x301]
    return ["", None, " ", "\n\n \t x", "'s'll don't ''re", "a" * 3000, "ab" * 2000 + "ba" * 99, "hello hello HELLO"] + [
        "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xC0, 0x2100), rng.choice(odd)])) for _ in range(rng.randrange(200))) for _ in range(150)]


def test_replay_equals_the_library(spark, ranks):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(ranks[0]).read_bytes().splitlines())}
    library = tiktoken.Encoding("own", pat_str=ranks[1], mergeable_ranks=table, special_tokens={})
    texts = _texts()
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(3, texts[3], 7)], "doc_id long, text string, n_tokens int")
    got = replay.encode(docs, *ranks, ["ids", "n_tokens", "ids_sha256", "decoded", "decoded_sha256"]).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = library.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded"] == (r["text"] or "") == library.decode(ids)
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


def _slow_merge(ids, word):
    """Always the lowest rank, leftmost first."""
    parts = [bytes([b]) for b in word]
    while len(parts) > 1 and (low := min((ids.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))[0] < 1 << 40:
        i = low[1]
        parts[i: i + 2] = [parts[i] + parts[i + 1]]
    return [ids[p] for p in parts]


@pytest.mark.parametrize("many", [0, 40])
def test_replay_of_ranks_in_any_order(monkeypatch, many):
    """Vocabularies in which merging can bring up lower ranks than the one at hand."""
    monkeypatch.setattr(replay, "MANY", many)
    rng = random.Random(2)
    for _ in range(30):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(25)}
        order = [bytes([b]) for b in range(256)] + sorted(tokens, key=lambda _: rng.random())
        v = replay.Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(order)), r"\S+|\s+")
        words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 30))) for _ in range(60)]
        ids, starts = v.replay(words)
        got = np.split(ids, starts[1:])
        assert [g.tolist() for g in got] == [_slow_merge(v.ids, w) for w in words]
        assert [v.decode(g) for g in got] == words


def test_replay_in_slices_and_small_blocks(monkeypatch, ranks):
    v = replay.Vocabulary(Path(ranks[0]).read_bytes(), ranks[1])
    texts = [t or "" for t in _texts()]
    whole = [b"".join(x) for x in v.encode(texts)]
    monkeypatch.setattr(replay, "BLOCK", 8)
    monkeypatch.setattr(replay, "SLICE", 3)
    monkeypatch.setattr(replay, "REMEMBERED", 20)
    assert [b"".join(x) for x in v.encode(texts)] == whole


def test_replay_edges(spark, ranks):
    empty = spark.createDataFrame([], "doc_id long, text string, ids string")
    assert replay.encode(empty, *ranks, ["ids", "n_tokens"]).collect() == []
    with pytest.raises(ValueError, match="without a rank"):
        replay.Vocabulary(base64.b64encode(b"a") + b" 0", ".")


# ---------------------------------------------------------------- op12

def _brute(rows, step=100, positives=5, negs=5, low=80, high=100):
    """Rows (vec_id, vector, label) in table order."""
    sound = [(i, np.floor(256 * np.asarray(v, dtype=np.float64)), y, k) for k, (i, v, y) in enumerate(rows)
             if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, a, y, k in sound:
        if i % step:
            continue
        scored = sorted((-int(sum(p * q for p, q in zip(a, b, strict=False))), j, m, z) for j, b, z, m in sound if m != k)
        for s, j, _, z in [x for x in scored if x[3] == y][:positives]:
            near = [x for x in scored if x[3] != y and low * -s <= 100 * -x[0] <= high * -s][:negs]
            out += [(i, j, r + 1, x[1], -s, -x[0]) for r, x in enumerate(near)]
    return sorted(out)


def _vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(3, dims))
    return [(i, [float(x) for x in (centre[i % 3] + rng.normal(size=dims)) * 0.1], int(rng.integers(4))) for i in range(n)]


def _mined(spark, rows, **options):
    df = spark.createDataFrame([(i, v, y, "s", 1) for i, v, y in rows], EMBEDDINGS)
    return sorted(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0, **options).collect()))


@pytest.mark.parametrize("dims", [13, 16])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, dims):
    rows = [(i, np.float32(v).tolist(), y) for i, v, y in _vectors(900, dims, dims)]
    want = _brute(rows)
    assert len(want) > 100 and _mined(spark, rows) == want
    monkeypatch.setattr(negatives, "CANDIDATES", 50)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "HELD", 3)
    assert _mined(spark, rows) == want


def test_hard_negatives_of_odd_rows(spark):
    rows = [(0, [0.5, 0.25], 1), (1, [0.5, 0.25], 1), (2, [0.45, 0.25], 2), (3, [0.45, 0.25], 2), (4, None, 1), (5, [0.5, None], 1), (6, [float("nan"), 1.0], 2), (7, [float("inf"), 1.0], 2),
            (8, [0.5, 0.2], None), (9, [], 2), (100, [-0.5, -0.25], 1), (200, [0.0, 0.0], 3), (201, [0.0, 0.0], 3), (202, [0.5], 3), (300, [9.0, 9.0], 7), (None, [0.5, 0.25], 1),
            (400, [1.0, 1.0, 1.0], 5), (400, [1.0, 1.0, 1.0], 5), (401, [0.9, 1.0, 1.0], 6)]
    want = _brute(rows)
    assert {r[0] for r in want} >= {0, 200, 400} and _mined(spark, rows) == want  # scores of zero, shorter vectors, repeated anchors
    assert _mined(spark, []) == [] and _mined(spark, [(1, [1.0], 1)]) == []
    assert _mined(spark, rows, positives=1, negatives=2, low=50) == _brute(rows, positives=1, negs=2, low=50)
    with pytest.raises(Exception, match="components must be smaller"):
        _mined(spark, [(0, [1e30], 1)])


def test_scores_of_bit_planes():
    rng = np.random.default_rng(1)
    for span in (1, 3, 300, 1 << 33):
        a, b = rng.integers(-span, span, (9, 21)), rng.integers(-span if span > 1 else 0, span, (70, 21))
        if span >= 1 << 31:
            a = a % 1000
        assert (negatives.scores(a, negatives.planes(b)) == a @ b.T).all()


# ---------------------------------------------------------------- op13

def _plain_trie(rows, group=100, kinds=6):
    turns = {}
    for i, t, r, x, *_ in rows:
        if i is not None:
            turns.setdefault(i, []).append((t is not None, t or 0, r or "", x or ""))
    said = {i: [(r, x) for _, _, r, x in sorted(v)] for i, v in turns.items()}
    built = {}
    for i, own in said.items():
        h = zlib.crc32(str(i).encode()) % kinds
        source = i - (abs(i) % group if i >= 0 else -(abs(i) % group))
        built[i] = said.get(source, [])[:h] + own[h:]
    nodes, ends = {}, {}
    for i, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(i)
        ends.setdefault(tuple(path), []).append(i)
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) if k in children else 1
        saved[k] = sum(saved[x] for x in children.get(k, [])) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((min(v), len(k), -1 if not k else min(nodes[k[:-1]]), len(v), len(children.get(k, [])), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, v in nodes.items())


def _trie(spark, rows):
    df = spark.createDataFrame(rows, TURNS) if rows else spark.createDataFrame([], TURNS)
    return sorted(tuple(-1 if x is None else x for x in r) for r in trie.prefix_trie(df).collect())


def _talks(seed, convs=150, texts=3):
    rng = random.Random(seed)
    return [(i, t, rng.choice(["user", None]), rng.choice(["a", "bé", None, "ccc"][: texts]), "x") for i in range(-120, convs) if rng.random() < 0.8 for t in range(rng.choice([1, 2, 3, 8, 9]))]


@pytest.fixture
def small(monkeypatch):
    """Many segments and shards, a queue that spills, and lists of identifiers in pieces."""
    for name, value in (("SEGMENT", 3), ("SHARD", 40), ("CHUNK", 4)):
        monkeypatch.setattr(trie, name, value)


def test_trie_equals_recursion(spark, small):
    rows = _talks(1)
    assert _trie(spark, rows) == _plain_trie(rows)


def test_trie_of_one_long_conversation_that_others_leave_at_every_turn(spark, small):
    long = [(200, t, "u", f"t{t}", "") for t in range(120)]
    # Conversation 300 + i follows it for i turns; their own sources are absent but for their first turns.
    others = [(200 + i, t, "u", f"t{t}" if t < i else "other", "") for i in range(1, 90) for t in range(i + 1)]
    rows = long + others
    assert _trie(spark, rows) == _plain_trie(rows)


def test_trie_edges(spark):
    assert _trie(spark, []) == [] and _trie(spark, [(None, 1, "u", "x", "")]) == []
    rows = [(5, None, "u", "x", ""), (5, None, "u", "x", ""), (5, 1, None, None, ""), (6, 1, "", "", ""), (100, 0, "u", "ü" * 5000, ""), (101, 0, "v", "y", ""), (7, 3, "a", "b", ""), (7, 3, "a", "a", "")]
    assert _trie(spark, rows) == _plain_trie(rows)


def test_queue_spills_and_adds_up():
    rng = random.Random(4)
    sent = [((-rng.randrange(40), rng.randrange(30)), rng.randrange(5), rng.randrange(9)) for _ in range(5000)]
    q, want = trie.Queue(most=20), {}
    for k, a, b in sent:
        q.push(k, a, b)
        x = want.get(k, (0, 0))
        want[k] = (x[0] + a, x[1] + b)
    assert [(k, q.take(k)) for k in sorted(want)] == sorted(want.items())
    assert not q.heap and not q.runs
    q.close()
