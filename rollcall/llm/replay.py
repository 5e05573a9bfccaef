"""Byte-level BPE by replaying the merges over all words of a block of texts at once.

The distinct words (pre-tokens) of a block that the task hasn't seen yet are laid out as one array of bytes. An inverted
index leads from each rank to the places whose pair of tokens merges to it. The ranks are taken in order, lowest first; a
rank's merge is made at all its places, and only the two neighbours of a merged place get new entries in the index. As
words never touch each other, each gets exactly the merges it would get alone. Texts are then put together from their
words, so a word is encoded once a block however often it occurs, and a word that many documents share costs no shuffle.

Joining words encoded once for the whole corpus back to every occurrence would shuffle each word of each text (170 million
for 0.5 GB), many times the text itself; so the block of a task, not the whole corpus, is what a replay covers.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BLOCK = 4 << 20  # bytes of text whose words are replayed together; a longer text is a block of its own
SLICE = 1 << 18  # words of a text that are held at once
REMEMBERED = 800_000  # words a task keeps between blocks
MANY = 40  # places of a rank from which on they are merged all at once


def white_space(pattern: str) -> str:
    r"""The pattern with \s and \S as Unicode's property White_Space, as the library's engine reads them."""
    return pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")


class Vocabulary:
    """The ranks of a file whose lines are a token in base64, a space and its rank, which is also its id."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in ranks.splitlines() if line)}
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"bytes without a rank: {missing}")
        self.bytes = {r: t for t, r in self.ids.items()}
        self.first = [self.ids[bytes([b])] for b in range(256)]
        self.base = max(self.bytes) + 1
        #: Two tokens, as left * base + right, and the rank of their bytes together.
        self.pairs = {}
        for token, rank in self.ids.items():
            for i in range(1, len(token)):
                a, b = self.ids.get(token[:i]), self.ids.get(token[i:])
                if a is not None and b is not None:
                    self.pairs[a * self.base + b] = rank
        self.of_bytes = np.full((256, 256), -1, dtype=np.int32)
        for a in range(256):
            for b in range(256):
                self.of_bytes[a, b] = self.pairs.get(self.first[a] * self.base + self.first[b], -1)
        #: The same pairs in order, to look up many at once.
        self.keys = np.fromiter(sorted(self.pairs), dtype=np.int64, count=len(self.pairs))
        self.made = np.array([self.pairs[k] for k in self.keys.tolist()], dtype=np.int32)
        #: The tokens' bytes one after another, by id.
        size = np.zeros(self.base, dtype=np.int64)
        size[list(self.bytes)] = [len(t) for t in self.bytes.values()]
        self.size, self.start = size, np.cumsum(size) - size
        self.letters = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(self.base)), dtype=np.uint8)
        self.pattern = regex.compile(white_space(pattern))
        self.seen: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the two don't merge."""
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], -1).astype(np.int32)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all (not empty) words, one word after another, and where each word's begin.

        Takes about 24 bytes of memory for each byte of the words.
        """
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        size = len(data)
        if not size:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        ends = np.cumsum([len(w) for w in words])
        starts = ends - [len(w) for w in words]
        # Arrays, and views of them to work on many places at once: the token at its first byte (-1 at its others), the places
        # of the next token and of the one before in the word, and the rank of the pair with the next one.
        sym = array("i", np.asarray(self.first, dtype=np.int32)[data].tobytes())
        nxt, prv, rank = (array("i", np.arange(lo, lo + size, dtype=np.int32).tobytes()) for lo in (1, -1, 0))
        syms, nexts, befores, lows = (np.frombuffer(x, dtype=np.int32) for x in (sym, nxt, prv, rank))
        nexts[ends - 1], befores[starts], lows[-1] = -1, -1, -1
        lows[:-1] = self.of_bytes[data[:-1], data[1:]]
        lows[ends - 1] = -1
        word = np.repeat(np.arange(len(words), dtype=np.int32), ends - starts)
        index: dict[int, array] = {}
        heap: list[int] = []
        pair, base = self.pairs.get, self.base

        def enter(r: int, i: int) -> None:
            rank[i] = r
            if r >= 0:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = array("i", (i,))
                    heappush(heap, r)

        def enter_all(at: np.ndarray) -> None:
            """Index places whose ranks are set."""
            r = lows[at]
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order].astype(np.int32), r[order]
            cuts = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
            for a, b, x in zip(cuts, cuts[1:], r[cuts[:-1]].tolist(), strict=False):
                if x not in index:
                    index[x] = array("i")
                    heappush(heap, x)
                index[x].frombytes(at[a:b].tobytes())

        def merge_firsts(r: int, at: np.ndarray) -> bool:
            """Merge the first place of each word, all words at once; the other places stay in the index. False, and
            nothing done, where the places are in too few words for that to pay."""
            at = np.unique(at[lows[at] == r])
            first = np.diff(word[at], prepend=-1) != 0
            if 8 * np.count_nonzero(first) < max(len(at), 8 * MANY):
                return False
            if not first.all():
                index[r] = array("i", at[~first].tobytes())
                heappush(heap, r)
            at = at[first]
            j = nexts[at]
            syms[at], syms[j], lows[at], lows[j] = r, -1, -1, -1
            n = nexts[j]
            nexts[at] = n
            a, n = at[n >= 0], n[n >= 0]
            befores[n] = a
            lows[a] = self.ranks(syms[a], syms[n])
            p = befores[at]
            p = p[p >= 0]
            lows[p] = self.ranks(syms[p], syms[nexts[p]])
            enter_all(np.concatenate([a, p]))
            return True

        enter_all(np.arange(size, dtype=np.int32))
        while heap:
            r = heappop(heap)
            places = index.pop(r)
            if len(places) > MANY and merge_firsts(r, np.frombuffer(places, dtype=np.int32)):
                continue
            places = sorted(places)
            for k, i in enumerate(places):
                if rank[i] != r:  # a neighbour's merge took one of the two
                    continue
                j = nxt[i]
                sym[i], sym[j], rank[j] = r, -1, -1
                nxt[i] = n = nxt[j]
                made = -1
                if n >= 0:
                    prv[n] = i
                    made = pair(r * base + sym[n], -1)
                enter(made, i)
                p = prv[i]
                if p >= 0:
                    left = pair(sym[p] * base + r, -1)
                    enter(left, p)
                    made = left if made < 0 or 0 <= left < made else made
                if 0 <= made < r and k + 1 < len(places):  # a lower rank than the present one has come up: it goes first
                    if r not in index:
                        index[r] = array("i")
                        heappush(heap, r)
                    index[r].extend(places[k + 1:])
                    break
        there = syms >= 0
        return syms[there], np.concatenate([[0], np.cumsum(there)])[starts]

    def learn(self, words: set[str]) -> None:
        """Have `seen` hold the ids, as little-endian 32-bit integers, of all these words."""
        new, data = [], []
        for w in words:
            said = w.encode("utf-8")
            if (i := self.ids.get(said)) is not None:  # a word that is a token is that token, whatever the merges make
                self.seen[w] = i.to_bytes(4, "little")
            else:
                new.append(w)
                data.append(said)
        ids, starts = self.replay(data)
        whole, cuts = ids.astype("<u4").tobytes(), [*(starts * 4).tolist(), 4 * len(ids)]
        for w, a, b in zip(new, cuts, cuts[1:], strict=False):
            self.seen[w] = whole[a:b]

    def decode(self, ids: np.ndarray) -> bytes:
        size = self.size[ids]
        total = np.cumsum(size)
        return self.letters[np.repeat(self.start[ids] - total + size, size) + np.arange(total[-1] if len(ids) else 0)].tobytes()

    def encode(self, texts: list[str]):
        """For each text in turn, an iterator over its ids in slices, as bytes. Consume them in turn."""
        if sum(map(len, texts)) > 3 * BLOCK:
            for text in texts:
                yield self._sliced(text)
            return
        split = [self.pattern.findall(t) for t in texts]
        self._know(set().union(*split))
        for words in split:
            yield iter((b"".join(map(self.seen.__getitem__, words)),))

    def _know(self, words: set[str]) -> None:
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        self.learn(words - self.seen.keys())

    def _sliced(self, text: str):
        words = (m[0] for m in self.pattern.finditer(text))
        while part := list(islice(words, SLICE)):
            self._know(set(part))
            yield b"".join(map(self.seen.__getitem__, part))


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    """One a worker, ranks and pattern."""
    key = hashlib.sha256(ranks + pattern.encode()).hexdigest()
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(ranks, pattern)
    return _vocabularies[key]


#: What encode() can return for each row, with its type in SQL.
OUTPUTS = {"ids": (pa.list_(pa.int64()), "array<long>"), "n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"),
           "decoded": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}


def _blocks(batches):
    """Lists of batches with about BLOCK bytes of text; a longer single row is alone in its batch."""
    held, size = [], 0
    for batch in batches:
        for part in common.pieces(batch, most=BLOCK):
            held.append(part)
            size += part.column("text").nbytes
            if size >= BLOCK:
                yield held
                held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, ranks_path: str, pattern: str, outputs: list[str]) -> DataFrame:
    """docs with the columns of `outputs` (see OUTPUTS) of each whole text: its ids, and what they decode to.

    The ranks are read once on the driver and shipped (a few MB at most). Null and empty texts have no tokens and decode to
    the empty text; repeated rows stay; columns of docs with an output's name are replaced, all others are carried along,
    whatever they are called; an empty table stays empty. Of two equal ranks in a word the left one is merged first.
    Memory: about 100 bytes for each word of a block or a slice, and 24 bytes for each byte of the longest single word.
    """
    common.ready(docs.sparkSession)
    with open(ranks_path, "rb") as f:
        spec = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))
    docs = docs.drop(*outputs)
    need_text = any(o.startswith("decoded") for o in outputs)

    def run(batches):
        v = vocabulary(*spec.value)
        gc.freeze()  # the vocabulary holds no cycles: no use in walking it again and again
        for parts in _blocks(batches):
            encoded = v.encode([t or "" for part in parts for t in part.column("text").to_pylist()])
            for part in parts:
                cols = {o: [] for o in outputs}
                for slices in islice(encoded, part.num_rows):
                    n, of_ids, of_text, every, texts = 0, hashlib.sha256(), hashlib.sha256(), [], []
                    for packed in slices:
                        got = np.frombuffer(packed, dtype="<u4")
                        n += len(got)
                        of_ids.update(packed)
                        if need_text:
                            said = v.decode(got)
                            of_text.update(said)
                            texts.append(said if "decoded" in cols else b"")
                        if "ids" in cols:
                            every.append(got.astype(np.int64))
                    made = {"n_tokens": n, "ids_sha256": of_ids.hexdigest(), "decoded_sha256": of_text.hexdigest()}
                    made["ids"] = np.concatenate(every) if every else []
                    made["decoded"] = b"".join(texts).decode("utf-8", "replace")
                    for o in outputs:
                        cols[o].append(made[o])
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(cols[o], OUTPUTS[o][0]) for o in outputs],
                                                 names=[*part.schema.names, *outputs])

    return docs.mapInArrow(run, common.schema_with(docs.schema, *[(o, OUTPUTS[o][1]) for o in outputs]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11 over documents."""
    import public_tokenizers

    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    made = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["n_tokens", "ids_sha256", "decoded_sha256"])
    return made.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
