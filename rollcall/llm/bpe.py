"""Byte-level BPE as a bounded-lookahead streaming transducer.

Encoding reads a text once, pre-token by pre-token. Most pre-tokens are short and are merged whole (and remembered in a
bounded table). A longer one is read in chunks: the merge list has a sufficient lookahead L, a number of bytes computed
once from the merges, such that a token boundary more than L bytes before the end of what has been read can't move when
more bytes arrive. Tokens before the last such boundary are emitted at once; the rest is carried on. Since no merge ever
crosses a final boundary, the part behind it is encoded on its own, so memory stays at L plus one chunk.
Decoding feeds the tokens' bytes to an incremental UTF-8 state machine.
"""

from __future__ import annotations

import codecs
import gc
import hashlib
import heapq
import json
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed by the vocabulary file's format: how byte-level pre-tokenizing parts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
CHUNK = 4096  # bytes read at once of a long pre-token
SHORT = 64  # bytes of a string that is merged by scanning
REMEMBERED = 1 << 19  # pre-tokens kept with their ids
SLICE = 512  # pre-tokens encoded, hashed and decoded at once


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """One vocabulary: `spec` is the text of its JSON file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        self.check(data)
        alphabet = byte_alphabet()
        vocab = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.bytes = {i: bytes(map(alphabet.__getitem__, t)) for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.first = {b[0]: i for i, b in self.bytes.items() if len(b) == 1}
        self.merges = {}
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.ranks = {pair: rank for pair, (rank, _) in self.merges.items()}
        self.made = [new for _, new in sorted(self.merges.values())]
        self.lookahead = self.sufficient_lookahead()
        self.pattern = regex.compile(PATTERN)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.seen: dict[str, tuple[str, tuple[int, ...]]] = {}

    @staticmethod
    def check(data: dict) -> None:
        """Refuse what this transducer doesn't do, rather than encode differently."""
        model, split = data["model"], data.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "fuse_unk", "ignore_merges") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or odd:
            raise ValueError(f"only plain byte-level BPE is supported ({odd or model.get('type')})")
        if data.get("normalizer"):
            raise ValueError("normalizers aren't supported")
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only the ByteLevel pre-tokenizer without a prefix space is supported")
        for t in data["added_tokens"]:
            if not t["special"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized"):
                raise ValueError(f"added token {t['content']!r}: only special, unstripped tokens are supported")

    def sufficient_lookahead(self) -> int:
        """Bytes after a boundary that fix it.

        A change at the end of the input moves left only from a merge to one of a later rank whose token starts before
        the place the change has reached; there, the later token's rest and the earlier token must agree as far as
        both go. far[t] is the greatest distance from the start of token t to the end of the input along such a chain;
        one pass in the order of ranks finds it, as every step goes to a later rank.
        """
        far: dict[bytes, int] = {}  # by token
        under: dict[bytes, int] = {}  # by prefix of a token: the most over tokens that begin with it
        most = 1

        def add(token: bytes, value: int) -> None:
            far[token] = max(value, far.get(token, 0))
            for i in range(1, len(token) + 1):
                if under.get(token[:i], 0) < value:
                    under[token[:i]] = value

        for b in range(256):
            add(bytes([b]), 1)
        for _, token in sorted(self.merges.values()):
            t = self.bytes[token]
            value = len(t)
            for i in range(1, len(t)):
                rest = t[i:]
                reach = max([under.get(rest, 0)] + [far.get(rest[:j], 0) for j in range(1, len(rest))])
                value = max(value, i + reach)
            add(t, value)
            most = max(most, value)
        return most + max(map(len, self.bytes.values()))

    def merge(self, data: bytes) -> list[int]:
        """The ids of a whole byte string: always the merge of the lowest rank, leftmost first."""
        ids = [self.first[b] for b in data]
        if len(ids) < 2:
            return ids
        n = len(ids)
        if n <= SHORT:  # scanning a short list for the lowest rank beats a heap
            get, none = self.ranks.get, len(self.made)
            ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
            while (low := min(ranks)) < none:
                i = ranks.index(low)
                ids[i: i + 2] = [self.made[low]]
                del ranks[i]
                if not ranks:
                    break
                if i:
                    ranks[i - 1] = get((ids[i - 1], ids[i]), none)
                if i < len(ranks):
                    ranks[i] = get((ids[i], ids[i + 1]), none)
            return ids
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if m := self.merges.get((ids[i], ids[i + 1])):
                heap.append((m[0], i, ids[i], ids[i + 1], m[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = nxt[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if m := self.merges.get((new, ids[nxt[i]])):
                    heapq.heappush(heap, (m[0], i, new, ids[nxt[i]], m[1]))
            if prv[i] >= 0 and (m := self.merges.get((ids[prv[i]], new))):
                heapq.heappush(heap, (m[0], prv[i], ids[prv[i]], new, m[1]))
        return [i for i in ids if i >= 0]

    def stream(self, chunks):
        """Byte chunks of one pre-token -> lists of ids, each as soon as it is stable."""
        carry = b""
        for chunk in chunks:
            carry += chunk
            if len(carry) <= 2 * self.lookahead:
                continue
            ids, at, stable = self.merge(carry), 0, 0
            for k, i in enumerate(ids):
                at += len(self.bytes[i])
                if at > len(carry) - self.lookahead:
                    break
                stable, cut = k + 1, at
            if stable:
                yield ids[:stable]
                carry = carry[cut:]
        yield self.merge(carry)

    def piece(self, text: str):
        """A pre-token's ids, also joined by commas; those of a long one come in slices, as they become stable."""
        if len(text) > CHUNK:
            for ids in self.stream(text[i: i + CHUNK].encode("utf-8") for i in range(0, len(text), CHUNK)):
                yield ",".join(map(str, ids)), tuple(ids)
            return
        ids = tuple(self.merge(text.encode("utf-8")))
        out = (",".join(map(str, ids)), ids)
        if len(text) <= 64:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[text] = out
        yield out

    def encode(self, text: str):
        """(joined ids, ids) of each pre-token of the text, or of slices of a long one, in turn; special tokens stand for
        themselves."""
        seen, piece, at = self.seen, self.piece, 0
        marks = self.marks.finditer(text) if self.marks and any(m in text for m in self.special) else ()
        for mark in marks:
            for w in self.pattern.finditer(text, at, mark.start()):
                w = w[0]
                if known := seen.get(w):
                    yield known
                else:
                    yield from piece(w)
            i, at = self.special[mark[0]], mark.end()
            yield str(i), (i,)
        for w in self.pattern.finditer(text, at):
            w = w[0]
            if known := seen.get(w):
                yield known
            else:
                yield from piece(w)

    def slices(self, text: str):
        """encode() in lists of SLICE pre-tokens or slices."""
        tokens = self.encode(text)
        while part := list(islice(tokens, SLICE)):
            yield part

    def decoder(self):
        """A function that takes ids in turn and gives the text they complete; called without any, it gives the rest."""
        machine, of = codecs.getincrementaldecoder("utf-8")("replace"), self.bytes.__getitem__
        return lambda ids=None: machine.decode(b"", True) if ids is None else machine.decode(b"".join(map(of, ids)))


_encoders: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder a worker and vocabulary."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(spec)
    return _encoders[key]


#: What transduce() can return for each row.
OUTPUTS = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded": pa.string(), "decoded_sha256": pa.string()}
_SQL = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


def transduce(docs: DataFrame, spec_path: str, outputs: list[str]) -> DataFrame:
    """docs with the columns of `outputs` (see OUTPUTS) of each whole text: its ids, and what they decode to.

    The vocabulary is read once on the driver and shipped (a few MB at most). Null and empty texts have no tokens and
    decode to the empty text; repeated rows stay; columns of docs with an output's name are replaced; an empty table
    stays empty. A row is handled on its own, however long: beside the text itself, its pre-token at hand and the outputs
    asked for, memory holds SLICE pre-tokens or slices of a long one, and the lookahead and a chunk. Vocabularies with features that this transducer lacks
    are refused.
    """
    common.ready(docs.sparkSession)
    with open(spec_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(*outputs)
    need_text = any(o.startswith("decoded") for o in outputs)

    def run(batches):
        enc = encoder(spec.value)
        gc.freeze()  # the vocabulary and what is remembered hold no cycles: no use in walking them again and again
        for batch in batches:
            for part in common.pieces(batch):
                cols = {o: [] for o in outputs}
                for text in part.column("text").to_pylist():
                    n, every, texts, of_ids, of_text, decode = 0, [], [], hashlib.sha256(), hashlib.sha256(), enc.decoder()
                    for got in enc.slices(text or ""):
                        ids = list(chain.from_iterable([g[1] for g in got]))
                        if "ids_sha256" in cols:
                            of_ids.update((("," if n else "") + ",".join([g[0] for g in got])).encode())
                        n += len(ids)
                        if "ids" in cols:
                            every += ids
                        if need_text:
                            done = decode(ids)
                            of_text.update(done.encode())
                            if "decoded" in cols:
                                texts.append(done)
                    if need_text:
                        done = decode()
                        of_text.update(done.encode())
                        texts.append(done)
                    made = {"ids": every, "n_tokens": n, "ids_sha256": of_ids.hexdigest(), "decoded": "".join(texts), "decoded_sha256": of_text.hexdigest()}
                    for o in outputs:
                        cols[o].append(made[o])
                yield pa.RecordBatch.from_arrays(list(part.columns) + [pa.array(cols[o], OUTPUTS[o]) for o in outputs],
                                                 names=[*part.schema.names, *outputs])

    return docs.mapInArrow(run, common.schema_with(docs.schema, *[(o, _SQL[o]) for o in outputs]))


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over documents."""
    docs = common.documents(spark, sf_dir).select("doc_id", "text")
    return transduce(docs, vocabulary(), ["n_tokens", "ids_sha256", "decoded_sha256"]).drop("text").select(
        "doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
