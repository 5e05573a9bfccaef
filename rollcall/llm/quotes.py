"""Quotation linking: nested quotes in messages are tied to the messages they quote.

Lines that begin with `>` marks are quotes, one level a mark; a line such as "On Monday, Ann wrote:" just above a deeper
level belongs to that quote, not to what its writer said. Each run of lines of one level is a passage; its text is
normalised and hashed, and linked to messages of the same conversation whose own words hold it, as a sentence, a few
words, a line or a body, however it is wrapped. To find a passage anywhere without hashing all stretches of all messages,
both sides choose short grams by their content (the least hash in every stretch of 2**c words, c by the passage's length):
messages index those, a passage looks up one, and the stretch of words around each place found is compared by its full
hash. Quote-free messages in reply order come out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_MARK = re.compile(r"[ \t]*>")
_WORD = re.compile(r"\w+")
# The line, or two lines, over a quote that say whose it is; the last one ends with the word and a colon.
ATTRIBUTION = r"On\b.*\bwrote:"

SLOTS = 1024  # remainders of grams that tell which ones a conversation looks up; past that many passages all are indexed


def normal(text: str) -> str:
    """Letters and digits in lower case, one space between words: layout, wrapping and punctuation don't count."""
    return " ".join(_WORD.findall(text.casefold()))


def parse(text: str, attribution: str = ATTRIBUTION) -> tuple[str, list[tuple[int, str]]]:
    """(body without quotes, [(level, passage)]). A blank unquoted line between two quotes of a level parts them.

    attribution: a pattern; lines that match it as a whole, alone or with the line before, and stand just above a deeper
    level (blank lines between don't count) are in neither. An empty pattern keeps them.
    """
    lines = []
    for line in text.splitlines():
        depth, at = 0, 0
        while m := _MARK.match(line, at):
            depth, at = depth + 1, m.end()
        lines.append((depth, line[at:].strip() if depth else line))
    if attribution and any(depth for depth, _ in lines):
        full = re.compile(attribution).fullmatch
        shown = [i for i, (_, rest) in enumerate(lines) if rest.strip()]
        gone = set()
        for j, (i, below) in enumerate(zip(shown, shown[1:])):
            depth, rest = lines[i]
            if lines[below][0] > depth:
                before = shown[j - 1] if j and lines[shown[j - 1]][0] == depth else None
                if full(rest.strip()):
                    gone.add(i)
                elif before is not None and full(f"{lines[before][1].strip()} {rest.strip()}"):
                    gone |= {before, i}
        lines = [line for i, line in enumerate(lines) if i not in gone]
    body, quotes, level, run = [], [], 0, []

    def flush():
        if level and run:
            quotes.append((level, "\n".join(run)))

    for depth, rest in lines:
        if depth != level or (depth and not rest):
            flush()
            level, run = depth, []
        if not depth:
            body.append(rest)
        elif rest:
            run.append(rest)
    flush()
    return "\n".join(body).strip(), quotes


def _digest(norm: bytes) -> bytes:
    return hashlib.sha256(norm).digest()[:16]


def _words(norm: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Normal text with a space at both ends, so that only whole words are found in it; where each word's space is; hashes."""
    data = f" {norm} ".encode("utf-8", "surrogatepass") if norm else b""
    at = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)[:-1]
    _, h = common.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return data, at, h


def _grams(h: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all grams of class c in words of these hashes, and the first place of the least one in each stretch of
    2**c words: 2**(c - 1) grams of 2**(c - 1) + 1 words lie in one, found by doubling."""
    wide = 1 if c == 0 else (1 << (c - 1)) + 1
    power, inverse = common._powers(len(h) + 1)
    total = np.r_[np.uint64(0), np.cumsum(h * power[: len(h)], dtype=np.uint64)]
    n = len(h) - wide + 1
    g = common.mix((total[wide:] - total[:-wide]) * inverse[:n])
    at = np.arange(n)
    for j in range(c - 1):
        left, right = at[: -(1 << j)], at[1 << j:]
        at = np.where(g[right] < g[left], right, left)
    return g, at


def anchor(norm: str) -> dict:
    """A passage as it is looked up: class, gram, bytes before the gram, bytes in all, hash of all."""
    data, at, h = _words(norm)
    c = len(h).bit_length() - 1
    g, least = _grams(h[: 1 << c], c)
    return {"class": c, "gram": int(g[least[0]].view(np.int64)), "lead": int(at[least[0]]), "size": len(data), "hash": _digest(data)}


def anchors(norm: str, classes: list[int], wanted: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The chosen grams of a message's words with a wanted remainder: (class, grams, bytes before each). One word is listed once."""
    _, at, h = _words(norm)
    out = []
    for c in classes:
        if len(h) >> c:
            g, least = _grams(h, c)
            least = np.unique(least) if c else np.unique(g, return_index=True)[1]
            gram = g[least].view(np.int64)
            mine = wanted[gram % SLOTS]
            out.append((c, gram[mine], at[least[mine]]))
    return out


_QUOTED = [("level", pa.int32()), ("class", pa.int32()), ("gram", pa.int64()), ("lead", pa.int64()), ("size", pa.int64()), ("hash", pa.binary())]


def _parsed(attribution):
    def run(batches):
        for batch in batches:
            for part in common.pieces(batch):
                body, norms, n, quoted = [], [], [], []
                for text in part.column("text").to_pylist():
                    b, quotes = parse(text or "", attribution)
                    body.append(b)
                    norms.append(f" {x} ".encode("utf-8", "surrogatepass") if (x := normal(b)) else b"")
                    found = [{"level": lv, **anchor(x)} for lv, q in quotes if (x := normal(q))]
                    n.append(len(found))
                    quoted.append(found)
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), pa.array(body, pa.string()), pa.array(norms, pa.binary()),
                     pa.array(n, pa.int32()), pa.array(quoted, pa.list_(pa.struct(_QUOTED)))],
                    names=["conv_id", "turn", "role", "body", "norm", "n_quotes", "quoted"])

    return run


def _indexed(classes):
    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "norm", 1 << 17):
                found = []
                for i, (x, slots) in enumerate(zip(part.column("norm").to_pylist(), part.column("wanted"), strict=True)):
                    wanted = np.zeros(SLOTS, dtype=bool)
                    wanted[slots.values.to_numpy()] = True
                    found += [(i, *a) for a in anchors(x[1:-1].decode("utf-8", "surrogatepass"), classes, wanted)]
                if found:
                    many = [len(f[2]) for f in found]
                    row = pa.array(np.repeat([f[0] for f in found], many))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("conv_id").take(row), part.column("turn").take(row), pa.array(np.repeat([f[1] for f in found], many).astype(np.int32)),
                         pa.array(np.concatenate([f[2] for f in found])), pa.array(np.concatenate([f[3] for f in found]))],
                        names=["conv_id", "turn", "class", "gram", "at"])

    return run


def link(messages: DataFrame, attribution: str = ATTRIBUTION) -> DataFrame:
    """messages: conv_id, turn, role, text -> conv_id, turn, role, body, n_quotes, n_linked, parent_turn, root_turn,
    depth, position.

    A passage's original is the first turn of the conversation whose own words hold it, if that is earlier than the
    quoting turn. attribution: see parse(). A message's parent is the latest original of its outermost quotes that are linked; without one it starts a
    thread. position counts from 0 in a conversation: threads by their first turn, then by depth, then by turn, so that
    every reply follows what it quotes. Null or empty texts have an empty body and no quotes. Rows with a null conv_id
    or turn are kept, unlinked. Repeated rows stay, and share parent and depth; rows of one turn count as one message.
    Other columns are ignored. An empty table gives no rows.
    """
    common.ready(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    read = common.save(rows.mapInArrow(_parsed(attribution), "conv_id long, turn long, role string, body string, norm binary, n_quotes int, "
                                       "quoted array<struct<level:int,class:int,gram:long,lead:long,size:long,hash:binary>>"))
    asks = common.save(read.filter("n_quotes > 0 and conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("quoted").alias("q"))
                       .select("conv_id", "turn", "q.*").distinct())
    # At most 63 classes, whatever the table; a passage is looked up once, in turns before the last that quotes it.
    classes = sorted(r[0] for r in asks.select("class").distinct().collect())
    sought = asks.groupBy("conv_id", "class", "gram", "lead", "size", "hash").agg(F.max("turn").alias("until"))
    bodies = read.filter((F.col("body") != "") & F.col("turn").isNotNull()).select("conv_id", "turn", "norm")
    # What is looked up in a conversation, as SLOTS remainders at most, so that a message gives few grams that nobody asks for.
    wanted = asks.groupBy("conv_id").agg(F.collect_set(F.pmod("gram", F.lit(SLOTS)).cast("int")).alias("wanted"))
    index = (bodies.join(wanted, "conv_id")
             .mapInArrow(_indexed(classes), "conv_id long, turn long, class int, gram long, at long"))
    places = (index.join(sought, ["conv_id", "class", "gram"]).filter("turn < until and at >= lead")
              .select("conv_id", "turn", (F.col("at") - F.col("lead") + 1).cast("int").alias("start"), F.col("size").cast("int").alias("size"), "hash"))
    same = F.unhex(F.substring(F.sha2(F.substring("norm", F.col("start"), F.col("size")), 256), 1, 32)) == F.col("hash")
    wrote = places.join(bodies, ["conv_id", "turn"]).filter(same).groupBy("conv_id", "hash").agg(F.min("turn").alias("original"))
    linked = common.save(asks.select("conv_id", "turn", "level", "hash").distinct().join(wrote, ["conv_id", "hash"]).filter("original < turn"))
    common.drop(asks)
    parents = (linked.groupBy("conv_id", "turn", "level").agg(F.max("original").alias("original"), F.count(F.lit(1)).alias("k"))
               .groupBy("conv_id", "turn").agg(F.min_by("original", "level").alias("parent"), F.sum("k").alias("n_linked")))
    parents = common.save(parents)
    # Pointer jumping: after k rounds every message knows its ancestor 2**k steps up, or its root.
    jump = common.save(parents.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")))
    while True:
        above = jump.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = common.save(jump.join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t")), "left").select(
            "conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved")))
        moved = new.filter("moved").limit(1).count()
        common.drop(jump)
        jump, scratch = new.drop("moved"), new._scratch
        jump._scratch = scratch
        if not moved:
            break
    tree = parents.join(jump, ["conv_id", "turn"]).select("conv_id", "turn", "parent", "n_linked", "up", "depth")
    out = read.select("conv_id", "turn", "role", "body", "n_quotes").join(tree, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "body", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.col("parent").alias("parent_turn"),
        F.coalesce("up", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).alias("depth"))
    return common.ranked(out, ["conv_id"], ["root_turn", "depth", "turn", "role", "body"], "position")


def replies(messages: DataFrame) -> DataFrame:
    """messages as a mail thread would hold them: by (conv_id + turn) % 4 a message stays plain, quotes the whole turn
    before it, quotes that and, one level deeper, the turn before that, or quotes the first line of the turn before it
    without its first word. Each quote has a line above it that says whose it is.

    The generated conversations hold no quotes of their own; every message stays, with its own text below the quotes.
    """
    # One text a turn, so that repeated turns don't multiply.
    before = messages.filter("text is not null").groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    last = before.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("said").alias("_last"))
    older = before.select("conv_id", (F.col("turn") + 2).alias("turn"), F.col("said").alias("_older"))
    kind = (F.col("conv_id") + F.col("turn")) % 4
    quote = lambda c, mark: F.concat(F.lit(mark), F.replace(c, F.lit("\n"), F.lit("\n" + mark)))
    whose = lambda mark, back: F.concat(F.lit(mark + "On turn "), (F.col("turn") - back).cast("string"), F.lit(" they wrote:\n"))
    above = F.when((kind == 2) & F.col("_older").isNotNull(), F.concat(whose("> ", 2), quote(F.col("_older"), "> > "), F.lit("\n"))).otherwise("")
    shown = F.when(kind == 3, F.regexp_replace(F.split_part("_last", F.lit("\n"), F.lit(1)), "^[^ ]+ ", "")).otherwise(F.col("_last"))
    made = F.when(F.col("_last").isNull() | (kind == 0), F.col("text")).otherwise(
        F.concat(whose("", 1), above, quote(shown, "> "), F.lit("\n\n"), F.coalesce("text", F.lit(""))))
    return messages.join(last, ["conv_id", "turn"], "left").join(older, ["conv_id", "turn"], "left").withColumn("text", made).select("conv_id", "turn", "role", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1 over all conversations, written as replies that quote; parent_turn is -1 for messages without a parent."""
    linked = link(replies(common.documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return linked.withColumn("parent_turn", F.coalesce("parent_turn", F.lit(-1)))
