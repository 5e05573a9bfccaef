"""Rows that share ids, null ids, odd extra columns, broken files: what each operator and pipeline stage makes of them."""

import hashlib
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import bpe, common, langid, minhash, nndescent, packing, quotes, sharding, suffixes, tiff, toxicity
from tests.llm.test_llm import prose

ODD = ["letters", "_letters", "copy", "lo", "hi", "score", "predicted", "held_out", "lang_pred", "tid", "_row", "component", "kept", "n_removed", "bin", "piece", "rank", "a b"]


def odd_columns(df):
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in ODD])


def rows_of(spark, given, schema="doc_id long, text string"):
    return spark.createDataFrame(given, schema)


@pytest.fixture(scope="module")
def shared_ids():
    """Rows 0.. with ids that come twice, one of them null: near copies, shared passages, and texts of their own."""
    rng = random.Random(21)
    a, b, c = prose(rng, 80), prose(rng, 80), prose(rng, 90)
    near = lambda t: t + " extra"
    return [(1, a), (2, b), (5, near(a)), (5, near(b)), (5, near(b)), (7, "own words " + c), (7, "other " + prose(rng, 40)), (9, c), (None, c), (None, None), (3, ""), (4, None)]


def test_near_duplicates_by_row(spark, shared_ids):
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["n_shingles"] > 0, r["kept"]) for r in minhash.near_duplicates(rows_of(spark, shared_ids)).collect())
    assert got == sorted([(1, 1, True, True), (2, 2, True, True), (5, 1, True, False), (5, 2, True, False), (5, 2, True, False), (7, 7, True, True), (7, 7, True, True),
                          (9, 7, True, False), (-1, 7, True, False), (-1, -1, False, True), (3, 3, False, True), (4, 4, False, True)])


def brute_by_row(given, n=50):
    data = [((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in given]
    first = {}
    for d, b in data:
        for p in range(len(b) - n + 1):
            first[b[p: p + n]] = min(d, first.get(b[p: p + n], d))
    out = []
    for d, b in data:
        gone = {q for p in range(len(b) - n + 1) if first[b[p: p + n]] < d for q in range(p, p + n)}
        out.append((-1 if d == (1 << 63) - 1 else d, len(b), len(gone), hashlib.sha256(bytes(x for q, x in enumerate(b) if q not in gone)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [1 << 10, 1])
def test_repeats_by_row(spark, shared_ids, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = suffixes.remove_repeats(odd_columns(rows_of(spark, shared_ids)).drop("n_removed"), "digest").collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in rows) == brute_by_row(shared_ids)
    assert all(r["copy"] == "own copy" and r["tid"] == "own tid" for r in rows)


def test_shards_are_the_same_however_dealt(spark, shared_ids, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 8)
    rng = random.Random(2)
    rows = rows_of(spark, shared_ids + [(100 + i, prose(rng, rng.randint(1, 30))) for i in range(60)])
    key = lambda r: (r["doc_id"] or -1, r["text_crc32"], r["size"])
    one = sorted((*key(r), r["shard"]) for r in sharding.shard(odd_columns(rows.coalesce(1)), 4).collect())
    two = sorted((*key(r), r["shard"]) for r in sharding.shard(rows.repartition(7), 4).collect())
    assert one == two and len({r[2:] for r in one}) > 4


def test_extra_columns_are_carried(spark, shared_ids):
    df = odd_columns(rows_of(spark, shared_ids).withColumn("lang", F.lit("en")))
    own = lambda r, *made: all(r[c] == f"own {c}" for c in ODD if c not in made)
    rows = langid.identify(df).collect()
    assert len(rows) == len(shared_ids) and all(own(r, "score", "lang_pred", "held_out") for r in rows)
    assert {r["lang_pred"] for r in rows if not r["text"]} == {"und"}
    labels = rows_of(spark, [(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    assert all(own(r, "score", "held_out", "predicted") and 0 <= r["score"] <= 1 for r in toxicity.rate(df, labels).collect())
    assert all(own(r) for r in bpe.transduce(df, bpe.vocabulary(), ["n_tokens", "ids_sha256"]).collect())
    assert all(own(r) for r in tiff.read_pages(tiff.encode(df)).collect())
    packed = packing.pack(odd_columns(rows_of(spark, [(None, 5), (1, None), (1, 7)], "doc_id long, n_tokens int"))).collect()
    assert sorted(r["n_tokens"] for r in packed) == [0, 5, 7] and len({r["bin"] for r in packed if r["bin"] is not None}) == 1


def test_bpe_refuses_what_it_lacks():
    import json

    spec = json.loads(open(bpe.vocabulary(), encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"added_tokens": [{"id": 1, "content": "x", "special": False}]}):
        with pytest.raises(ValueError):
            bpe.Encoder(json.dumps(spec | change))


def raw_tiff(w, h, spp, bits, strips, order="<", **tags):
    """A classic file of one page from ready-made strips."""
    out = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + b"\0\0\0\0")
    at = []
    for s in strips:
        at.append(len(out))
        out += s
    values = {256: [w], 257: [h], 258: [bits] * spp, 259: [1], 262: [1], 273: at, 277: [spp], 278: [h], 279: [len(s) for s in strips]} | {int(k[1:]): v for k, v in tags.items()}
    body = b""
    for tag, v in sorted(values.items()):
        raw = struct.pack(f"{order}{len(v)}I", *v)
        if len(raw) > 4:
            at_, raw = len(out), out.extend(raw) or struct.pack(order + "I", len(out) - len(raw))
        body += struct.pack(order + "HHI", tag, 4, len(v)) + raw
    out[4:8] = struct.pack(order + "I", len(out))
    return bytes(out + struct.pack(order + "H", len(values)) + body + b"\0\0\0\0")


def test_tiff_layouts(spark):
    page = lambda f: tiff.read_page(f, next(tiff.directories(f)))
    assert page(raw_tiff(10, 2, 1, 1, [b"\xa5\x80\x0f\x40"])) == (10, 2, 1, bytes([1, 0, 1, 0, 0, 1, 0, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1, 0, 1]))
    assert page(raw_tiff(10, 2, 1, 1, [b"\xa5\x01\xf0\x02"], t266=[2])) == page(raw_tiff(10, 2, 1, 1, [b"\xa5\x80\x0f\x40"]))
    assert page(raw_tiff(3, 1, 1, 4, [b"\x1f\x70"])) == (3, 1, 1, bytes([1, 15, 7]))
    for order in "<>":
        deep = struct.pack(order + "4H", 1, 500, 65535, 2)
        assert page(raw_tiff(2, 2, 1, 16, [deep], order)) == (2, 2, 1, struct.pack("<4H", 1, 500, 65535, 2))
        step = struct.pack(order + "3H", 65535, 2, 3)
        assert page(raw_tiff(3, 1, 1, 16, [step], order, t317=[2])) == (3, 1, 1, struct.pack("<3H", 65535, 1, 4))
    assert page(raw_tiff(2, 1, 3, 8, [b"\1\2", b"\3\4", b"\5\6"], t284=[2])) == (2, 1, 3, bytes([1, 3, 5, 2, 4, 6]))
    good, lost = tiff.write_tiff([(4, 1, 1, b"abcd"), (4, 1, 1, b"efgh"), (4, 1, 1, b"ijkl")], tiff.NONE, 1), 0
    bad = bytearray(good)
    spots = [d[258] for d in tiff.directories(good)]
    lost = good.index(struct.pack("<HHIHH", 258, 3, 1, 8, 0), good.index(struct.pack("<HHIHH", 258, 3, 1, 8, 0)) + 1)
    bad[lost + 8] = 7
    assert len(spots) == 3
    rows = tiff.read_pages(spark.createDataFrame([(1, bytes(bad)), (2, good[:-30])], "id int, media binary")).collect()
    assert [(r["page"], r["samples"], r["error"] is None) for r in rows if r["id"] == 1] == [(0, b"abcd", True), (1, None, False), (2, b"ijkl", True)]
    assert [bytes(r["samples"]) for r in rows if r["id"] == 2 and r["samples"]][:2] == [b"abcd", b"efgh"]


def test_nearest_edges(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (100, [3.0, 0.0]), (7, [3.0, 4.0]), (8, [1.0]), (11, [0.0]), (None, [1.0, 1.0]), (9, [None, 1.0]), (10, [])]
    got = nndescent.nearest(odd_columns(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [
        (0, 1, 8, 0.5), (0, 2, 100, 2.5), (0, 3, 7, (2.5 ** 2 + 16) ** 0.5), (100, 1, 8, 2.0), (100, 2, 0, 2.5), (100, 3, 7, 4.0)]


def test_nearest_of_few_and_of_clusters_far_apart(spark):
    """Tables of any size go the same way: graph, then search."""
    rng = random.Random(8)
    for sizes in ((3,), (60, 9, 20)):
        rows = [(k, [100.0 * c + rng.random(), rng.random(), rng.random()]) for k, c in enumerate(c for c, n in enumerate(sizes) for _ in range(n))]
        found = nndescent.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i % 10 == 0).collect()
        got = {q: [r["vec_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] for q, _ in rows if q % 10 == 0}
        for q, ids in got.items():
            want = sorted((sum((a - b) ** 2 for a, b in zip(v, rows[q][1], strict=True)), i) for i, v in rows if i != q)[:10]
            assert ids == [i for _, i in want]


def test_scratch_needs_a_shared_folder():
    class Cluster:
        """What scratch_root() asks of a session."""
        sparkContext = property(lambda self: self)
        master = "spark://far:7077"
        conf = property(lambda self: self)

        def getConf(self):
            return {}

        def get(self, name, default=None):
            return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_root(Cluster())


def test_rows_are_told_apart_whatever_they_come_from(spark, tmp_path):
    """Exploded, joined and united rows: near duplicates go, and nothing else does."""
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(pipeline.STAGES)["minhash_near_dedup"]
    texts = [prose(random.Random(90 + i), 60) for i in range(5)]
    rows_of(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain")).select("doc_id", "text")
    kept = lambda df: sorted((r["doc_id"], r["text"]) for r in stage(spark, df, "").collect())
    whole = sorted(enumerate(texts))
    assert kept(plain) == whole and kept(plain.filter("doc_id >= 0")) == whole
    assert kept(plain.unionByName(plain)) == whole
    exploded = plain.groupBy().agg(F.collect_list(F.struct("doc_id", "text")).alias("l")).select(F.inline("l")).unionByName(plain.limit(1))
    assert kept(exploded) == whole
    three = spark.createDataFrame([(i,) for i in range(3)], "part int").repartition(1)
    three.write.parquet(str(tmp_path / "three"))
    parts = plain.join(spark.read.parquet(str(tmp_path / "three")), F.lit(1) == F.lit(1)).withColumn("text", F.when(F.col("part") == 0, F.col("text")).otherwise(F.concat_ws(" ", F.col("part").cast("string"), F.reverse("text"))))
    parts = parts.select("doc_id", "text")
    assert len(kept(parts)) == 10  # of each document's two reversed copies one goes
    split = plain.select("doc_id", F.explode(F.array("text", F.reverse("text"))).alias("text"))
    assert len(kept(split)) == 10


def test_one_endless_word_takes_constant_memory(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(bpe, "SLICE", 16)

    with open(bpe.vocabulary(), encoding="utf-8") as f:
        enc = bpe.Encoder(f.read())
    peaks = []
    for n in (200_000, 1_000_000):
        text = "ab" * (n // 2)
        tracemalloc.start()
        total = sum(len(ids) for part in enc.slices(text) for _, ids in part)
        peaks.append(tracemalloc.get_traced_memory()[1] - len(text))  # the pre-token at hand
        tracemalloc.stop()
        assert total > n // 10
    assert peaks[1] < 1.3 * peaks[0] + 1e5, peaks


def test_pipeline_stages(spark, tmp_path, shared_ids):
    """Planted copies, toxic texts and repeated passages: exactly these go, whatever ids and columns the rows have."""
    pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    top = base.agg(F.max("doc_id")).first()[0]
    rng = random.Random(4)
    own = [prose(random.Random(50 + i), 120) for i in range(3)]
    passage = " ".join(rng.choice(["ember", "quiet", "lantern", "orbit", "meadow", "copper"]) + str(rng.randrange(99)) for _ in range(30))
    given = [(top + 1, own[0]), (top + 2, own[0]), (top + 3, own[0] + " end"), (top + 3, own[1]), (top + 3, own[1]), (top + 4, own[2] + " " + passage), (top + 5, passage + " " + prose(rng, 30)), (top + 6, None), (top + 7, "")]
    planted = rows_of(spark, [(i, t, "en", "s", len(t or "")) for i, t in given], base.schema)
    docs = odd_columns(base.unionByName(planted))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages, sf = dict(pipeline.STAGES), str(tmp_path)
    out = {}
    for name in ("language_id", "toxicity", "minhash_near_dedup", "suffix_array_dedup"):
        into = docs if name in ("language_id", "toxicity") else rows_of(spark, given).withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).select("doc_id", "text", "lang", "n_chars")
        into = into if name in ("language_id", "toxicity") else odd_columns(into)
        got = stages[name](spark, into, sf)
        assert got.columns == into.columns and got.dtypes == into.dtypes
        out[name] = got.collect()
        assert all(r[c] == f"own {c}" for r in out[name] for c in ODD)
    assert not {top + 6, top + 7} & {r["doc_id"] for r in out["language_id"]}
    bad = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    left = {r["doc_id"] for r in out["toxicity"]}
    fine = {r["doc_id"] for r in labels.filter("toxic = 0").collect()}
    assert len(left & bad) < 0.4 * len(bad) and len(left & fine) > 0.97 * len(fine)
    texts = lambda rows: sorted((r["doc_id"], r["text"] or "") for r in rows)
    assert texts(out["minhash_near_dedup"]) == sorted([(top + 1, own[0]), (top + 3, own[1]), (top + 4, own[2] + " " + passage), (top + 5, given[6][1]), (top + 6, ""), (top + 7, "")])
    cut = {(r["doc_id"], r["n_chars"]): r["text"] for r in out["suffix_array_dedup"]}
    assert top + 2 not in {d for d, _ in cut} and (top + 1, len(own[0])) in cut and passage not in "".join(t or "" for (d, _), t in cut.items() if d == top + 5)
    packed = stages["best_fit_packing"](spark, rows_of(spark, given), sf).collect()
    assert sorted(r["n_tokens"] for r in packed) == sorted(0 if t is None else len(t.encode()) + 1 for _, t in given)


def test_stages_leave_few_tables(spark, tmp_path, monkeypatch):
    """What a stage leaves in the shared folder is on disk while the next ones run: only what its lazy result reads."""
    pipeline = pytest.importorskip("corpus_pipeline")
    monkeypatch.setattr(suffixes, "LARGE", 0, raising=False)
    rng = random.Random(8)
    texts = [prose(rng, 60) for _ in range(40)]
    rows_of(spark, [(i, t) for i, t in enumerate(texts + [t + " end" for t in texts[:20]])]).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    root = common.scratch_root(spark).removeprefix("file://")
    for stage, most in ((pipeline.drop_near_duplicates, 1), (pipeline.drop_repeats, 2)):
        before = set(os.listdir(root))
        assert stage(spark, docs, str(tmp_path)).count() > 0
        assert len(set(os.listdir(root)) - before) <= most


MAIL = "conv_id long, turn long, role string, text string"


def test_quotes_of_a_sentence_and_attribution(spark):
    first = "The meeting is on Monday. Please bring the budget figures. We start at nine."
    rows = [(1, 0, "a", first), (1, 1, "b", "On Mon, Ann wrote:\n\n> Please bring the budget figures.\n\nWill do."),
            (1, 2, "a", "Good.\n\nOn Tue, 3 Feb, Bob\n<b@x> wrote:\n> On Mon, Ann wrote:\n> > We start\n> > at nine.\n> Will do.\n\nSee you."),
            (1, 3, "b", "> lease bring the budget figures\nHalf a word."), (1, 4, "b", "On Wed, nobody wrote:\nNo quote below."),
            (1, 5, "a", "> monday\nOne word."), (1, 6, "a", ">\n> \n"), (1, 7, "c", "On Thu, Al wrote:\n> " + first + "\n> " + first)]
    got = {r["turn"]: r for r in quotes.link(rows_of(spark, rows, MAIL)).collect()}
    assert [got[t]["body"] for t in (1, 2, 4, 6)] == ["Will do.", "Good.\n\n\nSee you.", "On Wed, nobody wrote:\nNo quote below.", ""]
    assert [(got[t]["n_quotes"], got[t]["n_linked"], got[t]["parent_turn"]) for t in range(1, 8)] == [
        (1, 1, 0), (2, 2, 1), (1, 0, None), (0, 0, None), (1, 1, 0), (0, 0, None), (1, 0, None)]
    assert quotes.parse("On Mon, Ann wrote:\n> x", attribution="")[0] == "On Mon, Ann wrote:"


def test_quotes_against_every_stretch(spark):
    """Few words, so that stretches repeat: a passage is linked to the first turn before that holds its words in a row."""
    rng = np.random.default_rng(5)
    said, rows = {}, []
    for turn in range(400):
        own = " ".join(rng.choice(["a", "b", "Ab", "c\u00e9", "d,"], rng.integers(1, 60)))
        source = quotes.normal(said[int(rng.integers(0, turn))]).split() if turn else ["a"]
        at = int(rng.integers(0, len(source)))
        part = source[at: at + int(rng.integers(1, 40))] + (["zz"] if rng.random() < 0.1 else [])
        rows.append((7, turn, "u", "> " + " ".join(part).upper() + "\n" + own))
        said[turn] = own
    got = {r["turn"]: r["parent_turn"] for r in quotes.link(rows_of(spark, rows, MAIL)).collect()}
    norm = {t: f" {quotes.normal(x)} " for t, x in said.items()}
    for _, turn, _, text in rows:
        want = f" {quotes.normal(quotes.parse(text)[1][0][1])} "
        assert got[turn] == next((t for t in range(turn) if want in norm[t]), None), (turn, text)


def test_quotes_in_one_giant_conversation(spark):
    """20,000 messages of one conversation, each quoting part of the one before, and one of a million words."""
    n = 20000
    text = lambda t: F.concat(F.lit("word "), t.cast("string"), F.lit(" of it. Said "), t.cast("string"), F.lit(" times, no more."))
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("u").alias("role"),
                                 F.concat(F.lit("> said "), (F.col("id") - 1).cast("string"), F.lit(" times\n"), text(F.col("id"))).alias("text"))
    long = " ".join(f"w{i % 7919}" for i in range(1000000))
    more = rows_of(spark, [(1, n, "u", long), (1, n + 1, "u", "> " + long[1000:2000000].split(" ", 1)[1].rsplit(" ", 1)[0] + "\nyes")], MAIL)
    got = quotes.link(rows.union(more))
    bad = got.filter((F.col("turn") > 0) & (F.col("turn") < n) & ~F.col("parent_turn").eqNullSafe(F.col("turn") - 1)).count()
    assert bad == 0 and got.filter(f"turn = {n + 1} and parent_turn = {n}").count() == 1
    assert got.agg(F.max("depth")).first()[0] == n - 1


def test_texts_are_told_apart_without_a_cryptographic_hash(spark):
    """A text's hash is made anew in every pass over the texts, so it is a cheap one; null and empty texts are one."""
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "doc_id long, text string")
    told = suffixes.known(df)
    a, b, c, d, e = (r["tid"] for r in told.orderBy("doc_id").collect())
    assert a == c and d == e and len({a, b, d}) == 3
    assert "sha2" not in told._jdf.queryExecution().optimizedPlan().toString()
