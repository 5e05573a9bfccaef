"""The training-data operators against brute force, libraries and exact round trips, with nulls, ties and empty tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.llm import bpe, langid, minhash, nndescent, packing, quotes, sharding, suffixes, tiff, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], DOCS)


WORDS = [f"w{i}" for i in range(60)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = [None, "", " \t\n", "a", "A", "one two", prose(rng, 3000)]
    for _ in range(12):
        t = prose(rng, rng.randint(5, 120))
        out += [t, t]
        for _ in range(3):
            w = t.split()
            for _ in range(max(1, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            out.append(" ".join(w))
    shared = prose(rng, 60)
    out += [prose(rng, 20) + " " + shared + " " + prose(rng, 20) for _ in range(4)] + ["é" * 40, "x" * 30 + "é" * 40, "ñ" * 200]
    return out


def brute_components(texts, width, percent):
    sets = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).split(" ") if t else []
        w = [x for x in (t or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if x]
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in w]
        sets.append({tuple(w[i: i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    comp = list(range(len(texts)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, texts, width):
    rows = minhash.near_duplicates(docs_of(spark, texts), width, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute_components(texts, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def brute_repeats(texts, n=50):
    data = [(t or "").encode() for t in texts]
    first = {}
    for i, b in enumerate(data):
        for p in range(len(b) - n + 1):
            first.setdefault(b[p: p + n], i)
    out = {}
    for i, b in enumerate(data):
        hit = [False] * len(b)
        for p in range(len(b) - n + 1):
            if first[b[p: p + n]] < i:
                hit[p: p + n] = [True] * n
        spans = sum(h and not (k and hit[k - 1]) for k, h in enumerate(hit))
        out[i] = (len(b), sum(hit), spans, hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest())
    return out


@pytest.mark.parametrize("hot", [1 << 16, 2])
def test_repeated_substrings(spark, texts, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rows = suffixes.remove_repeats(docs_of(spark, texts), "digest").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_repeats(texts)


def lines_with_neighbours(n, seed=5):
    """Texts of words of their own around a line that all have; every ninth repeats an earlier one, whole or but for its end."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(4, 9)))
    out = []
    for i in range(n):
        own = [" ".join(word() for _ in range(60)) for _ in range(2)]
        out.append(out[rng.randrange(i)][: rng.choice([None, -70])] if i % 9 == 8 else f"{own[0]} a line that is in every text {own[1]}" + " x" * 60 * (i % 7 == 3))
    return out


@pytest.mark.parametrize(("hot", "light"), [(1 << 15, 1 << 12), (2, 0)])
def test_repeated_substrings_in_slices_of_names(spark, texts, hot, light, monkeypatch):
    for name, value in (("HOT", hot), ("LIGHT", light), ("LARGE", 0), ("SLICES", 3), ("SHARE", 1)):
        monkeypatch.setattr(suffixes, name, value)
    texts = texts + lines_with_neighbours(120)
    rows = suffixes.remove_repeats(docs_of(spark, texts).repartition(5), "digest").collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows} == brute_repeats(texts)
    docs = suffixes.known(docs_of(spark, texts))
    names = suffixes._hot_names(docs.filter(F.octet_length("text") >= 50), 60)
    assert 0 < len(names) < 100  # those of the line, and of its words


def test_repeats_shuffle_less_than_their_text(spark, monkeypatch):
    """No stage writes shuffle of 1.3 bytes a byte of text: sorting samples of all names at once, a row each, took more."""
    monkeypatch.setattr(suffixes, "LARGE", 0, raising=False)
    texts = lines_with_neighbours(4000)
    docs = docs_of(spark, texts)
    store, jvm = spark._jsc.sc().statusStore(), spark.sparkContext._gateway

    def seen():
        stages = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = seen()
    assert suffixes.remove_repeats(docs, "digest").filter("n_removed > 0").count() > 400
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most = max(v for k, v in seen().items() if k not in before)
    assert 0 < most < 1.3 * sum(map(len, texts))


def test_sharding(spark, texts):
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["same text"] * 40).withColumn("doc_id", F.col("doc_id") + 1000))
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    assert all(sorted(r["slot"] for r in x) == list(range(len(x))) for x in by.values())
    assert len({r["shard"] for r in rows if r["doc_id"] >= 1000}) == 1
    assert {r["doc_id"]: r["text_crc32"] for r in rows}[3] == zlib.crc32(b"a")


def test_differencing_balances():
    rng = random.Random(1)
    sizes = [rng.randint(1, 10**6) for _ in range(2000)]
    sums = [0] * 16
    for s, bins in zip(sizes, sharding.differencing([[0] * 15 + [s] for s in sizes]), strict=True):
        assert sorted(bins) == list(range(16))
        sums[bins[15]] += s
    assert max(sums) - min(sums) <= 1e-6 * sum(sums) / 16


def test_packing(spark):
    rng = random.Random(4)
    given = [(i, rng.choice([0, 1, 7, 7, 100, 2048, 2049, 16384, 40000, rng.randint(1, 9000)])) for i in range(400)] + [(None, None)]
    rows = packing.pack(spark.createDataFrame(given, "doc_id long, n_tokens long")).collect()
    total = collections.Counter()
    bins = collections.defaultdict(list)
    for r in rows:
        total[r["doc_id"]] += r["n_tokens"]
        if r["bin"] is not None:
            bins[r["bin"]].append(r)
    assert total == collections.Counter({i: n or 0 for i, n in given})
    for x in bins.values():
        at = 0
        for r in sorted(x, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        fit = min(c for c in packing.CAPACITIES if c >= at)
        assert all(r["bin_tokens"] == at and r["capacity"] == fit for r in x)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, tile, order):
    rng = random.Random(5)
    a, b = bytes(rng.choice(b"aaaab\0\xff") for _ in range(64 * 70 * 3)), bytes(rng.randrange(256) for _ in range(50 * 33))
    for predictor in (1, 2):
        made = tiff.write_tiff([(64, 70, 3, a), (50, 33, 1, b)], compression, predictor, 16, tile, order)
        assert [tiff.read_page(made, t) for t in tiff.directories(made)] == [(64, 70, 3, a), (50, 33, 1, b)]


def test_tiff_columns(spark, texts):
    long = [*texts, "z" * (tiff.PAYLOAD * tiff.PAGE_ROWS + 5)]
    docs = docs_of(spark, long).select("doc_id", "text")
    rows = tiff.read_pages(tiff.encode(docs)).collect()
    assert max(r["page"] for r in rows) == 1
    for r in rows:
        if r["last"]:
            data = (long[r["doc_id"]] or "").encode()
            data += b" " * ((-len(data)) % 192 if data else 192)
            assert (r["bytes_so_far"], r["sha256_so_far"], r["crc32_so_far"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"nothing"))], "id int, media binary")
    assert [(r["page"], r["error"] is not None) for r in tiff.read_pages(bad).collect()] == [(-1, True)] * 2


def test_bpe_matches_library(spark, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    rng = random.Random(6)
    odd = ["it's  a\n\n test<|endoftext|> x", "a" * 20000, "é" * 9000, "=-" * 9000, "".join(rng.choice("thereising") for _ in range(30000)), "漢字😀 \x1c\x85 "]
    every = texts + odd
    rows = bpe.transduce(docs_of(spark, every), bpe.vocabulary(), ["ids", "decoded", "ids_sha256"]).collect()
    for r in rows:
        want = lib.encode(every[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == (every[r["doc_id"]] or "")
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_bpe_stream_is_stable():
    enc = bpe.encoder(open(bpe.vocabulary(), encoding="utf-8").read())
    data = bytes(random.Random(7).choice(b"thereinandation") for _ in range(9000))
    assert [i for ids in enc.stream(data[i: i + 50] for i in range(0, len(data), 50)) for i in ids] == enc.merge(data)


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = docs_of(spark, [None, "", "123 !!"]).withColumn("doc_id", F.col("doc_id") - 10)
    rows = langid.identify(docs.unionByName(extra)).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] >= 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert [(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] < 0] == [("und", 0.0)] * 3
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_learns_interactions():
    rng = np.random.default_rng(8)
    rows, y = [], []
    for _ in range(4000):  # toxic only where terms 1 and 2 meet
        a, b = rng.random() < 0.4, rng.random() < 0.4
        rows.append(np.unique(np.r_[rng.integers(10, 60, 8), [1] * a, [2] * b].astype(np.int64)))
        y.append(float(a and b))
    m = toxicity.train(np.array(y), rows, epochs=12, l1=2.0)
    at = {int(k): i for i, k in enumerate(m["bucket"])}
    assert m["v"][at[1]] @ m["v"][at[2]] > 0.5


def test_toxicity_learns_neutral_pair():
    """Production parameters; toxic where terms 1 and 2 are both there or both missing: neutral each alone."""
    rng = np.random.default_rng(8)
    has = rng.random((6000, 2)) < 0.5
    rows = [np.unique(np.r_[rng.integers(10, 60, 8), [1] * int(a), [2] * int(b)].astype(np.int64)) for a, b in has]
    y = (has[:, 0] == has[:, 1]).astype(float)
    m = toxicity.train(y[:4000], rows[:4000])
    at = {int(k): i for i, k in enumerate(m["bucket"])}
    assert m["v"][at[1]] @ m["v"][at[2]] > 0.5
    right, additive = 0, 0
    for t, r in zip(y[4000:], rows[4000:], strict=True):
        i = [at[k] for k in r.tolist() if k in at]
        x, s = m["v"][i], m["v"][i].sum(axis=0)
        right += (m["bias"] + m["w"][i].sum() + 0.5 * (s @ s - (x * x).sum()) > 0) == (t > 0)
        additive += (m["bias"] + m["w"][i].sum() > 0) == (t > 0)
    assert right / 2000 > 0.9 and additive / 2000 < 0.8


def test_toxicity_keeps_no_vectors_of_chance():
    """Labels that no pair explains: most terms keep nothing, and every held-out row is told right."""
    rng = np.random.default_rng(9)
    rows = [np.unique(np.r_[rng.integers(10, 2000, 60), [1] * int(i % 4 == 0)].astype(np.int64)) for i in range(6000)]
    y = np.array([float(i % 4 == 0) for i in range(6000)])
    m = toxicity.train(y[:4000], rows[:4000])
    at = {int(k): i for i, k in enumerate(m["bucket"])}
    assert len(at) < 500
    for t, r in zip(y[4000:], rows[4000:], strict=True):
        i = [at[k] for k in r.tolist() if k in at]
        x, s = m["v"][i], m["v"][i].sum(axis=0)
        assert (m["bias"] + m["w"][i].sum() + 0.5 * (s @ s - (x * x).sum()) > 0) == (t > 0)


def test_toxicity_sample_takes_toxic_rows_first(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda y, rows, **k: seen.append(y) or {"bias": 0.0})
    docs = docs_of(spark, [f"word{i} and x{i}" for i in range(1000)])
    for toxic, want in ((30, (30, 30)), (500, (30, 30)), (990, (50, 10))):
        labels = spark.createDataFrame([(i, int(i < toxic)) for i in range(1000)], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels, F.lit(True), max_rows=60)
        y = seen.pop()
        assert (sum(y), len(y) - sum(y)) == want
        assert abs(model["bias"] - np.log(toxic / (1000 - toxic) * want[1] / want[0])) < 1e-9
    assert toxicity.MAX_ROWS >= 20000


def test_toxicity_scores(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.rate(docs.select("doc_id", "text").limit(10000), labels).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r["toxic"]: r["p"] for r in got}
    assert share[1] > 0.6 and share[0] < 0.02


def test_nearest(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 16))
    x[50] = x[100]
    data = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nndescent.nearest(df, lambda i: i % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(600), d))[:10]) & {i for i, _ in found})
        assert all(abs(d[i] - s) < 1e-9 for i, s in found) and len(found) == 10
    assert hit / 60 >= 0.9 and got[100][0] == (50, 0.0)


def test_search_opens_a_hubs_own_neighbours(spark):
    """Nodes 1..24 are linked to the hub 0 alone, which a thousand distant nodes keep as a neighbour too."""
    place = {0: 0.0} | {i: 0.1 * i for i in range(1, 25)} | {i: float(i) for i in range(100, 1100)}
    nodes = spark.createDataFrame([(i, [x, 0.0]) for i, x in place.items()], "node long, v array<double>")
    edges = [(0, i, place[i]) for i in range(1, 25)] + [(i, 0, x) for i, x in place.items() if i]
    graph = spark.createDataFrame(edges, "node long, near long, dist double")
    asked = spark.createDataFrame([(0, 0, [0.0, 0.0])], "query_id long, node long, q array<double>")
    rows = nndescent.search(asked, nodes, nodes.select("node", F.col("node").alias("id")), graph, 10).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 11))


def test_quotes(spark):
    rows = [(1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "a", "> hello THERE\nFine."), (1, 2, "user", "> > Hello there.\n> Fine.\n\nGood."), (1, 3, "a", "> unknown words\nOh."),
            (1, 4, "user", None), (2, 0, "user", "> Hello there.\nx"), (None, None, None, "> q"), (1, 1, "a", "> hello THERE\nFine.")]
    out = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(out) == len(rows)
    got = {(r["conv_id"], r["turn"]): r for r in out}
    assert got[1, 1]["parent_turn"] == 0 and got[1, 1]["body"] == "Fine."
    assert (got[1, 2]["parent_turn"], got[1, 2]["root_turn"], got[1, 2]["depth"], got[1, 2]["n_linked"]) == (1, 0, 2, 2)
    assert got[1, 3]["parent_turn"] is None and got[2, 0]["parent_turn"] is None and got[1, 4]["body"] == ""
    assert sorted(r["position"] for r in out if r["conv_id"] == 1) == list(range(6))
    order = [r["turn"] for r in sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [0, 1, 1, 2, 3, 4]


def test_quotes_of_several_lines(spark):
    first = "A one two\nA three four\nA five\n\nB one\nB two three\n\nThanks"
    asks = ["> A one two\n> A three four\n> A five\nx", "> A three four\n> A five\nx", "> A one two A\n> three four A five\nx",
            "> " + first.replace("\n", "\n> ") + "\nx", "> A five\n> B one\nx", "> B two three\nx", "> A one\nx", "> A one two\n> A five\nx"]
    rows = [(1, 0, "user", "Thanks"), (1, 1, "a", first)] + [(1, i + 2, "user", t) for i, t in enumerate(asks)]
    got = {r["turn"]: r for r in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [got[i + 2]["parent_turn"] for i in range(len(asks))] == [1] * 7 + [None]
    assert [got[i + 2]["n_linked"] for i in range(len(asks))] == [1, 1, 1, 3, 1, 1, 1, 0]


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert minhash.near_duplicates(none).count() == suffixes.remove_repeats(none).count() == sharding.shard(none).count() == 0
    assert packing.pack(packing.byte_tokens(none)).count() == tiff.read_pages(tiff.encode(none.select("doc_id", "text"))).count() == 0
    assert bpe.transduce(none, bpe.vocabulary(), ["n_tokens"]).count() == langid.identify(none).count() == 0
    assert toxicity.rate(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert quotes.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert nndescent.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).count() == 0


def test_pipeline_small(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.collect()}
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns and {r["doc_id"] for r in docs.collect()} <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
