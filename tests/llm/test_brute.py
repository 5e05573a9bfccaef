"""Queries whose results SQL can't express, held against plain loops over the same rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from rollcall.llm import packing, sharding, tiff

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def cost(caps):
    return sum(packing.FIXED_COST + c + packing.SQUARE_COST * c * c for c in caps)


def best_fit(lengths):
    """One item after the other into the tightest open bin; a new bin opens where a token costs least. Used tokens by bin."""
    caps, bins, left = sorted(packing.CAPACITIES), [], Counter(lengths)
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0] - b[1])
        else:
            behind = sum(k * m for k, m in left.items() if k < n)

            def price(c):
                q = min(c // n, left[n])
                return cost([c]) / (q * n + min(c - q * n, behind / -(-left[n] // q)))

            b = [min((c for c in caps if c >= n), key=lambda c: (price(c), c)), 0]
            bins.append(b)
        b[1] += n
        left[n] -= 1
    return [b[1] for b in bins]


@pytest.mark.parametrize("seed", range(6))
def test_packing_costs_what_literal_best_fit_does(seed):
    rng = random.Random(seed)
    kinds = [rng.randint(1, 16384) for _ in range(rng.choice([3, 40]))]
    lengths = [rng.choice(kinds) if rng.random() < 0.7 else min(16384, int(rng.expovariate(1 / 900)) + 1) for _ in range(500)]
    used = {}
    for length, lo, hi, per_bin, start, first, total, cap in packing.plan(Counter(lengths)):
        for b in range(first, first - (lo - hi) // per_bin):
            assert used.setdefault(b, (total, cap)) == (total, cap) and start + per_bin * length <= cap
    shrunk = [min(c for c in packing.CAPACITIES if c >= u) for u in best_fit(lengths)]
    assert sum(t for t, _ in used.values()) == sum(lengths)
    assert cost([c for _, c in used.values()]) <= 1.02 * cost(shrunk)


def test_media_of_every_document(spark, texts):
    rows = {r["doc_id"]: r for r in tiff.query(spark, SF).collect()}
    assert sorted(rows) == sorted(texts)
    for i, text in texts.items():
        payload = text + b" " * (-len(text) % 192 if text else 192)
        n = len(payload)
        mean = sum(payload) / n
        dev = (sum(x * x for x in payload) / n - mean * mean) ** 0.5
        ranges = Counter(x // 32 for x in payload)
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        got = [float(x) for x in r["feature"].split(",")]
        assert len(got) == 10 and all(abs(a - b) <= 1e-4 for a, b in zip(got, [mean, dev, *(ranges[k] / n for k in range(8))], strict=True))


def test_shards_of_all_documents(spark, texts):
    """Equal texts together, gapless slots in order, and sums as near as the largest groups allow."""
    rows = sharding.query(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts) and {r["law"] for r in rows} == {"bytes"}
    groups, sums, where = Counter(), Counter({k: 0 for k in range(16)}), {}
    for r in rows:
        text = texts[r["doc_id"]]
        assert (r["size"], r["text_crc32"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), None)
        groups[text] += r["size"]
        sums[r["shard"]] += r["size"]
        assert where.setdefault(text, r["shard"]) == r["shard"]
    for k in range(16):
        own = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == k)
        assert own == list(enumerate(sorted(d for _, d in own)))
    # Greedy: every group, largest first, into the lightest shard.
    greedy = [0] * 16
    for size in sorted(groups.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += size
    assert max(sums.values()) - min(sums.values()) <= max(greedy) - min(greedy)
