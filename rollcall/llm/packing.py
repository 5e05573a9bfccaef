"""Variable-capacity best-fit packing: several permitted sequence lengths are planned jointly.

Item lengths are bounded by the largest capacity, so the corpus is planned from its length histogram: at most that many
rows, whatever the corpus. Lengths go in descending order; all items of one length are placed together into the tightest
open bins, and new bins open at the capacity of least cost. At the end each bin shrinks to the least capacity that holds
its contents. Items find their bin by (length, rank within the length) alone, so nothing else leaves the executors.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITIES = (2048, 4096, 8192, 16384)
FIXED_COST = 64  # of a sequence, in tokens, besides its capacity
SQUARE_COST = 1 / 65536  # of a capacity's square: attention


def plan(histogram: dict[int, int], capacities=CAPACITIES, fixed_cost: float = FIXED_COST, square_cost: float = SQUARE_COST) -> list[tuple]:
    """{length: items} -> rows (length, rank_from, rank_to, per_bin, offset, first_bin, used, capacity).

    Items rank_from <= r < rank_to of that length: bin first_bin + (r - rank_from) // per_bin, starting at
    offset + (r - rank_from) % per_bin * length. Open bins that hold the same lengths are one group (rest, first bin,
    number, placements); a group splits when a placement doesn't fill all of it, so there are at most a few groups a length.
    """
    caps = sorted(capacities)
    groups: dict[int, list] = {}  # by rest: [(first bin, number, used, placements)]
    rests: list[int] = []  # the keys of groups, sorted
    closed: list[tuple] = []
    bins = 0
    lengths = sorted((n for n in histogram if histogram[n] > 0), reverse=True)
    behind = sum(n * histogram[n] for n in lengths)  # tokens not yet placed
    shortest = lengths[-1] if lengths else 0

    def put(rest: int, group: tuple) -> None:
        if rest < shortest:
            closed.append(group)
            return
        if rest not in groups:
            groups[rest] = []
            bisect.insort(rests, rest)
        groups[rest].append(group)

    def split(group: tuple, number: int) -> tuple[tuple, tuple]:
        first, m, used, placed = group
        return (first, number, used, placed), (first + number, m - number, used, [(n, q, o, r + number * q) for n, q, o, r in placed])

    for n in lengths:
        left, rank = histogram[n], 0
        behind -= n * left
        while left:
            i = bisect.bisect_left(rests, n)
            if i < len(rests):  # the tightest bins that hold it
                rest = rests[i]
                group = groups[rest].pop()
                if not groups[rest]:
                    del groups[rest]
                    rests.pop(i)
            else:  # open bins where a token costs least, counting what shorter items can still fill
                def cost(c):
                    q = min(c // n, left)
                    number = -(-left // q)
                    return (fixed_cost + c + square_cost * c * c) / (q * n + min(c - q * n, behind / number))

                rest = min((c for c in caps if c >= n), key=lambda c: (cost(c), c))
                number = -(-left // (rest // n))
                group = (bins, number, 0, [])
                bins += number
            q = min(rest // n, left)
            number = min(group[1], left // q)
            if number < group[1]:
                group, other = split(group, number)
                put(rest, other)
            first, m, used, placed = group
            put(rest - q * n, (first, m, used + q * n, [*placed, (n, q, used, rank)]))
            left -= m * q
            rank += m * q
    for held in groups.values():
        closed += held
    return [(n, r, r + m * q, q, o, first, used, caps[bisect.bisect_left(caps, used)])
            for first, m, used, placed in closed if placed for n, q, o, r in placed]


_PLAN = "length int, rank_from long, rank_to long, per_bin int, start int, first_bin long, used int, capacity int"


def pack(items: DataFrame, id_col: str = "doc_id", length: str = "n_tokens", capacities=CAPACITIES) -> DataFrame:
    """items: one row a document with its number of tokens -> one row a piece: id_col, piece, n_tokens, bin, start,
    bin_tokens, capacity.

    A document longer than the largest capacity is cut into full pieces and a rest. Documents with no tokens (0 or null)
    take no room: they get bin null, start null. Repeated rows are packed as often as they occur; ties are broken by
    id (null first). Other columns are ignored. An empty table gives no rows.
    """
    spark = items.sparkSession
    top = max(capacities)
    size = F.coalesce(F.col(length), F.lit(0)).cast("long")
    cut = items.select(F.col(f"`{id_col}`").alias("_id"), size.alias("_n"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / top) - 1, F.lit(0)).cast("int"))).alias("piece"))
    cut = cut.select("_id", "piece", F.least(F.col("_n") - F.col("piece") * F.lit(top), F.lit(top)).cast("int").alias("n_tokens"))
    placed = common.save(common.ranked(cut, ["n_tokens"], ["_id", "piece"], "rank"))
    # At most `top` lengths, so the histogram and the plan have a proven bound.
    counts = {r["n_tokens"]: r["n"] for r in placed.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect() if r["n_tokens"]}
    rows = F.broadcast(spark.createDataFrame(plan(counts, capacities), _PLAN))
    hit = (placed.n_tokens == rows.length) & (placed["rank"] >= rows.rank_from) & (placed["rank"] < rows.rank_to)
    nth = F.col("rank") - F.col("rank_from")
    return placed.join(rows, hit, "left").select(
        F.col("_id").alias(id_col), "piece", "n_tokens", (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).alias("bin"),
        (F.col("start") + nth % F.col("per_bin") * F.col("n_tokens")).cast("int").alias("start"), F.col("used").alias("bin_tokens"), "capacity")


def byte_tokens(docs: DataFrame) -> DataFrame:
    """doc_id and n_tokens of a byte-level model: the UTF-8 bytes of the text and one end mark; none for null."""
    return docs.select("doc_id", F.coalesce(F.octet_length("text") + F.lit(1), F.lit(0)).cast("long").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4 over documents."""
    return pack(byte_tokens(common.documents(spark, sf_dir)))
