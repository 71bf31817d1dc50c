"""Sharding by minimax contiguous partition.

Documents with equal texts form an atomic group. Groups are ordered by the digest
of their text, and running sums of bytes give each group an end. The smallest
shard capacity is found by binary search, each capacity checked by greedy cuts.

The driver never sees all ends. It gets at most ``LIMIT`` buckets of ends, each by
its smallest and largest end, from which greedy cuts have exact lower and upper
bounds. These bound the capacity and each cut; the next pass buckets only the
ends between the bounds, until every bucket is one end. Each pass narrows them
by two orders of magnitude. The same is done from the back, so that cuts can be
put near equal sizes without exceeding the smallest capacity.

Defined results: a null text counts as empty (size 1, CRC 0); repeated rows are
separate rows of one group; rows without id sort first in their group; with
fewer groups than shards some shards stay empty; an empty table gives an empty
table. Of the input only ``carry`` (default: the id) is kept.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.ordered import prefix_sums

from .common import materialise

LIMIT = 50_000


def cut_bounds(low_ends: np.ndarray, high_ends: np.ndarray, shards: int, cap: int) -> tuple[list[int], list[int]]:
    """Lower and upper bounds of the greedy cuts at capacity ``cap``, from the smallest
    and largest end of each bucket. They agree if every bucket is one end."""
    low, high = [0], [0]
    for _ in range(shards):
        reach = low[-1] + cap
        i, j = (int(np.searchsorted(x, reach, "right")) for x in (high_ends, low_ends))
        low.append(max(low[-1], *(int(x[k - 1]) for x, k in ((high_ends, i), (low_ends, j)) if k), 0))
        reach = high[-1] + cap
        j = int(np.searchsorted(low_ends, reach, "right"))
        high.append(max(high[-1], min(reach, int(high_ends[j - 1])) if j else 0))
    return low, high


def smallest(ok, low: int, high: int) -> int:
    """Smallest value in [low, high] with ok(value); ok is monotone and ok(high) holds."""
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if ok(mid) else (mid + 1, high)
    return low


def buckets_between(ends: DataFrame, spans: list[tuple[int, int]], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest end of each bucket of the ends inside ``spans``; at most about ``limit``."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    width = max(1, -(-sum(b - a + 1 for a, b in merged) // limit))
    inside = F.lit(False)
    for a, b in merged:
        inside = inside | F.col("end").between(a, b)
    rows = ends.where(inside).groupBy(F.expr(f"end div {width}").alias("k")).agg(F.min("end").alias("lo"), F.max("end").alias("hi")).collect()
    rows.sort(key=lambda r: r.lo)
    return np.array([r.lo for r in rows], np.int64), np.array([r.hi for r in rows], np.int64)


def minimax_cuts(ends: DataFrame, total: int, shards: int, limit: int = LIMIT) -> tuple[int, list[int]]:
    """(capacity, cuts): the smallest capacity for ``shards`` contiguous shards and one
    partition that keeps it, with cuts as near to equal sizes as it allows."""
    spans, low_cap, high_cap, before = [(1, total)], -(-total // shards), total, None
    while True:
        covered = sum(b - a + 1 for a, b in spans)
        if before is not None and 2 * covered > before:
            limit *= 2  # bounds that narrow too little need finer buckets
        before = covered
        lo, hi = buckets_between(ends, [*spans, (total, total)], limit)
        back_lo, back_hi = np.unique(np.append(total - hi, total)), np.unique(np.append(total - lo, total))
        low_cap = smallest(lambda c: cut_bounds(lo, hi, shards, c)[1][-1] >= total, low_cap, high_cap)
        high_cap = smallest(lambda c: cut_bounds(lo, hi, shards, c)[0][-1] >= total, low_cap, high_cap)
        if np.array_equal(lo, hi):
            break
        spans = []
        for mirrored, (a, b) in ((False, (lo, hi)), (True, (back_lo, back_hi))):
            first, last = cut_bounds(a, b, shards, low_cap)[0], cut_bounds(a, b, shards, high_cap)[1]
            pairs = [(x, y) for x, y in zip(first, last, strict=True)]
            spans += [(total - y, total - x) if mirrored else (x, y) for x, y in pairs]
        spans = [(max(a, 1), b) for a, b in spans if b >= 1]
    cap = high_cap
    forward, backward = cut_bounds(lo, hi, shards, cap)[0], [total - x for x in cut_bounds(back_lo, back_hi, shards, cap)[0]][::-1]
    ideal = [total * j // shards for j in range(1, shards)]
    near = ends.agg(*[F.max(F.when(F.col("end") <= t, F.col("end"))) for t in ideal], *[F.min(F.when(F.col("end") >= t, F.col("end"))) for t in ideal]).first() if ideal else []
    known = sorted({*forward, *(max(x, 0) for x in backward), *(x for x in near if x is not None)})
    cuts = [0]
    for j in range(1, shards):
        least = max(cuts[-1], backward[j])
        cuts.append(min((x for x in {*known, cuts[-1]} if least <= x <= cuts[-1] + cap), key=lambda x: abs(x - ideal[j - 1])))
    return cap, [*cuts[1:], total]


def shard_documents(docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry, size, text_crc32, shard, slot for every row of ``docs``."""
    carry = [id_col] if carry is None else carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialise(docs.select(*carry, F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("_group")))
    placed = materialise(prefix_sums(rows, [F.col("_group"), F.col("_id")], {"_end": F.col("size"), "_rank": F.lit(1)}))
    ends = materialise(placed.groupBy("_group").agg(F.max("_end").alias("end")).select("end"))
    total = ends.agg(F.max("end")).first()[0]
    if total is None:
        return placed.select(*carry, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    cuts = minimax_cuts(ends, total, shards)[1]
    before = placed.agg(*[F.coalesce(F.max(F.when(F.col("_end") <= c, F.col("_rank"))), F.lit(0)) for c in cuts[:-1]]).first() if shards > 1 else ()
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("_end") > c).cast("int")
    placed = placed.withColumn("shard", shard)
    first = F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in (0, *before)]), F.col("shard") + 1)
    return placed.select(*carry, "size", "text_crc32", "shard", (F.col("_rank") - 1 - first).alias("slot"))
