"""Near-duplicate documents by HyperMinHash.

Every document gets ``bands * rows`` registers. A register holds, for one hash
function, the leading-zero count (6 bits) and the next ten mantissa bits of the
smallest hash of the document's shingles. Bands of ``rows`` registers are the
bucket keys. The register match rate, less the rate at which different minima
share a register, estimates Jaccard similarity; pairs within six standard
deviations of the threshold are confirmed on the full shingle sets.

Documents with equal shingle sets are one class and enter as its smallest id.
Each bucket compares its members with two hubs (stars), its smallest and largest id:
buckets of one group share their hubs, so most pairs repeat and fall together.
What the stars leave apart is settled exactly: in buckets that still hold
several components (one bucket of those with the same members), the members outside
the largest component are compared with all members on their full sets, in cells of
about ``cell`` by ``cell`` rows. Only links that join two components leave a task, so
its output grows with its rows, however many pairs are alike.

Defined results: a null or empty text, or one without words, has no shingles
and is linked with nothing; a text with fewer than ``shingle`` words is one
shingle. A row without id keeps a null component and is kept. Rows that repeat
an id count as one document. Other columns of the input are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, WordHash, as_long, materialise, mix

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MANTISSA = 10
#: Up to this many ids (16 MB) a list of documents is broadcast; beyond, joined by shuffle.
BROADCAST_IDS = 2_000_000


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased."""

    def __init__(self, size: int):
        self.size, self.words, self.rolling = size, WordHash(), Rolling()

    def __call__(self, text: bytes | None) -> np.ndarray:
        h = self.words.of((text or b"").translate(LOWER).split())
        return np.unique(self.rolling.windows(h, min(self.size, len(h)))) if len(h) else h


def registers(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: one per odd multiplier (a permutation of 32-bit hashes)."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.concatenate([(short[None, :] * odd[i:i + 8, None]).min(axis=1) for i in range(0, len(odd), 8)])
    fraction, exponent = np.frexp(np.maximum(low, 1).astype(np.float64))
    zeros = 32 - exponent
    return (zeros * 2**MANTISSA + ((fraction - 0.5) * 2**(MANTISSA + 1)).astype(np.int64)).astype("<u2")


def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that two different minima of n and m hashes share a register: equal
    leading-zero counts, then equal mantissa bits."""
    z = np.arange(64)
    high, low = 2.0**-z, 2.0**-(z + 1)
    with np.errstate(under="ignore"):
        p = [(1 - low[None, :]) ** x[:, None] - (1 - high[None, :]) ** x[:, None] for x in (n, m)]
    return (p[0] * p[1]).sum(axis=1) * 2.0**-MANTISSA


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of rows of registers."""
    c = collision_rate(n.astype(float), m.astype(float))
    return ((a == b).mean(axis=1) - c) / (1 - c)


def sketches(docs: DataFrame, shingle: int, n_registers: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, lo, hi (128-bit identity of the set), regs for every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, odd = Shingler(shingle), multipliers(n_registers)
        for batch in batches:
            n, lo, hi, regs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()):
                s = of(text.as_py())
                n.append(len(s))
                lo.append(int(mix(s, 11).sum().view(np.int64)) if len(s) else 0)
                hi.append(int(mix(s, 12).sum().view(np.int64)) if len(s) else 0)
                regs.append(registers(s, odd).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), pa.array(regs, pa.binary())], ["id", "n", "lo", "hi", "regs"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, n long, lo long, hi long, regs binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, shingles of the documents whose id is in ``ids`` (id, distinct)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Shingler(shingle)
        for batch in batches:
            sets = [as_long(of(t.as_py())) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    ids = materialise(ids)
    small = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small, "id", "left_semi")
    return materialise(rows.mapInArrow(run, "id long, shingles array<long>"))


def likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate reaches ``least``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
                good = estimate(a, b, batch.column(4).to_numpy(), batch.column(5).to_numpy()) >= least
                yield batch.select(["a", "b"]).filter(pa.array(good))

    ra, rb = (reps.select(F.col("id").alias(x), F.col("regs").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    return pairs.join(ra, "a").join(rb, "b").select("a", "b", "ra", "rb", "na", "nb").mapInArrow(run, "a long, b long").distinct()


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = np.intersect1d(s, t, assume_unique=True).size
    return 100 * both >= percent * (len(s) + len(t) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(s.values.to_numpy(), t.values.to_numpy(), percent) for s, t in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    sa, sb = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    return pairs.join(sa, "a").join(sb, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest linked id) for every id in ``links`` (a, b).

    Alternating large-star and small-star steps: only minima and joins, no
    neighbour lists, so a hub may have any number of links."""
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()


def unsettled(buckets: DataFrame, comps: DataFrame, cell: int) -> DataFrame:
    """Rows (key, id, comp, mi, pi, probe) of the cells of every bucket with several
    components; buckets with the same members are compared once."""
    labelled = buckets.join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"x{i}") for i in (3, 4)]
    per = labelled.groupBy("key", "comp").agg(F.count("*").alias("c"), *marks)
    mixed = per.groupBy("key").agg(F.count("*").alias("k"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("top"), *(F.bit_xor(x).alias(x) for x in ("x3", "x4")))
    mixed = mixed.where("k > 1").groupBy("m", "x3", "x4").agg(F.min("key").alias("key"), F.min_by("top", "key").alias("top"))
    mixed = mixed.select("key", "m", F.col("top.comp").alias("main"), (F.col("m") - F.col("top.c")).alias("p"))
    rows = materialise(labelled.join(mixed, "key"))
    cm, cp = F.ceil(F.col("m") / cell), F.ceil(F.col("p") / cell)
    mine = rows.withColumn("mi", F.pmod(F.xxhash64("id", F.lit(1)), cm)).withColumn("pi", F.explode(F.sequence(F.lit(0).cast("long"), cp - 1))).withColumn("probe", F.lit(False))
    other = rows.where("comp <> main").withColumn("pi", F.pmod(F.xxhash64("id", F.lit(2)), cp)).withColumn("mi", F.explode(F.sequence(F.lit(0).cast("long"), cm - 1))).withColumn("probe", F.lit(True))
    keep = ["key", "id", "comp", "mi", "pi", "probe"]
    return mine.select(keep).unionByName(other.select(keep))


class Forest:
    """Disjoint sets of component ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        path = []
        while (above := self.up.get(x, x)) != x:
            path.append(x)
            x = above
        for y in path:
            self.up[y] = x
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def cell_links(pdf: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links on full sets between components of the cells' rows, one for each joining:
    every probe counts what it shares with all members through their sorted shingles."""
    forest, out = Forest(), []
    pdf = pdf.sort_values(["key", "mi", "pi", "probe"], kind="stable")
    cell_of = pdf[["key", "mi", "pi"]].to_numpy()
    edge = np.concatenate([[0], np.nonzero((cell_of[1:] != cell_of[:-1]).any(axis=1))[0] + 1, [len(pdf)]])
    probe, comp, ids, sets = (pdf[c].to_numpy() for c in ("probe", "comp", "id", "shingles"))
    for start, end in zip(edge[:-1], edge[1:], strict=True):
        mid = start + int(np.searchsorted(probe[start:end], True))
        if mid in (start, end):
            continue
        n = np.array([len(s) for s in sets[start:mid]])
        tokens = np.concatenate(list(sets[start:mid]))
        order = np.argsort(tokens, kind="stable")
        owner, tokens = np.repeat(np.arange(len(n)), n)[order], tokens[order]
        for i in range(mid, end):
            own = sets[i]
            lo, hi = np.searchsorted(tokens, own, "left"), np.searchsorted(tokens, own, "right")
            c = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())
            both = np.bincount(owner[at], minlength=len(n))
            good = np.nonzero((100 * both >= percent * (n + len(own) - both)) & (comp[start:mid] != comp[i]))[0]
            out += [(ids[i], ids[start + j]) for j in good.tolist() if forest.join(int(comp[i]), int(comp[start + j]))]
    return out


#: Shingles of the rows that one task call compares, about 32 MB.
BIN_SHINGLES = 4_000_000


def remainder_links(docs: DataFrame, reps: DataFrame, buckets: DataFrame, comps: DataFrame, percent: int, cell: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Links that the stars missed: they join all components that a link joins."""
    cells = materialise(unsettled(buckets, comps, cell))
    load = cells.join(reps.select("id", "n"), "id").agg(F.sum("n")).first()[0] or 0
    # Many small cells share a bin: one call for each bin.
    bins = max(1, load // BIN_SHINGLES)
    sets = shingle_sets(docs, cells.select("id").distinct(), shingle, id_col, text_col)
    rows = cells.join(sets, "id").withColumn("bin", F.pmod(F.xxhash64("key", "mi", "pi"), F.lit(bins)))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(cell_links(pdf, percent), columns=["a", "b"]).astype("int64")

    return rows.groupBy("bin").applyInPandas(settle, "a long, b long")


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, bands: int = 51, rows: int = 5, cell: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept for every row of ``docs``.

    With the defaults a pair at exactly the threshold shares no bucket with
    probability 2e-9, and its estimate falls under the margin with 1e-9."""
    k = bands * rows
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    all_rows = materialise(sketches(docs, shingle, k, id_col, text_col))
    classes = all_rows.where("n > 0 and id is not null").groupBy("lo", "hi", "n").agg(F.min("id").alias("rep"))
    classes = materialise(classes)
    reps = materialise(all_rows.where("n > 0").join(classes, ["lo", "hi", "n"]).where("id = rep").dropDuplicates(["id", "lo", "hi", "n"]).select("id", "n", "regs"))
    width = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.substring(F.col("regs"), b * width + 1, F.lit(width))))
    buckets = reps.select("id", F.explode(keys).alias("key")).distinct()
    hubs = buckets.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("h1"), F.max("id").alias("h2")).where("c > 1").drop("c")
    buckets = materialise(buckets.join(hubs, "key"))
    stars = buckets.select(F.explode(F.array(F.struct("id", F.col("h1").alias("h")), F.struct("id", F.col("h2").alias("h")))).alias("p")).select("p.*").where("id <> h")
    stars = stars.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct()
    pairs = materialise(likely(stars, reps, least))
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), shingle, id_col, text_col)
    links = materialise(confirmed(pairs, sets, percent))
    comps = materialise(components(links))
    rest = materialise(remainder_links(docs, reps, buckets.select("key", "id"), comps, percent, cell, shingle, id_col, text_col))
    if not rest.isEmpty():
        comps = materialise(components(links.unionByName(rest)))
    by_class = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("lo", "hi", "n", F.coalesce("component", "rep").alias("component"))
    out = all_rows.join(by_class, ["lo", "hi", "n"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
