"""Benchmark decontamination by winnowing.

Of every run of consecutive k-grams that spans ``window`` words the smallest hash
is kept as a fingerprint (all equal ones on ties), in documents and in benchmark
items alike, so two texts that share ``window`` words share a fingerprint at the
same offset. Fingerprints of documents and items are joined on their hash, and
each hit is extended over the words to the left and right, as far as a window
holding the fingerprint can reach; a run of at least ``window`` equal words is a
hit. An item of fewer words is one window: its whole hash is its fingerprint.

Before the join, documents drop fingerprints that no item has. Tasks get the
items' hashes for that in a bit table of fixed size (``2**BITS`` bits, 2 MB),
whatever the size of the benchmark; the join itself is exact.

Defined results: a null or empty text or one without words has no words and no
hit; an empty benchmark hits nothing; items with equal texts are all listed;
items without id count as the string "null"; repeated rows are judged one by
one. Other columns of either table are not read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHash, as_long, ddl, materialise, mix, sliding_min

#: Bytes of words: A-Z become a-z; digits, a-z and all non-ASCII bytes stay; the rest are gaps.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
BITS = 24


def fingerprints(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions of the k-grams that are the smallest of some ``run`` consecutive ones."""
    if len(grams) < run:
        return np.zeros(0, np.int64)
    low = sliding_min(grams, run)
    pad = np.zeros(run - 1, np.uint64)
    highest = ~sliding_min(~np.concatenate([pad, low, pad]), run)
    return np.nonzero(grams == highest)[0]


class Seeds:
    """(key, position, length) of the fingerprints of a text's words, with the word
    hashes around each: ``reach`` to the left, nearest first, and to the right."""

    def __init__(self, window: int, k: int):
        self.window, self.k, self.words, self.rolling = window, k, WordHash(), Rolling()

    def of(self, text: bytes | None) -> np.ndarray:
        return self.words.of((text or b"").translate(WORD_BYTES).split())

    def keys(self, h: np.ndarray, n: int) -> np.ndarray:
        return mix(self.rolling.windows(h, n), n)

    def long(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = self.keys(h, self.k)
        at = fingerprints(grams, self.window - self.k + 1)
        return at, grams[at]

    def around(self, h: np.ndarray, at: np.ndarray) -> tuple[list, list]:
        h, reach = as_long(h), self.window - self.k
        return [h[max(p - reach, 0):p][::-1] for p in at], [h[p + self.k:p + self.k + reach] for p in at]


SEED = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))])
SEED_SQL = "array<struct<key: long, at: int, size: int, left: array<long>, right: array<long>>>"


def seed_rows(keys: np.ndarray, at: np.ndarray, size: int, left: list | None = None, right: list | None = None) -> list[dict]:
    n = len(at)
    return [{"key": int(a), "at": int(b), "size": size, "left": c, "right": d} for a, b, c, d in zip(as_long(keys), at, left or [None] * n, right or [None] * n, strict=True)]


def item_seeds(benchmark: DataFrame, window: int, k: int, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = Seeds(window, k)
        for batch in batches:
            out = []
            for text in batch.column(1).cast(pa.binary()):
                h = seeds.of(text.as_py())
                if len(h) >= window:
                    at, keys = seeds.long(h)
                    out.append(seed_rows(keys, at, k, *seeds.around(h, at)))
                else:
                    out.append(seed_rows(seeds.keys(h, len(h)), np.zeros(1, int), len(h)) if len(h) else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(SEED))], ["item", "seeds"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("text"))
    rows = rows.mapInArrow(run, f"item string, seeds {SEED_SQL}")
    return materialise(rows.select("item", F.explode("seeds").alias("s")).select("item", "s.*"))


def bit_table(keys: DataFrame) -> bytes:
    """Bits at the top ``BITS`` bits of the keys, compressed; tables of the tasks are
    merged slice by slice, so no task holds more than one table."""
    slices, bits = 16, BITS

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2**bits, bool)
        for batch in batches:
            table[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        for i, part in enumerate(table.reshape(slices, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(part).tobytes()], pa.binary())], ["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = np.frombuffer(x, np.uint8)
                tables[i] = tables[i] | part if i in tables else part
        for i, x in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(x.tobytes(), 1)], pa.binary())], ["slice", "bits"])

    marked = keys.mapInArrow(mark, "slice int, bits binary").repartition(slices, "slice").mapInArrow(merge, "slice int, bits binary")
    out = np.zeros((slices, 2**bits // slices // 8), np.uint8)
    for r in marked.collect():
        out[r.slice] |= np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def candidates(docs: DataFrame, packed: bytes, lengths: list[int], window: int, k: int, text_col: str, carry: list[str]) -> DataFrame:
    """carry, n_words, seeds of every row: fingerprints whose bit an item has set."""
    bits = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, table = Seeds(window, k), np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8)).view(bool)

        def known(keys: np.ndarray) -> np.ndarray:
            return np.nonzero(table[keys >> np.uint64(64 - bits)])[0]

        for batch in batches:
            n, out = [], []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
                h = seeds.of(text.as_py())
                n.append(len(h))
                at, keys = seeds.long(h)
                keep = known(keys)
                rows = seed_rows(keys[keep], at[keep], k, *seeds.around(h, at[keep])) if len(keep) else []
                for size in lengths:
                    if len(h) >= size and len(keep := known(keys := seeds.keys(h, size))):
                        rows += seed_rows(keys[keep], keep, size)
                out.append(rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(out, pa.list_(SEED))], [*carry, "n_words", "seeds"])

    schema = ", ".join(x for x in (ddl(docs, carry), f"n_words long, seeds {SEED_SQL}") if x)
    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def equal_run(a: str, b: str, reach: int) -> Column:
    """How many of the first ``reach`` elements of two arrays agree."""
    so_far, total = F.lit(True), F.lit(0)
    for i in range(reach):
        so_far = so_far & F.coalesce(F.get(a, F.lit(i)) == F.get(b, F.lit(i)), F.lit(False))
        total = total + so_far.cast("int")
    return total


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, k: int = 5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents has carry, n_words, row; hits has row, start, end, item."""
    carry = [c for c in docs.columns if c not in {"n_words", "seeds", "row", "n_hit", "items", "contaminated"}] if carry is None else carry
    items = item_seeds(benchmark, window, k, item_col, item_text_col)
    lengths = sorted(r[0] for r in items.where("left is null").select("size").distinct().collect())
    rows = materialise(candidates(docs, bit_table(items.select("key")), lengths, window, k, text_col, carry).withColumn("row", F.monotonically_increasing_id()))
    found = rows.select("row", F.explode("seeds").alias("s")).select("row", "s.*")
    met = found.join(items.select("key", "item", F.col("size").alias("i_size"), F.col("left").alias("i_left"), F.col("right").alias("i_right")), "key").where("size = i_size")
    short = F.col("i_left").isNull()
    left, right = (F.when(short, 0).otherwise(equal_run(x, f"i_{x}", window - k)) for x in ("left", "right"))
    met = met.select("row", (F.col("at") - left).alias("start"), (F.col("at") + F.col("size") + right).alias("end"), short.alias("short"), "item")
    hits = met.where(F.col("short") | (F.col("end") - F.col("start") >= window)).select("row", "start", "end", "item")
    return rows.select(*carry, "n_words", "row"), hits


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """carry, n_words, n_hit, items (sorted strings), contaminated for every row."""
    documents, hits = benchmark_hits(docs, benchmark, **options)
    spans = F.array_sort(F.collect_set(F.struct("start", "end")))
    by_row = hits.groupBy("row").agg(spans.alias("spans"), F.array_sort(F.collect_set("item")).alias("items"))
    # Sorted spans: each adds what lies beyond the furthest end so far.
    n_hit = F.expr("aggregate(spans, struct(0L as n, 0 as upto), (s, x) -> struct(s.n + greatest(x.end - greatest(x.start, s.upto), 0) as n, greatest(s.upto, x.end) as upto), s -> s.n)")
    by_row = by_row.select("row", n_hit.alias("n_hit"), "items")
    out = documents.join(by_row, "row", "left").drop("row")
    out = out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>"))})
    return out.withColumn("contaminated", F.col("n_hit") > 0)
