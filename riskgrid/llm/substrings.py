"""Exact substring dedup with a count-min prefilter.

A window is ``window`` consecutive words. Its key is the smallest hash of the
``anchor``-word grams inside it, so equal windows have equal keys, and
neighbouring windows mostly share one: a text has a key for every dozen words.

First pass: each partition counts the keys of its documents in a count-min sketch
whose cells stop at two (two bit planes of ``rows`` rows of ``2**bits`` cells).
The planes of all partitions are merged slice by slice. A key's estimate is at
least its count, so a window that occurs in two documents is always estimated
repeated; a sketch that fills up passes more windows on and loses none.

Second pass: only windows estimated repeated are grouped exactly. Runs of windows
with one key are segments, hashed as a whole: copies of a passage meet as one row
per segment instead of one per window. A key that has several different segments
is settled window by window, one copy of each segment. The smallest document of
each window then goes back to all segments, and a word goes if a window over it
starts in a smaller document.

Defined results: null and empty texts have no words; a text shorter than a window
keeps all; rows without id come after all ids, so they lose what others hold and
take nothing from others; rows that repeat an id are one document to each other;
an empty table gives an empty table. ``carry`` columns keep their names, except
ones named like a result.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, WordHash, as_long, ddl, materialise, mix, sliding_min

SLICES = 64
#: Longest run of windows in one segment; longer runs are several segments.
SEGMENT = 64
SEGMENT_TYPE = pa.struct([("key", pa.int64()), ("seg", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("wins", pa.list_(pa.int64()))])
SEGMENT_SQL = "array<struct<key: long, seg: long, start: int, n: int, wins: array<long>>>"


class Windows:
    """Keys, hashes and segments of a text's windows."""

    def __init__(self, window: int, anchor: int):
        self.window, self.anchor, self.words = window, anchor, WordHash()
        self.grams, self.whole = Rolling(), Rolling(0xD1342543DE82EF95)

    def words_of(self, text: bytes | None) -> np.ndarray:
        return self.words.of((text or b"").split())

    def keys(self, h: np.ndarray) -> np.ndarray:
        if len(h) < self.window:
            return np.zeros(0, np.uint64)
        return sliding_min(self.grams.windows(h, self.anchor), self.window - self.anchor + 1)

    def segments(self, h: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, number of windows, hash) of the runs of equal keys, cut at SEGMENT."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.nonzero(new)[0]
        run = np.repeat(at, np.diff(np.append(at, len(keys))))
        start = np.nonzero((np.arange(len(keys)) - run) % SEGMENT == 0)[0]
        n = np.diff(np.append(start, len(keys)))
        return start, n, self.whole.spans(self.whole.sums(h), start, start + n + self.window - 1)


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(keys, row + 1) >> np.uint64(64 - bits)).astype(np.int64)


def repeated_cells(docs: DataFrame, window: int, anchor: int, bits: int, rows: int) -> bytes:
    """Bit plane of the merged sketch's cells that count two or more, compressed; at most
    ``rows * 2**bits`` bits (8 MB by default) reach the driver and the tasks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window, anchor)
        once, twice = np.zeros((rows, 2**bits), bool), np.zeros((rows, 2**bits), bool)
        for batch in batches:
            found = [np.unique(of.keys(of.words_of(t.as_py()))) for t in batch.column(0).cast(pa.binary())]
            keys, seen = np.unique(np.concatenate([*found, np.zeros(0, np.uint64)]), return_counts=True)
            for r in range(rows):
                cell, at = np.unique(cells(keys, r, bits), return_inverse=True)
                total = np.bincount(at, weights=seen, minlength=len(cell))
                twice[r, cell[(total > 1) | once[r, cell]]] = True
                once[r, cell] = True
        out = [(i, *(zlib.compress(np.packbits(p).tobytes(), 1) for p in planes)) for i, planes in enumerate(zip(once.reshape(rows * SLICES, -1), twice.reshape(rows * SLICES, -1), strict=True)) if planes[0].any()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], ["slice", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for i, *packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                once, twice = (np.frombuffer(zlib.decompress(x), np.uint8) for x in packed)
                if i in planes:
                    a, b = planes[i]
                    planes[i] = [a | once, b | twice | (a & once)]
                else:
                    planes[i] = [once, twice]
        out = [(i, zlib.compress(twice.tobytes(), 1)) for i, (_, twice) in planes.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["slice", "twice"])

    sketches = docs.select("_text").mapInArrow(count, "slice int, once binary, twice binary")
    merged = sketches.repartition(rows * SLICES, "slice").mapInArrow(merge, "slice int, twice binary").collect()
    plane = np.zeros((rows * SLICES, 2**bits // SLICES // 8), np.uint8)
    for r in merged:
        plane[r.slice] = np.frombuffer(zlib.decompress(r.twice), np.uint8)
    return zlib.compress(plane.tobytes(), 1)


def candidate_segments(docs: DataFrame, plane: bytes, window: int, anchor: int, bits: int, rows: int) -> DataFrame:
    """_ord, _copy, key, seg, start, n, wins of the segments estimated repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Windows(window, anchor)
        table = np.unpackbits(np.frombuffer(zlib.decompress(plane), np.uint8)).reshape(rows, -1).view(bool)
        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], [], [], []]
            counts = []
            for text in batch.column(2).cast(pa.binary()):
                h = of.words_of(text.as_py())
                keys = of.keys(h)
                if not len(keys):
                    counts.append(0)
                    continue
                start, n, seg = of.segments(h, keys)
                key = keys[start]
                good = np.ones(len(key), bool)
                for r in range(rows):
                    good &= table[r, cells(key, r, bits)]
                start, n, seg, key = start[good], n[good], seg[good], key[good]
                counts.append(len(key))
                if len(key):
                    wins = of.whole.windows(h, window)
                    own = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    for out, x in zip(parts, (key, seg, start, n, wins[own]), strict=True):
                        out.append(x)
            key, seg, start, n, wins = (np.concatenate([*x, np.zeros(0, np.int64 if i in (2, 3) else np.uint64)]) for i, x in enumerate(parts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(as_long(wins)))
            structs = pa.StructArray.from_arrays([pa.array(as_long(key)), pa.array(as_long(seg)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), lists], fields=list(SEGMENT_TYPE))
            per_row = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), per_row], ["_ord", "_copy", "s"])

    found = docs.select("_ord", "_copy", "_text").mapInArrow(run, f"_ord long, _copy long, s {SEGMENT_SQL}")
    return materialise(found.select("_ord", "_copy", F.explode("s").alias("s")).select("_ord", "_copy", "s.*"))


def covered_spans(segments: DataFrame, window: int) -> DataFrame:
    """_ord, _copy, spans: the word ranges of each document that go."""
    distinct = materialise(segments.groupBy("key", "seg").agg(F.min("_ord").alias("lo"), F.max("_ord").alias("hi")))
    repeated = distinct.groupBy("key").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), F.count("*").alias("kinds")).where("a < b").select("key", "kinds")
    distinct = materialise(distinct.join(repeated, "key"))
    mixed = distinct.where("kinds > 1").select("key", "seg", "lo")
    one_copy = segments.select("key", "seg", "_ord", "wins").join(mixed, ["key", "seg"]).where("_ord = lo").dropDuplicates(["key", "seg"])
    windows = materialise(one_copy.select("key", "seg", "lo", F.posexplode("wins").alias("i", "win")))
    smallest = windows.groupBy("key", "win").agg(F.min("lo").alias("first"))
    firsts = windows.join(smallest, ["key", "win"]).groupBy("key", "seg").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "first"))), lambda x: x.first).alias("firsts"))
    same = distinct.where("kinds = 1").select("key", "seg", F.array("lo").alias("firsts"), F.lit(True).alias("same"))
    verdicts = materialise(same.unionByName(firsts.withColumn("same", F.lit(False))))
    met = segments.select("_ord", "_copy", "key", "seg", "start", "n").join(verdicts, ["key", "seg"])
    whole = F.filter(F.array(F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") - 1 + window).alias("b"))), lambda _: F.get("firsts", F.lit(0)) < F.col("_ord"))
    each = F.transform(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("firsts", i) < F.col("_ord")), lambda i: F.struct((F.col("start") + i).alias("a"), (F.col("start") + i + window).alias("b")))
    spans = met.select("_ord", "_copy", F.when(F.col("same"), whole).otherwise(each).alias("spans")).where(F.size("spans") > 0)
    return spans.groupBy("_ord", "_copy").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove_repeats(docs: DataFrame, *, window: int = 50, anchor: int = 20, bits: int = 25, rows: int = 2, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry, n_words, n_removed, and the text's kept words joined by one space under the
    name of the text column."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {text_col, "n_words", "n_removed"}]
    first = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("_ord")
    keyed = docs.select(*carry, first, F.xxhash64(F.col(text_col)).alias("_copy"), F.col(text_col).alias("_text"))
    plane = repeated_cells(keyed, window, anchor, bits, rows)
    segments = candidate_segments(keyed, plane, window, anchor, bits, rows)
    spans = covered_spans(segments, window).withColumnRenamed("spans", "_spans")
    joined = keyed.join(spans, ["_ord", "_copy"], "left").select(*carry, "_text", "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, kept = [], [], []
            for text, spans in zip(*(batch.column(batch.num_columns - i) for i in (2, 1)), strict=True):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    ab = spans.values.flatten()
                    np.add.at(edge, ab[0].to_numpy(), 1)
                    np.add.at(edge, ab[1].to_numpy(), -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    words = [w for w, s in zip(words, stay, strict=True) if s]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            texts = pa.array(kept, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], texts, pa.array(n, pa.int64()), pa.array(removed, pa.int64())], [*carry, text_col, "n_words", "n_removed"])

    schema = ", ".join(x for x in (ddl(docs, carry), f"`{text_col}` string, n_words long, n_removed long") if x)
    return joined.mapInArrow(cut, schema)
