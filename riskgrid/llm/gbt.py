"""Histogram gradient-boosted trees: ``fit`` on a bounded feature table in numpy,
``fit_table`` on a table of any size in Spark.

Features are binned by quantiles; each level of a tree is found from per-bin sums
of gradients and curvatures. Trees are complete and flattened into arrays, so that
scoring walks all trees of all rows at once, one level at a time.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


@dataclass
class Forest:
    """feature and threshold by (tree, inner node), value by (tree, leaf)."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def margin(self, x: np.ndarray, chunk: int = 2048) -> np.ndarray:
        trees, inner = self.feature.shape
        depth, tree, out = (inner + 1).bit_length() - 1, np.arange(trees)[None, :], []
        for i in range(0, len(x), chunk):
            part = x[i:i + chunk]
            row, node = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                right = part[row, self.feature[tree, node]] > self.threshold[tree, node]
                node = 2 * node + 1 + right
            out.append(self.bias + self.value[tree, node - inner].sum(axis=1))
        return np.concatenate(out) if out else np.zeros(0)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def best_splits(sums: Callable[[int], tuple[np.ndarray, np.ndarray]], edges: list[np.ndarray], width: int, l2: float, least: float) -> np.ndarray:
    """Of each of ``width`` nodes the best split as cut * features + feature, or -1;
    ``sums`` gives a feature's gradients and curvatures, added up by (node, bin)."""
    best, split = np.full(width, 1e-9), np.full(width, -1)
    for f in range(len(edges)):
        if not len(edges[f]):
            continue
        gs, hs = (s.cumsum(axis=1) for s in sums(f))
        gl, hl, gt, ht = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
        gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
        gain[(hl < least) | (ht - hl < least)] = 0
        cut = gain.argmax(axis=1)
        top = gain[np.arange(width), cut]
        better = (top > best) & (cut < len(edges[f]))
        best[better], split[better] = top[better], cut[better] * len(edges) + f
    return split


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """Logistic loss. ``least``: smallest curvature of a child. Without rows or with one
    class only, the forest is a constant."""
    inner = 2**depth - 1
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return forest
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    margin = np.full(len(y), forest.bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first

            def sums(f: int) -> tuple[np.ndarray, np.ndarray]:
                return tuple(np.bincount(at * bins + binned[f], weights=w, minlength=width * bins).reshape(width, bins) for w in (g, h))

            split = best_splits(sums, edges, width, l2, least)
            has = split >= 0
            f, cut = split % len(binned), split // len(binned)
            forest.feature[t, first:first + width][has] = f[has]
            forest.threshold[t, first:first + width][has] = [edges[a][b] for a, b in zip(f[has], cut[has], strict=True)]
            right = has[at] & (binned[np.where(has[at], f[at], 0), np.arange(len(y))] > cut[at])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = (np.bincount(leaf, weights=w, minlength=inner + 1) for w in (g, h))
        forest.value[t] = -rate * gs / (hs + l2)
        margin += forest.value[t][leaf]
    return forest


#: Trees after which the margins of a table's rows are written again, and rows of a file.
KEEP_TREES, FILE_ROWS = 15, 200_000
STATE = "code binary, y double, n long, margin double"


def codes_of(batch: pa.RecordBatch, features: int) -> np.ndarray:
    """Bins of the features of every row, stored as bytes in the first column."""
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, features)


def fit_table(rows: DataFrame, features: int, *, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Forest:
    """``fit`` on every row of a table of x (array of doubles), y (0 or 1) and n (how often
    the row counts). Quantiles are exact; each level of a tree is one pass of tasks over
    the binned rows, which sends the driver sums by node, feature and bin only. Sums are
    of whole numbers (gradients in steps so small that none overflows), so the trees do not
    depend on how rows are dealt to tasks."""
    inner = 2**depth - 1
    probs = np.linspace(0, 1, bins + 1)[1:-1].tolist()
    facts = rows.agg(F.sum("n").alias("n"), F.sum(F.col("y") * F.col("n")).alias("y"), *[F.percentile(F.get("x", F.lit(f)), F.lit(probs), F.col("n")).alias(f"q_{f}") for f in range(features)]).first()
    total, ones = facts.n or 0, facts.y or 0.0
    share = (ones + 1.0) / (total + 2.0)
    forest = Forest(np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)), float(np.log(share / (1 - share))))
    if ones in (0, total):
        return forest
    edges = [np.unique(facts[f"q_{f}"]) for f in range(features)]
    scale = 2.0 ** (52 - int(total).bit_length())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
            code = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in code], pa.binary()), *batch.columns[1:]], ["code", "y", "n"])

    state = materialise(rows.select("x", "y", "n").mapInArrow(encode, "code binary, y double, n long").groupBy("code", "y").agg(F.sum("n").alias("n")))
    files = min(-(-state.count() // FILE_ROWS), 2 * rows.sparkSession.sparkContext.defaultParallelism)
    state = materialise(state.repartition(files, "code").withColumn("margin", F.lit(forest.bias)))
    # The same trees on bins instead of values.
    cuts = Forest(forest.feature, np.full((trees, inner), np.inf), forest.value, 0.0)

    def grown(first: int, end: int) -> Forest:
        return Forest(cuts.feature[first:end], cuts.threshold[first:end], cuts.value[first:end], 0.0)

    def sums_of(state: DataFrame, known: Forest, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
        """Gradients and curvatures by (feature, node of the level, bin)."""
        shape = (2, features, 2**level * bins)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(shape)
            for batch in batches:
                code, (y, n, margin) = codes_of(batch, features), (c.to_numpy(zero_copy_only=False) for c in batch.columns[1:])
                p = 1 / (1 + np.exp(-(margin + known.margin(code))))
                row, node = np.arange(len(code)), np.zeros(len(code), np.int64)
                for _ in range(level):
                    node = 2 * node + 1 + (code[row, feature[node]] > cut[node])
                at = (node - (2**level - 1)) * bins
                for i, w in enumerate((p - y, p * (1 - p))):
                    w = np.round(w * scale) * n
                    for f in range(features):
                        out[i, f] += np.bincount(at + code[:, f], weights=w, minlength=shape[2])
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

        parts = state.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r.sums).reshape(shape) for r in parts) / scale

    def advanced(state: DataFrame, known: Forest) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                margin = batch.column(3).to_numpy(zero_copy_only=False) + known.margin(codes_of(batch, features))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(margin, pa.float64())], ["code", "y", "n", "margin"])

        return materialise(state.mapInArrow(run, STATE))

    kept = 0
    for t in range(trees):
        if t - kept == KEEP_TREES:
            state, kept = advanced(state, grown(kept, t)), t
        splits = True
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            if splits:
                sums = sums_of(state, grown(kept, t), cuts.feature[t], cuts.threshold[t], level).reshape(2, features, width, bins)
                split = best_splits(lambda f: (sums[0, f], sums[1, f]), edges, width, l2, least)
                node = sums[:, 0].sum(axis=2)
                splits = bool((split >= 0).any())
            else:
                # No node could be split: all rows go left.
                split = np.full(width, -1)
            left = node.copy()
            for i in np.nonzero(split >= 0)[0]:
                f, cut = split[i] % features, split[i] // features
                cuts.feature[t, first + i], cuts.threshold[t, first + i] = f, cut
                forest.threshold[t, first + i] = edges[f][cut]
                left[:, i] = sums[:, f, i, :cut + 1].sum(axis=1)
            node = np.stack([left, node - left], axis=2).reshape(2, 2 * width)
        forest.value[t] = -rate * node[0] / (node[1] + l2)
    return forest
