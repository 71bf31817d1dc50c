"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from the whole text, in tasks. The trees are fitted on the driver
on at most ``sample`` labelled rows (those with the smallest hash of the id), each
a vector of statistics; no text reaches the driver. Scoring ships the flattened
trees (a few hundred numbers) to the tasks.

Defined results: null and empty texts have zero statistics and get the score of
those; labels without a value or with an unknown id are not used; without labels
of both classes every score is the labels' smoothed share; repeated rows are
scored one by one. Other columns of the input are kept only through ``carry``.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import ddl

#: Classes of bytes: other, a-z, A-Z, 0-9, white space, sentence marks, other ASCII marks, non-ASCII.
CLASSES = np.array([7 if c >= 128 else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c == 32 or 9 <= c <= 13 else 5 if chr(c) in ".,;:?'\"-()" else 6 if 33 <= c <= 126 else 0 for c in range(256)], np.uint8)
N_FEATURES = 25


def statistics(text: str | None) -> np.ndarray:
    """Shares, lengths and repetition of one whole text."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    out = np.zeros(N_FEATURES)
    if not n:
        return out
    codes = np.frombuffer(raw, np.uint8)
    size = len(codes)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct, pairs = set(words), set(zip(words, words[1:]))
    out[:8] = np.bincount(CLASSES[codes], minlength=8) / size
    out[8:13] = np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), (lengths <= 3).mean()
    out[13:17] = len(distinct) / n, len(pairs) / max(n - 1, 1), len(lines) / n, len(set(lines)) / len(lines)
    out[17:22] = [raw.count(c) / n for c in (b"!", b"|", b"*", b"$", b"%")]
    out[22:] = np.mean([x.rstrip()[-1:] in b".!?" for x in lines]), lengths.max(), sum(w.isupper() for w in distinct) / len(distinct)
    return out


def with_statistics(docs: DataFrame, carry: list[str], text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))], [*carry, "features"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, f"{ddl(docs, carry)}, features array<double>")


def labelled_sample(labels: DataFrame, label: str, learn: Column, sample: int, id_col: str) -> DataFrame:
    """(_id, _label) of at most ``sample`` rows that may be learned from, by hash of the id."""
    rows = labels.where(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).alias("_id"), F.col(label).cast("double").alias("_label")).orderBy(F.xxhash64("_id"), "_id", "_label").limit(sample)


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "quality", sample: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> gbt.Forest:
    chosen = labelled_sample(labels, label, learn, sample, id_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(F.broadcast(chosen), "_id")
    table = with_statistics(rows, ["_id", "_label"], text_col).orderBy("_id", "_label", "features").limit(2 * sample).toPandas()
    x = np.array(table.features.to_list()).reshape(len(table), N_FEATURES)
    return gbt.fit(x, table._label.to_numpy())


def score_quality(docs: DataFrame, forest: gbt.Forest, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry and score (probability of label 1) for every row."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    feature, threshold, value, bias = forest.feature, forest.threshold, forest.value, forest.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = gbt_forest(feature, threshold, value, bias)
        for batch in batches:
            x = np.array([statistics(t.as_py()) for t in batch.column(batch.num_columns - 1)]).reshape(batch.num_rows, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(trees.probability(x), pa.float64())], [*carry, "score"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, f"{ddl(docs, carry)}, score double")


gbt_forest = gbt.Forest
