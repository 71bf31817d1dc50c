"""Helpers shared by the operators: scratch tables, words, rolling hashes."""
from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskgrid.session import ensure_checkpoint_dir

#: Words are runs of anything but ASCII white space; as Java, DuckDB and Python patterns.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder. It
    outlives a lost executor, and later readers prune its columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class WordHash(dict):
    """64-bit hash of a word's bytes, remembered up to a fixed number of words."""

    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply and shift), elementwise."""
    x = x ^ np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of all n-word windows of a sequence of word hashes, in linear time:
    differences of one running polynomial sum modulo 2**64, then mixed."""

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        size = 1 << max(10, (n - 1).bit_length())
        for name, base in (("up", self.base), ("down", pow(self.base, -1, 2**64))):
            powers = np.full(size, base, np.uint64)
            powers[0] = 1
            setattr(self, name, np.multiply.accumulate(powers))

    def sums(self, h: np.ndarray) -> np.ndarray:
        if len(h) >= len(self.up):
            self._grow(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[:len(h)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [start, end) of the sequence that ``sums`` belongs to."""
        return mix((sums[end] - sums[start]) * self.down[start])

    def windows(self, h: np.ndarray, n: int) -> np.ndarray:
        if len(h) < n:
            return np.zeros(0, np.uint64)
        sums = self.sums(h)
        return mix((sums[n:] - sums[:-n]) * self.down[:len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[width:], x[:-width])
        width *= 2
    return np.minimum(x[n - width:], x[:len(x) - (n - width)]) if n > width else x


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Up to this many rows (keys and a few numbers, about 100 MB) a dimension is broadcast.
BROADCAST_ROWS = 1_000_000
SALTS = 64


def attach(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left join of a per-key table on ``key`` (nulls match) whose key may be hot:
    broadcast after a count of its rows, else with salted keys. ``dim`` is read twice."""
    dim = dim.withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key"))
    if dim.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(dim), same, "left").drop("_key")
    spread = dim.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(SALTS)).cast("int"))
    return salted.join(spread, same & (F.col("_salt") == F.col("_part")), "left").drop("_key", "_salt", "_part")


def ddl(df: DataFrame, columns: list[str]) -> str:
    """Schema string of some columns of ``df``, for functions on Arrow batches."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[df[c] for c in columns]).schema)


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose keys (nulls match) are not in ``gone``: broadcast after a count,
    else joined by shuffle."""
    gone = materialise(gone.select(*keys).distinct())
    gone = gone.select(*[F.col(k).alias(f"_gone_{i}") for i, k in enumerate(keys)])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_gone_{i}")) for i, k in enumerate(keys)])
    return df.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, same, "left_anti")
