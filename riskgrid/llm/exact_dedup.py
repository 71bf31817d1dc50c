"""Exact dedup as a stateful stream.

The documents are read as a file stream. Tasks hash whole texts and fold equal texts
of one Arrow batch, compared byte by byte, into one row: digest, stable identifier,
content locator (file and row of the text) and number of documents. So a text that a
third of all rows share reaches its key as one narrow row per batch. The keyed state
(RocksDB on the executors' disks, changes in the shared checkpoint folder, no expiry)
retains for each digest the identifier, the locator and the count. Its keys are slots
of about ``SLOT`` digests, because a state call costs far more than a digest in it; the
number of slots is fixed when the stream begins. A row whose digest is held already is
a hit: it goes out with the locator it met.

Hits are checked on full bytes: the texts behind the locators of a digest's hits are
fetched and their smallest and largest compared. Documents of a digest whose texts
differ (colliding digests) are grouped by their texts instead.

With ``state`` the stream's folder is kept: a later call reads only new files and
meets what earlier calls held. An executor lost at any time costs its tasks; a driver
lost in between restarts from the stream's last commit.

Defined results: a null text is empty and equals an empty one. Of equal texts the row
with the largest identifier stays, rows without one coming first; rows that repeat an
identifier are ranked by file and row, so exactly one row of a group stays. An empty
table gives an empty table. Only the columns named are read, so others may have any
name.
"""
from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskgrid.session import ensure_checkpoint_dir

from .common import BROADCAST_ROWS, materialise

#: Settings of the stream's state, read when it starts: on disk, with bounded native memory,
#: without the 4 MB of log space that each of many small stores would reserve, and a store open
#: only while its task runs.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}
HELD = "known boolean, id long, file string, row long, n long"
#: Digests that share a state entry.
SLOT = 256
#: A group of more than this share of all rows is hot; there are at most its inverse of them.
HOT_SHARE = 1e-5


STATE = pa.schema([("digest", pa.string()), ("known", pa.bool_()), ("id", pa.int64()), ("file", pa.string()), ("row", pa.int64()), ("n", pa.int64())])


@contextmanager
def settings(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """known, id, file, row, text: documents with the locator of their text."""
    ident = F.col(id_col).cast("long")
    return docs.select(ident.isNotNull().alias("known"), F.coalesce(ident, F.lit(0)).alias("id"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def digest(digits: int) -> Column:
    return F.substring(F.sha2(F.col("text"), 256), 1, digits)


def folded(rows: DataFrame, digits: int) -> DataFrame:
    """digest, known, id, file, row, n: one row for each text of an Arrow batch, with its largest row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[bytes, list] = {}
            names: dict[bytes, str] = {}
            heads = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for head, text in zip(heads, batch.column(4).cast(pa.binary()), strict=True):
                raw = text.as_py()
                key = hashlib.sha256(raw).digest()
                # Equal digests of a batch are compared on all bytes; others wait for the state.
                while key in held and held[key][0] != raw:
                    key += b"+"
                if key not in held:
                    held[key], names[key] = [raw, head, 1], key[:32].hex()[:digits]
                else:
                    held[key] = [raw, max(held[key][1], head), held[key][2] + 1]
            columns = [list(names.values()), *zip(*(h[1] for h in held.values()), strict=True), [h[2] for h in held.values()]] if held else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["digest", "known", "id", "file", "row", "n"])

    return rows.mapInArrow(run, f"digest string, {HELD}")


def meet(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold arriving rows into their slot; hits, and what they met, go out with the count so far."""
    held: dict[str, tuple] = {}
    if state.exists:
        with pa.ipc.open_stream(state.get[0]) as stored:
            held = {d: tuple(rest) for d, *rest in zip(*stored.read_all().to_pydict().values(), strict=True)}
    out = []
    for frame in frames:
        for digest, *row, n in zip(*(frame[c].tolist() for c in STATE.names), strict=True):
            if digest not in held:
                held[digest] = (*row, n)
                if n > 1:
                    out.append((digest, *row, n))
                continue
            *best, so_far = held[digest]
            held[digest] = (*max(best, row), so_far + n)
            out += [(digest, *best, so_far + n), (digest, *row, so_far + n)]
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STATE) as stored:
        columns = zip(*((d, *rest) for d, rest in held.items()), strict=True)
        stored.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, STATE, strict=True)], schema=STATE))
    state.update((sink.getvalue().to_pybytes(),))
    if out:
        yield pd.DataFrame(out, columns=STATE.names)


def stream_hits(spark: SparkSession, path: str, schema, *, id_col: str, text_col: str, digits: int, slots: int, folder: str, batch_bytes: int, batch_files: int | None) -> None:
    """Run the stream over the files not seen before; hits are appended to ``folder``/hits."""
    # A pattern that matches the path itself: a stream reads single files only through patterns.
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes) if batch_files is None else spark.readStream.schema(schema).option("maxFilesPerTrigger", batch_files)
    arriving = folded(located(reader.parquet(f"{path[:-1]}[{path[-1]}]"), id_col, text_col), digits)
    hits = arriving.withColumn("slot", F.pmod(F.xxhash64("digest"), F.lit(slots))).groupBy("slot").applyInPandasWithState(meet, f"digest string, {HELD}", "held binary", "append", GroupStateTimeout.NoTimeout)
    with settings(spark, STATE_CONF):
        run = hits.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/stream").option("path", f"{folder}/hits").trigger(availableNow=True).start()
    run.awaitTermination()


def colliding(hits: DataFrame, rows: DataFrame, digits: int) -> DataFrame:
    """digest of those hits whose full texts are not all the same."""
    need = hits.select("file", "row").distinct()
    need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
    texts = rows.join(need, ["file", "row"]).select(digest(digits).alias("digest"), "text")
    return texts.groupBy("digest").agg((F.min("text") != F.max("text")).alias("differ")).where("differ").select("digest")


def with_groups(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Left join on digest. Few groups are broadcast; of many, the hot ones are (at most
    1 / HOT_SHARE of them), and the rest, each a small share of the rows, are shuffled."""
    if groups.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "digest", "left")
    hot = groups.where(F.col("size") > HOT_SHARE * total)
    names = hot.select("digest")
    cold = rows.join(F.broadcast(names), "digest", "left_anti").join(groups.join(F.broadcast(names), "digest", "left_anti"), "digest", "left")
    return rows.join(F.broadcast(hot), "digest").unionByName(cold)


def exact_duplicates(spark: SparkSession, path: str, *, id_col: str = "doc_id", text_col: str = "text", digits: int = 64, state: str | None = None, batch_bytes: int = 2**36, batch_files: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of the Parquet files
    under ``path``. ``digits`` of the SHA-256 key the state."""
    docs = spark.read.parquet(path)
    folder = state or f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    rows = located(docs, id_col, text_col)
    best = F.struct("known", "id", "file", "row")
    doc_id = F.when(F.col("known"), F.col("id")).alias("doc_id")
    if docs.isEmpty():
        return rows.select(doc_id, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.sha2("text", 256).alias("text_sha256"))
    total = docs.count()
    spark.range(1).select(F.lit(total // SLOT + 1).alias("slots")).write.mode("ignore").parquet(f"{folder}/slots")
    slots = spark.read.schema("slots long").parquet(f"{folder}/slots").first().slots
    stream_hits(spark, path, docs.schema, id_col=id_col, text_col=text_col, digits=digits, slots=slots, folder=folder, batch_bytes=batch_bytes, batch_files=batch_files)
    hits = spark.read.schema(f"digest string, {HELD}").parquet(f"{folder}/hits")
    groups = materialise(hits.groupBy("digest").agg(F.max(best).alias("best"), F.max("n").alias("size")))
    differ = materialise(colliding(hits, rows, digits))
    keyed = rows.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring("sha", 1, digits))
    if differ.isEmpty():
        judged = with_groups(keyed.drop("text"), groups, total)
    else:
        apart = keyed.join(differ, "digest", "left_semi")
        by_text = apart.groupBy("digest", "text").agg(F.max(best).alias("best"), F.count("*").alias("size"))
        same = with_groups(keyed.join(differ, "digest", "left_anti").drop("text"), groups.join(differ, "digest", "left_anti"), total)
        judged = same.unionByName(apart.join(by_text, ["digest", "text"]).drop("text"))
    keep = F.coalesce("best", best)
    return judged.select(doc_id, F.when(keep.known, keep.id).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
                         ((keep.file == F.col("file")) & (keep.row == F.col("row"))).alias("kept"), F.col("sha").alias("text_sha256"))
