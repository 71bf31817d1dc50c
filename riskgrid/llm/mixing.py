"""Mixing sources to target weights, in DataFrame functions only.

A source's documents, in an order permuted by hash, form one stream of words cut
into blocks. A source's quota of words is drawn as whole passes over its blocks
and one partial pass, so no block is drawn twice in a pass. A splitting tree
deals the drawn blocks to the output shards: each node sends an exact number of
its blocks left, those with the smallest hashes drawn anew at each level, so a
source's share of either side is multivariate hypergeometric and all quotas stay
exact. Documents meet their blocks by (source, block); a block holds a bounded
number of words, so a hot source is as many keys as it has blocks. ``order_key``
is the local shuffle: sort a shard by it.

Defined results: a null or empty text has size 0 and takes nothing; documents
without source form one source, ordered last; repeated rows are separate
documents; an empty table gives an empty table. ``carry`` columns keep their
names, so they must not be named like a result.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskgrid.operators.ordered import prefix_sums

from .common import GAP, WORD, attach, materialise

BLOCK_WORDS = 16_384


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """_source, source_size, base (words of the sources before), target, quota.

    Weights repeat over the sources in code point order. Targets share all words by
    weight; one above ``most`` times its source stops there, and the rest is shared
    again by weight until none is above. Only sums reach the driver."""
    ordered = prefix_sums(sizes, [F.asc_nulls_last("_source")], {"_rank": F.lit(1), "_end": F.col("source_size")})
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = materialise(ordered.select("_source", "source_size", (F.col("_end") - F.col("source_size")).alias("base"), w.cast("double").alias("weight")))
    cap = F.col("source_size") * float(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, left = 0.0, None
    while True:
        above = F.col("weight") * level > cap
        capped, weight, n = table.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.sum(above.cast("int"))).first()
        if n == left or not weight:
            break
        left, level = n, (total - (capped or 0.0)) / weight
    target = F.least(cap, F.col("weight") * level)
    return table.select("_source", "source_size", "base", target.alias("target"), F.round(target).cast("long").alias("quota"))


def draws(targets: DataFrame, block: int) -> DataFrame:
    """_source, pass, block, upto: the blocks that each pass over a source draws, and
    the stream position at which the pass ends."""
    size, quota = F.col("source_size"), F.col("quota")
    passes = targets.where("source_size > 0 and quota > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(quota - 1) div source_size"))))
    passes = passes.withColumn("upto", F.least(size, quota - F.col("pass") * size))
    return passes.select("_source", "pass", "upto", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(upto - 1) div {block}"))).alias("block"))


def splitting_tree(drawn: DataFrame, shards: int, seed: int) -> DataFrame:
    """``drawn`` with ``shard``: node by node an exact number of blocks goes left."""
    drawn = materialise(drawn.withColumn("_first", F.lit(0)))
    nodes = {0: (shards, drawn.count())}
    level = 0
    while any(width > 1 for width, _ in nodes.values()):
        ranked = prefix_sums(drawn, [F.col("_first"), F.xxhash64(F.lit(seed + level), "_source", "pass", "block")], {"_rank": F.lit(1)}, partition_cols=["_first"])
        goes, split = F.col("_first"), {}
        for first, (width, n) in nodes.items():
            half = width // 2
            stay = n * half // width
            split[first] = (max(half, 1), stay if half else n)
            if half:
                split[first + half] = (width - half, n - stay)
                goes = F.when((F.col("_first") == first) & (F.col("_rank") > stay), first + half).otherwise(goes)
        drawn, nodes, level = materialise(ranked.withColumn("_first", goes).drop("_rank")), split, level + 1
    return drawn.withColumnRenamed("_first", "shard")


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: int = 3, shards: int = 8, block: int = BLOCK_WORDS, seed: int = 9, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces), both with ``row`` as key. documents: carry, size,
    source_size, target. pieces: row, shard, pass, first_word, n_words, order_key."""
    carry = [c for c in docs.columns if c not in {"row", "size", "source_size", "target"}] if carry is None else carry
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})"), F.lit(1))).cast("long"), F.lit(0).cast("long"))
    size = F.when(F.col(text_col).isNull(), F.lit(0).cast("long")).otherwise(size)
    rows = materialise(docs.select(*[F.col(c) for c in carry], F.col(source_col).alias("_source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("_perm"), size.alias("size"), F.monotonically_increasing_id().alias("row")))
    targets = materialise(source_targets(rows.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, most))
    stream = prefix_sums(rows.select("row", "_source", "_perm", "size"), [F.asc_nulls_last("_source"), F.col("_perm")], {"_end": F.col("size")})
    stream = attach(stream, targets.select("_source", "base"), "_source").withColumn("_end", F.col("_end") - F.col("base")).where("size > 0")
    pieces = stream.withColumn("block", F.explode(F.expr(f"sequence((_end - size) div {block}, (_end - 1) div {block})")))
    dealt = splitting_tree(draws(targets, block), shards, seed)
    met = pieces.alias("p").join(dealt.alias("d"), F.col("p._source").eqNullSafe(F.col("d._source")) & (F.col("p.block") == F.col("d.block")))
    start = F.greatest(F.col("_end") - F.col("size"), F.col("p.block") * block)
    end = F.least(F.col("_end"), (F.col("p.block") + 1) * block, F.col("upto"))
    pieces = met.where(end > start).select("row", "shard", "pass", (start - F.col("_end") + F.col("size")).alias("first_word"), (end - start).alias("n_words"), F.xxhash64(F.lit(seed + 1), "_perm", "pass", F.col("p.block")).alias("order_key"))
    documents = attach(rows, targets.select("_source", "source_size", "target"), "_source")
    return documents.select(*carry, "row", "size", "source_size", "target"), pieces


def words_taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """``documents`` with ``taken``, the words that the pieces hold of each, repeats counted,
    and ``shard_words``, the same by shard: (shard, words) in the order of the shards."""
    by_shard = pieces.groupBy("row", "shard").agg(F.sum("n_words").alias("words"))
    taken = by_shard.groupBy("row").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("shard", "words"))).alias("shard_words"))
    none = F.expr("cast(array() as array<struct<shard: int, words: bigint>>)")
    return documents.join(taken, "row", "left").withColumns({"taken": F.coalesce("taken", F.lit(0).cast("long")), "shard_words": F.coalesce("shard_words", none)}).drop("row")


#: Pieces of one document, pass and shard that follow each other, as one.
_RUNS = """aggregate(sort_array(collect_list(struct(first_word, n_words, order_key))), cast(array() as array<struct<first_word: bigint, n_words: bigint, order_key: bigint>>),
    (runs, p) -> case when size(runs) > 0 and try_element_at(runs, -1).first_word + try_element_at(runs, -1).n_words = p.first_word
        then concat(slice(runs, 1, size(runs) - 1), array(named_struct('first_word', try_element_at(runs, -1).first_word, 'n_words', try_element_at(runs, -1).n_words + p.n_words, 'order_key', try_element_at(runs, -1).order_key)))
        else concat(runs, array(p)) end)"""


def copies(documents: DataFrame, pieces: DataFrame, columns: list[str], text_col: str = "text") -> DataFrame:
    """``columns`` of ``documents`` (or ``shard``, ``order_key``), one row for each pass that
    draws the document and each shard that its words are dealt to, in the order of the
    shards and in a shard of ``order_key``, in ranges of any number for one shard. A document
    whose blocks go to several shards, or that a pass ends in, is cut between words; words
    that follow each other in a shard stay together with the white space between them."""
    runs = pieces.groupBy("row", "pass", "shard").agg(F.expr(_RUNS).alias("_runs")).select("row", F.col("shard").alias("_shard"), F.explode("_runs").alias("_run"))
    units = F.regexp_extract_all(F.col(text_col), F.lit(f"((?:{GAP})?{WORD})"), F.lit(1))
    part = F.array_join(F.slice(units, F.col("_run.first_word").cast("int") + 1, F.col("_run.n_words").cast("int")), "")
    whole = F.col("_run.n_words") == F.col("size")
    text = F.when(whole, F.col(text_col)).otherwise(F.regexp_replace(part, f"^{GAP}", "")).alias(text_col)
    own = {"shard": F.col("_shard"), "order_key": F.col("_run.order_key")}
    wanted = [text if c == text_col else own[c].alias(c) if c in own and c not in documents.columns else F.col(c) for c in columns]
    order = ["_shard", "_order"]
    rows = documents.join(runs, "row").withColumn("_order", F.col("_run.order_key"))
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*wanted)
