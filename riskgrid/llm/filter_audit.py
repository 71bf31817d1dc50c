"""Audit of how document filters interact, by a recursive CTE over their orders.

Each document gets a mask with one bit for each failure condition it meets:

* A: fewer than 50 words
* B: 100 * distinct words < 65 * words
* C: 100 * characters A-Z > 5 * code points
* D: holds one of ``#$%&*|``
* E: identical to the text of a smaller doc_id anywhere in the table

Documents are counted into cells of one part (source) and one mask. A recursive CTE
starts from the masks that occur, extends each prefix of filters by an unused letter
through an equi-join with the masks' letter cells, and carries the bits applied so
far; each level's rows say what that step removes, keeps or finds removed already.
It holds at most 32 masks * 325 prefixes whatever the corpus; its rows meet the cells
on the mask, are summed by part and prefix, and prefixes are dealt to the 120 orders.

Defined results: a null text is empty and equals an empty one, a null source is the
part ``''``; rows without id have no smaller id and never fail E, and have no labels;
rows that repeat an id are documents of their own, of which none is a smaller id to
the other; a document with several label rows is good or toxic if one of them says so;
an empty table gives no rows. Texts are read whole, equal texts meet by SHA-256. Only
the columns named are read, so others may have any name.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

LETTERS = "ABCDE"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOL = re.compile(rb"[#$%&*|]")


def text_mask(text: bytes, length: int) -> int:
    """Bits of A to D for a text of ``length`` code points."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    return (len(words) < 50) | (100 * len(set(words)) < 65 * len(words)) << 1 | (100 * upper > 5 * length) << 2 | (SYMBOL.search(text) is not None) << 3


def masked(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """id, part, mask of A to D, digest of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                raw = text.encode()
                masks.append(text_mask(raw, len(text)))
                digests.append(hashlib.sha256(raw).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["id", "part", "mask", "digest"])

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, "id long, part string, mask int, digest binary")


def mask_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by part and set of failed filters."""
    facts = materialise(masked(docs, id_col, text_col, part_col))
    with_id = facts.where("id is not null")
    first = with_id.groupBy("digest").agg(F.min("id").alias("id"), F.lit(0).alias("copy"))
    copies = with_id.join(first, ["digest", "id"], "left").select("id", "part", (F.col("mask") + F.coalesce("copy", F.lit(16))).alias("mask"))
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = copies.join(said, "id", "left").select("part", "mask", "good", "toxic")
    none = F.lit(None).cast("int")
    rows = known.unionByName(facts.where("id is null").select("part", "mask", none.alias("good"), none.alias("toxic")))
    total = [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic"))]
    return rows.groupBy("part", "mask").agg(*total)


STEPS = """
with recursive masks as (select distinct mask from {cells}),
letter_cells as (
  select mask, letter, shiftleft(1, bit) as bit, (mask & shiftleft(1, bit)) <> 0 as fails
  from masks lateral view posexplode(array('A', 'B', 'C', 'D', 'E')) as bit, letter),
steps (mask, prefix, applied, fails, gone) as (
  select mask, '', 0, false, false from masks
  union all
  select s.mask, concat(s.prefix, c.letter), s.applied | c.bit, c.fails, (s.mask & s.applied) <> 0
  from steps s join letter_cells c on s.mask = c.mask where s.applied & c.bit = 0)
select mask, prefix, fails and not gone as removed, fails and gone as redundant, not fails and not gone as kept, fails and mask = shiftleft(1, instr('ABCDE', right(prefix, 1)) - 1) as alone
from steps where prefix <> ''
"""


def audit(cells: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from :func:`mask_cells`."""
    cells = materialise(cells)
    steps = materialise(cells.sparkSession.sql(STEPS, cells=cells))

    def total(flag: str, column: str, name: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(column)).otherwise(0)).alias(name)

    # At most 32 * 325 step rows and 600 steps of orders: broadcast whatever the corpus.
    met = cells.join(F.broadcast(steps), "mask")
    prefixes = met.groupBy("part", "prefix").agg(
        total("kept", "n", "kept"), total("removed", "n", "removed"), total("redundant", "n", "redundant"), total("alone", "n", "unique_fails"),
        total("removed", "good", "good_lost"), total("removed", "toxic", "toxic_lost"))
    prefixes = materialise(prefixes.withColumn("letter", F.substring("prefix", -1, 1)))
    # A prefix of k filters begins (5 - k)! of the orders.
    orders_of = F.factorial(len(LETTERS) - F.length("prefix"))
    shapley = prefixes.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders_of).alias("shapley"))
    orders = steps.where(F.length("prefix") == len(LETTERS)).select(F.col("prefix").alias("filter_order")).distinct()
    dealt = orders.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))).alias("step"))
    dealt = dealt.withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    out = prefixes.join(F.broadcast(dealt), "prefix").join(shapley, ["part", "letter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
