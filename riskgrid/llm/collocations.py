"""Phrase collocations by dynamic itemset counting.

Texts are dealt to ``shards`` shards, which are scanned in a cycle. Single words are
counted from the first scan. A phrase is activated by the first scan after both of
its subphrases (all but the last word, all but the first) have reached the threshold,
so phrases of all lengths are counted side by side in one scan, and each is counted
until it completes one full cycle from its activation: its count is then exact. At the
latest a subphrase reaches the threshold when its own cycle ends, so no frequent phrase
is missed.

Texts are read as words once, about a megabyte at a time: every word becomes a 64-bit
code, and what follows works on arrays of codes, stored as bytes. The words of the phrases found are looked up in the texts at the
end; should one code stand for two words, everything is done again with other codes.

Before the scans three passes shrink what is scanned and counted. The first merges count-min sketches
of the words and of the word pairs of all texts (cells stop at 255), and adds up the
words of each language. The second deals the texts to the shards, without what the
sketches rule out: words, and pairs of neighbours, whose estimate falls short of the
threshold. Estimates are never too small, so no frequent phrase is cut; words outside
every likely pair are kept in a column of their own, which only the scans that count
single words read. A third pass sketches the windows of three words of what was dealt:
most phrases of three words whose pairs are frequent are not, and need no counting.
A sketch that fills up rules out less and changes no result.

Tasks learn when phrases reached the threshold from a max-cell sketch (two rows of at
most 2**24 bytes, sized by a count of the phrases): a cell holds the latest scan of
its phrases, and the smaller of a phrase's two cells is at least its own, so a window
is passed on whenever it may be active. Which of the windows passed on are active is
decided exactly when they meet the table of counts, by the phrases themselves; a full
sketch costs time and changes nothing. A scan meets only the phrases still on their cycle;
complete ones are set aside, and a late window of theirs is recognised by its start. A task counts the windows of about 260 thousand
words at a time; the sums by phrase combine on the map side.

Then each candidate is cut at every place; parts of a frequent phrase are frequent, so
their counts are at hand. The lowest score (exact decimals) counts. A candidate of equal
count to one that is one word longer and holds it is dropped; with counts that only fall
with length, that covers all longer ones. The first ``top`` of a language are ranked in
salted parts first.

Defined results: null and empty texts have no words, a null language is ``und``; ties are
broken by count and phrase; rows that repeat an id count as often as they occur; an empty
table gives an empty table. Only the columns named are read, so others may have any name.
"""
from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskgrid.session import ensure_checkpoint_dir, spread

from .common import BROADCAST_ROWS, SALTS, attach, materialise, mix
from .exact_dedup import settings

BREAK = b"\xff"
#: Lower case, tabs as spaces, and the characters that end a piece as a byte that no UTF-8 text holds.
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + BREAK * 10)
CHUNK_WORDS = 1 << 18
ROWS, LEAST_BITS, MOST_BITS = 2, 12, 24
#: Cells of the count-min sketch: from 2**22 to 2**26 in two rows, about one for 32 words.
PAIR_BITS = (22, 26)
FULL = 255
#: Codes are read in tasks of about this many bytes, a multiple of the cores: sketches and
#: counts are summed within a task, so what is shuffled grows with the number of tasks.
TASK_BYTES = 1 << 27
#: Rows that go to a Python worker at once: codes are many bytes a row, and tasks are large.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
#: A phrase is the codes of its words, eight bytes each.
COUNTS = "lang string, phrase binary, k int, n long, start int, reached int"


#: Words over this many bytes are hashed one by one.
LONG = 64
CHUNK_BYTES = 1 << 20
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
CELL_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class Words:
    """The words of some texts: cleaned bytes, and row, start and end of each word."""

    def __init__(self, texts: pa.Array):
        texts, self.rows = texts.cast(pa.binary()), len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + self.rows + 1].astype(np.int64)
        raw = memoryview(texts.buffers()[2] or b"")[offsets[0]:offsets[-1]]
        offsets -= offsets[0]
        self.data = np.frombuffer(bytes(raw).translate(CLEAN) + bytes(8), np.uint8)
        text = self.data[:-8]
        word = (text != 32) & (text != BREAK[0])
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        heads, tails = offsets[:-1][offsets[:-1] < len(text)], offsets[1:][offsets[1:] > 0] - 1
        first[heads], last[tails] = word[heads], word[tails]
        self.starts, self.ends = np.nonzero(first)[0], np.nonzero(last)[0] + 1
        self.row = np.searchsorted(offsets, self.starts, "right") - 1

    def ends_piece(self) -> np.ndarray:
        """Whether a piece or a text ends after the word."""
        before = np.searchsorted(np.nonzero(self.data == BREAK[0])[0], self.starts)
        after = np.ones(len(self.starts), bool)
        after[:-1] = (before[1:] != before[:-1]) | (self.row[1:] != self.row[:-1])
        return after

    def eights(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Up to eight bytes from each place as one number."""
        every = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        return every[at] & MASKS[np.minimum(length, 8)]

    def spelled(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def different(self, codes: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Of the words ``of`` one for each code, and every word that differs from that one."""
        of = of[np.argsort(codes[of])]
        new = np.ones(len(of), bool)
        new[1:] = codes[of[1:]] != codes[of[:-1]]
        lead = of[np.nonzero(new)[0]][np.cumsum(new) - 1]
        length = (self.ends - self.starts)[of]
        other = length != (self.ends - self.starts)[lead]
        for at in range(0, min(int(length.max(initial=0)), LONG), 8):
            i = np.nonzero(~other & ~new & (length > at))[0]
            other[i] = self.eights(self.starts[of[i]] + at, length[i] - at) != self.eights(self.starts[lead[i]] + at, length[i] - at)
        for i in np.nonzero(~other & ~new & (length > LONG))[0].tolist():
            other[i] = self.spelled(of[i]) != self.spelled(lead[i])
        return of[new | other]


def word_codes(words: Words, salt: int) -> np.ndarray:
    """64-bit codes of words, by eight bytes at a time; 0 and 1 stand for no word."""
    out = [np.zeros(0, np.uint64)]
    for low in range(0, len(words.starts), CHUNK_WORDS):
        starts = words.starts[low:low + CHUNK_WORDS]
        length = words.ends[low:low + CHUNK_WORDS] - starts
        code = mix(length.astype(np.uint64), 2 * salt + 1)
        for at in range(0, min(int(length.max()), LONG), 8):
            i = np.nonzero(length > at)[0] if at else slice(None)
            code[i] = mix(code[i] ^ words.eights(starts[i] + at, length[i] - at), 2 * salt + 2)
        for i in np.nonzero(length > LONG)[0].tolist():
            code[i] = xxhash.xxh3_64_intdigest(words.spelled(low + i), salt)
        out.append(np.maximum(code, np.uint64(2)))
    return np.concatenate(out)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """lang, text of about CHUNK_BYTES at a time."""
    for batch in batches:
        length = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(length), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + CHUNK_BYTES, "right")))
            yield batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low)
            low = high


def encoded(texts: DataFrame, salt: int) -> DataFrame:
    """lang, codes of every text; 0 ends each piece and each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, part in portions(batches):
            words = Words(part)
            size = 1 + words.ends_piece()
            lengths = np.bincount(words.row, weights=size, minlength=words.rows).astype(np.int64)
            # A text without words is a single 0.
            empty = lengths == 0
            flat = np.zeros(int(lengths.sum() + empty.sum()), np.uint64)
            flat[np.cumsum(size) - size + np.cumsum(empty)[words.row]] = word_codes(words, salt)
            yield pa.RecordBatch.from_arrays([langs, blobs(flat, lengths + empty)], ["lang", "codes"])

    return texts.mapInArrow(run, "lang string, codes binary")


def blobs(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Arrays of codes as bytes: Spark then writes and reads them whole, not code by code."""
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]) * 8, pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, ends.buffers()[1], pa.py_buffer(flat.tobytes())])


class Windows:
    """The codes of some texts, one after the other, and the hash keys of their windows."""

    def __init__(self, langs: pa.Array, codes: np.ndarray, lengths: np.ndarray):
        of = langs.dictionary_encode()
        self.langs, self.rows = of.dictionary.to_pylist(), len(lengths)
        self.codes, self.row = codes, np.repeat(np.arange(len(lengths)), lengths)
        self.lang = of.indices.to_numpy(zero_copy_only=False).astype(np.int64)[self.row]
        self.salts = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.langs], np.uint64)

    def first_keys(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.nonzero(self.codes)[0]
        return at, mix(self.codes[at] ^ self.salts[self.lang[at]], 1)

    def longer_keys(self, at: np.ndarray, keys: np.ndarray, k: int) -> np.ndarray:
        """Keys of the windows of ``k`` words from those of one word less."""
        return mix(keys * np.uint64(0x9E3779B97F4A7C15) + self.codes[at + k - 1], k)

    def phrases(self, at: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """One place of each different phrase of ``k`` words and its number of windows."""
        order = np.argsort(keys)
        new = np.ones(len(keys), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(keys)))
        place = at[order[first]]
        rest, lead = at[order[~new]], np.repeat(place, n - 1)
        equal = self.lang[rest] == self.lang[lead]
        for j in range(k):
            equal &= self.codes[rest + j] == self.codes[lead + j]
        if equal.all():
            return place, n
        # Two phrases with one key: number them word by word.
        ident = self.lang[at]
        for j in range(k):
            word = np.unique(self.codes[at + j], return_inverse=True)[1]
            _, first, ident, n = np.unique(ident << 32 | word, return_index=True, return_inverse=True, return_counts=True)
        return at[first], n

    def batch(self, place: np.ndarray, n: np.ndarray, k: int) -> pa.RecordBatch:
        """lang, phrase, k, n."""
        spans = self.codes[place[:, None] + np.arange(k)].astype(">u8").tobytes()
        phrase = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.array(np.arange(len(place) + 1) * 8 * k, pa.int32()).buffers()[1], pa.py_buffer(spans)])
        lang = pa.DictionaryArray.from_arrays(pa.array(self.lang[place], pa.int32()), pa.array(self.langs, pa.string())).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(place), k), pa.int32()), pa.array(n, pa.int64())], ["lang", "phrase", "k", "n"])


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Windows]:
    """About CHUNK_WORDS codes at a time from batches of lang, codes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(1)
        ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + batch.num_rows + 1] // 8
        flat = np.frombuffer(column.buffers()[2], np.uint64, int(ends[-1])) if ends[-1] else np.zeros(0, np.uint64)
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, ends[start] + CHUNK_WORDS, "right")) - 1)
            end = min(end, batch.num_rows)
            yield Windows(batch.column(0).slice(start, end - start), flat[ends[start]:ends[end]], np.diff(ends[start:end + 1]))
            start = end


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cells of keys, which are mixed already: the high bits of a product."""
    return (keys * CELL_FACTORS[row] >> np.uint64(64 - bits)).astype(np.int64)


def pack(planes: np.ndarray, parts: int) -> pa.RecordBatch:
    """The used parts of some bytes, compressed."""
    cut = planes.reshape(parts, -1)
    used = [i for i in range(parts) if cut[i].any()]
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(cut[i].tobytes(), 1) for i in used], pa.binary())], ["part", "cells"])


def in_tasks(coded: DataFrame, codes: int) -> DataFrame:
    """``coded``, which holds so many codes, in no more tasks than TASK_BYTES asks for."""
    cores = coded.sparkSession.sparkContext.defaultParallelism
    return coded.coalesce(cores * max(1, -(-8 * codes // (cores * TASK_BYTES))))


def tally(plane: np.ndarray, keys: np.ndarray, bits: int) -> None:
    """Add keys to the rows of a count-min sketch; cells stop at FULL."""
    found, n = np.unique(keys, return_counts=True)
    for r in range(ROWS):
        cell = cells(found, r, bits)
        np.add.at(plane[r], cell, np.minimum(n, FULL).astype(np.uint16))
        plane[r, cell] = np.minimum(plane[r, cell], FULL)


def merged(tables: DataFrame, parts: int, length: int) -> np.ndarray:
    """Sum of the packed sketches of all tasks; cells stop at FULL."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
                sums[i] = np.minimum(sums[i].astype(np.uint16) + new, FULL).astype(np.uint8) if i in sums else new
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], ["part", "cells"])

    plane = np.zeros((parts, length // parts), np.uint8)
    for r in tables.repartition(parts, "part").mapInArrow(merge, "part int, cells binary").collect():
        plane[r.part] = np.frombuffer(zlib.decompress(r.cells), np.uint8)
    return plane


def pair_estimates(coded: DataFrame, bits: int) -> tuple[bytes, DataFrame]:
    """Merged count-min sketch of words (a quarter of the cells) and of pairs, compressed;
    lang, total of words."""
    sizes = (2**(bits - 2), 2**bits)
    parts = ROWS * 5 * 4

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = [np.zeros((ROWS, n), np.uint16) for n in sizes]
        totals: dict[str, int] = {}
        for w in chunks(batches):
            at, keys = w.first_keys()
            for lang, n in zip(w.langs, np.bincount(w.lang[at], minlength=len(w.langs)).tolist(), strict=True):
                totals[lang] = totals.get(lang, 0) + n
            both = np.nonzero(at[1:] == at[:-1] + 1)[0]
            for k, found in ((1, keys), (2, w.longer_keys(at[both], keys[both], 2))):
                tally(plane[k - 1], found, bits - 2 if k == 1 else bits)
        packed = pack(np.concatenate([p.ravel() for p in plane]).astype(np.uint8), parts)
        names, sums = list(totals), list(totals.values())
        yield pa.RecordBatch.from_arrays([packed.column(0), packed.column(1), pa.nulls(packed.num_rows, pa.string()), pa.nulls(packed.num_rows, pa.int64())], ["part", "cells", "lang", "total"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int32()), pa.nulls(len(names), pa.binary()), pa.array(names, pa.string()), pa.array(sums, pa.int64())], ["part", "cells", "lang", "total"])

    found = materialise(coded.mapInArrow(fill, "part int, cells binary, lang string, total long"))
    plane = merged(found.where("part is not null").select("part", "cells"), parts, ROWS * sum(sizes))
    totals = materialise(found.where("lang is not null").groupBy("lang").agg(F.sum("total").alias("total")))
    return zlib.compress(plane.tobytes(), 1), totals


def shrunk(coded: DataFrame, plane: bytes, bits: int, least: int, shards: int) -> DataFrame:
    """lang, runs, singles, shard: the words that may be frequent, in runs of likely pairs
    or alone; a 0 ends a run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(plane), np.uint8)
        ones, pairs = (x.reshape(ROWS, -1) for x in np.split(table, [ROWS * 2**(bits - 2)]))

        def likely(t: np.ndarray, keys: np.ndarray, b: int) -> np.ndarray:
            return np.minimum(*(t[r, cells(keys, r, b)] for r in range(ROWS))) >= least

        def some(w: Windows, at: np.ndarray, ends: np.ndarray) -> pa.Array:
            length = 1 + ends
            flat = np.zeros(length.sum(), np.uint64)
            flat[np.cumsum(length) - length] = w.codes[at]
            return blobs(flat, np.bincount(w.row[at], weights=length, minlength=w.rows).astype(np.int64))

        seen = 0
        for w in chunks(batches):
            at, keys = w.first_keys()
            good = likely(ones, keys, bits - 2)
            at, keys = at[good], keys[good]
            both = np.nonzero(at[1:] == at[:-1] + 1)[0]
            both = both[likely(pairs, w.longer_keys(at[both], keys[both], 2), bits)]
            goes_on, inside = np.zeros(len(at), bool), np.zeros(len(at), bool)
            goes_on[both] = inside[both] = inside[both + 1] = True
            alone = at[~inside]
            runs, singles = some(w, at[inside], (~goes_on[inside]).astype(np.int64)), some(w, alone, np.ones(len(alone), np.int64))
            lang = pa.DictionaryArray.from_arrays(pa.array(w.lang[np.searchsorted(w.row, np.arange(w.rows))], pa.int32()), pa.array(w.langs, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, runs, singles, pa.array((np.arange(w.rows) + seen) % shards, pa.int32())], ["lang", "runs", "singles", "shard"])
            seen += w.rows

    return coded.mapInArrow(run, "lang string, runs binary, singles binary, shard int")


def triple_estimates(runs: DataFrame, bits: int, least: int) -> bytes:
    """For each cell of a count-min sketch of the windows of three words in the runs, whether
    it comes to ``least``: one bit, compressed."""
    parts = ROWS * 16

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = np.zeros((ROWS, 2**bits), np.uint16)
        for w in chunks(batches):
            at, keys = w.first_keys()
            for k in (2, 3):
                both = np.nonzero(at[1:] == at[:-1] + 1)[0]
                at, keys = at[both], w.longer_keys(at[both], keys[both], k)
            tally(plane, keys, bits)
        yield pack(plane.astype(np.uint8), parts)

    plane = merged(runs.mapInArrow(fill, "part int, cells binary"), parts, ROWS * 2**bits)
    return zlib.compress(np.packbits(plane.ravel() >= least, bitorder="little").tobytes(), 1)


def sketch(reached: DataFrame, bits: int) -> bytes:
    """Max-cell sketch of lang, phrase, k, reached; cell values are the scan after it.
    At most ``ROWS * 2**MOST_BITS`` bytes, compressed, reach the driver and the tasks."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plane = np.zeros((ROWS, 2**bits), np.uint8)
        for batch in batches:
            k, value = batch.column(2).to_numpy(), batch.column(3).to_numpy() + 1
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").astype(np.uint64)
            w, at = Windows(batch.column(0), codes, k), np.cumsum(k) - k
            keys = mix(w.codes[at] ^ w.salts[w.lang[at]], 1)
            for length in range(2, int(k.max(initial=1)) + 1):
                longer = k >= length
                keys[longer] = w.longer_keys(at[longer], keys[longer], length)
            for r in range(ROWS):
                np.maximum.at(plane[r], cells(keys, r, bits), value.astype(np.uint8))
        yield pack(plane, ROWS * 16)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                new = np.frombuffer(zlib.decompress(packed), np.uint8)
                parts[i] = np.maximum(parts[i], new) if i in parts else new
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts.values()], pa.binary())], ["part", "cells"])

    filled = reached.select("lang", "phrase", "k", "reached").mapInArrow(fill, "part int, cells binary")
    plane = np.zeros((ROWS * 16, 2**bits // 16), np.uint8)
    for r in filled.repartition(ROWS * 4, "part").mapInArrow(merge, "part int, cells binary").collect():
        plane[r.part] = np.frombuffer(zlib.decompress(r.cells), np.uint8)
    return zlib.compress(plane.tobytes(), 1)


def scanned(shard: DataFrame, plane: bytes, bits: int, triples: bytes, triple_bits: int, scan: int, shards: int, longest: int) -> DataFrame:
    """lang, phrase, k, n: windows of a shard that may be active in this scan."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(plane), np.uint8).reshape(ROWS, -1)
        often = np.frombuffer(zlib.decompress(triples), np.uint8).reshape(ROWS, -1)

        def likely(keys: np.ndarray) -> np.ndarray:
            """Whether a phrase of three words may reach the threshold."""
            at = [cells(keys, r, triple_bits) for r in range(ROWS)]
            return np.logical_and(*(often[r, at[r] >> 3] >> (at[r] & 7).astype(np.uint8) & 1 for r in range(ROWS)))

        def begins(keys: np.ndarray) -> np.ndarray:
            """Scan after the one in which the phrase reached the threshold; 0: it has not."""
            return np.minimum(*(table[r, cells(keys, r, bits)] for r in range(ROWS))).astype(np.int64)

        for w in chunks(batches):
            at, keys = w.first_keys()
            if scan < shards and len(at):
                yield w.batch(*w.phrases(at, keys, 1), 1)
            for k in range(2, longest + 1):
                known = begins(keys)
                at, keys, known = at[known > 0], keys[known > 0], known[known > 0]
                # Both subphrases known: neighbours among the windows of k - 1 words.
                both = np.nonzero((at[1:] == at[:-1] + 1) & (w.codes[at[:-1] + k - 1] != 0))[0]
                begin = np.maximum(known[both], known[both + 1])
                at, keys = at[both], w.longer_keys(at[both], keys[both], k)
                if k == 3:
                    good = likely(keys)
                    at, keys, begin = at[good], keys[good], begin[good]
                active = begin > scan - shards
                if active.any():
                    yield w.batch(*w.phrases(at[active], keys[active], k), k)
                if not len(at):
                    break

    return shard.mapInArrow(run, "lang string, phrase binary, k int, n long")


#: All words of a phrase but the last, and all but the first.
HEAD = "substring(phrase, 1, 8 * (k - 1))"
TAIL = "substring(phrase, 9, 8 * (k - 1))"


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def frequent_phrases(coded: DataFrame, *, threshold: int = 100, longest: int = 5, shards: int = 4) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, n of all phrases that occur ``threshold`` times; lang, total of words)."""
    spark = coded.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    size = (coded.agg(F.sum(F.octet_length("codes").cast("long"))).first()[0] or 0) // 8
    pair_bits = min(max((size // 32).bit_length(), PAIR_BITS[0]), PAIR_BITS[1])
    estimates, totals = pair_estimates(in_tasks(coded, size), pair_bits)
    shrunk(coded, estimates, pair_bits, min(threshold, FULL), shards).write.partitionBy("shard").parquet(folder)
    dealt = spark.read.schema("lang string, runs binary, singles binary, shard int").parquet(folder)
    triple_bits = min(max((size // 16).bit_length(), PAIR_BITS[0]), PAIR_BITS[1])
    triples = triple_estimates(in_tasks(dealt.selectExpr("lang", "runs as codes"), size), triple_bits, min(threshold, FULL))
    # Phrases on their cycle, and the frequent ones that have completed theirs.
    counts, complete = spark.createDataFrame([], COUNTS), spark.createDataFrame([], COUNTS)
    scan, known, last = 0, 0, None
    # Phrases that the last newcomers activate complete their cycle ``shards`` scans after them.
    while scan < shards or (last is not None and scan <= last + shards):
        on_cycle = f"start + {shards} > {scan}"
        complete = complete.unionByName(counts.where(f"reached is not null and not {on_cycle}"))
        if scan and scan % shards == 0:
            complete = materialise(complete)
        counts = counts.where(on_cycle)
        shorter = complete.unionByName(counts.where("reached is not null")).where(f"k < {longest}")
        bits = min(max((16 * known).bit_length(), LEAST_BITS), MOST_BITS)
        plane = sketch(shorter, bits) if known else zlib.compress(bytes(ROWS * 2**bits))
        codes = F.concat("runs", "singles") if scan < shards else F.col("runs")
        shard = dealt.where(F.col("shard") == scan % shards).select("lang", codes.alias("codes"))
        seen = scanned(in_tasks(shard, size // shards), plane, bits, triples, triple_bits, scan, shards, longest)
        none = F.lit(None).cast("int")
        both = counts.select("*", F.lit(0).cast("long").alias("add")).unionByName(seen.select("lang", "phrase", "k", F.lit(0).cast("long").alias("n"), none.alias("start"), none.alias("reached"), F.col("n").alias("add")))
        met = both.groupBy("lang", "phrase", "k").agg(*(F.sum(c).alias(c) for c in ("n", "add")), *(F.max(c).alias(c) for c in ("start", "reached")))
        # Old and new phrases go on in one plan: with a plan for each the scan would run twice.
        for part, of in (("head", HEAD), ("tail", TAIL)):
            met = met.withColumn(part, F.expr(f"if(k > 1, {of}, phrase)"))
            met = met.join(sized(shorter.select("lang", F.col("phrase").alias(part), F.col("reached").alias(f"{part}_at")), known), ["lang", part], "left")
        start = F.expr("case when start is not null then start when k = 1 then 0 when head_at is not null and tail_at is not null then greatest(head_at, tail_at) + 1 end")
        met = met.withColumn("start", start).where(on_cycle).withColumn("n", F.col("n") + F.col("add"))
        reached = F.coalesce("reached", F.when(F.col("n") >= threshold, F.lit(scan)))
        counts = materialise(met.select("lang", "phrase", "k", "n", "start", reached.alias("reached")))
        newcomers = counts.where(f"reached = {scan} and k < {longest}").count()
        known, last, scan = known + newcomers, scan if newcomers else last, scan + 1
    return complete.unionByName(counts.where("reached is not null")).select("lang", "phrase", "k", "n"), totals


def scored_candidates(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates that stay."""
    rows = phrases.count()
    longer = phrases.where("k > 2")
    inside = longer.selectExpr("lang", f"{HEAD} as phrase", "n").unionByName(longer.selectExpr("lang", f"{TAIL} as phrase", "n")).distinct()
    cut = phrases.where("k > 1").select("lang", "phrase", "k", "n", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cut = cut.selectExpr("*", "substring(phrase, 1, 8 * cut) as left", "substring(phrase, 8 * cut + 1, 8 * (k - cut)) as right")
    for part, name in (("left", "l"), ("right", "r")):
        cut = cut.join(sized(phrases.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), rows), ["lang", part])
    cut = attach(cut, totals, "lang")
    exact = {c: F.col(c).cast("decimal(18,0)") for c in ("n", "total", "l", "r")}
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * exact["n"] * exact["total"], exact["l"] * exact["r"])
    lowest = F.min(F.struct(score.alias("score"), "cut", "l", "r", "total")).alias("low")
    scored = cut.groupBy("lang", "phrase", "n").agg(lowest).join(inside, ["lang", "phrase", "n"], "left_anti")
    return scored.select("lang", "phrase", F.col("n").alias("a"), "low.l", "low.r", F.col("low.total").alias("n"), "low.score")


def words_of(texts: DataFrame, phrases: DataFrame, salt: int) -> DataFrame:
    """code, word, other: the words behind the codes of the phrases; ``other`` differs from
    ``word`` if a code stands for several. A sketch of the frequent words finds them."""
    once = phrases.where("k = 1")
    bits = min(max((16 * once.count()).bit_length(), LEAST_BITS), MOST_BITS)
    plane = sketch(once.withColumn("reached", F.lit(0)), bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(plane), np.uint8).reshape(ROWS, -1)
        for langs, part in portions(batches):
            words = Words(part)
            codes = word_codes(words, salt)
            of = langs.dictionary_encode()
            salts = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in of.dictionary.to_pylist()], np.uint64)
            keys = mix(codes ^ salts[of.indices.to_numpy(zero_copy_only=False)[words.row]], 1)
            good = np.nonzero(np.minimum(*(table[r, cells(keys, r, bits)] for r in range(ROWS))))[0]
            good = words.different(codes, good)
            yield pa.RecordBatch.from_arrays([pa.array(codes[good].view(np.int64)), pa.array([words.spelled(i) for i in good.tolist()], pa.binary()).cast(pa.string())], ["code", "word"])

    found = texts.mapInArrow(run, "code long, word string").groupBy("code").agg(F.min("word").alias("word"), F.max("word").alias("other"))
    needed = with_codes(phrases.where("k > 1")).select("code").distinct()
    return materialise(found.join(needed, "code", "left_semi"))


def with_codes(phrases: DataFrame) -> DataFrame:
    """One row for each word of a phrase: place, code."""
    places = phrases.withColumn("place", F.explode(F.sequence(F.lit(0), (F.length("phrase") / 8).cast("int") - 1)))
    return places.withColumn("code", F.conv(F.hex(F.expr("substring(phrase, 8 * place + 1, 8)")), 16, -10).cast("long"))


def collocations(docs: DataFrame, *, threshold: int = 100, longest: int = 5, shards: int = 4, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` candidates of each language."""
    texts = spread(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null"))
    for salt in count():
        with settings(docs.sparkSession, BATCH):
            phrases, totals = frequent_phrases(materialise(encoded(texts, salt)), threshold=threshold, longest=longest, shards=shards)
            phrases = materialise(phrases)
            words = words_of(texts, phrases, salt)
        if words.where("word <> other").isEmpty():
            break
    scored = materialise(scored_candidates(phrases, totals))
    spelled = with_codes(scored.select("lang", "phrase")).join(sized(words.select("code", "word"), words.count()), "code")
    spelled = spelled.groupBy("lang", "phrase").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    scored = scored.join(spelled, ["lang", "phrase"]).withColumn("phrase", F.array_join("w.word", " ")).drop("w")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
