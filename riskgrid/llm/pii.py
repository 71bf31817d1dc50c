"""Personal data by candidate gradient boosting.

High-recall generators propose spans that may overlap: the four base kinds (email,
ip, card, phone), base-shaped spans that fail a check (Luhn, digit count, part
size), and other written forms (masked at-signs, phones without plus, IPv6).
Boosted trees score each candidate by its format and the text around it. They
learn from base spans that pass their checks, from the same spans rewritten to the
shapes that the other generators propose, and from candidates that fail a check and
touch no base span; the checks themselves are no features. Other forms found in the
corpus have no check to pass, so they are neither: nothing is learned from them.
A kind's threshold is calibrated on base spans and their rewritten forms in texts the
trees have not seen, so that ``recall`` of them would be selected, and is a half at
most; kinds with too few such base spans add nothing. Of overlapping selected
candidates the likelier one stays. Base spans always stay.

Training and finding read whole texts of all rows. Candidates to learn from are written
once, equal ones as one row with a count; the trees are grown and the thresholds are
found by Spark from all of them. Patterns run in linear time on any text: emails are
found from their at-sign, digit runs only from their first digit.

Defined results: null and empty texts have no spans; repeated rows are searched
one by one; an empty table gives an empty table.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import ddl, materialise

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
MASKED_AT = re.compile(r" ?[(\[] ?at ?[)\]] ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[] ?dot ?[)\]]) ?[A-Za-z0-9-]+)+")
#: A digit run starts where no digit precedes; a later start in it could only fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
PLAIN_PHONE = re.compile(r"(?<![0-9+])\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-][0-9]{3,4}(?![0-9])")
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "account", "pay"), "phone": ("phone", "tel", "call", "fax", "mobile")}
N_FEATURES = 26


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans from the at-sign: the longest local part to its left that starts after the
    span before, which is what a leftmost search finds."""
    before = 0
    for m in pattern.finditer(text):
        start = m.start()
        while start > before:
            chunk = text[max(before, start - 64):start]
            left = len(chunk.rstrip(LOCAL))
            start -= len(chunk) - left
            if left or not chunk:
                break
        if start < m.start():
            before = m.end()
            yield start, m.end()


def valid(kind: str, span: str) -> bool:
    """The check of a base-shaped span."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in span.split("."))
    digits = "".join(c for c in span if c in "0123456789")
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, is a base span), base spans first in the order of the kinds."""
    found = []
    if "@" in text:
        found += [("email", *s, True) for s in emails(text, AT)]
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            good = valid(kind, m.group())
            # Short digit runs are no card candidates; other failed spans stay candidates.
            if good or kind != "card" or m.end() - m.start() >= 12:
                found.append((kind, m.start(), m.end(), good))
    if "(" in text or "[" in text:
        found += [("email", *s, False) for s in emails(text, MASKED_AT)]
    if ":" in text:
        found += [("ip", m.start(), m.end(), False) for m in IP6.finditer(text)]
    return found + [("phone", m.start(), m.end(), False) for m in PLAIN_PHONE.finditer(text)]


def features(kind: str, span: str, before: str, after: str) -> list[float]:
    """Format of the span and its surroundings (32 code points on either side)."""
    digits, letters = sum(c in "0123456789" for c in span), sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    words = re.findall(r"[a-z]+", before.lower())[-4:]
    head, tail = before[-1:], after[:1]
    cue = [min((len(words) - i for i, w in enumerate(words) if w.startswith(CUES[k])), default=9) for k in KINDS]
    return [
        *(float(kind == k) for k in KINDS), len(span), digits, letters, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count("["), span.count(":"), float(span[:1] == "+"),
        float(head.isalnum()), float(tail.isalnum()), float(head in ('"', "'", "=", "/", "#", "$")), float(tail in ('"', "'", "/", "%", "#")),
        *cue, sum(c in "0123456789" for c in before), sum(c in "0123456789" for c in after)]


#: Rewritten forms of one span.
FORMS = 3
MASKS = [(at, dot) for at in (" (at) ", "(at)", " [at] ", "[at]") for dot in (".", " (dot) ", "(dot)", " [dot] ", "[dot]")]
DIALS = ("({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}")


def rewritten(kind: str, span: str) -> list[str]:
    """A base-shaped span in other written forms, each of a shape that ``candidates``
    proposes; which of them, follows from the span."""
    seed = hashlib.sha256(span.encode()).digest()
    if kind == "email":
        local, _, host = span.rpartition("@")
        return [local + at + host.replace(".", dot) for at, dot in (MASKS[(seed[0] + 7 * i) % len(MASKS)] for i in range(FORMS))]
    if kind == "ip":
        return [":".join(f"{int.from_bytes(seed[i + j:i + j + 2], 'big') >> (4 * (seed[j] % 8 == 0)):x}" for j in range(0, 16, 2)) for i in range(FORMS)]
    if kind == "phone":
        digits = re.findall("[0-9]", span)
        national = PLAIN_PHONE.search(span)
        parts = re.findall("[0-9]+", national.group()) if national else ["".join(digits[-10:-7]), "".join(digits[-7:-4]), "".join(digits[-4:])]
        forms = [DIALS[(seed[0] + i) % len(DIALS)].format(*parts) for i in range(FORMS)]
        return [f for f in ([national.group()] if national else []) + forms if PLAIN_PHONE.fullmatch(f)][:FORMS]
    return []


def refuted(kind: str, span: str) -> bool:
    """A candidate that fails a check. Masked e-mails and IPv6 have none to fail."""
    return kind != "email" and ":" not in span and not valid(kind, span)


def examples(text: str) -> Iterator[tuple[str, str, int, int, bool, float]]:
    """(kind, span, start, end, is a base span, label) to learn from. Candidates that
    touch a base span, and other forms that fail no check, are left out."""
    found = candidates(text)
    spans = sorted((a, b) for _, a, b, base in found if base)
    starts, reach = [a for a, _ in spans], list(accumulate((b for _, b in spans), max))
    for kind, a, b, base in found:
        span = text[a:b]
        if not base:
            before = bisect_left(starts, b)
            if not refuted(kind, span) or before and reach[before - 1] > a:
                continue
        yield kind, span, a, b, base, float(base)
        for other in rewritten(kind, span):
            if base or kind == "ip" or refuted(kind, other):
                yield kind, other, a, b, False, float(base)


@dataclass
class Model:
    forest: gbt.Forest
    thresholds: dict[str, float]


def ranked(values: np.ndarray, n: np.ndarray, q: float) -> tuple[float, float, float]:
    """Of values that occur ``n`` times the two next to the quantile ``q``, and the place
    of the quantile between them."""
    order = np.argsort(values)
    until = np.cumsum(n[order])
    at = (until[-1] - 1) * q
    low, high = (float(values[order[np.searchsorted(until, r, "right")]]) for r in (np.floor(at), np.ceil(at)))
    return low, high, at - np.floor(at)


def threshold_of(good: np.ndarray, bad: np.ndarray, recall: float, leak: float, floor: float, n_good: np.ndarray | None = None, n_bad: np.ndarray | None = None) -> float:
    """From this score on candidates are selected: the ``1 - recall`` quantile of unseen
    personal data, raised until at most ``leak`` of the unseen refuted candidates pass.
    A kind that then finds less than ``floor`` of its data adds nothing. Scores count
    once, or as often as said."""
    n_good, n_bad = (np.ones(len(s), np.int64) if n is None else n for s, n in ((good, n_good), (bad, n_bad)))
    low, high, between = ranked(good, n_good, 1 - recall)
    at = min(0.5, low + (high - low) * between)
    if len(bad):
        at = max(at, float(np.nextafter(ranked(bad, n_bad, 1 - leak)[1], 2.0)))
    return at if n_good[good >= at].sum() / n_good.sum() >= floor else np.inf


#: Scores are first counted in so many cells of equal width.
CELLS = 1 << 16


def thresholds_of(scored: DataFrame, recall: float, leak: float, floor: float) -> dict[str, float]:
    """``threshold_of`` each kind from the table of kind, good, score and n. The driver gets
    counts by cell, and single scores of the cells that hold the quantiles only: whatever
    the other scores are, they lie below or above."""
    cell = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1)).cast("int").alias("cell")
    scored = materialise(scored.groupBy("kind", "good", "score").agg(F.sum("n").alias("n")).select("*", cell))
    counts = scored.groupBy("kind", "good", "cell").agg(F.sum("n").alias("n")).toPandas()
    cells = {key: (of.cell.to_numpy(dtype=float), of.n.to_numpy()) for key, of in counts.groupby(["kind", "good"])}
    near = {(kind, int(c)) for (kind, good), (values, n) in cells.items() for c in ranked(values, n, 1 - recall if good else 1 - leak)[:2]}
    table = scored.sparkSession.createDataFrame(sorted(near), "kind string, cell int")
    single = scored.join(F.broadcast(table), ["kind", "cell"]).select("kind", "good", "score", "n").toPandas()
    out = {}
    for kind in KINDS:
        score, n = {}, {}
        for good in (True, False):
            values, count = cells.get((kind, good), (np.zeros(0), np.zeros(0, np.int64)))
            other = np.array([(kind, int(c)) not in near for c in values], bool)
            exact = single[(single.kind == kind) & (single.good == good)]
            score[good] = np.concatenate([values[other] / CELLS, exact.score.to_numpy(dtype=float)])
            n[good] = np.concatenate([count[other], exact.n.to_numpy(dtype=np.int64)])
        out[kind] = threshold_of(score[True], score[False], recall, leak, floor, n[True], n[False]) if len(score[True]) else np.inf
    return out


EXAMPLE = "kind string, base boolean, seen boolean, found boolean, y double, x array<double>"


def fit_pii(docs: DataFrame, *, recall: float = 0.98, leak: float = 0.05, floor: float = 0.8, least: int = 20, text_col: str = "text") -> Model:
    """Trees on the candidates of half of the texts, thresholds on the other half.
    Copies of a text are in the same half."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, seen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for kind, span, a, b, base, label in examples(text or ""):
                    out.append({"kind": kind, "base": base, "seen": seen, "found": span == text[a:b], "y": label, "x": features(kind, span, text[max(a - 32, 0):a], text[b:b + 32])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("kind", pa.string()), ("base", pa.bool_()), ("seen", pa.bool_()), ("found", pa.bool_()), ("y", pa.float64()), ("x", pa.list_(pa.float64()))]))

    found = docs.select(text_col, (F.pmod(F.xxhash64(text_col), F.lit(2)) == 0).alias("seen")).mapInArrow(run, EXAMPLE)
    table = materialise(found.groupBy("kind", "base", "seen", "found", "y", "x").agg(F.count(F.lit(1)).alias("n")))
    forest = gbt.fit_table(table.where("seen"), N_FEATURES)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(forest.probability(x), pa.float64())], ["kind", "good", "n", "score"])

    unseen = table.where("not seen")
    # Base spans stay whatever they score, so other forms set the bar; a kind without any adds nothing.
    judged = unseen.where("y = 1 and not base or y = 0 and found").select("kind", (F.col("y") == 1).alias("good"), "n", "x")
    thresholds = thresholds_of(judged.mapInArrow(score, "kind string, good boolean, n long, score double"), recall, leak, floor)
    bases = {r.kind: r.n for r in unseen.where("base").groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    return Model(forest, {kind: thresholds[kind] if bases.get(kind, 0) >= least else np.inf for kind in KINDS})


def select_spans(found: list[tuple[str, int, int, bool]], scores: np.ndarray, thresholds: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """Base spans and, of the other candidates over their kind's threshold, the likeliest
    that overlap no base span and no likelier one."""
    chosen = [c for c in found if c[3]]
    # Taken ranges as disjoint intervals by start: base spans may overlap, what is added does not.
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b, _ in chosen):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for i in sorted((i for i, c in enumerate(found) if not c[3] and scores[i] >= thresholds[c[0]]), key=lambda i: (-scores[i], found[i][1])):
        kind, a, b, _ = found[i]
        at = bisect_left(starts, b)
        if not at or ends[at - 1] <= a:
            starts.insert(at, a)
            ends.insert(at, b)
            chosen.append((kind, a, b, False))
    return sorted(chosen, key=lambda c: (c[1], KINDS.index(c[0]), c[2]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find_pii(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """carry and spans (kind, start, end in code points, base), by start, for every row."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "spans"]
    forest, thresholds = model.forest, model.thresholds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            found = [candidates(t) if t else [] for t in texts]
            x = [features(k, t[a:b], t[max(a - 32, 0):a], t[b:b + 32]) for t, c in zip(texts, found, strict=True) for k, a, b, _ in c]
            scores = forest.probability(np.array(x).reshape(len(x), N_FEATURES))
            parts = np.split(scores, np.cumsum([len(c) for c in found])[:-1]) if found else []
            spans = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in select_spans(c, s, thresholds)] for c, s in zip(found, parts, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(SPAN))], [*carry, "spans"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, f"{ddl(docs, carry)}, spans array<struct<kind: string, start: long, end: long, base: boolean>>")
