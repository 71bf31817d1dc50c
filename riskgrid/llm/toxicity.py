"""Toxicity: a linear-chain conditional random field over word tokens.

Labelled tokens come from labelled documents: a token of a toxic document is toxic
if its form or one of its prefixes stands almost only in toxic documents. Chains
are sentences. The field has two tags; a token's features are its form, prefixes,
suffix and both neighbours. Forward-backward
marginals give each token's probability; their sum, maximum and density make the
document's score by logistic regression, and runs of likely tokens its spans.

Document counts of features are summed over tasks by Spark. The driver gets at
most ``MARKS`` feature names, ``CHAINS`` chains and three numbers for each of at
most ``sample`` labelled documents of either class; all are documented bounds.

Defined results: null and empty texts score like a text without toxic tokens;
labels without a value or with an unknown id are not used; without labels of both
classes every score is the labels' smoothed share; repeated rows are scored one by
one.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ddl
from .quality import labelled_sample

MARKS = 20_000
CHAINS = 20_000
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
STOPS = (b".", b"!", b"?")
#: ASCII characters that are no letters.
MARGIN = "".join(chr(c) for c in range(128) if not chr(c).isalpha())


def form(word: bytes) -> str:
    """Lower-cased word without marks and digits at its ends."""
    token = word.decode("utf-8", "replace").lower()
    return token if token.isalpha() else EDGE.sub("", token)


def own_features(token: str) -> list[str]:
    return ["=" + token, *("^" + token[:n] for n in (4, 5, 6, 7)), "$" + token[-4:]]


def chains_of(ends: np.ndarray) -> np.ndarray:
    """Start of each chain: the first word and each word after one that ends a sentence."""
    return np.concatenate([[0], np.nonzero(ends[:-1])[0] + 1]) if len(ends) else np.zeros(0, np.int64)


def step(r: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Message over one transition: log odds of the next tag given log odds ``r``;
    ``to[i, j]`` is the weight of going from tag i to tag j, as a factor."""
    odds = np.exp(np.clip(r, -60, 60))
    return np.log((to[0, 1] + to[1, 1] * odds) / (to[0, 0] + to[1, 0] * odds))


def marginals(e: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of the toxic tag of each token given its chain, and the messages from
    the left (own emission included) and from the right. Chains advance together, the
    longest first, so each step handles one token of every chain that is still running."""
    length = np.diff(np.append(start, len(e)))
    order = np.argsort(-length, kind="stable")
    first, length = start[order], length[order]
    running = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    left, right, factor = e.copy(), np.zeros(len(e)), np.exp(trans)
    for t in range(1, len(running)):
        at = first[:running[t]] + t
        left[at] += step(left[at - 1], factor)
    last = first + length - 1
    for t in range(1, len(running)):
        at = last[:running[t]] - t
        right[at] = step(right[at + 1] + e[at + 1], factor.T)
    return left + right, left, right


@dataclass
class Field:
    """Weights of features by name, and of transitions between the two tags."""

    weights: dict[str, float]
    trans: np.ndarray


def forms(words: pa.Array) -> pa.Array:
    """``form`` of every word; words of ASCII only are trimmed by Arrow, others one by one."""
    out = pc.ascii_trim(pc.ascii_lower(words), characters=MARGIN)
    other = pc.invert(pc.string_is_ascii(words))
    if pc.any(other).as_py():
        out = pc.replace_with_mask(out, other, pa.array([form(w.encode()) for w in words.filter(other).to_pylist()], pa.string()))
    return out


class Emissions:
    """What each different word of some texts adds to its own token, to the next and to the
    previous one. Weights are looked up in tables by kind of feature, all forms at once."""

    def __init__(self, weights: dict[str, float]):
        self.tables = {}
        for kind in "=^$<>":
            names = [f for f in weights if f[0] == kind]
            self.tables[kind] = pa.array([f[1:] for f in names], pa.string()), np.array([weights[f] for f in names] + [0.0])

    def weight(self, kind: str, tokens: pa.Array) -> np.ndarray:
        names, weights = self.tables[kind]
        return weights[pc.fill_null(pc.index_in(tokens, value_set=names), len(names)).to_numpy(zero_copy_only=False)]

    def rows(self, words: pa.Array) -> np.ndarray:
        """Own emission, what is added to the next and to the previous token, ends a sentence."""
        of = forms(words).dictionary_encode()
        token = of.dictionary
        own = self.weight("=", token)
        for n in (4, 5, 6, 7):
            own = own + self.weight("^", pc.utf8_slice_codeunits(token, 0, n))
        own = own + self.weight("$", pc.utf8_slice_codeunits(token, -4))
        table = np.column_stack([own, self.weight("<", token), self.weight(">", token)])[of.indices.to_numpy()]
        ends = np.any([pc.ends_with(words, stop.decode()).to_numpy(zero_copy_only=False) for stop in STOPS], axis=0)
        return np.column_stack([table, ends])

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(emissions, chain starts, words of each text) of several texts, one after the other."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        flat = lists.flatten()
        kept = pc.greater(pc.binary_length(flat), 0)
        row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())[kept.to_numpy(zero_copy_only=False)]
        size = np.bincount(row, minlength=len(texts))
        words = flat.filter(kept).dictionary_encode()
        table = self.rows(words.dictionary)[words.indices.to_numpy()]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])[size > 0] if len(size) else size
        ends = table[:, 3] > 0
        ends[first[1:] - 1] = True
        start, e = chains_of(ends), table[:, 0].copy()
        inside = np.ones(len(e), bool)
        inside[start] = False
        after = np.nonzero(inside)[0]
        e[after] += table[after - 1, 1]
        e[after - 1] += table[after, 2]
        return e, start, size


def fit_field(chains: list[list[str]], tags: list[list[int]], *, rounds: int = 40, rate: float = 0.3, l2: float = 1e-3) -> Field:
    """Maximum likelihood by Adagrad on all chains at once; exact gradients from the marginals."""
    trans = np.zeros((2, 2))
    if not chains:
        return Field({}, trans)
    index: dict[str, int] = {}
    known: dict[str, list[int]] = {}

    def slot(feature: str) -> int:
        return index.setdefault(feature, len(index))

    rows = []
    for c in chains:
        for i, token in enumerate(c):
            own = known.setdefault(token, [slot(f) for f in own_features(token)])
            rows.append([*own, slot("<" + c[i - 1]) if i else -1, slot(">" + c[i + 1]) if i + 1 < len(c) else -1])
    x, y, weights = np.array(rows), np.concatenate(tags).astype(float), np.zeros(len(index))
    valid, start = x >= 0, np.concatenate([[0], np.cumsum([len(c) for c in chains])[:-1]])
    pair = np.ones(len(y), bool)
    pair[start] = False
    b = np.nonzero(pair)[0]
    a = b - 1
    seen = np.array([[((y[a] == i) & (y[b] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    sw, st = np.full(len(index), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        e = np.where(valid, weights[x], 0).sum(axis=1)
        odds, left, right = marginals(e, start, trans)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        g = np.bincount(x[valid], weights=np.repeat(p - y, x.shape[1]).reshape(x.shape)[valid], minlength=len(index)) / len(chains) + l2 * weights
        joint = np.stack([np.stack([trans[i, j] + i * left[a] + j * (e[b] + right[b]) for j in (0, 1)]) for i in (0, 1)])
        joint = np.exp(joint - joint.max(axis=(0, 1)))
        expected = (joint / joint.sum(axis=(0, 1))).sum(axis=2)
        gt = (expected - seen) / len(chains) + l2 * trans
        sw += g * g
        st += gt * gt
        weights -= rate * g / np.sqrt(sw)
        trans -= rate * gt / np.sqrt(st)
    return Field({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}, trans)


def token_marginals(texts: pa.Array, emissions: Emissions, trans: np.ndarray) -> list[np.ndarray]:
    """Toxic probability of every word of every text; all chains of a batch run together."""
    e, start, size = emissions.of(texts)
    odds = marginals(e, start, trans)[0]
    return np.split(1 / (1 + np.exp(-np.clip(odds, -30, 30))), np.cumsum(size)[:-1]) if len(size) else []


def portions(batch: pa.RecordBatch, size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose last column holds about ``size`` bytes, or one row."""
    length = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        done = length[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(length, done + size, "right")))
        yield batch.slice(start, end - start)
        start = end


def summary(p: np.ndarray) -> list[float]:
    return [float(np.log1p(p.sum())), float(p.max()), float(p.mean())] if len(p) else [0.0, 0.0, 0.0]


def toxic_spans(text: str | None, p: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens of probability ``least`` or more, as code point offsets."""
    if not len(p) or p.max() < least:
        return []
    out: list[dict] = []
    for i, m in enumerate(WORDS.finditer(text)):
        if p[i] >= least:
            if out and i and p[i - 1] >= least:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
    return out


@dataclass
class Model:
    field: Field
    coef: np.ndarray
    bias: float


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, l2: float = 1e-2) -> tuple[np.ndarray, float]:
    """Newton steps on weighted rows with a small penalty."""
    if not len(y):
        return np.zeros(x.shape[1]), 0.0
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        w -= np.linalg.solve(h, a.T @ (weight * (p - y)) + l2 * w)
    return w[:-1], float(w[-1])


def toxic_marks(rows: DataFrame, text_col: str, least_docs: int, share: float) -> dict[str, float]:
    """Forms and prefixes that at least ``share`` of at least ``least_docs`` documents with
    them are toxic; the MARKS most frequent."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                marks = {f for w in set((text or "").encode().split()) for f in own_features(form(w))[:5] if len(f) > 3}
                total.update(marks)
                if label:
                    toxic.update(marks)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([total[k] for k in keys], pa.int64()), pa.array([toxic[k] for k in keys], pa.int64())], ["mark", "n", "toxic"])

    counts = rows.select(text_col, "_label").mapInArrow(count, "mark string, n long, toxic long").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    good = counts.where((F.col("n") >= least_docs) & (F.col("toxic") >= share * F.col("n"))).orderBy(F.desc("n"), "mark").limit(MARKS)
    return {r.mark: r.toxic / r.n for r in good.collect()}


def tagged_chains(rows: DataFrame, marks: dict[str, float], text_col: str) -> list:
    """At most CHAINS (tokens, tags), by hash: of toxic documents the chains with toxic
    tokens, of clean ones three chains each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                words = (text or "").encode().split()
                if not words:
                    continue
                start = chains_of(np.fromiter((w.endswith(STOPS) for w in words), bool, len(words)))
                bounds = list(zip(start, np.append(start[1:], len(words)), strict=True))
                if not label:
                    bounds = sorted(bounds, key=lambda x: xxhash.xxh3_64_intdigest(b" ".join(words[x[0]:x[1]])))[:3]
                for a, b in bounds:
                    tokens = [form(w) for w in words[a:b]]
                    tags = [int(label > 0 and any(f in marks for f in own_features(t)[:5])) for t in tokens]
                    if any(tags) or not label:
                        out.append({"tokens": tokens, "tags": tags, "any": any(tags)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("any", pa.bool_())]))

    chains = rows.select(text_col, "_label").mapInArrow(run, "tokens array<string>, tags array<int>, any boolean")
    order = F.xxhash64("tokens")
    return [r for toxic in (True, False) for r in chains.where(F.col("any") == toxic).orderBy(order, "tokens").limit(CHAINS // 2).collect()]


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, *, label: str = "toxic", sample: int = 4_000, least_docs: int = 4, share: float = 0.9, id_col: str = "doc_id", text_col: str = "text") -> Model:
    kinds = [labelled_sample(labels, label, learn & (F.col(label) == x), sample, id_col) for x in (1, 0)]
    chosen = kinds[0].unionByName(kinds[1])
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col)).join(F.broadcast(chosen), "_id")
    marks = toxic_marks(rows, text_col, least_docs, share)
    chains = tagged_chains(rows, marks, text_col)
    field = fit_field([r.tokens for r in chains], [r.tags for r in chains])
    table = with_marginals(rows, field, ["_id", "_label"], text_col, spans=False).orderBy("_id", "_label").limit(4 * sample).toPandas()
    x, y = np.array(table.summary.to_list()).reshape(len(table), 3), table._label.to_numpy()
    # The classes are sampled apart; weights bring back their shares among the labels.
    share_1 = labels.where(learn).agg(F.avg((F.col(label) > 0).cast("double"))).first()[0] or 0.0
    weight = np.where(y > 0, share_1 / max(y.mean(), 1e-9), (1 - share_1) / max(1 - y.mean(), 1e-9)) if len(y) else y
    return Model(field, *logistic(x, y, weight))


def with_marginals(docs: DataFrame, field: Field, carry: list[str], text_col: str, *, spans: bool = True, least: float = 0.5) -> DataFrame:
    weights, trans = field.weights, field.trans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(weights)
        for batch in (part for b in batches for part in portions(b)):
            texts = batch.column(batch.num_columns - 1)
            p = token_marginals(texts, emissions, trans)
            # Only texts with a likely word are turned into Python strings.
            found = [toxic_spans(texts[i].as_py(), x, least) if spans and len(x) and x.max() >= least else [] for i, x in enumerate(p)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([summary(x) for x in p], pa.list_(pa.float64())), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], [*carry, "summary", "spans"])

    return docs.select(*carry, F.col(text_col).alias("_text")).mapInArrow(run, f"{ddl(docs, carry)}, summary array<double>, spans array<struct<start: long, end: long>>")


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None, least: float = 0.5) -> DataFrame:
    """carry, score (probability of label 1), spans (code points of the offending words)."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {"score", "spans", "summary"}]
    out = with_marginals(docs, model.field, carry, text_col, least=least)
    margin = F.lit(model.bias)
    for i, c in enumerate(model.coef):
        margin = margin + float(c) * F.get("summary", F.lit(i))
    return out.select(*carry, (1 / (1 + F.exp(-margin))).alias("score"), "spans")
