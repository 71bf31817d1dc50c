"""Steps that grew faster than their input: what they write, and that nothing is lost."""
import datetime as dt
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskgrid.operators import panes
from riskgrid.operators import text_vectors as TV
from riskgrid.operators.dynamics import position_features
from riskgrid.operators.rolling import rolling_to_grid
from riskgrid.session import ensure_checkpoint_dir


def _stored(spark) -> int:
    top = ensure_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, files in os.walk(top) for f in files)


def _grams(text: str) -> Counter:
    t = [w for w in text.lower().split() if len(w) > 1]
    return Counter(" ".join(t[i:i + n]) for n in (1, 2, 3) for i in range(len(t) - n + 1))


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, weights=range(1, 401), k=300)) for _ in range(60)]
    rows = [*enumerate(texts), (0, texts[0]), (None, "w1 w2 w1"), (None, "w1"), (90, None), (91, "")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").checkpoint()


@pytest.mark.parametrize(("size", "cells"), [(3, 2**20), (50, 64), (50, 2**20), (700, 512), (100_000, 2**20)])
def test_vocabulary_is_exact_for_any_cells(prose, size, cells):
    rows, docs = prose
    count = Counter()
    for _, text in rows:
        count += _grams(text or "")
    want = sorted(count.items(), key=lambda x: (-x[1], x[0]))[:size]
    got = TV.vocabulary(TV.occurrences(docs, "doc_id", "text"), size, cells).collect()
    assert sorted(((r.term, r.cf) for r in got), key=lambda x: (-x[1], x[0])) == want


def test_only_kept_terms_are_stored(spark, prose):
    """Before, the counts of every n-gram of every document were written."""
    rows, docs = prose
    before = _stored(spark)
    weights, vocab = TV.tfidf(docs, "doc_id", "text", max_features=20)
    assert _stored(spark) - before < 500_000
    df = {r.term: r.df for r in vocab.collect()}
    by_doc = {}
    for i, text in rows:
        by_doc[i] = by_doc.get(i, Counter()) + _grams(text or "")
    assert df == {t: sum(t in c for c in by_doc.values()) for t in df} and len(df) == 20
    norms = weights.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s"), F.count("*").alias("n")).collect()
    assert all(r.s == pytest.approx(1.0) for r in norms)
    assert {r.doc_id: r.n for r in norms} == {i: len(set(c) & set(df)) for i, c in by_doc.items() if set(c) & set(df)}


@pytest.fixture
def busy(spark):
    """One session of a 30 s grid of 40 points; five drivers with rows before, on and between its points."""
    from riskgrid.operators.grid import build_grid, grid_spec
    start = dt.datetime(2024, 3, 2, 15)
    s = spark.createDataFrame([(1, start, start + dt.timedelta(seconds=30 * 39))], "session_key long, date_start timestamp_ntz, date_end timestamp_ntz")
    rng = random.Random(3)
    rows = sorted((rng.randrange(-200, 1300), i, rng.randrange(5), rng.randrange(6)) for i in range(250))
    ev = spark.createDataFrame([(1, i, start + dt.timedelta(seconds=t), str(d), float(p)) for t, i, d, p in rows], "session_key long, event_id long, date timestamp_ntz, driver_number string, position double")
    spec = grid_spec(s, ["session_key"], 30)
    return rows, spec, build_grid(spec, ["session_key"], 30), ev


def test_copies_of_a_task_are_bounded(busy, monkeypatch):
    """Before, a task copied as many states as it had read; now more copies are more tasks,
    and small blocks of grid points change no result."""
    rows, spec, grid, ev = busy
    monkeypatch.setattr(panes, "COPIES", 50)
    monkeypatch.setattr(panes, "BLOCK_POINTS", 4)
    seen = []
    spread_by = panes.Panes.spread_by
    monkeypatch.setattr(panes.Panes, "spread_by", lambda *a, **k: seen.append(spread_by(*a, **k)) or seen[-1])
    aggs = [("d", "distinct", "driver_number", 120), ("d2", "distinct", "driver_number", 100), ("e", "entropy", "driver_number", 100)]
    got = {r.grid_k: r for r in rolling_to_grid(grid, spec, ev, ["session_key"], "date", 30, aggs).collect()}
    moved = {r.grid_k: r for r in position_features(grid, spec, ev, ["session_key"], 30, 100, 120, tiebreak="event_id").collect()}
    assert len(got) == len(moved) == 40
    for k in range(40):
        inside = lambda w: [r for r in rows if 30 * k - w < r[0] <= 30 * k]
        count = Counter(r[2] for r in inside(100))
        n = sum(count.values())
        assert (got[k].d, got[k].d2) == (len({r[2] for r in inside(120)}), len(count))
        assert got[k].e == pytest.approx(-sum(c / n * math.log2(c / n) for c in count.values()), abs=1e-9)
        steps = {w: {d: [abs(b[3] - a[3]) for a, b in zip(x, x[1:])] for d in range(5) if (x := [r for r in inside(w) if r[2] == d])} for w in (100, 120)}
        assert moved[k].position_changes_100s == sum(m > 0 for x in steps[100].values() for m in x)
        means = [sum(x) / len(x) for x in steps[120].values() if x]
        want = sum(means) / len(means) if means else None if steps[120] else 0.0
        assert moved[k].driver_position_volatility_120s == (None if want is None else pytest.approx(want))
    for x in seen:
        most = x.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert x.rdd.getNumPartitions() >= x.count() / 50 and most < x.count() / 2


def test_texts_of_a_task_are_bounded(busy, monkeypatch):
    """Before, texts were copied to the widest window of any aggregate, by as many tasks as a
    shuffle has; now longer texts are more tasks, and only windows of texts are filled."""
    rows, spec, grid, ev = busy
    ev = ev.withColumn("message", F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("m" * 90), F.col("event_id").cast("string"))))
    monkeypatch.setattr(panes, "COPIES", 100)
    seen, spread_by = [], panes.Panes.spread_by
    monkeypatch.setattr(panes.Panes, "spread_by", lambda *a, **k: seen.append((a[2], spread_by(*a, **k))) or seen[-1][1])
    aggs = [("n", "count", None, 600), ("c", "concat", "message", 100), ("t", "text", "message", 70)]
    got = {r.grid_k: r for r in rolling_to_grid(grid, spec, ev, ["session_key"], "date", 30, aggs, tiebreak="event_id").collect()}
    assert len(got) == 40
    for k in range(40):
        said = {w: ["m" * 90 + str(r[1]) if r[1] % 7 else "" for r in rows if 30 * k - w < r[0] <= 30 * k] for w in (600, 100, 70)}
        assert (got[k].n, got[k].c, got[k].t) == (len(said[600]), " | ".join(said[100]), " ".join(said[70]))
    (window, copies), = seen
    size = sum(len(r.x) for r in copies.select(F.explode("_items_0").alias("x")).collect())
    assert window == 100 and copies.rdd.getNumPartitions() >= size / 100 / 100


def test_a_file_of_texts_fills_a_batch_of_bounded_size(busy, monkeypatch):
    """Before, 32 grid points were one block however long their texts: its file, which a
    Parquet reader takes in one batch, grew with the density of the messages. Sizes were added
    up by reading every text."""
    from riskgrid.operators import rolling
    rows, spec, grid, ev = busy
    long = ev.where("event_id < 40").withColumn("message", F.concat(F.repeat(F.lit("m"), 4000), F.col("event_id").cast("string")))
    monkeypatch.setattr(panes, "COPIES", 10_000)  # 160 kB
    kept, written = [], rolling.written
    monkeypatch.setattr(rolling, "written", lambda df: kept.append(written(df)) or kept[-1])
    got = rolling_to_grid(grid, spec, long, ["session_key"], "date", 30, [("c", "concat", "message", 600)], tiebreak="event_id").collect()
    want = {k: [r[1] for r in rows if r[1] < 40 and 30 * k - 600 < r[0] <= 30 * k] for k in range(40)}
    assert {r.grid_k: r.c for r in got} == {k: " | ".join("m" * 4000 + str(i) for i in x) for k, x in want.items()}
    texts, = [df for df in kept if "c" in df.columns]
    files = texts.groupBy(F.input_file_name()).agg(F.sum(F.octet_length("c")).alias("n"), F.count("*").alias("rows")).collect()
    assert sum(f.n for f in files) > 1e6 and all(f.n < 4 * 160_000 or f.rows == 1 for f in files)
    assert texts.agg(F.sum("_bytes")).first()[0] == sum(f.n for f in files)


def _coded_docs(spark):
    rng = random.Random(12)
    words = [f"w{min(rng.randrange(1, 40), rng.randrange(1, 40))}" for _ in range(900)]
    rows = [(i // 2 if i < 20 else i, " ".join(words[15 * i:15 * i + rng.randrange(40)])) for i in range(58)]
    return spark.createDataFrame([*rows, (None, "w1 w2 w3 w1 w2"), (None, "w1 w2 \u00c9t\u00e9"), (90, None), (91, "a ! b")], "doc_id long, text string")


@pytest.mark.parametrize("size", [5, 60, 5000])
def test_terms_by_word_codes(spark, size, monkeypatch):
    """Same terms and weights as counting strings, with pieces shorter than texts, ids that repeat
    or are null, and more terms than there are; no n-gram is made a string row on the way (before, all were)."""
    docs = _coded_docs(spark)

    def found():
        weights, vocab = TV.tfidf(docs, "doc_id", "text", max_features=size)
        return {(r.doc_id, r.term): r.weight for r in weights.collect()}, {r.term: (r.df, r.cf, r.idf) for r in vocab.collect()}, weights.count()

    with monkeypatch.context() as m:
        m.setattr(TV.CT, "term_rows", lambda *a, **k: None)
        w0, v0, n0 = found()
    monkeypatch.setattr(TV.CT, "PIECE", 4)
    monkeypatch.setattr(TV, "occurrences", None)
    w1, v1, n1 = found()
    assert n0 == n1 == len(w1) and w1 == pytest.approx(w0) and (None, "w1") in w1
    assert v1.keys() == v0.keys() and all(v1[t] == pytest.approx(v0[t]) for t in v0) and len(v1) == min(size, len(v0))


def test_too_many_frequent_words_are_counted_as_strings(spark, monkeypatch):
    docs = _coded_docs(spark)
    assert TV.CT.term_rows(docs, "doc_id", "text", TV.tokens("_text"), 20, (1, 3), words_at_most=3) is None
    rows, terms = TV.CT.term_rows(docs, "doc_id", "text", TV.tokens("_text"), 20, (1, 1))
    assert len(terms) == 20 and all(" " not in t for t, _ in terms) and terms == sorted(terms)
    assert sum(sum(r.tf) for r in rows.collect()) == sum(n for _, n in terms)


def test_pieces_are_handled_a_few_at_once():
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([[1, 2], [3], [], [4, 5, 6, 7]], pa.list_(pa.int32()))], ["doc_id", "codes"])
    got = [(i.to_pylist(), n.tolist(), c.tolist()) for i, n, c in TV.CT._pieces(iter([batch.slice(1), batch]), 3)]
    assert got == [([2, 3], [1, 0], [3]), ([4], [4], [4, 5, 6, 7]), ([1, 2, 3], [2, 1, 0], [1, 2, 3]), ([4], [4], [4, 5, 6, 7])]
