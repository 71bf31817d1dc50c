"""Findings of round 3 on the training-data operators."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from riskgrid.llm import collocations, gbt, pii, toxicity


def test_table_trees_are_those_of_the_rows(spark):
    rng = np.random.default_rng(3)
    x, n = np.round(rng.normal(size=(800, 3)) * 9), rng.integers(1, 4, 800)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 4) ^ (rng.random(800) < 0.05)).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(a), int(b)) for r, a, b in zip(x, y, n)], "x array<double>, y double, n long")
    want = gbt.fit(x.repeat(n, axis=0), y.repeat(n), trees=18, depth=3, bins=16)
    got = gbt.fit_table(rows, 3, trees=18, depth=3, bins=16)
    assert (got.feature == want.feature).all() and (got.threshold == want.threshold).all()
    assert got.probability(x) == pytest.approx(want.probability(x))


def test_pii_learns_from_every_document(spark):
    """Personal data only in documents that a sample of 20 000 by hash of the id leaves out."""
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    docs = spark.range(20_300).withColumnRenamed("id", "doc_id").withColumn("rank", F.row_number().over(order))
    made = F.concat(F.lit("write to u"), "doc_id", F.lit("@host.example.com or not 301.2.3."), F.col("doc_id"))
    docs = docs.select("doc_id", F.when(F.col("rank") > 20_000, made).otherwise("plain words").alias("text"))
    model = pii.fit_pii(docs)
    assert model.thresholds["email"] <= 0.5
    # Without a document id nothing is left out either.
    assert pii.fit_pii(docs.withColumn("doc_id", F.lit(None).cast("long"))).thresholds == model.thresholds


def test_thresholds_of_a_table_are_exact(spark):
    rng = np.random.default_rng(5)
    good, bad = np.round(rng.uniform(0.3, 1, 400), 5), np.round(rng.uniform(0, 0.4, 300), 5)
    rows = [("email", True, float(s), 1 + i % 3) for i, s in enumerate(good)] + [("email", False, float(s), 1 + i % 2) for i, s in enumerate(bad)] + [("ip", False, 0.5, 9)]
    got = pii.thresholds_of(spark.createDataFrame(rows, "kind string, good boolean, score double, n long"), 0.98, 0.05, 0.8)
    want = pii.threshold_of(good.repeat(1 + np.arange(400) % 3), bad.repeat(1 + np.arange(300) % 2), 0.98, 0.05, 0.8)
    assert got == {"email": want, "ip": np.inf, "card": np.inf, "phone": np.inf}


def test_emissions_are_looked_up_together(monkeypatch):
    """The emission of each word by its definition; no word of ASCII letters and marks alone is handled one by one."""
    rng = random.Random(6)
    pool = ["a", "Bad.", "bad?", "12abc34", "ab_c", "_", "--", "The,", "x\x1cq", "\x00z", "é!", "İx", "ΑΣ", "ß", "٣ab", "haanth"]
    texts = [None, "", " ", "\t\n", *("".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\x0b"]) for _ in range(rng.randint(0, 20))) for _ in range(60))]
    weights = {}
    for token in {toxicity.form(w.encode()) for w in pool}:
        weights |= {f: rng.uniform(-2, 2) for f in [*toxicity.own_features(token), "<" + token, ">" + token] if rng.random() < 0.7}
    want, starts = [], []
    for text in texts:
        words = (text or "").encode().split()
        tokens = [toxicity.form(w) for w in words]
        for i, t in enumerate(tokens):
            head = not i or words[i - 1].endswith(toxicity.STOPS)
            tail = i + 1 == len(words) or words[i].endswith(toxicity.STOPS)
            if head:
                starts.append(len(want))
            own = [weights.get(f, 0.0) for f in toxicity.own_features(t)]
            want.append(sum(own) + (0 if head else weights.get("<" + tokens[i - 1], 0.0)) + (0 if tail else weights.get(">" + tokens[i + 1], 0.0)))
    plain, alone = toxicity.form, []
    monkeypatch.setattr(toxicity, "form", lambda w: (alone.append(w), plain(w))[1])
    e, start, size = toxicity.Emissions(weights).of(pa.array(texts, pa.string()))
    assert e == pytest.approx(np.array(want)) and start.tolist() == starts
    assert size.tolist() == [len((t or "").encode().split()) for t in texts]
    assert alone and not any(w.isascii() for w in alone)


def test_field_is_learned_beside_texts_without_words(spark):
    rows = [(i, None if i % 5 == 0 else "" if i % 5 == 1 else f"vile{i % 3} stuff. and more" if i % 2 else "plain stuff. and more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, F.lit(True)), carry=["doc_id"]).collect()}
    assert len(got) == 40 and got[0] == got[1] and got[3] > got[2]


def test_collocation_scans_run_once_and_count_few_triples(spark, monkeypatch):
    """Pairs are frequent, triples are not: those are not counted, and a scan is in its plan once."""
    rows = [("en", f"a{i % 12} mid b{i // 12 % 12}. the same four words") for i in range(288)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    plain, triples, scans, rows_at_once = collocations.materialise, [], [], set()

    def seen(df):
        rows_at_once.add(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        if "reached" in df.columns and "MapInArrow" in (plan := df._jdf.queryExecution().optimizedPlan().toString()):
            scans.append(plan.count("MapInArrow"))
            triples.append((out := plain(df)).where("k = 3").count())
            return out
        return plain(df)
    monkeypatch.setattr(collocations, "materialise", seen)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r.phrase: r.a for r in collocations.collocations(docs, threshold=20).collect()}
    assert got["the same four words"] == 288 and got["a3 mid"] == 24 and "a3 mid b4" not in got
    assert scans and set(scans) == {1}
    assert max(triples) == 2
    assert "2000" in rows_at_once and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_codes_are_read_in_few_tasks(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 10 * cores)
    assert collocations.in_tasks(many, 1000).rdd.getNumPartitions() == cores
    monkeypatch.setattr(collocations, "TASK_BYTES", 8)
    assert collocations.in_tasks(many, 2 * cores + 1).rdd.getNumPartitions() == 3 * cores
    assert collocations.in_tasks(many, 10**9).rdd.getNumPartitions() == 10 * cores
