"""Operators of the training-data subpackage: SQL oracles, brute force, odd inputs."""
import collections
import hashlib
import itertools
import os
import random
import re
import time

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskgrid.llm import gbt, pii, queries, toxicity
from riskgrid.llm.chat import escaped, expand_targets, read_back, unescaped
from riskgrid.llm.common import Rolling, attach, sliding_min, without
from riskgrid.llm.host_rules import host_rules
from riskgrid.llm.hyperminhash import cell_links, collision_rate, components, estimate, multipliers, near_duplicates, registers
from riskgrid.llm.mixing import copies, mix_sources, words_taken
from riskgrid.llm.quality import fit_quality, score_quality
from riskgrid.llm.sharding import cut_bounds, minimax_cuts, shard_documents
from riskgrid.llm.substrings import remove_repeats
from riskgrid.llm.winnowing import decontaminate, fingerprints

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
LOWER_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TABLES = ("documents", "labels", "benchmark", "conversations")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, score double, spans string, rate double, size long, `row` int, items string"


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def odd_rows():
    rng = random.Random(3)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(30_000))
    base = " ".join(f"w{i}" for i in range(120))
    texts = [None, "", " \t\n ", "one", "two words", base, base, base + " tail", "x " * 400, long, "a b été 中文 end.", "###&&& $$$ " * 40]
    out = [(i, t, None, None if i % 3 == 0 else "s", None, 7, None, None, "q", 1.0, 3, 1, "z") for i, t in enumerate(texts)]
    return [*out, out[5], (None, base, *out[0][2:]), (None, None, *[None] * 11)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda d: sorted(tuple(map(str, r)) for r in d[cols].itertuples(index=False))
    assert key(got) == key(want)


# Helpers

def test_rolling_and_sliding():
    h = np.random.default_rng(0).integers(0, 2**63, 300, dtype=np.uint64)
    r = Rolling()
    both = np.concatenate([h, h[40:90]])
    w = r.windows(both, 7)
    assert (w[40:84] == w[300:344]).all() and len(set(w.tolist())) == len(w) - 44
    assert (r.spans(r.sums(both), np.array([40, 300]), np.array([90, 350]))[:1] == r.spans(r.sums(both), np.array([300]), np.array([350]))).all()
    for n in (1, 2, 3, 31):
        assert (sliding_min(h, n) == [h[i:i + n].min() for i in range(len(h) - n + 1)]).all()


def test_attach_and_without_beyond_broadcast(spark, odd, monkeypatch):
    from riskgrid.llm import common
    dim = odd.groupBy("source").agg(F.count("*").alias("c"))
    small = rows_of(attach(odd.select("doc_id", "source"), dim, "source"), "doc_id", "source", "c")
    gone = odd.select("doc_id", "source").where("doc_id is null or doc_id < 4")
    left = rows_of(without(odd, gone, ["doc_id", "source"]), "doc_id")
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert rows_of(attach(odd.select("doc_id", "source"), dim, "source"), "doc_id", "source", "c") == small
    assert rows_of(without(odd, gone, ["doc_id", "source"]), "doc_id") == left
    assert sorted(x[0] for x in left) == [4, 5, 5, 6, 7, 8, 9, 10, 11]


# 1 Personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            s = m.group()
            digits = re.sub("[^0-9]", "", s)
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], list(PATTERNS).index(x[0])))


def test_pii_base_spans():
    rng = random.Random(1)
    pieces = ["a.b@c.de", "@", "x@y", "@@a@b.c.d@e.f", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (068) 555-2748", "+49 30 1", "+12", " ", ".", "9" * 30, "é", "(at)", "a%+_@-.-", "٣"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", "-", "."]) for _ in range(rng.randint(1, 9)))
        got = [c[:3] for c in pii.select_spans(pii.candidates(text), np.zeros(99), dict.fromkeys(pii.KINDS, np.inf))]
        assert got == brute_spans(text), text
    assert pii.candidates("a" * 300_000 + "@b." + "1" * 300_000 + "." * 50_000)


def test_pii_query(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op1_pii_boosting"](spark, SF01).collect()}
    added = 0
    for d, t in duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall():
        base = [":".join(map(str, x)) for x in brute_spans(t)]
        assert got[d].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = [x for x in got[d].spans.split(",") if x]
        assert set(base) <= set(spans)
        added += len(spans) - len(base)
    assert len(got) == 1000
    # Runs that fail Luhn look like cards that pass; at most one in twenty may be added.
    docs = duckdb.sql(f"select doc_id, text from '{SF01}/documents.parquet'").fetchall()
    runs = {(d, f"{k}:{a}:{b}") for d, t in docs for k, a, b, base in pii.candidates(t) if k == "card" and not base}
    assert len(runs) > 5 and sum(s in got[d].spans.split(",") for d, s in runs) <= len(runs) / 20 and added <= 10


def test_pii_thresholds_on_both_classes():
    rng = np.random.default_rng(1)
    good, bad = rng.uniform(0.6, 1, 500), rng.uniform(0, 0.7, 500)
    at = pii.threshold_of(good, bad, 0.98, 0.05, 0.8)
    assert 0.6 < at < 0.7 and (bad >= at).mean() <= 0.05 and (good >= at).mean() >= 0.8
    assert pii.threshold_of(good, good, 0.98, 0.05, 0.8) == np.inf
    assert pii.threshold_of(good, np.zeros(0), 0.98, 0.05, 0.8) == 0.5


def test_pii_selection_is_linear():
    rng = random.Random(2)
    found = [("phone", a := 20 * i + rng.randint(0, 8), a + rng.randint(5, 25), i % 3 == 0) for i in range(50_000)]
    scores = np.array([rng.random() for _ in found])
    began = time.perf_counter()
    got = pii.select_spans(found, scores, {"phone": 0.2})
    assert time.perf_counter() - began < 3
    few, few_scores = found[:300], scores[:300]
    taken = [(a, b) for _, a, b, base in few if base]
    for i in sorted((i for i, c in enumerate(few) if not c[3] and scores[i] >= 0.2), key=lambda i: (-few_scores[i], few[i][1])):
        if not any(few[i][1] < y and x < few[i][2] for x, y in taken):
            taken.append(few[i][1:3])
    assert sorted(taken) == sorted((a, b) for _, a, b, _ in pii.select_spans(few, few_scores, {"phone": 0.2})) and len(got) > 20_000


def planted_pii():
    """Rows with base spans, and rows with other forms, number runs and what must be found."""
    rng = random.Random(11)

    def words():
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(3, 9)))

    def host(dot):
        return dot.join([words()[:5].strip().replace(" ", "x") + "h", "example", "com"])

    def number(n):
        return "".join(rng.choice("0123456789") for _ in range(n))

    makers = {
        "email": lambda i: f"u{number(3)}@{host('.')}", "ip": lambda i: ".".join(str(rng.randrange(256)) for _ in range(4)), "phone": lambda i: f"+1 ({number(3)}) 555-{number(4)}", "broken": lambda i: f"{300 + rng.randrange(600)}.{number(3)}.1.{number(2)}", "amount": lambda i: f"{rng.randint(10, 99)}.{number(3)}.{number(3)}",
        "masked": lambda i: f"v{number(3)}" + [" (at) ", "(at)", "[at]", " [at] "][i % 4] + host([".", " (dot) ", "[dot]"][i % 3]),
        "plain": lambda i: [f"({number(3)}) 555-{number(4)}", f"{number(3)}-555-{number(4)}", f"{number(3)} 555 {number(4)}", f"{number(3)}.555.{number(4)}"][i % 4],
        "ip6": lambda i: ":".join(f"{rng.randrange(65536):x}" for _ in range(8))}
    rows = []
    for kind, make in makers.items():
        for i in range(150):
            before, span = words() + " ", make(i)
            rows.append((len(rows), f"{before}{span} {words()}", kind, len(before), len(before) + len(span)))
    return rows


def test_pii_other_forms(spark):
    rows = planted_pii()
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, a long, b long")
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.find_pii(docs, pii.fit_pii(docs), carry=["doc_id"]).collect()}
    for form, kind in (("masked", "email"), ("plain", "phone"), ("ip6", "ip")):
        assert sum((kind, a, b) in got[d] for d, _, f, a, b in rows if f == form) >= 143, form
    for form in ("broken", "amount"):
        assert sum(bool(got[d]) for d, _, f, _, _ in rows if f == form) <= 15, form


def test_pii_examples():
    for kind, span in (("email", "a.b@c.example.de"), ("ip", "10.2.3.4"), ("phone", "+1 (068) 555-2748"), ("phone", "+49301234567")):
        forms = pii.rewritten(kind, span)
        assert len(forms) >= 2
        for form in forms:
            assert (kind, 3, 3 + len(form), False) in pii.candidates(f"to {form} or"), form
    text = "+1 (017) 555-7713 or (017) 555-7713 or me (at) x.org or 1:2:3:4:5:6:7:8 or 12.345.678 or 256.1.1.1"
    assert {(k, s) for k, s, a, b, _, y in pii.examples(text) if y == 0 and text[a:b] == s} == {("phone", "12.345.678"), ("ip", "256.1.1.1")}
    assert all(text[a:b] == "+1 (017) 555-7713" for _, _, a, b, _, y in pii.examples(text) if y == 1)


def test_pii_odd(odd, empty):
    model = pii.fit_pii(odd)
    assert model.thresholds == dict.fromkeys(pii.KINDS, np.inf)
    assert pii.find_pii(odd, model).count() == 15
    assert pii.find_pii(empty, pii.fit_pii(empty), carry=["doc_id"]).count() == 0


# 2 Substring dedup

def test_substrings_brute_force(spark):
    rng = random.Random(2)
    passage = [f"p{i}" for i in range(140)]
    docs = []
    for i in range(30):
        words = [f"d{i}w{j}" for j in range(rng.randint(0, 60))]
        a = rng.randint(0, 80)
        at = rng.randint(0, len(words))
        docs.append((i, " ".join(words[:at] + passage[a:a + rng.randint(20, 120)] + words[at:] + ["r"] * rng.choice([0, 130]))))
    first, gone = {}, {}
    for i, t in docs:
        w = t.split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j:j + 50]), i)
    for i, t in docs:
        w = t.split()
        gone[i] = {p for j in range(len(w) - 49) if first[tuple(w[j:j + 50])] < i for p in range(j, j + 50)}
    want = [(i, len(t.split()), len(gone[i]), " ".join(x for p, x in enumerate(t.split()) if p not in gone[i])) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # A sketch of 64 cells is full: it must pass everything on and change nothing.
    for bits in (16, 9):
        assert rows_of(remove_repeats(df, bits=bits), "doc_id", "n_words", "n_removed", "text") == sorted(want, key=str)


def test_substrings_odd(odd, empty):
    got = {(r.doc_id, r.n_words): r for r in remove_repeats(odd, bits=12).collect()}
    assert got[(5, 120)].n_removed == 0 and got[(6, 120)].n_removed == 120 and got[(7, 121)].text == "tail"
    assert got[(None, 120)].n_removed == 120 and got[(0, 0)].text == "" and got[(8, 400)].n_removed == 0
    assert remove_repeats(empty, bits=12).count() == 0


# 3, 4 Classifiers

def test_gbt_learns_and_degenerates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    f = gbt.fit(x[:2000], y[:2000])
    assert ((f.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    assert gbt.fit(x[:5], np.ones(5)).probability(x[:2]) == pytest.approx([6 / 7] * 2)
    assert gbt.fit(x[:0], y[:0]).probability(x[:1]) == pytest.approx([0.5])


@pytest.mark.parametrize(("name", "label", "least"), [("op3_quality_trees", "quality", 0.95), ("op4_toxicity_crf", "toxic", 0.75)])
def test_classifier_held_out(spark, name, label, least):
    got = queries.QUERIES[name](spark, SF01).toPandas()
    m = got.merge(duckdb.sql(f"select * from '{SF01}/labels.parquet'").df(), on="doc_id")
    m = m[m.held_out]
    rank = m.score.rank()
    n1 = m[label].sum()
    auc = (rank[m[label] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(m) - n1))
    assert len(got) == 1000 and got.score.between(0, 1).all() and auc >= least


def test_classifiers_odd(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 1), (8, 0, 0), (11, None, None), (None, 1, 1), (999, 1, 0)], "doc_id long, quality int, toxic int")
    forest = fit_quality(odd, labels, F.lit(True))
    scores = [r.score for r in score_quality(odd, forest, carry=["doc_id", "kept"]).collect()]
    assert len(scores) == 15 and all(0 <= s <= 1 for s in scores)
    assert score_quality(empty, fit_quality(empty, labels.limit(0), F.lit(True)), carry=["doc_id"]).count() == 0
    model = toxicity.fit_toxicity(odd, labels, F.lit(True))
    assert toxicity.score_toxicity(odd, model, carry=["doc_id"]).count() == 15
    assert toxicity.score_toxicity(empty, toxicity.fit_toxicity(empty, labels.limit(0), F.lit(True)), carry=["doc_id"]).count() == 0


def test_marginals_brute_force_and_spans():
    rng = np.random.default_rng(4)
    trans, sizes = rng.normal(size=(2, 2)), [1, 4, 2, 5]
    e = rng.normal(size=sum(sizes))
    start = np.cumsum([0, *sizes[:-1]])
    got = 1 / (1 + np.exp(-toxicity.marginals(e, start, trans)[0]))
    for a, n in zip(start, sizes):
        total, on = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e[a + i] for i in range(n) if tags[i]) + sum(trans[tags[i], tags[i + 1]] for i in range(n - 1)))
            total += w
            on += w * np.array(tags)
        assert got[a:a + n] == pytest.approx(on / total)
    assert toxicity.toxic_spans("é badé bad ok", np.array([0, 0.9, 0.8, 0.1]), 0.5) == [{"start": 2, "end": 10}]


# 5 Host rules

def test_host_rules_strict_domain(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    soft = clean + "$" * 60
    rows = [(f"bad{i}", soft, "bad") for i in range(60)] + [("clean", clean, "bad")] + [(f"g{i}", clean, "good") for i in range(99)] + [("soft", soft, "good")]
    got = {r.doc_id: r for r in host_rules(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()}
    assert not got["bad3"].kept and got["clean"].kept and got["soft"].kept and got["g1"].kept
    assert got["bad3"].domain_rate > 0.5 > got["soft"].domain_rate


def test_host_rules_fitted_verdicts(spark):
    # Failures are far from half of any domain, yet domain "bad" is clearly above the others.
    clean = " ".join(f"word{i}" for i in range(80))
    mild, gross = clean + "$" * 60, clean + "$" * 200
    rows = [(f"{s}{k}{i}", text, s) for s, n in (("bad", 40), ("good", 2), ("fine", 2)) for k, text, m in (("clean", clean, 200), ("mild", mild, n), ("gross", gross, 2)) for i in range(m)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert kept == {d for d, _, s in rows if "gross" not in d and not (s == "bad" and "mild" in d)}


def test_host_rules_equal_and_planted_domains(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    mild = clean + "$" * 60
    equal = [(f"{s}{i}", mild if i < 5 else clean, s) for s in "abcdef" for i in range(40)]
    schema = "doc_id string, text string, source string"
    assert host_rules(spark.createDataFrame(equal, schema)).where("not kept").count() == 0
    bad = [(f"z{i}", mild if i < 12 else clean, "z") for i in range(40)]
    gone = host_rules(spark.createDataFrame(equal + bad, schema)).where("not kept").collect()
    assert {r.doc_id for r in gone} == {f"z{i}" for i in range(12)}


@pytest.mark.parametrize("folder", [SF01, "/root/testdata/sf0.1"])
def test_host_verdicts_reject_rows(spark, folder):
    out = host_rules(spark.read.parquet(f"{folder}/documents.parquet"), carry=["doc_id"])
    by_host = out.where("not kept and not base_failed and not gross_failed")
    assert by_host.count() > 0 and by_host.where("not soft_failed").count() == 0


def test_host_rules_odd(odd, empty):
    got = host_rules(odd)
    assert got.count() == 15 and "rate" in got.columns and got.where("kept is null").count() == 0
    assert got.where("doc_id = 8").first().n_repeat_words == 400
    assert host_rules(empty).count() == 0


# 6 HyperMinHash

def test_estimate_follows_jaccard():
    rng, odd_numbers = np.random.default_rng(1), multipliers(255)
    for share in (0.3, 0.6, 0.8, 0.95):
        pool = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        n = int(1000 * 2 * share / (1 + share))
        a, b = pool[:1000], np.concatenate([pool[:n], pool[1000:2000 - n]])
        got = estimate(registers(a, odd_numbers)[None, :], registers(b, odd_numbers)[None, :], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - n / (len(a) + len(b) - n)) < 0.12
    assert 0 < collision_rate(np.array([1.0, 500.0]), np.array([1.0, 500.0])).max() < 0.001


def brute_components(docs, size, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return sorted([(i, len(sets[i]), find(i), find(i) == i) for i in sets], key=str)


@pytest.mark.parametrize("cell", [512, 3])
def test_near_duplicates_brute_force(spark, cell):
    rng = random.Random(6)
    docs = list(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id limit 60").fetchall())
    base = [f"b{i}" for i in range(90)]
    for i in range(70):  # a group whose members are partly linked and mostly just under the threshold
        docs.append((1000 + i, " ".join(w if rng.random() > 0.07 else f"x{rng.randint(0, 99)}" for w in base)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = rows_of(near_duplicates(df, shingle=2, cell=cell), "doc_id", "n_shingles", "component_id", "kept")
    assert got == brute_components(docs, 2, 80)


def test_remainder_grows_with_its_rows():
    """Near copies just under the threshold: no pair is linked, and nothing leaves the cell;
    linked ones leave a tree."""
    rng = np.random.default_rng(3)
    base = np.arange(1000)

    def cells(n, changed):
        sets = []
        for i in range(n):
            s = base.copy()
            s[rng.choice(1000, changed, replace=False)] = 10_000 + 1000 * i + np.arange(changed)
            sets.append(np.sort(s))
        rows = [(0, i, i, 0, 0, probe, sets[i]) for probe in (False, True) for i in range(n)]
        return pd.DataFrame(rows, columns=["key", "id", "comp", "mi", "pi", "probe", "shingles"])

    for n in (100, 200):
        assert cell_links(cells(n, 130), 80) == []
        links = cell_links(cells(n, 40), 80)
        assert len(links) == n - 1 and len({x for pair in links for x in pair}) == n


def test_recall_at_the_threshold(spark):
    """Documents whose id is divisible by 100, against all rows, by brute force."""
    docs = [r for r in duckdb.sql("select doc_id, text from '/root/testdata/sf0.1/documents.parquet'").fetchall()]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), shingle=2).collect()}
    sets = {d: {tuple(w[i:i + 2]) for i in range(max(len(w) - 1, min(len(w), 1)))} for d, t in docs for w in [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER_AZ))]}
    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    found = total = 0
    for d in (d for d in sets if d % 100 == 0):
        shared = collections.Counter(o for x in sets[d] for o in holders[x])
        for o, both in shared.items():
            if o != d and 100 * both >= 80 * (len(sets[d]) + len(sets[o]) - both):
                total += 1
                found += got[d] == got[o]
    assert total > 20 and found == total


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.component for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_near_duplicates_odd(odd, empty):
    got = near_duplicates(odd).collect()
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert len(got) == 15 and by[(6, 116)].component_id == 5 and by[(7, 117)].component_id == 5
    assert by[(0, 0)].kept and by[(1, 0)].kept and by[(None, 116)].component_id is None and by[(None, 116)].kept
    assert near_duplicates(empty).count() == 0


# 7 Sharding

def brute_capacity(sizes, shards):
    for cap in itertools.count(max(max(sizes), -(-sum(sizes) // shards))):
        used, filled = 1, 0
        for s in sizes:
            used, filled = (used, filled + s) if filled + s <= cap else (used + 1, s)
        if used <= shards:
            return cap
    return None


@pytest.mark.parametrize("limit", [50_000, 1_500])
def test_minimax_cuts_brute_force(spark, limit):
    rng = random.Random(limit)
    for sizes in ([rng.randint(1, 50) for _ in range(400)], [1] * 5 + [900] + [3] * 200):
        ends = np.cumsum(sizes)
        df = spark.createDataFrame([(int(x),) for x in ends], "end long")
        cap, cuts = minimax_cuts(df, int(ends[-1]), 16, limit)
        assert cap == brute_capacity(sizes, 16)
        assert cuts == sorted(cuts) and set(cuts) <= {0, *ends.tolist()} and cuts[-1] == ends[-1]
        assert max(np.diff([0, *cuts])) <= cap
    assert cut_bounds(ends, ends, 16, int(ends[-1]))[0][-1] == ends[-1]


def test_shards_are_atomic_and_gapless(spark, odd, empty):
    got = queries.QUERIES["op7_minimax_sharding"](spark, SF).toPandas()
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").df().merge(got, on="doc_id")
    assert (docs.groupby("text").shard.nunique() == 1).all()
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    size = docs.text.map(lambda t: len(t.encode()) + 1)
    assert (size == docs["size"]).all()
    assert shard_documents(odd).count() == 15 and shard_documents(empty).count() == 0
    null = shard_documents(odd).where("doc_id = 0").first()
    assert (null["size"], null["text_crc32"]) == (1, 0)


# 8 Winnowing

def test_fingerprints_guarantee():
    rng = np.random.default_rng(8)
    grams = rng.integers(0, 40, 500).astype(np.uint64)
    at = set(fingerprints(grams, 6).tolist())
    for i in range(len(grams) - 5):
        assert at & {j for j in range(i, i + 6) if grams[j] == grams[i:i + 6].min()}


def test_decontaminate_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "dd"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([0, 1, 2, 9, 10, 11, 14, 25, 25])] + [(None, "dd dd dd dd"), (4, None), (77, items_text := "a b c dd a a b c dd b c")]
    docs = [(i, ". ".join(rng.choice(vocabulary + ["z", "y", "X1"]) for _ in range(rng.randint(0, 60)))) for i in range(40)] + [(99, "Z-" + items_text.upper() + "!"), (98, None)]

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    want = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, x in items:
            x = words(x)
            n = min(10, len(x))
            grams = {tuple(x[j:j + n]) for j in range(len(x) - n + 1)} if n else set()
            for j in range(len(w) - n + 1):
                if n and tuple(w[j:j + n]) in grams:
                    hit |= set(range(j, j + n))
                    found.add("null" if item is None else str(item))
        want.append((i, len(w), len(hit), sorted(found), bool(hit)))
    got = decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == sorted(want, key=str)


def test_decontaminate_odd(spark, odd, empty):
    items = spark.createDataFrame([(1, "two words"), (2, None)], "item_id long, text string")
    assert [r.doc_id for r in decontaminate(odd, items).where("contaminated").collect()] == [4]
    assert decontaminate(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate(empty, items).count() == 0


# 9 Mixing

def test_mixing_meets_targets(spark, odd, empty):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    small = docs.withColumn("source", F.when(F.col("doc_id") < 3, "a").when(F.col("doc_id") < 500, "b").when(F.col("doc_id") < 990, "c"))
    for df in (docs, small):
        documents, pieces = mix_sources(df, carry=["doc_id", "source"], block=500)
        got = words_taken(documents, pieces).toPandas()
        assert (got.taken <= 3 * got["size"]).all()
        by = got.groupby("source", dropna=False).agg({"target": "first", "taken": "sum", "size": "sum", "source_size": "first"})
        assert (by["size"] == by.source_size).all() and (abs(by.taken - by.target) <= 0.5 + 1e-6).all()
        assert abs(by.target.sum() - by["size"].sum()) < 1e-6
        shards = pieces.groupBy("shard").agg(F.sum("n_words").alias("n")).toPandas()
        assert len(shards) == 8 and shards.n.max() < 2 * shards.n.min() + 1000
    again = words_taken(*mix_sources(small, carry=["doc_id", "source"], block=500)).toPandas()
    assert again.sort_values("doc_id").taken.tolist() == got.sort_values("doc_id").taken.tolist()
    # Source "a" is tiny and heavy: it stops at three times its size.
    a = got[got.source == "a"]
    assert a.taken.sum() == 3 * a["size"].sum()
    assert words_taken(*mix_sources(odd, carry=["doc_id"])).count() == 15
    assert words_taken(*mix_sources(empty, carry=["doc_id"])).count() == 0
    whole = copies(*mix_sources(odd, carry=["doc_id", "text"]), ["doc_id", "text"]).toPandas()
    assert whole.text.map(lambda t: len(t.encode().split())).sum() == words_taken(*mix_sources(odd, carry=["doc_id"])).agg(F.sum("taken")).first()[0]


def test_mixing_deals_shards(spark):
    docs = spark.createDataFrame([(i, "\n".join(f"{i}.{k}" for k in range(i % 40 * 40)), f"s{i % 3}") for i in range(150)], "doc_id long, text string, source string")
    documents, pieces = mix_sources(docs, carry=["doc_id", "text"], block=500)
    taken = words_taken(documents, pieces).drop("text").toPandas()
    assert (taken.shard_words.map(lambda x: sum(w.words for w in x)) == taken.taken).all()
    assert {w.shard for x in taken.shard_words for w in x} == set(range(8))
    rows = copies(documents, pieces, ["doc_id", "text", "shard", "order_key"]).collect()
    assert [(r.shard, r.order_key) for r in rows] == sorted((r.shard, r.order_key) for r in rows)
    words = {(r.doc_id, w.shard): w.words for r in taken.itertuples() for w in r.shard_words}
    got = {}
    for r in rows:
        got[r.doc_id, r.shard] = got.get((r.doc_id, r.shard), 0) + len(r.text.split())
        first, n = int(r.text.split()[0].split(".")[1]), len(r.text.split())
        assert r.text == "\n".join(f"{r.doc_id}.{k}" for k in range(first, first + n))
    assert got == words
    assert "shard_words" in queries.QUERIES["op9_source_mixing"](spark, SF).columns


# 10 Chat

def test_chat_round_trip(spark):
    texts = ["", None, "\\", "\\s<s>", "</s>[INST] ok [/INST]", "[\\INST]\\\\[INST]", "<<s>s>\n</</s>", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r.t == r.u for r in df.select("t", unescaped(escaped(F.col("t"))).alias("u")).collect())
    rows = [(c, t, r, texts[(c + t) % 8]) for c in range(9) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", None][c % 3:6 - c % 2])]
    rows += [(None, None, "assistant", "x"), (5, 1, "assistant", "again"), (5, 1, "assistant", "again"), (50, 0, "user", "no reply"), (51, 0, "]</s>[INST]", "role")]
    examples = expand_targets(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in read_back(examples).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted([(t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [(t.role, t.text) for t in got[c].turns] == [t[2:] for t in turns]
        assert got[c].loss_text == "".join(t[3] for t in turns if t[2] == "assistant")
    for r in examples.collect():
        assert (r.target is None) == (r.loss_end == 0) and r.formatted.endswith("</s>")
    assert read_back(expand_targets(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# Pipeline

def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        stage(spark, docs, SF01).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.toPandas()
        if i < 4:
            assert list(after.columns) == list(before.columns)
            assert set(after.doc_id) <= set(before.doc_id)
        if name == "near_dedup":
            want = {r[0] for r in brute_components(list(before[["doc_id", "text"]].itertuples(index=False, name=None)), 5, 80) if r[3]}
            assert set(after.doc_id) == want
        if name == "decontamination":
            hit = duckdb.connect()
            hit.register("documents", before)
            hit.execute(f"create view benchmark as select * from '{SF01}/benchmark.parquet'")
            bad = hit.execute(f"select doc_id from ({queries.ORACLES['op8_winnowing']}) where contaminated").fetchall()
            assert set(before.doc_id) - set(after.doc_id) == {x[0] for x in bad}
    assert len(after) == len(before) and sorted(after.doc_id) == sorted(before.doc_id)
    assert os.path.isdir(SF01)


def test_pipeline_near_dedup_repeated_ids(spark):
    def text(k):
        return " ".join(f"{k}{i}" for i in range(60))

    rows = [(1, text("a"), "s"), (2, text("a"), "s"), (2, text("b"), "s"), (3, text("c"), "s"), (3, text("c"), "s"), (None, text("d"), "s"), (None, text("d") + " more", "s"), (None, text("e"), "s"),
            (4, text("f"), "s"), (4, text("g"), "s"), (5, text("g"), "t"), (None, text("a"), "s"), (6, "", "s"), (6, "", "s"), (None, None, "s")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SF).collect()
    kept = [(r.doc_id, (r.text or "")[:1]) for r in got]
    want = [(1, "a"), (2, "b"), (3, "c"), (None, "d"), (None, "e"), (4, "f"), (4, "g"), (6, ""), (6, ""), (None, "")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_pipeline_odd(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() >= 1
