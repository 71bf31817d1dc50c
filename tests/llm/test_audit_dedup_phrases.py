"""Filter audit, exact stream dedup and phrase collocations: brute force and odd inputs."""
import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from riskgrid.llm import collocations as C
from riskgrid.llm import exact_dedup as X
from riskgrid.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n long, kept boolean, mask int, digest string, total long, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def odd_rows():
    rng = random.Random(5)
    long = " ".join(rng.choice(["Ab", "c", "dd#", "x"]) for _ in range(20_000))
    base = " ".join(f"w{i}" for i in range(70))
    texts = [None, "", " \t\n ", "one", base, base, base + "$", "A B C " * 30, long, "été Ab. cd, Ab cd\nAb\tcd", long]
    rows = [(i, t, (None, "en", "fr")[i % 3], (None, "", "s")[i % 3], 1, False, 2, "d", 3, "p") for i, t in enumerate(texts)]
    return [*rows, rows[4], (None, base, *rows[4][2:]), (None, "lone", *rows[4][2:]), (None, None, *rows[1][2:])]


def saved(spark, tmp_path, rows, files=1):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.parquet(path)
    return path


# 11 Filter audit

def brute_audit(docs, labels):
    first = {}
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = ({i for i, *said in labels if i is not None and said[k] == 1} for k in (0, 1))
    facts = []
    for doc_id, text, _, source, *_ in docs:
        t = text or ""
        w = WORD.findall(t)
        fails = {x for x, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search(r"[#$%&*|]", t)), doc_id is not None and first[t] < doc_id), strict=True) if bad}
        facts.append((source or "", fails, doc_id in good, doc_id in toxic))
    out, shapley = [], collections.Counter()
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                before = set(order[:step - 1])
                here = [f for f in own if x in f[1] and not f[1] & before]
                shapley[part, x] += len(here)
                out.append((part, "".join(order), step, sum(not f[1] & (before | {x}) for f in own), len(here), sum(x in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {x} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)))
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit_against_brute_force(spark):
    rows = odd_rows()
    labels = [(4, 1, 0), (5, 1, 1), (5, 0, 0), (7, None, 1), (None, 1, 1), (99, 1, 1), (3, 0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = A.audit(A.mask_cells(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(A.mask_cells(docs.limit(0), empty)).count() == 0
    assert A.mask_cells(docs, empty).agg({"n": "sum"}).first()[0] == len(rows)


def test_recursion_holds_only_masks(spark):
    cells = spark.createDataFrame([(str(p), m, 1, 0, 0) for p in range(5) for m in (0, 3)], "part string, mask int, n long, good long, toxic long")
    steps = spark.sql(A.STEPS, cells=cells)
    assert steps.count() == 2 * 325 and A.audit(cells).count() == 5 * 600


# 12 Exact dedup

def brute_dedup(rows):
    groups = collections.defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows), key=str), len(groups)


@pytest.mark.parametrize("digits, options", [(64, {}), (64, {"batch_files": 1}), (1, {"batch_files": 2})])
def test_exact_dedup(spark, tmp_path, digits, options):
    """One batch; a batch for each file; digests of four bits, which all collide."""
    rows = odd_rows()
    want, classes = brute_dedup(rows)
    got = X.exact_duplicates(spark, saved(spark, tmp_path, rows, 4), digits=digits, **options).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == classes and all(r.doc_id == r.keep_id for r in kept)


def test_dedup_goes_on_from_its_state(spark, tmp_path):
    rows, state = odd_rows(), str(tmp_path / "state")
    path = saved(spark, tmp_path, rows[:6])
    assert X.exact_duplicates(spark, path, state=state).count() == 6
    spark.createDataFrame(rows[6:], SCHEMA).write.mode("append").parquet(path)
    got = X.exact_duplicates(spark, path, state=state).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_dedup(rows)[0]


def test_dedup_of_nothing_and_many_groups(spark, tmp_path, monkeypatch):
    assert X.exact_duplicates(spark, saved(spark, tmp_path, [])).count() == 0
    rows = [(i, f"t{i % 7 if i < 60 else i}", None, None, 0, True, 0, "", 0, "") for i in range(100)]
    path = str(tmp_path / "more")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(X, "HOT_SHARE", 0.08)
    got = X.exact_duplicates(spark, path).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_dedup(rows)[0]


# 13 Collocations

def brute_phrases(rows, threshold, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = {p: c for p, c in f.items() if c >= threshold}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if len(w) > 1 and not any(x == lang and len(v) > len(w) and c >= a and any(v[i:i + len(w)] == w for i in range(len(v))) for (x, v), c in found.items()):
            score, k = min((1000 * a * n[lang] // (found[lang, w[:j]] * found[lang, w[j:]]), j) for j in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), found[lang, w[:k]], found[lang, w[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for r, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize("full", [False, True])
def test_collocations_against_brute_force(spark, monkeypatch, full):
    """With a few cells all sketches are full and everything is decided by the tables."""
    if full:
        monkeypatch.setattr(C, "PAIR_BITS", (6, 6))
        monkeypatch.setattr(C, "LEAST_BITS", 4)
        monkeypatch.setattr(C, "MOST_BITS", 4)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(12)] + ["Ab", "ab", "x\x1cy", "été"]

    def text():
        return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ", "]) for _ in range(rng.randint(0, 60)))
    rows = [(i, rng.choice([None, "", text(), text(), text()]), rng.choice(["en", "fr", None]), None, 0, True, 0, "", 0, "") for i in range(300)] + odd_rows()
    got = C.collocations(spark.createDataFrame(rows, SCHEMA).repartition(5), threshold=8, top=60, shards=2 if full else 4)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 8, 60)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.collocations(empty).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None, *odd_rows()[0][3:])], SCHEMA)).count() == 0


def test_products_pass_64_bits(spark):
    big = 3_000_000_000_000
    a, b = bytes(range(8)), bytes(range(8, 16))
    counts = spark.createDataFrame([("en", a, 1, big), ("en", b, 1, big - 1), ("en", a + b, 2, big - 7)], "lang string, phrase binary, k int, n long")
    r = C.scored_candidates(counts, spark.createDataFrame([("en", 9 * big)], "lang string, total long")).first()
    assert r.score == 1000 * (big - 7) * 9 * big // (big * (big - 1))


def test_codes_that_collide_are_replaced(spark, monkeypatch):
    """With the first salt all words of a length share a code."""
    strong = C.word_codes
    texts = ["ab cd " * 9, "cd ef " * 9, "ef ab " * 9]

    def weak(words, salt):
        return strong(words, salt) if salt else (100 + words.ends - words.starts).astype("uint64")
    monkeypatch.setattr(C, "word_codes", weak)
    rows = [(i, t, "en", None, 0, True, 0, "", 0, "") for i, t in enumerate(texts)]
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), threshold=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows, 5, 2000)


def test_words_of_any_length_and_their_codes():
    rng = random.Random(3)
    texts = ["", " ", "a", "é b.c", ".", "x" * 200, "x" * 199 + "y z", "abcdefgh abcdefghi ABCDEFGH", "a\x00 a \x00", "long " * 3, *("".join(rng.choice("ab é.\t") for _ in range(rng.randint(0, 300))) for _ in range(50))]
    column = pa.array(["skipped", *texts]).slice(1)
    words = C.Words(column)
    codes = C.word_codes(words, 7)
    spelled = [words.spelled(i) for i in range(len(codes))]
    assert len(set(zip(spelled, codes.tolist()))) == len(set(spelled)) == len(set(codes.tolist()))
    expected, ends = [], []
    for row, text in enumerate(texts):
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text.translate(LOWER)):
            found = re.findall(r"[^\x20\x09]+", piece)
            expected += [(row, w.encode()) for w in found]
            ends += [i == len(found) - 1 for i in range(len(found))]
    assert list(zip(words.row.tolist(), spelled)) == expected
    assert words.ends_piece().tolist() == ends
    # All words under one code: each that differs from the first is found.
    one = words.different(np.full(len(codes), 5, np.uint64), np.arange(len(codes)))
    assert {spelled[i] for i in one} == set(spelled)
    few = words.different(codes, np.arange(len(codes)))
    assert sorted(spelled[i] for i in few) == sorted(set(spelled))
