"""Quality rules with host-level verdicts, in DataFrame functions only.

Every document gets its rule statistics. Failures are counted by domain; a beta
prior fitted to the domains' failure rates (method of moments) shrinks each
domain's rate, so a domain of three documents isn't judged on three documents.
A domain is strict if its shrunk rate lies ``SURE`` of its posterior standard
deviations above the corpus mean, or reaches ``strict_rate``: its rate is above the
mean with a posterior probability of 0.8. A domain whose true rate is the mean is
strict with a probability of at most 0.2; domains of equal failure rates never are.
Documents that fail a hard rule go everywhere, as do soft failures over ``GROSS``
times a limit (symbols, repeated lines; word lengths are never gross, as scripts
without spaces have long words). Documents that fail a soft rule by less go where
the domain is strict. A document that fails no rule is always kept.

The statistics of one document are computed inside its row, so text is never
shuffled and a domain of any size is only ever partially aggregated.

Defined results: a null or empty text has no words and fails the hard rule on
length; documents without domain form one domain of their own; repeated rows
count and are judged one by one; an empty table gives an empty table. Columns
of the input that are named like a result are replaced by the result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, attach, materialise

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "soft_failed", "gross_failed"]

#: Symbols or repeated lines over so many times the soft limit go in every domain.
GROSS = 2
#: Posterior standard deviations above the corpus mean from which a domain is strict
#: (the 80 % point of the normal distribution).
SURE = 0.8416

#: Words in 3-word windows found twice or more: hash the windows, sort the hashes
#: with their positions, keep positions whose neighbour has the same hash, and add
#: up what each kept window covers beyond the one before.
_TRIGRAMS = "transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2]))"
_SORTED = "sort_array(transform(_tri, (h, i) -> struct(h, i)))"
_AGAIN = """sort_array(transform(filter(sequence(0, size(_sorted) - 1), k ->
    (k > 0 and _sorted[k].h = _sorted[greatest(k - 1, 0)].h) or (k < size(_sorted) - 1 and _sorted[k].h = _sorted[least(k + 1, size(_sorted) - 1)].h)),
    k -> _sorted[k].i))"""
_COVERED = "aggregate(zip_with(slice(_again, 2, size(_again)), slice(_again, 1, size(_again) - 1), (b, a) -> least(b - a, 3)), 3, (s, x) -> s + x)"


def with_statistics(docs: DataFrame, text: Column, carry: list[str]) -> DataFrame:
    """``carry`` columns plus STATS for each row. Hard rules: under 50 words, or over
    half the words in repeated windows. Soft rules: over 10 % symbols, over 30 % of
    lines repeated, or a mean word length outside 2 to 20 characters."""
    out = docs.select(*carry, F.coalesce(text, F.lit("")).alias("_text"))
    out = out.select("*", F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)).alias("_words"),
                     F.filter(F.split("_text", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"))
    out = out.select("*", F.expr(f"case when size(_words) >= 3 then {_TRIGRAMS} else cast(array() as array<bigint>) end").alias("_tri"))
    # A text without repeated window, the common case, stops here with an empty array.
    out = out.select("*", F.expr(f"case when size(array_distinct(_tri)) < size(_tri) then {_SORTED} end").alias("_sorted"))
    out = out.select("*", F.expr(f"case when _sorted is not null then {_AGAIN} end").alias("_again"))
    out = out.select(*carry, F.size("_lines").alias("_n_lines"),
                     F.size("_words").cast("long").alias("n_words"),
                     F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
                     F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                     (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                     F.expr(f"cast(case when _again is null then 0 else {_COVERED} end as bigint)").alias("n_repeat_words"))
    hard = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    soft = F.expr("10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * _n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words")
    gross = F.expr(f"10 * n_symbols > {GROSS} * word_chars or 10 * n_dup_lines > {GROSS} * 3 * _n_lines")
    return out.select(*carry, *STATS[:5], hard.alias("base_failed"), soft.alias("soft_failed"), gross.alias("gross_failed"))


def domain_verdicts(stats: DataFrame, strict_rate: float) -> DataFrame:
    """_domain, n_docs, n_failed, rate (shrunk), strict. One row of moments reaches the driver."""
    failed = F.col("base_failed") | F.col("soft_failed")
    domains = materialise(stats.groupBy("_domain").agg(F.count("*").alias("n_docs"), F.sum(failed.cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    mean, var = domains.agg(F.sum("n_failed") / F.sum("n_docs"), F.coalesce(F.var_samp(rate), F.lit(0.0))).first()
    mean, var = min(max(mean or 0.0, 1e-6), 1 - 1e-6), max(var or 0.0, 1e-9)
    strength = min(max(mean * (1 - mean) / var - 1, 2.0), 1e6)
    shrunk = (F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)
    deviation = F.sqrt(shrunk * (1 - shrunk) / (F.col("n_docs") + strength + 1))
    strict = (shrunk >= strict_rate) | (shrunk - mean >= SURE * deviation)
    return domains.select("*", shrunk.alias("rate"), strict.alias("strict"))


def host_rules(docs: DataFrame, *, domain: str = "source", text_col: str = "text", carry: list[str] | None = None, strict_rate: float = 0.5) -> DataFrame:
    """``carry`` columns (default: all), STATS, domain_rate and kept for every row."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in {*STATS, "kept", "domain_rate"}]
    named = docs.select("*", F.col(domain).alias("_domain"))
    stats = materialise(with_statistics(named, F.col(text_col), [*carry, "_domain"]))
    verdicts = domain_verdicts(stats, strict_rate).select("_domain", F.col("rate").alias("_rate"), F.col("strict").alias("_strict"))
    joined = attach(stats, verdicts, "_domain")
    rejected = F.col("base_failed") | F.col("gross_failed") | (F.col("soft_failed") & F.col("_strict"))
    kept = ~F.coalesce(rejected, F.lit(False))
    return joined.select(*carry, *STATS, F.col("_rate").alias("domain_rate"), kept.alias("kept"))
