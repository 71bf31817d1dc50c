"""The registered queries of the training-data operators, and their DuckDB SQL.

Each query applies one operator, with production parameters, to its whole table
and derives the digest columns from the operator's output."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import expand_targets, read_back
from .collocations import collocations
from .common import read
from .exact_dedup import exact_duplicates
from .filter_audit import audit, mask_cells
from .host_rules import host_rules
from .hyperminhash import near_duplicates
from .mixing import mix_sources, words_taken
from .pii import KINDS, find_pii, fit_pii
from .quality import fit_quality, score_quality
from .sharding import shard_documents
from .substrings import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .winnowing import decontaminate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op5_host_rules"] = r"""
with d as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as k from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) as i from d)),
again as (select doc_id, i from tri qualify count(*) over (partition by doc_id, k) > 1),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
s as (select d.doc_id, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words
    from d left join rep using (doc_id)),
r as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from s),
f as (select *, 10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * len(lines) or word_chars < 2 * n_words or word_chars > 20 * n_words as soft_failed, 10 * n_symbols > 2 * word_chars or 10 * n_dup_lines > 6 * len(lines) as gross_failed from r),
h as (select source, count(*) as n, sum((base_failed or soft_failed)::int) as bad from f group by source),
m as (select least(greatest(sum(bad) / sum(n), 1e-6), 1 - 1e-6) as mean, greatest(coalesce(var_samp(bad / n), 0), 1e-9) as var from h),
b as (select mean, least(greatest(mean * (1 - mean) / var - 1, 2.0), 1e6) as k from m),
q as (select source, mean, (bad + mean * k) / (n + k) as rate, n + k + 1 as weight from h, b),
v as (select source, rate >= 0.5 or rate - mean >= 0.8416 * sqrt(rate * (1 - rate) / weight) as strict from q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not gross_failed and not (soft_failed and strict) as kept
from f join v on f.source is not distinct from v.source
"""


@query
def op6_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


@query
def op7_minimax_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(read(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, pieces = mix_sources(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return words_taken(documents, pieces).select("doc_id", "size", "source_size", "target", "taken", F.concat_ws(",", F.transform("shard_words", lambda w: F.concat_ws(":", w.shard, w.words))).alias("shard_words"))


@query
def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op8_winnowing"] = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select item_id, least(len(w), 10) as n, unnest(list_transform(generate_series(1, len(w) - least(len(w), 10) + 1), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) as k from b where len(w) > 0),
lens as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as k from (select doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) as i from d, lens where len(w) >= n)),
hit as (select doc_id, i, bw.n, item_id from dw join bw on dw.k = bw.k and dw.n = bw.n),
pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hit) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hit) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join pos using (doc_id) left join it using (doc_id)
"""

#: Texts that hold every control string of the chat template's family.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op10_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string")
    out = read_back(expand_targets(turns.unionByName(more)))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


ORACLES["op10_prefix_targets"] = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, row_number() over (partition by conv_id order by turn, role, text) as i, count(*) over (partition by conv_id) as n,
    22 + length(role) + length(text) + length(role || text) - length(replace(role || text, '\', ''))
    + (length(role) - length(replace(role, '<s>', ''))) // 3 + (length(role) - length(replace(role, '</s>', ''))) // 4 + (length(role) - length(replace(role, '[INST]', ''))) // 6 + (length(role) - length(replace(role, '[/INST]', ''))) // 7
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4 + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 as chars from t),
c as (select *, sum(chars) over (partition by conv_id order by i) as upto from e)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
    length(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), ''))::bigint as loss_chars,
    sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
    sum(case when role = 'assistant' or i = n then upto else 0 end)::bigint as formatted_chars
from c group by conv_id
"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op2_substring_dedup"] = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as k from (select doc_id, w, unnest(generate_series(1, len(w) - 49)) as i from d where len(w) >= 50)),
rep as (select doc_id, i from win qualify min(doc_id) over (partition by k) < doc_id),
gone as (select doc_id, list(distinct p) as ps from (select doc_id, unnest(generate_series(i, i + 49)) as p from rep) group by doc_id),
words as (select doc_id, unnest(w) as word, unnest(generate_series(1, len(w))) as p from d),
left_over as (select words.doc_id, string_agg(word, ' ' order by words.p) as kept, count(*) as n from words left join (select doc_id, unnest(ps) as p from gone) g on words.doc_id = g.doc_id and words.p = g.p where g.p is null group by words.doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join left_over using (doc_id)
"""


def held_out(modulus: int, fold: int) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == fold


@query
def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), held_out(5, 0)
    forest = fit_quality(docs, read(spark, sf_dir, "labels"), ~out)
    return score_quality(docs, forest, carry=["doc_id"]).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), held_out(4, 2)
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), ~out)
    return score_toxicity(docs, model, carry=["doc_id"]).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op1_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = find_pii(docs, fit_pii(docs), carry=["doc_id"])

    def text(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))

    base = F.filter("spans", lambda s: s.base)

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *map(count, KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(mask_cells(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLES["op11_filter_audit"] = r"""
with recursive d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
f as (select doc_id, part, len(w) < 50 as a, 100 * len(list_distinct(w)) < 65 * len(w) as b, 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) as c,
    regexp_matches(t, '[#$%&*|]') as d, min(doc_id) over (partition by t) < doc_id as e from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * coalesce(e, false)::int as mask, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from f left join l using (doc_id)),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
letters(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, bits) as (select letter, [bit] from letters union all select filter_order || letter, list_append(bits, bit) from orders, letters where not list_contains(bits, bit)),
steps as (select filter_order, s as step, substr(filter_order, s, 1) as letter, bits[s] as bit, coalesce(list_sum(bits[1:s - 1]), 0)::int as before
    from (select filter_order, bits, unnest([1, 2, 3, 4, 5]) as s from orders where len(bits) = 5)),
r as (select part, filter_order, step, letter,
    sum(case when mask & (bit | before) = 0 then n else 0 end)::bigint as kept,
    sum(case when mask & bit <> 0 and mask & before = 0 then n else 0 end)::bigint as removed,
    sum(case when mask & bit <> 0 and mask & before <> 0 then n else 0 end)::bigint as redundant,
    sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
    sum(case when mask & bit <> 0 and mask & before = 0 then good else 0 end)::bigint as good_lost,
    sum(case when mask & bit <> 0 and mask & before = 0 then toxic else 0 end)::bigint as toxic_lost
    from cells, steps group by part, filter_order, step, letter)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r
"""


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, f"{sf_dir}/documents.parquet")


ORACLES["op12_exact_dedup"] = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLES["op13_collocations"] = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase from (select lang, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(w) >= k)),
f as (select lang, k, phrase, count(*) as a, string_split(phrase, ' ') as ws from g group by lang, k, phrase having count(*) >= 100),
t as (select lang, sum(len(w))::hugeint as n from w group by lang),
c as (select f.lang, f.phrase, f.k, f.a, l.a as l, r.a as r, t.n, x.j, (1000::hugeint * f.a * t.n) // (l.a::hugeint * r.a) as score
    from f join (select unnest([1, 2, 3, 4]) as j) x on x.j < f.k
    join f l on l.lang = f.lang and l.phrase = array_to_string(f.ws[1:x.j], ' ') join f r on r.lang = f.lang and r.phrase = array_to_string(f.ws[x.j + 1:f.k], ' ') join t on t.lang = f.lang),
b as (select * from c qualify row_number() over (partition by lang, phrase order by score, j) = 1),
s as (select * from b where not exists (select 1 from f where f.lang = b.lang and f.k > b.k and f.a >= b.a and contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' '))),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score::bigint as score from s)
select * from o where rank <= 2000
"""
