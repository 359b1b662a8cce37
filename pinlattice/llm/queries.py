"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pinlattice.llm import bpe, decontaminate, filter_audit, fingerprints, jaccard, language, personal, phrases, ppm, quality, secrets, sharding, toxicity
from pinlattice.llm.registry import query, table
from pinlattice.llm.spans import count_of, joined, of_kinds


@query("op6_quality_rules")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    judged = quality.quality_rules(docs, table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


OP4_SQL = r"""
with dw as (
  select doc_id, text, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents
), iw as (
  select distinct item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark
), item_windows as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as win
  from iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as t(i) where len(w) > 0
), sizes as (select distinct n from item_windows),
numbered as (select row_number() over () as row_id, doc_id, w from dw),
doc_windows as (
  select row_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win
  from numbered, sizes, unnest(range(1, len(w) - n + 2)) as t(i) where len(w) >= n
), hits as (
  select d.row_id, d.i, d.n, b.item_id from doc_windows d join item_windows b on d.win = b.win and d.n = b.n
), words as (
  select row_id, count(distinct p) as n_hit from (select row_id, unnest(range(i, i + n)) as p from hits) group by row_id
), items as (
  select row_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids
  from hits group by row_id
)
select n.doc_id, cast(len(n.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
  cast(coalesce(i.n_items, 0) as bigint) as n_items, sha256(coalesce(i.ids, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from numbered n left join words h using (row_id) left join items i using (row_id)
"""


@query("op4_decontaminate", OP4_SQL)
def op4(spark, sf_dir):
    marked = decontaminate.mark_documents(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op3_sharding")
def op3(spark, sf_dir):
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.crc32(F.lit("").cast("binary"))).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    dealt = sharding.shard_rows(rows, 24, ["doc_id", "size", "text_crc32", "text_hash"])
    return dealt.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op1_secret_scan")
def op1(spark, sf_dir):
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    spans = F.col("secret_spans")
    return found.select(
        "doc_id",
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in secrets.KINDS],
        F.sha2(joined(of_kinds(spans, secrets.KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@query("op5_personal_data")
def op5(spark, sf_dir):
    found = personal.find_personal(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("personal_spans")
    return found.select(
        "doc_id",
        *[count_of(spans, kind).alias(f"n_{kind}") for kind in personal.KINDS],
        F.sha2(joined(of_kinds(spans, personal.KINDS)), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


@query("op10_bpe_encode_decode")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"), keep=["doc_id"])
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op9_ppm_scoring")
def op9(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folded = docs.withColumn("held_out", ppm.fold(F.col("doc_id"), 10) == 0)
    scored = ppm.score_texts(folded, ~F.col("held_out"), keep=["doc_id", "held_out"], across=True)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), shingle=3, numerator=9, denominator=10)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("set").alias("class_id"), "n_links")


@query("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    folded = docs.withColumn("held_out", ppm.fold(F.col("doc_id"), 4) == 2)
    judged = language.identify(folded, folded.filter(~F.col("held_out")), keep=["doc_id", "held_out"])
    return judged.select("doc_id", "held_out", "lang_pred", "score", "gap", "rejected")


@query("op8_toxicity")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folded = docs.withColumn("held_out", ppm.fold(F.col("doc_id"), 4) == 2)
    labels = table(spark, sf_dir, "labels").filter(ppm.fold(F.col("doc_id"), 4) != 2)
    scorer = toxicity.train(toxicity.labelled_sample(docs, labels, "doc_id", "text"))
    return toxicity.score_texts(folded, scorer, keep=["doc_id", "held_out"])


OP13_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as text, coalesce(lang, '') as part,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents
), least_ids as (select coalesce(text, '') as text, min(doc_id) as least from documents group by 1),
known as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
marked as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    case when len(w) < 200 then 1 else 0 end
    + case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end
    + case when 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 3 * length(t.text) then 4 else 0 end
    + case when regexp_matches(t.text, '[#$%&*|]') then 8 else 0 end
    + case when coalesce(t.doc_id > least, false) then 16 else 0 end as mask
  from t left join least_ids using (text) left join known using (doc_id)
), cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from marked group by 1, 2),
letters(f, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a join letters b on b.f <> a.f join letters c on c.f not in (a.f, b.f)
  join letters d on d.f not in (a.f, b.f, c.f) join letters e on e.f not in (a.f, b.f, c.f, d.f)
), steps as (
  select filter_order, cast(s as int) as step, bits[s] as bit, cast(list_sum(bits[1:s]) as int) - bits[s] as before
  from orders, unnest(range(1, 6)) as u(s)
), parts as (select distinct part from marked),
counted as (
  select p.part, filter_order, step, bit,
    cast(coalesce(sum(n) filter ((mask & (before | bit)) = 0), 0) as bigint) as kept,
    cast(coalesce(sum(n) filter ((mask & before) = 0 and (mask & bit) > 0), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter ((mask & before) > 0 and (mask & bit) > 0), 0) as bigint) as redundant,
    cast(coalesce(sum(n) filter (mask = bit), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter ((mask & before) = 0 and (mask & bit) > 0), 0) as bigint) as good_lost,
    cast(coalesce(sum(toxic) filter ((mask & before) = 0 and (mask & bit) > 0), 0) as bigint) as toxic_lost
  from steps, parts p join cells using (part) group by 1, 2, 3, 4
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  cast(sum(removed) over (partition by part, bit) as bigint) as shapley
from counted
"""


@query("op13_filter_interactions", OP13_SQL)
def op13(spark, sf_dir):
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


@query("op11_document_fingerprints")
def op11(spark, sf_dir):
    return fingerprints.compare_edited(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


OP12_SQL = r"""
with docs as (
  select row_number() over () as row_id, coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), pieces as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from docs),
totals as (select lang, cast(sum(len(w)) as bigint) as n from pieces group by 1),
grams as (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
  from pieces, unnest(range(1, 5)) as s(k), unnest(range(1, len(w) - k + 2)) as t(i) where len(w) >= k
), f as (select lang, k, phrase, count(*) as a from grams group by 1, 2, 3 having count(*) >= 30),
parts as (select *, string_split(phrase, ' ') as p from f),
cuts as (
  select c.lang, c.phrase, c.a, j, h.a as l, t.a as r, (2000000::hugeint * c.a) // (h.a + t.a) as score
  from (select *, unnest(range(1, k)) as j from parts where k > 1) c
  join f h on h.lang = c.lang and h.phrase = array_to_string(list_slice(c.p, 1, j), ' ')
  join f t on t.lang = c.lang and t.phrase = array_to_string(list_slice(c.p, j + 1, c.k), ' ')
), best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, j) = 1),
longer as (
  select lang, array_to_string(list_slice(p, i, i + m - 1), ' ') as phrase, max(a) as longer
  from (select *, unnest(range(2, k)) as m from parts where k > 2), unnest(range(1, k - m + 2)) as t(i) group by 1, 2
), kept as (
  select b.* from best b left join longer g using (lang, phrase) where g.longer is null or 100::hugeint * g.longer < 80::hugeint * b.a
)
select lang, cast(row_number() over (partition by lang order by score desc, a desc, phrase) as bigint) as rank,
  phrase, a, l, r, n, cast(score as bigint) as score
from kept join totals using (lang) qualify rank <= 2000
"""


@query("op12_collocations", OP12_SQL)
def op12(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))
