"""The queries of this subpackage: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audit, bpe, hmm, mixture, negatives, phrases, quality, quotes, sampling, simhash, templates, toxicity, warc
from .common import materialize, table
from .oracle import ORACLE as OTHER_SQL


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op2_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrases.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = templates.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed")


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations hold no quotes, so each message is first written as a reply that quotes earlier ones; linking takes that apart again."""
    out = quotes.linked(materialize(quotes.with_quotes(table(spark, sf_dir, "conversations")), "replies"))
    return out.select("conv_id", "turn", "role", "n_quotes", "max_level", "reply_to", "root", "depth", F.to_json("quote_links").alias("quote_links"), "position", F.sha2("body", 256).alias("body_sha256"))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixture.mixed(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op9_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sampling.edited_neighbours(table(spark, sf_dir, "documents"))
    mine = F.col("signature")
    return out.select("doc_id", "n_chars", "edited_sha256", sampling.as_string(mine).alias("fingerprint"), sampling.as_string(F.col("edited")).alias("edited_fingerprint"), sampling.likeness(mine, F.col("edited")).alias("near_edited"), sampling.likeness(mine, F.col("following")).alias("near_next"))


def op10_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    out = bpe.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or tokenizer_path())
    return digests(out)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digests(out: DataFrame) -> DataFrame:
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_repeated_phrases, op3_line_templates, op4_simhash, op5_quality, op6_quotes, op7_mixture, op8_hmm, op9_weighted_sampling, op10_bpe, op11_toxicity, op12_filter_audit, op13_hard_negatives)}

ORACLE: dict[str, str] = dict(OTHER_SQL)

ORACLE["op1_warc"] = """
with p as (select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages),
g as (select h, max(page_id) m from p group by h)
select p.page_id, cast(strlen(p.html) as bigint) payload_bytes,
  array_to_string(list_transform(range(8), lambda k: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x' || substr(p.h, cast(k * 5 + 1 as bigint), 5))::bigint >> s) & 31) + 1 as bigint), 1)), '')), '') payload_digest,
  case when p.page_id is distinct from g.m and g.m is not null then 'revisit' else 'response' end record_type,
  case when p.page_id is distinct from g.m then g.m end refers_to, cast(null as varchar) error
from p join g using (h)
"""

ORACLE["op12_filter_audit"] = r"""
with t as (select doc_id, coalesce(lang, '') part, coalesce(text, '') x, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
m as (select doc_id, part, len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b, 100 * (length(x) - length(regexp_replace(x, '[A-Z]', '', 'g'))) > 3 * length(x) c, regexp_matches(x, '[#$%&*|]') d,
  coalesce(min(doc_id) over (partition by x) < doc_id, false) e from t),
f as (select part, (a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int) mask, count(*) n, count(*) filter (quality = 1) good, count(*) filter (toxic = 1) toxic from m left join labels using (doc_id) group by all),
l as (select unnest([{'f': 'A', 'bit': 1}, {'f': 'B', 'bit': 2}, {'f': 'C', 'bit': 4}, {'f': 'D', 'bit': 8}, {'f': 'E', 'bit': 16}], recursive := true)),
o as (select p.f || q.f || r.f || s.f || t.f filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] bits from l p, l q, l r, l s, l t where p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k as (select filter_order, cast(step as int) step, bits[step] bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as int) before from o, range(1, 6) g(step))
select part, filter_order, step, substr(filter_order, step, 1) "filter",
  cast(coalesce(sum(n) filter (mask & (before | bit) = 0), 0) as bigint) kept, cast(coalesce(sum(n) filter (mask & bit <> 0 and mask & before = 0), 0) as bigint) removed,
  cast(coalesce(sum(n) filter (mask & bit <> 0 and mask & before <> 0), 0) as bigint) redundant, cast(coalesce(sum(n) filter (mask = bit), 0) as bigint) unique_fails,
  cast(coalesce(sum(good) filter (mask & bit <> 0 and mask & before = 0), 0) as bigint) good_lost, cast(coalesce(sum(toxic) filter (mask & bit <> 0 and mask & before = 0), 0) as bigint) toxic_lost,
  cast(coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (mask & bit <> 0), 0) as bigint) shapley
from f, k group by part, filter_order, step, bit
"""

ORACLE["op13_hard_negatives"] = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
  where vec_id is not null and label is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s as (select a.vec_id a, r.vec_id r, a.label = r.label same, cast(list_inner_product(a.q, r.q) as bigint) s from v a join v r on a.vec_id <> r.vec_id where a.vec_id % 100 = 0),
p as (select a, r, s from s where same qualify row_number() over (partition by a order by s desc, r) <= 5)
select p.a anchor_id, p.r positive_id, cast(row_number() over (partition by p.a, p.r order by n.s desc, n.r) as int) "rank", n.r negative_id, p.s positive_score, n.s negative_score
from p join s n on n.a = p.a and not n.same and 80 * p.s <= 100 * n.s and 100 * n.s <= 100 * p.s
qualify row_number() over (partition by p.a, p.r order by n.s desc, n.r) <= 5
"""
