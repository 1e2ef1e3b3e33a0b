"""The operators as queries over the driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import decontaminate, exact_dedup, hard_negatives, lm_scoring, near_dedup, ngram_join, packing, secrets, sharding, suffix_dedup, toxicity, whitening, wrapper
from eventloom.llm.common import table
from eventloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: query(configure(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return query

    return add


@register(
    "op2_exact_dedup",
    """with d as (select doc_id, sha256(coalesce(text, '')) as h from documents)
       select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
         doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256 from d""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.group_exact(table(spark, sf_dir, "documents"))


SHARDS = 40


@register("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    shards = sharding.shuffle_shards(table(spark, sf_dir, "documents").withColumn("size", size), "doc_id", "size", SHARDS)
    return shards.select(
        "record.doc_id",
        "record.size",
        F.crc32(F.coalesce(F.col("record.text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


@register("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op3_minhash_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), k=2, threshold=80)


@register("op1_benchmark_decontamination")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
SPANS_SQL = """list_transform(range(1, len({m}) + 1), lambda i: struct_pack(start := list_sum(list_transform({s}[1:i], lambda x: len(x))) +
  coalesce(list_sum(list_transform({m}[1:i - 1], lambda x: len(x))), 0), place := {place}, size := len({m}[i]), part := len({v}[i])))"""


@register(
    "op5_secret_scan",
    f"""with d as (select doc_id, coalesce(text, '') as t from documents),
    p as (select doc_id, regexp_extract_all(t, '{ASSIGN}', 0) as am, regexp_extract_all(t, '{ASSIGN}', 2) as av, string_split_regex(t, '{ASSIGN}') as s0,
      regexp_extract_all(t, 'AKIA[A-Z0-9]+', 0) as km, string_split_regex(t, 'AKIA[A-Z0-9]+') as s1,
      regexp_extract_all(t, '[0-9a-f]{{24,}}', 0) as hm, string_split_regex(t, '[0-9a-f]{{24,}}') as s2 from d),
    q as (select doc_id, list_filter({SPANS_SQL.format(m="am", s="s0", v="av", place=0)}, lambda x: x.part >= 6) as a,
      list_filter({SPANS_SQL.format(m="km", s="s1", v="km", place=1)}, lambda x: x.part >= 20) as k,
      {SPANS_SQL.format(m="hm", s="s2", v="hm", place=2)} as h from p),
    r as (select doc_id, len(a) as n_assign, len(k) as n_access, len(h) as n_hex, coalesce(array_to_string(list_transform(list_sort(a || k || h),
      lambda x: concat(['assign', 'access', 'hex'][x.place + 1], ':', cast(x.start as bigint), ':', cast(x.start + x.size as bigint))), ','), '') as spans from q)
    select doc_id, n_assign, n_access, n_hex, sha256(spans) as base_sha256, spans from r""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex")], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


@register("op10_html_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


@register("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.drop_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


@register("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


@register("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register(
    "op11_hard_negatives",
    """with r as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda c: floor(256 * cast(c as double))) as x
      from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda c: coalesce(not isfinite(c), true))) = 0),
    s as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, cast(list_inner_product(a.x, b.x) as bigint) as score
      from r a, r b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    p as (select * from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
    select p.anchor_id, p.vec_id as positive_id, cast(row_number() over w as integer) as rank, s.vec_id as negative_id,
      p.score as positive_score, s.score as negative_score
    from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score
    window w as (partition by p.anchor_id, p.vec_id order by s.score desc, s.vec_id) qualify row_number() over w <= 10""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"))


@register("op12_ngram_jaccard_join")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"), k=5, threshold=80)
