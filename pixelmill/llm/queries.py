"""The thin queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import archives, exact_dedup, filter_audit, line_dedup, minhash, mixing, packing, periodic_runs, quality_rules, rule_ensemble, secrets, topk, url_templates
from pixelmill.llm.common import table, work_dir, written


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.classify(docs, rule_ensemble.train(docs, table(spark, sf_dir, "labels")))


#: Fixed values of the contract.
URL_RULES = [
    url_templates.Rule("block", "com", "/en/"),
    url_templates.Rule("allow", "example.com", "/en/7"),
    url_templates.Rule("allow", "net", "/de/"),
    url_templates.Rule("block", "example.net", "/de/8"),
    url_templates.Rule("block", "org", "/es/"),
]


def op2_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page shows the document whose number is the last one in its path, and has that document's label."""
    pages = table(spark, sf_dir, "pages")
    shown = pages.select("page_id", F.regexp_extract(url_templates.host_and_path(F.col("url"))[1], r"/([0-9]{1,18})(?:\.html)?/?$", 1).alias("number")).where("number <> ''")
    marks = table(spark, sf_dir, "labels").where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("number")).agg((1.0 - F.avg("quality")).alias("bad"))
    labels = shown.withColumn("number", F.col("number").cast("long")).join(marks, "number").select("page_id", "bad")
    return url_templates.judge(pages, labels, URL_RULES)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in the mix of all sources: slot, and place in the slot's block."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_order(docs, places=("block", "slot", "in_block")).drop("text")


def op4_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = archives.write_archives(table(spark, sf_dir, "pages"), work_dir(spark, "archives"))
    return archives.read_archives(manifest).drop("url", "payload")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(topk.quantised(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(secrets.samples(docs)))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line that takes part: where the line that stays for it stands, and whether it is this one."""
    return line_dedup.line_components(table(spark, sf_dir, "documents"), **line_dedup.FINE).select("doc_id", "line_no", "kept_doc_id", "kept_line_no", "kept")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), in_files=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.measure(table(spark, sf_dir, "documents"), rewrite=periodic_runs.planted)


OP4_SQL = """
with p as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), r as (
  select *, max(page_id) over (partition by payload_digest) as response from p
)
select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < response then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id < response then response end as refers_to, true as digest_ok
from r
"""

OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 10
"""

OP11_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words from documents
), g as (
  select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1
), f as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
    (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text))::int
    + 8 * (regexp_matches(text, '[#$%&*|]'))::int + 16 * coalesce(doc_id > min(doc_id) over (partition by text), false)::int as fails
  from d left join g using (doc_id)
), n as (
  select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from f group by 1, 2
), l(l) as (values ('A'), ('B'), ('C'), ('D'), ('E')), o as (
  select a.l || b.l || c.l || d.l || e.l as filter_order from l a, l b, l c, l d, l e
  where a.l not in (b.l, c.l, d.l, e.l) and b.l not in (c.l, d.l, e.l) and c.l not in (d.l, e.l) and d.l <> e.l
), s as (
  select filter_order, cast(step as integer) as step, 1 << (ascii(substr(filter_order, step, 1)) - 65) as bit,
    cast(list_sum(list_prepend(0, list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65)))) as integer) as before
  from o, range(1, 6) r(step)
)
select part, filter_order, step, cast(sum(case when fails & (before | bit) = 0 then n else 0 end) as bigint) as kept,
  cast(sum(case when fails & bit <> 0 and fails & before = 0 then n else 0 end) as bigint) as removed, cast(sum(case when fails & bit <> 0 and fails & before <> 0 then n else 0 end) as bigint) as redundant,
  cast(sum(case when fails = bit then n else 0 end) as bigint) as unique_fails, cast(sum(case when fails & bit <> 0 and fails & before = 0 then good else 0 end) as bigint) as good_lost,
  cast(sum(case when fails & bit <> 0 and fails & before = 0 then toxic else 0 end) as bigint) as toxic_lost, cast(sum(case when fails & bit <> 0 then n * (120 // bit_count(fails)) else 0 end) as bigint) as shapley
from n, s group by 1, 2, 3
"""

OP12_SQL = """
with t as (select doc_id, coalesce(text, '') as text from documents), r as (
  select *, count(*) over (partition by text) as n, row_number() over (partition by text order by doc_id desc nulls last) as place from t
)
select doc_id, max(doc_id) over (partition by text) as keep_id, n as group_size, place = 1 as kept, sha256(text) as text_sha256 from r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rule_ensemble, op2_url_templates, op3_mixing, op4_archives, op5_topk, op6_secrets, op7_line_dedup, op8_packing, op9_quality_rules, op10_minhash, op11_filter_audit, op12_exact_dedup, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {"op4_archives": OP4_SQL, "op5_topk": OP5_SQL, "op11_filter_audit": OP11_SQL, "op12_exact_dedup": OP12_SQL}
