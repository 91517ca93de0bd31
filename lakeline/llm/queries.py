"""The queries of this subpackage, and what DuckDB's SQL can say of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeline.llm import conversation_repair, language_bloom, lexical_blocks, line_rules, masked_lm, near_dup, packing, pair_index_bpe, quality_pu, set_relation_join, token_files, topk_nra, toxicity_fm
from lakeline.llm.common import remainder, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def held_out(n: int, rest: int) -> F.Column:
    return F.coalesce(remainder(n) == rest, F.lit(False)).alias("held_out")


def toxicity_model(docs: DataFrame, sf_dir: str) -> toxicity_fm.Model:
    labels = table(docs.sparkSession, sf_dir, "labels").where(remainder(5) != 0).select("doc_id", "toxic")
    return toxicity_fm.fit(docs, labels)


def language_model(docs: DataFrame) -> language_bloom.Model:
    return language_bloom.fit(docs.where(F.col("lang").isNotNull() & (remainder(4) != 2)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    scored = toxicity_fm.score(docs, toxicity_model(docs, sf_dir))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where((remainder(5) != 0) & (F.col("quality") == 1)).select("doc_id")
    scored = quality_pu.score(docs, quality_pu.fit(docs, good))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


def op7_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.score(documents(spark, sf_dir))


def op8_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_index_bpe.digests(documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    predicted = language_bloom.predict(docs.select("doc_id", "text"), language_model(docs))
    return predicted.select("doc_id", held_out(4, 2), "lang_pred", "score")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op11_set_relation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_relation_join.classes(documents(spark, sf_dir))


def op12_lexical_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_blocks.search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_topk, op3_quality, op4_line_rules, op5_packing, op6_token_files, op7_masked_lm, op8_pair_index_bpe, op9_language, op10_near_dup, op11_set_relation_join, op12_lexical_blocks, op13_conversation_repair)}


TOPK_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as q from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q))
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score from s
qualify row_number() over (partition by query_id order by score desc, vec_id) <= 20
"""

#: Classes of similar texts: by n-grams of one word and so many more, similarity in percent.
CLASSES_SQL = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - {more} + 1, 2)::bigint)) as i from d where len(w) > 0),
s as (select distinct doc_id, array_to_string(w[i : i + {more}], ' ') as g from p),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {percent} * (x.n + y.n - k)),
both_ways as (select a, b from e union all select b, a from e),
reach as (select doc_id as node, doc_id as root from n union select b, root from reach join both_ways on a = node),
comp as (select node, min(root) as component_id from reach group by node)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(component_id, d.doc_id) as component_id{rest}
from d left join n using (doc_id) left join comp on comp.node = d.doc_id
"""


def classes_sql(size: int, percent: int, rest: str = "") -> str:
    return CLASSES_SQL.replace("{more}", str(size - 1)).replace("{percent}", str(percent)).replace("{rest}", rest)


NEAR_SQL = classes_sql(5, 85, ", coalesce(component_id, d.doc_id) = d.doc_id as kept")


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": TOPK_SQL, "op4_line_rules": line_rules.ORACLE, "op10_near_dup": NEAR_SQL, "op11_set_relation_join": classes_sql(3, 90), "op12_lexical_blocks": lexical_blocks.ORACLE, "op13_conversation_repair": conversation_repair.ORACLE}
