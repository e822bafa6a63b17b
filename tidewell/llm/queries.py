"""Queries of the text problems, and their SQL where there is any.

Tokens can't be counted in SQL: what must hold of p6 and p7 is computed from the
rows that come out, and the SQL says what it must be.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.mixing import mix_sources
from tidewell.llm.packing import pack_texts, packing_report
from tidewell.llm.spans import shared_characters, shared_spans
from tidewell.llm.tokens import with_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))


@query
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared_characters(shared_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")))


# windows are cut from pieces of the text, since a position in a long text is sought from its start
SQL["p8_found"] = """
WITH piece AS (SELECT doc_id, o, substring(text, o + 1, 2159) AS t FROM (SELECT doc_id, text, unnest(range(0, length(text), 2000)) AS o FROM documents WHERE length(text) >= 160)),
w AS (SELECT doc_id, o + i AS pos, substring(t, i + 1, 160) AS s FROM (SELECT doc_id, o, t, unnest(range(0, least(2000, length(t) - 159))) AS i FROM piece WHERE length(t) >= 160)),
shared AS (SELECT s FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM w WHERE s IN (SELECT s FROM shared))
SELECT doc_id, sum(CASE WHEN p IS NULL THEN 160 ELSE least(160, pos - p) END)::BIGINT AS shared_chars FROM hit GROUP BY doc_id"""


@query
def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container of each text, or of each piece of a text that exceeds one."""
    return pack_texts(sized(spark, sf_dir))


@query
def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers used, against the lower bound over all texts."""
    return packing_report(pack_texts(sized(spark, sf_dir)))


@query
def p6_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pack of every text: texts placed, texts lost or doubled, containers overfull, texts cut that fit one."""
    sizes = sized(spark, sf_dir)
    packed = pack_texts(sizes)
    texts = packed.groupBy("id").agg(F.sum("size").alias("size"), F.count("*").alias("pieces"), F.max("piece").alias("last"))
    whole = sizes.select(F.col("doc_id").alias("id"), "n_tokens").join(texts, "id", "full_outer")
    wrong = F.col("size").isNull() | F.col("n_tokens").isNull() | (F.col("size") != F.col("n_tokens")) | (F.col("pieces") != F.col("last") + 1)
    needed = F.greatest(F.ceil(F.col("n_tokens") / 2048), F.lit(1))
    by_text = whole.agg(F.count("size").alias("placed"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("pieces") != needed).alias("cut_needlessly"))
    filled = packed.groupBy("container").agg(F.sum("size").alias("size"), F.max("filled").alias("told"))
    by_container = filled.agg(F.count_if(F.col("size") > 2048).alias("overfull"), F.count_if(F.col("size") != F.col("told")).alias("told_wrongly"))
    return by_text.crossJoin(by_container)  # one row each


SQL["p6_checks"] = "SELECT count(doc_id) AS placed, 0::BIGINT AS wrong, 0::BIGINT AS cut_needlessly, 0::BIGINT AS overfull, 0::BIGINT AS told_wrongly FROM documents"


@query
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text is used, with the target and the reached share of its source."""
    return mix_sources(sized(spark, sf_dir), spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


@query
def p7_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the mix, by source: its share as wanted (within a token for each source), no text too often, none of another source."""
    targets = spark.read.parquet(f"{sf_dir}/mix_targets.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id"), F.col("source").alias("own"))
    mix = p7_mix(spark, sf_dir).join(docs, "doc_id", "left").join(targets.select("source", "max_repeats"), "source", "left")
    got = mix.groupBy("source", "target_share", "reached_share").agg(
        F.sum(F.col("uses") * F.col("n_tokens")).alias("tokens"), F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") < 1)).alias("too_often"), F.count_if(~F.col("own").eqNullSafe(F.col("source"))).alias("foreign"),
        (F.count("*") - F.count_distinct("doc_id")).alias("repeated"),
    )
    total = got.agg(F.sum("tokens").alias("total"), F.count("*").alias("sources"))
    share = F.col("tokens") / F.col("total")
    met = F.abs(share - F.col("target_share")) * F.col("total") <= F.col("sources")
    return got.crossJoin(total).select("source", F.round("target_share", 9).alias("target_share"), met.alias("met"), (F.abs(share - F.col("reached_share")) < 1e-9).alias("told_rightly"), "too_often", "foreign", "repeated")


SQL["p7_checks"] = """
WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND text <> ''),
t AS (SELECT source, weight FROM mix_targets JOIN s USING (source) WHERE weight > 0 AND max_repeats > 0)
SELECT source, round(weight / sum(weight) OVER (), 9) AS target_share, true AS met, true AS told_rightly, 0::BIGINT AS too_often, 0::BIGINT AS foreign, 0::BIGINT AS repeated FROM t"""
