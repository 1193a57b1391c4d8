"""The operators' queries: one for each, over whole tables, with fixed result columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The key of the registered query; production passes its own secret.
PII_KEY = "registered-query-key"


def op1_pii(spark, sf_dir):
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, counts=True)


def op2_near_duplicates(spark, sf_dir):
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_topk(spark, sf_dir):
    from .topk import top_inner_products

    return top_inner_products(table(spark, sf_dir, "embeddings"))


def op4_licences(spark, sf_dir):
    from .licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark, sf_dir):
    from .lm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    from .mixing import with_copies

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontamination(spark, sf_dir):
    from .decontaminate import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_url_filter(spark, sf_dir):
    from .urlfilter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op9_repeats(spark, sf_dir):
    from .repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)


def op10_toxicity(spark, sf_dir):
    from .toxicity import toxicity_report

    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fill_in_middle(spark, sf_dir):
    from .fim import digests

    return digests(table(spark, sf_dir, "documents"))


def op12_languages(spark, sf_dir):
    from .ppm import predict_languages

    return predict_languages(table(spark, sf_dir, "documents"))


def op13_whitening(spark, sf_dir):
    from .whiten import whitened_long

    return whitened_long(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_near_duplicates, op3_topk, op4_licences, op5_lm_scores, op6_mixing, op7_decontamination, op8_url_filter, op9_repeats, op10_toxicity,
                                   op11_fill_in_middle, op12_languages, op13_whitening)}


def _oracles() -> dict[str, str]:
    from .fim import FIM_SQL
    from .mixing import MIX_SQL
    from .oracles import DECONTAMINATION_SQL, URL_SQL
    from .topk import TOPK_SQL

    return {"op3_topk": TOPK_SQL, "op6_mixing": MIX_SQL, "op7_decontamination": DECONTAMINATION_SQL, "op8_url_filter": URL_SQL, "op11_fill_in_middle": FIM_SQL}


ORACLES = _oracles()
