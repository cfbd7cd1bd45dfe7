"""The operators applied to their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerleaf.catalogue.registry import Query
from ledgerleaf.llm import oracles
from ledgerleaf.llm.embedding_dedup import op8_embedding_dedup
from ledgerleaf.llm.exact_dedup import op11_exact_dedup
from ledgerleaf.llm.kneser_ney import op3_quality_classifier
from ledgerleaf.llm.lm_scoring import op5_lm_scoring
from ledgerleaf.llm.merkle import op13_merkle_manifest
from ledgerleaf.llm.mixing import op6_mixing
from ledgerleaf.llm.packing import op9_packing
from ledgerleaf.llm.pii import op4_pii
from ledgerleaf.llm.quality_rules import op10_quality_rules
from ledgerleaf.llm.ranked_search import op12_ranked_search
from ledgerleaf.llm.simhash import op2_simhash
from ledgerleaf.llm.suffix_dedup import op1_suffix_dedup
from ledgerleaf.llm.token_counts import op7_token_counts


def _over(table: str, operator, oracle: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))

    return Query(run, oracle)


def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels")]
    return op3_quality_classifier(*tables)


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark")]
    return op12_ranked_search(*tables)


QUERIES = {
    "op1_suffix_dedup": _over("documents", op1_suffix_dedup),
    "op2_simhash": _over("documents", op2_simhash),
    "op3_quality_classifier": Query(quality_classifier, None),
    "op4_pii": _over("documents", op4_pii),
    "op5_lm_scoring": _over("documents", op5_lm_scoring),
    "op6_mixing": _over("documents", op6_mixing, oracles.MIXING),
    "op7_token_counts": _over("documents", op7_token_counts),
    "op8_embedding_dedup": _over("embeddings", op8_embedding_dedup, oracles.EMBEDDING_DEDUP),
    "op9_packing": _over("documents", op9_packing),
    "op10_quality_rules": _over("documents", op10_quality_rules, oracles.QUALITY_RULES),
    "op11_exact_dedup": _over("documents", op11_exact_dedup, oracles.EXACT_DEDUP),
    "op12_ranked_search": Query(ranked_search, oracles.RANKED_SEARCH),
    "op13_merkle_manifest": _over("documents", op13_merkle_manifest, oracles.MERKLE),
}
