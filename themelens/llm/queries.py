"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from themelens.llm import (
    automata,
    exact,
    language,
    manifest,
    mixing,
    packing,
    personal,
    quality,
    secrets,
    simhash,
    spelling,
    suffixes,
    tokenfile,
)
from themelens.llm.common import documents

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_token_file": lambda spark, sf_dir: tokenfile.write_and_read(documents(spark, sf_dir)),
    "op2_quality_rules": lambda spark, sf_dir: quality.judge(documents(spark, sf_dir)),
    "op3_mix_sources": lambda spark, sf_dir: mixing.mix(documents(spark, sf_dir)),
    "op4_simhash": lambda spark, sf_dir: simhash.label(documents(spark, sf_dir)),
    "op5_language": lambda spark, sf_dir: language.identify(documents(spark, sf_dir)),
    "op6_pack": lambda spark, sf_dir: packing.pack(documents(spark, sf_dir)),
    "op7_exact_duplicates": lambda spark, sf_dir: exact.duplicates(documents(spark, sf_dir)),
    "op8_suffix_array": lambda spark, sf_dir: suffixes.report(documents(spark, sf_dir)),
    "op9_personal_data": lambda spark, sf_dir: personal.report(documents(spark, sf_dir)),
    "op10_repeated_spans": lambda spark, sf_dir: automata.report(documents(spark, sf_dir)),
    "op11_merkle_manifest": lambda spark, sf_dir: manifest.report(documents(spark, sf_dir)),
    "op12_spelling_variants": lambda spark, sf_dir: spelling.report(documents(spark, sf_dir)),
    "op13_secret_scan": lambda spark, sf_dir: secrets.report(documents(spark, sf_dir)),
}

ORACLE_SQL: dict[str, str] = {
    "op3_mix_sources": mixing.ORACLE.format(documents="documents"),
    "op7_exact_duplicates": exact.ORACLE.format(documents="documents"),
    "op10_repeated_spans": automata.ORACLE.format(documents="documents"),
    "op11_merkle_manifest": manifest.oracle(),
    "op12_spelling_variants": spelling.ORACLE.format(documents="documents"),
}


def registered() -> tuple[dict[str, Query], dict[str, str]]:
    """Queries and SQL, the pipeline's among them."""
    pipeline = importlib.import_module("corpus_pipeline")
    sql = {} if pipeline.ORACLE_SQL is None else {"pipeline": pipeline.ORACLE_SQL}
    return QUERIES | {"pipeline": pipeline.run}, ORACLE_SQL | sql
