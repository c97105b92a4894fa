"""The registered queries of the operators, on their whole tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir
from . import codes, decontaminate, language, mixing, neardup, pages, pii, quality, spelling, spotsigs, substrings, tokens, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


@query("op1_suffix_array_dedup")
def op1(spark, sf):
    return substrings.repeated_bytes(table(spark, sf, "documents"))


@query("op2_minhash_near_dup")
def op2(spark, sf):
    return neardup.near_duplicates(table(spark, sf, "documents"), threshold=0.8, words=2)


@query("op3_html_extraction")
def op3(spark, sf):
    return pages.main_text(table(spark, sf, "pages"))


@query("op4_token_binary")
def op4(spark, sf):
    return tokens.token_digest(table(spark, sf, "documents"), f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}")


@query("op5_temperature_mixing", mixing.SQL)
def op5(spark, sf):
    return mixing.mix(table(spark, sf, "documents"))


@query("op6_document_fingerprints")
def op6(spark, sf):
    return spotsigs.fingerprints_and_edits(table(spark, sf, "documents"))


@query("op7_quality_classifier")
def op7(spark, sf):
    return quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op8_language_id")
def op8(spark, sf):
    return language.identify(table(spark, sf, "documents"))


@query("op9_pii_surrogates")
def op9(spark, sf):
    return pii.pseudonymise(table(spark, sf, "documents").select("doc_id", "text"))


@query("op10_benchmark_decontamination", decontaminate.SQL)
def op10(spark, sf):
    return decontaminate.report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op11_warc", warc.SQL)
def op11(spark, sf):
    return warc.write_and_read(table(spark, sf, "pages"), f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}")


@query("op12_spelling_variants")
def op12(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))


@query("op13_vector_codes", codes.SQL)
def op13(spark, sf):
    return codes.compress(table(spark, sf, "embeddings"))
