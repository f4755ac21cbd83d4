"""Queries of problems 6 to 8 over the documents.

They have no SQL: token sizes, packings and sentence rules can't be written in it; the tests hold
them against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.catalog import table
from tidemark.llm import mixing, packing, sentences, tokens
from tidemark.session import materialize


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Where every document (or part of one) goes."""
    return packing.pack(tokens.token_counts(table(spark, sf, "documents"), ["doc_id"]))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_containers(spark, sf).filter("part = 1").select("doc_id")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(p6_containers(spark, sf))


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), ["doc_id", "source"])


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    planned = mixing.plan(_sized(spark, sf), table(spark, sf, "mixture_targets"))
    return mixing.report(planned).filter("scarce").select("source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.report(mixing.plan(_sized(spark, sf), table(spark, sf, "mixture_targets")))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    sized, targets = materialize(_sized(spark, sf), "sized"), table(spark, sf, "mixture_targets")
    return mixing.select(sized, targets, materialize(mixing.plan(sized, targets), "plan"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, sf, "documents").filter("doc_kind = 'prose'"))


def p8_units(spark: SparkSession, sf: str) -> DataFrame:
    return sentences.sentences(table(spark, sf, "documents").filter("doc_kind = 'prose'"))


QUERIES = {f.__name__: f for f in (p6_found, p6_containers, p6_report, p7_found, p7_shares, p7_mixture, p8_found, p8_units)}
ORACLE: dict[str, str] = {}
