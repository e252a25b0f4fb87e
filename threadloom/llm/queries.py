"""Registered queries pN_... of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import abuse, groupsplit, mixing, overlap, packing, pii, quality, residue
from threadloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": lambda spark, d: abuse.found(table(spark, d, "summary_records")),
    "p1_rates": lambda spark, d: abuse.rates(table(spark, d, "summary_records")),
    "p2_found": lambda spark, d: groupsplit.found(table(spark, d, "summary_records")),
    "p2_splits": lambda spark, d: groupsplit.splits(table(spark, d, "summary_records")),
    "p2_incremental": lambda spark, d: groupsplit.incremental(table(spark, d, "summary_records"), F.pmod(F.xxhash64("stimulus.id"), F.lit(4)) == 0),
    "p4_found": lambda spark, d: overlap.found(table(spark, d, "summary_records")),
    "p4_report": lambda spark, d: overlap.report(table(spark, d, "summary_records")),
    "p4_links": lambda spark, d: overlap.class_links(table(spark, d, "summary_records")),
    "p4_members": lambda spark, d: overlap.class_members(table(spark, d, "summary_records")),
    "p3_found": lambda spark, d: pii.found(table(spark, d, "summary_records")),
    "p3_redacted": lambda spark, d: pii.redacted(table(spark, d, "summary_records")),
    "p5_found": lambda spark, d: residue.found(table(spark, d, "summary_records")),
    "p5_kept": lambda spark, d: residue.kept(table(spark, d, "summary_records")),
    "p6_pack": lambda spark, d: packing.assigned(table(spark, d, "documents"), table(spark, d, "pack_sizes")),
    "p6_unused": lambda spark, d: packing.unused(table(spark, d, "documents"), table(spark, d, "pack_sizes")),
    "p7_mix": lambda spark, d: mixing.mix(table(spark, d, "documents"), table(spark, d, "source_weights")),
    "p7_shares": lambda spark, d: mixing.shares(table(spark, d, "documents"), table(spark, d, "source_weights")),
    "p8_found": lambda spark, d: quality.found(table(spark, d, "documents"), table(spark, d, "common_words")),
    "p8_kinds": lambda spark, d: quality.kinds(table(spark, d, "documents"), table(spark, d, "common_words")),
    "p8_stats": lambda spark, d: quality.document_stats(table(spark, d, "documents"), table(spark, d, "common_words")),
}

ORACLE_SQL: dict[str, str] = {}
