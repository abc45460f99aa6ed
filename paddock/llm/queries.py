"""Queries of the corpus operators over the racing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.llm import components, linkage, mixing, packing, reading, survivor, tokens
from paddock.runtime import cut, table


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "horse_merge_log").where("not rolled_back").select("loser", "keeper")
    return components.components(log, "loser", "keeper")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every horse id that the merge log links, directly or through others."""
    return _groups(spark, sf_dir).select("group_id", F.col("id").alias("horse_id"))


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(survivor.claims(table(spark, sf_dir, "horse"), _groups(spark, sf_dir)), "claims").df


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row whose value survives, for each group and field with a real value."""
    return survivor.survivors(_claims(spark, sf_dir)).select("group_id", "field_name", F.col("row_id").alias("horse_id"))


def p4_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a group by the model alone, with the probability of each field's value."""
    said = _claims(spark, sf_dir)
    won = survivor.survivors(said, trust=None)
    at = lambda f: F.max(F.when(F.col("field_name") == f, F.col("value"))).alias(f)
    return won.groupBy("group_id").agg(*(at(f) for f in survivor.FIELDS), F.round(F.min("p"), 6).alias("least_p"))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of each group and field that the model judges true."""
    return survivor.kept_values(_claims(spark, sf_dir)).withColumn("p", F.round("p", 6))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    home, foreign = linkage.horse_traits(table(spark, sf_dir, "horse")), linkage.raw_traits(table(spark, sf_dir, "horse_raw"))
    return linkage.matches(home, foreign)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a horse row and a foreign record that are the same animal."""
    return _linked(spark, sf_dir).select(F.col("id").alias("horse_id"), F.col("other_id").alias("raw_id"))


def p2_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pairs with the model's confidence."""
    return _linked(spark, sf_dir).select(F.col("id").alias("horse_id"), F.col("other_id").alias("raw_id"), F.round("p", 6).alias("confidence"))


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_label"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every document with running prose."""
    return _levels(spark, sf_dir).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean score of each language and level."""
    return _levels(spark, sf_dir).groupBy("lang", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("score"), 3).alias("mean_score"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(tokens.counted(table(spark, sf_dir, "documents")), "sizes").df


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of each text (or piece of a text that alone is too long) for each capacity."""
    return packing.packed(_sizes(spark, sf_dir), table(spark, sf_dir, "pack_spec"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, tokens and room left of every container."""
    specs = table(spark, sf_dir, "pack_spec")
    return packing.fills(packing.packed(_sizes(spark, sf_dir), specs), specs)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the mixture and how often each is used."""
    return mixing.mixed(_sizes(spark, sf_dir), table(spark, sf_dir, "mix_target"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of each source."""
    sizes, targets = _sizes(spark, sf_dir), table(spark, sf_dir, "mix_target")
    return mixing.reached(cut(mixing.mixed(sizes, targets), "mix").df, sizes, targets)


def queries() -> dict:
    """The corpus queries by name; the first of each problem is the one checked."""
    return {f.__name__: f for f in (p2_found, p2_confidence, p4_found, p4_golden, p4_kept, p5_found, p8_pack, p8_fill, p9_mix, p9_shares, p10_found, p10_profile)}
