"""Calibration of the similarity threshold on a golden set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Thresholds to compare, and the hit rate to reach.
THRESHOLDS = (0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75)
HIT_GOAL = 0.9


def threshold_sweep(hits: DataFrame, golden: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, top_k: int = 5) -> DataFrame:
    """``(threshold, hit_rate, abstention, alternatives)`` from one search at the lowest threshold:
    dropping lower scores from a top k leaves the top k of the higher threshold."""
    spark = hits.sparkSession
    levels = F.broadcast(spark.createDataFrame([(float(t),) for t in thresholds], "threshold double"))  # a handful of rows
    expected = golden.select("query_id", F.explode_outer(F.array_distinct("expected_chunk_ids")).alias("chunk_id")).withColumn("wanted", F.lit(True))
    found = hits.where(F.col("rank") <= top_k).join(expected, ["query_id", "chunk_id"], "left").join(levels, F.col("raw") >= F.col("threshold"))
    by = found.groupBy("threshold", "query_id").agg(F.count("*").alias("eligible"), F.count_if(F.col("wanted")).alias("matched"))
    cases = golden.select("query_id", "kind", F.size(F.array_distinct("expected_chunk_ids")).alias("expected")).join(levels)
    told = cases.join(by, ["threshold", "query_id"], "left").fillna(0, ["eligible", "matched"])

    def share(kind: str, good):
        return F.avg(F.when(F.col("kind") == kind, good.cast("double")))

    return told.groupBy("threshold").agg(
        share("answerable", F.col("matched") > 0).alias("hit_rate"), share("out_of_corpus", F.col("eligible") == 0).alias("abstention"),
        share("ambiguous", F.col("matched") == F.col("expected")).alias("alternatives"),
    )


def select_threshold(sweep: DataFrame, hit_goal: float = HIT_GOAL) -> DataFrame:
    """One row: the highest threshold that meets all goals, or null with ``chosen`` false."""
    good = (F.col("hit_rate") >= hit_goal) & (F.col("abstention") == 1) & (F.col("alternatives") == 1)
    best = F.max(F.when(good, F.col("threshold")))
    return sweep.agg(best.alias("threshold"), best.isNotNull().alias("chosen"))


def compare_versions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Differences of two sweeps by threshold, new less old."""
    o = old.select("threshold", *[F.col(c).alias(f"_{c}") for c in ("hit_rate", "abstention", "alternatives")])
    return new.join(o, "threshold").select("threshold", *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_delta") for c in ("hit_rate", "abstention", "alternatives")])


def citation_precision(valid: DataFrame, invalid: DataFrame) -> DataFrame:
    """``(citations, valid, precision)``: one row; without citations 0 and two nulls. Repeated citations count each, as
    ``check_citations`` tells each once."""
    both = valid.withColumn("ok", F.lit(1)).unionByName(invalid.withColumn("ok", F.lit(0)))
    return both.agg(F.count("*").alias("citations"), F.sum("ok").alias("valid"), F.avg("ok").alias("precision"))
