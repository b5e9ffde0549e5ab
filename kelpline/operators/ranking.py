"""Best rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """TK9: the first k rows of each group; Spark cuts groups per task before it shuffles."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def best_with_margin(scored: DataFrame, probe: str, item: str, score: str, accept: float, review: float, margin: float) -> DataFrame:
    """Each probe's best item, its runner-up's score, and accept, manual_review or reject.

    accept needs a score and a lead over the runner-up; ties go to the smaller item. Two partial aggregates, no
    window: a probe with millions of items is summed up task by task.
    """
    best = F.min_by(F.struct(item, score), F.struct(-F.col(score), F.col(item)))
    tops = scored.groupBy(probe).agg(best.alias("b"))
    tops = tops.select(probe, F.col(f"b.{item}").alias("best_item"), F.col(f"b.{score}").alias("best_score"))
    rest = scored.join(tops.select(probe, F.col("best_item").alias(item)), [probe, item], "left_anti")
    tops = tops.join(rest.groupBy(probe).agg(F.max(score).alias("runner_up")), probe, "left")
    lead = F.col("runner_up").isNull() | (F.col("best_score") - F.col("runner_up") >= margin)
    verdict = F.when((F.col("best_score") >= accept) & lead, "accept").when(F.col("best_score") >= review, "manual_review").otherwise("reject")
    return tops.withColumn("verdict", verdict)


def dominant(rows: DataFrame, keys: list[str], label: str, votes: str, position: str) -> DataFrame:
    """AG9: the label with the most votes, the first of those that tie."""
    return rows.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col(votes), F.col(position))).alias("dominant"), F.max(votes).alias("votes"))


def first_per_key(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """AG31, SO6, SRC15: the first row of each key."""
    return top_k(rows, keys, [F.col(position)], 1).drop("rank")
