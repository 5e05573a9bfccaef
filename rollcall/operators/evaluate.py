"""Evaluation on labelled data, and what a run costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import reconcile


def confusion(df: DataFrame) -> DataFrame:
    """df: predicted, expected (booleans) -> counts, precision, recall, accuracy and F1 (0 where undefined)."""
    n = lambda c: F.count_if(c)
    p, e = F.col("predicted"), F.col("expected")
    one = df.agg(n(p & e).alias("tp"), n(~p & ~e).alias("tn"), n(p & ~e).alias("fp"), n(~p & e).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    one = one.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
                           "accuracy": ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))})
    return one.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(
        "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy", "f1")])


def by_kind(df: DataFrame, kind: str) -> DataFrame:
    right = F.col("predicted") == F.col("expected")
    return df.groupBy(kind).agg(F.count_if(right).alias("correct"), F.count_if(~right).alias("wrong")).orderBy(kind)


def misclassified(df: DataFrame) -> DataFrame:
    return df.filter(F.col("predicted") != F.col("expected"))


def decisions(fixtures: DataFrame, reports: DataFrame) -> DataFrame:
    """Labelled decisions: fixtures (id, field, expected) and the candidates of their reports, keyed (id, field).

    conflict and blocked_unsafe count as human_review, and are right only if the conflict was seen or the confidence,
    as shown, would have cleared the bar.
    """
    got = reconcile.score(reports, keys=("id", "field"))
    rows = fixtures.join(got, ["id", "field"], "left").withColumn("predicted", F.coalesce("decision", F.lit("no_change")))
    wanted = F.when(F.col("expected").isin("conflict", "blocked_unsafe"), "human_review").otherwise(F.col("expected"))
    right = (F.col("predicted") == wanted) & F.when(F.col("expected") == "conflict", F.coalesce("conflict", F.lit(False))).when(
        F.col("expected") == "blocked_unsafe", F.coalesce(F.col("confidence") >= F.col("bar"), F.lit(False))).otherwise(True)
    metric = (F.when((F.col("predicted") == "auto_update") & (wanted == "auto_update"), "correct_auto_update").when(F.col("predicted") == "auto_update", "false_auto_update")
              .when((F.col("predicted") == "human_review") & (wanted == "human_review"), "correct_human_review").when(F.col("predicted") == "human_review", "false_human_review")
              .when(wanted == "no_change", "correct_no_change").otherwise("missed_change"))
    return rows.select("id", "field", "expected", "predicted", right.alias("correct"), metric.alias("metric"), "confidence")


def metrics(decided: DataFrame) -> DataFrame:
    return decided.groupBy("metric").agg(F.count(F.lit(1)).alias("n"))


def run_summary(providers: DataFrame, quarantined: DataFrame, routed: DataFrame, external: DataFrame, duplicates: DataFrame, stale: DataFrame) -> DataFrame:
    """measure, n: what a run held, decided, wrote and found; no_change counts records that sources know and none changes."""
    c = F.col
    changes = routed.agg(F.count_if(c("decision") == "AUTO_UPDATE").alias("auto_update"), F.count_if(c("decision") == "NEEDS_REVIEW").alias("needs_review"),
                         F.count_if(F.lower("reason").contains("conflict")).alias("conflicts"), F.count_if(c("status") == "applied").alias("applied"))
    rows = [changes.select(F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), c(m).alias("n")) for m in changes.columns])))]
    untouched = external.select("npi").distinct().join(routed.select("npi"), "npi", "left_anti")
    tables = {"providers": providers, "quarantined": quarantined, "no_change": untouched, "duplicates": duplicates, "stale": stale}
    rows += [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(m).alias("measure"), "n") for m, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def run_cost(counts: DataFrame, minutes: float = 4.0, hourly: float = 25.0, extracted_share: float = 0.15, per_call: float = 0.0011, compute_per_1k: float = 0.05) -> DataFrame:
    """counts: one row with records and reviews -> review, extraction, compute, total and review-everything cost."""
    n, one = F.col("records"), F.lit(minutes / 60 * hourly)
    out = counts.withColumns({"review_cost": F.col("reviews") * one, "extraction_cost": n * extracted_share * per_call, "compute_cost": n / 1000 * compute_per_1k, "review_all_cost": n * one})
    total = F.col("review_cost") + F.col("extraction_cost") + F.col("compute_cost")
    return out.withColumn("total_cost", total).select("records", "reviews", *[F.round(c, 4).alias(c) for c in ("review_cost", "extraction_cost", "compute_cost", "total_cost", "review_all_cost")])
