"""Replies of judge models: parsing, votes, ensembles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = ("semantic_correctness", "cs_preservation", "dialect_naturalness")
CRITERIA = ("bengali_valid", "cs_natural", "dialect_authentic", "not_noise")


def embedded_json(reply: Column) -> Column:
    """From the first brace to the last."""
    return F.nullif(F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def parse_decision(reply: Column) -> Column:
    """struct of the criteria (booleans), decision and reason; null unless the decision is a known one."""
    kind = ", ".join(f"{k} string" for k in (*CRITERIA, "decision", "reason"))
    x = F.from_json(embedded_json(reply), kind)
    decision = F.upper(F.trim(x["decision"]))
    yes = lambda k: F.coalesce(F.upper(x[k]) == "YES", F.lit(False)).alias(k)
    return F.when(decision.isin("ACCEPT", "REJECT", "UNCERTAIN"), F.struct(*map(yes, CRITERIA), decision.alias("decision"), F.substring(F.coalesce(x["reason"], F.lit("")), 1, 200).alias("reason")))


def parse_scores(reply: Column, dimensions: tuple[str, ...] = DIMENSIONS) -> Column:
    """struct of scores, cut to 0 to 5, and a brief reason; null unless every score is a number."""
    x = F.from_json(embedded_json(reply), ", ".join(f"{k} string" for k in (*dimensions, "brief_reason")))
    score = lambda k: x[k].try_cast("double").cast("int")
    known = reduce(lambda a, b: a & b, (score(k).isNotNull() for k in dimensions))
    return F.when(known, F.struct(*(F.greatest(F.lit(0), F.least(F.lit(5), score(k))).alias(k) for k in dimensions), F.substring(F.coalesce(x["brief_reason"], F.lit("")), 1, 200).alias("brief_reason")))


def prompt(template: str, **fields: Column) -> Column:
    """The template with each {field} filled in."""
    return reduce(lambda t, f: F.replace(t, F.lit("{" + f[0] + "}"), f[1]), fields.items(), F.lit(template))


def majority_vote(votes: DataFrame, key: str, decision: str = "decision") -> DataFrame:
    """key, votes by kind and the ensemble's decision; a null vote has failed. One row a judge in ``votes``."""
    n = {k: F.count_if(F.coalesce(F.col(decision) == k, F.lit(False))) for k in ("ACCEPT", "REJECT", "UNCERTAIN")}
    rows = votes.groupBy(key).agg(F.count(F.lit(1)).alias("judges"), *(c.alias(k.lower()) for k, c in n.items()), F.count_if(F.col(decision).isNull()).alias("failed"))
    need = F.floor(F.col("judges") / 2) + 1
    verdict = F.when(F.col("failed") == F.col("judges"), "REJECT").when(F.col("accept") >= need, "ACCEPT").when(F.col("reject") >= need, "REJECT").otherwise("UNCERTAIN")
    return rows.withColumn("ensemble_decision", verdict)


def criteria_verdict(passed: list[Column]) -> Column:
    """Of four criteria: three or more accept, two are uncertain, fewer reject."""
    n = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(False)).cast("int") for p in passed))
    return F.when(n >= 3, "ACCEPT").when(n == 2, "UNCERTAIN").otherwise("REJECT")


def ensemble(scores: DataFrame, key: str) -> DataFrame:
    """Per item and dimension: mean, sd, confidence and verdict over the judges. scores: key, judge, dimension, score."""
    mean, sd = F.round(F.avg("score"), 2), F.coalesce(F.stddev_samp("score"), F.lit(0.0))
    return scores.where("score IS NOT NULL").groupBy(key, "dimension").agg(mean.alias("mean"), F.round(sd, 3).alias("sd"), F.round(1 - sd / 5, 3).alias("confidence"), F.when(mean >= 3, "PASS").otherwise("FAIL").alias("verdict"))


def agreement(scores: DataFrame, key: str) -> DataFrame:
    """key, overall (halves up), agreement_rate: pairs of judges, by dimension, that differ by one at most."""
    listed = scores.where("score IS NOT NULL").groupBy(key, "dimension").agg(F.collect_list("score").alias("s"), F.round(F.avg("score"), 2).alias("m"))
    near = F.aggregate("s", F.lit(0), lambda n, x: n + F.size(F.filter("s", lambda y: F.abs(x - y) <= 1)))
    # every score is near itself, and each pair was counted twice
    listed = listed.withColumns({"near": ((near - F.size("s")) / 2).cast("long"), "pairs": (F.size("s") * (F.size("s") - 1) / 2).cast("long")})
    return listed.groupBy(key).agg(F.round(F.avg("m") + 1e-9, 2).alias("overall"), F.round(F.coalesce(F.try_divide(F.sum("near"), F.sum("pairs")), F.lit(0.0)), 3).alias("agreement_rate"))


def judge_summary(results: DataFrame, flag: str) -> DataFrame:
    """Mean overall score and agreement of all items and of each subset."""
    g = results.groupingSets([[F.col(flag)], []], F.col(flag)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("overall"), 3).alias("overall"), F.round(F.avg("agreement_rate"), 3).alias("agreement_rate"), F.grouping(flag).alias("is_total"))
    return g.withColumn("subset", F.when(F.col("is_total") == 1, "all").when(F.col(flag), "cs").otherwise("bn")).drop(flag, "is_total")
