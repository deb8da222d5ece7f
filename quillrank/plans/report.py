"""Result tables of experiments: long rows algorithm, cutoff, metric, value."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def results_table(results: DataFrame, metrics: list[str], cutoffs: list[int]) -> DataFrame:
    """algorithm and a column METRIC@cutoff for each, in one pass."""
    cell = F.concat("metric", F.lit("@"), F.col("cutoff").cast("string"))
    names = [f"{m}@{c}" for c in cutoffs for m in metrics]
    return results.withColumn("cell", cell).groupBy("algorithm").pivot("cell", names).agg(F.first("value"))


def marked_best(results: DataFrame, baselines: list[str]) -> DataFrame:
    """Adds best: whether a value is the best of its cutoff and metric, and beats: whether a non-baseline is above every
    baseline."""
    w = W.partitionBy("cutoff", "metric")
    is_base = F.col("algorithm").isin(baselines)
    top = F.max(F.when(is_base, F.col("value"))).over(w)
    return results.withColumn("best", F.col("value") == F.max("value").over(w)).withColumn("beats", ~is_base & (F.col("value") > top))


def latex(results: DataFrame, metrics: list[str], cutoffs: list[int], baselines: list[str], digits: int = 4) -> str:
    """Rows of a LaTeX table: baselines that beat all others, and others that beat all baselines, in bold."""
    rows = {(r["algorithm"], r["cutoff"], r["metric"]): r for r in results.collect()}  # a report's rows
    names = list(dict.fromkeys(a for a, _, _ in rows))
    lines = []
    for a in names:
        cells = []
        for c in cutoffs:
            for m in metrics:
                r = rows.get((a, c, m))
                if r is None or r["value"] is None:
                    cells.append("-")
                    continue
                rivals = [x["value"] for (b, c2, m2), x in rows.items() if (c2, m2) == (c, m) and (b in baselines) != (a in baselines) and x["value"] is not None]
                text = f"{r['value']:.{digits}f}"
                cells.append(f"\\textbf{{{text}}}" if rivals and r["value"] > max(rivals) else text)
        lines.append(f"{a} & " + " & ".join(cells) + " \\\\")
    return "\n".join(lines)


def parameters_table(cases: DataFrame) -> DataFrame:
    """algorithm, parameter, value from a map column params, one row each."""
    return cases.select("algorithm", F.explode("params").alias("parameter", "value")).orderBy("algorithm", "parameter")


def time_statistics(cases: DataFrame) -> DataFrame:
    """algorithm, n_cases, mean and sample deviation of train and evaluation seconds, and users a second when
    recommending."""
    agg = [f(c).alias(f"{c}_{n}") for c in ("train_s", "evaluate_s") for f, n in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return cases.groupBy("algorithm").agg(F.count("*").alias("n_cases"), *agg, (F.max("n_users") / F.avg("evaluate_s")).alias("users_per_s"))


def biggest_unit(seconds: float) -> tuple[float, str]:
    """A duration in the biggest unit of which it has one or more."""
    for size, name in ((86400 * 365, "year"), (86400, "day"), (3600, "hour"), (60, "min")):
        if seconds >= size:
            return seconds / size, name
    return seconds, "sec"


def mean_and_deviation(results: DataFrame) -> DataFrame:
    """algorithm, metric, mean, std over folds."""
    return results.groupBy("algorithm", "metric").agg(F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def rounded(value: float, std: float) -> str:
    """value with as many digits as its deviation tells."""
    digits = max(0, -int(math.floor(math.log10(std)))) if std > 0 else 4
    return f"{value:.{digits}f} ± {std:.{digits}f}"
