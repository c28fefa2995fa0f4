"""Evaluation of searches against reference addresses: keys, ranks, domain checks and the summary of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions import urls as U


def url_key(url: Column) -> Column:
    """Scheme, host, effective port and path without its last slashes, as one string; query and fragment do not count. Null for
    an address that is no plain ASCII HTTP(S) one."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    port = F.regexp_extract(url, "^[A-Za-z]+://[^/?#:]+:([0-9]+)", 1)
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    effective = F.when(port != "", port).when(scheme == "https", F.lit("443")).otherwise(F.lit("80"))
    bad = url.rlike(r"[\x00-\x20\x7f\\]")
    return F.when(U.host_of(url).isNotNull() & ~bad, F.concat_ws(" ", scheme, U.host_of(url), effective, F.when(path == "", F.lit("/")).otherwise(path)))


def judged(results: DataFrame, references: DataFrame, allowed: Column) -> DataFrame:
    """results (run, case_id, rank, url, …) with domain_allowed and reference_match: an equi join on (case, URL key).

    references: case_id, url. allowed: whether the column host may be shown."""
    keys = references.select(F.col("case_id").alias("_case"), url_key(F.col("url")).alias("_wanted")).filter("_wanted is not null").distinct()
    rows = results.withColumn("_key", url_key(F.col("url"))).withColumn("host", U.host_of(F.col("url")))
    rows = rows.withColumn("domain_allowed", F.coalesce(F.col("_key").isNotNull() & allowed, F.lit(False)))
    rows = rows.join(keys, (F.col("case_id") == F.col("_case")) & (F.col("_key") == F.col("_wanted")), "left")
    return rows.withColumn("reference_match", F.col("domain_allowed") & F.col("_wanted").isNotNull()).drop("_case", "_wanted", "_key")


def run_scores(runs: DataFrame, checked: DataFrame) -> DataFrame:
    """runs (run, …) with checked_links, domain_violations, first_reference_rank and reciprocal_rank."""
    found = checked.groupBy(F.col("run").alias("_run")).agg(
        F.count("*").alias("checked_links"), F.count_if(~F.col("domain_allowed")).alias("domain_violations"), F.min(F.when(F.col("reference_match"), F.col("rank"))).alias("first_reference_rank")
    )
    rows = runs.join(found, F.col("run") == F.col("_run"), "left").drop("_run").fillna(0, ["checked_links", "domain_violations"])
    return rows.withColumn("reciprocal_rank", F.coalesce(1 / F.col("first_reference_rank"), F.lit(0.0)))


def summary(scores: DataFrame, *by: str) -> DataFrame:
    """The eight figures of each group of runs: runs, with_results, found, MRR, complete, incomplete without the reference,
    domain violations, median of elapsed seconds."""
    found = F.col("first_reference_rank").isNotNull()
    complete = F.coalesce(F.col("complete"), F.lit(False))
    return scores.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(F.col("checked_links") > 0).alias("with_results"), F.count_if(found).alias("reference_found"), F.bround(F.avg("reciprocal_rank"), 4).alias("mean_reciprocal_rank"),
        F.count_if(complete).alias("complete_searches"), F.count_if(~complete & ~found).alias("incomplete_without_reference"), F.sum("domain_violations").alias("domain_violations"), F.bround(F.median("elapsed"), 3).alias("median_elapsed_seconds"),
    )


def write_report(records: DataFrame, path: str) -> None:
    """Replace a report as a whole: Spark commits a new folder beside it, which is then renamed into place."""
    spark = records.sparkSession
    target, draft = (spark._jvm.org.apache.hadoop.fs.Path(x) for x in (path, path.rstrip("/") + ".draft"))
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    records.write.mode("overwrite").json(draft.toString())
    fs.delete(target, True)
    fs.rename(draft, target)
