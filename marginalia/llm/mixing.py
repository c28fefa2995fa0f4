"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Targets: sources in code-point order (null last) get weights by cycling through ``weights`` and share ``ratio`` of all sizes;
a target stops at ``max_epochs`` times its source's size, and the excess is shared again by weight, until none is above.
That fixed point is min(cap, level * weight) for one level, found by ordering sources by cap / weight.

Selection: a source takes floor(target / source size) complete epochs; for the rest its documents are ordered by the
exponential key -ln(u) / quality, u a hash of the document, and prefix-summed to the remaining budget; the document that
crosses it is taken if that comes nearer. The order is made by range partitioning on (source, key), so a source of any
share of the rows spreads over tasks; its selection is then a cut point, one row a source, that every document is held
against. Only the one range that holds a source's cut is ordered within a window.

Defined cases: a null or empty text has size 0 and takes 0; a null source is a source of its own; a null doc_id sorts
first; rows equal in source, key, id and size share one decision; a source of size 0 has target 0; an empty table gives
an empty result. Extra columns are ignored by ``mix`` and passed through by ``repeat_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.common import WORD, materialize, table, unused

SYMBOLS = "#*$%&|<>"
WEIGHTS = (3, 1, 2)


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def quality_of(text: str = "text") -> Column:
    """Quality weight in [0.1, 1]: less with the share of symbols; 1 for an empty text."""
    marks = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4 * marks / F.nullif(F.length(text), F.lit(0))), F.lit(1.0))


def key_of(doc_id: str, quality: Column, seed: int) -> Column:
    """Exponential key: -ln(u) / quality, u from 52 bits of an MD5 of the seed and the id; smallest first."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double")
    return -F.log((bits + 0.5) / F.lit(float(1 << 52))) / quality


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """source, source_size, target, epochs, rest; sizes holds (source, source_size), one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # single-partition windows over one row a source, never over documents
    ranked = sizes.withColumn("_i", (F.row_number().over(order) - 1) % len(weights)).withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), F.col("_i").cast("int") + 1).cast("double"))
    ranked = ranked.withColumn("_cap", (max_epochs * F.col("source_size")).cast("double"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        ranked.withColumn("_total", ratio * F.sum("source_size").over(every))
        .withColumn("_cap_before", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_w_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_cap_before")) / F.col("_w_left"))
    )
    # a source is capped if the level that the sources before it leave exceeds its own cap / weight
    capped = F.col("_level") * F.col("_w") >= F.col("_cap")
    first_free = F.min(F.when(~capped, F.struct((F.col("_cap") / F.col("_w")).alias("a"), F.col("_cap_before").alias("b"), F.col("_level").alias("level")))).over(every)
    ranked = ranked.withColumn("_free_level", first_free.getField("level"))
    target = F.when(capped, F.col("_cap")).otherwise(F.col("_free_level") * F.col("_w"))
    out = ranked.withColumn("target", target)
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("bigint")
    out = out.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    return out.select("source", "source_size", "target", "epochs", "rest")


def plan(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """One row a source: targets() and its cut; items holds (source, key, id, size), a written table.

    A document is in the fractional selection if (key, id, size) is below the cut, or equal to it where ``at_cut``.
    """
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = materialize(targets(sizes, weights, ratio, max_epochs), "targets")
    goal = goals.select(F.col("source").alias("of"), "rest")
    ordered = items.repartitionByRange("source", "key", "id", "size").withColumn("part", F.spark_partition_id())
    ordered = materialize(ordered, "ordered")
    sums = ordered.groupBy("source", "part").agg(F.sum("size").alias("words"))  # one row a source and range
    upto = Window.partitionBy("source").orderBy("part")
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words")).join(goal, F.col("source").eqNullSafe(F.col("of")))
    crossing = sums.filter((F.col("rest") > 0) & (F.col("before") + F.col("words") > F.col("rest")))
    crossing = crossing.groupBy("source").agg(F.min_by(F.struct("part", "before", "rest"), "part").alias("x")).select(F.col("source").alias("of"), F.col("x.part").alias("in_part"), "x.before", "x.rest")
    near = ordered.join(crossing, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in_part")))
    tied = near.groupBy("source", "key", "id", "size").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("source").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tied = tied.withColumn("after", F.col("before") + F.sum("words").over(inside))
    in_cut = (F.col("after") - F.col("words") < F.col("rest")) & (F.col("after") - F.col("rest") <= F.col("rest") - (F.col("after") - F.col("words")))
    place = F.struct("key", "id", "size")
    cuts = tied.groupBy("source").agg(F.max(F.when(in_cut, place)).alias("last"), F.min(place).alias("low"))
    cuts = cuts.select(F.col("source").alias("of"), F.coalesce("last", "low").alias("cut"), F.col("last").isNotNull().alias("at_cut"))
    return materialize(goals.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "cuts")


def _times(place: Column) -> Column:
    chosen = F.coalesce((place < F.col("cut")) | (F.col("at_cut") & (place == F.col("cut"))), F.lit(False))
    return F.col("epochs") + chosen.cast("bigint")


def mix(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, taken, times of every document."""
    items = docs.select("doc_id", "source", key_of("doc_id", quality_of(), seed).alias("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"), size_of().alias("size"))
    items = materialize(items, "items")
    chosen = plan(items.drop("doc_id"), weights, ratio, max_epochs).withColumnRenamed("source", "from")
    joined = items.join(chosen, F.col("source").eqNullSafe(F.col("from")))
    out = joined.withColumn("times", _times(F.struct("key", "id", "size")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def repeat_documents(docs: DataFrame, seed: int = 17, weights: tuple[int, ...] = WEIGHTS, ratio: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    whole, key, number, size = (unused(docs, n) for n in ("_row", "_key", "_id", "_size"))
    items = docs.select(F.struct(*docs.columns).alias(whole), "source", key_of("doc_id", quality_of(), seed).alias(key), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias(number), size_of().alias(size))
    light = materialize(items.select("source", F.col(key).alias("key"), F.col(number).alias("id"), F.col(size).alias("size")), "items")
    chosen = plan(light, weights, ratio, max_epochs).withColumnRenamed("source", "from")
    place = F.struct(F.col(key).alias("key"), F.col(number).alias("id"), F.col(size).alias("size"))
    joined = items.join(chosen, F.col("source").eqNullSafe(F.col("from")))
    out = joined.select(whole, F.explode(F.array_repeat(F.lit(1), _times(place).cast("int"))).alias("_n"))
    return out.select(f"{whole}.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("times")


#: The same rows in DuckDB SQL.
OP6_SQL = r"""
WITH items AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || md5('17:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
           / coalesce(greatest(0.1::DOUBLE, 1 - 4 * (length(text) - length(translate(text, '#*$%&|<>', ''))) / nullif(length(text), 0)::DOUBLE), 1.0::DOUBLE) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM items GROUP BY source),
ranked AS (
  SELECT *, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w, (2 * source_size)::DOUBLE AS cap,
         1.5::DOUBLE * sum(source_size) OVER () AS total FROM sizes),
filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER f, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER f, 0)) AS level
  FROM ranked WINDOW f AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (
  SELECT source, source_size, CASE WHEN level * w >= cap THEN cap ELSE first_value(level) OVER (ORDER BY level * w >= cap, cap / w, source NULLS LAST) * w END AS target
  FROM filled),
spans AS (
  SELECT i.*, g.source_size, g.target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS epochs,
         sum(size) OVER (PARTITION BY i.source ORDER BY key, doc_id NULLS FIRST, size) AS after
  FROM items i JOIN goals g ON i.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
       (size * (epochs + (after - size < target - epochs * source_size
         AND after - (target - epochs * source_size) <= (target - epochs * source_size) - (after - size))::BIGINT))::BIGINT AS taken
FROM spans
"""
