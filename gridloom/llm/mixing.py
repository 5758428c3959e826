"""Mixing sources to target weights, exact to the word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, parts, staged, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null and for texts of white space alone."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """``rows`` with the sums over all rows before each one, in ``order``; a row for each row.

    Rows are laid in sorted ranges, each range is summed in its own task, and
    only the ranges' totals, one row each, meet in one place.
    """
    laid = staged(rows.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), label)
    totals = laid.groupBy("range_no").agg(*[F.sum(c).alias(f"{k}_total") for k, c in sums.items()])
    before = Window.partitionBy().orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("range_no", *[F.coalesce(F.sum(f"{k}_total").over(before), F.lit(0)).alias(f"{k}_base") for k in sums])
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = laid.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{k}_inside") for k, c in sums.items()])
    joined = own.join(F.broadcast(totals), "range_no")
    return joined.select(*rows.columns, *[(F.col(f"{k}_base") + F.col(f"{k}_inside")).alias(k) for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """``(source, source_size, target)`` for sized rows ``(source, size)``.

    ``share`` times all sizes is dealt out by weight; a target stops at
    ``most`` times its source's size, and the excess goes to the others by
    weight until none is above. That is water-filling, solved in one pass:
    sources sorted by the level at which they fill up are full as long as the
    level that the rest would reach lies above theirs. One row a source, and
    both orders are running sums over ranges, so sources may be as many as hosts.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = running(by, [F.col("source").asc_nulls_last()], {"rank": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.select("source", "source_size", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    by = running(by, [F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()], {"caps": F.col("cap"), "ws": F.col("w")}, "levels")
    whole = by.agg(F.sum("source_size").alias("sizes"), F.sum("w").alias("ws")).first()
    level = (F.lit((whole.sizes or 0) * share) - F.col("caps")) / (F.lit(whole.ws or 0) - F.col("ws"))
    # The first source that is not full sets the level for it and all after it.
    found = by.withColumn("level", level).where("level * w < cap").agg(F.min(F.struct(F.col("cap") / F.col("w"), "level"))["level"].alias("level")).first().level
    cap = F.col("cap").cast("double")
    return by.select("source", "source_size", (cap if found is None else F.least(cap, F.lit(found) * F.col("w"))).alias("target"))


#: Rows of a source that a range of keys has on average, and ranges that a source has at least.
RANGE_ROWS, RANGES = 100_000, 4096


def mix(docs: DataFrame, seed: int = 42, size: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, *keep)``, a row for each row of ``docs``; names in ``keep`` must not be among the first five.

    Each document gets a hash-random key; keys are cut into equal ranges, which
    sorts a source into buckets that are even however large the source is, as there are more of
    them the more rows there are. Sums by (source, bucket) are prefix-summed over the buckets of a source,
    and each bucket's rows are then prefix-summed on their own,
    so no task ever holds a source. ``taken`` counts whole epochs of the
    document plus what falls below the source's cut in the last, partial epoch;
    a source's ``taken`` add up to its rounded target exactly.

    The key depends on doc_id, text and seed alone, so reruns agree. Rows of
    one key are repeats: each gets a row, and very many of them are dealt over
    as many places as there are shuffle partitions, one after another. A null text has size 0; a null source is a source of
    its own, last in order; an empty table gives no rows; further columns are
    ignored, unless named in ``keep``.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id"), F.md5(F.col("text").cast("binary"))).cast("binary"))
    # One never-null key for a source, so that every join and window is a plain equality.
    group = F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("source"))).alias("group")
    rows = docs.select("doc_id", "source", group, size.alias("size"), key.alias("key"), *[F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)])
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(parts(docs.sparkSession))).cast("int")
    sized = staged(rows.withColumn("turn", spread), "sized")
    buckets = max(RANGES, sized.count() // RANGE_ROWS)
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("long").alias("bucket")
    sized = sized.withColumn("bucket", bucket)
    # Repeats are summed by turn, so that what follows has few rows of a key.
    runs = sized.groupBy("group", "bucket", "key", "turn").agg(F.sum("size").alias("run_size"), F.first("source").alias("source"))
    inside = F.sum("run_size").over(Window.partitionBy("group", "bucket").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("inside", F.coalesce(inside, F.lit(0)))
    sums = staged(runs.groupBy("group", "bucket").agg(F.sum("run_size").alias("size"), F.first("source").alias("source")), "sums")
    offsets = sums.select("group", "bucket", (F.sum("size").over(Window.partitionBy("group").orderBy("bucket")) - F.col("size")).alias("offset"))
    targets = source_targets(sums.select("source", "size"), weights, share, most).select(group, "source_size", "target")
    plan = staged(runs.select("group", "bucket", "key", "turn", "inside").join(offsets, ["group", "bucket"]).join(targets, "group"), "plan")
    place = Window.partitionBy("group", "bucket", "key", "turn").orderBy("size")
    joined = sized.withColumn("earlier", F.col("size") * (F.row_number().over(place) - 1)).join(plan, ["group", "bucket", "key", "turn"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inside") - F.col("earlier")))
    taken = (epochs * F.col("size") + last).cast("long").alias("taken")
    return joined.select("doc_id", "size", "source_size", "target", taken, *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    return mix(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(concat_ws(':', 42, doc_id, md5(text))) AS key FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT] AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2 * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER ()
      - coalesce(sum(2 * source_size) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(w) OVER (ORDER BY (2 * source_size)::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM sources),
chosen AS (SELECT arg_min(level, cap::DOUBLE / w) AS level FROM levels WHERE level * w < cap),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT level FROM chosen) * w, cap::DOUBLE)) AS target FROM levels),
cuts AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    CASE WHEN t.source_size > 0 THEN round(t.target)::BIGINT // t.source_size ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM cuts
"""
