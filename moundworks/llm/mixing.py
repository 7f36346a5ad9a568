"""Mixing sources to target weights: a time-varying curriculum.

Each source has a piecewise-linear weight schedule over training time 0 to 1.  Its integral is the source's
share of all words (water-filled below ``max_repeats`` times what the source has).  A source's documents
stand in a fixed pseudo-random order and are passed over again and again until the demand is met; the copy
that starts at word c of that stream is trained at the time when the source's cumulative demand reaches c,
found by inverting the integral.  The mix is range-sorted by that position.

Prefix sums are two-level: by (source, ``16 ** DIGITS`` hash buckets), then over the buckets' sums, so a source with a
third of all rows is spread like the others, and nothing is gathered but one row per source.  The number of buckets
changes no result; a bucket should hold some million documents at most, so raise ``digits`` for sources beyond 10^9.

Defined cases: a null source is a source of its own and comes last; a null text has size 0; size-0 documents
are never taken; a null id sorts first; repeated rows are documents of their own; texts of any length are counted whole;
with no words at all every target is 0; an empty table gives no rows; input columns named like an output column (``OUT``,
and of a mix ``copy`` and ``position``) are replaced, all others pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from moundworks.llm.common import n_words, source_table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
DIGITS = 3
OUT = ("size", "source_size", "target", "taken", "positions")
#: The columns of a schedule: knots of the weight curve of a source, times from 0 to 1.
SCHEDULE = T.StructType([T.StructField("source", T.StringType()), T.StructField("t", T.DoubleType()), T.StructField("weight", T.DoubleType())])


def measured(docs: DataFrame, keep: tuple[str, ...] | None = None, digits: int = DIGITS) -> DataFrame:
    """The columns to keep as one struct ``_row``, with each document's size in words, its place in its source's order, and
    what breaks ties."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in OUT]
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    group = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit("")))  # never null, so windows and joins share a partitioning
    rest = {"_id": F.col("doc_id"), "source": F.col("source"), "_group": group, "size": n_words(F.col("text")), "_key": key, "_bucket": F.substring(key, 1, digits), "_tie": F.xxhash64("text")}
    return docs.select(F.struct(*kept).alias("_row"), *[c.alias(n) for n, c in rest.items()])


def ranked_schedule(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Weights by rank in code-point order, repeating: odd ranks fade from 1.5 to 0.5 times theirs, even ranks grow."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))  # a row per source
    ranked = sources.select("source", rank.alias("r")).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("r") - 1, F.lit(len(weights))) + 1).cast("int")))
    first, last = F.when(F.col("r") % 2 == 1, 1.5).otherwise(0.5), F.when(F.col("r") % 2 == 1, 0.5).otherwise(1.5)
    knots = F.array(F.struct(F.lit(0.0).alias("t"), (F.col("w") * first).alias("weight")), F.struct(F.lit(1.0).alias("t"), (F.col("w") * last).alias("weight")))
    return ranked.select("source", F.explode(knots).alias("k")).select("source", "k.t", "k.weight")


def integrals(schedule: DataFrame) -> DataFrame:
    """Per source: knots (t, weight, slope, area before the knot) in order, and the whole area."""
    by = W.partitionBy("source").orderBy("t")  # a row per knot
    step = F.lead("t").over(by) - F.col("t")
    area = F.coalesce((F.col("weight") + F.lead("weight").over(by)) / 2 * step, F.lit(0.0))
    slope = F.coalesce((F.lead("weight").over(by) - F.col("weight")) / F.nullif(step, F.lit(0.0)), F.lit(0.0))
    knots = schedule.select("source", "t", "weight", slope.alias("slope"), area.alias("own")).withColumn("before", F.sum("own").over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("own"))
    return knots.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("t", "weight", "slope", "before"))).alias("_knots"), F.sum("own").alias("_area"))


def targets(sources: DataFrame, areas: DataFrame, max_repeats: int) -> DataFrame:
    """source, source_size, target, _knots, _area: shares by area, none above max_repeats times its size."""
    known = sources.join(areas.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    known = known.withColumns({"_cap": F.col("source_size") * max_repeats, "_area": F.coalesce("_area", F.lit(0.0))})
    line = W.orderBy(F.when(F.col("_area") > 0, F.col("_cap") / F.col("_area")).otherwise(F.lit(float("inf"))), F.col("source").asc_nulls_last())
    every, so_far = W.partitionBy(), line.rowsBetween(W.unboundedPreceding, -1)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(so_far), F.lit(0))) / F.nullif(F.sum("_area").over(every) - F.coalesce(F.sum("_area").over(so_far), F.lit(0.0)), F.lit(0.0))
    levels = known.withColumns({"_level": level, "_order": F.row_number().over(line)})
    fits = F.when(F.col("_level") * F.col("_area") <= F.col("_cap"), F.struct("_order", "_level"))
    best = levels.withColumn("_best", F.min(fits).over(every)["_level"])
    return best.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_best") * F.col("_area"), F.lit(0.0))).alias("target"), "_knots", "_area")


def when_reached(words: Column) -> Column:
    """The time at which a source's cumulative demand reaches so many words."""
    u = words / F.col("target") * F.col("_area")
    knot = F.element_at("_knots", F.greatest(F.size(F.filter("_knots", lambda k: k["before"] <= u)), F.lit(1)))
    rest = u - knot["before"]
    root = F.sqrt(F.greatest(knot["weight"] * knot["weight"] + knot["slope"] * rest * 2, F.lit(0.0)))
    return knot["t"] + F.coalesce(rest * 2 / F.nullif(knot["weight"] + root, F.lit(0.0)), F.lit(0.0))


def assign(rows: DataFrame, schedule: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The kept columns of ``measured`` with size, source_size, target, taken (words) and the positions of the copies taken."""
    buckets = rows.groupBy("source", "_group", "_bucket").agg(F.sum("size").alias("_n"))
    sources = buckets.groupBy("source").agg(F.sum("_n").alias("source_size"))
    goal = targets(sources, integrals(ranked_schedule(sources) if schedule is None else schedule), max_repeats)
    before = F.sum("_n").over(W.partitionBy("_group").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")  # a row per bucket
    starts = buckets.select(F.col("source").alias("_s"), "_group", "_bucket", before.alias("_start"))
    starts = starts.join(goal.withColumnRenamed("source", "_g"), F.col("_s").eqNullSafe(F.col("_g"))).drop("_g", "_s")
    own = F.sum("size").over(W.partitionBy("_group", "_bucket").orderBy("_key", "_id", "size", "_tie").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = rows.withColumn("_own", own).join(starts, ["_group", "_bucket"])
    placed = placed.withColumn("_before", F.col("_own") + F.col("_start"))
    passes = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    copies = F.transform(passes, lambda p: F.struct((F.col("_before") + F.col("source_size") * p).alias("at"), F.least(F.greatest(F.floor(F.col("target") + 0.5) - F.col("_before") - F.col("source_size") * p, F.lit(0)), F.col("size")).alias("words")))
    placed = placed.withColumn("_copies", F.filter(copies, lambda c: c["words"] > 0))
    taken = F.aggregate("_copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    positions = F.transform("_copies", lambda c: F.struct(F.floor(when_reached(c["at"].cast("double")) * 1e9 + 0.5).cast("double").alias("p"), c["words"].alias("words")))
    positions = F.transform(positions, lambda x: F.struct((x["p"] / 1e9).alias("position"), x["words"].alias("words")))
    return placed.withColumns({"taken": taken, "positions": positions}).select("_row.*", *OUT)


def mix(docs: DataFrame, schedule: DataFrame | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The training order: a row per copy taken, with copy (from 0), position and its taken words, range-sorted."""
    placed = assign(measured(docs), schedule, max_repeats).drop("taken")
    keep = [c for c in placed.columns if c not in ("positions", "copy", "position")]
    copies = placed.select(F.struct(*keep).alias("row"), F.posexplode("positions").alias("copy", "p"))
    return copies.select("row", "copy", F.col("p.position").alias("position"), F.col("p.words").alias("taken")).select("row.*", "copy", "position", "taken").orderBy("position", "doc_id", "copy")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = measured(source_table(spark, sf_dir, "documents"), ("doc_id",))
    placed = assign(docs).withColumn("position", F.element_at("positions.position", F.when(F.size("positions") > 0, 1).otherwise(None)))
    return placed.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy(F.col("position").asc_nulls_last(), "doc_id")


#: Rows of assign() without positions' structure, from a table {docs}(doc_id, text, source).
MIX_CTES = r"""sized AS (
  SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(CASE (r - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, source_size * 3 AS cap FROM by_source
), levels AS (
  SELECT *, row_number() OVER l AS k,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / (sum(w) OVER () - coalesce(sum(w) OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed WINDOW l AS (ORDER BY cap / w, source NULLS LAST)
), goal AS (
  SELECT source, source_size, w, r, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, k) FROM levels WHERE level * w <= cap)) AS target FROM levels
), ordered AS (
  SELECT s.*, g.source_size, g.target, g.w, g.r,
    CAST(sum(size) OVER (PARTITION BY s.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), copies AS (
  SELECT *, least(greatest(CAST(floor(target + 0.5) AS BIGINT) - before - source_size * p, 0), size) AS words, before + source_size * p AS pos
  FROM ordered, (VALUES (0), (1), (2)) AS passes(p)
), placed AS (
  SELECT *, pos / target * w AS u, CASE WHEN r % 2 = 1 THEN w * 1.5 ELSE w * 0.5 END AS first, CASE WHEN r % 2 = 1 THEN -w ELSE w END AS slope FROM copies
), timed AS (
  SELECT *, floor((u * 2 / (first + sqrt(greatest(first * first + slope * u * 2, 0)))) * 1e9 + 0.5) / 1e9 AS position FROM placed
)"""
OP1_SQL = f"""
WITH {MIX_CTES.format(docs="documents")}
SELECT doc_id, size, source_size, target, CAST(sum(words) AS BIGINT) AS taken, min(position) FILTER (WHERE words > 0) AS position
FROM timed GROUP BY doc_id, size, source_size, target
"""
