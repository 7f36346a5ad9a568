"""Answers for any number of date windows without joining windows and pitches.

Two structures over (pitcher, day):

* the prefix-sum cube: counts and sums of every measure by pitcher, type and day, with running totals over the days.  A
  window's statistics are the totals up to its end less those before its start; both are found as of a day, so a window costs
  two look-ups however long it is, and windows that end on the same day share one.
* samples by dyadic blocks of days: a window is cut into a logarithmic number of blocks of 2^k days, each block that some
  window uses keeps its first pitches in the fixed order, and a window's sample is the first of its blocks' samples.  A pitch
  is looked at once per block size at most, whatever the number of windows.

Work grows with the pitches and with the windows, not with their product.  No group grows without bound: running totals are
over a pitcher's days, samples are cut where the rows are before they move.  Sums are doubles: they are exact for measures in
dyadic fractions, and else within some 1e-12 of the pitcher's whole sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from moundworks.functions.constants import MAX_LOCATIONS, VALID_ARSENAL
from moundworks.functions.expressions import RUN_VALUE
from moundworks.operators import arsenal, charts, clean
from moundworks.sources.shared import materialise

REST = ""  # the type of pitches that are not clean: they count as rows only
TYPES = (*VALID_ARSENAL, REST)
LEVELS = 23  # blocks of up to 2^22 days: more than all dates have


def near_windows(rows: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows of pitchers with a window, from the start of their first to the end of their last one: others cannot matter."""
    spans = windows.groupBy("pitcher").agg(F.min("start_date").alias("_from"), F.max("end_date").alias("_to"))  # a row per pitcher
    return rows.join(spans, "pitcher").where("game_date BETWEEN _from AND _to").drop("_from", "_to")


def daily(pitches: DataFrame) -> DataFrame:
    """pitcher, pitch_type, game_date with counts and sums: one hash aggregation.  Days only add rows, so a stored table of
    them is kept up to date by appending those of new pitches."""
    kind = F.when(clean.is_valid(), F.col("pitch_type")).otherwise(F.lit(REST))
    sums = [F.sum(F.when(~F.isnan(c), F.col(c))).alias(a) for a, c in arsenal.AVERAGES.items()]
    counts = [F.count(F.when(~F.isnan(c), F.col(c))).alias(f"n_{a}") for a, c in arsenal.AVERAGES.items()]
    return pitches.groupBy("pitcher", kind.alias("pitch_type"), "game_date").agg(F.count("*").alias("count"), F.sum(F.expr(RUN_VALUE)).alias("rv"), *sums, *counts)


def daily_counts(pitches: DataFrame) -> DataFrame:
    """The same with the pitches and the clean ones among them alone, all types as one."""
    return pitches.groupBy("pitcher", "game_date").agg(F.count("*").alias("n_rows"), F.count(F.when(clean.is_valid(), 1)).alias("n_clean")).withColumn("pitch_type", F.lit(REST))


def state_of(days: DataFrame) -> list[str]:
    """What is summed of daily rows."""
    return [c for c in days.columns if c not in ("pitcher", "pitch_type", "game_date")]


def merged(days: DataFrame) -> DataFrame:
    """Daily rows with those of the same pitcher, type and day added up (they may come from several landings)."""
    return days.groupBy("pitcher", "pitch_type", "game_date").agg(*[F.sum(c).alias(c) for c in state_of(days)])


def as_of(days: DataFrame, asked: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """pitcher, pitch_type, day and the running totals of each of the types at the end of each distinct day asked for
    (pitcher, day).

    The days asked for stand among the daily rows as rows of nothing, so one running sum answers them all.
    """
    marks = asked.select("pitcher", "day").distinct().withColumn("pitch_type", F.explode(F.array(*map(F.lit, types))))
    state = state_of(days)
    rows = days.select("pitcher", "pitch_type", F.col("game_date").alias("day"), F.lit(0).alias("mark"), *state)
    rows = rows.unionByName(marks.select("pitcher", "pitch_type", "day", F.lit(1).alias("mark")), allowMissingColumns=True)
    over = Window.partitionBy("pitcher", "pitch_type").orderBy("day", "mark").rowsBetween(Window.unboundedPreceding, 0)  # a row per day
    totals = rows.select("pitcher", "pitch_type", "day", "mark", *[F.sum(c).over(over).alias(c) for c in state])
    return totals.where("mark = 1").drop("mark").na.fill(0, state)


def window_sums(days: DataFrame, windows: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """window, pitch_type and the sums of daily rows over each window (window, pitcher, start_date, end_date); types without
    a pitch in it are left out."""
    before = F.date_sub("start_date", 1)
    ends = windows.where("start_date <= end_date").select("window", "pitcher", F.col("end_date").alias("day"), before.alias("before"))
    asked = ends.select("pitcher", "day").unionByName(ends.select("pitcher", F.col("before").alias("day")))
    totals, state = as_of(days, asked, types), state_of(days)
    both = F.array(F.struct(F.col("day").alias("day"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("day"), F.lit(-1).alias("sign")))
    signed = ends.select("window", "pitcher", F.explode(both).alias("e")).select("window", "pitcher", "e.day", "e.sign")
    sums = signed.join(totals, ["pitcher", "day"]).groupBy("window", "pitch_type").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in state])  # two rows each
    return sums.where(F.col(state[0]) > 0)


def window_counts(sums: DataFrame) -> DataFrame:
    """Per window its pitches and the clean ones among them."""
    clean_ones = F.when(F.col("pitch_type") != REST, F.col("count")).otherwise(0)
    return sums.groupBy("window").agg(F.sum("count").alias("n_rows"), F.sum(clean_ones).alias("n_clean"))


def window_arsenal(sums: DataFrame) -> DataFrame:
    """The arsenal of every window."""
    groups = sums.where(F.col("pitch_type") != REST).select("window", "pitch_type", "count", "rv", *[(F.col(a) / F.nullif(F.col(f"n_{a}"), F.lit(0))).alias(a) for a in arsenal.AVERAGES])
    return arsenal.shown(arsenal.with_total(groups, "window"), "window")


# Samples


_LEFT, _RIGHT = "shiftright({start} + shiftleft(1L, k) - 1, k)", "shiftright({end} + 1, k)"
_BLOCKS = f"""CASE WHEN {{start}} <= {{end}} THEN filter(flatten(transform(sequence(0, {LEVELS - 1}), k -> array(
  CASE WHEN {_LEFT} < {_RIGHT} AND {_LEFT} % 2 = 1 THEN named_struct('level', k, 'block', {_LEFT}) END,
  CASE WHEN {_LEFT} < {_RIGHT} AND {_RIGHT} % 2 = 1 THEN named_struct('level', k, 'block', {_RIGHT} - 1) END))), b -> b IS NOT NULL) END"""


def day_number(day: str) -> str:
    """SQL of the days from 0001-01-01 to a date."""
    return f"CAST(datediff({day}, DATE '0001-01-01') AS BIGINT)"


def blocks(start: str, end: str) -> Column:
    """The fewest dyadic blocks that make up the days from start to end (columns): an array of (level, block), at most two a
    level."""
    return F.expr(_BLOCKS.format(start=day_number(start), end=day_number(end)))


def days_of(block: str) -> Column:
    """The days of a block (level, block), as an array."""
    at = lambda n: f"date_add(DATE '0001-01-01', CAST(shiftleft({block}.block + {n}, {block}.level) - {n} AS INT))"
    return F.expr(f"sequence({at(0)}, {at(1)})")


def cut_windows(pitches: DataFrame, windows: DataFrame) -> DataFrame:
    """window, pitcher, b: the blocks (level, block) of each window's days between the pitcher's first and last pitch."""
    known = pitches.groupBy("pitcher").agg(F.min("game_date").alias("_first"), F.max("game_date").alias("_last"))
    inside = windows.join(known, "pitcher").select("window", "pitcher", F.greatest("start_date", "_first").alias("_from"), F.least("end_date", "_last").alias("_to"))
    return inside.select("window", "pitcher", F.explode(blocks("_from", "_to")).alias("b"))


def placed(pitches: DataFrame, used: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """pitcher, b, row: each pitch once for every used block (pitcher, b) that its day lies in.

    A pitcher's blocks are at most the days between the first and last pitch, once per block size.
    """
    row = F.struct(F.expr(charts.SAMPLE_ORDER).alias("_o"), *charts.KEY, *[c for c in columns if c not in charts.KEY]).alias("row")
    calendar = used.select("pitcher", "b", F.explode(days_of("b")).alias("game_date"))
    return pitches.select("pitcher", "game_date", row).join(calendar, ["pitcher", "game_date"]).drop("game_date")


def window_samples(pitches: DataFrame, windows: DataFrame, columns: tuple[str, ...], most: int = MAX_LOCATIONS) -> DataFrame:
    """window and columns of the first so many pitches of each window in the fixed order.

    pitches: those to be sampled.  Only days of pitchers that some window asks for are joined, each pitch with as many blocks
    as the windows use of those that its day lies in.
    """
    cut = materialise(cut_windows(pitches, windows), "blocks")  # some two dozen rows a window
    inside = placed(pitches, cut.select("pitcher", "b").distinct(), columns)
    order = [F.col(f"row.{c}") for c in ("_o", *charts.KEY)]
    salt = F.pmod(F.col("row.game_pk"), F.lit(charts.SALTS))
    first = lambda frame, *keys: frame.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")
    kept = first(first(inside.withColumn("_salt", salt), "pitcher", "b", "_salt"), "pitcher", "b")
    found = first(cut.join(kept.select("pitcher", "b", "row"), ["pitcher", "b"]), "window")
    return found.select("window", *[F.col(f"row.{c}").alias(c) for c in columns])
