"""A deterministic pitch world derived from the test tables; one SQL text for Spark and for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.sources.shared import spread

TABLES = ("lineitem", "orders", "customer", "nation")

PITCHES = """
WITH b AS (
  SELECT l.*, o.o_custkey,
    CAST(FLOOR(l_orderkey / 64) AS BIGINT) AS game_pk,
    l_orderkey % 64 AS at_bat_number,
    CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS BIGINT) AS pitch_number,
    (l_partkey * 3 + l_suppkey * 5 + l_linenumber * 7) % 40 AS t,
    (l_partkey * 11 + l_suppkey * 3 + l_linenumber) % 20 AS d,
    CAST(l_quantity AS BIGINT) AS q
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
), c AS (
  SELECT *,
    CASE WHEN d <= 6 THEN 'ball' WHEN d <= 9 THEN 'called_strike' WHEN d <= 11 THEN 'swinging_strike'
         WHEN d <= 14 THEN 'foul' WHEN d = 15 THEN 'blocked_ball' WHEN d = 16 THEN 'foul_tip'
         ELSE 'hit_into_play' END AS description
  FROM b
)
SELECT game_pk, at_bat_number, pitch_number,
  DATE '2021-01-01' + CAST((game_pk * 61) % 1460 AS INT) AS game_date,
  (o_custkey % 30) * (o_custkey % 7) % 150 AS pitcher,
  CASE WHEN (l_suppkey + l_partkey) % 101 = 100 THEN NULL WHEN (l_suppkey + at_bat_number) % 5 < 2 THEN 'L' ELSE 'R' END AS stand,
  CASE WHEN t < 13 THEN 'FF' WHEN t < 19 THEN 'SL' WHEN t < 24 THEN 'SI' WHEN t < 28 THEN 'CH' WHEN t < 31 THEN 'CU'
       WHEN t < 33 THEN 'FC' WHEN t = 33 THEN 'ST' WHEN t = 34 THEN 'FS' WHEN t = 35 THEN 'KC' WHEN t = 36 THEN 'SV'
       WHEN t = 37 THEN 'PO' WHEN t = 38 THEN (CASE WHEN l_partkey % 9 = 0 THEN 'KN' ELSE 'EP' END) ELSE NULL END AS pitch_type,
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE 70 + q / 2e0 + (l_suppkey % 8) / 8e0 END AS release_speed,
  CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE ((l_partkey * 7 + q) % 129 - 64) / 32e0 END AS plate_x,
  CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE ((l_partkey * 5 + q * 3) % 161) / 32e0 END AS plate_z,
  ((l_partkey * 13 + q * 5) % 129 - 64) / 64e0 AS pfx_x,
  ((l_suppkey * 17 + q * 3) % 161 - 60) / 64e0 AS pfx_z,
  CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE ((l_partkey + l_linenumber) % 257 - 128) / 64e0 END AS release_pos_x,
  5 + (l_suppkey % 128) / 64e0 AS release_pos_z,
  CASE WHEN l_partkey % 59 = 0 THEN NULL ELSE 5.5e0 + (l_partkey % 96) / 64e0 END AS release_extension,
  CAST(l_partkey % 4 AS INT) AS balls, CAST(l_suppkey % 3 AS INT) AS strikes,
  CAST(l_linenumber % 3 AS INT) AS outs_when_up, CAST(1 + at_bat_number % 9 AS INT) AS inning,
  CASE WHEN d = 17 THEN (CASE q % 5 WHEN 0 THEN 'double' WHEN 1 THEN 'home_run' WHEN 2 THEN 'triple' ELSE 'single' END)
       WHEN d = 18 THEN (CASE WHEN q % 4 = 0 THEN 'grounded_into_double_play' ELSE 'field_out' END)
       WHEN d = 19 THEN (CASE WHEN q % 3 = 0 THEN 'field_error' ELSE 'force_out' END)
       WHEN description = 'swinging_strike' AND l_suppkey % 3 = 2 THEN (CASE WHEN q % 10 = 0 THEN 'strikeout_double_play' ELSE 'strikeout' END)
       WHEN description IN ('ball', 'blocked_ball') AND l_partkey % 4 = 3 THEN 'walk'
       ELSE NULL END AS events,
  description,
  CASE WHEN d >= 17 AND q % 13 <> 0 THEN 60 + (l_partkey * 3 + q) % 100 / 2e0 ELSE NULL END AS launch_speed
FROM c
"""

PLAYERS = """
SELECT c_custkey AS key_mlbam, LOWER(c_mktsegment) AS name_first, LOWER(n_name) AS name_last,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(2000 + c_custkey * 7 % 25 AS INT) END AS mlb_played_last
FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey < 150
"""

REQUESTS = """
SELECT key_mlbam AS request_id,
  CASE key_mlbam % 6 WHEN 0 THEN name_first || ' ' || name_last
                     WHEN 1 THEN name_first || ' x. ' || name_last
                     WHEN 2 THEN name_last
                     WHEN 3 THEN 'zz ' || name_last
                     WHEN 4 THEN 'no body'
                     ELSE '  ' || UPPER(name_first) || '  ' || UPPER(name_last) || ' ' END AS pitcher_name,
  CASE WHEN key_mlbam % 8 = 5 THEN DATE '2024-11-20' WHEN key_mlbam % 4 = 1 THEN DATE '2022-03-01'
       WHEN key_mlbam % 4 = 3 THEN DATE '1999-01-01' ELSE NULL END AS start_date,
  CASE key_mlbam % 4 WHEN 0 THEN NULL WHEN 1 THEN DATE '2024-11-30' WHEN 2 THEN DATE '2023-06-30' ELSE DATE '1999-12-31' END AS end_date
FROM players
"""

CONTEXTS = """
SELECT p.pitcher, s.batter_stand, b.balls, k.strikes, 1 AS outs, 5 AS inning
FROM (SELECT DISTINCT pitcher FROM pitches) p
CROSS JOIN (VALUES ('L'), ('R'), ('S')) AS s(batter_stand)
CROSS JOIN (VALUES (0), (1), (2), (3)) AS b(balls)
CROSS JOIN (VALUES (0), (1), (2)) AS k(strikes)
"""

PROBABILITIES = """
SELECT pitcher, batter_stand, balls, strikes, code, pitch_type,
  w * 1e0 / SUM(w) OVER (PARTITION BY pitcher, batter_stand, balls, strikes) AS probability
FROM (
  SELECT c.pitcher, c.batter_stand, c.balls, c.strikes, t.code, t.pitch_type,
    CAST((c.balls * 7 + c.strikes * 11 + t.code * t.code * 5 + c.pitcher * 3) % 64 AS BIGINT) + 1 AS w
  FROM contexts c
  CROSS JOIN (VALUES (0, 'CH'), (1, 'CU'), (2, 'EP'), (3, 'FC'), (4, 'FF'), (5, 'FS'), (6, 'KC'),
                     (7, 'KN'), (8, 'PO'), (9, 'SI'), (10, 'SL'), (11, 'ST'), (12, 'SV')) AS t(code, pitch_type)
) z
"""

#: In the order in which each may use those before it.
VIEWS = {"pitches": PITCHES, "players": PLAYERS, "matchup_requests": REQUESTS, "contexts": CONTEXTS, "class_probabilities": PROBABILITIES}
AS_OF = "2024-12-31"
#: A pitch's date follows from its order's key alone, as PITCHES has it.
DATE_OF = "DATE '2021-01-01' + CAST((CAST(FLOOR({key} / 64) AS BIGINT) * 61) % 1460 AS INT)"
YEARS = range(2021, 2025)


def world(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The views as DataFrames over the tables of ``sf_dir``, and pitches_<year>, derived from that year's orders alone, as no
    filter by date gets below the numbering; the orders' join and numbering see a bounded part a task."""
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    keys = {"lineitem": "l_orderkey", "orders": "o_orderkey"}
    tables |= {name: spread(tables[name], key, of=tables["lineitem"]) for name, key in keys.items()}
    made = {}
    for year in YEARS:
        for name, key in keys.items():
            tables[name].where(F.year(F.expr(DATE_OF.format(key=key))) == year).createOrReplaceTempView(name)
        made[f"pitches_{year}"] = spark.sql(PITCHES)
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
    for name, text in VIEWS.items():
        made[name] = spark.sql(text)
        made[name].createOrReplaceTempView(name)
    return made


def of_year(made: dict[str, DataFrame], year: int) -> DataFrame:
    """The year's pitches; of a world that is stored, those of its table."""
    return made.get(f"pitches_{year}", made["pitches"]).where(F.year("game_date") == year)
