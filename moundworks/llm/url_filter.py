"""URL filter by a path-template tree.  DataFrame functions only.

Rules decide the urls that they fit; these decisions, and any labels given besides, label the tree.  Digits in a
path become ``{n}``.  Per host the tree then grows by path segment as long as a node's labels disagree:

1. A child with fewer than ``RARE`` pages is a variable segment; all of a node's variable segments are one wildcard
   ``*``.  Others keep their name, however many they are.
2. Children whose share of blocked labels does not differ significantly from their node's merge into one branch
   ``~``, unlabelled ones among them.
3. A branch's purity is its share of blocked labels, smoothed towards its node's.

The same tree grown over all hosts together pools like paths; a path's purity there is what a host's own is smoothed
towards, so a host without labels is judged by what its paths are worth elsewhere.  A url that no rule fits is blocked
if its template's smoothed purity reaches ``PURITY``.

Each level is written to the shared folder, so no level is planned or computed twice.  All work is aggregation and
joins over distinct (host, shape), pre-aggregated before each shuffle; joins on a hot host are split by skew handling,
as nothing above them needs a host's rows together.  Levels end where labels agree or paths end, at any depth.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and follows the tree's
smoothed purity of the empty host; repeated pages are judged alike; urls of any length and depth are taken whole; an
empty table gives no rows; other columns of pages are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moundworks.llm.common import materialise, source_table

#: (verdict, host, path): fits the host and its subdomains if the url's path starts with the rule's.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
RARE = 3  # pages from which a segment is a name of its own
Z2 = 3.84  # squared normal quantile: branches that differ at the 5 % level stay apart
PRIOR = 5.0  # labels that the parent's purity counts for
PURITY = 0.8
_URL = "(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def by_length(rules: tuple) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: -len(r[1] + r[2]))


def fitting(rules: tuple, value: int) -> Column:
    """The longest fitting rule's text (0) or verdict (1), null if none fits."""
    found = F.lit(None).cast("string")
    for verdict, host, path in reversed(by_length(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(fits, F.lit((host + path, verdict)[value])).otherwise(found)
    return found


def parsed(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, decided, and the path's shape."""
    url = F.coalesce("url", F.lit(""))
    rows = pages.select("page_id", F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER).alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))
    return rows.withColumns({"rule": fitting(rules, 0), "decided": fitting(rules, 1), "shape": F.regexp_replace("path", "[0-9]+", "{n}")})


def smoothed(bad: Column, n: Column, prior: Column) -> Column:
    return (bad + prior * PRIOR) / (n + PRIOR)


def grow(leaves: DataFrame) -> DataFrame:
    """host, shape, template and purity of leaves (host, shape, pages, n and bad labels, prior)."""
    node = leaves.groupBy("host").agg(F.sum("n").alias("nn"), F.sum("bad").alias("nb"), F.max(F.size(F.split("shape", "/"))).alias("deep"))
    state = leaves.join(node, "host").withColumns({"template": F.col("host"), "purity": smoothed(F.col("nb"), F.col("nn"), F.col("prior")), "segments": F.split("shape", "/")})
    state, level, keys = materialise(state.drop("prior"), "leaves"), 0, ["host", "template"]
    mixed = (F.col("nb") > 0) & (F.col("nb") < F.col("nn"))
    while not (splits := state.where(mixed & (F.col("deep") > level + 1))).isEmpty():
        level += 1
        own = splits.withColumn("s", F.coalesce(F.get("segments", F.lit(level)), F.lit("")))
        child = own.groupBy(*keys, "s").agg(F.sum("n").alias("cn"), F.sum("bad").alias("cb"), F.max("nn").alias("nn"), F.max("nb").alias("nb"), F.max(F.size("segments")).alias("deep"), F.sum("pages").alias("pages"))
        child = child.withColumn("c", F.when(F.col("pages") < RARE, F.lit("*")).otherwise(F.col("s")))
        branch = child.groupBy(*keys, "c").agg(F.sum("cn").alias("bn"), F.sum("cb").alias("bb"), F.max("nn").alias("nn"), F.max("nb").alias("nb"), F.max("deep").alias("deep"))
        rate, away = F.col("nb") / F.col("nn"), F.col("bb") / F.col("bn") - F.col("nb") / F.col("nn")
        alike = F.when(F.col("bn") > 0, away * away <= F.lit(Z2) * rate * (1 - rate) * (1.0 / F.col("bn") - 1.0 / F.col("nn"))).otherwise(True)
        branch = branch.withColumn("m", F.when(alike, F.lit("~")).otherwise(F.col("c")))
        merged = branch.groupBy(*keys, "m").agg(F.sum("bn").alias("nn"), F.sum("bb").alias("nb"), F.max("deep").alias("deep"))
        named = child.select(*keys, "s", "c").join(branch.select(*keys, "c", "m"), [*keys, "c"]).join(merged, [*keys, "m"]).drop("c")
        grown = own.drop("nn", "nb", "deep").join(named, [*keys, "s"])
        grown = grown.withColumns({"template": F.concat_ws("/", "template", "m"), "purity": smoothed(F.col("nb"), F.col("nn"), F.col("purity"))})
        done = state.where(~mixed | (F.col("deep") <= level))
        state = materialise(grown.select(*state.columns).unionByName(done.withColumn("deep", F.lit(0))), "leaves")
    return state.select("host", "shape", "template", "purity")


def tree(rows: DataFrame) -> DataFrame:
    """host, shape, template, purity and pooled (the path's template over all hosts), from rows with host, shape and label (1
    block, 0 allow, null)."""
    leaves = rows.groupBy("host", "shape").agg(F.count("*").alias("pages"), F.count("label").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    leaves = materialise(leaves, "leaves")
    sums = [F.sum(c).alias(c) for c in ("pages", "n", "bad")]
    whole = leaves.agg(F.coalesce((F.sum("bad") + 1) / (F.sum("n") + 2.0), F.lit(0.5)).alias("prior"))  # one row
    pooled = grow(leaves.groupBy(F.lit("").alias("host"), "shape").agg(*sums).crossJoin(F.broadcast(whole)))
    own = grow(leaves.join(pooled.select("shape", F.col("purity").alias("prior")), "shape"))
    return own.join(pooled.select("shape", F.col("template").alias("pooled")), "shape")


def judge(pages: DataFrame, rules: tuple = RULES, labels: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, template, pooled, purity; labels (page_id, label) add to what rules decide."""
    rows = parsed(pages, rules).withColumn("label", F.when(F.col("decided") == "block", 1).when(F.col("decided") == "allow", 0))
    if labels is not None:
        given = labels.groupBy("page_id").agg(F.max("label").alias("_given"))
        rows = rows.join(given, "page_id", "left").withColumn("label", F.coalesce("label", "_given")).drop("_given")
    found = rows.join(tree(rows), ["host", "shape"])
    verdict = F.coalesce("decided", F.when(F.col("purity") >= PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "pooled", "purity")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(source_table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.withColumn("purity", F.floor(F.col("purity") * 1e6 + 0.5) / 1e6)


#: The contract's rules, longest first, written out apart from RULES.
_SQL_RULES = """CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'block example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'block example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'allow com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'block com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'allow org/'
    END"""
SQL_LEVELS = 6  # levels that the check's tables need at most


def _grow_sql(name: str, leaves: str) -> str:
    """CTEs <name>0 .. that grow the tree of leaves (host, shape, pages, n, bad, prior)."""
    parts = [f"""{name}0 AS (
  SELECT l.host, shape, pages, n, bad, string_split(shape, '/') AS segments, nn, nb, deep, l.host AS template, (nb + prior * {PRIOR}) / (nn + {PRIOR}) AS purity
  FROM {leaves} l JOIN (SELECT host, sum(n) AS nn, sum(bad) AS nb, max(len(string_split(shape, '/'))) AS deep FROM {leaves} GROUP BY host) USING (host)
)"""]
    for k in range(1, SQL_LEVELS + 1):
        parts.append(f"""{name}own{k} AS (
  SELECT *, coalesce(segments[{k + 1}], '') AS s FROM {name}{k - 1} WHERE nb > 0 AND nb < nn AND deep > {k}
), {name}child{k} AS (
  SELECT *, CASE WHEN pages < {RARE} THEN '*' ELSE s END AS c FROM (SELECT host, template, s, sum(n) AS cn, sum(bad) AS cb, max(nn) AS nn, max(nb) AS nb, max(len(segments)) AS deep, sum(pages) AS pages FROM {name}own{k} GROUP BY host, template, s)
), {name}branch{k} AS (
  SELECT *, CASE WHEN bn > 0 AND NOT ((bb / bn - nb / nn) * (bb / bn - nb / nn) <= CAST({Z2} AS DOUBLE) * (nb / nn) * (1 - nb / nn) * (1.0 / bn - 1.0 / nn)) THEN c ELSE '~' END AS m
  FROM (SELECT host, template, c, CAST(sum(cn) AS DOUBLE) AS bn, CAST(sum(cb) AS DOUBLE) AS bb, CAST(max(nn) AS DOUBLE) AS nn, CAST(max(nb) AS DOUBLE) AS nb, max(deep) AS deep FROM {name}child{k} GROUP BY host, template, c)
), {name}merged{k} AS (
  SELECT host, template, m, sum(bn) AS nn, sum(bb) AS nb, max(deep) AS deep FROM {name}branch{k} GROUP BY host, template, m
), {name}{k} AS (
  SELECT o.host, shape, pages, n, bad, segments, g.nn, g.nb, g.deep, concat_ws('/', template, m) AS template, (g.nb + purity * {PRIOR}) / (g.nn + {PRIOR}) AS purity
  FROM {name}own{k} o JOIN (SELECT host, template, s, c FROM {name}child{k}) USING (host, template, s) JOIN (SELECT host, template, c, m FROM {name}branch{k}) USING (host, template, c) JOIN {name}merged{k} g USING (host, template, m)
  UNION ALL SELECT host, shape, pages, n, bad, segments, nn, nb, 0, template, purity FROM {name}{k - 1} WHERE NOT (nb > 0 AND nb < nn) OR deep <= {k}
)""")
    return ",\n".join(parts)


OP2_SQL = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{_URL}', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{_URL}', 2) AS path FROM pages
), rows AS (
  SELECT page_id, host, path, split_part(fit, ' ', 2) AS rule, split_part(fit, ' ', 1) AS decided,
    regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS shape, CASE WHEN fit LIKE 'block %' THEN 1 WHEN fit LIKE 'allow %' THEN 0 END AS label
  FROM (SELECT *, {_SQL_RULES} AS fit FROM split)
), leaves AS (
  SELECT host, shape, count(*) AS pages, count(label) AS n, coalesce(sum(label), 0) AS bad FROM rows GROUP BY host, shape
), every AS (
  SELECT *, (SELECT CAST(sum(bad) + 1 AS DOUBLE) / (sum(n) + 2) FROM leaves) AS prior FROM (SELECT '' AS host, shape, sum(pages) AS pages, sum(n) AS n, sum(bad) AS bad FROM leaves GROUP BY shape)
), {_grow_sql("pool", "every")}, own AS (
  SELECT l.*, p.purity AS prior FROM leaves l JOIN pool{SQL_LEVELS} p USING (shape)
), {_grow_sql("tree", "own")}
SELECT page_id, r.host, path, rule, coalesce(decided, CASE WHEN t.purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, t.template, p.template AS pooled, floor(t.purity * 1e6 + 0.5) / 1e6 AS purity
FROM rows r JOIN tree{SQL_LEVELS} t ON r.host = t.host AND r.shape = t.shape JOIN pool{SQL_LEVELS} p ON r.shape = p.shape
"""
