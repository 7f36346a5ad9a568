"""Centroid clustering: exact k-means over integer vectors by Shallot search.

A vector's components become whole numbers, floor(1024 * x), and all that decides an assignment is compared in integers.
Between rounds each vector remembers its centroid, the second-nearest one, an upper bound of its distance to the first and
a lower bound of that to all others.  When centroids have moved, bounds move with them; where they still part the first
from the rest, nothing is computed.  Elsewhere the scan starts from the closer of the two remembered centroids and visits
its neighbours by distance, until one lies further from it than the start's distance plus the second-least distance found
so far: that ball shrinks as nearer centroids turn up, and no centroid outside it can matter.

Vectors are packed into slices of some thousand, in a bucketed table in the shared folder.  A round is one pass: slices
meet their bounds by an equi-join (the small bounds move, the vectors do not, as they are bucketed by slice), and return new
bounds and the sums of each centroid.  Sums are added up in Spark; the driver sees k x dimension numbers a round.  Every
round's bounds are a written table, so a lost executor repeats tasks of one round only.

Whole numbers below 2^27 (|x| under 131,072) are 64-bit arithmetic, larger ones Python's own integers, slower and exact too;
a distance or sum of distances that does not fit a long is null.

Defined cases: vectors that are null, of another length, or with a null or non-finite component are left out; a null id is
hashed as an empty text; of equal hashes the smaller vector comes first; repeated rows are vectors of their own; fewer
vectors than k make fewer centroids; an empty table gives no rows; of the input's columns only id and vector are read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from moundworks.llm.common import discard, materialise, shared_dir, source_table

K, ROUNDS, DIMENSION, SCALE, SEED = 8, 10, 64, 1024, 3
SLICE = 4096  # vectors
FAST = 1 << 27  # components below this are 64-bit arithmetic: squares of differences, 64 of them, stay below 2 ** 63
LIMB = 30  # sums cross the network in parts of so many bits
SLOP = 1e-9  # relative; what a bound may be off by, a million times what rounding makes of it
BOUNDS = "slice long, own binary, second binary, upper binary, lower binary, moved long, sums binary, members binary"
PACKED = "slice long, ids array<long>, kind string, vectors binary"


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly, for any finite x."""
    top, bottom = float(x).as_integer_ratio()
    return top * scale // bottom


def kept_vectors(rows: DataFrame, vector: str, dimension: int) -> DataFrame:
    """Rows whose vector has so many components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == dimension)).where(finite)


def numbers(values: np.ndarray) -> np.ndarray:
    """Components as whole numbers: int64 where all are below FAST, else Python's integers."""
    scaled = np.floor(values * SCALE)
    if not len(values) or np.abs(scaled).max() < FAST:
        return scaled.astype(np.int64)
    return np.array([[whole(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def stored(vectors: np.ndarray) -> tuple[str, bytes]:
    """Numbers as bytes in the narrowest form that holds them, and its name."""
    if vectors.dtype == object:
        return "text", ",".join(map(str, vectors.ravel())).encode()
    most = int(np.abs(vectors).max()) if vectors.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4"
    return kind, vectors.astype(kind).tobytes()


def restored(kind: str, data: bytes, n: int) -> np.ndarray:
    if kind == "text":
        return np.array([int(x) for x in data.split(b",")], object).reshape(n, -1)
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, -1)


def packed(rows: DataFrame, identity: str, vector: str, dimension: int, size: int) -> DataFrame:
    """The slices (``PACKED``) of kept vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                kind, data = stored(numbers(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, dimension)))
                ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array([number]), ids, pa.array([kind]), pa.array([data], pa.binary())], ["slice", "ids", "kind", "vectors"])
                number += 1

    narrow = kept_vectors(rows.select(F.col(identity).cast("long").alias("id"), F.col(vector).alias("vector")), "vector", dimension)
    return narrow.mapInArrow(run, PACKED)


def first_centroids(rows: DataFrame, identity: str, vector: str, dimension: int, k: int, seed: int) -> np.ndarray:
    """The k kept vectors with the smallest hashes of seed and id."""
    narrow = kept_vectors(rows.select(F.col(identity).cast("string").alias("id"), F.col(vector).alias("vector")), "vector", dimension)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("id", F.lit(""))), 256)
    first = narrow.select(digest.alias("digest"), "vector").orderBy("digest", "vector").limit(k).collect()  # k rows
    return centroids([[whole(x) for x in r["vector"]] for r in first], dimension)


def centroids(values: list[list[int]], dimension: int) -> np.ndarray:
    small = all(abs(x) < FAST for row in values for x in row)
    return np.array(values, np.int64 if small else object).reshape(len(values), dimension)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    if x.dtype == object or c.dtype == object:
        x, c = x.astype(object), c.astype(object)
    d = x - c
    return (d * d).sum(axis=-1)


VAST = 2.0**500  # distances from here on are infinite as upper bounds and this as lower ones


def at_least(x: np.ndarray) -> np.ndarray:
    """Lower bounds of square roots."""
    return np.minimum(roots(x), VAST) * (1 - SLOP)


def roots(x: np.ndarray) -> np.ndarray:
    return np.array([math.sqrt(v) if v < 1 << 1000 else math.inf for v in x.ravel()]).reshape(x.shape) if x.dtype == object else np.sqrt(x.astype(float))


@dataclass
class Centres:
    """What a round's tasks know of the centroids: the numbers, each one's neighbours in order, how far each has moved."""

    values: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        apart = at_least(np.array([[int(squared(a, b)) for b in self.values] for a in self.values], object).reshape(len(self.values), -1))
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.near = np.array([[i, *[j for j in row if j != i]] for i, row in enumerate(self.near)]).reshape(apart.shape)  # itself first
        self.apart = np.take_along_axis(apart, self.near, axis=1)
        self.half = self.apart[:, 1] / 2 if len(self.values) > 1 else np.full(len(self.values), np.inf)
        order = np.sort(self.moved)
        self.most, self.next = (order[-1], order[-2] if len(order) > 1 else 0.0) if len(order) else (0.0, 0.0)

    def others_moved(self, own: np.ndarray) -> np.ndarray:
        """The furthest that any centroid but each vector's own has moved."""
        top = self.moved == self.most
        return np.where(top[own] & (top.sum() == 1), self.next, self.most)


def search(x: np.ndarray, centres: Centres, bounds: tuple[np.ndarray, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """own, second, upper, lower of vectors, given those of the round before (none: every vector is searched for)."""
    n, k = len(x), len(centres.values)
    if bounds is None:
        own, second, upper, lower = np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32), np.full(n, np.inf), np.zeros(n)
        open_ = np.arange(n)
    else:
        own, second = bounds[0].copy(), bounds[1].copy()
        upper = (bounds[2] + centres.moved[own]) * (1 + SLOP)
        lower = (bounds[3] - centres.others_moved(own)) * (1 - SLOP) - SLOP
        clear = np.fmax(lower, centres.half[own])
        open_ = np.flatnonzero(~(upper < clear))
        exact = roots(squared(x[open_], centres.values[own[open_]])) * (1 + SLOP)
        upper[open_] = exact
        open_ = open_[~(exact < clear[open_])]
    if k == 1:
        lower[:] = np.inf
        return own, second, np.zeros(n), lower
    if len(open_):
        v = x[open_]
        a, b = own[open_].astype(np.int64), second[open_].astype(np.int64)
        da, db = squared(v, centres.values[a]), squared(v, centres.values[b])
        closer = (db < da) | ((db == da) & (b < a))
        best, best_d, other, other_d = (np.where(closer, p, q) for p, q in ((b, a), (db, da), (a, b), (da, db)))
        start, start_r = best.copy(), roots(best_d)
        live = np.arange(len(open_))
        for step in range(1, k):
            ball = (start_r[live] + roots(other_d[live])) * (1 + SLOP) + SLOP
            live = live[centres.apart[start[live], step] <= ball]
            if not len(live):
                break
            c = centres.near[start[live], step]
            new = (c != best[live]) & (c != other[live]) & (c != a[live]) & (c != b[live])
            rows, c = live[new], c[new]
            d = squared(v[rows], centres.values[c])
            first = (d < best_d[rows]) | ((d == best_d[rows]) & (c < best[rows]))
            then = ~first & ((d < other_d[rows]) | ((d == other_d[rows]) & (c < other[rows])))
            up = rows[first]
            other[up], other_d[up] = best[up], best_d[up]
            best[up], best_d[up] = c[first], d[first]
            other[rows[then]], other_d[rows[then]] = c[then], d[then]
        own[open_], second[open_] = best, other
        upper[open_], lower[open_] = roots(best_d) * (1 + SLOP), at_least(other_d)
    return own, second, upper, lower


def sums(x: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per centroid the componentwise sum and the number of its vectors."""
    members = np.bincount(own, minlength=k)
    if x.dtype == object:
        return np.array([x[own == c].sum(axis=0) if members[c] else [0] * x.shape[1] for c in range(k)], object).reshape(k, -1), members
    order = np.argsort(own, kind="stable")
    total = np.concatenate([np.zeros((1, x.shape[1]), np.int64), np.cumsum(x[order], axis=0)])
    ends = np.cumsum(members)
    return total[ends] - total[ends - members], members


def limbs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """Numbers as (place, limb, part): their value is the sum of part * 2 ** (LIMB * limb)."""
    out = []
    for place, value in enumerate(values.ravel().tolist()):
        sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
        while rest:
            out.append((place, limb, sign * (rest & ((1 << LIMB) - 1))))
            rest >>= LIMB
            limb += 1
    return out


def one_round(slices: DataFrame, before: DataFrame | None, centres: Centres) -> DataFrame:
    """New bounds of every slice, with its sums (as ``limbs``), members and how many of its vectors changed centroid."""
    k = len(centres.values)
    rows = slices.select("slice", F.size("ids").alias("n"), "kind", "vectors")
    rows = rows.join(before.select("slice", "own", "second", "upper", "lower"), "slice") if before is not None else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = restored(r["kind"], r["vectors"], r["n"])
                last = None if "own" not in r else (np.frombuffer(r["own"], np.int32), np.frombuffer(r["second"], np.int32), np.frombuffer(r["upper"], float), np.frombuffer(r["lower"], float))
                found = search(x, centres, last)
                total, members = sums(x, found[0], k)
                moved = r["n"] if last is None else int((found[0] != last[0]).sum())
                columns = [[v.astype(t).tobytes()] for v, t in zip(found, (np.int32, np.int32, float, float), strict=True)]
                made = [[r["slice"]], *columns, [moved], [np.array(limbs(total), np.int64).tobytes()], [members.astype(np.int64).tobytes()]]
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, made, strict=True)), schema=schema)

    schema = pa.schema([("slice", pa.int64()), *[(c, pa.binary()) for c in ("own", "second", "upper", "lower")], ("moved", pa.int64()), ("sums", pa.binary()), ("members", pa.binary())])
    return rows.mapInArrow(run, BOUNDS)


def added(rounds: DataFrame, k: int, dimension: int) -> tuple[list[list[int]], list[int]]:
    """The sums and members of all slices: added up in Spark, k x dimension numbers (and their limbs) come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(s, np.int64).reshape(-1, 3) for s in batch.column(0).to_pylist()]
            members = np.sum([np.frombuffer(m, np.int64) for m in batch.column(1).to_pylist()], axis=0) if batch.num_rows else np.zeros(k, np.int64)
            every = np.concatenate([*parts, np.stack([np.arange(k), np.full(k, -1), members], axis=1)])
            yield pa.RecordBatch.from_arrays([pa.array(every[:, c]) for c in range(3)], ["place", "limb", "part"])

    rows = rounds.select("sums", "members").mapInArrow(run, "place long, limb long, part long")
    found = rows.groupBy("place", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).collect()
    values, members = [0] * (k * dimension), [0] * k
    for r in found:
        if r["limb"] < 0:
            members[r["place"]] = int(r["part"])
        else:
            values[r["place"]] += int(r["part"]) << (LIMB * r["limb"])
    return [values[c * dimension : (c + 1) * dimension] for c in range(k)], members


def cluster(rows: DataFrame, identity: str = "vec_id", vector: str = "embedding", dimension: int = DIMENSION, k: int = K, rounds: int = ROUNDS, seed: int = SEED, size: int = SLICE) -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector after so many rounds and a last
    assignment.  Rounds in which no centroid moves would not change a thing and are left out."""
    spark = rows.sparkSession
    now = first_centroids(rows, identity, vector, dimension, k, seed)
    if not len(now):
        return spark.createDataFrame([], "id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(now)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table, folder = f"slices_{uuid.uuid4().hex}", shared_dir(spark, "clustering")
    packed(rows, identity, vector, dimension, size).repartition(parts, "slice").write.option("path", f"{folder}/slices").bucketBy(parts, "slice").saveAsTable(table, format="parquet")
    slices, last, centres = spark.table(table), None, Centres(now, np.zeros(k))
    for _ in range(rounds):
        last = materialise(one_round(slices, last, centres), "bounds", folder)
        total, members = added(last, k, dimension)
        new = centroids([[t // m for t in row] if m else list(map(int, old)) for row, m, old in zip(total, members, now, strict=True)], dimension)
        centres = Centres(new, roots(squared(new, now)) * (1 + SLOP))
        still, now = np.array_equal(new, now), new
        if still:
            break
    last = materialise(one_round(slices, last, centres), "bounds", folder)
    each = materialise(assigned(slices, last, now), "assigned")
    spark.sql(f"DROP TABLE {table}")
    discard(spark, folder)
    big, fits = "decimal(38,0)", lambda c: F.col(c).try_cast("long")
    own = each.groupBy("cluster").agg(F.sum(F.col("distance").cast(big)).alias("own"), F.count("*").alias("n"), F.count("distance").alias("known"))  # k rows
    own = own.withColumn("own", F.when(F.col("n") == F.col("known"), F.col("own")))
    every = W.partitionBy()
    own = own.withColumn("all", F.when(F.count("own").over(every) == F.count("*").over(every), F.sum("own").over(every)))
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in now.tolist()]
    digests = spark.createDataFrame(list(enumerate(names)), "cluster int, centroid_sha256 string")  # k rows
    known = own.join(digests, "cluster").select("cluster", fits("own").alias("cluster_inertia"), fits("all").alias("inertia"), "centroid_sha256")
    return each.join(F.broadcast(known), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assigned(slices: DataFrame, last: DataFrame, now: np.ndarray) -> DataFrame:
    """id, cluster and squared distance (null where it does not fit a long) of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, r in enumerate(batch.select(["kind", "vectors", "own"]).to_pylist()):
                own = np.frombuffer(r["own"], np.int32)
                d = squared(restored(r["kind"], r["vectors"], len(own)), now[own])
                fit = pa.array([v if v < 1 << 63 else None for v in d.tolist()], pa.int64()) if d.dtype == object else pa.array(d)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].values, pa.array(own), fit], ["id", "cluster", "distance"])

    rows = slices.join(last.select("slice", "own"), "slice").select("ids", "kind", "vectors", "own")
    return rows.mapInArrow(run, "id long, cluster int, distance long")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(source_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def _rounds_sql() -> str:
    parts = []
    for r in range(ROUNDS + 1):
        parts.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, arg_min(cluster, distance * 1000 + cluster) AS cluster, min(distance) AS distance FROM (
    SELECT v.vec_id, c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS HUGEINT) AS distance FROM vectors v, centres{r} c)
  GROUP BY vec_id
)""")
        if r < ROUNDS:
            parts.append(f"""centres{r + 1} AS MATERIALIZED (
  SELECT c.cluster, coalesce(n.x, c.x) AS x FROM centres{r} c LEFT JOIN (
    SELECT cluster, list(mean ORDER BY i) AS x FROM (
      SELECT cluster, i, CAST(floor_sum AS BIGINT) AS mean FROM (
        SELECT cluster, i, (sum(value) - ((sum(value) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
        FROM (SELECT n.cluster, UNNEST(v.x) AS value, UNNEST(range(1, {DIMENSION + 1})) AS i FROM vectors v JOIN near{r} n ON v.vec_id = n.vec_id) GROUP BY cluster, i))
    GROUP BY cluster) n ON c.cluster = n.cluster
)""")
    return ", ".join(parts)


OP13_SQL = f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = {DIMENSION} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSION}
), centres0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY digest) - 1 AS INTEGER) AS cluster, x FROM (SELECT sha256('{SEED}:' || vec_id) AS digest, x FROM vectors ORDER BY digest LIMIT {K})
), {_rounds_sql()}
SELECT n.vec_id, n.cluster, CAST(n.distance AS BIGINT) AS distance, CAST(sum(n.distance) OVER (PARTITION BY n.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(n.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM near{ROUNDS} n JOIN centres{ROUNDS} c ON n.cluster = c.cluster
"""
