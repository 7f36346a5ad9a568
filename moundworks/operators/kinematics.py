"""Ball flights: arrays of points per row, from column expressions and a batch's matrix, exploded only on demand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moundworks.functions import expressions as E
from moundworks.functions.expressions import finite

STEPS = 40
NAMES = {"v0": "release_speed", "rx": "release_pos_x", "rz": "release_pos_z", "ext": "release_extension", "pfx_x": "pfx_x", "pfx_z": "pfx_z", "px": "plate_x", "pz": "plate_z"}


def flight_params(rows: DataFrame) -> DataFrame:
    """flight (time), ax and az of each row; movement in inches."""
    return rows.withColumns({"flight": F.expr(E.FLIGHT.format(**NAMES)), "ax": F.expr(E.ACCEL_X.format(**NAMES)), "az": F.expr(E.ACCEL_Z.format(**NAMES))})


#: Terms of a flight by axis: start + first * t + second * t * t, in the order in which expressions.FREE and TO_PLATE add them.
FREE_TERMS = {"x": ("-{rx}", None, "0.5e0 * ax"), "y": (E.START_Y, f"-{E.SPEED}", "-2.5e0"), "z": ("{rz}", "-(({rz} - 2.5e0) / flight)", "0.5e0 * az")}
TO_PLATE_TERMS = {"x": ("-{rx}", "vx0", "0.5e0 * ax"), "y": (E.START_Y, f"-{E.SPEED}", None), "z": ("{rz}", "vz0", "0.5e0 * az")}


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's numbers, one to a row of a matrix, and which of them are null."""
    return column.fill_null(0.0).to_numpy(zero_copy_only=False)[:, None], column.is_null().to_numpy(zero_copy_only=False)


def _points(terms: dict[str, tuple[str, str | None, str | None]], steps: int, ground: float | None = None) -> Column:
    """The points of a flight at equal steps; heights under 0 become ``ground``.

    Spark works the terms out once a row, and a batch of rows is one matrix of rows and times in numpy.  Sums are taken in the order
    of the SQL, so numbers are the same to the last bit.
    """
    there = [(axis, k) for axis, of in terms.items() for k, term in enumerate(of) if term is not None]

    @F.arrow_udf("array<struct<i: int, x: double, y: double, z: double>>")
    def points(flight: pa.Array, *columns: pa.Array) -> pa.Array:
        time, missing = _values(flight)
        t, n = np.arange(steps + 1) / float(steps) * time, len(flight)
        values, nulls = {}, {axis: missing for axis in terms}
        with np.errstate(all="ignore"):
            for (axis, k), column in zip(there, columns, strict=True):
                term, null = _values(column)
                added = np.broadcast_to(term, t.shape) if k == 0 else term * t if k == 1 else term * t * t
                values[axis], nulls[axis] = (values[axis] + added if axis in values else added), nulls[axis] | null
            if ground is not None:
                values["z"] = np.where(values["z"] < 0, ground, values["z"])
        axes = [pa.array(values[axis].ravel(), mask=np.repeat(nulls[axis], steps + 1)) for axis in "xyz"]
        number = pa.array(np.tile(np.arange(steps + 1, dtype=np.int32), n))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (steps + 1)), pa.StructArray.from_arrays([number, *axes], ["i", "x", "y", "z"]))

    return points("flight", *[F.expr(f"CAST({terms[axis][k].format(**NAMES)} AS DOUBLE)") for axis, k in there])


def trajectory(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """points: the flight in equal time steps, decelerating, never under the ground."""
    return flight_params(rows).withColumn("points", _points(FREE_TERMS, steps, ground=0.05))


def trajectory_to_plate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """points: the flight whose launch velocity brings the last point to the plate location."""
    solved = flight_params(rows).withColumns({"vx0": F.expr(E.TO_PLATE_VX.format(**NAMES)), "vz0": F.expr(E.TO_PLATE_VZ.format(**NAMES))})
    return solved.withColumn("points", _points(TO_PLATE_TERMS, steps))


def trajectory_inputs(rows: DataFrame) -> DataFrame:
    """Inputs that are missing or not finite get their defaults."""
    return rows.withColumns({c: F.coalesce(finite(F.col(c)), F.lit(d)) for c, d in E.INPUT_DEFAULTS.items()})


def exploded(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, F.explode("points").alias("p")).select(*keys, "p.i", "p.x", "p.y", "p.z")


def plate_crossing(rows: DataFrame, *keys: str) -> DataFrame:
    """The last point; drawn_x is mirrored."""
    last = F.element_at("points", -1)
    return rows.select(*keys, last["x"].alias("x"), last["y"].alias("y"), last["z"].alias("z"), (-last["x"]).alias("drawn_x"))


def sim_defaults(requests: DataFrame) -> DataFrame:
    """Speed and break that a simulated pitch of a type has."""
    return requests.withColumns({"release_speed": F.expr(E.SIM_SPEED), "pfx_z": F.expr(E.SIM_BREAK)})


def simulate(requests: DataFrame, steps: int = STEPS) -> DataFrame:
    fixed = {"release_pos_x": -2.0, "release_pos_z": 6.0, "pfx_x": -5.0, "release_extension": 6.0}
    return trajectory(sim_defaults(requests).withColumns({c: F.lit(v) for c, v in fixed.items()}), steps)
