"""Column expressions, written as SQL text so that a query and its check share every arithmetic step."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moundworks.functions.constants import PITCH_NAMES, RUN_CENTS, SIM_DEFAULTS, SIM_OTHER, VALID_ARSENAL


def rounded(expression: str, places: int) -> str:
    """Half away from minus infinity on the binary value: floor(x * 10^n + 1/2) / 10^n."""
    return f"(floor(({expression}) * {10**places}e0 + 0.5e0) / {10**places}e0)"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def case(column: str, values: dict, otherwise: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items())
    return f"CASE {column} {arms} ELSE {otherwise} END"


VALID = f"pitch_type IN ({quoted(VALID_ARSENAL)})"
#: The event's weight if it has one, else the description's, else 0; in hundredths.
RUN_VALUE = f"CAST(coalesce({case('events', RUN_CENTS, 'NULL')}, {case('description', RUN_CENTS, 'NULL')}, 0) AS BIGINT)"
PITCH_NAME = case("pitch_type", {k: f"'{v}'" for k, v in PITCH_NAMES.items()}, "pitch_type")
SIM_SPEED = case("pitch_type", {k: f"{v[0]}e0" for k, v in SIM_DEFAULTS.items()}, f"{SIM_OTHER[0]}e0")
SIM_BREAK = case("pitch_type", {k: f"{v[1]}e0" for k, v in SIM_DEFAULTS.items()}, f"{SIM_OTHER[1]}e0")


def finite(column: Column) -> Column:
    """The value, or null if it is NaN or infinite."""
    return F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)


# Kinematics: speed in mph, releases and extension in feet, movement in inches; T is the flight time.
START_Y = "(60.5e0 - {ext})"
SPEED = "({v0} * 1.467e0)"
FLIGHT = f"({START_Y} / ({SPEED} * 0.96e0))"
ACCEL_X = f"(2e0 * (-{{pfx_x}} / 12e0) / ({FLIGHT} * {FLIGHT}))"
ACCEL_Z = f"(-32.174e0 + 2e0 * ({{pfx_z}} / 12e0) / ({FLIGHT} * {FLIGHT}))"

#: Points of a flight that starts at the release and decelerates; t is a time, the height never below 0.05 if under 0.
FREE = {
    "x": "(-{rx} + 0.5e0 * ax * {t} * {t})",
    "y": f"({START_Y} - {SPEED} * {{t}} - 2.5e0 * {{t}} * {{t}})",
    "z": "(CASE WHEN {height} < 0e0 THEN 0.05e0 ELSE {height} END)".replace("{height}", "{rz} - (({rz} - 2.5e0) / flight) * {t} + 0.5e0 * az * {t} * {t}"),
}
#: Launch velocities that bring the last point to the plate location, and the points of that flight.
TO_PLATE_VX = "((-{px} + {rx} - 0.5e0 * ax * flight * flight) / flight)"
TO_PLATE_VZ = "(({pz} - {rz} - 0.5e0 * az * flight * flight) / flight)"
TO_PLATE = {"x": "(-{rx} + vx0 * {t} + 0.5e0 * ax * {t} * {t})", "y": f"({START_Y} - {SPEED} * {{t}})", "z": "({rz} + vz0 * {t} + 0.5e0 * az * {t} * {t})"}

#: Stand-ins for values that are not finite.
INPUT_DEFAULTS = {"release_pos_x": -1.5, "release_pos_z": 6.0, "release_extension": 6.0, "plate_x": 0.0, "plate_z": 2.5, "release_speed": 90.0, "pfx_x": 0.0, "pfx_z": 0.0}
