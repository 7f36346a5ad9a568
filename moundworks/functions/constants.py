"""Codes, weights and defaults that results must agree with."""

VALID_ARSENAL = ("FF", "SL", "CH", "CU", "SI", "FC", "ST", "SV", "FS", "KC", "KN", "EP")

#: Run value of an outcome in hundredths of a run, so that sums are exact in any order.
RUN_CENTS = {
    "ball": 6, "blocked_ball": 6, "called_strike": -6, "swinging_strike": -12, "foul": -4, "hit_into_play": 0,
    "single": 48, "double": 77, "triple": 105, "home_run": 140, "walk": 32, "hit_by_pitch": 34,
    "strikeout": -27, "field_out": -27, "force_out": -27, "grounded_into_double_play": -45,
}

PITCH_NAMES = {
    "FF": "4-Seam Fastball", "SI": "Sinker", "SL": "Slider", "ST": "Sweeper", "CH": "Changeup", "CU": "Curveball",
    "FS": "Splitter", "FC": "Cutter", "KN": "Knuckleball", "SV": "Slurve", "KC": "Knuckle Curve", "EP": "Ephus",
}

#: Release speed and vertical break (inches) of a simulated pitch.
SIM_DEFAULTS = {"FF": (94.0, 10.0), "SL": (85.0, -5.0), "CU": (78.0, -10.0), "CH": (84.0, 8.0)}
SIM_OTHER = (90.0, 5.0)

WHIFFS = ("swinging_strike", "swinging_strike_blocked")
SWINGS = (*WHIFFS, "foul", "foul_tip", "hit_into_play")
STRIKEOUTS = ("strikeout", "strikeout_double_play")
HARD_HIT = 95.0

MIN_PITCHES, MIN_PER_TYPE, MAX_LOCATIONS = 10, 5, 1000
CLEAN_COLUMNS = ("release_speed", "pfx_x", "pfx_z", "plate_x", "plate_z")
FEATURES = ("release_speed", "plate_x", "plate_z", "balls", "strikes", "stand_code")
SEQUENCE, TRAINING_LIMIT, TRAINING_FLOOR = 5, 200_000, "2022-01-01"
TOP_K, MIN_PROBABILITY = 5, 0.01
