"""Expressions on frequency strings, task names and start times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Calendar anchors that are dropped, prediction lengths by unit, for the
# M4 competition's datasets and for all others, seasons by unit, task horizons, and
# the keys of datasets whose names differ from them.
ANCHORS = {"W-SUN": "W", "Q-DEC": "Q", "A-DEC": "A", "Y": "A"}
LENGTHS = {"M": 12, "W": 8, "D": 30, "H": 48, "T": 48, "S": 60}
M4_LENGTHS = {"A": 6, "Q": 8, "M": 18, "W": 13, "D": 14, "H": 48}
SEASONS = {"S": 3600, "T": 1440, "H": 24, "D": 1, "W": 1, "M": 12, "Q": 4, "B": 5, "A": 1}
HORIZONS = {"short": 1, "medium": 10, "long": 15}
TEST_SHARE, MOST_WINDOWS = 0.1, 20
KEYS = {"saugeenday": "saugeen", "temperature_rain_with_missing": "temperature_rain", "kdd_cup_2018_with_missing": "kdd_cup_2018", "car_parts_with_missing": "car_parts"}
_UNITS = {"S": "SECOND", "T": "MINUTE", "H": "HOUR", "D": "DAY", "B": "DAY", "W": "WEEK", "M": "MONTH", "Q": "QUARTER", "A": "YEAR"}


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def normal_frequency(freq: Column) -> Column:
    """The frequency without its default anchor."""
    return F.coalesce(_lookup(ANCHORS, freq), freq)


def unit(freq: Column) -> Column:
    """The unit of a frequency: its letter without multiple and anchor, pandas' newer names mapped to one letter."""
    letters = F.upper(F.regexp_extract(freq, r"^\d*([A-Za-z]+)", 1))
    newer = {"MIN": "T", "ME": "M", "MS": "M", "QE": "Q", "QS": "Q", "YE": "A", "YS": "A", "Y": "A", "AS": "A"}
    return F.coalesce(_lookup(newer, letters), letters)


def multiple(freq: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(freq, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(1))


def season(freq: Column) -> Column:
    """Observations in a season: the unit's, divided by the multiple where that is whole, else 1."""
    base, m = _lookup(SEASONS, unit(freq)), multiple(freq)
    return F.when(base % m == 0, (base / m).cast("int")).otherwise(F.lit(1))


def is_m4(name: Column) -> Column:
    return F.contains(name, F.lit("m4"))


def prediction_length(name: Column, freq: Column, term: Column) -> Column:
    u = unit(freq)
    return F.when(is_m4(name), _lookup(M4_LENGTHS, u)).otherwise(_lookup(LENGTHS, u)) * _lookup(HORIZONS, term)


def window_count(name: Column, shortest: Column, length: Column) -> Column:
    """Test windows of a task: a tenth of the shortest series, 1 to MOST_WINDOWS; 1 for M4."""
    by_length = F.least(F.greatest(F.ceil(F.lit(TEST_SHARE) * shortest / length), F.lit(1)), F.lit(MOST_WINDOWS)).cast("int")
    return F.when(is_m4(name), F.lit(1)).otherwise(by_length)


def dataset_key(name: Column) -> Column:
    """The key of a dataset's pretty name."""
    return F.coalesce(_lookup(KEYS, F.lower(name)), F.lower(name))


def task_name(key: Column, freq: Column, term: Column) -> Column:
    return F.concat_ws("/", dataset_key(key), freq, term)


def horizon_of(task: Column) -> Column:
    parts = F.split(task, "/")
    return F.when(F.size(parts) < 2, F.lit("unknown")).otherwise(F.element_at(parts, -1))


def file_stem(task: Column) -> Column:
    return F.replace(task, F.lit("/"), F.lit("-"))


def later(start: Column, freq: Column, n: Column) -> Column:
    """``start`` moved on by n observations."""
    u, steps = unit(freq), n * multiple(freq)
    out = F.lit(None).cast("timestamp")
    for letter, name in _UNITS.items():
        out = F.when(u == letter, F.timestamp_add(name, steps, start)).otherwise(out)
    return out
