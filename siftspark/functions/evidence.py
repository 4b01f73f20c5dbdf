"""What names and annotations say about values: kind of fact, its value, and how sure it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of names, the dimension and the unit they say; the first that fits. Fixed values.
NAME_UNITS = (
    ("_ms", "time:1", "ms"),
    ("_millis", "time:1", "ms"),
    ("_s", "time:1", "s"),
    ("_sec", "time:1", "s"),
    ("_seconds", "time:1", "s"),
    ("_deg", "angle:1", "deg"),
    ("_degrees", "angle:1", "deg"),
    ("_rad", "angle:1", "rad"),
    ("_radians", "angle:1", "rad"),
    ("_pct", "", "percent"),
    ("_percent", "", "percent"),
    ("_bits", "data:1", "bits"),
    ("_bytes", "data:1", "bytes"),
    ("_m", "length:1", "m"),
    ("_km", "length:1", "km"),
    ("_cm", "length:1", "cm"),
    ("_mm", "length:1", "mm"),
    ("_kg", "mass:1", "kg"),
    ("_hz", "frequency:1", "hz"),
)
#: Other endings and what they say, in the order in which they are tried. Fixed values.
INSTANTS = ("_at", "_ts", "_time", "_timestamp", "_instant", "_when")
DURATIONS = ("_delay", "_elapsed", "_duration", "_timeout", "_interval")
FRAMES = (("_world", "world"), ("_camera", "camera"), ("_cam", "camera"), ("_local", "local"))
FRACTIONS = ("_ratio", "_fraction", "_alpha", "_opacity", "_probability", "_share")
#: Parts of names, tried after the endings. Fixed values.
LOCAL_WALL = ("local", "wall", "dt_local", "local_time", "wall_time", "site_time")
UTC = ("utc", "_utc", "time_utc", "timestamp_utc", "aware")
TRAILING = ("trailing", "tan_dose_30m", "_30m", "trailing_")
FORWARD_START = ("best_", "_start", "_begin", "window_start")
QUANTITY = ("irradiance", "radiation", "dose", "uv_index", "uvi", "_wm2", "_j_m2", "sed_", "score", "pigment", "uva", "uvb", "vitamin", "erythemal")
QUALITY = ("_complete", "_coverage", "_coverage_fraction", "_valid", "_stale", "_version", "_confidence", "_source")
#: How sure the two kinds of evidence are; fixed values.
RANKS = {"annotation": 1.00, "name": 0.80}


def _any(test, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (test(w) for w in words))


def name_evidence(name: Column) -> Column:
    """STRUCT of facet, value, dimension, provenance and confidence; null where the name is silent."""
    low = F.lower(name)
    ends, has, starts = (lambda w: F.endswith(low, F.lit(w))), (lambda w: F.contains(low, F.lit(w))), (lambda w: F.startswith(low, F.lit(w)))
    fact = lambda facet, value, dimension="": F.struct(F.lit(facet).alias("facet"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(dimension).alias("dimension"))
    stem = F.element_at(F.split(F.regexp_replace(low, "_id$", ""), "_"), -1)
    rules = [(ends(s), fact("unit", unit, dimension)) for s, dimension, unit in NAME_UNITS]
    rules += [(_any(ends, INSTANTS), fact("nominal", "instant")), (_any(ends, DURATIONS), fact("nominal", "duration")), (ends("_id") & (stem != "") & (stem != "id"), fact("nominal", stem))]
    rules += [(ends(s), fact("frame", f)) for s, f in FRAMES]
    rules += [(_any(ends, FRACTIONS), fact("unit", "fraction")), (_any(has, LOCAL_WALL), fact("time_basis", "local_wall")), (_any(has, UTC), fact("time_basis", "utc")), (_any(has, TRAILING), fact("interval_alignment", "trailing"))]
    rules += [(_any(starts, FORWARD_START) | _any(ends, tuple(w.strip("_") for w in FORWARD_START)), fact("interval_alignment", "leading")), (_any(has, QUANTITY), fact("missingness", "unknown"))]
    found = reduce(lambda c, r: c.when(*r), rules[1:], F.when(*rules[0]))
    return F.when(found.isNotNull(), F.struct(found["facet"].alias("facet"), found["value"].alias("value"), found["dimension"].alias("dimension"), F.concat(F.lit("name:"), name).alias("provenance"), F.lit(RANKS["name"]).alias("confidence")))


def annotation_evidence(annotation: Column) -> Column:
    """STRUCT like name_evidence()'s, with the shape of an array annotation as value; null where the annotation is silent."""
    text = F.element_at(F.split(F.split_part(F.trim(annotation), F.lit("["), F.lit(1)), r"\."), -1)
    inner = F.regexp_replace(F.trim(annotation), r"^(['\"])(.*)\1$", "$2")
    shape = F.regexp_extract(inner, r'^\s*(?:Float|Int|Bool|Complex|Array)\s*\[\s*\w+\s*,\s*"([^"]+)"\s*\]\s*$', 1)
    dims = F.array_join(F.filter(F.split(shape, r"\s+"), lambda x: x != ""), " ")
    fact = lambda facet, value, dimension="": F.struct(F.lit(facet).alias("facet"), (value if isinstance(value, Column) else F.lit(value)).alias("value"), F.lit(dimension).alias("dimension"))
    found = F.when(text == "timedelta", fact("nominal", "duration", "time:1")).when(text.isin("datetime", "date"), fact("nominal", "instant")).when(text == "bytes", fact("encoding", "bytes")).when(text == "str", fact("encoding", "utf8")).when(dims != "", fact("shape", dims))
    return F.when(found.isNotNull(), F.struct(found["facet"].alias("facet"), found["value"].alias("value"), found["dimension"].alias("dimension"), F.concat(F.lit("annotation:"), annotation).alias("provenance"), F.lit(RANKS["annotation"]).alias("confidence")))


def quality_base(name: Column) -> Column:
    """The quantity whose quality a name tells of; null for other names."""
    low = F.lower(name)
    return F.coalesce(*(F.when(F.endswith(low, F.lit(s)) & (F.length(name) > len(s)), F.substring(name, F.lit(1), F.length(name) - len(s))) for s in QUALITY))
