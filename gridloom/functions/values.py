"""Literals of netlists as Column functions: numbers with factors, times, node and instance names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Factors of the lower-case dialect.
FACTORS = {"f": 1e-15, "p": 1e-12, "n": 1e-9, "u": 1e-6, "m": 1e-3, "k": 1e3, "meg": 1e6, "g": 1e9, "t": 1e12}
TIMES = {"ps": 1e-12, "ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "": 1.0}
PLAIN = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _factor(name: Column, table: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name)


def spice_value(text: Column) -> Column:
    """Number with an optional factor; an unknown alphabetic suffix counts as none; NULL where no number leads."""
    digits = F.regexp_extract(text, f"^({PLAIN})", 1)
    suffix = F.lower(F.regexp_extract(text, f"^{PLAIN}([A-Za-z]*)", 1))
    return F.when(digits != "", digits.cast("double") * F.coalesce(_factor(suffix, FACTORS), F.lit(1.0)))


def value_with_params(text: Column, params: dict[str, float]) -> Column:
    """As spice_value, but names of parameters count first (any case), X is MEG, and an unknown suffix gives NULL."""
    digits = F.regexp_extract(text, rf"^({PLAIN})[A-Za-z]*\z", 1)
    suffix = F.lower(F.regexp_extract(text, rf"^{PLAIN}([A-Za-z]*)\z", 1))
    named = _factor(F.upper(text), {k.upper(): v for k, v in params.items()}) if params else F.lit(None).cast("double")
    number = digits.cast("double") * F.when(suffix == "", F.lit(1.0)).otherwise(_factor(suffix, {**FACTORS, "x": 1e6}))
    return F.coalesce(named, F.when(digits != "", number))


def time_value(text: Column) -> Column:
    """Seconds of ``5ns``, ``0.1 us``, ``3e-9`` and the like; NULL for other units or no number."""
    digits = F.regexp_extract(text, rf"^\s*({PLAIN})\s*[A-Za-z]*\s*\z", 1)
    unit = F.lower(F.regexp_extract(text, rf"^\s*{PLAIN}\s*([A-Za-z]*)\s*\z", 1))
    return F.when(digits != "", digits.cast("double") * _factor(unit, TIMES))


def node_place(node: Column) -> dict[str, Column]:
    """x, y, layer, layer_num of a name ``X_Y_LAYER`` or ``X_Y``; NULLs for any other name."""
    whole = r"^(-?[0-9]+(?:\.[0-9]+)?)_(-?[0-9]+(?:\.[0-9]+)?)(?:_([A-Za-z]*[0-9]+))?\z"
    part = lambda k: F.nullif(F.regexp_extract(node, whole, k), F.lit(""))
    return {"x": part(1).cast("double"), "y": part(2).cast("double"), "layer": part(3), "layer_num": layer_number(part(3))}


def node_place_anywhere(node: Column) -> dict[str, Column]:
    """x, y of the first ``X_Y`` anywhere in the name, as whole numbers; kept for names that carry a prefix."""
    part = lambda k: F.nullif(F.regexp_extract(node, r"([0-9]+)_([0-9]+)", k), F.lit("")).cast("bigint")
    return {"x": part(1), "y": part(2)}


def layer_number(layer: Column) -> Column:
    """The first digits of a layer's name."""
    return F.nullif(F.regexp_extract(layer, r"([0-9]+)", 1), F.lit("")).cast("int")


def instance_parts(name: Column) -> dict[str, Column]:
    """Parts of ``instance:pin:X_Y``; a part ``0`` or none is NULL."""
    parts = F.split(name, ":", -1)
    part = lambda k: F.nullif(F.nullif(F.get(parts, k), F.lit("0")), F.lit(""))
    tile = lambda k: F.regexp_extract(F.coalesce(F.get(parts, 2), F.lit("")), r"^([0-9]+)_([0-9]+)\z", k)
    return {"instance": part(0), "pin": part(1), "tile_x": F.nullif(tile(1), F.lit("")).cast("int"), "tile_y": F.nullif(tile(2), F.lit("")).cast("int")}


def net_kind(net: Column) -> Column:
    """``ground`` or ``power`` by the name of a net; ground patterns come first; otherwise ``unknown``."""
    n = F.lower(net)
    return F.when(n.rlike("vss|gnd|ground"), "ground").when(n.rlike("vdd|vcc|vpwr|power"), "power").otherwise("unknown")
