"""Ordered classifications as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")
#: Travel-time classes in their order, and the depths and speeds of the flood rule.
CLASSES = ("well-served", "underserved", "critical")
LIGHT_BELOW, SEVERE_FROM = 0.3, 1.0
DRIVE_LIGHT_KMH, WALK_LIGHT_KMH, WALK_MODERATE_KMH, WALK_KMH = 10.0, 1.5, 1.0, 4.5
#: Road classes and their speeds; any other class takes the default.
SPEED_KMH = {"osm_trunk": 80.0, "osm_primary": 80.0, "osm_secondary": 60.0, "osm_tertiary": 40.0, "osm_unclassified": 20.0, "zwe_roads_Road": 50.0, "zwe_roads_Trail": 15.0}
DEFAULT_KMH = 20.0
#: What ownership codes and words mean.
OWNERSHIP = {
    "0": "unspecified", "1": "unspecified", "2": "government", "3": "mission", "4": "mission", "5": "government/council", "6": "government/council",
    "7": "private", "8": "unspecified", "9": "unspecified", "govt": "government", "council": "government/council", "mission": "mission",
    "private": "private", "industrial": "private", "prison": "restricted", "zrp": "restricted",
}
#: Words in names that say a place is restricted, or not in operation.
RESTRICTED = r"\bZRP\b|\bZPS\b|\bprison\b|\bcorrectional\b|\bpolice\b"
CLOSED = r"\bnot yet open\b|\bunder construction\b|\badmin(istration)? office\b|\bnon[- ]operational\b|\bclosed\b"
REASONS = {
    "restricted": "Excluded - restricted access (prison/police, not public)",
    "private": "Excluded - private facility",
    "closed": "Excluded - non-operational / administrative, not a service point",
    "nowhere": "Excluded - missing or invalid coordinates",
    "included": "Included - public facility",
}
NUMBER = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def first_of(rules: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The value of the first rule that holds; a rule that is null doesn't."""
    out = F.lit(otherwise)
    for test, value in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), value).otherwise(out)
    return out


def finite(x: Column) -> Column:
    """Whether a time that isn't negative is finite: false for +inf, NaN and null."""
    return F.coalesce(x < INF, F.lit(False))


def time_class(minutes: Column) -> Column:
    """Under 30 minutes, under 60, and all else (unreachable and unknown included)."""
    return first_of([(minutes < 30, CLASSES[0]), (minutes < 60, CLASSES[1])], CLASSES[2])


def class_rank(name: Column) -> Column:
    return F.when(name == CLASSES[0], 0).when(name == CLASSES[1], 1).when(name == CLASSES[2], 2)


def severity(depth: Column) -> Column:
    """light, moderate or severe; null where no depth was sampled."""
    return F.when(depth.isNull() | F.isnan(depth), None).otherwise(first_of([(depth < LIGHT_BELOW, "light"), (depth < SEVERE_FROM, "moderate")], "severe"))


def flood_minutes(mode: str, minutes: Column, length_m: Column, depth: Column) -> Column:
    """Minutes along an edge under the flood rule; null for an edge that can't be passed."""
    s = severity(depth)
    slow = lambda kmh: length_m / 1000.0 / kmh * 60.0
    if mode == "drive":
        return F.when(s.isNull(), minutes).when(s == "light", slow(DRIVE_LIGHT_KMH))
    return F.when(s.isNull(), minutes).when(s == "light", slow(WALK_LIGHT_KMH)).when(s == "moderate", slow(WALK_MODERATE_KMH))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ownership(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in OWNERSHIP.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(strip(code))), F.lit("unknown"))


def number(text: Column) -> Column:
    """A number, or null for text that isn't one (hexadecimal and suffixed forms are not)."""
    return F.when(text.cast("string").rlike(NUMBER), strip(text.cast("string")).try_cast("double"))


def place_status(name: Column, owner: Column, comments: Column, lon: Column, lat: Column) -> Column:
    """restricted, private, closed, nowhere or included: the first that applies. Null texts match nothing."""
    kind = ownership(owner)
    return first_of(
        [
            (F.coalesce(name, F.lit("")).rlike(f"(?i){RESTRICTED}") | (kind == "restricted"), "restricted"),
            (kind == "private", "private"),
            (F.coalesce(name, F.lit("")).rlike(f"(?i){CLOSED}") | F.coalesce(comments, F.lit("")).rlike(f"(?i){CLOSED}"), "closed"),
            (lon.isNull() | lat.isNull() | F.isnan(lon) | F.isnan(lat), "nowhere"),
        ],
        "included",
    )


def combined_status(cut_off: Column, base_min: Column, flood_min: Column, base_class: Column, flood_class: Column) -> Column:
    return first_of(
        [
            (cut_off, "Newly cut off by flood"),
            (~finite(base_min) & ~finite(flood_min), "Always cut off"),
            ((base_class == CLASSES[0]) & (flood_class == CLASSES[0]), "Well-served (unaffected by flood)"),
            (class_rank(flood_class) > class_rank(base_class), "Degraded by flood (not cut off)"),
        ],
        "Persistently underserved/critical",
    )
