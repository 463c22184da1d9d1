"""Options of the library: typed, with defaults, set in a session as `tessera.<category>.<name>`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

CATEGORIES = ("tiling", "segments", "sources")


@dataclass(frozen=True)
class Option:
    """An option's category, name and default; a value has the default's type."""

    category: str
    name: str
    default: int | float | bool | str

    @property
    def key(self) -> str:
        return f"tessera.{self.category}.{self.name}"

    def get(self, spark: SparkSession) -> int | float | bool | str:
        given = spark.conf.get(self.key, None)
        if given is None:
            return self.default
        if isinstance(self.default, bool):
            if given.lower() not in ("true", "false"):
                raise ValueError(f"{self.key} is true or false, not {given}")
            return given.lower() == "true"
        return type(self.default)(given)

    def set(self, spark: SparkSession, value: int | float | bool | str) -> None:
        if type(value) is not type(self.default):
            raise TypeError(f"{self.key} is a {type(self.default).__name__}")
        spark.conf.set(self.key, str(value).lower() if isinstance(value, bool) else str(value))


REGISTERED: dict[str, Option] = {}


def option(category: str, name: str, default: int | float | bool | str) -> Option:
    """Registers an option; a second registration must have the same type, and gives the first one."""
    if category not in CATEGORIES or not name or any(c in name for c in ".\\ :"):
        raise ValueError(f"bad option {category}.{name}")
    made = Option(category, name, default)
    known = REGISTERED.setdefault(made.key, made)
    if type(known.default) is not type(default):
        raise TypeError(f"{made.key} is registered as {type(known.default).__name__}")
    return known


# The published defaults of tiling.
DESIRED_POINTS = option("tiling", "desired_points", 40_000)
MOST_TILES = option("tiling", "most_tiles", 10_000_000)
MOST_LOWRES = option("tiling", "most_lowres", 1_000_000)
SEGMENT_BYTES = option("segments", "bytes", 256 << 20)
PRECISION_BYTES = option("sources", "precision_bytes", 16 << 20)
