"""Packed fields of point records, and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published colour ramps, from low to high, as 0xRRGGBB.
RAMPS = {
    "Grayscale": [0x000000, 0xFFFFFF],
    "Elevation1": [0xAFF0E9, 0xFFFFB3, 0x008040, 0xFCBA03, 0x800000, 0x69300D, 0xABABAB, 0xFFFCFF],
    "Elevation2": [0x76DBD3, 0xFFFFC7, 0xFFFFC7, 0xFFFF80, 0xD9C279, 0x876026, 0x9696B5, 0xB596B5, 0x19FCFF],
    "BareEarth": [0xFFFF80, 0xF2A72E, 0x6B0000],
    "FullSpectrum": [0xFF0000, 0xFFFF00, 0x00FFFF, 0x0000FF],
    "PartialSpectrum": [0x734D2A, 0x9C6930, 0xC98934, 0xE8C174, 0xFFFFBF, 0xAD95BA, 0x5B3FB0, 0x592787, 0x510D61],
}


def ramp_stops(name: str, reverse: bool = False) -> list[tuple[int, int, int]]:
    """The red, green and blue stops of a published ramp, for `ramp`."""
    stops = [(c >> 16, c >> 8 & 255, c & 255) for c in RAMPS[name]]
    return stops[::-1] if reverse else stops


def return_bits(options: Column) -> list[Column]:
    """The fields of the return byte: number, count, scan direction, edge of the flight line."""
    fields = (("return_number", 0, 7), ("return_count", 3, 7), ("scan_direction", 6, 1), ("flight_edge", 7, 1))
    return [F.shiftright(options, at).bitwiseAND(F.lit(mask)).cast("int").alias(name) for name, at, mask in fields]


def class_bits(value: Column) -> list[Column]:
    fields = (("classification", 0, 31), ("synthetic", 5, 1), ("key_point", 6, 1), ("withheld", 7, 1))
    return [F.shiftright(value, at).bitwiseAND(F.lit(mask)).cast("int").alias(name) for name, at, mask in fields]


def rgb_pack(red: Column, green: Column, blue: Column) -> Column:
    """Three 16-bit channels as 8-bit ones in one integer, red lowest."""
    r, g, b = ((c * F.lit(255.0 / 65536.0)).cast("int") for c in (red, green, blue))
    return r.bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(F.shiftleft(b, 16))


def stddev_stretch(mean: Column, stddev: Column, low: Column, high: Column, k: float) -> tuple[Column, Column]:
    """mean ± k standard deviations, inside the actual range."""
    return F.greatest(low, mean - k * stddev), F.least(high, mean + k * stddev)


def interval(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0 below the stretch, bins - 1 above, equal bins inside."""
    inside = F.floor((value - low) / (high - low) * bins)
    return F.when((value <= low) | (high <= low), F.lit(0)).otherwise(F.least(inside, F.lit(bins - 1))).cast("int")


def ramp(ratio: Column, stops: list[tuple[int, int, int]]) -> Column:
    """A piecewise-linear colour ramp: packed 0xRRGGBB of a ratio from 0 to 1, truncating."""
    place = F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)) * (len(stops) - 1)
    at = F.least(F.floor(place), F.lit(len(stops) - 2)).cast("int")
    channels = []
    for c in range(3):
        values = F.array(*[F.lit(s[c]) for s in stops])
        a, b = F.element_at(values, at + 1), F.element_at(values, at + 2)
        channels.append((a + (place - at) * (b - a)).cast("int"))
    return channels[0] * 65536 + channels[1] * 256 + channels[2]


def minmax_stretch(low: Column, high: Column) -> tuple[Column, Column]:
    """The whole range."""
    return low, high


def custom_stretch(low: Column, high: Column, begin: float, end: float) -> tuple[Column, Column]:
    """A given range, inside the actual one."""
    return F.greatest(low, F.lit(begin)), F.least(high, F.lit(end))


def interval_shift(actual: tuple[Column, Column], stretch: tuple[Column, Column], bins: int, scaled: bool = True) -> Column:
    """By how many bits whole numbers are shifted to get their bin: the width is a power of two, so that about `bins` bins cover the stretch
    (or with scaled=False the actual range), but no more than there are values."""
    span = (actual[1] - actual[0]).cast("double")
    power = lambda x: F.ceil(F.log2(x)).cast("int")
    wanted = F.floor(F.lit(float(bins)) / ((stretch[1] - stretch[0]) / span)) if scaled else F.lit(float(bins))
    return F.when(span > 0, F.greatest(power(span) - F.least(power(wanted), power(span)), F.lit(0))).otherwise(F.lit(0))


def interval_map(value: Column, actual: tuple[Column, Column], stretch: tuple[Column, Column], shift: Column) -> tuple[Column, Column]:
    """The bin of a whole number, counted from that of the actual minimum, and its ratio: 0 below the stretch's first bin, 1 above
    its last one, in equal steps between them."""
    down = lambda v: F.call_function("shiftright", v, shift)
    index = down(value) - down(actual[0])
    first, last = down(stretch[0]) - down(actual[0]), down(stretch[1]) - down(actual[0])
    inside = F.coalesce(F.try_divide((index - first).cast("double"), (last - first).cast("double")), F.lit(0.0))
    return index, F.when(index < first, F.lit(0.0)).when(index > last, F.lit(1.0)).otherwise(inside)


def ramp_size(quality: float) -> int:
    """The length of a precomputed ramp for a quality from 0 to 100."""
    return int(quality / 100 * 300)


def cached_ramp(stops: list[tuple[int, int, int]], bins: int) -> Column:
    """The colours of all bins of a ramp as one array; the entry behind the last repeats it, for what overflows."""
    places = [F.lit(i / max(bins - 1, 1)) for i in range(bins)]
    return F.array(*[ramp(p, stops) for p in [*places, places[-1]]])


def distinct_colour(value: Column, palette: list[int]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in palette]), (F.pmod(value, F.lit(len(palette))) + 1).cast("int"))


def ramp_size_of(quality: Column) -> Column:
    """`ramp_size` for a column of qualities, in single precision."""
    return ((quality / 100.0).cast("float") * F.lit(300).cast("float")).cast("int")


def bitmap(pixels: DataFrame, width: int, height: int, colours: Column, bin_: Column) -> DataFrame:
    """(px, py, argb) for every pixel of a raster of width x height: pixels (r, c and what the bin is computed from) in the colour of their
    bin, opaque, those without a value transparent; the first row is the lowest."""
    every = pixels.sparkSession.range(width * height).select((F.col("id") % width).cast("int").alias("px"), F.expr(f"int(id div {width})").alias("py"))
    seen = pixels.select(F.col("c").cast("int").alias("px"), (F.lit(height - 1) - F.col("r")).cast("int").alias("py"), (F.get(colours, bin_) + F.lit(0xFF000000)).alias("argb"))
    return every.join(seen, ["px", "py"], "left").select("px", "py", F.coalesce("argb", F.lit(0xFFFFFF)).cast("long").alias("argb"))
