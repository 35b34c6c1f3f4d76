"""Column expressions: encodings, guards, bins, unit conversions and spectral indices."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import medians


def cyclic(x: Column, period: float, name: str) -> list[Column]:
    """name_sin and name_cos of x on a circle of `period`."""
    angle = x * F.lit(2 * math.pi / period)
    return [F.sin(angle).alias(f"{name}_sin"), F.cos(angle).alias(f"{name}_cos")]


def date_parts(day: Column) -> list[Column]:
    """year, month, day, day_of_year and ISO week as integers."""
    parts = {"year": F.year(day), "month": F.month(day), "day": F.dayofmonth(day), "day_of_year": F.dayofyear(day), "week": F.weekofyear(day)}
    return [c.cast("int").alias(n) for n, c in parts.items()]


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def safe_percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """100 * part / whole, half-even rounded; 0 where whole is 0."""
    return F.when(whole != 0, F.bround(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bounded x; null stays null (greatest/least would skip it)."""
    if low is not None:
        x = F.when(x < low, F.lit(float(low))).otherwise(x)
    return x if high is None else F.when(x > high, F.lit(float(high))).otherwise(x)


def finite(x: Column) -> Column:
    """x, or null where it is infinite or not a number."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def bins_right_closed(x: Column, edges: Sequence[float], names: Sequence[str]) -> Column:
    """Label of (-inf, e0], (e0, e1], ..., (last, inf)."""
    out = reduce(lambda c, en: c.when(x <= en[0], en[1]), zip(edges[1:], names[1:], strict=False), F.when(x <= edges[0], names[0]))
    return out.when(x.isNotNull(), names[-1])


def season(month: Column, dry: Sequence[int] = (12, 1, 2, 3, 4, 5)) -> Column:
    return F.when(month.isin(*dry), "dry").when(month.isNotNull(), "wet")


def flag_at_least(x: Column, threshold: float) -> Column:
    """1 where x >= threshold, else 0 (null: 0)."""
    return F.when(x >= threshold, 1).otherwise(0)


def three_way_weight(flag: Column, yes: float = 1.0, no: float = 0.4, unknown: float = 0.5) -> Column:
    return F.when(flag, yes).when(~flag, no).otherwise(unknown)


def decimal_comma(x: Column) -> Column:
    """Text with a decimal comma or point as a double; null where it does not parse."""
    return F.regexp_replace(F.trim(x), ",", ".").try_cast("double")


def coerce_numeric(df: DataFrame, columns: Sequence[str], least_share: float = 0.8) -> DataFrame:
    """Turn text columns into doubles where over `least_share` of their non-null values parse (one pass decides)."""
    counts = df.agg(*[F.count(c).alias(f"{c}_all") for c in columns], *[F.count(decimal_comma(F.col(c))).alias(f"{c}_ok") for c in columns]).first()
    good = [c for c in columns if counts[f"{c}_all"] and counts[f"{c}_ok"] > least_share * counts[f"{c}_all"]]
    return df.withColumns({c: decimal_comma(F.col(c)) for c in good})


def one_hot(df: DataFrame, column: str, prefix: str, most: int = 200) -> DataFrame:
    """One 0/1 column for each level, levels in order; more than `most` levels are refused."""
    levels = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(levels) > most:
        raise ValueError(f"{column} has more than {most} levels")
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


def row_mean(columns: Sequence[str]) -> Column:
    """Mean of the non-null values of a row; null if there is none."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    count = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return F.when(count > 0, total / count)


def any_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])


def unstandardise(x: Column, mean: float, std: float) -> Column:
    return x * F.lit(std) + F.lit(mean)


def flip_if_median_negative(df: DataFrame, column: str) -> DataFrame:
    """Change the sign of a column whose median over all rows is below 0."""
    sign = -1.0 if medians(df, [column]).get(column, 0.0) < 0 else 1.0
    return df.withColumn(column, F.col(column) * F.lit(sign))


def weather_units(df: DataFrame) -> DataFrame:
    """Kelvin, metres, pascals and joules of a reanalysis day into C, mm, hPa and MJ; wind speed from its parts.

    Precipitation, runoff and radiation are not below 0; evaporation comes as its size and with its sign.
    Only the columns that df has are converted.
    """
    c = F.col
    celsius, positive_mm = lambda x: c(x) - 273.15, lambda x: clip(c(x), 0.0) * 1000
    known = {
        "temperature_2m_c": (("temperature_2m",), celsius),
        "temperature_2m_min_c": (("temperature_2m_min",), celsius),
        "temperature_2m_max_c": (("temperature_2m_max",), celsius),
        "dewpoint_temperature_2m_c": (("dewpoint_temperature_2m",), celsius),
        "precipitation_mm": (("total_precipitation",), positive_mm),
        "runoff_mm": (("runoff",), positive_mm),
        "potential_evaporation_mm": (("potential_evaporation",), lambda x: F.abs(c(x)) * 1000),
        "potential_evaporation_mm_signed": (("potential_evaporation",), lambda x: c(x) * 1000),
        "surface_pressure_hpa": (("surface_pressure",), lambda x: c(x) / 100),
        "solar_radiation_mj_m2": (("solar_radiation",), lambda x: clip(c(x), 0.0) / 1e6),
        "wind_u_10m_ms": (("wind_u",), c),
        "wind_v_10m_ms": (("wind_v",), c),
        "wind_speed_10m_ms": (("wind_u", "wind_v"), lambda u, v: F.hypot(c(u), c(v))),
    }
    return df.select("*", *[f(*inputs).alias(name) for name, (inputs, f) in known.items() if set(inputs) <= set(df.columns)])


def scale_bands(df: DataFrame, bands: Sequence[str], factor: float = 10_000.0) -> DataFrame:
    """Stored integers of reflectance bands as shares of 1."""
    return df.withColumns({b: F.col(b) / F.lit(factor) for b in bands})


def mask_bands(df: DataFrame, bands: Sequence[str], clear: Column) -> DataFrame:
    """Bands of pixels that are not clear become null; the rows stay."""
    return df.withColumns({b: F.when(clear, F.col(b)) for b in bands})


def joined_values(column: str, separator: str = ",") -> Column:
    """The sorted distinct values of a column as one string (an aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(F.col(column).cast("string"))), separator)


#: Semi-major axis and flattening of WGS 84, scale on the central meridian, false easting.
_AXIS, _FLAT, _SCALE, _EAST = 6_378_137.0, 1 / 298.257223563, 0.9996, 500_000.0


def utm(lon: Column, lat: Column, zone: int = 48) -> tuple[Column, Column]:
    """Easting and northing in metres of degrees in a northern UTM zone (zone 48: EPSG 32648).

    Krueger's series to the third power of the third flattening: good to a millimetre inside the zone.
    """
    n = _FLAT / (2 - _FLAT)
    radius = _AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, away = F.radians(lat), F.radians(lon - F.lit(float(zone * 6 - 183)))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(e) * F.atanh(F.lit(e) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(series, 1):
        east = east + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_EAST) + F.lit(_SCALE * radius) * east, F.lit(_SCALE * radius) * north


def _ratio(a: Column, b: Column) -> Column:
    """a / b, masked (null) on a zero divisor."""
    return F.try_divide(a, b)


def spectral_indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column) -> dict[str, Column]:
    """Vegetation, water, soil and salinity indices of surface reflectances (0 to 1)."""
    return {
        "NDVI": _ratio(nir - red, nir + red),
        "NDWI": _ratio(green - nir, green + nir),
        "MNDWI": _ratio(green - swir1, green + swir1),
        "EVI": _ratio(F.lit(2.5) * (nir - red), nir + F.lit(6.0) * red - F.lit(7.5) * blue + F.lit(1.0)),
        "SAVI": _ratio(F.lit(1.5) * (nir - red), nir + red + F.lit(0.5)),
        "RVI": _ratio(nir, red),
        "BI": F.sqrt(green * green + nir * nir),
        "BGRratio": _ratio(blue + green, red),
        "SI_1": F.sqrt(green * red),
        "SI_2": F.sqrt(green * green + red * red),
        "SI_3": F.sqrt(green * green + red * red + nir * nir),
        "R_1": _ratio(blue, red),
        "R_2": _ratio(blue, nir),
        "R_3": _ratio(green, red),
        "R_4": _ratio(green, nir),
        "Red_SWIR1_ratio": _ratio(red, swir1),
        "SWIR1": swir1,
        "SWIR2": swir2,
    }


def map_indices(blue: Column, green: Column, red: Column, nir: Column, swir1: Column, swir2: Column, eps: float = 1e-6) -> dict[str, Column]:
    """The weekly map's band columns; eps in each divisor keeps dark pixels."""
    d = lambda a, b: (a - b) / (a + b + F.lit(eps))
    return {
        "MNDWI_median_week": d(green, swir1),
        "NDWI_median_week": d(green, nir),
        "NDVI_median_week": d(nir, red),
        "NDCI_median_week": d(red, blue),
        "BGRratio_median_week": (blue + green) / (red + F.lit(eps)),
        "Red_SWIR1_median_week": red / (swir1 + F.lit(eps)),
        "Red_SWIR2_median_week": red / (swir2 + F.lit(eps)),
        "B11_median_week": swir1,
        "B12_median_week": swir2,
    }


def clear_pixel(quality: Column, cloud: Column, scene: Column, most_cloud: int = 40) -> Column:
    """No cloud or cirrus bit (10, 11), cloud probability below the limit, scene class not shadow, cloud or snow."""
    bits = quality.bitwiseAND(F.lit((1 << 10) | (1 << 11))) == 0
    return bits & (cloud < most_cloud) & ~scene.isin(3, 8, 9, 10, 11)
