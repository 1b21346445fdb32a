"""Radiometric conversions and solar geometry."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, percentile, valid
from .core import Operator, expression


def dn_to_radiance(dn, gain, offset=0.0, scale=1.0):
    """gain * dn / scale + offset"""
    return F.lit(gain) * dn / F.lit(scale) + F.lit(offset)


def radiance_to_dn(radiance, gain, offset=0.0, scale=1.0):
    """(radiance - offset) * scale / gain"""
    return (radiance - F.lit(offset)) * F.lit(scale) / F.lit(gain)


def dn_to_reflectance(dn, scale, offset=0.0):
    """scale * dn + offset"""
    return F.lit(scale) * dn + F.lit(offset)


def min_max_normalize(v, vmin, vmax, clipped=True):
    """(v - vmin) / (vmax - vmin), in [0, 1] if clipped."""
    out = (v - F.lit(vmin)) / F.lit(float(vmax - vmin))
    return clip(out, 0.0, 1.0) if clipped else out


def gamma_correct(v, g=1.2):
    """max(v, 0) ** (1 / g)"""
    return F.pow(F.greatest(v, F.lit(0.0)), F.lit(1.0 / g))


def bt_from_radiance(radiance, k1, k2):
    """Brightness temperature: k2 / ln(k1 / radiance + 1)"""
    return F.lit(k2) / F.log(F.lit(k1) / radiance + 1)


def to_float32(v):
    """Single precision."""
    return v.cast("float")


ToFloat32 = expression("ToFloat32", to_float32, v="nir")
DNToRadiance = expression("DNToRadiance", dn_to_radiance, dn="qa", gain=0.01)
RadianceToDN = expression("RadianceToDN", radiance_to_dn, radiance="nir", gain=0.01)
DNToReflectance = expression("DNToReflectance", dn_to_reflectance, dn="qa", scale=1e-4)
MinMax = expression("MinMax", min_max_normalize, v="nir", vmin=0.0, vmax=1.0)
Gamma = expression("Gamma", gamma_correct, v="nir", g=1.2)
BTFromRadiance = expression("BTFromRadiance", bt_from_radiance, radiance="nir", k1=774.8853, k2=1321.0789)


def _day(when: dt.datetime | dt.date) -> int:
    return when.timetuple().tm_yday


def earth_sun_distance_correction_factor(when) -> float:
    """Distance of sun and earth in astronomical units, by the day of the year."""
    return 1 - 0.01673 * math.cos(0.0172 * (_day(when) - 4))


def earth_sun_distance(t: Column) -> Column:
    """The same as a column of timestamps."""
    return 1 - 0.01673 * F.cos(F.lit(0.0172) * (F.dayofyear(t) - 4))


def sza(lon: Column, lat: Column, t: Column) -> Column:
    """Solar zenith angle in degrees at longitude, latitude (degrees) and a UTC timestamp."""
    day = F.dayofyear(t)
    hour = F.hour(t) + F.minute(t) / 60.0 + F.second(t) / 3600.0
    g = F.lit(2 * math.pi / 365) * (day - 1 + (hour - 12) / 24.0)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    decline = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    angle = F.radians((hour * 60 + equation + 4 * lon) / 4 - 180)
    c = F.sin(F.radians(lat)) * F.sin(decline) + F.cos(F.radians(lat)) * F.cos(decline) * F.cos(angle)
    return F.degrees(F.acos(clip(c, -1.0, 1.0)))


def compute_sza(center: tuple[float, float], when: dt.datetime) -> float:
    """Solar zenith angle in degrees for one place and time, on the driver."""
    lon, lat = center
    hour = when.hour + when.minute / 60 + when.second / 3600
    g = 2 * math.pi / 365 * (_day(when) - 1 + (hour - 12) / 24)
    equation = 229.18 * (0.000075 + 0.001868 * math.cos(g) - 0.032077 * math.sin(g) - 0.014615 * math.cos(2 * g) - 0.040849 * math.sin(2 * g))
    decline = 0.006918 - 0.399912 * math.cos(g) + 0.070257 * math.sin(g) - 0.006758 * math.cos(2 * g) + 0.000907 * math.sin(2 * g) - 0.002697 * math.cos(3 * g) + 0.00148 * math.sin(3 * g)
    angle = math.radians((hour * 60 + equation + 4 * lon) / 4 - 180)
    c = math.sin(math.radians(lat)) * math.sin(decline) + math.cos(math.radians(lat)) * math.cos(decline) * math.cos(angle)
    return math.degrees(math.acos(max(-1.0, min(1.0, c))))


def observation_date_correction_factor(when, *, sza_deg: float | None = None, center: tuple[float, float] | None = None) -> float | None:
    """pi * d^2 / cos(zenith); None if neither angle nor centre is given."""
    if sza_deg is None:
        if center is None:
            return None
        sza_deg = compute_sza(center, when)
    return math.pi * earth_sun_distance_correction_factor(when) ** 2 / math.cos(math.radians(sza_deg))


def radiance_to_reflectance(radiance: Column, irradiance: float, factor: float) -> Column:
    """radiance * factor / irradiance; factor of observation_date_correction_factor()."""
    return radiance * F.lit(factor / irradiance)


def reflectance_to_radiance(reflectance: Column, irradiance: float, factor: float) -> Column:
    return reflectance * F.lit(irradiance / factor)


RadianceToReflectance = expression("RadianceToReflectance", radiance_to_reflectance, radiance="nir", irradiance=1000.0, factor=math.pi)
ReflectanceToRadiance = expression("ReflectanceToRadiance", reflectance_to_radiance, reflectance="nir", irradiance=1000.0, factor=math.pi)


class EarthSunDistanceCorrection(Operator):
    """Multiplies bands by the squared distance of the rows' time (or of one date)."""

    def __init__(self, bands: list[str], t: str = "t"):
        super().__init__(bands=bands, t=t)

    def apply(self, df: DataFrame) -> DataFrame:
        d = earth_sun_distance(F.col(self.params["t"]))
        return df.withColumns({b: F.col(b) * d * d for b in self.params["bands"]})


class ComputeSZA(Operator):
    def __init__(self, lon: str = "lon", lat: str = "lat", t: str = "t", out: str = "sza"):
        super().__init__(lon=lon, lat=lat, t=t, out=out)

    def apply(self, df: DataFrame) -> DataFrame:
        p = self.params
        return df.withColumn(p["out"], sza(F.col(p["lon"]), F.col(p["lat"]), F.col(p["t"])))


class _Stretched(Operator):
    """Statistics per scene and band, once, joined to the pixels by a window."""

    def __init__(self, band: str = "nir", by=("scene",), **params):
        super().__init__(band=band, by=by, **params)

    def with_stats(self, df: DataFrame, **stats: Column) -> DataFrame:
        by = list(self.params["by"])
        agg = df.groupBy(*by).agg(*[v.alias(k) for k, v in stats.items()])
        return df.join(agg, by) if by else df.crossJoin(F.broadcast(agg))


class PercentileClip(_Stretched):
    """Stretch between two percentiles of each scene to [0, 1]; a flat scene is divided by 1."""

    def __init__(self, band: str = "nir", p_min: float = 2.0, p_max: float = 98.0, by=("scene",), out: str | None = None):
        super().__init__(band, by, p_min=p_min, p_max=p_max, out=out or band)

    def apply(self, df: DataFrame) -> DataFrame:
        p, v = self.params, F.col(self.params["band"])
        both = self.with_stats(df, _lo=percentile(v, p["p_min"] / 100), _hi=percentile(v, p["p_max"] / 100))
        span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(F.lit(1.0))
        return both.withColumn(p["out"], clip((v - F.col("_lo")) / span, 0.0, 1.0)).drop("_lo", "_hi")


class DOS1(_Stretched):
    """Dark-object subtraction: max(v - percentile, 0) per scene."""

    def __init__(self, band: str = "nir", dark_percentile: float = 1.0, by=("scene",), out: str | None = None):
        super().__init__(band, by, dark=dark_percentile, out=out or band)

    def apply(self, df: DataFrame) -> DataFrame:
        p, v = self.params, F.col(self.params["band"])
        both = self.with_stats(df, _dark=percentile(v, p["dark"] / 100))
        return both.withColumn(p["out"], F.greatest(v - F.col("_dark"), F.lit(0.0))).drop("_dark")


def SimpleAtmosphericCorrection(method: str = "dos1", **params) -> Operator:
    if method != "dos1":
        raise ValueError("method is dos1")
    return DOS1(**params)


def integrated_irradiance(srf: DataFrame, irradiance: DataFrame, eps: float = 1e-4) -> DataFrame:
    """(band, irradiance): mean of irradiance (wavelength, e) weighted by srf (band, wavelength, w), where w > eps."""
    both = srf.where(F.col("w") > eps).join(irradiance, "wavelength")
    return both.groupBy("band").agg((F.sum(F.col("e") * F.col("w")) / F.sum("w")).alias("irradiance"))


def apply_srf(cube: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean of bands: cube (keys, band, v), weights (target, band, w); the weights are few and bounded by bands x targets."""
    both = cube.join(F.broadcast(weights), "band")
    return both.groupBy(*keys, "target").agg((F.sum(valid(F.col("v")) * F.col("w")) / F.sum("w")).alias("v"))


def gaussian_srf(spark, centers: list[float], fwhm: list[float], wavelengths: list[float], eps: float = 1e-4) -> DataFrame:
    """Gaussian response weights (target, band, w) of each source band, normalised per target."""
    rows = []
    for k, (c, f) in enumerate(zip(centers, fwhm, strict=True)):
        s = f / (2 * math.sqrt(2 * math.log(2)))
        w = [math.exp(-0.5 * ((x - c) / s) ** 2) for x in wavelengths]
        total = sum(w)
        rows += [(k, b, x / total) for b, x in enumerate(w) if x / total > eps]
    return spark.createDataFrame(rows, "target int, band int, w double")

