"""Spectral indices of band columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import PIXEL, Expression, Operator, expression

EPS = 1e-10


def normalized_difference(a: Column, b: Column, eps: float = EPS) -> Column:
    """(a - b) / (a + b + eps)"""
    return (a - b) / (a + b + F.lit(eps))


def ndvi(nir, red, eps=EPS):
    """Vegetation: near infrared against red."""
    return normalized_difference(nir, red, eps)


def ndwi_mcfeeters(green, nir, eps=EPS):
    """Open water: green against near infrared."""
    return normalized_difference(green, nir, eps)


def ndbi(swir, nir, eps=EPS):
    """Built-up land."""
    return normalized_difference(swir, nir, eps)


def nbr(nir, swir2, eps=EPS):
    """Burn ratio."""
    return normalized_difference(nir, swir2, eps)


def mndwi(green, swir, eps=EPS):
    """Open water, with the short-wave band."""
    return normalized_difference(green, swir, eps)


def ndmi(nir, swir1, eps=EPS):
    """Moisture."""
    return normalized_difference(nir, swir1, eps)


def ndsi(green, swir, eps=EPS):
    """Snow."""
    return normalized_difference(green, swir, eps)


def nbr2(swir1, swir2, eps=EPS):
    """Burn ratio of the two short-wave bands."""
    return normalized_difference(swir1, swir2, eps)


def savi(nir, red, L=0.5, eps=EPS):
    """Soil-adjusted vegetation."""
    return (nir - red) / (nir + red + F.lit(L) + F.lit(eps)) * F.lit(1 + L)


def evi(nir, red, blue, G=2.5, C1=6.0, C2=7.5, L=1.0, eps=EPS):
    """Enhanced vegetation."""
    return F.lit(G) * (nir - red) / (nir + F.lit(C1) * red - F.lit(C2) * blue + F.lit(L) + F.lit(eps))


def evi2(nir, red, eps=EPS):
    """Enhanced vegetation without blue."""
    return F.lit(2.5) * (nir - red) / (nir + F.lit(2.4) * red + F.lit(1.0) + F.lit(eps))


def arvi(nir, red, blue, gamma=1.0, eps=EPS):
    """Atmospherically resistant vegetation."""
    rb = red - F.lit(gamma) * (blue - red)
    return normalized_difference(nir, rb, eps)


def gci(nir, green, eps=EPS):
    """Green chlorophyll."""
    return nir / (green + F.lit(eps)) - 1


def kndvi(nir, red, eps=EPS):
    """Kernel vegetation index."""
    return F.tanh(F.pow(ndvi(nir, red, eps), F.lit(2)))


def bais2(red, red_edge1, red_edge2, nir, swir2, eps=EPS):
    """Burned area."""
    edge = 1 - F.sqrt(red_edge1 * red_edge2 * nir / (red + F.lit(eps)))
    return edge * ((swir2 - nir) / F.sqrt(swir2 + nir + F.lit(eps)) + 1)


def bsi(blue, red, nir, swir, eps=EPS):
    """Bare soil."""
    return normalized_difference(swir + red, nir + blue, eps)


def iron_oxide(red, blue, eps=EPS):
    """Red over blue."""
    return red / (blue + F.lit(eps))


def clay_minerals(swir1, swir2, eps=EPS):
    """Short-wave ratio."""
    return swir1 / (swir2 + F.lit(eps))


def ciri(cirrus):
    """The cirrus band as it is."""
    return cirrus * F.lit(1.0)


NormalizedDifference = expression("NormalizedDifference", normalized_difference, a="nir", b="red")
NDVI = expression("NDVI", ndvi, nir="nir", red="red")
NDWI = expression("NDWI", ndwi_mcfeeters, green="green", nir="nir")
NDBI = expression("NDBI", ndbi, swir="swir", nir="nir")
NBR = expression("NBR", nbr, nir="nir", swir2="swir2")
SAVI = expression("SAVI", savi, nir="nir", red="red", L=0.5)
EVI = expression("EVI", evi, nir="nir", red="red", blue="blue")
EVI2 = expression("EVI2", evi2, nir="nir", red="red")
ARVI = expression("ARVI", arvi, nir="nir", red="red", blue="blue", gamma=1.0)
GCI = expression("GCI", gci, nir="nir", green="green")
kNDVI = expression("kNDVI", kndvi, nir="nir", red="red")
MNDWI = expression("MNDWI", mndwi, green="green", swir="swir")
NDMI = expression("NDMI", ndmi, nir="nir", swir1="swir")
NDSI = expression("NDSI", ndsi, green="green", swir="swir")
NBR2 = expression("NBR2", nbr2, swir1="swir", swir2="swir2")
BAIS2 = expression("BAIS2", bais2, red="red", red_edge1="re1", red_edge2="re2", nir="nir", swir2="swir2")
BSI = expression("BSI", bsi, blue="blue", red="red", nir="nir", swir="swir")
IronOxide = expression("IronOxide", iron_oxide, red="red", blue="blue")
ClayMinerals = expression("ClayMinerals", clay_minerals, swir1="swir", swir2="swir2")
CIRI = expression("CIRI", ciri, cirrus="swir2")


class AppendIndex(Operator):
    """An index as one more band of a wide table, or as rows of a new band of a long one."""

    def __init__(self, index: Expression, band: str | None = None):
        super().__init__(index=index.config(), band=band)
        self.index, self.band = index, band or index.out

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.band, self.index.column())


class dNBR(Operator):
    """Burn ratio before minus after; both tables are joined on their pixels."""

    def __init__(self, nir: str = "nir", swir2: str = "swir2", keys=PIXEL):
        super().__init__(nir=nir, swir2=swir2, keys=keys)

    def __call__(self, before: DataFrame, after: DataFrame) -> DataFrame:
        p, keys = self.params, list(self.params["keys"])
        one = lambda df, name: df.select(*keys, nbr(F.col(p["nir"]), F.col(p["swir2"])).alias(name))
        return one(before, "_before").join(one(after, "_after"), keys).select(*keys, (F.col("_before") - F.col("_after")).alias("dnbr"))


def resolve_band(names: dict[str, list[str]] | list[str], ref: int | str, keys=("descriptions", "band_names", "bands")) -> str:
    """The column of a band given by number or name; of several lists of names the first that has it counts."""
    lists = [names] if isinstance(names, list) else [names[k] for k in keys if names.get(k)]
    if isinstance(ref, int):
        return lists[0][ref]
    for one in lists:
        if ref in one:
            return lists[0][one.index(ref)]
    raise KeyError(f"no band {ref!r}")


def configured_ref(value, fallback):
    """A band given by name, or else its default number."""
    return fallback if value is None else value
