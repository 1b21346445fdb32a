"""Quality masks: bit fields, classes and sentinels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import Operator

# Scene classes of the SCL band.
SCL = {"no_data": 0, "saturated": 1, "dark": 2, "cloud_shadow": 3, "vegetation": 4, "soil": 5, "water": 6, "unclassified": 7, "cloud_medium": 8, "cloud_high": 9, "cirrus": 10, "snow": 11}
# Bits of QA60.
QA60 = {"cloud": 10, "cirrus": 11}
# Bits of QA_PIXEL; cirrus is not set by the l7 sensors.
QA_PIXEL = {"fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7}
# Fields of the MODIS state band, (bits, values that count).
MODIS_STATE = {"cloud": ((0, 1), (1, 2)), "cloud_shadow": ((2,), (1,)), "cirrus": ((8, 9), (1, 2, 3))}


def _some(values, what: str) -> list[int]:
    values = [int(v) for v in values]
    if not values:
        raise ValueError(f"{what} must not be empty")
    return values


def mask_from_qa_bits(qa: Column, bits, invert: bool = False) -> Column:
    """Whether any of the bits is set."""
    m = qa.bitwiseAND(F.lit(sum(1 << b for b in set(_some(bits, "bits"))))) != 0
    return ~m if invert else m


def mask_from_scl(scl: Column, classes, invert: bool = False) -> Column:
    m = scl.isin(_some(classes, "classes"))
    return ~m if invert else m


def mask_from_bit_field(qa: Column, bits, values, invert: bool = False) -> Column:
    """Whether the number in contiguous bits is one of values."""
    bits = sorted(_some(bits, "bits"))
    if bits != list(range(bits[0], bits[-1] + 1)):
        raise ValueError("bits must be contiguous")
    m = F.shiftright(qa, bits[0]).bitwiseAND(F.lit((1 << len(bits)) - 1)).isin(_some(values, "values"))
    return ~m if invert else m


def reduce_bit_masks(qa: Column, groups) -> Column:
    """Whether any bit of any group is set."""
    return reduce(lambda a, b: a | b, [mask_from_qa_bits(qa, g) for g in groups])


class _Mask(Operator):
    """Adds a boolean column `out`."""

    def __init__(self, out: str = "mask", **params):
        super().__init__(out=out, **params)

    def column(self) -> Column:
        raise NotImplementedError

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.params["out"], self.column())


class MaskFromQABits(_Mask):
    def __init__(self, bits, band: str = "qa", invert: bool = False, out: str = "mask"):
        super().__init__(out, bits=bits, band=band, invert=invert)

    def column(self):
        return mask_from_qa_bits(F.col(self.params["band"]), self.params["bits"], self.params["invert"])


class MaskFromSCL(_Mask):
    def __init__(self, classes, band: str = "scl", invert: bool = False, out: str = "mask"):
        super().__init__(out, classes=classes, band=band, invert=invert)

    def column(self):
        return mask_from_scl(F.col(self.params["band"]), self.params["classes"], self.params["invert"])


class DecodeBitmask(Operator):
    """A boolean column for each name: any or all of its bits."""

    def __init__(self, bits: dict[str, list[int]], mode: str = "any", band: str = "qa"):
        if mode not in ("any", "all"):
            raise ValueError("mode is any or all")
        if not bits:
            raise ValueError("bits must not be empty")
        super().__init__(bits=bits, mode=mode, band=band)

    def apply(self, df: DataFrame) -> DataFrame:
        qa = F.col(self.params["band"])
        out = {}
        for name, bits in self.params["bits"].items():
            if self.params["mode"] == "any":
                out[name] = mask_from_qa_bits(qa, bits)
            else:
                want = sum(1 << b for b in set(_some(bits, "bits")))
                out[name] = qa.bitwiseAND(F.lit(want)) == want
        return df.withColumns(out)


class MaskValid(_Mask):
    """True where the value is the sentinel, which marks INVALID pixels."""

    def __init__(self, invalid_value, band: str = "v", out: str = "mask"):
        super().__init__(out, invalid_value=invalid_value, band=band)

    def column(self):
        v, bad = F.col(self.params["band"]), self.params["invalid_value"]
        return F.isnan(v) if isinstance(bad, float) and bad != bad else v == F.lit(bad)


class _BitsOrValues(_Mask):
    def __init__(self, bits=None, values=None, band: str = "qa", mode: str = "any", out: str = "mask"):
        if bits is None and values is None:
            raise ValueError("give bits or values")
        super().__init__(out, bits=bits, values=values, band=band, mode=mode)

    def column(self):
        p, qa = self.params, F.col(self.params["band"])
        if p["values"] is not None:
            return qa.isin(_some(p["values"], "values"))
        want = sum(1 << b for b in set(_some(p["bits"], "bits")))
        return qa.bitwiseAND(F.lit(want)) == want if p["mode"] == "all" else qa.bitwiseAND(F.lit(want)) != 0


class MaskClouds(_BitsOrValues):
    pass


class MaskCloudShadow(_BitsOrValues):
    pass


class MaskCirrus(_BitsOrValues):
    pass


class MaskSnow(_BitsOrValues):
    pass


class MaskWater(_BitsOrValues):
    pass


class MaskNoData(_Mask):
    """QA bits or values if given, else any of the bands at the fill value."""

    def __init__(self, bands=("v",), fill=None, bits=None, values=None, band: str = "qa", out: str = "mask"):
        super().__init__(out, bands=bands, fill=fill, bits=bits, values=values, band=band)

    def column(self):
        p = self.params
        if p["bits"] is not None or p["values"] is not None:
            return _BitsOrValues(p["bits"], p["values"], p["band"]).column()
        same = lambda b: F.isnan(b) if p["fill"] != p["fill"] else F.col(b) == F.lit(p["fill"])
        return reduce(lambda a, b: a | b, [same(b) for b in p["bands"]])


class MaskSaturated(_Mask):
    """Any band at the saturation value."""

    def __init__(self, bands, saturation_value, out: str = "mask"):
        super().__init__(out, bands=bands, saturation_value=saturation_value)

    def column(self):
        return reduce(lambda a, b: a | b, [F.col(b) == F.lit(self.params["saturation_value"]) for b in self.params["bands"]])


class S2QA60(_Mask):
    def __init__(self, band: str = "qa", out: str = "mask"):
        super().__init__(out, band=band)

    def column(self):
        return mask_from_qa_bits(F.col(self.params["band"]), QA60.values())


class S2SCL(_Mask):
    """True outside the classes to keep."""

    def __init__(self, band: str = "scl", keep=("vegetation", "soil", "water"), out: str = "mask"):
        super().__init__(out, band=band, keep=keep)

    def column(self):
        return mask_from_scl(F.col(self.params["band"]), [SCL[k] for k in self.params["keep"]], invert=True)


class LandsatQA_PIXEL(_Mask):
    def __init__(self, band: str = "qa", targets=("cloud", "cloud_shadow"), sensor: str = "l89", out: str = "mask"):
        known = {k: v for k, v in QA_PIXEL.items() if sensor != "l7" or k != "cirrus"}
        if wrong := [t for t in targets if t not in known]:
            raise ValueError(f"unknown targets {wrong}")
        super().__init__(out, band=band, targets=targets, sensor=sensor)

    def column(self):
        return mask_from_qa_bits(F.col(self.params["band"]), [QA_PIXEL[t] for t in self.params["targets"]])


class MODISStateQA(_Mask):
    def __init__(self, band: str = "qa", targets=("cloud", "cloud_shadow"), out: str = "mask"):
        super().__init__(out, band=band, targets=targets)

    def column(self):
        qa = F.col(self.params["band"])
        return reduce(lambda a, b: a | b, [mask_from_bit_field(qa, *MODIS_STATE[t]) for t in self.params["targets"]])
