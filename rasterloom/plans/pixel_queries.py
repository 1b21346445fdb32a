"""Queries of per-pixel operators: indices, radiometry, quality bits, band mathematics, scaling, display."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.numeric import tidy
from ..operators import indices as ix
from ..operators import normalize as nz
from ..operators import qa, spectral, viz
from ..operators import radiometry as rad
from ..operators.core import Expression
from .fixtures import CUBE, PX, cube, px
from .registry import add, per_pixel, query

_E = "1e-10"


def _nd(a: str, b: str) -> str:
    return f"(({a}) - ({b})) / (({a}) + ({b}) + {_E})"


_RB = "(red - (blue - red))"
for name, op, sql in (
    ("idx_normalized_difference", ix.NormalizedDifference(a="green", b="red"), _nd("green", "red")),
    ("idx_ndvi", ix.NDVI(), _nd("nir", "red")),
    ("idx_ndwi", ix.NDWI(), _nd("green", "nir")),
    ("idx_ndbi", ix.NDBI(), _nd("swir", "nir")),
    ("idx_nbr", ix.NBR(), _nd("nir", "swir2")),
    ("idx_savi", ix.SAVI(), f"(nir - red) / (nir + red + 0.5 + {_E}) * 1.5"),
    ("idx_evi", ix.EVI(), f"2.5 * (nir - red) / (nir + 6 * red - 7.5e0 * blue + 1 + {_E})"),
    ("idx_evi2", ix.EVI2(), f"2.5 * (nir - red) / (nir + 2.4e0 * red + 1 + {_E})"),
    ("idx_arvi", ix.ARVI(), _nd("nir", _RB)),
    ("idx_gci", lambda: ix.gci(F.col("nir"), F.col("green") + 0.01), f"nir / (green + 0.01e0 + {_E}) - 1"),
    ("idx_kndvi", ix.kNDVI(), f"tanh(power({_nd('nir', 'red')}, 2))"),
    ("idx_mndwi", ix.MNDWI(), _nd("green", "swir")),
    ("idx_ndmi", ix.NDMI(), _nd("nir", "swir")),
    ("idx_ndsi", ix.NDSI(), _nd("green", "swir")),
    ("idx_nbr2", ix.NBR2(), _nd("swir", "swir2")),
    ("idx_bais2", ix.BAIS2(), f"(1 - sqrt(re1 * re2 * nir / (red + {_E}))) * ((swir2 - nir) / sqrt(swir2 + nir + {_E}) + 1)"),
    ("idx_bsi", ix.BSI(), _nd("swir + red", "nir + blue")),
    ("idx_iron_oxide", ix.IronOxide(blue="nir"), f"red / (nir + {_E})"),
    ("idx_clay_minerals", ix.ClayMinerals(swir2="nir"), f"swir / (nir + {_E})"),
    ("idx_ciri", ix.CIRI(), "swir2"),
    ("idx_append", ix.NDVI(), _nd("nir", "red")),
    ("rad_to_float32", rad.ToFloat32(), "nir::float::double"),
    ("rad_dn_to_radiance", rad.DNToRadiance(gain=0.01, offset=2.0, scale=2.0), "0.01e0 * qa / 2e0 + 2e0"),
    ("rad_radiance_to_dn", rad.RadianceToDN(gain=0.01, offset=0.1, scale=2.0), "(nir - 0.1e0) * 2e0 / 0.01e0"),
    ("rad_dn_to_reflectance", rad.DNToReflectance(scale=1e-4, offset=-0.1), "1e-4 * qa - 0.1e0"),
    ("rad_min_max", rad.MinMax(vmin=0.1, vmax=0.6), "least(greatest((nir - 0.1e0) / (0.6e0 - 0.1e0), 0e0), 1e0)"),
    ("rad_gamma", rad.Gamma(g=1.2), "power(greatest(nir, 0e0), 1e0 / 1.2e0)"),
    ("rad_brightness_temperature", rad.BTFromRadiance(), "1321.0789e0 / ln(774.8853e0 / nir + 1)"),
    ("rad_radiance_to_reflectance", rad.RadianceToReflectance(irradiance=2.0, factor=math.pi), "nir * (pi() / 2e0)"),
    ("rad_reflectance_to_radiance", rad.ReflectanceToRadiance(irradiance=2.0, factor=math.pi), "nir * (2e0 / pi())"),
    ("norm_log", nz.LogScale(), "log10(greatest(nir, 0e0) + 1e-6)"),
    ("norm_asinh", nz.AsinhScale(a=0.5), "asinh(nir / 0.5e0)"),
    ("norm_power", nz.PowerScale(gamma=0.5), "sqrt(greatest(nir, 0e0))"),
    ("norm_fixed", nz.Normalize(mean=0.4, std=0.2), "(nir - 0.4e0) / 0.2e0"),
    ("spec_band_ratio", spectral.BandRatio(), "nir / (red + 1e-6)"),
    ("spec_normalized_difference", spectral.SpectralND(), "(nir - red) / (nir + red + 1e-6)"),
):
    per_pixel(name, op.column if isinstance(op, Expression) else op, sql)

per_pixel("spec_band_math", lambda: spectral.evaluate_band_math("clip(sqrt(abs(nir - red)) ** 2 + log(nir + 1) / exp(-blue), 0.1, 2) + where(nir - 0.5, 1, 2) * maximum(red, blue) - minimum(green, -red)", ["nir", "red", "blue", "green"]), "least(greatest(power(sqrt(abs(nir - red)), 2) + ln(nir + 1) / exp(-blue), 0.1e0), 2e0) + case when nir - 0.5e0 <> 0 then 1e0 else 2e0 end * greatest(red, blue) - least(green, -red)")
per_pixel("rad_earth_sun_distance", lambda: rad.earth_sun_distance(F.col("t")), "1 - 0.01673e0 * cos(0.0172e0 * (dayofyear(t) - 4))")
_G = "(2 * pi() / 365 * (dayofyear(t) - 1 + (hour(t) + minute(t) / 60e0 + second(t) / 3600e0 - 12) / 24e0))"
_H = "(hour(t) + minute(t) / 60e0 + second(t) / 3600e0)"
_EQ = f"(229.18e0 * (0.000075e0 + 0.001868e0 * cos({_G}) - 0.032077e0 * sin({_G}) - 0.014615e0 * cos(2 * {_G}) - 0.040849e0 * sin(2 * {_G})))"
_DEC = f"(0.006918e0 - 0.399912e0 * cos({_G}) + 0.070257e0 * sin({_G}) - 0.006758e0 * cos(2 * {_G}) + 0.000907e0 * sin(2 * {_G}) - 0.002697e0 * cos(3 * {_G}) + 0.00148e0 * sin(3 * {_G}))"
per_pixel("rad_solar_zenith", lambda: rad.sza(F.col("x").cast("double"), F.col("y").cast("double"), F.col("t")), f"degrees(acos(sin(radians(y)) * sin({_DEC}) + cos(radians(y)) * cos({_DEC}) * cos(radians(({_H} * 60 + {_EQ} + 4 * x) / 4 - 180))))")
per_pixel("viz_gamma_display", lambda: viz.gamma_correct_display(F.col("nir"), 2.0), "sqrt(least(greatest(nir, 0e0), 1e0))")

_qa = lambda: F.col("qa")
for name, column, sql in (
    ("qa_bits", lambda: qa.mask_from_qa_bits(_qa(), [3, 4]), "(qa & 24) <> 0"),
    ("qa_bits_inverted", lambda: qa.mask_from_qa_bits(_qa(), [2, 9], invert=True), "(qa & 516) = 0"),
    ("qa_scl", lambda: qa.mask_from_scl(_qa() % 12, [8, 9, 10]), "(qa % 12) in (8, 9, 10)"),
    ("qa_bit_field", lambda: qa.mask_from_bit_field(_qa(), [8, 9], [1, 2]), "((qa >> 8) & 3) in (1, 2)"),
    ("qa_reduce_groups", lambda: qa.reduce_bit_masks(_qa(), [[1], [5, 6]]), "(qa & 2) <> 0 or (qa & 96) <> 0"),
    ("qa_s2_qa60", lambda: qa.S2QA60().column(), "(qa & 3072) <> 0"),
    ("qa_s2_scl", lambda: qa.mask_from_scl(_qa() % 12, [4, 5, 6], invert=True), "(qa % 12) not in (4, 5, 6)"),
    ("qa_landsat", lambda: qa.LandsatQA_PIXEL().column(), "(qa & 24) <> 0"),
    ("qa_landsat_all", lambda: qa.LandsatQA_PIXEL(targets=("fill", "dilated_cloud", "cirrus", "snow", "water")).column(), "(qa & 167) <> 0"),
    ("qa_modis_state", lambda: qa.MODISStateQA(targets=("cloud", "cloud_shadow", "cirrus")).column(), "(qa & 3) in (1, 2) or (qa & 4) <> 0 or ((qa >> 8) & 3) in (1, 2, 3)"),
    ("qa_valid_sentinel", lambda: qa.MaskValid(0.0, "green").column(), "green = 0"),
    ("qa_clouds", lambda: qa.MaskClouds(bits=[3]).column(), "(qa & 8) <> 0"),
    ("qa_cloud_shadow", lambda: qa.MaskCloudShadow(bits=[4]).column(), "(qa & 16) <> 0"),
    ("qa_cirrus_all_bits", lambda: qa.MaskCirrus(bits=[2, 3], mode="all").column(), "(qa & 12) = 12"),
    ("qa_snow", lambda: qa.MaskSnow(bits=[5]).column(), "(qa & 32) <> 0"),
    ("qa_water_values", lambda: qa.MaskWater(values=[6, 7, 8]).column(), "qa in (6, 7, 8)"),
    ("qa_no_data", lambda: qa.MaskNoData(bands=("green", "blue"), fill=0.0).column(), "green = 0 or blue = 0"),
    ("qa_saturated", lambda: qa.MaskSaturated(["red", "swir"], 1.0).column(), "red = 1 or swir = 1"),
    ("restore_saturation_flag", lambda: F.col("red") >= 0.98, "red >= 0.98e0"),
    ("mask_bbox", lambda: F.col("x").between(10, 20) & F.col("y").between(5, 30), "x between 10 and 20 and y between 5 and 30"),
):
    per_pixel(name, column, sql, exact=True)


@query("qa_decode_bitmask", f"select scene, y, x, (qa & 8) <> 0 cloud, (qa & 20) = 20 both, from {PX}".replace(" both, from", " both_bits from"))
def qa_decode_bitmask(spark, sf_dir):
    df = qa.DecodeBitmask({"cloud": [3]})(px(spark, sf_dir))
    return qa.DecodeBitmask({"both_bits": [2, 4]}, mode="all")(df).select("scene", "y", "x", "cloud", "both_bits")


@query("qa_scl_classes", "select unnest(['no_data', 'saturated', 'dark', 'cloud_shadow', 'vegetation', 'soil', 'water', 'unclassified', 'cloud_medium', 'cloud_high', 'cirrus', 'snow']) \"name\", unnest(range(12)) \"value\"")
def qa_scl_classes(spark, sf_dir):
    return spark.createDataFrame(list(qa.SCL.items()), "name string, value long")


@query("idx_dnbr", f"with b as (select y, x, avg(nir) n, avg(swir2) s from {PX} where scene = 0 group by 1, 2), a as (select y, x, avg(nir) n, avg(swir2) s from {PX} where scene = 1 group by 1, 2) select y, x, round((b.n - b.s) / (b.n + b.s + {_E}) - (a.n - a.s) / (a.n + a.s + {_E}), 6) + 0.0 v from b join a using (y, x)")
def idx_dnbr(spark, sf_dir):
    one = lambda k: px(spark, sf_dir).where(F.col("scene") == k).groupBy("y", "x").agg(F.avg("nir").alias("nir"), F.avg("swir2").alias("swir2"))
    return ix.dNBR(keys=("y", "x"))(one(0), one(1)).select("y", "x", tidy(F.col("dnbr")).alias("v"))


@query("spec_select_bands", f"select scene, y, x, red + 0.0 red, nir from {PX}")
def spec_select_bands(spark, sf_dir):
    return spectral.select_bands(px(spark, sf_dir), ["red", "nir"]).withColumn("red", F.col("red") + 0.0)


@query("spec_to_long", f"select scene, y, x, 0 band, red + 0.0 v from {PX} union all select scene, y, x, 1, nir from {PX}")
def spec_to_long(spark, sf_dir):
    return spectral.to_long(px(spark, sf_dir), ["red", "nir"]).withColumn("band", F.col("band").cast("int"))


@query("spec_stack_bands", f"select pixel, band, v from {CUBE} where band < 3 union all select pixel, band, v from {CUBE} where band between 3 and 4")
def spec_stack_bands(spark, sf_dir):
    c = cube(spark, sf_dir).select("pixel", "band", "v")
    return spectral.stack_bands(c.where("band < 3"), c.where("band between 3 and 4").withColumn("band", F.col("band") - 3), sizes=[3, 2])


@query("spec_binning_mean", f"select pixel, case when band between 5 and 15 then 0 else 1 end::bigint target, round(avg(v), 6) + 0.0 v from {CUBE} where band between 5 and 15 or band between 35 and 45 group by 1, 2")
def spec_binning_mean(spark, sf_dir):
    out = spectral.spectral_binning(cube(spark, sf_dir), [400 + 10 * b for b in range(64)], [500, 800], 100, ["pixel"])
    return out.select("pixel", F.col("target").cast("long").alias("target"), tidy(F.col("v")).alias("v"))


@query("spec_binning_gaussian", f"select pixel, round(sum(v * exp(-0.5e0 * power((400 + 10 * band - 500) / 50e0, 2))) / sum(exp(-0.5e0 * power((400 + 10 * band - 500) / 50e0, 2))), 6) + 0.0 v from {CUBE} where band between 5 and 15 group by 1")
def spec_binning_gaussian(spark, sf_dir):
    return spectral.spectral_binning(cube(spark, sf_dir), [400 + 10 * b for b in range(64)], [500], 100, ["pixel"], "gaussian").select("pixel", tidy(F.col("v")).alias("v"))


@query("spec_moving_average", f"select pixel, band, round(sum(v) over (partition by pixel order by band rows between 3 preceding and 3 following) / 7e0, 6) + 0.0 v from {CUBE}")
def spec_moving_average(spark, sf_dir):
    return spectral.spectral_smoothing(cube(spark, sf_dir), ["pixel"], "moving_average", 7).select("pixel", "band", tidy(F.col("v")).alias("v"))


_SG = spectral.savgol_weights(5, 2)


@query("spec_savgol", "with c as (select *, first(v) over w f, last(v) over w l from " + CUBE + " window w as (partition by pixel order by band rows between unbounded preceding and unbounded following)) select pixel, band, round(" + " + ".join(f"coalesce({'lag' if k < 0 else 'lead'}(v, {abs(k)}) over (partition by pixel order by band), {'f' if k < 0 else 'l'}) * ({w!r}::double)" for k, w in zip(range(-2, 3), _SG, strict=True)) + ", 6) + 0.0 v from c")
def spec_savgol(spark, sf_dir):
    return spectral.spectral_smoothing(cube(spark, sf_dir), ["pixel"], "savgol", 5, 2).select("pixel", "band", tidy(F.col("v")).alias("v"))


@query("spec_continuum_linear", f"with c as (select *, first(v) over w f, last(v) over w l from {CUBE} window w as (partition by pixel order by band rows between unbounded preceding and unbounded following)) select pixel, band, round(v / case when f + (l - f) * band / 63e0 = 0 then 1 else f + (l - f) * band / 63e0 end, 4) + 0.0 v from c where abs(f + (l - f) * band / 63e0) > 1e-2")
def spec_continuum_linear(spark, sf_dir):
    c = cube(spark, sf_dir)
    out = spectral.continuum_removal(c, ["pixel"])
    ends = c.where("band in (0, 63)").groupBy("pixel").agg(F.max(F.when(F.col("band") == 0, F.col("v"))).alias("f"), F.max(F.when(F.col("band") == 63, F.col("v"))).alias("l"))
    kept = out.join(ends, "pixel").where(F.abs(F.col("f") + (F.col("l") - F.col("f")) * F.col("band") / 63.0) > 1e-2)
    return kept.select("pixel", "band", tidy(F.col("v"), 4).alias("v"))


@query("spec_apply_srf", f"select pixel, round(sum(v * (band + 1)) / sum(band + 1), 6) + 0.0 v from {CUBE} where band < 10 group by 1")
def spec_apply_srf(spark, sf_dir):
    w = spark.range(10).select(F.lit(0).alias("target"), F.col("id").alias("band"), (F.col("id") + 1).cast("double").alias("w"))
    return spectral.apply_srf(cube(spark, sf_dir), w, ["pixel"]).select("pixel", tidy(F.col("v")).alias("v"))


@query("spec_gaussian_srf", f"with s as (select *, 50 / (2 * sqrt(2 * ln(2e0))) s from {CUBE}), w as (select pixel, v, exp(-0.5e0 * power((400 + 10 * band - 600) / s, 2)) w, sum(exp(-0.5e0 * power((400 + 10 * band - 600) / s, 2))) over (partition by pixel) a from s) select pixel, round(sum(v * w) / sum(w), 6) + 0.0 v from w where w / a > 1e-4 group by 1")
def spec_gaussian_srf(spark, sf_dir):
    w = spectral.gaussian_srf(spark, [600.0], [50.0], [400.0 + 10 * b for b in range(64)])
    return spectral.apply_srf(cube(spark, sf_dir), w, ["pixel"]).select("pixel", tidy(F.col("v")).alias("v"))


@query("rad_integrated_irradiance", "select 0 band, round(sum((1000 + id) * exp(-id / 10e0)) / sum(exp(-id / 10e0)), 6) + 0.0 irradiance from range(100) t(id) where exp(-id / 10e0) > 1e-4")
def rad_integrated_irradiance(spark, sf_dir):
    n = spark.range(100)
    srf = n.select(F.lit(0).alias("band"), F.col("id").alias("wavelength"), F.exp(-F.col("id") / 10.0).alias("w"))
    e = n.select(F.col("id").alias("wavelength"), (F.col("id") + 1000.0).alias("e"))
    return rad.integrated_irradiance(srf, e).select("band", tidy(F.col("irradiance")).alias("irradiance"))


@query("viz_true_color", f"select scene, y, x, red + 0.0 r, green + 0.0 g, blue + 0.0 b from {PX}")
def viz_true_color(spark, sf_dir):
    return viz.TrueColor()(px(spark, sf_dir)).select("scene", "y", "x", *[(F.col(c) + 0.0).alias(c) for c in "rgb"])


@query("viz_false_color", f"select scene, y, x, nir r, red + 0.0 g, green + 0.0 b from {PX}")
def viz_false_color(spark, sf_dir):
    return viz.FalseColor()(px(spark, sf_dir)).select("scene", "y", "x", *[(F.col(c) + 0.0).alias(c) for c in "rgb"])


@query("viz_swir_composite", f"select scene, y, x, swir2 r, nir g, red + 0.0 b from {PX}")
def viz_swir_composite(spark, sf_dir):
    return viz.SWIRComposite()(px(spark, sf_dir)).select("scene", "y", "x", *[(F.col(c) + 0.0).alias(c) for c in "rgb"])


@query("viz_colormap", f"select scene, y, x, [0.0, 0.25, 0.5, 1.0][1 + cast(floor(least(greatest(nir, 0e0), 1e0) * 3) as int)]::double v from {PX}")
def viz_colormap(spark, sf_dir):
    table = [(k, 0, 0, 1) for k in (0.0, 0.25, 0.5, 1.0)]
    return px(spark, sf_dir).select("scene", "y", "x", viz.rgba_from_scalar(F.col("nir"), table, 0.0, 1.0)[0].alias("v"))


@query("viz_discrete_colormap", f"select scene, y, x, case scene when 1 then 0.5e0 when 2 then 1e0 else 0e0 end v from {PX}")
def viz_discrete_colormap(spark, sf_dir):
    return px(spark, sf_dir).select("scene", "y", "x", viz.rgba_from_categories(F.col("scene"), {1: (0.5, 0, 0, 1), 2: (1, 0, 0, 1)})[0].alias("v"))


add("pipe_sequential", lambda s, d: (ix.NDVI(out="a") | ix.NDWI(out="b"))(px(s, d)).select("scene", "y", "x", tidy(F.col("a") + F.col("b")).alias("v")), f"select scene, y, x, round({_nd('nir', 'red')} + {_nd('green', 'nir')}, 6) + 0.0 v from {PX}")
