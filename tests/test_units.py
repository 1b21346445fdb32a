"""Operators on small inputs worked out by hand, and properties of the composition."""

from __future__ import annotations

import datetime as dt
import warnings

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterloom.checkpoints import stash
from rasterloom.functions import boxes, wkb
from rasterloom.operators import aggregations as ag
from rasterloom.operators import background as bg
from rasterloom.operators import components, core, kernels, learn
from rasterloom.operators import patches as pt
from rasterloom.operators import qa, spectral
from rasterloom.sources import slices
from rasterloom.sources.catalog import Catalog, CatalogMetadataError, open_catalog
from rasterloom.sources.items import Bundle
from rasterloom.streaming import events


def _grid(spark, n=12):
    return spark.range(n * n).select(F.floor(F.col("id") / n).alias("y"), (F.col("id") % n).alias("x"), F.col("id").cast("double").alias("v"))


def test_disjoint_tiles_give_the_field_back(spark):
    p = pt.SpatialPatcher((4, 4), (4, 4), aggregation=ag.SpatialOverlapAdd())
    g = _grid(spark)
    out = {(r.y, r.x): r.v for r in p.merge(p.split(g, (12, 12))).collect()}
    assert out == {(r.y, r.x): r.v for r in g.collect()}


def test_a_constant_field_stays_constant_under_overlaps(spark):
    p = pt.SpatialPatcher((5, 5), (2, 3), pt.triangular(2), ag.SpatialOverlapAdd(), boundary="shrink")
    g = _grid(spark).withColumn("v", F.lit(3.0))
    assert {round(r.v, 9) for r in p.merge(p.split(g, (12, 12))).collect()} == {3.0}


def test_aggregations_fill_uncovered_cells_their_own_way(spark):
    one = spark.createDataFrame([(0, 0, 2.0, 1.0, 1)], "y long, x long, v double, weight double, label int")
    domain = spark.createDataFrame([(0, 0), (0, 1)], "y long, x long")
    fill = {ag.SpatialSum: 0.0, ag.SpatialMean: 0.0, ag.SpatialMax: -np.inf, ag.SpatialMin: np.inf, ag.SpatialVariance: 0.0, ag.SpatialOverlapAdd: 0.0, ag.SpatialMode: 0.0, ag.SpatialHardVote: 0}
    for kind, want in fill.items():
        assert {r.x: r.v for r in kind().merge(one, domain).collect()}[1] == want
    assert np.isnan({r.x: r.v for r in ag.SpatialMedian().merge(one, domain).collect()}[1])


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 40), st.integers(1, 12), st.integers(1, 7))
def test_anchor_count(length, size, step):
    n = pt.RegularStride((step, step)).last(length, size, step, True) + 1
    assert n == len(range(0, max(length - size + 1, 1), step))


def test_full_scan_check():
    with pytest.raises(pt.IncompleteScanConfiguration):
        pt.RegularStride((4, 4), check_full_scan=True).last(10, 4, 4, True)


def test_quotas_by_largest_remainder():
    assert pt.quotas({0: 0.5, 1: 0.3, 2: 0.2}, 101) == {0: 51, 1: 30, 2: 20}


def test_samplers_depend_on_the_seed_alone(spark):
    rows = [sorted(map(tuple, pt.RandomAnchors(40, s).anchors(spark, (64, 64), (8, 8)).collect())) for s in (1, 1, 2)]
    assert rows[0] == rows[1] != rows[2]
    places = [(r.ay, r.ax) for r in pt.PoissonDisk(6.0, 1).anchors(spark, (64, 64), (8, 8)).collect()]
    assert min(np.hypot(a[0] - b[0], a[1] - b[1]) for i, a in enumerate(places) for b in places[:i]) >= 6


def test_stencil_ends():
    assert pt.Stencil(0, 3, 1).points() == [0, 1, 2]
    assert pt.Stencil(0, 3, 1, "right").points() == [1, 2, 3]
    assert pt.TimeStencil.of("-1h", "1h", "30min", "both").points() == [-3600, -1800, 0, 1800, 3600]
    with pytest.raises(ValueError):
        pt.Stencil(0, 1, 0.3)


def test_band_math_is_restricted():
    for text in ("__import__('os')", "a.b", "a < b", "c", "f(a)", "True"):
        with pytest.raises(ValueError):
            spectral.evaluate_band_math(text, {"a": F.lit(1.0), "b": F.lit(1.0)})


def test_qa_arguments():
    with pytest.raises(ValueError):
        qa.mask_from_qa_bits(F.lit(1), [])
    with pytest.raises(ValueError):
        qa.mask_from_bit_field(F.lit(1), [1, 3], [1])
    with pytest.raises(ValueError):
        qa.LandsatQA_PIXEL(targets=("cirrus",), sensor="l7")


def test_geoslice():
    t = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))
    assert slices.GeoSlice((0, 0, 10, 5), t, (1, 1)).shape == (5, 10)
    with pytest.raises(ValueError):
        slices.GeoSlice((0, 0, -1, 5), t, (1, 1))
    with pytest.raises(ValueError):
        slices.GeoSlice((0, 0, 10.5, 5), t, (1, 1), align="error")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert slices.GeoSlice((0, 0, 10.5, 5.2), t, (1, 1), align="snap").bounds == (0, -0.7999999999999998, 11, 5.2)


def test_catalog_round_trip_and_strict_open(spark, tmp_path):
    rows = [(f"f{i}", float(i), 0.0, i + 1.0, 1.0, dt.datetime(2024, 1, 1 + i), dt.datetime(2024, 1, 2 + i)) for i in range(9)]
    c = Catalog(spark.createDataFrame(rows, "filepath string, xmin double, ymin double, xmax double, ymax double, start_time timestamp, end_time timestamp"))
    c.write(str(tmp_path / "c"), partition_by=["year", "month"])
    back = open_catalog(spark, str(tmp_path / "c"), strict=True)
    assert back.count() == 9 and back.query(bounds=(3, 0, 4, 1)).count() == 3
    c.append(str(tmp_path / "c"), partition_by=["year", "month"])
    assert open_catalog(spark, str(tmp_path / "c")).count() == 18
    with pytest.raises(ValueError):
        c.append(str(tmp_path / "c"))
    c.df.write.parquet(str(tmp_path / "bare"))
    with pytest.raises(CatalogMetadataError):
        open_catalog(spark, str(tmp_path / "bare"), strict=True)
    with pytest.raises(TypeError):
        c.query(slices.GeoSlice((0, 0, 1, 1), (rows[0][5], rows[0][6]), (1, 1)), bounds=(0, 0, 1, 1))
    assert len(list(c.iter_rows())) == 9
    nothing = c.where("false").total_bounds().first()
    assert np.isnan(nothing.xmin)
    assert c.intersect(c).count() == 9 and c.intersect(c, drop_touching=False).count() == 25


def test_bundle_directory(spark, tmp_path):
    items = spark.createDataFrame([("a", "p")], "id string, filepath string")
    b = Bundle(items)
    b.to_directory(str(tmp_path / "b"))
    assert Bundle.from_directory(spark, str(tmp_path / "b")).items.count() == 1


def test_wkb():
    assert wkb.bounds(wkb.box(1, 2, 3, 5)) == (1, 2, 3, 5)
    rings = wkb.decode(wkb.polygon([(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (2, 1), (2, 2), (1, 2)]))
    assert wkb.inside(rings, np.array([0.5, 1.5, 5.0]), np.array([0.5, 1.5, 1.0])).tolist() == [True, False, False]
    assert wkb.area(rings[0]) == 16


def test_hilbert_key_is_a_walk_over_neighbours(spark):
    n = 8
    rows = spark.range(n * n).select((F.col("id") % n + 0.5).alias("x"), (F.floor(F.col("id") / n) + 0.5).alias("y"))
    got = rows.select("x", "y", boxes.curve_key(F.col("x"), F.col("y"), 3, (0, 0, n, n)).alias("k")).orderBy("k").collect()
    assert [r.k for r in got] == list(range(n * n))
    assert all(abs(a.x - b.x) + abs(a.y - b.y) == 1 for a, b in zip(got, got[1:], strict=False))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (3, 3)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert {got[k] for k in (2, 3)} == {1} and {got[k] for k in (8, 9)} == {7} and {got[100 + i] for i in range(1, 41)} == {100}
    assert components.components(links.where("false")).count() == 0


def test_matched_filter_is_one_on_the_target(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, bands array<double>")
    mean, cov, n = bg.mean_cov(df, 4)
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T))
    t = np.array([1.0, 2, 0, 1])
    w, o, _ = bg.filter_weights(mean, cov, t)
    assert abs(w @ (mean + t) - o - 1) < 1e-9
    bg.validate(cov, t)
    with pytest.raises(ValueError):
        bg.validate(cov, t * 0)
    assert bg.detection_threshold(0.05, np.eye(2), np.array([1.0, 0])) == pytest.approx(1.6448536)
    m, axes = bg.pca(df, 4, 4)
    both = df.select("bands", bg.reconstruct(bg.project(F.col("bands"), m, axes), m, axes).alias("back")).first()
    assert np.allclose(both.bands, both.back)


def test_scene_kernels(spark):
    a = np.zeros((20, 20))
    a[8:12, 8:12] = 1
    assert kernels.blob_log(a, (2,), 0.1)[9:11, 9:11].any()
    assert kernels.canny(a).any() and not kernels.canny(np.ones((9, 9))).any()
    assert np.allclose(kernels.phase_shift(np.roll(a, (2, -3), (0, 1)), a), (-2, 3), atol=0.3)
    m = np.zeros((20, 20), int)
    m[0, 0], m[10, 10] = 1, 2
    assert set(np.unique(kernels.watershed(a, m))) == {1, 2}
    gap = a.copy()
    gap[9, 9] = np.nan
    assert np.isfinite(kernels.gap_fill_laplacian(gap)).all()
    assert kernels.chan_vese(a)[9, 9] and not kernels.chan_vese(a)[0, 0]
    assert len(np.unique(kernels.felzenszwalb(a, 1.0, 0.1, 4))) == 2
    assert kernels.hough_lines(np.eye(20, dtype=bool))[0][2] == 20
    assert kernels.contours(a, 0.5) and kernels.hog(a).shape == (2, 2, 9)
    g = _grid(spark).withColumn("scene", F.lit(1))
    out = kernels.per_scene(g, lambda x: x * 2)
    assert out.count() == 144 and out.where("v <> 2 * (y * 12 + x)").count() == 0


def test_learning(spark):
    rows = [(i, float(i % 2 * 10 + i * 0.01), 1.0 + i % 3) for i in range(60)] + [(60, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    km = learn.KMeans(["a", "b"], ["id"], k=2)(df)
    assert km.count() == 60 and km.select("prediction").distinct().count() == 2
    assert learn.PCA(["a", "b"], ["id"], k=1)(df).count() == 60
    far = spark.createDataFrame(rows[:60] + [(99, 500.0, 500.0)], "id long, a double, b double")
    scored = learn.isolation_forest(far, ["a", "b"]).orderBy(F.desc("anomaly")).first()
    assert scored.id == 99
    pts = spark.createDataFrame([(i, float(i % 5), float(i // 5)) for i in range(25)] + [(99, 30.0, 30.0)], "id long, px double, py double")
    assert learn.local_outlier_factor(pts, 3, 4.0).orderBy(F.desc("lof")).first().id == 99


def test_composition(spark):
    df = spark.createDataFrame([(0, 0, 0, 3.0)], "scene int, y int, x int, v double")
    add = core.Lambda(lambda d: d.withColumn("v", F.col("v") + 1))
    assert (add | add | core.Identity())(df).first().v == 5
    out = core.Graph({"a": (add, ["in"]), "b": (lambda x, y: x.unionAll(y), ["a", "in"])}, ["b"])(**{"in": df})
    assert sorted(r.v for r in out["b"].collect()) == [3, 4]
    assert core.Fanout(p=add, q=core.Const("k", 1))(df)["q"].first().k == 1
    assert core.Switch(lambda d: "x", {"x": add})(df).first().v == 4


def test_stream_appends_each_file_once_and_windows_close(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rows = spark.createDataFrame([("f", dt.datetime(2024, 1, k), dt.datetime(2024, 1, k)) for k in (1, 2)], "filepath string, start_time timestamp, end_time timestamp")
    rows.write.parquet(src)
    for _ in range(2):
        events.append_catalog(events.stream_of(spark, src, rows.schema), out, cp, ["year"]).awaitTermination(60)
        assert spark.read.parquet(out).count() in (2, 4)
        rows.write.mode("append").parquet(src)
    ev = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "k", 1.0) for h in (0, 1, 9)], "ts timestamp, kind string, value double")
    ev.write.parquet(str(tmp_path / "ev"))
    s = events.tumbling(events.stream_of(spark, str(tmp_path / "ev"), ev.schema), "1 hour", ["kind"])
    q = s.writeStream.format("memory").queryName("closed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select * from closed").count() == 3


def test_stash_survives_its_source(spark):
    a = spark.range(3).cache()
    b = stash(a, "t")
    a.unpersist()
    assert b.count() == 3


def test_item_searches(spark, tmp_path):
    import json

    from rasterloom.sources import search

    stac = [{"id": f"s{i}", "collection": "c", "bbox": [i, 0, i + 1, 1], "properties": {"datetime": f"2024-01-0{i + 1}T00:00:00Z", "k": str(i % 2)}, "assets": {"data": {"href": f"h{i}"}, "qa": {"href": "q"}}} for i in range(5)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.json").write_text("\n".join(map(json.dumps, stac)))
    s = search.StacSource(spark, str(tmp_path / "s"), "stac")
    assert [r.id for r in s.search(bounds=(1.5, 0, 3.5, 1), filters={"k": "1"}).orderBy("id").collect()] == ["s1", "s3"]
    row = s.search(limit=1).first()
    assert row.assets == {"data": "h0", "qa": "q"} and row.provenance == {"via": "stac"} and row.source == "stac"
    umm = {"GranuleUR": "g", "CollectionReference": {"ShortName": "C"}, "CloudCover": 12.5, "RelatedUrls": [{"URL": "https://h/p/file.tif", "Type": "GET DATA"}], "SpatialExtent": {"HorizontalSpatialDomain": {"Geometry": {"BoundingRectangles": [{"WestBoundingCoordinate": 1, "SouthBoundingCoordinate": 2, "EastBoundingCoordinate": 3, "NorthBoundingCoordinate": 4}]}}}, "TemporalExtent": {"SingleDateTime": "2024-01-01T00:00:00Z"}}
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.json").write_text(json.dumps({"meta": {}, "umm": umm}))
    row = search.GranuleSource(spark, str(tmp_path / "g"), "granules").search(collection="C").first()
    assert (row.id, row.xmin, row.ymax, row.assets, row.properties) == ("g", 1.0, 4.0, {"file": "https://h/p/file.tif"}, {"cloud_cover": "12.5"})


def test_staging_copies_once(spark, tmp_path):
    from rasterloom.sources import items

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.tif").write_text("x")
    c = Catalog(spark.createDataFrame([(f"file://{tmp_path}/in/a.tif",)], "filepath string"))
    staged = items.stage(c, str(tmp_path / "cache"))
    assert [r.status for r in items.copy_files(staged).collect()] == ["copied"]
    assert [r.status for r in items.copy_files(staged).collect()] == ["fresh"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    import json

    from rasterloom import __main__ as cli

    monkeypatch.setattr(cli, "local_session", lambda n: spark)
    rows = [("f", 0.0, 0.0, 1.0, 1.0, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))]
    Catalog(spark.createDataFrame(rows, "filepath string, xmin double, ymin double, xmax double, ymax double, start_time timestamp, end_time timestamp")).write(str(tmp_path / "c"))
    assert cli.main(["query", str(tmp_path / "c"), "--bbox", "0", "0", "9", "9", "--start", "2024-01-01"]) == 0
    assert json.loads(capsys.readouterr().out)["n"] == 1
    assert cli.main(["convert", str(tmp_path / "c"), "--out", str(tmp_path / "d"), "--partition-by", "year"]) == 0
    assert cli.main(["info", str(tmp_path / "d")]) == 0 and cli.main(["stats", str(tmp_path / "d")]) == 0
    assert cli.main(["migrate", str(tmp_path / "c"), "--out", str(tmp_path / "e"), "--to-version", "9"]) == 2


def test_spectra_queries_use_all_bands(spark):
    from rasterloom.operators import background as bg
    from rasterloom.plans import registry

    sf, run = "/root/testdata/sf0.001", registry.queries()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    x, label = np.array([r.embedding for r in rows], float), np.array([r.label for r in rows])
    target, mean = 1.0 + 0.5 * np.sin(np.arange(64)), x.mean(0)
    cov = np.cov(x.T)
    spread, q = np.linalg.eigh(cov)
    q = q[:, ::-1][:, :2]
    want = (x - mean) @ (q * np.sign(q[np.abs(q).argmax(0), [0, 1]]))
    got = {r.pixel: r.scores for r in run["mf_pca_scores"](spark, sf).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], want, atol=1e-5)

    def score(x, cov, own):
        w = np.linalg.solve(cov, target)
        return (x - own) @ w / (target @ w)

    got = {r.pixel: r.score for r in run["mf_matched_filter"](spark, sf).collect()}
    assert np.allclose([got[r.vec_id] for r in rows], score(x, bg.shrink_covariance(cov, len(x), "oas"), mean), atol=1e-5)
    assert {r.band for r in run["mf_huber_mean"](spark, sf).collect()} == set(range(64))
    got = {r.pixel: r.score for r in run["mf_cluster_filter"](spark, sf).collect()}
    want = {}
    for k in set(label):
        own = x[label == k]
        within = np.cov(own.T) + 1e-3 * np.eye(64)
        want |= dict(zip([r.vec_id for r in rows if r.label == k], score(own, within, own.mean(0)), strict=True))
    assert set(got) == set(want)
    assert all(abs(got[k] - v) <= 1e-5 for k, v in want.items())


def _field(spark, seed=3, h=9, w=7, holes=True):
    r = np.random.default_rng(seed)
    a = r.normal(5, 2, (h, w))
    if holes:
        a[r.random((h, w)) < 0.15] = np.nan
        a[0, 0] = np.nan
    rows = [(y, x, float(a[y, x])) for y in range(h) for x in range(w)]
    return a, spark.createDataFrame(rows, "y long, x long, v double")


def _array(df, shape, column="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = np.nan if r[column] is None else r[column]
    return out


def _windows(a, size, mode):
    k = size // 2
    p = np.pad(a, k, mode={"nearest": "edge", "reflect": "symmetric"}[mode])
    return np.lib.stride_tricks.sliding_window_view(p, (size, size)).reshape(*a.shape, -1)


def test_windows_repeat_the_border_and_keep_gaps(spark):
    from rasterloom.operators import restore

    a, df = _field(spark)
    gap = np.isnan(a)
    w = _windows(a, 3, "nearest")
    with np.errstate(all="ignore"):
        mean, var = np.nanmean(w, -1), np.nanvar(w, -1)
    cv = np.sqrt(var) / np.abs(mean)
    lee = mean + np.where(var > 0, 0.5 * var / (var + (0.523 * mean) ** 2), 0) * (a - mean)
    frost = np.exp(-2 * cv) * a + (1 - np.exp(-2 * cv)) * mean
    median = np.median(_windows(np.where(gap, np.nanmedian(a), a), 3, "nearest"), -1)
    d = np.arange(-4, 5)
    kernel = np.exp(-(d[:, None] ** 2 + d**2) / 2).ravel()
    near = _windows(a, 9, "nearest")
    gauss = np.nansum(near * kernel, -1) / (~np.isnan(near) * kernel).sum(-1)
    for got, want in ((restore.despeckle_lee(df, 3), lee), (restore.despeckle_frost(df, 3), frost), (restore.median_denoise(df, 3), median), (restore.gaussian_denoise(df, 1.0), gauss)):
        np.testing.assert_allclose(_array(got, a.shape), np.where(gap, np.nan, want), rtol=1e-9)


def test_adaptive_background_mirrors_the_border(spark):
    from rasterloom.operators import restore

    a, df = _field(spark, holes=False)
    w = _windows(a, 5, "reflect")
    got = restore.adaptive_background(df, 5)
    np.testing.assert_allclose(_array(got, a.shape, "mean"), w.mean(-1), rtol=1e-9)
    np.testing.assert_allclose(_array(got, a.shape, "var"), w.var(-1, ddof=1), rtol=1e-9)
    with pytest.raises(ValueError):
        restore.adaptive_background(df, 4)


def test_destripe_with_moment_matching(spark):
    from rasterloom.operators import restore

    a, df = _field(spark)
    profile = np.nanmean(a, 0, keepdims=True)
    out = a - (profile - np.nanmean(profile))
    want = np.where(np.isnan(a), np.nan, np.nanmean(_windows(out, 3, "nearest"), -1))
    np.testing.assert_allclose(_array(restore.destripe(df, method="moment_matching", window=3), a.shape), want, rtol=1e-9)
    with pytest.raises(ValueError):
        restore.destripe(df, method="other")


def test_shrinkage_by_both_estimates():
    from rasterloom.operators.background import shrink_covariance

    x = np.random.default_rng(1).normal(size=(500, 6)) * [1, 2, 3, 1, 1, 1]
    cov, n, p = np.cov(x.T), 500, 6
    mu = np.trace(cov) / p
    away = ((cov - mu * np.eye(p)) ** 2).sum()
    for method, share in (("ledoit_wolf", ((cov**2).sum() + np.trace(cov) ** 2 / p) / n / away), ("oas", ((1 - 2 / p) * (cov**2).sum() + np.trace(cov) ** 2) / ((n + 1) * away))):
        np.testing.assert_allclose(shrink_covariance(cov, n, method), (1 - min(1, share)) * cov + min(1, share) * mu * np.eye(p))
    with pytest.raises(ValueError):
        shrink_covariance(cov, n, "other")


def test_poisson_disks_fill_any_field(spark):
    import math

    from rasterloom.operators.patches import PoissonDisk

    at = [(r.ay, r.ax) for r in PoissonDisk(3.0, 5).anchors(spark, (120, 90), (8, 8)).collect()]
    assert all(math.hypot(a - c, b - d) >= 3 for i, (a, b) in enumerate(at) for c, d in at[:i])
    free = [(y, x) for y in range(113) for x in range(83) if all(math.hypot(y - a, x - b) >= 3 for a, b in at)]
    assert not free and len(at) > 700


def test_nearest_neighbours_far_away(spark):
    import math
    import random

    from rasterloom.operators.joins import knn_join

    r = random.Random(1)
    right = [(i, r.gauss(0, 1) + 50 * (i % 3), r.gauss(0, 1)) for i in range(300)] + [(300 + i, 7.0, 7.0) for i in range(5)]
    left = [(0, 0.0, 0.0), (1, 1e4, 3.0), (2, -500.0, 800.0), (3, 50.0, 1.0), (4, 7.0, 7.0)]
    got = {}
    for x in knn_join(spark.createDataFrame(left, "id long, px double, py double"), spark.createDataFrame(right, "id long, px double, py double"), 4, 0.05).collect():
        got.setdefault(x.l.id, {})[x["rank"]] = x.r.id
    for i, px, py in left:
        want = sorted(right, key=lambda p: (math.sqrt((px - p[1]) ** 2 + (py - p[2]) ** 2), p[0]))[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [p[0] for p in want]
    few = knn_join(spark.createDataFrame(left, "id long, px double, py double"), spark.createDataFrame(right[:2], "id long, px double, py double"), 4, 0.05)
    assert few.count() == 10
    assert knn_join(spark.createDataFrame(left, "id long, px double, py double").where("false"), spark.createDataFrame(right, "id long, px double, py double"), 4, 0.05).count() == 0


def test_numbers_over_a_table(spark):
    from rasterloom.operators.numbering import numbered

    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k").repartition(5)
    assert sorted((r.k, r.label) for r in numbered(df, ["k"]).collect()) == [(k, k + 1) for k in range(1000)]
    assert numbered(df.where("false"), ["k"]).count() == 0


def test_masks_are_checked(spark):
    from rasterloom.operators import masks

    df = spark.createDataFrame([(0, 0, True), (0, 1, False)], "y long, x long, mask boolean")
    for make in (lambda: masks.BBoxMask((1, 2, 3)), lambda: masks.CombineMasks("nand"), lambda: masks.CleanMask((2, 2), -1), lambda: masks.CombineMasks()([]), lambda: masks.CombineMasks("not")([df, df])):
        with pytest.raises(ValueError):
            make()
    assert [r.mask for r in masks.CombineMasks("NOT")([df]).orderBy("x").collect()] == [False, True]
    high = masks.AltitudeMask(spark.createDataFrame([(0, 0, float("nan"))], "y long, x long, v double"), high=3.0)
    assert [r.mask for r in high(df).collect()] == [False, False]
    v = spark.createDataFrame([(0, 0, 1.0, "a"), (0, 1, 2.0, "b"), (5, 5, 3.0, "c")], "y long, x long, v double, note string")
    assert sorted((r.x, r.v) for r in masks.ApplyMask(df, -1.0)(v).collect()) == [(0, -1.0), (1, 2.0), (5, 3.0)]


def _strips(order, pixels, kind, predictor=1, deflate=False, planes=False):
    """A file in strips of three rows, put together by hand."""
    import struct
    import zlib

    n, h, w = pixels.shape
    strips = []
    for plane in range(n if planes else 1):
        for i in range(0, h, 3):
            part = pixels[plane : plane + 1 if planes else n, i : i + 3].transpose(1, 2, 0)
            if predictor == 2:
                part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
            raw = part.astype(f"{order}{kind}").tobytes()
            if predictor == 3:
                rows = np.frombuffer(part.astype(f">{kind}").tobytes(), np.uint8).reshape(part.shape[0], -1, int(kind[1:])).transpose(0, 2, 1).reshape(part.shape[0], -1, n if not planes else 1)
                raw = np.concatenate([rows[:, :1], rows[:, 1:] - rows[:, :-1]], 1).astype(np.uint8).tobytes()
            strips.append(zlib.compress(raw) if deflate else raw)
    at = 8
    body = b"".join(strips)
    offsets = [at + sum(map(len, strips[:k])) for k in range(len(strips))]
    tags = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8 * int(kind[1:])] * n), (259, 3, [8 if deflate else 1]), (273, 4, offsets), (277, 3, [n]), (278, 3, [3]), (279, 4, [len(s) for s in strips]), (284, 3, [2 if planes else 1]), (317, 3, [predictor]), (339, 3, [{"u": 1, "i": 2, "f": 3}[kind[0]]] * n), (33550, 12, [10.0, 20.0, 0.0]), (33922, 12, [0.0, 0.0, 0.0, 500.0, 4000.0, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, 32630]), (42113, 2, b"7\0")]
    start = at + len(body)
    heap, entries = b"", b""
    for tag, t, values in tags:
        v = values if t == 2 else struct.pack(f"{order}{len(values)}{ {3: 'H', 4: 'I', 12: 'd'}[t]}", *values)
        place = v.ljust(4, b"\0") if len(v) <= 4 else struct.pack(order + "I", start + 2 + 12 * len(tags) + 4 + len(heap))
        heap += v if len(v) > 4 else b""
        entries += struct.pack(order + "HHI", tag, t, len(values)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, start) + body + struct.pack(order + "H", len(tags)) + entries + struct.pack(order + "I", 0) + heap


@pytest.mark.parametrize(("order", "kind", "predictor", "deflate", "planes"), [("<", "u2", 1, False, False), (">", "i4", 1, True, True), ("<", "u1", 2, True, False), (">", "u2", 2, True, True), ("<", "f4", 3, True, False), ("<", "f8", 1, True, False)])
def test_geotiff_files_of_others(spark, tmp_path, order, kind, predictor, deflate, planes):
    from rasterloom.sources import geotiff

    pixels = np.random.default_rng(2).integers(0, 200, (3, 11, 8))
    (tmp_path / "a.tif").write_bytes(_strips(order, pixels, kind, predictor, deflate, planes))
    h = geotiff.headers(spark, str(tmp_path)).first()
    assert (h.xmin, h.ymin, h.xmax, h.ymax, h.crs, h.width, h.height, h.bands) == (500.0, 3780.0, 580.0, 4000.0, "EPSG:32630", 8, 11, 3)
    want = np.where(pixels == 7, np.nan, pixels.astype(float))

    def got(df):
        return {(r.band, r.y, r.x): r.v for r in df.collect()}

    def same(rows, bands, ys, xs):
        assert set(rows) == {(b, y, x) for b in bands for y in ys for x in xs}
        assert all((np.isnan(v) and np.isnan(want[b - 1, y, x])) or v == want[b - 1, y, x] for (b, y, x), v in rows.items())

    same(got(geotiff.read(spark, str(tmp_path))), (1, 2, 3), range(11), range(8))
    same(got(geotiff.read(spark, str(tmp_path), window=(2, 5, 7, 99), bands=[3])), (3,), range(2, 9), range(5, 8))
    same(got(geotiff.read(spark, str(tmp_path), bounds=(515.0, 3900.0, 540.0, 3950.0))), (1, 2, 3), range(2, 5), range(1, 4))
    assert geotiff.read(spark, str(tmp_path), bounds=(0.0, 0.0, 1.0, 1.0)).count() == 0


def test_geotiff_round_trip(spark, tmp_path):
    from rasterloom.sources import geotiff

    rows = [(s, b, y, x, float(s * 1000 + b * 100 + y * 10 + x)) for s in (1, 2) for b in (1, 2) for y in range(9) for x in range(5) if (y, x) != (3, 3)]
    df = spark.createDataFrame(rows, "scene long, band int, y long, x long, v double")
    geotiff.write(df, str(tmp_path / "w"), (9, 5), by=["scene"], transform=(2.0, 0.0, 10.0, 0.0, -2.0, 50.0), epsg=4326, dtype="int16", nodata=-1.0, tile=4)
    h = geotiff.headers(spark, str(tmp_path / "w")).collect()
    assert len(h) == 2 and {(x.crs, x.xmin, x.ymax, x.xmax, x.ymin) for x in h} == {("EPSG:4326", 10.0, 50.0, 20.0, 32.0)}
    back = geotiff.read(spark, str(tmp_path / "w")).collect()
    assert sorted(r.v for r in back if not np.isnan(r.v)) == sorted(r[4] for r in rows)
    assert sum(np.isnan(r.v) for r in back) == 4 and all((r.y, r.x) == (3, 3) for r in back if np.isnan(r.v))
    tile = geotiff.read_tile(spark, str(tmp_path / "w"), 1, 0, (4, 4), [2]).collect()
    assert {(r.band, r.y, r.x) for r in tile} == {(2, y, x) for y in range(4, 8) for x in range(4)}
    with pytest.raises(ValueError):
        geotiff.parse(b"no file")


def test_histogram_match_reads_no_frame_anew_for_every_row(spark):
    from rasterloom.operators.normalize import histogram_match

    r = np.random.default_rng(3)
    a, b = r.integers(0, 50, 400) / 7.0, r.normal(3, 2, 300)
    df = lambda x: spark.createDataFrame([(0, float(v)) for v in x], "k long, v double")
    out = histogram_match(df(a), df(b), ["k"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("specifiedwindowframe(rowframe, unboundedpreceding$(), unboundedfollowing$())", "")
    values, counts = np.unique(a, return_counts=True)
    known, many = np.unique(b, return_counts=True)
    want = dict(zip(values, np.interp(np.cumsum(counts) / 400, np.cumsum(many) / 300, known), strict=True))
    assert all(abs(x.matched - want[x.v]) < 1e-9 for x in out.collect())
    assert out.count() == 400


@pytest.mark.parametrize("limit", ["1000", "100"])
def test_samples_of_classes_are_cut_before_they_meet(spark, limit):
    rows = [(i, i % 3) for i in range(4000)]
    key = "spark.sql.optimizer.windowGroupLimitThreshold"
    spark.conf.set(key, limit)
    try:
        out = pt.stratified_sample(spark.createDataFrame(rows, "id long, c long"), "c", {0: 200, 1: 5, 2: 9000 if limit == "100" else 1}, ["id"], 7)
        got = {(r.c, r.id) for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(key)
    assert "WindowGroupLimit" in plan or "_part" in plan
    from rasterloom.functions.numeric import uniform

    order = [r.id for r in spark.createDataFrame(rows, "id long, c long").orderBy(uniform(7, "id"), "id").collect()]
    some = lambda c, n: {(c, i) for i in [i for i in order if i % 3 == c][:n]}
    assert got == some(0, 200) | some(1, 5) | some(2, 9000 if limit == "100" else 1)


def test_min_cloud_composite_orders_counts_not_rows(spark):
    from rasterloom.operators.compositing import min_cloud_composite

    rows = [(0, 0, "a", True, 4.0), (0, 0, "a", True, 3.0), (0, 0, "b", True, 1.0), (0, 1, "a", False, 9.0), (0, 1, "b", False, 8.0), (1, 0, "b", True, None), (1, 0, "b", True, 2.0), (1, 1, "b", False, 5.0)]
    out = min_cloud_composite(spark.createDataFrame(rows, "y long, x long, scene string, clear boolean, v double"), "clear", "v")
    assert {(r.y, r.x): (r.v, r.n) for r in out.collect()} == {(0, 0): (3.0, 3), (0, 1): (9.0, 0), (1, 0): (None, 2), (1, 1): (5.0, 0)}
    plan = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert "min_by" in plan[0] and "min_by" not in plan[-1]


@pytest.mark.parametrize("join", ["all", "any"])
def test_nearest_matches_make_no_pairs(spark, join):
    import random

    from rasterloom.operators import matchup as mu

    r = random.Random(5)
    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)

    def row(i, most):
        x, y, w, t = r.uniform(-9, 9), r.uniform(-9, 9), r.choice([0.0, 0.5, 1.0, most]), r.randrange(40)
        return (i, x, y, x + w, y + w / 2, day(t), day(t + r.randrange(3)))

    left, right = [row(i, 30.0) for i in range(300)] + [(300, None, 0.0, 1.0, 1.0, day(1), day(2))], [row(i, 3.0) for i in range(200)]
    right += [(1000 + i, *right[7][1:]) for i in range(300)]
    schema = "id long, xmin double, ymin double, xmax double, ymax double, start_time timestamp, end_time timestamp"
    two = {"a": [x for x in right if x[0] % 2 == 0], "b": [x for x in right if x[0] % 2]}
    out = mu.matchup(spark.createDataFrame(left, schema), {k: spark.createDataFrame(v, schema) for k, v in two.items()}, spatial=mu.Contains(), temporal=mu.NearestInTime(5 * 86400.0), join=join)
    mid = lambda a: (a[5].timestamp() + a[6].timestamp()) / 2
    want = set()
    for p in left[:-1]:
        ids = [p[0]]
        for s in two.values():
            near = [q for q in s if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2] and abs(mid(p) - mid(q)) <= 5 * 86400]
            q = min(near, key=lambda q: (abs(mid(p) - mid(q)), q[0]), default=None)
            if q and p[1] <= q[1] and p[2] <= q[2] and p[3] >= q[3] and p[4] >= q[4]:
                ids.append(q[0])
        if len(ids) == 3 or join == "any" and len(ids) == 2:
            want.add(tuple(ids))
    assert len(want) > 5
    assert {tuple(x.member_ids) for x in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_neighbours_of_crowded_places_meet_few_points(spark, monkeypatch):
    import math
    import random

    from rasterloom.operators import joins

    r = random.Random(2)
    points = [(i, 3.0, 4.0) for i in range(400)] + [(400 + i, r.random() / 3, r.random() / 3) for i in range(600)] + [(1000, 9.0, -7.0)]
    met, plain = [], joins.radius_join

    def counted(*args):
        out = plain(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(joins, "radius_join", counted)
    df = spark.createDataFrame(points, "id long, px double, py double")
    got = {(x.l.id, x["rank"]): (x.r.id, x.distance) for x in joins.knn_join(df, df, 3, 0.5).collect()}
    assert sum(met) < 100 * len(points)
    for i, x, y in points:
        want = sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), j) for j, a, b in points)[:3]
        assert [got[i, k] for k in (1, 2, 3)] == [(j, d) for d, j in want]
    assert len(got) == 3 * len(points)


def test_pairs_of_a_single_role_are_joined_once(spark):
    from rasterloom.operators import matchup as mu

    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)
    df = spark.createDataFrame([(i, i * 0.5, 0.0, i * 0.5 + 1, 1.0, day(i), day(i + 1)) for i in range(20)], "id long, xmin double, ymin double, xmax double, ymax double, start_time timestamp, end_time timestamp")
    out = mu.matchup(df, {"b": df}, spatial=mu.IouAtLeast(0.3), temporal=mu.WithinWindow(-86400.0, 86400.0))
    assert {tuple(r.member_ids) for r in out.collect()} == {(i, j) for i in range(20) for j in (i - 1, i, i + 1) if 0 <= j < 20}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Filter" in plan.split("Join ")[0]


def test_rows_of_one_place_are_joined_as_one(spark, monkeypatch):
    import math

    from rasterloom.operators import joins

    met, plain = [], joins._unbundled

    def counted(pairs, *args):
        met.append(pairs.count())
        return plain(pairs, *args)

    monkeypatch.setattr(joins, "_unbundled", counted)
    monkeypatch.setattr(joins, "BUNDLE", 50)
    points = [(i, float(i % 3) / 4, 1.0 if i % 2 else None if i % 50 == 0 else -0.2) for i in range(300)]
    df = spark.createDataFrame(points, "id long, px double, py double")
    got = sorted((x.l.id, x.r.id, x.distance, x.l.px) for x in joins.radius_join(df, df, 0.3).collect())
    far = lambda a, b: math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
    some = [p for p in points if p[2] is not None]
    assert got == sorted((a[0], b[0], far(a, b), a[1]) for a in some for b in some if far(a, b) <= 0.3)
    boxes = spark.createDataFrame([(i, float(i % 4), 0.0, float(i % 4) + 1.5, 1.0) for i in range(200)], "id long, xmin double, ymin double, xmax double, ymax double")
    got = sorted((x.l.id, x.r.id, x.l.xmax, x.r.xmin) for x in joins.box_join(boxes, boxes).collect())
    assert got == sorted((a, b, a % 4 + 1.5, float(b % 4)) for a in range(200) for b in range(200) if abs(a % 4 - b % 4) <= 1)
    assert sum(met) < 60
