"""Pixel kernels on synthetic frames, metrics on their features, streams."""

import math

import numpy as np

from roadlens.operators import kernels, video
from roadlens.plans import reports

FRAMES = "video string, frame_no long, ts double, height int, width int, nChannels int, data binary"


def frames(spark, images, name="v"):
    rows = [(name, k, k / 10, *i.shape[:2], 3, i.astype(np.uint8).tobytes()) for k, i in enumerate(images)]
    return spark.createDataFrame(rows, FRAMES)


def flat(level, h=48, w=64):
    return np.full((h, w, 3), level)


def noise(seed, h=96, w=128):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3))


def test_features_of_known_images():
    names = [f.split()[0] for f in kernels.FEATURES.split(", ")]
    f = dict(zip(names, kernels.features(flat(20))))
    assert (f["brightness"], f["laplacian_variance"], f["noise_std"], f["low_intensity"], f["low_texture"], f["border_constant"]) == (20.0, 0.0, 0.0, 1.0, 1.0, 1.0)
    assert f["edge_gini"] == 0.0 and math.isclose(sum(f["hist"]), 1.0, abs_tol=1e-6) and abs(f["tile_entropy"]) < 1e-5
    board = np.kron(np.indices((6, 8)).sum(0) % 2, np.ones((8, 8)))[..., None].repeat(3, 2) * 255
    f = dict(zip(names, kernels.features(board)))
    assert f["brightness"] == 127.5 and f["laplacian_variance"] > 1000 and math.isclose(f["low_intensity"], 0.5)
    dark = flat(200)
    dark[:, :4] = 0
    f = dict(zip(names, kernels.features(dark)))
    assert f["border_left"] == 1.0 and f["border_right"] == 0.0


def test_small_kernels():
    g = np.arange(48.0).reshape(6, 8)
    assert kernels.half(g).shape == (3, 4) and kernels.half(g)[0, 0] == g[:2, :2].mean()
    assert math.isclose(kernels.box_mean(np.full((30, 30), 3.0), 21)[4, 7], 3.0)
    assert kernels.resize_area(np.full((50, 70), 9.0), 32, 32).shape == (32, 32)
    assert math.isclose(kernels.gini([0, 0, 0, 4]), 0.75, abs_tol=1e-6)
    edge = np.zeros((20, 20))
    edge[:, 10:] = 255
    assert kernels.canny(edge).max() == 255 and kernels.canny(np.zeros((20, 20))).max() == 0


def test_view_change():
    rng = np.random.default_rng(0)
    big = kernels.box_mean(rng.integers(0, 256, (220, 280)).astype(float), 5)
    big = (big - big.min()) / np.ptp(big) * 255
    scale, turn, n = kernels.view_change(big, big)
    assert math.isclose(scale, 1.0, abs_tol=1e-6) and abs(turn) < 1e-6 and n >= 20
    scale, turn, _ = kernels.view_change(big, np.roll(big, (6, 9), (0, 1)))
    assert abs(scale - 1) < 0.02 and abs(turn) < 1
    assert kernels.view_change(flat(9)[..., 0].astype(float), big)[0] is None


def test_view_change_by_zoom():
    rng = np.random.default_rng(5)
    big = kernels.box_mean(rng.integers(0, 256, (360, 480)).astype(float), 9)
    big = np.rint((big - big.min()) / np.ptp(big) * 255)
    for zoom in (1.2, 1.5, 2.0):
        h, w = int(360 / zoom), int(480 / zoom)
        scale, turn, n = kernels.view_change(big, kernels.resize_bilinear(big[20 : 20 + h, 30 : 30 + w], 360, 480))
        assert n >= 20 and abs(scale - 360 / h) < 0.03 * zoom and abs(turn) < 1.5, (zoom, scale, turn, n)


def test_report_of_a_steady_video(spark):
    df = frames(spark, [noise(1)] * 12)
    out = reports.video_metrics(df, stride=1, views=True)["v"]
    assert out["sensor_consistency"]["sci"] == 1.0 and out["temporal_metrics"]["completeness_pct"] == 100.0
    assert out["sensor_degradation"]["scale_mean"] == 1.0 and not out["sensor_degradation"]["border_intrusion"]
    assert out["traffic_presence"]["total"] == 0 and out["duplicate_record_rate"]["duplicates"] == 0


def test_default_report_compares_views(spark):
    rng = np.random.default_rng(0)
    big = kernels.box_mean(rng.integers(0, 256, (220, 280)).astype(float), 5)
    big = np.repeat(((big - big.min()) / np.ptp(big) * 255)[..., None], 3, axis=2)
    df = frames(spark, [big] * 6)
    got = reports.video_metrics(df, stride=1)["v"]["sensor_degradation"]
    assert got["inliers_median"] >= 20 and abs(got["scale_mean"] - 1) < 1e-6
    r = video.degradation(kernels.frame_features(df)).first()
    assert (r.scale_mean, r.scale_cov, r.fov_change_score, r.fov_change_suspected, r.scale_change) == (None,) * 5


def test_dark_border_and_few_frames(spark):
    image = noise(2)
    image[:, :20] = 0
    features = kernels.frame_features(frames(spark, [image] * 3))
    r = video.degradation(features).first()
    assert r.border_intrusion and r.partial_blockage_score < 1
    r = video.degradation(kernels.frame_features(frames(spark, [flat(0)]))).first()
    assert (r.partial_blockage_score, r.fov_change_score, r.insufficient_frames) == (1.0, 1.0, True)


def test_traffic_needs_the_whole_background(spark):
    still = [flat(100, 18, 32)] * 118 + [noise(4, 18, 32), flat(100, 18, 32)]
    assert kernels.traffic_scores(frames(spark, still[:119]), stride=1).count() == 0
    scores = kernels.traffic_scores(frames(spark, still), stride=1)
    r = video.traffic_presence(scores, scores).first()
    assert (r.total, r.active) == (120, 1)


def test_stream(spark, tmp_path):
    from roadlens.streaming import metrics

    rows = [("f", f"2024-01-01 00:{m:02d}:0{s}", i, 60.0 * (i == 2), 0.0) for m in range(30) for s in range(2) for i in (1, 2, 2)]
    df = spark.createDataFrame(rows, "file string, t string, idx long, vel_x double, vel_y double").selectExpr("file", "cast(t as timestamp) ts", "idx", "vel_x", "vel_y")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = metrics.detections(metrics.without_repeats(stream, "1 second"), late=None).writeStream.format("memory").queryName("seen").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    r = spark.table("seen").orderBy("start").first()
    assert (r.samples, r.objects, r.fast_samples) == (4, 2, 2)


def test_missing_times_are_no_duplicates(spark):
    rows = [("a", k, t) for k, t in enumerate([float("nan")] * 3)] + [("b", k, t) for k, t in enumerate([0.0, 0.0, None, float("nan"), 1.0])] + [("c", 0, None)]
    got = {r.video: (r.frames, r.duplicates) for r in video.duplicate_rate(spark.createDataFrame(rows, "video string, frame_no long, ts double")).collect()}
    assert got == {"a": (3, 0), "b": (5, 1), "c": (1, 0)}


def test_bilinear_resize():
    g = np.array([[0.0, 100.0], [200.0, 100.0]])
    assert kernels.resize_bilinear(g, 2, 2).tolist() == g.tolist() and kernels.resize_bilinear(g, 1, 1).tolist() == [[100.0]]
    assert kernels.resize_bilinear(g, 2, 4).tolist() == [[0, 25, 75, 100], [200, 175, 125, 100]]
    rng = np.random.default_rng(0)
    big = np.rint(rng.uniform(0, 255, (97, 61)))
    small = kernels.resize_bilinear(big, 32, 32)
    y, x = (10.5 * 97 / 32 - 0.5), (20.5 * 61 / 32 - 0.5)
    a, b, fy, fx = int(y), int(x), y % 1, x % 1
    want = (big[a, b] * (1 - fx) + big[a, b + 1] * fx) * (1 - fy) + (big[a + 1, b] * (1 - fx) + big[a + 1, b + 1] * fx) * fy
    assert small[10, 20] == np.rint(want) and (kernels.resize_bilinear(np.full((3, 1), 7.0), 32, 32) == 7).all()


def test_stacked_frames_keep_their_features(spark):
    images = [noise(k, 32, 48) for k in range(5)] + [flat(9, 32, 48), noise(5, 97, 61), noise(6, 32, 48), flat(255, 3, 5), flat(0, 1, 1), noise(7, 3, 5)]
    names = [f.split()[0] for f in kernels.FEATURES.split(", ")]
    with np.errstate(all="ignore"):
        want = {k: dict(zip(names, kernels.features(i))) for k, i in enumerate(images)}
    got = {r.frame_no: r.asDict() for r in kernels.frame_features(frames(spark, images).coalesce(1)).collect()}
    same = lambda a, b: a == b or (a is None or a != a) and b != b
    assert got.keys() == want.keys() and all(same(got[k][c], want[k][c]) for k in want for c in names)
    assert [got[k]["brightness"] for k in (5, 8, 9)] == [9.0, 255.0, 0.0]


def test_frames_of_one_size_are_computed_together():
    images = [noise(k, 32, 48) for k in range(200)] + [noise(0, 400, 400)] * 3 + [noise(1, 32, 48)]
    data, h, w = zip(*((i.astype(np.uint8).tobytes(), *i.shape[:2]) for i in images))
    got = list(kernels.stacks(data, h, w, [3] * len(images)))
    assert len(got) < 10 and all(s.shape[0] == 1 or s[..., 0].size <= kernels.STACK for s in got)
    assert all((a == b).all() for a, b in zip((f for s in got for f in s), images, strict=True))


def test_small_rows_are_dealt_before_images_are_made(spark):
    from conftest import DATA

    from roadlens.plans import registry

    df = registry.queries()["frame_kernels"](spark, str(DATA / "sf0.001"))
    assert df.rdd.getNumPartitions() >= 4  # one file, one row group


def test_edges_follow_weak_pixels_from_strong_ones():
    g = np.zeros((2, 12, 40))
    g[0, 6:] = np.linspace(20, 80, 40)  # weak at first, strong at the right
    g[1, 6:] = 30  # weak only
    edges = kernels.canny(g)
    assert not edges[1].any() and (edges == np.stack([kernels.canny(i) for i in g])).all()
    y, x = np.nonzero(edges[0])
    assert x.max() == 39 and len(x) > 20 and 4 * g[0, 6, x.min()] < 150
