"""Pixel kernels: one frame's image to one row of features, in NumPy on Arrow batches.

Images are row-wise BGR bytes (the layout of Spark's image source). Borders reflect without repeating
the edge pixel, as image libraries do by default. Kernels up to histogram() take one image or a stack of
images of one size, whose last two axes are y and x. Everything after the feature row is built-ins."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

EPS = 1e-9
DARK, FLAT, BAND, TILES, BINS = 30.0, 50.0, 0.06, 4, 64
FEATURES = (
    "brightness double, mean_b double, mean_g double, mean_r double, laplacian_variance double, noise_std double, "
    "hist array<double>, low_intensity double, low_texture double, border_left double, border_right double, "
    "border_top double, border_bottom double, edge_gini double, tile_entropy double, border_constant double, thumbnail_md5 string"
)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of a BGR image in 0..255, rounded."""
    return np.rint(bgr[..., 0] * 0.114 + bgr[..., 1] * 0.587 + bgr[..., 2] * 0.299)


def _around(g: np.ndarray, r: int) -> np.ndarray:
    return _padded(g, r, mode="reflect" if min(g.shape[-2:]) > r else "symmetric")


def _padded(g: np.ndarray, r: int, **how) -> np.ndarray:
    return np.pad(g, [(0, 0)] * (g.ndim - 2) + [(r, r)] * 2, **how)


def convolve3(g: np.ndarray, k) -> np.ndarray:
    p = _around(g, 1)
    h, w = g.shape[-2:]
    return sum(k[j][i] * p[..., j : j + h, i : i + w] for j in range(3) for i in range(3) if k[j][i])


SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))
LAPLACE = ((2, 0, 2), (0, -8, 0), (2, 0, 2))


def box_mean(g: np.ndarray, size: int) -> np.ndarray:
    """Mean over a size x size window, from a summed-area table."""
    r = size // 2
    p = _padded(g, r, mode="reflect" if min(g.shape[-2:]) > r else "edge")
    h, w = g.shape[-2:]
    s = np.zeros((*p.shape[:-2], p.shape[-2] + 1, p.shape[-1] + 1))
    np.cumsum(p, axis=-2, out=s[..., 1:, 1:])
    np.cumsum(s, axis=-1, out=s)
    out = s[..., size : size + h, size : size + w] - s[..., :h, size : size + w]
    out -= s[..., size : size + h, :w]
    out += s[..., :h, :w]
    out /= size**2
    return out


def half(g: np.ndarray, factor: int = 2) -> np.ndarray:
    """Area-averaged reduction by a whole factor."""
    h, w = g.shape[-2] // factor * factor, g.shape[-1] // factor * factor
    return g[..., :h, :w].reshape(*g.shape[:-2], h // factor, factor, w // factor, factor).mean(axis=(-3, -1)) if h and w else g


def resize_area(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Area-averaged resize by cell boundaries (nearest where the image is smaller)."""

    def bins(n, m):
        return np.minimum((np.arange(n) * m) // n, m - 1)

    if g.shape[0] < height or g.shape[1] < width:
        return g[np.ix_((np.arange(height) * g.shape[0]) // height, (np.arange(width) * g.shape[1]) // width)]
    rows, cols = bins(g.shape[0], height), bins(g.shape[1], width)
    part = np.add.reduceat(g, np.searchsorted(rows, np.arange(height)), axis=0)
    part = np.add.reduceat(part, np.searchsorted(cols, np.arange(width)), axis=1)
    return part / np.outer(np.bincount(rows, minlength=height), np.bincount(cols, minlength=width))


def resize_bilinear(g: np.ndarray, height: int, width: int) -> np.ndarray:
    """Resize by linear interpolation between the centres of pixels, rounded to bytes; places beyond
    the outer centres have the outer pixels' values."""

    def places(n, m):
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.minimum(at.astype(np.int64), max(n - 2, 0))
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = places(g.shape[-2], height), places(g.shape[-1], width)
    rows = g[..., y0, :] * (1 - fy)[:, None] + g[..., y1, :] * fy[:, None]
    return np.clip(np.rint(rows[..., x0] * (1 - fx) + rows[..., x1] * fx), 0, 255)


def canny(g: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Edges: Sobel gradients (L1), non-maximum suppression, and weak edges that touch strong ones."""
    gx, gy = convolve3(g, SOBEL_X), convolve3(g, SOBEL_Y)
    mag = np.abs(gx) + np.abs(gy)
    p = _padded(mag, 1)
    inner, row = (..., slice(1, -1), slice(1, -1)), p.shape[-1]
    some = np.zeros(p.shape, bool)
    some[inner] = mag > low
    at, x, y = np.flatnonzero(some), gx[some[inner]], gy[some[inner]]
    ratio = np.abs(y) / (np.abs(x) + EPS)
    flat, steep = ratio < np.tan(np.pi / 8), ratio > np.tan(3 * np.pi / 8)
    step = np.where(flat, 1, np.where(steep, row, np.where(x * y >= 0, row + 1, row - 1)))
    p = p.ravel()
    at = at[(p[at] > p[at - step]) & (p[at] >= p[at + step])]
    weak, strong = np.zeros(p.shape, bool), np.zeros(p.shape, bool)
    weak[at] = True
    new = at[p[at] > high]
    while len(new):
        strong[new], weak[new] = True, False
        near = (new[:, None] + [dy * row + dx for dy in (-1, 0, 1) for dx in (-1, 0, 1)]).ravel()
        new = np.unique(near[weak[near]])
    return strong.reshape(some.shape)[inner] * 255.0


def tiles(a: np.ndarray, n: int = TILES) -> list[np.ndarray]:
    """n x n tiles; the last of each direction takes the rest."""
    y, x = ([k * (s // n) for k in range(n)] + [s] for s in a.shape[-2:])
    return [a[..., y[j] : y[j + 1], x[i] : x[i + 1]] for j in range(n) for i in range(n)]


def gini(x: np.ndarray) -> np.ndarray:
    """Of the values less their minimum, along the last axis."""
    x = np.sort(np.asarray(x, float), axis=-1)
    x = x - x[..., :1]
    n = x.shape[-1]
    return ((2 * np.arange(1, n + 1) - n - 1) * x).sum(axis=-1) / (n * (x.sum(axis=-1) + EPS))


def histogram(g: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of each image's values 0..255 in bins of one width, along the last axis."""
    n, size = int(np.prod(g.shape[:-2])), g.shape[-2] * g.shape[-1]
    at = (g.reshape(n, size) * bins / 256).astype(np.int64) + np.arange(n)[:, None] * bins
    return np.bincount(at.ravel(), minlength=n * bins).reshape(*g.shape[:-2], bins).astype(float)


def entropy(hist: np.ndarray) -> np.ndarray:
    """Of histograms along the last axis."""
    p = hist / (hist.sum(axis=-1, keepdims=True) + EPS)
    return -(p * np.log(p + EPS)).sum(axis=-1)


def _mean(a: np.ndarray) -> np.ndarray:
    """Each image's mean."""
    return a.reshape(len(a), -1).mean(axis=1)


def feature_columns(bgr: np.ndarray) -> list:
    """The columns of FEATURES of a stack of frames of one size (frame, y, x, channel)."""
    import hashlib

    planes = np.moveaxis(bgr, -1, 0).astype(np.float64, order="C")
    g = gray(np.moveaxis(planes, 0, -1))
    n, h, w = g.shape
    small = half(g)
    mag = np.hypot(convolve3(small, SOBEL_X), convolve3(small, SOBEL_Y))
    calm = mag <= np.percentile(mag.reshape(n, -1), 20.0, axis=1)[:, None, None]
    mean = box_mean(g, 21)
    flat = np.maximum(0.0, box_mean(g * g, 21) - mean * mean) <= FLAT
    bw, bh = int(max(1, BAND * w)), int(max(1, BAND * h))
    bands = [g[..., :bw], g[..., w - bw :], g[:, :bh], g[:, h - bh :]]
    edges = canny(g)
    thumbs = resize_bilinear(g, 32, 32).astype(np.uint8)
    by_tile = np.stack([histogram(t) for t in tiles(g)], axis=1)
    hist = by_tile.sum(axis=1)
    return [
        _mean(g),
        *(_mean(p) for p in planes),
        convolve3(g, LAPLACE).reshape(n, -1).var(axis=1),
        np.array([s[c].std() for s, c in zip(small, calm)]),
        list(hist / (hist.sum(axis=1, keepdims=True) + EPS)),
        _mean(g <= DARK),
        _mean(flat),
        *(_mean(b <= DARK) for b in bands),
        gini(np.stack([_mean(t) for t in tiles(edges)], axis=1)),
        entropy(by_tile).mean(axis=1),
        np.mean([_mean(np.abs(b - _mean(b)[:, None, None]) < 2.0) for b in bands], axis=0),
        [hashlib.md5(t.tobytes()).hexdigest() for t in thumbs],
    ]


def features(bgr: np.ndarray) -> tuple:
    """One frame's feature row, in order of FEATURES."""
    return tuple(c[0].tolist() if isinstance(c[0], (np.ndarray, np.generic)) else c[0] for c in feature_columns(bgr[None]))


STACK = 1 << 17  # pixels, so that a stack's arrays stay in a core's cache


def stacks(data, height, width, channels):
    """Rows of images, in order, as stacks of consecutive images of one size: of STACK pixels at most, or
    one image."""
    sizes = list(zip(height, width, channels))
    for (h, w, c), run in groupby(range(len(sizes)), sizes.__getitem__):
        run = list(run)
        most = max(1, STACK // max(1, h * w))
        for k in range(0, len(run), most):
            yield np.stack([image_of(data[i], h, w, c) for i in run[k : k + most]])


def image_of(data: bytes, height: int, width: int, channels: int = 3) -> np.ndarray:
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return a[..., :3] if channels >= 3 else np.repeat(a[..., :1], 3, axis=2)


def frame_features(frames: DataFrame) -> DataFrame:
    """video, frame_no, ts and the features of every frame(video, frame_no, ts, height, width,
    nChannels, data)."""
    names = [f.split()[0] for f in FEATURES.split(", ")]

    def run(batches):
        for b in batches:
            b = b.reset_index(drop=True)
            parts = [pd.DataFrame(dict(zip(names, feature_columns(s)))) for s in stacks(*(b[c].tolist() for c in ("data", "height", "width", "nChannels")))]
            rows = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=names)
            yield pd.concat([b[["video", "frame_no", "ts"]], rows], axis=1)

    return frames.select("video", "frame_no", "ts", "height", "width", "nChannels", "data").mapInPandas(run, f"video string, frame_no long, ts double, {FEATURES}")


# ----------------------------------------------------------------- scale and rotation of a view


def corners(g: np.ndarray, most: int = 500) -> np.ndarray:
    """(y, x) of the strongest corners by the smaller eigenvalue's proxy (Harris), apart from each
    other by non-maximum suppression."""
    gx, gy = convolve3(g, SOBEL_X), convolve3(g, SOBEL_Y)
    a, b, c = (box_mean(v, 7) for v in (gx * gx, gy * gy, gx * gy))
    r = a * b - c * c - 0.04 * (a + b) ** 2
    p = np.pad(r, 1, constant_values=-np.inf)
    h, w = r.shape
    peak = np.all([r >= p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0) & (r > 0.01 * max(r.max(), EPS))
    peak[:16] = peak[-16:] = False
    peak[:, :16] = peak[:, -16:] = False
    y, x = np.nonzero(peak)
    top = np.argsort(-r[y, x], kind="stable")[:most]
    return np.stack([y[top], x[top]], axis=1)


_PAIRS = np.clip(np.rint(np.random.default_rng(31).normal(0, 6, (256, 4))), -14, 14)


def describe(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """256-bit descriptors by comparing smoothed pixels in pairs turned to the patch's centroid."""
    s = box_mean(g, 5)
    span = np.arange(-15, 16)
    y, x = at[:, 0], at[:, 1]
    patch = g[y[:, None, None] + span[:, None], x[:, None, None] + span]
    turn = np.arctan2((patch * span[:, None]).sum(axis=(1, 2)), (patch * span).sum(axis=(1, 2)))
    c, n = np.cos(turn)[:, None], np.sin(turn)[:, None]

    def pixel(px, py):
        row, col = np.rint(y[:, None] + px * n + py * c), np.rint(x[:, None] + px * c - py * n)
        return s[np.clip(row, 0, g.shape[0] - 1).astype(int), np.clip(col, 0, g.shape[1] - 1).astype(int)]

    return pixel(_PAIRS[:, 0], _PAIRS[:, 1]) < pixel(_PAIRS[:, 2], _PAIRS[:, 3])


LEVELS, FACTOR, CORNERS = 8, 1.2, 2000


def described(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places x + iy, descriptors) of the corners of an image and of its smaller copies, each by FACTOR
    smaller than the one before; a copy's share of CORNERS goes with its width."""
    share = FACTOR ** -np.arange(LEVELS)
    places, bits = [], []
    for k, n in enumerate(np.rint(CORNERS * share / share.sum()).astype(int).tolist()):
        h, w = (int(round(size * share[k])) for size in g.shape)
        if min(h, w) < 34:  # no room for a patch
            break
        small = resize_bilinear(g, h, w) if k else g
        at = corners(small, n)
        if len(at):
            places.append(((at[:, 1] + 0.5) / w * g.shape[1] - 0.5) + 1j * ((at[:, 0] + 0.5) / h * g.shape[0] - 0.5))
            bits.append(describe(small, at))
    if not places:
        return np.zeros(0, complex), np.zeros((0, 256), bool)
    return np.concatenate(places), np.concatenate(bits)


def view_change(ref: np.ndarray, cur: np.ndarray) -> tuple[float | None, float | None, int]:
    """similarity() from image ref to image cur."""
    return similarity(*described(ref), *described(cur))


def similarity(a: np.ndarray, da: np.ndarray, b: np.ndarray, db: np.ndarray, rounds: int = 500) -> tuple[float | None, float | None, int]:
    """(scale, rotation in degrees, inliers) of a similarity from corners a to b, by matched descriptors
    and random sampling; None without 20 corners and 20 matches (a match beats the next by 0.75)."""
    if len(a) < 20 or len(b) < 20:
        return None, None, 0
    da, db = da.astype(np.float32), db.astype(np.float32)
    far = da.sum(1)[:, None] + db.sum(1)[None, :] - 2 * da @ db.T
    two = np.argpartition(far, 1, axis=1)[:, :2]
    two = np.take_along_axis(two, np.argsort(np.take_along_axis(far, two, 1), axis=1, kind="stable"), 1)
    d1, d2 = (np.take_along_axis(far, two[:, k : k + 1], 1)[:, 0] for k in (0, 1))
    good = d1 < 0.75 * d2
    if good.sum() < 20:
        return None, None, int(good.sum())
    p, q = a[good], b[two[good, 0]]
    rng = np.random.default_rng(3)
    best = np.zeros(len(p), bool)
    for _ in range(rounds):
        i, j = rng.choice(len(p), 2, replace=False)
        if p[i] == p[j]:
            continue
        m = (q[j] - q[i]) / (p[j] - p[i])
        near = np.abs(m * (p - p[i]) + q[i] - q) < 3.0
        if near.sum() > best.sum():
            best = near
    if best.sum() < 2:
        return None, None, int(good.sum())
    pc, qc = p[best] - p[best].mean(), q[best] - q[best].mean()
    m = (np.conj(pc) * qc).sum() / (np.abs(pc) ** 2).sum()
    return float(np.abs(m)), float(np.degrees(-np.angle(m))), int(best.sum())


def view_changes(frames: DataFrame, stride: int = 5) -> DataFrame:
    """video, frame_no, scale, rotation_deg, inliers of every stride-th frame against the first. The
    first frame's corners, found once, join its video's sampled frames, so a video needn't lie in one
    task and no image is shipped for it."""
    from pyspark.sql import functions as F

    cols = ["height", "width", "nChannels", "data"]
    sampled = frames.where(F.col("frame_no") % stride == 0).select("video", "frame_no", *cols)

    def image(row):
        h, w, n, data = row
        return gray(image_of(data, h, w, n).astype(float))

    def first(batches):
        for b in batches:
            seen = [described(image(x)) for x in zip(*(b[c] for c in cols))]
            yield pd.DataFrame({"video": b["video"], "places": [a.astype("<c16").tobytes() for a, _ in seen], "bits": [np.packbits(d, axis=1).tobytes() for _, d in seen]})

    def run(batches):
        for b in batches:
            rows = []
            for v, n, places, bits, *x in zip(b["video"], b["frame_no"], b["places"], b["bits"], *(b[c] for c in cols)):
                ref = np.frombuffer(places, "<c16"), np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, 32), axis=1)
                rows.append((v, n, *similarity(*ref, *described(image(x)))))
            yield pd.DataFrame(rows, columns=["video", "frame_no", "scale", "rotation_deg", "inliers"])

    refs = frames.where("frame_no = 0").select("video", *cols).mapInPandas(first, "video string, places binary, bits binary")
    return sampled.join(refs, "video").select("video", "frame_no", "places", "bits", *cols).mapInPandas(run, "video string, frame_no long, scale double, rotation_deg double, inliers int")


def traffic_scores(frames: DataFrame, background: int = 120, alpha: float = 0.75, stride: int = 3) -> DataFrame:
    """video, frame_no, score of every stride-th frame against the median of the first `background`
    of them; no rows for a video with fewer. One task per video holds the background's small frames
    (144 x 256) at once and streams the rest."""
    from pyspark.sql import functions as F

    def small(row):
        return resize_bilinear(gray(image_of(*row).astype(float)), 144, 256)

    def score(g, bg):
        edge = np.hypot(convolve3(g, SOBEL_X), convolve3(g, SOBEL_Y))
        diff = np.abs(g - bg)
        return float(alpha * (diff * edge / (edge.mean() + EPS)).mean() + (1 - alpha) * diff.mean())

    def run(batches):
        video, held, bg = None, [], None
        for b in batches:
            rows = []
            for v, n, *x in zip(b["video"], b["frame_no"], b["data"], b["height"], b["width"], b["nChannels"]):
                if v != video:
                    video, held, bg = v, [], None
                g = small(x)
                if bg is None:
                    held.append((n, g))
                    if len(held) == background:
                        bg = np.median([k for _, k in held], axis=0)
                        rows += [(v, m, score(k, bg)) for m, k in held]
                        held = []
                else:
                    rows.append((v, n, score(g, bg)))
            yield pd.DataFrame(rows, columns=["video", "frame_no", "score"])

    dealt = frames.where(F.col("frame_no") % stride == 0).select("video", "frame_no", "data", "height", "width", "nChannels").repartition("video").sortWithinPartitions("video", "frame_no")
    return dealt.mapInPandas(run, "video string, frame_no long, score double")
