"""Near-duplicate embeddings by int8 quantised tile products with rigorous error bounds.

Vectors are normalised and laid out by a k-d tree of their leading principal directions (fitted on a
bounded sample; only the layout depends on it, not the result), so that tiles of up to TILE rows
are compact where the data are. Each tile has the bounding box of its rows in these directions and
is one packed row: ids, int8 vectors, scales, error norms, and the originals. Tiles that follow each
other in the layout form stripes of bounded size.

Every two stripes whose boxes lie no farther apart than linked vectors can lie are one task's unit,
which holds one stripe and streams the other; a tile thus travels once per stripe it has to meet. In
a unit the same test is made for every two tiles. Those that pass are multiplied as int8 products in
float32, BLOCK dimensions at a time and added up in double precision: every partial sum is an integer
under 2^24 (127 * 127 * 1024), so products are exact in any number of dimensions. With
a = q_a + e_a, |a.b - q_a.q_b| <= |q_a||e_b| + |q_b||e_a| + |e_a||e_b|, so a pair whose upper bound
is under the threshold is settled; only pairs that may reach it are recomputed in double precision
from the originals. A unit adds up link counts and reduces its links to a spanning forest, so
groups of copies of any size never become rows per pair; components follow by contraction.

Pairs of tiles: of random high-dimensional data no exact method prunes, and the number of tile
products grows with the square of the number of tiles (n/TILE). README gives figures.

Defined results: null or zero vectors, and those with null or non-finite components or another
dimension than most, link with nothing; null vec_id: reported, linked with nothing, component null,
kept false; rows that repeat a vec_id are vectors of their own, each with its own links (to each other,
too), and both are kept if theirs is the smallest vec_id reachable; an empty table gives no rows;
extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import components, cut, forget

TILE = 4096
SAMPLE = 100_000  # rows that the layout is fitted on, about, at most
SAMPLE_BYTES = 16 << 20  # and their size
BOX = 8  # principal directions of the boxes
DEEPEST = 14  # levels of the layout's tree at most: a leaf needs a few rows of the sample
STRIPE_BYTES = 32 << 20  # of tiles that a unit holds at most, but for one tile
BLOCK = 1024  # dimensions whose int8 products are added up in float32 without rounding


def usable(embedding):
    """A column: the vector if it takes part, else null."""
    e = embedding.cast("array<double>")
    ok = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok & F.exists(e, lambda x: x != 0), e)


def matrix(column) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _layout(sample: np.ndarray, leaves: float):
    """(directions, tree) from a sample: a node splits at the median of the direction in which its
    rows spread most; nodes are in heap order, (direction, value)."""
    u = _unit(sample)
    _, _, axes = np.linalg.svd(u - u.mean(axis=0), full_matrices=False)
    axes = axes[: min(BOX, len(axes))]
    p = u @ axes.T
    depth = int(np.clip(np.round(np.log2(max(1.0, leaves))), 0, DEEPEST))
    split = np.zeros((2**depth, 2))
    node = np.ones(len(p), np.int64)
    for level in range(depth):
        for k in range(2**level, 2 ** (level + 1)):
            own = p[node == k]
            if len(own) > 1:
                axis = int(np.ptp(own, axis=0).argmax())
                split[k] = axis, np.median(own[:, axis])
        node = _step(p, node, split)
    return axes, split, depth


def _step(p: np.ndarray, node: np.ndarray, split: np.ndarray) -> np.ndarray:
    return 2 * node + (p[np.arange(len(p)), split[node, 0].astype(np.int64)] > split[node, 1])


def _assign(layout, dim: int):
    """Rows (vec_id, e) to (vec_id, e, leaf); e and leaf are null for what takes no part."""
    axes, split, depth = layout

    def run(batches):
        for b in batches:
            ids, e = b.column(0), b.column(1)
            takes = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(e), dim), False)) & np.asarray(pc.is_valid(ids))
            leaf = np.zeros(len(ids), np.int64)
            if takes.any():
                p = _unit(matrix(e.filter(pa.array(takes)))) @ axes.T
                node = np.ones(len(p), np.int64)
                for _ in range(depth):
                    node = _step(p, node, split)
                leaf[takes] = node
            kept = pc.if_else(pa.array(takes), e, pa.scalar(None, e.type))
            yield pa.RecordBatch.from_arrays([ids, kept, pa.array(leaf, mask=~takes)], ["vec_id", "e", "leaf"])

    return run


_TILE = "ids binary, rows binary, q binary, scale binary, err binary, e binary, low array<double>, high array<double>"


def _pack(axes: np.ndarray, tile: int, kind: str):
    """Rows (key, vec_id, row, e) in runs of one key to packed tiles of at most `tile` rows."""

    def packed(ids, rows, e):
        e = np.concatenate(e)
        u = _unit(e)
        scale = np.abs(u).max(axis=1) / 127
        q = np.rint(u / scale[:, None]).astype(np.int8)
        err = np.sqrt(((u - q * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        p = u @ axes.T
        cols = [np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(rows).astype("<i8").tobytes(), q.tobytes(), scale.tobytes(), err.tobytes(), e.astype(kind).tobytes(), p.min(axis=0).tolist(), p.max(axis=0).tolist()]
        kinds = [*[pa.binary()] * 6, *[pa.list_(pa.float64())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cols, kinds)], ["ids", "rows", "q", "scale", "err", "e", "low", "high"])

    def run(batches):
        key, ids, rows, e, held = None, [], [], [], 0
        for b in batches:
            keys, at = np.asarray(b.column(0)), 0
            own, row, vec = np.asarray(b.column(1)), np.asarray(b.column(2)), matrix(b.column(3))
            while at < len(keys):
                if held and (keys[at] != key or held >= tile):
                    yield packed(ids, rows, e)
                    ids, rows, e, held = [], [], [], 0
                key = keys[at]
                end = min(int(np.searchsorted(keys, key, "right")), at + tile - held)
                ids.append(own[at:end])
                rows.append(row[at:end])
                e.append(vec[at:end])
                held += end - at
                at = end
        if held:
            yield packed(ids, rows, e)

    return run


class _Tile:
    """One tile as a unit needs it. `at`: the place of its first row among the unit's."""

    def __init__(self, row: list, kind: str, at: int):
        ids, rows, q, scale, err, e, low, high = row
        self.ids, self.rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
        shape = lambda b, t: np.frombuffer(b, t).reshape(len(self.ids), -1)
        self.q, self.scale, self.err = shape(q, np.int8).astype(np.float32), np.frombuffer(scale), np.frombuffer(err)
        self.norm = self.scale * np.sqrt((self.q.astype(np.float64) ** 2).sum(axis=1))
        x = shape(e, kind).astype(np.float64)
        self.x = x / np.abs(x).max(axis=1, keepdims=True)
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        self.low, self.high, self.at = np.array(low), np.array(high), at
        self.count = np.zeros(len(self.ids), np.int64)


def quantised_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 vectors that are held as float32."""
    if a.shape[1] <= BLOCK:
        return a @ b.T
    return sum((a[:, x : x + BLOCK] @ b[:, x : x + BLOCK].T).astype(np.float64) for x in range(0, a.shape[1], BLOCK))


def _linked(a: _Tile, b: _Tile, threshold: float):
    """Places (x, y) of all linked rows of two tiles, or of one tile each once."""
    # q_a.q_b must reach the threshold less |q_a||e_b| + |q_b||e_a| + |e_a||e_b|
    reach = threshold - 1e-9 - (a.norm + a.err) * b.err.max() - a.err * b.norm.max()
    xs, ys = [], []
    for i in range(0, len(a.ids), 256):
        need = (reach[i : i + 256] / a.scale[i : i + 256])[:, None] / b.scale[None, :]
        x, y = np.nonzero(quantised_products(a.q[i : i + 256], b.q) >= need - 1e-6 * np.abs(need))
        x = x + i
        if a is b:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), 1 << 15):
            u, v = x[k : k + (1 << 15)], y[k : k + (1 << 15)]
            ok = (a.x[u] * b.x[v]).sum(axis=1) / (a.length[u] * b.length[v]) >= threshold
            xs.append(u[ok].astype(np.int32))
            ys.append(v[ok].astype(np.int32))
    return (np.concatenate(z) if z else np.zeros(0, np.int32) for z in (xs, ys))


def _products(threshold: float, kind: str):
    """Rows (unit, side, tile) sorted by unit and side to rows (id, row, n, other, other_row): n links
    of a row where other is null, else two rows in one component. Holds a unit's first side."""
    near = 2 - 2 * threshold + 1e-6

    class Unit:
        def __init__(self, key):
            self.key, self.held, self.all, self.x, self.y, self.n = key, [], [], [], [], 0

        def add(self, side: int, row: list):
            t = _Tile(row, kind, self.n)
            self.n += len(t.ids)
            if side == 0:
                self.held.append(t)
            self.all.append((t.ids, t.rows, t.count))
            # a stripe that meets itself comes on side 0 alone, two stripes on sides 1 and 2
            against = [] if side == 1 else self.held
            if side == 1:
                self.held.append(t)
            for o in against:
                if (np.maximum(np.maximum(o.low - t.high, t.low - o.high), 0) ** 2).sum() > near:
                    continue
                x, y = _linked(o, t, threshold)
                if len(x):
                    o.count += np.bincount(x, minlength=len(o.ids))
                    t.count += np.bincount(y, minlength=len(t.ids))
                    # a forest of these links is all that components need
                    label = _labels(x, y + len(o.ids) if o is not t else y, len(o.ids) + (len(t.ids) if o is not t else 0))
                    place = np.r_[o.at + np.arange(len(o.ids)), t.at + np.arange(len(t.ids))] if o is not t else o.at + np.arange(len(o.ids))
                    joined = np.flatnonzero(label != np.arange(len(label)))
                    self.x.append(place[joined])
                    self.y.append(place[label[joined]])
                    if sum(map(len, self.x)) > 4 * self.n + 100_000:
                        self._reduce()

        def _reduce(self):
            if self.x:
                label = _labels(np.concatenate(self.x), np.concatenate(self.y), self.n)
                joined = np.flatnonzero(label != np.arange(self.n))
                self.x, self.y = [joined], [label[joined]]

        def out(self):
            self._reduce()
            ids, rows, count = (np.concatenate(c) for c in zip(*self.all))
            some = np.flatnonzero(count)
            x, y = (self.x[0], self.y[0]) if self.x else (some[:0], some[:0])
            ends = np.r_[np.ones(len(some), bool), np.zeros(len(x), bool)]
            cols = [pa.array(np.r_[ids[some], ids[x]]), pa.array(np.r_[rows[some], rows[x]]), pa.array(np.r_[count[some], 0 * x])]
            cols += [pa.array(np.r_[0 * some, c[y]], mask=ends) for c in (ids, rows)]
            return pa.RecordBatch.from_arrays(cols, ["id", "row", "n", "other", "other_row"])

    def run(batches):
        unit = None
        for batch in batches:
            for r in range(batch.num_rows):
                key, side, *row = (batch.column(c)[r] for c in range(10))
                if unit is None or key.as_py() != unit.key:
                    if unit:
                        yield unit.out()
                    unit = Unit(key.as_py())
                unit.add(side.as_py(), [*(c.as_buffer() for c in row[:6]), row[6].as_py(), row[7].as_py()])
        if unit:
            yield unit.out()

    return run


def _labels(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Each place's smallest reachable place over links (x, y)."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def near_vectors(rows: DataFrame, threshold: float = 0.9, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of rows(vec_id, embedding); threshold: the
    cosine from which vectors are linked (over 0)."""
    spark = rows.sparkSession
    kind = "<f4" if "float" in dict(rows.dtypes)["embedding"] else "<f8"
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("e"))
    good = slim.where("vec_id is not null and e is not null")
    sizes = good.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if sizes is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    dim, n = sizes
    most = max(100, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    some = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))
    sample = good.where((F.size("e") == dim) & some).limit(2 * most).select("e").toArrow()
    points = matrix(sample.column(0).combine_chunks()) if sample.num_rows else np.eye(dim)
    layout = _layout(points, n / (0.75 * tile))
    # rows are numbered where they are written, so that repeated ones stay apart
    placed = slim.mapInArrow(_assign(layout, dim), "vec_id long, e array<double>, leaf long").withColumn("row", F.monotonically_increasing_id())
    placed = cut(placed, "leaves")
    takes = placed.where("leaf is not null")
    # a leaf of copies may hold any share of the rows: it is dealt to several tasks (at most 2^DEEPEST leaves)
    shares = takes.groupBy("leaf").agg(F.ceil(F.count("*") / (2 * tile)).alias("parts"))
    keyed = takes.join(F.broadcast(shares), "leaf").select((F.col("leaf") * (1 << 40) + F.pmod(F.xxhash64("row"), "parts")).alias("key"), "vec_id", "row", "e")
    packed = keyed.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_pack(layout[0], tile, kind), _TILE)
    tiles = cut(packed.withColumn("m", F.monotonically_increasing_id()), "tiles")
    # tiles in order of the layout: m's upper bits are the task, its lower bits the place there
    parts = sorted((r.part, r.n) for r in tiles.groupBy(F.shiftright("m", 33).alias("part")).agg((F.max("m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("n")).collect())  # a row per task
    before = dict(zip([p for p, _ in parts], np.cumsum([0] + [c for _, c in parts]).tolist()))
    t = sum(c for _, c in parts)
    offsets = F.broadcast(spark.createDataFrame(list(before.items()), "part long, before long"))
    held = max(1, STRIPE_BYTES // (tile * dim * (1 + int(kind[2]))))
    wide = max(1, min(held, t // int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism)))))
    many = -(-t // wide)  # stripes
    numbered = tiles.withColumn("part", F.shiftright("m", 33)).join(offsets, "part")
    numbered = numbered.withColumn("stripe", F.floor((F.col("before") + F.col("m").bitwiseAND(F.lit((1 << 33) - 1))) / wide)).drop("part", "before")
    axes = range(len(layout[0]))
    boxes = numbered.groupBy("stripe").agg(F.array(*(F.min(F.col("low")[k]) for k in axes)).alias("low"), F.array(*(F.max(F.col("high")[k]) for k in axes)).alias("high"))
    boxes = cut(boxes, "boxes")
    # every two stripes once: one and the d-th after it, around
    ahead = boxes.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many // 2).cast("long"))))
    ahead = ahead.where((F.col("d") * 2 < many) | (F.col("stripe") < many // 2)).withColumn("j", (F.col("stripe") + F.col("d")) % many)
    theirs = boxes.select(F.col("stripe").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    gap = F.aggregate(F.arrays_zip("low", "high", "low2", "high2"), F.lit(0.0), lambda s, b: s + F.pow(F.greatest(b["low"] - b["high2"], b["low2"] - b["high"], F.lit(0.0)), 2))
    pairs = ahead.join(theirs, "j").where(gap <= 2 - 2 * threshold + 1e-6).select((F.col("stripe") * many + F.col("j")).alias("unit"), F.col("stripe").alias("i"), "j")
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("stripe"))
    sides = pairs.select("unit", F.explode(F.when(F.col("i") == F.col("j"), F.array(side(0, "i"))).otherwise(F.array(side(1, "i"), side(2, "j")))).alias("s")).select("unit", "s.side", "s.stripe")
    met = sides.join(numbered, "stripe").select("unit", "side", *(c.split()[0] for c in _TILE.split(", ")), "m")
    met = met.repartition("unit").sortWithinPartitions("unit", "side", "m").drop("m")
    found = cut(met.mapInArrow(_products(threshold, kind), "id long, row long, n long, other long, other_row long"), "links")
    counts = found.where("other is null").groupBy("row").agg(F.sum("n").alias("links"))
    joined = found.where("other is not null")
    # vertices in order of vec_id, then of row
    comp = components(joined.select(F.struct("id", "row").alias("u"), F.struct(F.col("other").alias("id"), F.col("other_row").alias("row")).alias("v")), "vectors")
    comp = comp.select(F.col("id.row").alias("row"), F.col("component.id").alias("component"))
    forget(tiles, boxes)
    out = placed.select("vec_id", "row").join(counts, "row", "left").join(comp, "row", "left")
    component = F.coalesce(F.col("component"), F.col("vec_id"))
    return out.select("vec_id", F.coalesce(F.col("links"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
