"""Approximate nearest neighbours by a forest of hash-prefix trees.

Base vectors are dealt by hash to shards of about SHARD rows; copies of one vector spread evenly. In
a shard every tree gives each vector a string of BITS hash bits (signs of random projections of the
vector less the shard's mean) and keeps these strings in a sorted array. A query descends in every
tree to its longest matching prefix, found by binary search, and all trees then ascend together, a
bit at a time, until the intervals of that prefix length hold `share` of the shard's rows (and FEWEST at least). These
candidates are ranked by exact Euclidean distance of the original vectors in double precision;
rows of equal strings are always taken together, so no number of copies is cut off.

Every query visits every shard, in blocks: one stated set of queries against all rows. A unit of work
is one shard and about GROUP blocks, dealt by its number: however many queries there are, no unit
grows, and a shard is shipped and hashed once for all blocks of a unit. Of a unit only each query's
k nearest go on, and per-task limits precede the final ranking.

`share` sets recall: random directions of 64 dimensions have no near neighbours to speak of and need
about a third of the rows as candidates for a recall over 0.9; data with clusters need far less.

Defined results: null or zero vectors, those with null or non-finite components or of another
dimension than most, and null vec_ids take no part, as queries or candidates; rows that repeat the
query's vec_id are its own; of rows that repeat a query's vec_id the smallest vector is the query;
repeated candidates are each ranked; ties go to smaller vec_ids; an empty table gives no rows;
extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.vectors import matrix, usable

SHARD = 8192
BLOCK = 512
GROUP = 16  # blocks of queries in a unit
TREES = 64
BITS = 32
SHARE = 0.42
FEWEST = 1024  # candidates in a shard at least


def _packed(batches):
    """Rows (key, vec_id, e) in runs of one key to one row (key, ids, e) each."""

    def out(key, ids, e):
        row = [[key], [np.concatenate(ids).astype("<i8").tobytes()], [np.concatenate(e).astype("<f8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int64(), pa.binary(), pa.binary()))], ["key", "ids", "e"])

    key, ids, e = None, [], []
    for b in batches:
        if not b.num_rows:
            continue
        keys, own, vec = np.asarray(b.column(0)), np.asarray(b.column(1)), matrix(b.column(2))
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            if ids and keys[x] != key:
                yield out(key, ids, e)
                ids, e = [], []
            key = int(keys[x])
            ids.append(own[x:y])
            e.append(vec[x:y])
    if ids:
        yield out(key, ids, e)


def _blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    key = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // size))))
    dealt = rows.select(key.cast("long").alias("key"), "vec_id", "e").repartition("key").sortWithinPartitions("key", "vec_id")
    return dealt.mapInArrow(_packed, "key long, ids binary, e binary")


class PrefixForest:
    """The sorted hash strings of one shard's vectors."""

    def __init__(self, x: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 11):
        self.x, self.trees, self.bits = x, trees, bits
        rng = np.random.default_rng(seed)
        self.mean = x.mean(axis=0)
        self.planes = rng.standard_normal((x.shape[1], trees * bits))
        h = self.strings(x)
        self.order = np.argsort(h, axis=0, kind="stable")
        self.sorted = np.take_along_axis(h, self.order, axis=0)

    def strings(self, v: np.ndarray) -> np.ndarray:
        """By vector and tree, the bits as one number, first bit highest."""
        out = np.zeros((len(v), self.trees), np.uint64)
        for a in range(0, len(v), 1024):
            sign = (v[a : a + 1024] - self.mean) @ self.planes > 0
            place = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
            out[a : a + 1024] = (sign.reshape(-1, self.trees, self.bits) * place).sum(axis=2, dtype=np.uint64)
        return out

    def candidates(self, queries: np.ndarray, share: float):
        """Each query's candidates: descend to the longest prefixes, ascend in step."""
        h = self.strings(queries)
        n = len(self.x)
        wanted = min(n, max(FEWEST, int(np.ceil(share * n))))
        enough = np.inf if wanted >= n else -n * np.log1p(-wanted / n)  # entries that hold so many distinct rows, about
        lo, hi = {}, {}

        def intervals(level):
            if level not in lo:
                low = (h >> np.uint64(self.bits - level)) << np.uint64(self.bits - level)
                high = low + (np.uint64(1) << np.uint64(self.bits - level))
                lo[level], hi[level] = (np.stack([np.searchsorted(self.sorted[:, t], v[:, t]) for t in range(self.trees)], axis=1) for v in (low, high))
            return lo[level], hi[level]

        level = np.full(len(queries), self.bits)
        for step in range(self.bits, 0, -1):
            a, b = intervals(step)
            short = (b - a).sum(axis=1) < enough
            level[short] = np.minimum(level[short], step - 1)
            if not (level == step - 1).any():
                break
        for q in range(len(queries)):
            at = int(level[q])
            while True:
                hit = np.zeros(n, bool)
                if at == 0:
                    hit[:] = True
                else:
                    a, b = intervals(at)
                    for t in range(self.trees):
                        hit[self.order[a[q, t] : b[q, t], t]] = True
                if at == 0 or hit.sum() >= wanted:
                    break
                at -= 1
            yield np.flatnonzero(hit)


def _search(k: int, share: float):
    """Rows (unit, side, ids, e), by unit a shard (side 0) and then blocks of queries (side 1), to each
    query's k nearest of the shard's candidates."""

    def run(batches):
        unit, ids, shard, forest = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                own, side = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                some_ids = np.frombuffer(batch.column(2)[r].as_py(), "<i8")
                vectors = np.frombuffer(batch.column(3)[r].as_py(), "<f8").reshape(len(some_ids), -1)
                if side == 0:
                    unit, ids, shard, forest = own, some_ids, vectors, None
                    continue
                if own != unit:  # a shard without rows
                    continue
                forest = forest or PrefixForest(shard)
                found = [[], [], []]
                for q, some in enumerate(forest.candidates(vectors, share)):
                    some = some[ids[some] != some_ids[q]]
                    d = np.sqrt(((shard[some] - vectors[q]) ** 2).sum(axis=1))
                    best = np.lexsort((ids[some], d))[:k]
                    found[0].append(np.full(len(best), some_ids[q]))
                    found[1].append(ids[some][best])
                    found[2].append(d[best])
                cols = [np.concatenate(f) for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def _units(packed: DataFrame, side: int, many: int, groups: int) -> DataFrame:
    """Shards in each of their units (side 0), or blocks in the unit of each shard (side 1)."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((groups if side == 0 else many) - 1).cast("long")))
    met = packed.withColumn("other", each)
    unit = F.col("key") * groups + F.col("other") if side == 0 else F.col("other") * groups + F.pmod("key", F.lit(groups).cast("long"))
    return met.select(unit.alias("unit"), F.lit(side).alias("side"), "ids", "e")


def nearest(base: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of base(vec_id, embedding) found for each
    row of queries(vec_id, embedding), by Euclidean distance."""

    def good(df):
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("e")).where("vec_id is not null and e is not null")

    rows, asked = good(base), good(queries)
    dims = rows.groupBy(F.size("e").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = dims if dims is not None else (0, 0)
    asked = asked.where(F.size("e") == dim).groupBy("vec_id").agg(F.min("e").alias("e"))
    shards = _blocks(rows.where(F.size("e") == dim), shard, n)
    n_asked = asked.count()
    blocks = _blocks(asked, BLOCK, n_asked)
    many, groups = max(1, -(-n // shard)), max(1, -(-n_asked // (BLOCK * GROUP)))
    met = _units(shards, 0, many, groups).union(_units(blocks, 1, many, groups))
    met = met.repartition("unit").sortWithinPartitions("unit", "side")
    found = met.mapInArrow(_search(k, share), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
