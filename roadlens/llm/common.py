"""What the corpus operators share: table access, cutting lineage, hashing kernels, components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, as the session names it. Where it names none, a local master
    gets a folder below the warehouse, which its only process can read; a cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which is deleted when the application ends."""
    path = f"{shared_dir(spark)}/roadlens/{name}-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: the lineage ends there, and a lost
    executor takes nothing with it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._roadlens_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the files behind frames made by cut() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_roadlens_path", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


# ---------------------------------------------------------------------------------- hashing

_rng = np.random.default_rng(20240607)
BYTE_HASH = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
PIECE = 1 << 19
SHORT = 16  # bytes
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 4 * PIECE:
            _powers[str(base)] = have
    return have[:n]


PRIME = np.uint64(2**31 - 1)
PRIME_BYTE = _rng.permutation(1 << 20)[:256].astype(np.uint64) * np.uint64(2039) + np.uint64(1)
PRIME_BASE = 1_582_043_177
_prime_powers: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """Numbers below 2^62 modulo PRIME, up to one multiple of it."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return (x & PRIME) + (x >> np.uint64(31))


def _prime_power(base: int, n: int) -> np.ndarray:
    have = _prime_powers.get(base)
    if have is None or len(have) < n:
        have, step = np.ones(1, np.uint64), base
        while len(have) < n:
            have = np.r_[have, _folded(have * np.uint64(step)) % PRIME]
            step = step * step % int(PRIME)
        if n <= 4 * PIECE:
            _prime_powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_piece(data: np.ndarray, starts: np.ndarray, gaps: np.ndarray, fold: np.ndarray = LOWER):
    """Hashes, start offsets and end offsets of the words of one buffer. starts: where documents
    begin. fold: what stands for each byte. gaps: by folded byte, whether it separates words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z
    low = fold[data]
    inside = ~gaps[low]
    brk = np.zeros(n + 1, bool)
    brk[starts[starts < n]] = True
    brk[0] = brk[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    s = np.flatnonzero(inside & (~before | brk[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    e = np.flatnonzero(inside & (~after | brk[1:])) + 1
    return _span_hashes(low, s, e), s, e


def _span_hashes(units: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    n = len(units)
    if units.dtype == np.uint8:
        value, residue = BYTE_HASH[units], PRIME_BYTE[units]
    else:  # code points
        value = mix(units.astype(np.uint64) + BYTE_HASH[0]) | np.uint64(1)
        residue = units.astype(np.uint64) * np.uint64(1901) + np.uint64(1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(value * _power(BASE, n), dtype=np.uint64, out=sums[1:])
    wide = (sums[e] - sums[s]) * _power(BASE_INV, n)[s]
    # words that agree modulo 2^64 whatever the base (such words are easily made) differ modulo a prime
    np.cumsum(_folded(residue * _prime_power(PRIME_BASE, n)), dtype=np.uint64, out=sums[1:])
    prime = (sums[e] - sums[s]) % PRIME * _prime_power(pow(PRIME_BASE, -1, int(PRIME)), n)[s] % PRIME
    return mix(wide ^ mix(prime))


def span_hashes(units: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the spans units[s:e] (bytes or code points; starts and ends ascend), a bounded piece
    at a time."""
    out, at = np.zeros(len(s), np.uint64), 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + 2 * PIECE, "right")))
        lo = int(s[at])
        out[at:to] = _span_hashes(units[lo : int(e[to - 1])], s[at:to] - lo, e[at:to] - lo)
        at = to
    return out


def edge_words(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """By span data[s:e] of bytes, its first and last eight bytes as two numbers (of eight bytes at
    most, those bytes and 0). With its size they tell a span of SHORT bytes at most from all others."""
    size = e - s
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    load = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = np.zeros((2, len(s)), np.uint64)
    out[0] = load[s] & LOW_BYTES[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    out[1, long] = load[e[long] - 8]
    return out


def chunk_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of spans of bytes, whose edge_words are given: of these alone where they tell the span."""
    size = e - s
    out = mix(words[0] ^ mix(words[1] + size.astype(np.uint64) * BASE))
    long = np.flatnonzero(size > SHORT)
    if len(long):
        upto = np.cumsum(size[long])
        out[long] = span_hashes(data[spread(s[long], size[long])], upto - size[long], upto)
    return out


def text_buffers(column):
    """(bytes, offsets, validity) of an Arrow string column; null texts come out empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = column.type == pa.large_string()
    off = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data, off


def documents_in_pieces(off: np.ndarray, most: int = PIECE):
    """Ranges [i, j) of documents that hold about `most` bytes together, one document at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACES, fold: np.ndarray = LOWER):
    """For every document: its words' 64-bit hashes. Yields (document index, hashes, starts, ends)
    with byte offsets from the document's start. A document longer than a piece is cut at gaps."""
    for i, j in documents_in_pieces(off):
        lo, hi = int(off[i]), int(off[j])
        if j - i > 1 or hi - lo <= 2 * PIECE:
            h, s, e = _hash_piece(data[lo:hi], off[i:j] - lo, gaps, fold)
            at = np.searchsorted(s, off[i : j + 1] - lo)
            for k in range(i, j):
                a, b = at[k - i], at[k - i + 1]
                base = int(off[k]) - lo
                yield k, h[a:b], s[a:b] - base, e[a:b] - base
            continue
        parts, x = [], lo
        while x < hi:
            y = min(hi, x + PIECE)
            if y < hi:
                inside = np.flatnonzero(gaps[fold[data[x:y]]])
                while not len(inside) and y < hi:  # one word longer than a piece
                    z = min(hi, y + PIECE)
                    more = np.flatnonzero(gaps[fold[data[y:z]]])
                    inside, y = (more + (y - x), z) if len(more) else (more, z)
                if y < hi or len(inside):
                    y = x + int(inside[-1]) + 1 if len(inside) else y
            h, s, e = _hash_piece(data[x:y], np.zeros(1, np.int64), gaps, fold)
            parts.append((h, s + (x - lo), e + (x - lo)))
            x = y
        yield i, *(np.concatenate([p[q] for p in parts]) for q in range(3))


def spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places at[0] .. at[0] + size[0] - 1, at[1] .. and so on."""
    upto = np.cumsum(size)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(at - (upto - size), size)


class Ragged:
    """Rows of different lengths in one growing array."""

    def __init__(self, kind):
        self.flat, self.at, self.size = np.zeros(1 << 12, kind), np.zeros(1 << 10, np.int64), np.zeros(1 << 10, np.int64)
        self.n, self.held = 0, 0

    def extend(self, flat: np.ndarray, size: np.ndarray) -> None:
        while self.held + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while self.n + len(size) > len(self.at):
            self.at, self.size = np.r_[self.at, np.zeros_like(self.at)], np.r_[self.size, np.zeros_like(self.size)]
        self.flat[self.held : self.held + len(flat)] = flat
        self.at[self.n : self.n + len(size)] = self.held + np.cumsum(size) - size
        self.size[self.n : self.n + len(size)] = size
        self.n, self.held = self.n + len(size), self.held + len(flat)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """These rows' values, one after the other, and their sizes."""
        size = self.size[rows]
        return self.flat[spread(self.at[rows], size)], size

    def keep(self, rows: np.ndarray) -> None:
        flat, size = self.take(rows)
        self.n = self.held = 0
        self.extend(flat, size)


class Known:
    """Distinct words (or other strings of units) met so far, each with a row number.

    Rows are found by hash in arrays, many at once, and told apart by comparing all their units, so
    hashes that clash do no harm; given the edge_words of all, short ones are compared by these.
    `payloads` hold what is known of each row. When `most` rows are
    full, those used in the most batches stay, a quarter of them."""

    def __init__(self, most: int, kind, payloads: list[Ragged]):
        self.most, self.slots = most, 1 << (2 * most - 1).bit_length()
        self.units, self.payloads = Ragged(kind), payloads
        self.hash, self.used, self.edges = np.zeros(most, np.uint64), np.zeros(most, np.int32), np.zeros((2, most), np.uint64)
        self._clear()

    def _clear(self) -> None:
        self.row = np.full(self.slots, -1, np.int32)

    def _find(self, h, data, s, e, edges=None) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        todo, slot = np.arange(len(h)), (h & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            row = self.row[slot].astype(np.int64)
            free = row < 0
            same = ~free
            same[same] = (self.hash[row[same]] == h[todo[same]]) & (self.units.size[row[same]] == (e - s)[todo[same]])
            own, at = row[same], todo[same]
            if len(own):
                bad = np.zeros(len(own), bool)
                rest = np.arange(len(own))
                if edges is not None:
                    bad = (self.edges[0, own] != edges[0, at]) | (self.edges[1, own] != edges[1, at])
                    rest = np.flatnonzero(((e - s)[at] > SHORT) & ~bad)
                size = (e - s)[at[rest]]
                unlike = self.units.flat[spread(self.units.at[own[rest]], size)] != data[spread(s[at[rest]], size)]
                if unlike.any():
                    bad[np.repeat(rest, size)[unlike]] = True
                if bad.any():
                    same[np.flatnonzero(same)[bad]] = False
                    own, at = own[~bad], at[~bad]
                out[at] = own
            on = ~free & ~same
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        return out

    def _insert(self, rows: np.ndarray) -> None:
        """Slots for rows, whose hashes may agree."""
        todo, slot = rows, (self.hash[rows] & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.row[slot] < 0
            self.row[slot[free]] = todo[free]
            on = self.row[slot] != todo
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)

    def rows(self, h, data, s, e, learn, edges=None) -> np.ndarray | None:
        """The row of each word data[s:e] with hash h. learn(indices) adds the payloads of words that
        are new. None if there are more distinct words than rows. edges: edge_words, in all calls or
        in none."""
        got = self._find(h, data, s, e, edges)
        while (got < 0).any():
            miss = np.flatnonzero(got < 0)
            new = np.sort(miss[np.unique(h[miss], return_index=True)[1]])
            if self.units.n + len(new) > self.most:
                if len(new) > self.most // 2:
                    return None
                self._shrink()
                got = self._find(h, data, s, e, edges)
                continue
            learn(new)
            first, size = self.units.n, (e - s)[new]
            self.units.extend(data[spread(s[new], size)], size)
            self.hash[first : self.units.n], self.used[first : self.units.n] = h[new], 0
            if edges is not None:
                self.edges[:, first : self.units.n] = edges[:, new]
            self._insert(np.arange(first, self.units.n))
            got[miss] = self._find(h[miss], data, s[miss], e[miss], None if edges is None else edges[:, miss])
        some = np.zeros(self.units.n, bool)
        some[got] = True
        self.used[: self.units.n] += some
        return got

    def _shrink(self) -> None:
        n = self.units.n
        stay = np.sort(np.argsort(-self.used[:n], kind="stable")[: n // 4])
        for r in (self.units, *self.payloads):
            r.keep(stay)
        self.hash[: len(stay)], self.used[: len(stay)] = self.hash[stay], self.used[stay] // 2
        self.edges[:, : len(stay)] = self.edges[:, stay]
        self._clear()
        self._insert(np.arange(len(stay)))


STEP = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; of fewer words, one of the whole sequence."""
    n = len(h)
    if not n:
        return h
    if n < k:
        return mix((h * STEP[:n]).sum(dtype=np.uint64, keepdims=True) + STEP[40 + n % 20])
    s = h[: n - k + 1] * STEP[0]
    for q in range(1, k):
        s = s + h[q : n - k + 1 + q] * STEP[q]
    return np.unique(mix(s))


# ------------------------------------------------------------------------------- components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(u, v): (id, component) with the smallest id reachable, for
    every id that has an edge to another.

    Each round every vertex points to its smallest neighbour (an aggregate that combines before
    the shuffle, so that a hub costs no more than others), pointers are followed twice, and the
    graph is contracted to the vertices pointed to. Rounds are logarithmic in the longest path;
    each one's tables are written to the shared folder."""
    e = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-edges")
    maps: list[DataFrame] = []
    while not e.isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        p = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("p"))
        p = cut(p, f"{name}-point")
        for _ in range(2):
            q = p.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            nxt = cut(p.join(q, "p").select("u", F.col("pp").alias("p")), f"{name}-jump")
            forget(p)
            p = nxt
        maps.append(p)
        to_u, to_v = p.select("u", F.col("p").alias("pu")), p.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        nxt = e.join(to_u, "u").join(to_v, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        nxt = cut(nxt, f"{name}-edges")
        forget(e)
        e = nxt
    if not maps:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out = maps[-1].select("u", "p")
    for m in reversed(maps[:-1]):
        up = out.select(F.col("u").alias("p"), F.col("p").alias("pp"))
        out = m.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
    out = cut(out.select(F.col("u").alias("id"), F.col("p").alias("component")), name)
    forget(e, *maps)
    return out
