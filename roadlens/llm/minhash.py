"""Near-duplicate documents by an LSH forest of MinHash signatures.

Words are runs without ASCII white space of the text with A-Z lower-cased; a document's set holds
its distinct k-word shingles (of fewer words: the whole sequence as one). Documents whose sets have
a Jaccard similarity of `threshold` or more are linked; components of links are groups.

Plan, by size of what is shuffled:

1. One pass over the texts gives each document its set's size, a 128-bit digest of the set and a
   MinHash signature. Documents with equal digests are one class; only its smallest id goes on, so
   groups of copies of any size cost one row after a pre-aggregated group-by.
2. The signature read from TREES different places, cyclically, gives TREES sorted orders. Rows whose
   first LEAST values of an order are nobody else's drop out by a bitmap of the others' hashes; the
   rest are sorted, range-partitioned by their whole strings, so no prefix is a hot key.
3. Every task walks its part of the orders with the longest common prefixes of neighbours. A region
   is a run that shares LEAST values; one of more than `region` rows falls apart where its common
   prefix is shortest, again and again (adaptive depth). Rows of a region are candidates: their
   similarities are estimated from a finer signature of FINE values without emitting pairs, and a
   maximum spanning forest of the estimates above a wide margin is emitted, and each row's NEAREST
   best neighbours.
4. Candidates are confirmed on whole sets; components follow by contraction.
5. What was cut in 3, by splitting regions, by the ends of tasks and by emitting forests, is made up
   for: in every region of the least depth all rows of different components meet, those of a large
   one by pairs of blocks of bounded size. Those estimated above the margin are compared on whole
   sets.

Defined results: null or word-less text: empty set, linked with nothing; null doc_id: reported with
a null component and kept false; repeated rows: one class, each row reported; empty table: no rows.
Extra columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import components, cut, forget, mix, shingle_set, text_buffers, word_hashes

TREES, STEP_VALUES = 20, 3
VALUES = TREES * STEP_VALUES
LEAST, DEEPEST = 3, 24  # values of an order that a region shares at least, and that are sorted by
REGION = 256  # rows of a region that are compared with each other at most
BLOCK = 1024  # rows of a unit of the last comparison at most
FINE = 256  # values of the signatures that similarities are estimated from, a byte each
NEAREST = 8
SEED = np.random.default_rng(77).integers(1, 2**63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
XOR = np.random.default_rng(78).integers(0, 2**63, VALUES, dtype=np.uint64)


def _signature(s: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, 2**64 - 1, np.uint64)
    for a in range(0, len(s), 2048):
        part = s[a : a + 2048, None] ^ XOR[None, :]
        part *= SEED[None, :]
        np.minimum(low, part.min(axis=0), out=low)
    return (mix(low) >> np.uint64(32)).astype(">u4")


FINE_SEED = (np.random.default_rng(79).integers(0, 2**31, FINE, dtype=np.uint32) * np.uint32(2)) | np.uint32(1)
FINE_XOR = np.random.default_rng(80).integers(0, 2**32, FINE, dtype=np.uint32)


def _fine(k: int):
    """Rows (id, text) and their finer signatures."""

    def signature(s: np.ndarray) -> bytes:
        s, low = (s >> np.uint64(32)).astype(np.uint32), np.full(FINE, 2**32 - 1, np.uint32)
        for a in range(0, len(s), 2048):
            part = s[a : a + 2048, None] ^ FINE_XOR[None, :]
            part *= FINE_SEED[None, :]
            np.minimum(low, part.min(axis=0), out=low)
        return (mix(low.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()

    def run(batches):
        for batch in batches:
            sig = [signature(shingle_set(h, k)) for _, h, _, _ in word_hashes(*text_buffers(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sig, pa.binary())], ["id", "text", "sig1"])

    return run


def _sketch(k: int):
    def run(batches):
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            ids = batch.column(0)
            size, one, two, sig = [], [], [], []
            for _, h, _, _ in word_hashes(data, off):
                s = shingle_set(h, k)
                size.append(len(s))
                one.append(int(s.sum(dtype=np.uint64).astype(np.int64)) if len(s) else 0)
                two.append(int(np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF))).astype(np.int64)) if len(s) else 0)
                sig.append(_signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(size, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "h1", "h2", "sig"])

    return run


def _estimates(sig: np.ndarray) -> np.ndarray:
    """Estimated similarity of every two rows of one bounded region (at most a few thousand)."""
    m = len(sig)
    out = np.zeros((m, m), np.float32)
    for a in range(0, m, 64):
        out[a : a + 64] = (sig[a : a + 64, None, :] == sig[None, :, :]).sum(axis=2, dtype=np.uint16)
    out = (out / FINE - 1 / 256) / (1 - 1 / 256)
    np.fill_diagonal(out, -1)
    return out


def _forest(est: np.ndarray, floor: float) -> list[tuple[int, int]]:
    """A maximum spanning forest over entries of at least floor, and each row's best neighbours."""
    m = len(est)
    best = np.argpartition(-est, min(NEAREST, m - 1) - 1, axis=1)[:, :NEAREST] if m > 1 else np.zeros((m, 0), int)
    edges = {(min(i, j), max(i, j)) for i, row in enumerate(best.tolist()) for j in row if est[i, j] >= floor}
    left, reach, via = np.ones(m, bool), np.full(m, -1.0, np.float32), np.zeros(m, np.int64)
    for _ in range(m):
        i = int(np.where(left, reach, -2).argmax())
        if reach[i] >= floor:
            j = int(via[i])
            edges.add((min(i, j), max(i, j)))
        left[i] = False
        closer = left & (est[i] > reach)
        reach[closer], via[closer] = est[i][closer], i
    return sorted(edges)


def common_prefixes(keys: np.ndarray) -> np.ndarray:
    """How many values each row of sorted strings (rows x values) shares with the one before; -1 first."""
    same = keys[1:] == keys[:-1]
    return np.r_[-1, np.where(same.all(axis=1), keys.shape[1], same.argmin(axis=1))]


def parts_of(lcp: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of at most `most` rows: a longer one falls apart at its least common prefix, of several
    at the one nearest to its middle."""
    todo, out = [(0, len(lcp))], []
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            out.append((a, b))
            continue
        low = np.flatnonzero(lcp[a + 1 : b] == lcp[a + 1 : b].min()) + a + 1
        at = int(low[np.abs(low - (a + b) // 2).argmin()])
        todo += [(a, at), (at, b)]
    return sorted(out)


def _in_orders(floor: float, region: int):
    """Rows (t, key, id, sig1), sorted, to candidate pairs (a, b). State: rows of one region, up to
    4 * region of them; of a longer one all but the last part are done with as it goes."""

    def run(batches):
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        def work(ids, sigs):
            if len(ids) < 2:
                return []
            sig = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(ids), FINE)
            if len(ids) == 2:
                pairs = [(0, 1)] if (sig[0] == sig[1]).sum() >= floor * FINE else []
            else:
                pairs = _forest(_estimates(sig), floor)
            return [(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in pairs if ids[i] != ids[j]]

        def settle(rows, last):
            """Pairs of a region's parts, and the rows of its last part unless the region ends here."""
            keys = np.frombuffer(b"".join(r[1] for r in rows), ">u4").reshape(len(rows), -1)
            parts = parts_of(common_prefixes(keys), region)
            rest = [] if last else rows[parts[-1][0] :]
            found = []
            for a, b in parts if last else parts[:-1]:
                found += work([r[0] for r in rows[a:b]], [r[2] for r in rows[a:b]])
            return found, rest

        head, rows, found = None, [], []
        for batch in batches:
            for t, key, i, s in zip(*(batch.column(c).to_pylist() for c in range(4))):
                here = (t, key[: 4 * LEAST])
                if here != head:
                    found += settle(rows, True)[0] if len(rows) > 1 else []
                    head, rows = here, []
                elif len(rows) >= 4 * region:
                    some, rows = settle(rows, False)
                    found += some
                rows.append((i, key, s))
                if len(found) > 20_000:
                    yield out(found)
                    found = []
        if len(rows) > 1:
            found += settle(rows, True)[0]
        yield out(found)

    return run


def _confirm(k: int, percent: int):
    """Rows (a, b, text_a, text_b), those of one a together where they can be, to links (u, v)."""

    def sets(column):
        data, off = text_buffers(column)
        return [shingle_set(h, k) for _, h, _, _ in word_hashes(data, off)]

    def run(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 64):
                part = batch.slice(x, 64)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                keep = []
                for p, q in zip(sets(part.column(2)), sets(part.column(3))):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([pa.array([i for i, y in zip(a, keep) if y], pa.int64()), pa.array([i for i, y in zip(b, keep) if y], pa.int64())], ["u", "v"])

    return run


def _candidates(reps: DataFrame, texts: DataFrame, k: int, floor: float, region: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidate pairs (a, b) from reps(id, sig), (id, text, sig1) of all in shared regions, and the
    regions (id, t, key) of the least depth."""
    twice = F.concat("sig", "sig")
    string = lambda values: F.substring(twice, F.col("t") * (4 * STEP_VALUES) + 1, F.lit(4 * values))
    spots = reps.select("id", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"), "sig")
    keys = spots.select("id", "t", F.xxhash64("t", string(LEAST)).alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    regions = cut(by_bitmap(keys, shared, "left_semi", "key"), "regions")
    near = by_bitmap(texts, regions.select("id").distinct(), "left_semi").dropDuplicates(["id", "text"])
    near = cut(near.mapInArrow(_fine(k), "id long, text string, sig1 binary"), "near")
    rows = regions.select("id", "t").join(reps, "id").join(near.select("id", "sig1"), "id").select("t", string(DEEPEST).alias("key"), "id", "sig1")
    orders = rows.repartitionByRange("t", "key").sortWithinPartitions("t", "key", "id")
    return orders.mapInArrow(_in_orders(floor, region), "a long, b long"), near, regions


SALTS = 32


def _salted(big: DataFrame, small: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """big joined with small, whose rows are unique by `on`, where one key may hold a large share of
    big: its rows go SALTS ways by the column `by`."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return big.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS).cast("long"))).join(small.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


UNIT_BYTES = 16 << 20  # of texts that one task holds at most, but for single longer texts


def _blocks(rows: DataFrame, region: int) -> DataFrame:
    """Rows (key, t, id, c, bytes) of regions with several components c to rows (unit, side, t, id, c):
    every two rows of a region with different c meet in a unit of about `region` rows at most. A region
    that is larger is dealt into blocks, and each pair of blocks is a unit, one block on each side;
    blocks within one component needn't meet."""
    load = lambda n, b: F.ceil(F.greatest(2 * F.col(n) / region, 2 * F.col(b) / UNIT_BYTES))
    groups = rows.groupBy("key", "c").agg(F.count("*").alias("m"), F.sum("bytes").alias("b"))
    totals = groups.groupBy("key").agg(F.sum("m").alias("all_m"), F.sum("b").alias("all_b"), F.count("*").alias("cs")).where("cs > 1")
    rows = by_bitmap(rows, totals, "left_semi", "key")
    groups = _salted(groups, totals, ["key"], "c").withColumn("whole", (F.col("all_m") <= region) & (F.col("all_b") <= UNIT_BYTES)).withColumn("own", ~F.col("whole") & (load("m", "b") > 1))
    pool = groups.where("not own").groupBy("key").agg(F.sum("m").alias("pool_m"), F.sum("b").alias("pool_b"))
    plan = _salted(groups, pool, ["key"], "c", "left").select("key", "c", "whole", "own", F.when(F.col("own"), load("m", "b")).otherwise(load("pool_m", "pool_b")).alias("parts"))
    block = F.when(F.col("whole"), F.lit(0)).when(F.col("own"), F.xxhash64("c", F.pmod(F.xxhash64("id"), "parts"))).otherwise(F.pmod(F.xxhash64("c"), "parts"))
    dealt = cut(_salted(rows, plan, ["key", "c"], "id").select("key", "t", "id", "c", block.alias("block"), F.when(F.col("own"), F.col("c")).alias("own")), "blocks")
    blocks = dealt.select("key", "block", "own").distinct()
    two = blocks.alias("x").join(blocks.alias("y"), "key").where("x.block <= y.block and (x.own is null or y.own is null or x.own <> y.own)")
    unit = F.xxhash64("key", F.col("x.block"), F.col("y.block"))
    ends = F.when(F.col("x.block") == F.col("y.block"), F.array(F.struct(F.lit(0).alias("side"), F.col("x.block").alias("block")))).otherwise(F.array(F.struct(F.lit(1).alias("side"), F.col("x.block").alias("block")), F.struct(F.lit(2).alias("side"), F.col("y.block").alias("block"))))
    sides = two.select("key", unit.alias("unit"), F.explode(ends).alias("e")).select("key", "unit", "e.side", "e.block")
    return dealt.join(sides, ["key", "block"]).select("unit", "side", "t", "id", "c")


def _by_unit(work, names: list[str]):
    """Rows sorted by their first column: work(the columns of one unit) makes rows of `names`."""

    def run(batches):
        def out(rows):
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        unit, held, found = None, [], []
        for batch in batches:
            heads = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(heads[1:] != heads[:-1]) + 1, len(heads)] if len(heads) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if heads[a] != unit:
                    if held:
                        found += work(pa.Table.from_batches(held))
                    unit, held = heads[a], []
                    if len(found) > 20_000:
                        yield out(found)
                        found = []
                held.append(batch.slice(a, b - a))
        if held:
            found += work(pa.Table.from_batches(held))
        yield out(found)

    return run


def _apart(side: np.ndarray, c: np.ndarray, at: slice) -> np.ndarray:
    """Which rows of a unit those at `at` have to meet."""
    return (c[at, None] != c[None, :]) & ((side[at, None] == 0) | (side[at, None] != side[None, :]))


def _suspects(floor: float):
    """A unit's rows (unit, side, t, id, c, sig, sig1) that are estimated at `floor` or more with one
    of another component, in the first tree where the two share a region."""

    def work(rows):
        side, t, ids, c = (rows.column(n).to_numpy() for n in ("side", "t", "id", "c"))
        fine = np.frombuffer(b"".join(rows.column("sig1").to_pylist()), np.uint8).reshape(len(ids), FINE)
        trees = np.frombuffer(b"".join(rows.column("sig").to_pylist()), ">u4").reshape(len(ids), TREES, STEP_VALUES)
        hit = np.zeros(len(ids), bool)
        least = floor * FINE
        for a in range(0, len(ids), 64):
            at = slice(a, a + 64)
            i, j = np.nonzero(_apart(side, c, at))
            for x in range(0, len(i), 1 << 14):
                p, q = i[x : x + (1 << 14)] + a, j[x : x + (1 << 14)]
                ok = (fine[p] == fine[q]).sum(axis=1) >= least
                p, q = p[ok], q[ok]
                first = (trees[p] == trees[q]).all(axis=2).argmax(axis=1) == t[p]
                hit[p[first]] = hit[q[first]] = True
        unit = int(rows.column("unit")[0].as_py())
        return [(unit, int(side[k]), int(ids[k]), int(c[k])) for k in np.flatnonzero(hit)]

    return _by_unit(work, ["unit", "side", "id", "c"])


def _links(k: int, percent: int):
    """A unit's rows (unit, side, id, c, text) to links (u, v): whole sets of every two of different
    components are compared; of links that join the same rows a forest is emitted."""

    def work(rows):
        side, ids, c = (rows.column(n).to_numpy() for n in ("side", "id", "c"))
        sets = [shingle_set(h, k) for _, h, _, _ in word_hashes(*text_buffers(rows.column("text")))]
        size = np.array([len(s) for s in sets], np.int64)
        values, place = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(place, kind="stable")
        owner = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
        count = np.bincount(place, minlength=len(values))
        begin = np.r_[0, np.cumsum(size)]
        post = np.cumsum(count) - count
        parent = {x: x for x in c.tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        found = []
        for i in range(len(sets)):
            both = np.zeros(len(sets), np.int64)
            for y in range(begin[i], begin[i + 1], 4096):  # bounds the postings held at once
                w = place[y : min(y + 4096, begin[i + 1])]
                n = count[w]
                upto = np.cumsum(n)
                both += np.bincount(owner[np.arange(upto[-1]) + np.repeat(post[w] - (upto - n), n)], minlength=len(sets))
            linked = (both > 0) & (100 * both >= percent * (size[i] + size - both)) & _apart(side, c, slice(i, i + 1))[0]
            for j in np.flatnonzero(linked):
                p, q = root(int(c[i])), root(int(c[j]))
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    found.append((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
        return found

    return _by_unit(work, ["u", "v"])


def _missed(regions: DataFrame, reps: DataFrame, texts: DataFrame, comp: DataFrame, k: int, percent: int, floor: float, region: int) -> DataFrame:
    """Links (u, v) between components comp(id, component), of every two rows that share a region
    (t, key, id) and are estimated at floor or more: no cap and no split decides."""
    rows = regions.select("key", "t", "id").join(comp, "id", "left").join(texts.select("id", F.octet_length("text").alias("bytes")), "id")
    rows = rows.select("key", "t", "id", F.coalesce("component", "id").alias("c"), "bytes")
    units = _blocks(rows, region).join(reps, "id").join(texts.select("id", "sig1"), "id").select("unit", "side", "t", "id", "c", "sig", "sig1")
    some = units.repartition("unit").sortWithinPartitions("unit").mapInArrow(_suspects(floor), "unit long, side long, id long, c long")
    some = cut(some, "suspects").join(texts.select("id", "text"), "id").select("unit", "side", "id", "c", "text")
    return cut(some.repartition("unit").sortWithinPartitions("unit", "id").mapInArrow(_links(k, percent), "u long, v long"), "missed")


FILTER_WORDS = 1 << 18  # of 64 bits: the bound of what by_bitmap() broadcasts, 4 MB


def by_bitmap(rows: DataFrame, ids: DataFrame, how: str, on: str = "id") -> DataFrame:
    """how left_semi: the rows whose id is in ids(id), and a few more; left_anti: only rows whose id
    is not in it, nearly all of them. A bitmap of hashed ids, of a fixed size whatever the input, is
    broadcast, so that rows are told apart before any shuffle. on: the column that holds ids."""
    spot = f"pmod(xxhash64({on}), {FILTER_WORDS * 64}L)"
    word, bit = F.expr(f"shiftright({spot}, 6)"), F.expr(f"shiftleft(1L, int({spot} % 64))")
    bitmap = ids.where(f"{on} is not null").groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return rows.join(F.broadcast(bitmap), (word == bitmap["word"]) & (bitmap["bits"].bitwiseAND(bit) != 0), how)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, region: int = REGION, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text). percent: the
    similarity, in hundredths, from which documents are linked. region, block: the rows that one task
    compares with each other at most, in the orders and at last."""
    floor = percent / 100 - 4.5 * float(np.sqrt(percent / 100 * (1 - percent / 100) / FINE))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = cut(slim.mapInArrow(_sketch(k), "doc_id long, n_shingles long, h1 long, h2 long, sig binary"), "sketch")
    some = sketch.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("id"), F.count("*").alias("n")), "classes")
    lead = classes.select("id", "h1", "h2")
    reps = some.select(F.col("doc_id").alias("id"), "h1", "h2", "sig").join(lead, ["id", "h1", "h2"]).select("id", "sig").dropDuplicates(["id", "sig"])
    found, texts, regions = _candidates(reps, slim.withColumnRenamed("doc_id", "id"), k, floor, region)
    pairs = cut(found.distinct(), "pairs")
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    links = cut(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(k, percent), "u long, v long"), "links")
    comp = components(links, "near")
    missed = _missed(regions, reps, texts, comp, k, percent, floor, block)
    if not missed.isEmpty():
        forget(comp)
        comp = components(links.union(missed), "near")
    forget(texts, pairs, regions, links, missed)
    joined = classes.join(comp, "id", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "id").alias("component"), "n", F.col("component").isNotNull().alias("linked"))
    joined = joined.where("n > 1 or linked").drop("n", "linked")
    out = _salted(sketch.drop("sig"), joined, ["h1", "h2", "n_shingles"], "doc_id", "left")
    comp_id = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    comp_id = F.when(F.col("doc_id").isNotNull(), comp_id)
    return out.select("doc_id", "n_shingles", comp_id.alias("component_id"), F.coalesce(F.col("doc_id") == comp_id, F.lit(False)).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group, that of the smallest doc_id (null last), and all their
    columns. Rows with equal doc_id and text are one document, of which any one row stays; rows that
    repeat a doc_id with another text are documents of their own, the smaller text first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("doc"))
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        place = [F.col("id").asc_nulls_last(), F.col("text").asc_nulls_last()]
        rows = rows.dropDuplicates(["id", "text"]).repartitionByRange(*place).sortWithinPartitions(*place)
        rows = cut(rows.withColumn("id", F.monotonically_increasing_id()), "numbered")
    judged = near_duplicates(rows.select(F.col("id").alias("doc_id"), "text"), k, percent)
    gone = cut(judged.where("not kept").select(F.col("doc_id").alias("id")), "gone")
    certain = by_bitmap(rows, gone, "left_anti")
    others = by_bitmap(rows, gone, "left_semi").join(gone, "id", "left_anti")
    return certain.select("doc.*").unionByName(others.select("doc.*"))
