"""Best-fit packing of documents into training sequences of several permitted lengths.

Every document's length is known; one longer than the largest permitted length is cut into pieces of
that length and a rest, so nothing is dropped. Equal rows are counted and numbered, and pieces are
dealt to tasks by a hash of their identity and number, about `per_task` to a task, so no source,
document or repeated row is a hot key. Each task packs on its own:

* pieces go by decreasing length into the open bin that they leave with the least room (best fit);
* where none has room, a bin is opened of the permitted length that costs least per unit it will
  hold: for every length, the pieces still to come are looked through for those that would fill the
  bin, largest first; the cost is that of the smallest permitted length for these contents and a
  fixed overhead. So all lengths are weighed by the distribution of what is left;
* at the end each bin is downsized to the smallest permitted length that holds its contents;
* the same is done with each permitted length alone, and the cheapest outcome stays.

Defined results: null or empty text has length `end` (its end mark) and is packed as such; rows whose
length is null, 0 or negative hold nothing and give no pieces; null doc_id is packed too; repeated
rows are packed each; ties go by doc_id and piece; an empty table gives no rows; extra columns are
not read."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITIES = (2048, 4096, 8192, 16384)
OVERHEAD = 64
PER_TASK = 50_000


def final_size(used: int, caps: list[int]) -> int:
    return caps[bisect_left(caps, used)]


def _filled(room: int, at: int, negative: list[int], upto: list[int]) -> int:
    """What of the pieces from place `at` on, in decreasing order, goes into room, largest first.
    negative: the lengths, negated; upto: their running sums."""
    took = 0
    while at < len(negative):
        at = bisect_left(negative, took - room, at)  # the first that fits
        if at == len(negative):
            break
        end = bisect_right(upto, upto[at] + room - took) - 1  # and as many of its successors as fit
        took += upto[end] - upto[at]
        at = end
    return took


def best_fit_bins(lengths: list[int], caps: list[int], overhead: int, final: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each length, how much each bin holds), opening bins of sizes `caps`, those
    downsized to sizes `final` afterwards."""
    negative, upto = [-n for n in lengths], [0]
    for n in lengths:
        upto.append(upto[-1] + n)
    room: list[tuple[int, int]] = []  # (room, bin), sorted; a bin's room is that of its opened size
    used, where = [], []
    for i, n in enumerate(lengths):
        at = bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b, least = 0, len(used), None
            fitting = caps[bisect_left(caps, n) :]
            for c in fitting:
                held = n if len(fitting) == 1 else n + _filled(c - n, i + 1, negative, upto)
                cost = (final_size(held, final) + overhead) / held
                if least is None or cost < least:
                    free, least = c, cost
            used.append(0)
        where.append((b, used[b]))
        used[b] += n
        if free > n:
            insort(room, (free - n, b))
    return where, used


def pack(lengths: list[int], capacities: tuple[int, ...], overhead: int = OVERHEAD) -> tuple[list[tuple[int, int]], list[int]]:
    """((bin, offset) of each length, each bin's final capacity); lengths in decreasing order."""
    caps = sorted(capacities)
    best = None
    for some in (caps, *([c] for c in caps if len(caps) > 1 and (not lengths or c >= lengths[0]))):
        where, used = best_fit_bins(lengths, some, overhead, caps)
        final = [final_size(u, caps) for u in used]
        cost = sum(final) + overhead * len(final)
        if best is None or cost < best[0]:
            best = cost, where, final
    return best[1:]


_OUT = pa.schema([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("bin", pa.string()), ("bin_offset", pa.int64()), ("capacity", pa.int64())])


def _packer(capacities: tuple[int, ...], overhead: int):
    def group(key, rows):
        order = sorted(range(len(rows)), key=lambda i: (-rows[i][3], rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
        where, caps = pack([rows[i][3] for i in order], capacities, overhead)
        cols = [[rows[i][c] for i in order] for c in range(4)]
        cols += [[f"{key}-{b}" for b, _ in where], [o for _, o in where], [caps[b] for b, _ in where]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _OUT.types)], schema=_OUT)

    def run(batches):
        key, rows = None, []
        for batch in batches:
            for k, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if k != key and rows:
                    yield group(key, rows)
                    rows = []
                key = k
                rows.append(row)
        if rows:
            yield group(key, rows)

    return run


def best_fit(sized: DataFrame, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD, per_task: int = PER_TASK) -> DataFrame:
    """doc_id, piece, start, length, bin, bin_offset, capacity for every piece of sized(doc_id,
    length): the piece holds `length` units of the document from `start`, and lies at bin_offset
    in its bin."""
    most = max(capacities)
    rows = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("n")).where("n > 0")
    rows = rows.groupBy("doc_id", "n").agg(F.count("*").alias("copies"))
    many = f"((n + {most - 1}) div {most})"
    groups = max(1, -(-(rows.agg(F.sum(F.expr(f"copies * {many}"))).first()[0] or 0) // per_task))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    pieces = rows.withColumn("copy", upto(F.col("copies"))).withColumn("piece", upto(F.expr(many)))
    pieces = pieces.select("doc_id", "piece", "copy", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("n") - F.col("piece") * most).cast("long").alias("length"))
    key = F.pmod(F.xxhash64("doc_id", "piece", "copy", "length"), F.lit(int(groups)))
    dealt = pieces.select(key.alias("key"), "doc_id", "piece", "start", "length").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(_packer(tuple(capacities), overhead), "doc_id long, piece long, start long, length long, bin string, bin_offset long, capacity long")


def byte_lengths(docs: DataFrame, end: int = 1) -> DataFrame:
    """doc_id and the length of each text in byte tokens, with its end mark."""
    return docs.select("doc_id", (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + end).alias("length"))
