"""Token ids in grammar-compressed binary shards, in ascending doc_id order.

Texts are dealt by ranges of doc_id and sorted within them, so file order is id order without one
task seeing all rows. Each task fills shards of about SHARD ids. A shard is compressed by Re-Pair
in rounds, until no pair of adjacent symbols is frequent: the frequent pairs get nonterminals and
are replaced at once (leftmost first where occurrences overlap), never across the end of a document.
A pair is frequent from LEAST occurrences in the shard: rarer rules would cost more than they save. It stores the
rules, the ids each rule expands to, the symbols, and where each document's symbols begin, so one
document can be decoded without the others.

File format: Parquet rows (part, shard, start, n_tokens, doc_ids, doc_tokens, doc_symbols, base,
rules, expansion, symbols); `start` counts the ids before the shard within its part; `rules` is
little-endian pairs and `symbols` a sequence of uint16 (uint32 where symbols are more than 65,536),
`expansion` uint32.

Defined results: null text is the empty text (the end id alone); null doc_id sorts first; rows of
one doc_id lie next to each other in order of their text; an empty table gives no rows; extra
columns are not read."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm.common import Known, Ragged, chunk_hashes, edge_words, spread, text_buffers

SHARD = 1 << 19
LEAST = 16  # occurrences from which a pair is frequent and gets a rule
PER_ROUND = 3500  # rules at most; other frequent pairs wait for the next round
BUCKETS = 18  # bits
CHUNKS = 1 << 20  # distinct chunks that are kept


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_BYTES = np.arange(256)
_LETTER = (_BYTES >= 65) & (_BYTES <= 90) | (_BYTES >= 97) & (_BYTES <= 122)
_WHITE = (_BYTES >= 9) & (_BYTES <= 13) | (_BYTES == 32)
_OTHER = (_BYTES > 32) & (_BYTES < 127) & ~_LETTER


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where UTF-8 texts can be cut without changing their pre-tokens: before ASCII white space that
    follows anything but white space, and between an ASCII letter and another ASCII character. (The
    pattern ends a run of letters at anything else, and any token before white space; it looks
    ahead only within white space, and never behind.) Includes each text's beginning."""
    white, letter = _WHITE[data], _LETTER[data]
    cut = np.zeros(len(data), bool)
    a, b = data[:-1], data[1:]
    solid = ~white[:-1] & (a > 32) & (a < 127)
    # the last byte of a longer character, unless it may be white space
    before = np.r_[np.uint8(0), data[:-2]]
    solid |= (a >= 128) & ~((before == 0x80) | (before == 0x81) | (before == 0x9A) | (before == 0xC2) & ((a == 0x85) | (a == 0xA0)))
    cut[1:] = solid & white[1:] | letter[:-1] & _OTHER[b]
    cut[off[:-1][off[:-1] < off[1:]]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of whole texts, each distinct chunk (chunk_starts) encoded once by the library.

    Chunks are looked up in arrays (Known, which compares their bytes). New ones that begin with
    white space, or follow a letter, are encoded many at a time, joined, and told apart by their
    lengths in bytes; others, such as texts' first words, one by one. Texts that contain an added
    token's string are encoded whole."""

    def __init__(self, path: str):
        import json

        self.tok = _tokenizer(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        self.bytes_of = np.zeros(self.tok.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in spec["model"]["vocab"].items():
            self.bytes_of[i] = len(token)  # one character stands for each byte
        self.ids = Ragged(np.uint16)
        self.chunks = Known(CHUNKS, np.uint8, [self.ids])

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint16) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[bytes], between: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of joined chunks between which, and `between`, texts can be cut, and where those of
        each chunk begin and end."""
        groups = [between.join(chunks[x : x + 128]).decode() for x in range(0, len(chunks), 128)]
        ids = np.concatenate(self._library(groups))
        ends = np.cumsum(self.bytes_of[ids])
        size = np.array([len(c) for c in chunks], np.int64)
        gap = np.full(len(chunks), len(between), np.int64)
        gap[127::128] = 0
        upto = np.cumsum(size + gap) - gap
        return ids, np.searchsorted(ends, upto - size, "right"), np.searchsorted(ends, upto) + 1

    def _each(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = self._library([c.decode() for c in chunks])
        upto = np.cumsum([len(p) for p in parts])
        return np.concatenate(parts), np.r_[0, upto[:-1]], upto

    def _learn(self, chunks: list[bytes]) -> None:
        """Add the ids of new chunks."""
        first = np.array([c[0] for c in chunks])
        last = np.array([c[-1] for c in chunks])
        ends = (last > 32) & (last < 127)
        spaced, after = ends & _WHITE[first], ends & _OTHER[first]
        flat, at, size, held = [], np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64), 0
        for own, between in ((spaced, b""), (after, b" a"), (~spaced & ~after, None)):
            own = np.flatnonzero(own)
            if len(own):
                some = [chunks[i] for i in own.tolist()]
                ids, begin, end = self._each(some) if between is None else self._joined(some, between)
                flat.append(ids)
                at[own], size[own] = begin + held, end - begin
                held += len(ids)
        self.ids.extend(np.concatenate(flat)[spread(at, size)], size)

    def encode(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Ids (uint16) of each text of a buffer."""
        data, off = data[off[0] : off[-1]], off - off[0]
        if not len(data):
            return [np.zeros(0, np.uint16)] * (len(off) - 1)
        raw = data.tobytes()
        s = chunk_starts(data, off)
        e = np.r_[s[1:], len(data)]
        edges = edge_words(data, s, e)
        rows = self.chunks.rows(chunk_hashes(data, s, e, edges), data, s, e, lambda new: self._learn([raw[x:y] for x, y in zip(s[new].tolist(), e[new].tolist())]), edges)
        if rows is None:  # more distinct chunks than are kept
            return [x for d in range(len(off) - 1) for x in self._library([raw[off[d] : off[d + 1]].decode()])]
        ids, size = self.ids.take(rows)
        upto = np.r_[0, np.cumsum(size)][np.searchsorted(s, off)].tolist()
        out = [ids[a:b] for a, b in zip(upto, upto[1:])]
        if any(a in raw for a in self.added):
            for d in range(len(out)):
                text = raw[off[d] : off[d + 1]]
                if any(a in text for a in self.added):
                    out[d], = self._library([text.decode()])
        return out


# ---------------------------------------------------------------------------------- Re-Pair


def compress(ids: np.ndarray, ends: np.ndarray, base: int):
    """(symbols, where each document's symbols begin and end, rules, expansion lengths) of ids;
    ends: each document's end. Rounds go on until no pair of adjacent symbols is frequent.

    A pair that isn't frequent never becomes so, as replacing makes no new pair of old symbols; so
    after the first round only frequent pairs and those with a new symbol are counted."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[ends - 1] = True
    live = np.flatnonzero(~last)  # where a pair begins that may be frequent
    rules, length = [], []
    top = base
    bucket_of = lambda k: ((k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS)).astype(np.int64)
    while len(live) >= LEAST:
        key = (seq[live].astype(np.uint64) << np.uint64(32)) | seq[live + 1]
        # a bucket counts at least as much as each of its pairs, so most places drop out here
        bucket = bucket_of(key)
        often = (np.bincount(bucket, minlength=1 << BUCKETS) >= LEAST)[bucket]
        live, key, bucket = live[often], key[often], bucket[often]
        some = np.sort(key)
        at = np.flatnonzero(np.r_[True, some[1:] != some[:-1]]) if len(some) else np.zeros(0, np.int64)
        times = np.diff(np.r_[at, len(some)])
        good = np.flatnonzero(times >= LEAST)
        if not len(good):
            break
        good = good[np.argsort(-times[good], kind="stable")[:PER_ROUND]]
        chosen = some[at[good]]
        # one pair per bucket, the most frequent; others wait for the next round
        chosen = np.sort(chosen[np.unique(bucket_of(chosen), return_index=True)[1]])
        slot = np.zeros(1 << BUCKETS, np.int64)
        slot[bucket_of(chosen)] = np.arange(len(chosen))
        which = slot[bucket]
        hit = chosen[which] == key
        spots, which = live[hit], which[hit]
        # of overlapping occurrences, every second one from the left of their run
        new_run = np.r_[True, spots[1:] != spots[:-1] + 1]
        run_at = spots[np.maximum.accumulate(np.where(new_run, np.arange(len(spots)), 0))]
        take = ((spots - run_at) & 1) == 0
        spots, which = spots[take], which[take]
        used, which = np.unique(which, return_inverse=True)
        chosen = chosen[used]
        left, right = (chosen >> np.uint64(32)).astype(np.int64), (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
        known = np.array(length, np.int64)
        size = lambda s: np.where(s < base, 1, known[np.maximum(s - base, 0)]) if len(known) else np.ones(len(s), np.int64)
        rules.append(np.stack([left, right], 1))
        length += (size(left) + size(right)).tolist()
        keep = np.ones(len(seq), bool)
        keep[spots + 1] = False
        seq[spots] = top + which
        last[spots] = last[spots + 1]
        maybe = np.zeros(len(seq), bool)
        maybe[live] = maybe[spots] = True
        maybe = maybe[keep]
        seq, last = seq[keep], last[keep]
        now = spots - np.arange(len(spots))  # each spot has one place less before it per earlier spot
        maybe[np.maximum(now - 1, 0)] = True
        live = np.flatnonzero(maybe & ~last)
        top += len(chosen)
    sym_ends = np.flatnonzero(last) + 1
    kind = symbol_kind(top - base, base)
    table = np.concatenate(rules).astype(kind) if rules else np.zeros((0, 2), kind)
    return seq.astype(kind), np.r_[0, sym_ends], table, np.array(length, np.uint32)


def symbol_kind(rules: int, base: int) -> str:
    """How symbols lie in a file: two bytes each where that is enough."""
    return "<u2" if base + rules <= 1 << 16 else "<u4"


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where, how many): what every symbol stands for. A rule only uses earlier ones."""
    flat, size = np.arange(base, dtype=np.uint32), np.ones(base, np.int64)
    where, done = np.arange(base), 0
    newest = rules.max(axis=1).astype(np.int64) - base if len(rules) else np.zeros(0, np.int64)
    while done < len(rules):  # as many rules at once as use only what is known
        more = np.flatnonzero(newest[done:] >= done)
        end = done + int(more[0]) if len(more) else len(rules)
        part = rules[done:end].ravel().astype(np.int64)
        n = size[part].reshape(-1, 2).sum(axis=1)
        where = np.r_[where, len(flat) + np.cumsum(n) - n]
        flat, size, done = np.r_[flat, flat[spread(where[part], size[part])]], np.r_[size, n], end
    return flat, where, size


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids that symbols stand for; works on any slice of a shard's symbols."""
    flat, where, size = expansions(rules, base)
    s = symbols.astype(np.int64)
    return flat[spread(where[s], size[s])]


_SHARDS = "part int, shard int, start long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, base int, rules binary, expansion binary, symbols binary"


def _shards(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = Encoder(path)
        base = enc.tok.get_vocab_size(with_added_tokens=True)
        end = np.array([end_id], np.uint16)
        doc_ids, parts, held, start, shard = [], [], 0, 0, 0

        def flush():
            lens = np.array([len(p) + 1 for p in parts[::2]], np.int64)
            symbols, at, rules, length = compress(np.concatenate(parts), np.cumsum(lens), base)
            row = {"part": part, "shard": shard, "start": start, "n_tokens": int(lens.sum()), "doc_ids": doc_ids, "doc_tokens": lens.tolist(), "doc_symbols": at.tolist(), "base": base, "rules": rules.tobytes(), "expansion": length.astype("<u4").tobytes(), "symbols": symbols.tobytes()}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())), ("base", pa.int32()), ("rules", pa.binary()), ("expansion", pa.binary()), ("symbols", pa.binary())])
        for whole in batches:
            for x in range(0, whole.num_rows, 256):
                batch = whole.slice(x, 256)
                for i, c in zip(batch.column(0).to_pylist(), enc.encode(*text_buffers(batch.column(1)))):
                    doc_ids.append(i)
                    parts += [c, end]
                    held += len(c) + 1
                    if held >= SHARD:
                        out = flush()
                        yield out
                        start, shard = start + held, shard + 1
                        doc_ids, parts, held = [], [], 0
        if parts:
            yield flush()

    return run


def write(docs: DataFrame, tokenizer: str, out_path: str, end_id: int = 2) -> None:
    """Encode every row of docs(doc_id, text) and write the shards to out_path."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = slim.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(_shards(tokenizer, end_id), _SHARDS).write.parquet(out_path)


def _unpack(column, kind):
    return np.frombuffer(column.as_py(), kind)


def _documents(full: bool):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(c)[r] for c, n in enumerate(batch.schema.names)}
                base, length = row["base"].as_py(), _unpack(row["expansion"], "<u4")
                kind = symbol_kind(len(length), base)
                rules, symbols, at = _unpack(row["rules"], kind).reshape(-1, 2), _unpack(row["symbols"], kind), row["doc_symbols"].as_py()
                whole = expand(symbols, rules, base).astype("<u4")
                length = np.r_[np.ones(base, np.int64), length][symbols.astype(np.int64)]
                ends = np.r_[0, np.cumsum(length)][at]
                ids = [whole[a:b] for a, b in zip(ends[:-1], ends[1:])]
                n = len(ids)
                first = row["start"].as_py()
                cols = [pa.array([row["part"].as_py()] * n, pa.int32()), pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array([first + int(a) for a in ends[:-1]], pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.tobytes()) for i in ids], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if full:
                    cols, names = [*cols, pa.array([i.tolist() for i in ids], pa.list_(pa.int64()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files of path."""
    files = spark.read.schema(_SHARDS).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()  # a row per written part
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    offset = spark.createDataFrame(offsets, "part int, before long")
    docs = files.mapInArrow(_documents(with_ids), "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return docs.join(F.broadcast(offset), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """One document's ids: its symbols are found by the stored positions and expanded alone."""
    row = spark.read.schema(_SHARDS).parquet(path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).first()
    if row is None:
        return None
    k = row.doc_ids.index(doc_id)
    kind = symbol_kind(len(row.expansion) // 4, row.base)
    part = np.frombuffer(row.symbols, kind)[row.doc_symbols[k] : row.doc_symbols[k + 1]]
    return expand(part, np.frombuffer(row.rules, kind).reshape(-1, 2), row.base).tolist()
