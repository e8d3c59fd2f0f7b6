"""Encoding and decoding with a SentencePiece BPE model by vectorised merge rounds.

No piece of such a model has its word mark after another character, so merges never cross the start
of a marked word and every distinct word is encoded once; nor do they cross two characters that
stand side by side in no piece, so words fall into parts there. The parts of a batch lie in one flat
symbol array with the rank of every adjacent pair. Each round finds every part's smallest rank by
one segmented minimum, merges that rank's occurrences at once, from the left where they overlap, and
compacts the array to the parts that still have a pair. One queue would take these merges in the
same order unless a merge makes a pair of no higher rank than its own; where one does, the part
makes its leftmost merge only in that round.

Words are looked up in arrays (Known, which compares their bytes); texts are gathered from their
words' ids. A word of any length goes through the same rounds.

Defined results: null text encodes as the empty text (no ids); repeated rows are encoded each; null
doc_id is kept; an empty table gives no rows; extra columns are not read."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm.common import Known, Ragged, documents_in_pieces, mix, span_hashes, spread, text_buffers

MARK = "▁"
NONE = np.int32(2**31 - 1)
CACHED = 1 << 19  # distinct words that are kept
PART = 1 << 20  # bytes of text whose words are looked up at once, but for single longer texts


class Pieces:
    """The vocabulary of one model and the merges it allows."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        pieces: dict[str, int] = {}
        score = {}
        for i in range(n):
            p = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i)):
                pieces[p], score[p] = i, lib.get_score(i)
        assert not any(MARK in p.lstrip(MARK) for p in pieces), "a piece spans the start of a word"
        chars = sorted({c for p in pieces for c in p} - set(pieces))  # parts of pieces only
        self.vocabulary, self.size = n, n + len(chars)
        self.width = np.ones(n, np.int64)
        for p, i in pieces.items():
            self.width[i] = len(p)
        symbol = pieces | {c: n + i for i, c in enumerate(chars)}
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        order = {s: r for r, s in enumerate(sorted({-x for x in score.values()}))}
        pairs, beside = {}, set()
        for p, i in pieces.items():
            beside.update(zip(p, p[1:]))
            for c in range(1, len(p)):
                a, b = symbol.get(p[:c]), symbol.get(p[c:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = (order[-score[p]], i)
        self.beside = np.array(sorted(ord(a) << 21 | ord(b) for a, b in beside), np.int64)
        keys = np.array(list(pairs), np.int64)
        self.slots = 1 << (4 * len(pairs)).bit_length()
        self.key, self.rank, self.merged = np.full(self.slots, -1, np.int64), np.full(self.slots, NONE), np.zeros(self.slots, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.key[slot] < 0
            self.key[slot[free]] = keys[todo[free]]
            on = self.key[slot] != keys[todo]
            todo, slot = todo[on], (slot[on] + 1) & (self.slots - 1)
        at = self._place(keys)
        self.rank[at], self.merged[at] = np.array(list(pairs.values()), np.int32).T

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(self.slots - 1)).astype(np.int64)

    def _place(self, key: np.ndarray) -> np.ndarray:
        """Where a pair's rank and merge lie, or a slot without any."""
        slot = self._slot(key)
        todo = np.flatnonzero((self.key[slot] != key) & (self.key[slot] >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.slots - 1)
            got = self.key[slot[todo]]
            todo = todo[(got != key[todo]) & (got >= 0)]
        return slot

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair of symbols; rank NONE where there is no merge."""
        known = (left >= 0) & (right >= 0)
        at = self._place(np.where(known, left.astype(np.int64) * self.size + right, 0))
        return np.where(known & (self.key[at] == left.astype(np.int64) * self.size + right), self.rank[at], NONE), self.merged[at]

    def _rounds(self, sym: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of parts, the q-th from first[q], merged: (symbols, how many each part has left)."""
        sym = sym.astype(np.int32)
        size = np.diff(np.r_[first, len(sym)])
        rank, into = np.full(len(sym), NONE), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self._pairs(sym[:-1], sym[1:])
        rank[first + size - 1] = NONE
        part, done = np.arange(len(first)), []
        left_over = np.zeros(len(first), np.int64)
        while len(part):
            first = np.cumsum(size) - size
            low = np.minimum.reduceat(rank, first)
            going = low < NONE
            if not going.all():
                done.append((part[~going], size[~going], sym[np.repeat(~going, size)]))
                still = np.repeat(going, size)
                sym, rank, into = sym[still], rank[still], into[still]
                part, size, low = part[going], size[going], low[going]
                if not len(part):
                    break
                first = np.cumsum(size) - size
            spot = np.flatnonzero(rank == np.repeat(low, size))
            run = np.r_[True, spot[1:] != spot[:-1] + 1]
            spot = spot[((spot - spot[np.maximum.accumulate(np.where(run, np.arange(len(spot)), 0))]) & 1) == 0]
            own = np.searchsorted(first, spot, "right") - 1
            alone = np.r_[True, own[1:] != own[:-1]]

            def around(spot, own):
                new = into[spot]
                has_left, has_right = spot > first[own], spot + 2 < (first + size)[own]
                # a left neighbour may have been merged in this round: then it ends two places before
                near = np.r_[False, spot[1:] == spot[:-1] + 2] & has_left
                left = np.where(near, np.r_[np.int32(0), new[:-1]], sym[np.maximum(spot - 1, 0)])
                before, after = (self._pairs(a, b) for a, b in ((left, new), (new, sym[np.minimum(spot + 2, len(sym) - 1)])))
                return new, has_left, has_right, near, (np.where(has_left, before[0], NONE), before[1]), (np.where(has_right, after[0], NONE), after[1])

            found = around(spot, own)
            early = (found[4][0] <= low[own]) | (found[5][0] <= low[own])
            if (early & ~(alone & np.r_[alone[1:], True])).any():
                hasty = np.zeros(len(part), bool)
                hasty[own[early]] = True
                keep = alone | ~hasty[own]
                spot, own = spot[keep], own[keep]
                found = around(spot, own)
            new, has_left, _, near, before, after = found
            sym[spot], rank[spot], into[spot] = new, *after
            behind = np.where(near, spot - 2, spot - 1)[has_left]
            rank[behind], into[behind] = before[0][has_left], before[1][has_left]
            stay = np.ones(len(sym), bool)
            stay[spot + 1] = False
            sym, rank, into = sym[stay], rank[stay], into[stay]
            size = size - np.bincount(own, minlength=len(size))
        for p, n, _ in done:
            left_over[p] = n
        out = np.zeros(int(left_over.sum()), np.int32)
        at = np.cumsum(left_over) - left_over
        for p, n, syms in done:
            out[spread(at[p], n)] = syms
        return out, left_over

    def encode_flat(self, code: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many) of words of `size` characters (code points `code`, marks included)."""
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(size), np.int64)
        word = np.repeat(np.arange(len(size)), size)
        key = code[:-1].astype(np.int64) << 21 | code[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        first = np.flatnonzero(np.r_[True, (self.beside[at] != key) | (word[1:] != word[:-1])])
        sym, n = self._rounds(self.of_char[code], first)
        owner = np.repeat(word[first], n)
        # a character outside the vocabulary becomes the ids of its bytes
        odd = np.flatnonzero((sym < 0) | (sym >= self.vocabulary))
        if len(odd):
            width = np.ones(len(sym), np.int64)
            inside = (sym >= 0) & (sym < self.vocabulary)
            width[inside] = self.width[sym[inside]]
            place = (np.cumsum(width) - width)[odd]
            text = code[place].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
            raw = [self.byte[list(c.encode("utf-8", "surrogatepass"))] for c in text]
            many = np.ones(len(sym), np.int64)
            many[odd] = [len(r) for r in raw]
            start = np.cumsum(many) - many
            sym, owner, old = np.repeat(sym, many), np.repeat(owner, many), sym
            sym[spread(start[odd], many[odd])] = np.concatenate(raw)
        return sym.astype(np.int32), np.bincount(owner, minlength=len(size))

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words carry their marks."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        ids, n = self.encode_flat(code, np.array([len(w) for w in words], np.int64))
        cut = np.r_[0, np.cumsum(n)].tolist()
        flat = ids.tolist()
        return [flat[a:b] for a, b in zip(cut, cut[1:])]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


class Encoder:
    """Ids and their decimal numbers, joined, of whole texts, by a table of marked words."""

    def __init__(self, path: str):
        self.model = pieces(path)
        self.ids, self.said = Ragged(np.int32), Ragged(np.uint8)
        self.words = Known(CACHED, np.uint8, [self.ids, self.said])
        numbers = Ragged(np.uint8)
        texts = [f"{i},".encode() for i in range(self.model.vocabulary)]
        numbers.extend(np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts], np.int64))
        self.numbers = numbers

    def encode(self, texts: list[str]):
        """(ids, sizes by text, numbers, sizes by text): each text's ids, and the same as decimal
        numbers that each end with a comma."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        data, off = text_buffers(pa.array(marked, pa.large_string()))
        if not len(data):
            z = np.zeros(len(texts), np.int64)
            return np.zeros(0, np.int32), z, np.zeros(0, np.uint8), z
        # words begin at marks (bytes E2 96 81) that don't follow another
        mark = np.zeros(len(data), bool)
        mark[:-2] = (data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)
        begins = mark.copy()
        begins[3:] &= ~mark[:-3]
        begins[off[:-1][off[:-1] < off[1:]]] = True
        s = np.flatnonzero(begins)
        e = np.r_[s[1:], len(data)]

        def learn(new):
            raw = data[spread(s[new], (e - s)[new])].tobytes()
            code = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
            chars = np.add.reduceat((data & 0xC0) != 0x80, s)[new]
            ids, n = self.model.encode_flat(code, chars)
            self.ids.extend(ids, n)
            flat, width = self.numbers.take(ids)
            self.said.extend(flat, np.add.reduceat(width, np.cumsum(n) - n))

        rows = self.words.rows(span_hashes(data, s, e), data, s, e, learn)
        first = np.searchsorted(s, off)
        if rows is None:  # more distinct words than are kept: all are encoded, as they come
            code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
            ids, n = self.model.encode_flat(code, np.add.reduceat((data & 0xC0) != 0x80, s))
            flat, width = self.numbers.take(ids)
            width = np.add.reduceat(width, np.cumsum(n) - n)
        else:
            (ids, n), (flat, width) = self.ids.take(rows), self.said.take(rows)
        return ids, np.diff(np.r_[0, np.cumsum(n)][first]), flat, np.diff(np.r_[0, np.cumsum(width)][first])


def _encoder(path: str, digests: bool):
    def run(batches):
        enc = Encoder(path)
        lib = enc.model.lib
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            _, off = text_buffers(whole.column(1))
            for a, b in documents_in_pieces(off, PART):
                batch = whole.slice(a, b - a)
                ids, n, said, width = enc.encode([t or "" for t in batch.column(1).to_pylist()])
                upto = np.cumsum(n)
                if not digests:
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, upto], pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])
                    continue
                raw, end = said.tobytes(), np.cumsum(width)
                cols = [batch.column(0), pa.array(n, pa.int64())]
                cols += [pa.array([sha(raw[x : max(x, y - 1)]) for x, y in zip((end - width).tolist(), end.tolist())], pa.string())]
                flat = ids.tolist()
                cols += [pa.array([sha(lib.decode(flat[x:y]).encode("utf-8", "surrogatepass")) for x, y in zip((upto - n).tolist(), upto.tolist())], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids of every row of docs(doc_id, text), without begin or end ids."""
    return _slim(docs).mapInArrow(_encoder(path, False), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of encoded(doc_id, ids); null ids decode as none."""

    def run(batches):
        lib = pieces(path).lib
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([lib.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, whose ids
    needn't leave the task."""
    return _slim(docs).mapInArrow(_encoder(path, True), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
