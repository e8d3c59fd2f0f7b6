"""Language identification: known words first, backing off to shorter character n-grams.

Words are runs of letters (Unicode categories L, with marks M among them) of the lower-cased text.
A word that the model knows scores its smoothed log frequency in each language. A word it doesn't
know falls back to the longest length of character n-grams (5 to 1, with word boundaries) of which
the model knows one, and scores their mean. A text's language has the largest sum over its words;
the score is that language's posterior, with the evidence tempered to a fixed number of words so
that it doesn't saturate on long texts.

Fitting reads at most about `per_language` labelled rows of each language (a deterministic sample
by hash of doc_id, documented bound), counts their words and then the n-grams of the distinct words
by distributed aggregation, and keeps `words` words and `grams` n-grams, an equal share of each
language's most frequent ones: the model has a fixed number of rows, with a column per language.
Prediction reads nothing but the text. Words are looked up in arrays; each distinct word that the
model doesn't know is scored once and kept, CACHED of them at a time.

Defined results: null, empty or letterless text: `und` with score 0; null lang is never learned;
ties go to the alphabetically first language; with nothing to learn from, every row is `und`;
repeated rows are predicted each; a null doc_id is sampled like any other; an empty table gives no
rows; extra columns stay as they are."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadlens.llm.common import Known, Ragged, cut, documents_in_pieces, forget, span_hashes, spread, text_buffers

UNKNOWN = "und"
LENGTHS = (5, 4, 3, 2, 1)
TEMPER = 12.0  # words of evidence at most
CACHED = 1 << 18  # distinct unknown words that are kept
PART = 1 << 19  # bytes of text whose words are looked up at once, but for single longer texts
STREAM = 1 << 18  # n-grams that are looked up at once
CELLS = 1 << 21  # numbers of vectors that are added up at once


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, and whether it can stand in a word."""
    kind = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    return kind == "L", (kind == "L") | (kind == "M")


def _code(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)


def words_of(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, ends, text) of all words of an Arrow column of texts, lower-cased."""
    data, off = text_buffers(pc.utf8_lower(pc.fill_null(column, "").cast(pa.large_string())))
    data, off = data[off[0] : off[-1]], off - off[0]
    code = _code(data.tobytes())
    off = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][off]  # in characters
    letter, within = _letters()
    inside = np.r_[False, within[code], False]
    brk = np.zeros(len(code) + 1, bool)
    brk[off] = True
    s = np.flatnonzero(inside[1:] & (~inside[:-1] | brk))
    s = s[s < len(code)]
    e = np.flatnonzero(inside[:-1] & (~inside[1:] | brk))
    real = np.add.reduceat(letter[code].astype(np.int64), s) > 0 if len(s) else np.zeros(0, bool)  # up to the next word: no letters lie between
    s, e = s[real], e[real]
    return code, s, e, np.searchsorted(off, s, "right") - 1


def _joined(code: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words with boundaries around each, one after the other, and their sizes with these."""
    size = e - s + 2
    flat = np.full(int(size.sum()), ord("<"), np.uint32)
    end = np.cumsum(size)
    flat[spread(end - size + 1, size - 2)] = code[spread(s, size - 2)]
    flat[end - 1] = ord(">")
    return flat, size


def _windows(size: np.ndarray, n: int):
    """(starts, words) of all n-grams of words that lie one after the other with boundaries, STREAM
    at a time. An n-gram of one character is never a boundary."""
    first = np.cumsum(size) - size
    skip = 1 if n == 1 else 0
    many = np.maximum(size - 2 * skip - n + 1, 0)
    upto = np.r_[0, np.cumsum(many)]
    for x in range(0, int(upto[-1]), STREAM):
        k = np.arange(x, min(x + STREAM, int(upto[-1])))
        word = np.searchsorted(upto, k, "right") - 1
        yield first[word] + skip + k - upto[word], word


def _add(total: np.ndarray, owner: np.ndarray, rows: np.ndarray, table: np.ndarray) -> None:
    """total[o] += table[r] for every owner (ascending) and row, a bounded number at a time."""
    step = max(1, CELLS // max(1, table.shape[1]))
    for x in range(0, len(rows), step):
        o = owner[x : x + step]
        first = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
        total[o[first]] += np.add.reduceat(table[rows[x : x + step]].astype(np.float64), first, axis=0)


def _index(items: list[str]) -> Known:
    """Rows 0, 1, .. of distinct strings."""
    known = Known(max(2 * len(items), 2), np.uint32, [])
    size = np.array([len(i) for i in items], np.int64)
    code = np.frombuffer("".join(items).encode("utf-32-le"), np.uint32)
    order = np.arange(len(items))
    known.units.extend(code, size)
    e = np.cumsum(size)
    known.hash[order] = span_hashes(code, e - size, e) if len(items) else 0
    known._insert(order)
    return known


class Model:
    """Evidence by language: `words` and `grams` map an item to its vector, in order of `languages`."""

    def __init__(self, languages: list[str], words: dict[str, np.ndarray], grams: dict[str, np.ndarray]):
        matrix = lambda d: np.array(list(d.values()), np.float32).reshape(len(d), len(languages))
        self.__setstate__((languages, list(words), matrix(words), list(grams), matrix(grams)))

    @classmethod
    def of(cls, languages: list[str], words: list[str], word_table: np.ndarray, grams: list[str], gram_table: np.ndarray) -> Model:
        self = cls.__new__(cls)
        self.__setstate__((languages, words, word_table.astype(np.float32), grams, gram_table.astype(np.float32)))
        return self

    def __getstate__(self):
        return self.state

    def __setstate__(self, state):
        self.state = state
        self.languages, words, self.word_table, grams, self.gram_table = state
        self.words, self.grams = _index(words), _index(grams)
        self.scored = Ragged(np.float32)
        self.seen = Known(CACHED, np.uint32, [self.scored])

    def score_words(self, code: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The vector of each word with hash h: its own, or the mean of its longest known n-grams."""
        out = np.zeros((len(s), len(self.languages)))
        row = self.words._find(h, code, s, e)
        known = np.flatnonzero(row >= 0)
        out[known] = self.word_table[row[known]]
        left = np.flatnonzero(row < 0)
        for n in LENGTHS:
            if not len(left):
                break
            flat, size = _joined(code, s[left], e[left])
            total, count = np.zeros((len(left), len(self.languages))), np.zeros(len(left), np.int64)
            for at, word in _windows(size, n):
                got = self.grams._find(span_hashes(flat, at, at + n), flat, at, at + n)
                hit = got >= 0
                _add(total, word[hit], got[hit], self.gram_table)
                count += np.bincount(word[hit], minlength=len(left))
            some = count > 0
            out[left[some]] = total[some] / count[some, None]
            left = left[~some]
        return out

    def predict_many(self, column) -> tuple[list[str], np.ndarray]:
        """(languages, scores) of an Arrow column of texts."""
        code, s, e, text = words_of(column)
        total, width = np.zeros((len(column), len(self.languages))), len(self.languages)
        if width and len(s):
            h = span_hashes(code, s, e)
            rows = self.seen.rows(h, code, s, e, lambda new: self.scored.extend(self.score_words(code, s[new], e[new], h[new]).astype(np.float32).ravel(), np.full(len(new), width)))
            if rows is not None:
                _add(total, text, rows, self.scored.flat[: self.scored.held].reshape(-1, width))
            else:  # more words than are kept: scored as they come
                for x in range(0, len(s), 1 << 16):
                    some = slice(x, x + (1 << 16))
                    _add(total, text[some], np.arange(len(s[some])), self.score_words(code, s[some], e[some], h[some]))
        words = np.bincount(text, minlength=len(column))
        if not width:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        best = total.argmax(axis=1)
        odds = (total - total.max(axis=1, keepdims=True)) * np.minimum(1.0, TEMPER / np.maximum(words, 1))[:, None]
        score = np.where(words > 0, 1 / np.exp(odds).sum(axis=1), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), words.tolist())], score

    def predict(self, text: str | None) -> tuple[str, float]:
        (lang,), (score,) = self.predict_many(pa.array([text], pa.string()))
        return lang, float(score)


def _scores(counts: np.ndarray) -> np.ndarray:
    """Log relative frequencies by language with add-half smoothing, less their mean: what all
    languages share carries no evidence."""
    v = np.log((counts + 0.5) / (counts.sum(axis=0) + 1.0))
    return v - v.mean(axis=1, keepdims=True)


def _strings(code: np.ndarray, s: np.ndarray, size: np.ndarray) -> list[str]:
    text = code[spread(s, size)].tobytes().decode("utf-32-le")
    cut = np.r_[0, np.cumsum(size)].tolist()
    return [text[a:b] for a, b in zip(cut, cut[1:])]


def _counted_words(batches):
    """Rows (text, lang) to partial counts (lang, item, n) of words."""
    for batch in batches:
        _, off = text_buffers(batch.column(0))
        for a, b in documents_in_pieces(off, PART):
            part = batch.slice(a, b - a)
            code, s, e, text = words_of(part.column(0))
            langs = part.column(1).dictionary_encode()
            key = span_hashes(code, s, e)
            which = langs.indices.to_numpy()[text]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                own = np.flatnonzero(which == k)
                _, at, n = np.unique(key[own], return_index=True, return_counts=True)
                at = own[at]
                items = _strings(code, s[at], (e - s)[at])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(n, pa.int64())], ["lang", "item", "n"])


def _counted_grams(batches):
    """Rows (lang, item, n) of words to partial counts (lang, item, n) of their n-grams."""
    for batch in batches:
        if not batch.num_rows:
            continue
        langs = batch.column(0).dictionary_encode()
        which, times = langs.indices.to_numpy(), batch.column(2).to_numpy()
        raw = [w.encode("utf-32-le") for w in batch.column(1).to_pylist()]
        size = np.array([len(r) // 4 for r in raw], np.int64)
        e = np.cumsum(size)
        flat, size = _joined(np.frombuffer(b"".join(raw), np.uint32), e - size, e)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            for n in LENGTHS:
                for at, word in _windows(size, n):
                    own = which[word] == k
                    if not own.any():
                        continue
                    _, first, same = np.unique(span_hashes(flat, at, at + n)[own], return_index=True, return_inverse=True)
                    count = np.bincount(same, weights=times[word[own]]).astype(np.int64)
                    items = _strings(flat, at[own][first], np.full(len(first), n))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(items), pa.string()), pa.array(items, pa.string()), pa.array(count, pa.int64())], ["lang", "item", "n"])


def _most(counts: DataFrame, share: int, names: list[str], by_length: bool) -> tuple[list[str], np.ndarray]:
    """The `share` most frequent items (lang, item, n) of each language, and their counts by language;
    items met once in all are left out. by_length: the share is for each length of items."""
    total = counts.groupBy("item").agg(F.sum("n").alias("total")).where("total > 1")
    group = ["lang", F.length("item")] if by_length else ["lang"]
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "item")
    top = counts.join(total, "item", "left_semi").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= share)
    got = counts.join(top.select("item").distinct(), "item", "left_semi").select("item", "lang", "n").toArrow()  # the model's own size
    items = got.column("item").combine_chunks().dictionary_encode()
    order = np.argsort(np.array(items.dictionary.to_pylist(), object), kind="stable")
    place = np.zeros(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = np.zeros((len(order), len(names)))
    column = {x: i for i, x in enumerate(names)}
    table[place[items.indices.to_numpy()], [column[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    known = items.dictionary.to_pylist()
    return [known[i] for i in order.tolist()], table


def fit(labelled: DataFrame, per_language: int = 2000, words: int = 60_000, grams: int = 60_000) -> Model:
    """A model from rows (doc_id, text, lang) with a language. Bounds: about per_language rows of
    each language; `words` words and `grams` n-grams in all, in equal shares by language."""
    rows = labelled.where("lang is not null").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not sizes:
        return Model([], {}, {})
    quota = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n)))))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(share < F.try_element_at(quota, F.col("lang"))).select("text", "lang")
    add_up = lambda df: df.groupBy("lang", "item").agg(F.sum("n").alias("n"))
    names = sorted(sizes)
    seen = cut(add_up(sample.mapInArrow(_counted_words, "lang string, item string, n long")), "words")
    parts = cut(add_up(seen.mapInArrow(_counted_grams, "lang string, item string, n long")).where("n > 1"), "grams")
    known, times = _most(seen, max(1, words // len(names)), names, False)
    pieces, piece_times = _most(parts, max(1, grams // len(names) // len(LENGTHS)), names, True)
    forget(seen, parts)
    table, length = np.zeros(piece_times.shape), np.array([len(p) for p in pieces], np.int64)
    for n in LENGTHS:
        if (length == n).any():
            table[length == n] = _scores(piece_times[length == n])
    return Model.of(names, known, _scores(times) if known else times, pieces, table)


def predicted(text: Column, model) -> Column:
    """struct(lang_pred, score) of each text. model: a broadcast Model."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        m, langs, scores = model.value, [], []
        _, off = text_buffers(texts)
        for a, b in documents_in_pieces(off, PART):
            lang, score = m.predict_many(texts.slice(a, b - a))
            langs += lang
            scores.append(score)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs and their lang_pred and score (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the size fit() bounds
    both = "_".join(["predicted", *docs.columns])  # a name that no column has
    told = docs.withColumn(both, predicted(F.col("text").cast("string"), shared))
    return told.withColumns({"lang_pred": F.col(f"`{both}`.lang_pred"), "score": F.col(f"`{both}`.score")}).drop(both)
