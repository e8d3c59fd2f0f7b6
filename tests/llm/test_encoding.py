"""Encoders against their libraries, compression and packing by round trips and bounds."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from roadlens.llm import packing, pieces, token_files
from roadlens.llm.common import Known, Ragged, chunk_hashes, edge_words, spread, text_buffers, word_hashes

ODD = ["", " ", "  ", "a  b", " a", "a ", "a \n b", "\n \n", "x\t y", "it's  'll <|endoftext|> x", "日本 語 𝕏 \u0000", "\u0000 \u0000x", "▁a ▁▁ b", "▁", "a" * 500 + " " + "ab" * 300, "!" * 1000, "\u3000 a", "a \u3000b", "éé ö\r\n  z", "<s> </s> <0x41>", "   ", "thisisaverylongwordwithoutspaces" * 40]
BYTE, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def texts(n=200):
    rng = random.Random(6)
    alphabet = "etaoin  shrdlu\n.,éß日!0123 ABC▁"
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(n)]


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@pytest.mark.parametrize("kept", [1 << 16, 512, 4])
def test_pieces_equal_the_library(monkeypatch, kept):
    monkeypatch.setattr(pieces, "CACHED", kept)
    enc, all_texts = pieces.Encoder(PIECE), texts()
    want = enc.model.lib.encode(all_texts)
    for _ in range(2):  # new words, then known ones
        for x in range(0, len(all_texts), 16):
            ids, n, said, width = enc.encode(all_texts[x : x + 16])
            assert split(ids, n) == want[x : x + 16]
            assert [bytes(b) for b in split(said, width)] == ["".join(f"{i}," for i in w).encode() for w in want[x : x + 16]]


def test_rounds_equal_the_library():
    p, rng = pieces.pieces(PIECE), random.Random(4)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    words = ["▁" + "".join(rng.choice(letters[:k]) for _ in range(n)) for k in (1, 2, 3, 5, 26) for n in (1, 2, 3, 7, 30, 300, 4000)]
    words += ["▁" * n for n in range(2, 40)] + ["▁" + "日本語" * 2000, "▁" + "the" * 3000, "▁" + "aab" * 999 + "\x00é"]
    words += ["▁" + "".join(p.lib.id_to_piece(rng.randrange(260, 32_000)).replace("▁", "") for _ in range(60)) for _ in range(300)]
    want = p.lib.encode([w[1:].replace("▁", " ") for w in words])
    assert p.encode_words(words) == want


def test_sentencepiece_digests(spark):
    import sentencepiece

    lib, docs = sentencepiece.SentencePieceProcessor(model_file=PIECE), [*enumerate(texts(60)), (999, None)]
    df = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in pieces.round_trip_digests(df, PIECE).collect()}
    for i, t in docs:
        ids = lib.encode(t or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(df, PIECE), PIECE).collect()}
    assert all(back[i] == lib.decode(lib.encode(t or "")) for i, t in docs)
    assert pieces.round_trip_digests(df.limit(0), PIECE).count() == 0


def test_chunks_equal_the_library():
    enc, all_texts = token_files.Encoder(BYTE), texts()
    want = [e.ids for e in enc.tok.encode_batch(all_texts, add_special_tokens=False)]
    for _ in range(2):  # new chunks, then known ones
        data, off = text_buffers(pa.array(all_texts))
        assert [ids.tolist() for ids in enc.encode(data, off)] == want


def thue_morse(n):
    w = "a"
    while len(w) < n:
        w += w.translate(str.maketrans("ab", "ba"))
    return w


def test_chunks_whose_hashes_could_agree():
    """Polynomial hashes modulo 2^64 agree for these two words, whatever the base."""
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    enc = token_files.Encoder(BYTE)
    for t in (f"x {a} y", f"x {b} y", f"x {a}{b}"):
        assert [ids.tolist() for ids in enc.encode(*text_buffers(pa.array([t])))] == [enc.tok.encode(t, add_special_tokens=False).ids]
    h = [h for _, h, _, _ in word_hashes(*text_buffers(pa.array([a, b])))]
    assert h[0][0] != h[1][0]


def test_known_words_of_one_hash():
    """Rows are told apart by their units where all hashes agree."""
    words, got = [b"one", b"two", b"three", b"four"], Ragged(np.uint8)
    known = Known(16, np.uint8, [got])
    for turn in (words, words[::-1], [*words, b"one", b"five"]):
        data = np.frombuffer(b"".join(turn), np.uint8)
        e = np.cumsum([len(w) for w in turn])
        s = e - [len(w) for w in turn]
        rows = known.rows(np.full(len(turn), 7, np.uint64), data, s, e, lambda new: got.extend(data[spread(s[new], (e - s)[new])], (e - s)[new]))
        assert [got.take(rows[i : i + 1])[0].tobytes() for i in range(len(turn))] == turn


def test_chunks_with_odd_white_space():
    enc, rng = token_files.Encoder(BYTE), random.Random(12)
    alphabet = ["a", "B", "é", "'", "s", "ll", ",", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\u2003", "\u1680", "\x85", "\x1f", "\x00", "1", "日", "𝕏", "\u0301", "<|endoftext|>"]
    some = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    want = [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]
    assert [ids.tolist() for ids in enc.encode(*text_buffers(pa.array(some)))] == want


def test_more_chunks_than_are_kept(monkeypatch):
    monkeypatch.setattr(token_files, "CHUNKS", 128)
    enc = token_files.Encoder(BYTE)
    for k in range(6):
        some = [" ".join(f"w{k * 60 + i}" for i in range(40)), "w1 w1 w2"]
        want = [e.ids for e in enc.tok.encode_batch(some, add_special_tokens=False)]
        assert [ids.tolist() for ids in enc.encode(*text_buffers(pa.array(some)))] == want


@pytest.mark.parametrize("kind", ["runs", "random", "phrases"])
def test_repair(kind):
    rng = np.random.default_rng(8)
    lens = rng.integers(1, 400, 60)
    n = int(lens.sum())
    ids = {"runs": np.repeat(rng.integers(0, 5, n), 9)[:n], "random": rng.integers(0, 50_257, n), "phrases": np.tile(rng.integers(0, 999, 37), n)[:n]}[kind].astype(np.uint16)
    seq, at, rules, size = token_files.compress(ids, np.cumsum(lens), 50_257)
    assert (token_files.expand(seq, rules, 50_257) == ids).all() and len(at) == len(lens) + 1
    ends = np.r_[0, np.cumsum(lens)]
    for d in (0, 17, 59):  # random access by document
        assert (token_files.expand(seq[at[d] : at[d + 1]], rules, 50_257) == ids[ends[d] : ends[d + 1]]).all()
    assert (size == [len(token_files.expand(np.array([50_257 + r], np.uint16), rules, 50_257)) for r in range(len(rules))]).all()
    assert kind == "random" or len(seq) < n / 2


def test_repair_goes_on_until_no_pair_is_frequent():
    ids = np.tile(np.arange(40, dtype=np.uint16), 5000)
    seq, at, rules, size = token_files.compress(ids, np.array([len(ids)]), 50_257)
    assert (token_files.expand(seq, rules, 50_257) == ids).all() and len(seq) < 2 * token_files.LEAST * 40 and size.max() > 1000
    rng = np.random.default_rng(1)
    ids = rng.choice(np.arange(300, dtype=np.uint16), 200_000)
    seq, at, rules, size = token_files.compress(ids, np.array([len(ids)]), 300)
    pairs = np.unique(np.stack([seq[:-1], seq[1:]]), axis=1, return_counts=True)[1]
    assert pairs.max() < 2 * token_files.LEAST and (token_files.expand(seq, rules, 300) == ids).all()
    wide = np.repeat(rng.permutation(60_000).astype(np.uint16), 2)
    seq, at, rules, size = token_files.compress(np.tile(wide, 16), np.arange(1, 17) * len(wide), 60_000)
    assert len(rules) > 5536 and seq.dtype == np.uint32 and (token_files.expand(seq, rules, 60_000) == np.tile(wide, 16)).all()


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD", 2000)
    docs = [(i * 3 % 101, t) for i, t in enumerate(texts(79))] + [(500, None), (501, "word " * 20_000)]
    df = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, start string")
    path = str(tmp_path / "tokens")
    token_files.write(df, BYTE, path)
    got, at = {r.doc_id: r for r in token_files.read(spark, path, with_ids=True).collect()}, 0
    tok = token_files.Encoder(BYTE).tok
    for i, t in sorted(docs):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r.start, r.n_tokens, r.ids) == (at, len(ids), ids) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert token_files.read_document(spark, path, 500) == [2] and token_files.read_document(spark, path, 12345) is None
    empty = str(tmp_path / "empty")
    token_files.write(df.limit(0), BYTE, empty)
    assert token_files.read(spark, empty).count() == 0


def test_odd_rows_of_token_files_and_pieces(spark, tmp_path):
    rows = [(7, "b b", 1, "p"), (7, "a a", 2, "q"), (None, "n n", 3, "r"), (7, "a a", 4, "s"), (3, None, 5, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, part string")
    path = str(tmp_path / "odd")
    token_files.write(df, BYTE, path)
    tok = token_files.Encoder(BYTE).tok
    got = token_files.read(spark, path, with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 3, 7, 7, 7]
    assert [r.ids for r in got] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in ("n n", "", "a a", "a a", "b b")]
    assert [r.start for r in got] == np.cumsum([0] + [len(r.ids) for r in got])[:-1].tolist()
    out = pieces.round_trip_digests(df, PIECE).collect()
    lib = pieces.pieces(PIECE).lib
    want = lambda t: hashlib.sha256(",".join(map(str, lib.encode(t or ""))).encode()).hexdigest()
    assert sorted((repr(r.doc_id), r.ids_sha256) for r in out) == sorted((repr(i), want(t)) for i, t, _, _ in rows)


def test_best_fit():
    rng = random.Random(9)
    lengths = sorted((rng.randrange(1, 16385) for _ in range(3000)), reverse=True)
    where, caps = packing.pack(lengths, packing.CAPACITIES)
    fill = [0] * len(caps)
    for n, (b, o) in zip(lengths, where):
        assert o == fill[b]
        fill[b] += n
    assert all(f <= c and c in packing.CAPACITIES and not any(f <= s < c for s in packing.CAPACITIES) for f, c in zip(fill, caps))
    assert sum(lengths) / sum(caps) > 0.97


def least_cost(lengths, caps, overhead):
    """The cheapest of all ways to part lengths into bins."""
    best = [10**9]

    def go(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(packing.final_size(b, caps) + overhead for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= caps[-1]:
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


def test_best_fit_is_near_the_cheapest_way():
    rng, caps = random.Random(3), [20, 40, 80]
    ours = least = 0
    for _ in range(120):
        lengths = sorted((rng.randrange(1, rng.choice([15, 45, 81])) for _ in range(rng.randrange(1, 8))), reverse=True)
        where, final = packing.pack(lengths, tuple(caps), 3)
        cost = sum(final) + 3 * len(final)
        cheapest = least_cost(lengths, caps, 3)
        assert cheapest <= cost <= 1.5 * cheapest
        for c in caps:
            if c >= lengths[0]:
                used = packing.best_fit_bins(lengths, [c], 3, caps)[1]
                assert cost <= sum(packing.final_size(u, caps) + 3 for u in used)
        ours, least = ours + cost, least + cheapest
    assert ours <= 1.05 * least


def test_sizes_are_weighed_jointly():
    """Pieces that fill the middle size exactly go there, though larger bins would hold more of them."""
    where, final = packing.pack([3000] * 40 + [1096] * 40, (2048, 4096, 10_000))
    assert final == [4096] * 40
    where, final = packing.pack([5000] * 10 + [1900] * 30, (2048, 8192))
    assert sum(final) == 10 * 8192 + 20 * 2048


def test_repeated_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(1, 700)] * 500 + [(None, 700)] * 40 + [(2, 0), (3, None), (4, -5)], "doc_id long, length long")
    out = packing.best_fit(df, per_task=50).collect()
    groups = {}
    for r in out:
        groups.setdefault(r.bin.split("-")[0], []).append(r)
    assert len(out) == 540 and len(groups) > 5 and max(map(len, groups.values())) < 120


def test_packing_is_whole(spark):
    docs = [(i, "é" * (i * 37 % 9000)) for i in range(150)] + [(None, "x"), (7, "y"), (7, "y"), (900, None), (901, "z" * 100_001)]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, bin int")
    out = packing.best_fit(packing.byte_lengths(df), per_task=40).collect()
    assert sum(r.length for r in out) == sum(len((t or "").encode()) + 1 for _, t in docs)
    big = sorted((r.start, r.length) for r in out if r.doc_id == 901)
    assert [s for s, _ in big] == [k * 16384 for k in range(len(big))] and sum(n for _, n in big) == 100_002
    bins = {}
    for r in out:
        bins.setdefault((r.bin, r.capacity), []).append((r.bin_offset, r.length))
    for (_, cap), parts in bins.items():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(parts[-1]) <= cap
    assert len({r.bin.split("-")[0] for r in out}) > 1
    assert packing.best_fit(packing.byte_lengths(df.limit(0))).count() == 0


def test_known_chunks_by_edge_words():
    """Chunks of any size are told apart, though edge words or hashes agree."""
    words = [b"a", b"a\0", b"\0", b"\0\0", b"12345678", b"12345678\0", b"1234567812345678", b"12345678x12345678", b"12345678y12345678", b"12345678" * 9, b"12345678" * 10, b"abcdefgh" + b"xy" * 600 + b"abcdefgh", b"abcdefgh" + b"yx" * 600 + b"abcdefgh"]
    some = [words[i] for i in np.random.default_rng(3).integers(0, len(words), 400)] + words
    data = np.frombuffer(b"".join(some), np.uint8)
    e = np.cumsum([len(w) for w in some])
    s = e - [len(w) for w in some]
    edges = edge_words(data, s, e)
    for h in (chunk_hashes(data, s, e, edges), np.zeros(len(some), np.uint64)):
        known = Known(64, np.uint8, [])
        rows = known.rows(h, data, s, e, lambda new: None, edges)
        assert len({(r, w) for r, w in zip(rows.tolist(), some)}) == len(set(rows.tolist())) == len(words)
