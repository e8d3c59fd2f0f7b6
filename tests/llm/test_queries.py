"""The registered queries on the smallest tables: against SQL, else against plain versions."""

import hashlib
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA

sys.path.insert(0, str(Path(__file__).resolve().parent))

from test_tagging import UP, brute_spans  # noqa: E402

from roadlens.llm import licenses, packing, registry, secrets  # noqa: E402

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(SF / "documents.parquet").to_pandas()


def run(spark, name):
    return registry.queries()[name](spark, str(SF)).toPandas()


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = run(spark, name), con.execute(registry.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(repr, d[sorted(want.columns)].astype(object).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_languages(spark, docs):
    got = run(spark, "op2_language_id").set_index("doc_id")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs.doc_id}
    assert got.held_out.to_dict() == held and got.score.between(0, 1).all()
    truth = docs[[held[i] for i in docs.doc_id]].set_index("doc_id").lang.dropna()
    assert (got.lang_pred.loc[truth.index] == truth).mean() >= 0.95


def test_tokens(spark, docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(registry.tokenizer_path("byte_bpe_50k.json"))
    got, at = run(spark, "op4_token_files").set_index("doc_id"), 0
    for i, t in sorted(zip(docs.doc_id, docs.text)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(got.loc[i, ["start", "n_tokens", "ids_crc32"]]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_pieces(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=registry.tokenizer_path("piece_bpe_32k.model"))
    got = run(spark, "op5_sentencepiece").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        ids = lib.encode(t or "")
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())
        assert tuple(got.loc[i, ["n_tokens", "ids_sha256", "decoded_sha256"]]) == want


def test_secrets(spark, docs):
    got = run(spark, "op6_secret_scan").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        base = brute_spans(t or "")
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert tuple(got.loc[i, ["n_assign", "n_access", "n_hex"]]) == tuple(sum(x[1] == k for x in base) for k in range(3))
        assert got.loc[i, "base_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_packing(spark, docs):
    got = run(spark, "op7_best_fit_packing")
    want = {i: len((t or "").encode()) + 1 for i, t in zip(docs.doc_id, docs.text)}
    assert got.groupby("doc_id").length.sum().to_dict() == want
    use = got.groupby("bin").agg(used=("length", "sum"), cap=("capacity", "first"))
    assert (use.used <= use.cap).all() and set(use.cap) <= set(packing.CAPACITIES)


def test_licenses(spark, docs):
    got = run(spark, "op8_license_scan").set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        at = [(x, label) for p, label in licenses.PHRASES.items() for x in range(len(w)) if w[x : x + len(p.split())] == p.split()]
        assert (got.n_words[i], got.n_base[i], got.base_labels[i]) == (len(w), len(at), ",".join(sorted({label for _, label in at})))
        assert not at or (got.first_word[i], got.last_word[i]) == (min(at)[0], max(at)[0])


def test_neighbours(spark):
    rows = pq.read_table(SF / "embeddings.parquet").to_pandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got, hits, n = run(spark, "op10_nearest_neighbours"), 0, 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        own = got[got.query_id == ids[q]].sort_values("rank")
        best = ids[np.lexsort((ids, d))[:10]]
        hits, n = hits + len(set(own.vec_id) & set(best)), n + len(best)
        assert own["rank"].tolist() == list(range(1, 1 + len(own)))
    assert hits >= 0.9 * n
