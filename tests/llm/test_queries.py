"""Every registered query of the subpackage over the small tables, against SQL where there is some, else against what its contract says of every row."""

import zlib

import duckdb
import pytest

import __spark_entry__
from tests.test_queries import TABLES, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def got(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["op3_chat_format", "op10_warc", "op11_hard_negatives", "op12_site_style", "op13_merkle_manifest"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(__spark_entry__.oracle_sql()[name])
    rows, columns = rel.fetchall(), sorted(rel.columns)
    have = got(spark, name)
    assert sorted([plain(r[c]) for c in columns] for r in have) == sorted([plain(r[rel.columns.index(c)]) for c in columns] for r in rows)


def test_lm_score(spark, documents):
    rows = got(spark, "op1_lm_score")
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    same = {}
    for r in rows:
        t = documents[r.doc_id]
        assert r.n_tokens == len(t.lower().split()) and (r.pseudo_log_likelihood < 0) == (r.n_tokens > 0)
        assert abs(same.setdefault(t, r.pseudo_log_likelihood) - r.pseudo_log_likelihood) < 1e-3 * max(1, r.n_tokens)


def test_token_counts(spark, documents):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = {r.doc_id: r for r in got(spark, "op2_token_counts")}
    for i, t in documents.items():
        n = len(model.encode(t))
        assert (rows[i].n_bytes, rows[i].n_tokens, rows[i].over_limit) == (len(t.encode()), n, n > 4096)


def test_mixing(spark, documents):
    rows = got(spark, "op5_mixing")
    assert sorted(r.doc_id for r in rows) == sorted(documents) and all(r.rate >= 0 for r in rows)
    base = sum(r.n_tokens * r.p_clean for r in rows)
    totals = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in ("clean", "low", "toxic")}
    want = {"clean": 1.2 * base, "low": 1.2 * base * 0.06 / 0.93, "toxic": 1.2 * base * 0.01 / 0.93}
    assert all(abs(totals[d] / want[d] - 1) < 1e-3 for d in want)


def test_nearest(spark):
    rows = got(spark, "op6_ann")
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    hits = total = 0
    for q in [i for i in vectors if i % 100 == 0]:
        mine = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        d = sorted((sum((a - b) ** 2 for a, b in zip(vectors[q], v, strict=True)) ** 0.5, i) for i, v in vectors.items() if i != q)[:10]
        assert [m[0] for m in mine] == list(range(1, 11))
        hits += len({m[1] for m in mine} & {i for _, i in d})
        total += 10
    assert hits / total >= 0.9


def test_simhash(spark, documents):
    from quillgraph.llm.simhash_dedup import fingerprint

    rows = got(spark, "op7_simhash_dedup")
    prints = {i: fingerprint(t, 3) for i, t in documents.items()}
    assert {r.doc_id: int(r.fingerprint, 16) for r in rows} == prints
    root = {i: i for i in prints}
    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    assert {r.doc_id: r.component_id for r in rows} == root


def test_language_id(spark, documents):
    rows = got(spark, "op8_language_id")
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {r.doc_id for r in rows if r.held_out} == {i for i in documents if zlib.crc32(str(i).encode()) % 5 == 0}
    judged = [(r.lang_pred, lang[r.doc_id]) for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert sum(a == b for a, b in judged) / len(judged) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_packing_and_pipeline(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name in ("op9_packing", "pipeline"):
        rows = got(spark, name)
        places = {}
        for r in rows:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        full = [sum(n for _, n in x) for x in places.values()]
        assert all(sorted(x)[i + 1][0] == sum(sorted(x)[i]) for x in places.values() for i in range(len(x) - 1)) and sum(n != 1024 for n in full) <= 1
        if name == "op9_packing":
            by = {}
            for r in rows:
                by.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
            for i, t in documents.items():
                n = len(tokenizer.encode(t, add_special_tokens=False).ids) + 1
                assert sum(x[1] for x in by[i]) == n == by[i][0][2]
        else:
            assert {r.doc_id for r in rows} <= set(documents) and len(rows) > 50
