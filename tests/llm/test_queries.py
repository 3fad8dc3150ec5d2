"""The registered queries on the smallest tables, against SQL where there is some, and the contract's columns."""

import math

import duckdb
import pytest

from sparrowmill.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op3_chat_format": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op5_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op6_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op10_quality": ["doc_id", "held_out", "score", "predicted"],
    "op11_lm_scoring": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op12_spelling": ["word", "form", "root", "n", "n_near", "form_n"],
    "op13_lexical_search": ["item_id", "rank", "doc_id", "score"],
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v + 0.0:.9g}" if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted([cell(r[k]) for k in order] for r in data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns[: len(COLUMNS.get(name, []))] == COLUMNS.get(name, [])
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name])
        assert got == rows(want.columns, want.fetchall())
    elif "fingerprint_neighbours" not in name:
        assert len(got[1]) == db.sql("SELECT count(*) FROM documents").fetchall()[0][0]


def test_thirteen_operators():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14))
