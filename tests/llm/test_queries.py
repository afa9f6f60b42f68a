"""The thin queries over small tables: columns, types, fixed values, and their SQL run by another engine."""

import os
from collections import Counter

import pytest

from colinear.llm import queries as thin

TYPES = {
    "op1_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_suffixes": {"doc_id": "bigint", "start": "int", "end": "int", "whole": "boolean"},
    "op3_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_quality": {"doc_id": "bigint", "expected_grade": "double", "keep": "boolean"},
    "op5_topk": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op6_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op7_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op8_toolcalls": {"conv_id": "bigint", "call_id": "string", "position": "bigint", "json": "string"},
    "op9_lines": {"doc_id": "bigint", "n_lines": "int", "n_dropped": "int", "text": "string"},
    "op10_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.mark.parametrize("name", sorted(TYPES))
def test_columns_and_rows_of_the_queries(spark, tables, name):
    out = thin.queries()[name](spark, tables)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema.fields}
    assert {k: kinds.get(k) for k in TYPES[name]} == TYPES[name]
    rows = out.collect()
    n = spark.read.parquet(f"{tables}/documents.parquet").count()
    if name not in ("op2_suffixes", "op5_topk", "op8_toolcalls"):
        assert len(rows) == n
    if name == "op1_sharding":
        assert {r.law for r in rows} == {"key"} and all(0 <= r["shard"] < 24 and r.grown_shard in (r["shard"], 24) for r in rows)
    if name == "op5_topk":
        assert all(r.query_id % 100 == 0 and 1 <= r.rank <= 10 for r in rows)
    if name == "op10_simhash":
        assert all(len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower() for r in rows)
    sql = thin.oracle_sql().get(name)
    if sql is None:
        assert name in ("op1_sharding", "op4_quality", "op6_language", "op10_simhash")  # see test_operators
        return
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(tables):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tables}/{t}/*.parquet')")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(out.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    assert Counter(tuple(plain(r[c]) for c in names) for r in rows) == Counter(tuple(plain(x) for x in r) for r in got.fetchall())


def test_sharding_moves_whole_documents(spark, tables, monkeypatch):
    seen, real = [], thin.shard.shuffle_into_shards
    monkeypatch.setattr(thin.shard, "shuffle_into_shards", lambda rows, *a, **k: seen.append(rows) or real(rows, *a, **k))
    out = thin.op1_sharding(spark, tables)
    assert set(seen[0].columns) >= {"doc_id", "text", "lang", "source"} and out.count() == seen[0].count()
