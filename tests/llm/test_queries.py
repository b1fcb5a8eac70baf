"""The registered queries: one for each operator, contract columns, SQL where there is some."""

import duckdb
import pytest

import __spark_entry__ as entry
from connrisk.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    2: "query_id bigint, rank int, vec_id bigint, score double",
    3: "doc_id bigint, n_shingles bigint, component_id bigint",
    4: "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    5: "doc_id bigint",
    6: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    7: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    8: "doc_id bigint, held_out boolean, lang_pred string, score double",
    9: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    10: "page_id bigint, host string, path string, rule string, verdict string",
    11: "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    12: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    13: "item_id bigint, rank int, doc_id bigint, score bigint",
}


def test_every_operator_has_one_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(llm, name):
    found = dict(QUERIES[name](llm, SF).dtypes)
    for column in COLUMNS[int(name[2:].split("_")[0])].split(", "):
        column, kind = column.split()
        assert found[column] == kind


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_gives_the_same_rows(llm, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM read_parquet('{SF}/{name_}.parquet')")
    df = QUERIES[name](llm, SF)
    expected = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(expected)
