"""Queries with SQL twins on the smallest tables and on awkward rows."""

import duckdb
import pyarrow as pa
import pytest

import checks
import edge
from tidewheel.llm import exact, licenses, mixing, queries

ORACLE = queries.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLE))
def test_twin(spark, folder, name):
    assert checks.compare(queries.queries()[name](spark, folder), checks.connect(folder), ORACLE[name]) == []


def _edge_connection(rows):
    con = duckdb.connect()
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string()]
    documents = pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text", "lang", "source"])  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT * FROM documents")
    return con


def _run(name, docs):
    if name.startswith("op2"):
        return exact.content_groups(docs, keep="largest")
    if name.startswith("op6"):
        return mixing.mix(docs, carry=["doc_id"]).drop("copies")
    return licenses.scan(docs)


@pytest.mark.parametrize("name", ["op6_pareto_mix", "op9_license_scan"])
@pytest.mark.parametrize("rows", [edge.ROWS, []], ids=["edge", "empty"])
def test_twin_on_edge_rows(spark, name, rows):
    unique = list({(r[0], r[1]): r for r in rows if r[0] is not None}.values())
    docs = edge.clashing(edge.documents(spark, unique))
    assert checks.compare(_run(name, docs), _edge_connection(unique), ORACLE[name]) == []


def test_no_row_cap_or_sample_in_inputs(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("op2_content_sort", "op6_pareto_mix", "op9_license_scan", "op7_digest_cache", "op10_toxicity_cnn"):
        assert queries.queries()[name](spark, folder).count() == documents
