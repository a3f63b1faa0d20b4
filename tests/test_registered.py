"""Every registered query against its DuckDB oracle on sf0.001, plus the
entry point and batch = stream."""
import os
import sys

import duckdb
import pytest

from tests.conftest import ROOT, SF_SMALL

sys.path.insert(0, os.path.join(ROOT, "tools"))
import oracle_check  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from quarry.plans.registry import QUERIES, load_all  # noqa: E402

load_all()


# The queries of optional parts have their own tests.
CORE = sorted(QUERIES)

SQL_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) >= {"item_id", "rank", "chunk_id", "score"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in oracle_check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(rows) > 0
        return
    cur = con.execute(sql)
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    for f in df.schema.fields:
        assert SQL_TYPES.get(f.dataType.simpleString()) == types[f.name], (f.name, f.dataType, types[f.name])
    assert len(rows) == len(orows)
    assert oracle_check.digest(df.columns, rows) == oracle_check.digest(ocols, orows)


@pytest.mark.parametrize("name", CORE)
def test_no_pairwise_operators(spark, name):
    """No registered plan pairs rows without a key: no Cartesian product and
    no nested-loop join (scoring happens inside tasks, joins are equi-joins)."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


# Queries whose plan must show the scoring of passages and the rank.
SCORED = ["retrieve_text", "retrieve_sections", "retrieve_dense_text", "catalogue_match", "catalogue_dense",
          "prompt_context", "knn_dense", "retrieve_min_score", "retrieve_text_index"]


@pytest.mark.parametrize("name", SCORED)
def test_search_stays_in_the_plan_and_does_not_copy_the_corpus(spark, name):
    """The scan, the scoring and the rank are in the returned plan, and no
    exchange by a key and no replication lies between the passages and their
    scoring (the checks deal a one-row-group file to all cores)."""
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "WindowGroupLimit" in plan
    lines = plan.split("== Initial Plan ==")[0].split("\n")
    for i, line in enumerate(lines):
        if "MapInArrow run(" in line and "score" in line:
            depth = line.index("MapInArrow")
            below = []
            for x in lines[i + 1:]:
                at = len(x) - len(x.lstrip(" :+-*(0123456789)"))
                if at <= depth:
                    break
                below.append(x)
            moved = [x for x in below if "Exchange" in x and "RoundRobin" not in x or "sequence(" in x]
            assert not moved, (name, moved)


@pytest.mark.parametrize("name", ["knn_dense_blocked", "retrieve_text_blocked", "knn_sparse_all"])
def test_many_questions_meet_the_corpus_in_a_grid(spark, name):
    plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "__cell" in plan and "WindowGroupLimit" in plan


def test_scans_read_only_needed_columns(spark):
    """Column pruning reaches the parquet scans."""
    cases = {"char_chunks": ("n_chars", "lang", "source"), "key_lookup": ("c_acctbal", "c_mktsegment"),
             "knn_dense": ("label",)}
    for name, absent in cases.items():
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        schemas = [seg.split("]")[0].split("\n")[0] for seg in plan.split("ReadSchema: ")[1:]]
        assert schemas, name
        assert all(col not in sch for sch in schemas for col in absent), (name, schemas)
