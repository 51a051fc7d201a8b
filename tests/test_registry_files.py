"""Queries over rendered files against their SQL, on a small part table."""

from collections import Counter

import duckdb
import pytest

from stocklens import registry_files
from stocklens.sources import manifests


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("parts"))
    rows = [(i, ("small ring", "hot gear", "red bolt")[i % 3], f"Brand#{i % 25}", "SMALL", i % 50) for i in range(170)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(f"{top}/part.parquet")
    return top


@pytest.mark.parametrize("name", ["parsed_build", "parsed_single", "parsed_edges", "parse_errors"])
def test_against_sql(spark, folder, name):
    base = duckdb.connect()
    base.execute(f"create view part as select * from '{folder}/part.parquet/*.parquet'")
    found = base.execute(registry_files.ORACLES[name])
    columns, want = [d[0] for d in found.description], Counter(found.fetchall())
    got = registry_files.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns) and Counter(map(tuple, got.select(columns).collect())) == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_go_to_python_a_few_at_a_time(spark):
    """An Arrow batch holds 10,000 rows, so whole files in one would fill an executor's Python as tables grow."""
    files = spark.createDataFrame([("p", "x", "{}")], "project string, path string, text string")
    for parse in (manifests.cargo_lock, manifests.poetry_lock, manifests.package_lock, manifests.poetry_lock_edges, manifests.cmake, manifests.mk_file, manifests.parse_errors):
        plan = plan_of(parse(files))
        assert "ArrowEvalPython" not in plan and (parse is manifests.parse_errors or "BatchEvalPython" in plan)


def test_texts_are_parsed_once(spark):
    files = spark.createDataFrame([("p", "3rdparty/a/CMakeLists.txt", "")], "project string, path string, text string")
    assert plan_of(manifests.cargo_lock(files)).count("EvalPython [") <= 1
    assert manifests.vendored_libraries(files)._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(text") <= 4
    assert "regexp_extract_all" not in plan_of(manifests.gitmodules(files))
