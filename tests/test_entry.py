import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from meridian.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DIR}/{f}'")
    return c


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, con, name):
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    got = entry.queries()[name](spark, DIR)
    assert sorted(got.columns) == cols
    clean = lambda rows: sorted(repr(tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r)) for r in rows)
    assert clean(got.select(*cols).collect()) == clean(want.select(", ".join(f'"{c}"' for c in cols)).fetchall())


def test_text_hashes_of_odd_names(spark, tmp_path):
    spark.createDataFrame([(1, None), (2, "éb"), (3, "a:1;")], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = entry.queries()["h4_h6_text_hashes"](spark, str(tmp_path)).collect()
    want = duckdb.sql("WITH part AS (SELECT * FROM '%s/part.parquet/*.parquet') %s" % (tmp_path, entry.oracle_sql()["h4_h6_text_hashes"].replace("WITH a", ", a", 1))).fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) == 3


def test_no_function_is_defined_twice():
    for path in (Path(entry.__file__).parent / "meridian").rglob("*.py"):
        names = re.findall(r"^def (?!_\()(\w+)\(", path.read_text(), re.M)
        assert len(names) == len(set(names)), path
