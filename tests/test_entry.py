"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"
NAMES = ("pr4_first_match", "j9_radius_join", "ag7_cramers_v", "wn5_rolling_sums", "in8_wasserstein", "me2_auroc", "flagship_matched_sets")


def test_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_stands_without_the_subpackage(tmp_path):
    code = f"""
import importlib.abc, sys
sys.path.insert(0, {ROOT!r})
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path, target=None):
        if name.startswith("cohortspark.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
q = e.queries()
assert len(q) > 100 and not any(k.startswith("op") or k == "pipeline" for k in q) and set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got, want = e.queries()[name](spark, SF).toPandas(), con.sql(e.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda d: sorted(tuple(round(float(x), 4) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in d[cols].itertuples(index=False))
    assert plain(got) == plain(want)
