import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from support import HEADER, planted_rows  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from cohortlens.session import get_spark
    s = get_spark("local[4]", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb
    from cohortlens.sources.tables import TABLES

    def make(sf_dir):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        return con
    return make


@pytest.fixture(scope="session")
def planted_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("planted") / "customers.csv"
    path.write_text("\r\n".join([HEADER, *(",".join(map(str, r)) for r in planted_rows())]) + "\r\n")
    return str(path)
