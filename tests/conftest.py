import sys
from contextlib import contextmanager
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.plans.expected import EXPECTED  # noqa: E402
from millrace.plans.registry import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

TESTDATA = Path("/root/testdata")
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages"]




def queries():
    """The queries on the star and event tables; those of `llm` have their own tests."""
    return dict(QUERIES)


def oracle_sql():
    return dict(EXPECTED)


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, memory="8g", partitions=8)
    yield session
    session.stop()


@contextmanager
def relation(sql, folder):
    with duckdb.connect() as connection:
        for table in TABLES:
            path = Path(folder) / f"{table}.parquet"
            if path.exists():
                files = f"{path}/*.parquet" if path.is_dir() else path
                connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{files}'")
        yield connection.sql(sql)


@pytest.fixture(scope="session")
def duck():
    """A function that runs SQL on the tables in a folder."""

    def run(sql, folder):
        with relation(sql, folder) as result:
            return sorted(result.columns), _rows(result.df())

    return run


@pytest.fixture(scope="session")
def duck_types():
    """A function that tells the column types of SQL on the tables in a folder."""

    def run(sql, folder):
        with relation(sql, folder) as result:
            return {c: str(t) for c, t in zip(result.columns, result.types)}

    return run


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(row) for row in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def rows():
    """Columns by name and rows in a fixed order, of a Spark result."""

    def of(df):
        return sorted(df.columns), _rows(df.toPandas())

    return of
