import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from helpers import SF  # noqa: E402

from stockhealth.session import build_session, shared_path  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
        spark__driver__memory="6g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def fresh(spark):
    """A new path in the shared folder on every call."""
    return lambda name="t": shared_path(spark, name)


@pytest.fixture(scope="session")
def seed_csv():
    return os.path.join(ROOT, "tests", "data", "seed_stock.csv")


@pytest.fixture(scope="session")
def seed(spark, seed_csv):
    from stockhealth.sources.tables import read_stock_csv

    return read_stock_csv(spark, seed_csv).cache()


@pytest.fixture(scope="session")
def daily(spark):
    """The derived ledger, written once."""
    from stockhealth.plans.inputs import stock_daily

    path = shared_path(spark, "ledger")
    stock_daily(spark, SF).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def actions(spark):
    from stockhealth.plans.inputs import action_logs

    path = shared_path(spark, "log")
    action_logs(spark, SF).write.parquet(path)
    return spark.read.parquet(path)
