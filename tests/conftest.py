import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerframe.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "4",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def scripts(spark):
    """A maker of (name, text) frames from names alone or from a dict."""

    def make(items):
        pairs = items.items() if isinstance(items, dict) else [(n, "select 1;") for n in items]
        return spark.createDataFrame(list(pairs), "name string, text string")

    return make


@pytest.fixture(scope="session")
def registry(spark):
    """A maker of registries; ids follow the order given."""

    def make(items):
        pairs = items.items() if isinstance(items, dict) else [(n, "select 1;") for n in items]
        rows = [(i + 1, n, t, int(n.rsplit(".", 1)[0].endswith("_rollback")), 0) for i, (n, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, "script_id bigint, name string, text string, type int, status int")

    return make
