from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pageloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("checkpoints")
    session = local_session(8, "tests", **{"spark.checkpoint.dir": folder.as_uri(), "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture
def pages(spark):
    """Pages from HTML strings; page ids count from 1."""

    def build(*htmls: str | None, url: str = "https://a.test/x"):
        return spark.createDataFrame(
            [(i, url, html) for i, html in enumerate(htmls, 1)], "page_id bigint, url string, html string"
        )

    return build


@pytest.fixture
def texts(spark):
    def build(*values: str | None):
        return spark.createDataFrame(list(enumerate(values, 1)), "page_id bigint, text string")

    return build


@pytest.fixture
def value(spark):
    """Value of an expression over one string column t."""

    def run(expression, text):
        return spark.createDataFrame([(text,)], "t string").select(expression.alias("x")).first()["x"]

    return run


def rows(df, *columns):
    """Rows as sorted tuples."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
