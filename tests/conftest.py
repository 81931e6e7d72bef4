from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bucketscope.schema import LISTING_SCHEMA  # noqa: E402
from bucketscope.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[4]",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.maxMetadataStringLength": "10000"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


UTC = dt.timezone.utc
DAY = dt.datetime(2024, 1, 15, 10, 30, tzinfo=UTC)


def row(key: str, size: int = 0, **values):
    """A listing row: an object of bucket ``b`` unless said otherwise."""
    base = {
        "bucket": "b",
        "entry_type": "OBJECT",
        "key": key,
        "size": size,
        "last_modified": DAY,
        "e_tag": '"t"',
        "checksum_algorithm": [],
    }
    if values.get("entry_type") == "PREFIX":
        base |= {"last_modified": None, "e_tag": None, "checksum_algorithm": None}
    base |= values
    return tuple(base.get(f.name) for f in LISTING_SCHEMA.fields)


@pytest.fixture(scope="session")
def rows(spark):
    def make(*entries):
        return spark.createDataFrame(list(entries), LISTING_SCHEMA)

    return make


def keys(df) -> list[str]:
    return [r["key"] for r in df.select("key").collect()]


def values(df) -> list[str]:
    return [r["value"] for r in df.select("value").collect()]
