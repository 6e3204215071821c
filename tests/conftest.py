import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import compare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = compare.session()
    yield session
    session.stop()


@pytest.fixture(scope="session")
def page(spark):
    """One-page table from markup."""

    def make(html, url="https://www.nunoa.cl/", seq=0):
        rows = [(seq, url, html, seq)]
        return spark.createDataFrame(
            rows, "page_id BIGINT, url STRING, html STRING, crawl_seq BIGINT"
        )

    return make


@pytest.fixture(scope="session")
def pages(spark):
    """Page table from (url, html) pairs in crawl order."""

    def make(*pairs):
        rows = [(i, url, html, i) for i, (url, html) in enumerate(pairs)]
        return spark.createDataFrame(
            rows, "page_id BIGINT, url STRING, html STRING, crawl_seq BIGINT"
        )

    return make
