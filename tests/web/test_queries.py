"""Every registered query against its SQL on whole tables."""

import pandas as pd
import pytest

from weftline.plans.registry import ORACLES, QUERIES

from ..oracles import SMALL, compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_is_that_of_sql(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    got = QUERIES[name](spark, SMALL)
    assert got.count() == 50 and got.where(f"{got.columns[1]} = ''").isEmpty()


@pytest.mark.parametrize("name", ["fetch_fast", "stream_fetch", "fetch_errors"])
def test_of_pages_with_one_address_the_first_is_taken(spark, tmp_path, name):
    html = ["<html>" + "z" * 600, "<html>" + "a" * 700, "<html>" + "b" * 800, "<html>" + "c" * 900]
    urls = ["http://a.example.com/x", "http://a.example.com/x", "https://b.example.com/y", "http://www.b.example.com/y"]
    pd.DataFrame({"page_id": [1, 2, 3, 4], "url": urls, "html": html}).to_parquet(tmp_path / "pages.parquet")
    compare(spark, QUERIES[name], ORACLES[name], str(tmp_path))
