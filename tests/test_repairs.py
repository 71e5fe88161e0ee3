"""Anchors in any writing, parts of titles said once, and neighbours within groups only."""

import pytest
from pyspark.sql import functions as F

from sievery.functions import fields, text
from sievery.operators import windows
from sievery.sources import connectors


def test_anchors_in_any_writing(spark):
    page = spark.createDataFrame([("<A class='x' HREF='/1'>One</A><a href=/2 id=y>Two</a><a data-href='/no'>No</a><a\nhref = \"/3\"><b>Three</b></a>",)], "html string")
    assert [(r.href, r.label) for r in connectors.anchors(page).collect()][:2] == [("/1", "One"), ("/2", "Two")]
    assert ("/3", "Three") in [(r.href, r.label) for r in connectors.anchors(page).collect()]
    assert page.select(text.attribute(F.lit("<img alt='a b' src=x.png>"), "img", "alt").alias("a"), text.attribute(F.lit("<img>"), "img", "alt").alias("b")).first() == ("a b", "")


@pytest.mark.parametrize("title, shown", [("Analyst | Analyst | Acme", "Analyst"), ("Data Analyst | data analyst | Data Analyst", "Data Analyst"), ("Analyst | Analysts", "Analyst | Analysts"), ("Policy Analyst", "Policy Analyst")])
def test_parts_of_titles_once(spark, title, shown):
    assert spark.range(1).select(fields.clean_title(F.lit(title), F.lit("Acme"))).first()[0] == shown


def test_neighbours_need_groups(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "g int, id int")
    assert sorted(tuple(r) for r in windows.neighbours(df, ["id"], "id", ["g"]).collect()) == [(1, 1, None, 2), (1, 2, 1, None), (2, 3, None, None)]
    with pytest.raises(ValueError):
        windows.neighbours(df, ["id"], "id", [])
