"""Every benchmark passage is scored against every page."""

from lexmill import registry

DIR = "/root/testdata/sf0.001"


def test_every_passage_has_every_page(spark):
    pairs = spark.read.parquet(f"{DIR}/benchmark.parquet").count() * spark.read.parquet(f"{DIR}/pages.parquet").count()
    out = registry.queries()["lexical_relevance"](spark, DIR)
    assert out.count() == pairs == out.select("item_id", "page_id").distinct().count()
