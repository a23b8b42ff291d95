from quillspan.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_work_is_merged(spark):
    got = catalogue.merge_master(spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {"MIDDLE EAST", "Middle East"} <= {x.state for x in got.select("state").distinct().collect()}
