from pyspark.sql import functions as F

from quillspan.plans import dataset
from quillspan.plans.contracts import SOURCES


def test_raw_cells_are_whole_unless_summary(spark):
    columns = list(SOURCES["recommended"].columns)
    long = "MP/MP62/24/1 - " + "x" * 400
    rows = spark.createDataFrame([(2, "malformed", *[long] * len(columns)), (3, "summary", *[long] * len(columns))], ", ".join(["source_row int", "category string", *[f"{c}__raw string" for c in columns]]))
    rows = rows.withColumn("reason", F.lit(None).cast("string")).withColumn("key__p", F.struct(F.lit("e").alias("error")))
    whole = dataset._audit({"recommended": rows}, "malformed").first().row_values
    assert whole == "; ".join(f"{c}={long}" for c in columns)
    assert dataset._audit({"recommended": rows}, "summary").first().row_values == "; ".join(f"{c}={long[:50]}" for c in columns)
