import os

from pyspark.sql import functions as F

from quarry.sources import io as IO
from quarry.streaming import file_stream, grouped_rate_stream
from oracle import SF_SMALL


def test_csv_roundtrip_with_schema_and_nan(spark, tmp_path):
    p = str(tmp_path / "l.csv")
    with open(p, "w") as fh:
        fh.write("id,price,score\n1,\"$1,200.00\",NaN\n2,,3.5\n")
    df = IO.read_csv(spark, p, "id long, price string, score double")
    rows = df.orderBy("id").collect()
    assert rows[0].score is None and rows[1].score == 3.5
    out = str(tmp_path / "out")
    IO.replace_table(df, out)
    assert IO.shape(IO.load_with_fallback(spark, None, [str(tmp_path / "missing"), out])).first()["rows"] == 2
    assert [r.id for r in IO.tail(df, "id", 1).collect()] == [2]


def test_grouped_rate_stream(spark, tmp_path):
    schema = spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).schema
    s = file_stream(spark, SF_SMALL, schema, glob="events.parquet")
    s = s.withColumn("big", (F.col("value") > 100).cast("int"))
    q = (grouped_rate_stream(s, ["event_type"], "big").writeStream.outputMode("complete").format("memory")
         .queryName("rates").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT SUM(total) FROM rates").first()[0]
    assert got == spark.read.parquet(os.path.join(SF_SMALL, "events.parquet")).count()
