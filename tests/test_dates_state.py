"""Date formats by vote with a quarantine, and versioned state that is read only as a whole."""

import os
import tempfile

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tillcast.sources import dates as DT
from tillcast.sources import files as FS
from tillcast.sources import state as ST


def write(folder, name, lines):
    with open(f"{folder}/{name}", "w") as f:
        f.write("store,date,qty_sold,revenue,disc_value\n" + "".join(f"{x}\n" for x in lines))


def test_two_files_of_mixed_formats(spark):
    d, q = tempfile.mkdtemp(prefix="tillcast-dates-"), tempfile.mkdtemp(prefix="tillcast-rejects-") + "/r"
    write(d, "us.csv", ["1,03/25/2020,1,10,0", "1,04/05/2020,1,10,0", "2,2020-01-02,2,5,0", "3,25/03/2020,1,1,0", "4,,1,1,0", "5,04/06/2020,one,1,0"])
    write(d, "eu.csv", ["1,25.03.2020,1,10,0", "2,5.4.2020,1,20,", "2,25/03/2020,1,20,0", "3,04/05/2020,1,20,0", "4,13/13/2020,1,1,0", "5,02.01.2020 10:30:00,1,x,0"])
    rows = sorted((r["store"], str(r["date"]), r["revenue"]) for r in FS.read_sales(spark, d, rejects=q).collect())
    assert rows == sorted([("1", "2020-03-25", 10.0), ("1", "2020-04-05", 10.0), ("2", "2020-01-02", 5.0),
                           ("1", "2020-03-25", 10.0), ("2", "2020-04-05", 20.0), ("2", "2020-03-25", 20.0), ("3", "2020-05-04", 20.0)])
    bad = sorted((os.path.basename(r["file"]), r["store"], r["date"], r["reason"]) for r in spark.read.option("header", True).csv(q).collect())
    assert bad == [("eu.csv", "4", "13/13/2020", "date"), ("eu.csv", "5", "02.01.2020 10:30:00", "revenue"), ("us.csv", "3", "25/03/2020", "date"),
                   ("us.csv", "4", None, "date"), ("us.csv", "5", "04/06/2020", "qty_sold")]
    assert FS.read_sales(spark, d).count() == 12  # without a quarantine nothing is left out
    assert FS.read_sales(spark, d).where("date IS NULL").count() == 3


@pytest.mark.parametrize("texts, want", [
    (["2020-02-29", "2021-02-29", " 2020-03-01T05:00:00Z "], ["2020-02-29", None, "2020-03-01"]), (["20200131", "20201301"], ["2020-01-31", None]),
    (["1/2/2020", "13/2/2020", "14/2/2020"], ["2020-02-01", "2020-02-13", "2020-02-14"]), (["1/2/2020"], ["2020-01-02"]), (["5 Mar 2020", "Mar 6, 2020", "x", ""], ["2020-03-05", "2020-03-06", None, None]),
    (["1-2-20", "1.2.20"], [None, None]), ([None], [None])])
def test_formats(spark, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    got = [r["d"] for r in FS.parse_dates(df, "d").orderBy("i").collect()]
    assert [None if x is None else str(x) for x in got] == want
    good, bad = DT.parse_with_rejects(df, "d")
    assert good.count() == sum(w is not None for w in want) and bad.count() == sum(w is None for w in want)
    assert {r["reason"] for r in bad.collect()} == {"missing" if not t else "unreadable" for t, w in zip(texts, want) if w is None}


def test_state_round_trip_and_half_written_versions(spark):
    root = tempfile.mkdtemp(prefix="tillcast-state-") + "/s"
    with pytest.raises(FileNotFoundError):
        ST.read_state(spark, root)
    one, two = spark.range(3).withColumn("t", F.lit("a")), spark.createDataFrame([(None, [1.0])], "x int, y array<double>")
    model = VectorAssembler(inputCols=["id"], outputCol="v")
    assert ST.write_state(spark, root, {"one": one, "two": two}, {"m": model}, {"range": ["2020-01-01", "2020-12-31"], "scale": 1.5}) == 1
    first = ST.read_state(spark, root)
    assert ST.write_state(spark, root, {"one": spark.range(5)}) == 2
    # what a writer leaves that dies before its manifest is complete
    os.makedirs(f"{root}/manifests/version-000000003")
    spark.range(9).write.parquet(f"{root}/data-dead/tables/one")
    newest = ST.read_state(spark, root)
    assert newest.version == 2 and newest.table("one").count() == 5 and not newest.models
    # the version opened before still reads what it named
    assert first.version == 1 and first.table("one").dtypes == one.dtypes and sorted(first.table("one").collect()) == sorted(one.collect())
    assert first.table("two").collect() == two.collect() and first.settings == {"range": ["2020-01-01", "2020-12-31"], "scale": 1.5}
    assert first.model("m").transform(spark.range(1)).first()["v"].toArray().tolist() == [0.0]
    first.verify()
    spark.range(1).withColumn("t", F.lit("b")).write.mode("append").parquet(first.tables["one"]["path"])
    with pytest.raises(ValueError):
        first.verify()
    assert ST.read_state(spark, root, 1).version == 1
    with pytest.raises(FileNotFoundError):
        ST.read_state(spark, root, 3)
    assert ST.write_state(spark, root, {"one": spark.range(6)}) == 4  # the taken number is passed over
