"""Readers by role, sinks, and the streaming extension against its batch form."""

from pyspark.sql import functions as F

from terraloom.sources import readers
from terraloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_roles_and_csv_sets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Company Name,Notice Date,Employees\nFoo Ltd,2024-01-02,10\n,2024-01-03,\n")
    (tmp_path / "b.csv").write_text("Employer,Amount\nBar,7\n")
    got = readers.by_roles(readers.read_csv_set(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"]))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == ["('Bar', None, '7')", "('Foo Ltd', '2024-01-02', '10')", "(None, '2024-01-03', None)"]


def test_json_and_markdown(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    (tmp_path / "y.json").write_text('[{"a": 1},\n {"a": 3}]')
    (tmp_path / "z.md").write_text("# t\n| Market | n |\n|---|---|\n| Steel | 1 |\n| Palm oil | 2 |\n")
    assert sorted(r.a for r in readers.read_json_lines(spark, f"file://{tmp_path}/x.jsonl", "a int").collect()) == [1, 2]
    assert sorted(r.a for r in readers.read_json_array(spark, f"file://{tmp_path}/y.json", "a int").collect()) == [1, 3]
    assert [r.name for r in readers.read_markdown_names(spark, f"file://{tmp_path}/z.md").collect()] == ["Steel", "Palm oil"]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("m1", 1.5), ("m2", 2.0)], "market string, score double")
    readers.write_documents(df, f"file://{tmp_path}/docs", "market")
    back = spark.read.text(f"file://{tmp_path}/docs").select(F.from_json("value", "market string, score double").alias("x")).select("x.*")
    assert sorted(map(tuple, back.collect())) == [("m1", 1.5), ("m2", 2.0)]
    readers.write_csv(df, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 2


def test_streams_equal_their_batch_form(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").limit(300)
    batch.unionByName(batch).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = events.distinct_events(events.read_events(spark, f"file://{tmp_path}/in", batch.schema), late="400 days")
    q = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 300 and spark.table("once").select("event_id").distinct().count() == 300
    counts = events.windowed_counts(events.read_events(spark, f"file://{tmp_path}/in", batch.schema))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 600
