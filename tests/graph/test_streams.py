import pandas as pd

from graphloom.streaming import events

SF = "/root/testdata/sf0.001"


def test_windows_and_transitions_equal_batch(spark, tmp_path):
    raw = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(3):
        raw.where(f"event_id % 3 = {i} AND user_id < 10").coalesce(1).orderBy("ts").write.mode("append").parquet(str(tmp_path / "in"))
    stream = events.read_events(spark, str(tmp_path / "in"), files_per_batch=3)
    for name, df, mode in (("moves", events.transitions(stream), "append"), ("counts", events.windowed_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    rows = raw.where("user_id < 10").toPandas().sort_values(["ts", "event_id"])
    want = []
    for user, own in rows.groupby("user_id"):
        last = "*"
        for e in own.itertuples():
            want.append((f"user{user}", last, e.event_type, e.event_id))
            last = e.event_type
    assert sorted(map(tuple, spark.table("moves").collect())) == sorted(want)
    counts = rows.groupby([rows.ts.dt.floor("h"), "event_type"]).size()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == sorted(counts.tolist())
    assert isinstance(counts, pd.Series)
