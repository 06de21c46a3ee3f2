"""Versioned tables under kills and replays, campaigns that go on, lag features of a stream."""

from __future__ import annotations

import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomstat.operators import ranking
from loomstat.operators.campaign import Campaign, Streams
from loomstat.streaming.lags import lag_stream
from loomstat.streaming.versions import Conflict, VersionedTable


class Killed(Exception):
    pass


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def kill(monkeypatch):
    """The next publication dies between the rows and their manifest."""
    publish = VersionedTable._publish

    def die(self, version):
        monkeypatch.setattr(VersionedTable, "_publish", publish)
        raise Killed

    return lambda: monkeypatch.setattr(VersionedTable, "_publish", die)


def test_upserts_survive_kills_and_replays(spark, tmp_path, kill):
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    part = lambda *r: spark.createDataFrame(list(r), "k long, at int, v string")
    with pytest.raises(ValueError):
        t.read()
    assert t.latest() is None
    t.upsert(part((1, 1, "a"), (2, 1, "b"), (1, 2, "c")), ["k"], ["at"], ("s", 0))
    assert rows(t.read()) == [(1, 2, "c"), (2, 1, "b")]
    kill()
    with pytest.raises(Killed):
        t.upsert(part((2, 5, "z"), (3, 1, "n")), ["k"], ["at"], ("s", 1))
    assert rows(t.read()) == [(1, 2, "c"), (2, 1, "b")] and t.latest().number == 0
    for _ in range(2):  # the batch again, and once more
        v = t.upsert(part((2, 5, "z"), (3, 1, "n")), ["k"], ["at"], ("s", 1))
    assert v.number == 1 and v.tokens == {"s": 1} and rows(t.read()) == [(1, 2, "c"), (2, 5, "z"), (3, 1, "n")]
    t.upsert(part((3, 0, "old")), ["k"], ["at"], ("other", 0))
    assert rows(t.read())[2] == (3, 1, "n")
    assert rows(t.read(v)) == rows(t.read())  # an earlier version stays readable
    with pytest.raises(Conflict):
        t.commit(part((9, 9, "x")), v)  # another writer has gone on from v
    assert t.vacuum() >= 2 and rows(t.read())[0] == (1, 2, "c") and t.vacuum() == 0


def test_a_stream_is_applied_once(spark, tmp_path, kill):
    source = tmp_path / "in"
    source.mkdir()
    rng = np.random.default_rng(0)
    whole = []
    for i in range(3):
        pdf = pd.DataFrame({"k": rng.integers(0, 6, 20), "at": np.arange(20) + 20 * i, "v": rng.random(20)})
        pdf.to_parquet(source / f"{i}.parquet")
        whole.append(pdf)
    t = VersionedTable(spark, f"file://{tmp_path}/t")
    stream = lambda: spark.readStream.schema("k long, at long, v double").option("maxFilesPerTrigger", 1).parquet(str(source))
    kill()
    with pytest.raises(Exception, match="Killed"):
        t.upsert_stream(stream(), "in", ["k"], ["at"], str(tmp_path / "check")).awaitTermination()
    t.upsert_stream(stream(), "in", ["k"], ["at"], str(tmp_path / "check")).awaitTermination()
    last = pd.concat(whole).sort_values("at").groupby("k").tail(1)
    assert rows(t.read()) == sorted((tuple(r) for r in last.itertuples(index=False)), key=str)
    number = t.latest().number
    shutil.rmtree(tmp_path / "check")  # the stream forgets, the table does not
    t.upsert_stream(stream(), "in", ["k"], ["at"], str(tmp_path / "check")).awaitTermination()
    assert t.latest().number == number == 2


@pytest.fixture(scope="module")
def candidates(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2)).round(3)
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(60), "a": x[:, 0], "b": x[:, 1]})).cache(), 2 * x[:, 0] - x[:, 1]


def run_campaign(spark, folder, candidates, kills):
    df, truth = candidates
    results = lambda made: spark.createDataFrame([(r["round"], r["id"], float(truth[r["id"]])) for r in made], "round int, id long, y double")
    again = lambda: Campaign(spark, f"file://{folder}", df, ["a", "b"])  # each step as after a restart
    first = spark.createDataFrame([(i, float(truth[i])) for i in range(0, 16, 2)], "id long, y double")

    def step(f):
        kills()
        try:
            return f()
        except Killed:
            return f()

    step(lambda: again().start(first, seed=3, folds=2))
    for turn in range(2):
        made = step(lambda: again().propose(2)).collect()
        assert [(r["round"], r["place"]) for r in made] == [(turn + 1, 1), (turn + 1, 2)] and not {r["id"] for r in made} & set(range(0, 16, 2))
        with pytest.raises(ValueError, match="pending"):
            again().propose(2)
        step(lambda: again().apply(results(made), ("results", turn)))
        again().apply(results(made), ("results", turn))  # results that come twice
    return again()


def test_campaign_goes_on_after_kills(spark, tmp_path, candidates, kill):
    calm = run_campaign(spark, tmp_path / "calm", candidates, lambda: None)
    torn = run_campaign(spark, tmp_path / "torn", candidates, kill)
    assert rows(calm.table.read()) == rows(torn.table.read()) and len(rows(calm.table.read())) == 12
    assert calm.table.latest().state == torn.table.latest().state and calm.table.latest().number == 4
    progress = calm.progress().orderBy("round").toPandas()
    assert progress["n"].tolist() == [8, 2, 2] and progress["best_so_far"].is_monotonic_increasing
    extra = spark.createDataFrame([(3, 59, 1.5), (3, 58, None)], "round int, id long, y double")
    calm.apply(extra)
    assert (3, 0, 59, "observed", 1.5) in rows(calm.table.read())
    with pytest.raises(ValueError):
        calm.apply(extra.where("y IS NULL"))
    with pytest.raises(ValueError, match="left"):
        calm.propose(1000)
    with pytest.raises(ValueError):
        Campaign(spark, f"file://{tmp_path}/none", candidates[0], ["a", "b"]).propose(1)


def test_four_streams():
    s = Streams(7)
    drawn = [s.number(n) for n in ("folds", "draws", "fantasies", "scales")]
    assert len(set(drawn)) == 4
    back = Streams(positions=s.positions())
    assert back.number("draws") == s.number("draws")
    assert Streams(7).number("scales") == drawn[3]  # a stream does not depend on the others' draws


def test_lags_of_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rng = np.random.default_rng(3)
    begin = pd.Timestamp("2024-01-01")
    whole = pd.DataFrame({"id": np.arange(90), "ts": [begin + pd.Timedelta(minutes=int(m)) for m in range(90)], "user": rng.integers(0, 3, 90), "value": rng.random(90).round(3), "n": rng.integers(0, 9, 90)})
    shuffled = whole.iloc[np.argsort(np.arange(90) + rng.uniform(0, 6, 90))]  # out of order by less than the delay
    for i in range(3):
        part = shuffled.iloc[30 * i : 30 * i + 30]
        if i == 2:  # far behind the watermark
            part = pd.concat([part, pd.DataFrame({"id": [999], "ts": [begin + pd.Timedelta(minutes=2)], "user": [1], "value": [0.5], "n": [1]})])
        part.assign(ts=part["ts"].astype("datetime64[us]")).to_parquet(source / f"{i}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("id long, ts timestamp, user long, value double, n long").option("maxFilesPerTrigger", 1).parquet(str(source))
        out = lag_stream(stream, "user", ["ts", "id"], ["value", "n"], 2, 4, "10 minutes")
        out.writeStream.format("memory").queryName("lagged").outputMode("append").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("lagged")
    table = ranking.lag_features(spark.createDataFrame(whole), "user", ["ts", "id"], ["value", "n"], 2, 4)
    passed = whole["ts"].max() - pd.Timedelta(minutes=10)
    want = table.where(F.col("ts") < F.lit(passed.to_pydatetime()))
    assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(map(tuple, want.select(*sorted(got.columns)).collect())) and got.count() > 60
    with pytest.raises(ValueError):
        lag_stream(stream, "user", ["value"], ["n"], 1, 2, "1 minute")
