"""Memory of the stream that keeps turns in state."""

from sessionmill.operators import turns
from sessionmill.schemas import EVENT
from sessionmill.sources import fixtures as fx
from sessionmill.streaming import stream

SF = "/root/testdata/sf0.001"


def test_stores_share_one_bound_and_a_batch_is_not_held_in_memory(spark, tmp_path, monkeypatch):
    build, seen = turns.build_turns, []

    def look(events, *args, **kwargs):
        conf = events.sparkSession.conf
        seen.append((conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", None), conf.get("spark.sql.streaming.stateStore.unloadOnCommit"), events.storageLevel.useMemory))
        return build(events, *args, **kwargs)

    monkeypatch.setattr(turns, "build_turns", look)
    before = {name: spark.conf.get(name, None) for name in stream.STATE}
    fx.events(spark, SF).limit(50).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(EVENT).parquet(str(tmp_path / "in"))
    stream.stateful_turns(source, str(tmp_path / "out"), str(tmp_path / "at"), fx.rates(spark), "60 days").awaitTermination()
    assert seen == [("true", "true", False)]
    assert {name: spark.conf.get(name, None) for name in stream.STATE} == before
    assert stream.current_turns(spark, str(tmp_path / "out")).count()
