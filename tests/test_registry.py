"""The registry as keyed streaming state, against plain Python and the engine."""

import random

import pytest

from driftgrove.engine import Engine
from driftgrove.streaming import registry


def send(spark, path, rows):
    spark.createDataFrame(rows, "source_id string, batch_index long, more string").coalesce(1).write.mode("append").parquet(path)


def kept(batches, window):
    """Plain: source -> (last batch, how many) within the window."""
    last = len(batches) - 1
    out = {}
    for i, b in enumerate(batches):
        if window is None or i > last - window:
            for s in set(b):
                out[s] = (i, out.get(s, (0, 0))[1] + 1)
    return out


def run(spark, tmp_path, window):
    at = f"file://{tmp_path}"
    q = registry.start(registry.source_stream(spark, f"{at}/in"), f"{at}/changes", f"{at}/check", window)
    q.awaitTermination()
    assert q.exception() is None
    return {r["source_id"]: (r["last_batch"], r["batches"]) for r in registry.registry(spark, f"{at}/changes").collect()}


@pytest.mark.parametrize("window", [None, 1, 3])
def test_registry_by_stream_and_restart(spark, tmp_path, window):
    rng = random.Random(window or 7)
    batches = [[f"s{rng.randrange(12)}" for _ in range(rng.randrange(1, 9))] for _ in range(7)]
    batches[1] = ["s0"]  # leaves the window and comes again
    done = 0
    for stop in (4, 7):
        for i in range(done, stop):
            send(spark, f"file://{tmp_path}/in", [(s, i, "x") for s in batches[i] + batches[i][:2]] + [(None, i, None)])
        done = stop
        assert run(spark, tmp_path, window) == kept(batches[:done], window)


def test_late_rows_and_batches_in_parts(spark, tmp_path):
    at = f"file://{tmp_path}/in"
    for rows in ([("a", 0)], [("b", 0)], [("a", 1)], [("c", 0)], [("b", 1)]):
        send(spark, at, [(*r, None) for r in rows])
    # c is late; a batch in two files is one batch
    assert run(spark, tmp_path, 2) == {"a": (1, 2), "b": (1, 2)}
    assert [tuple(r) for r in registry.late(spark, f"file://{tmp_path}/changes").collect()] == [("c", 0)]


def test_stream_keeps_what_the_engine_keeps(spark, make_sources, tmp_path):
    e = Engine(spark)
    batches = [["a", "b", "c"], ["a", "d"], ["d", "e"], ["b", "e"]]
    for i, b in enumerate(batches):
        send(spark, f"file://{tmp_path}/in", [(s, i, None) for s in b])
        e.register(make_sources({s: "x" for s in b}), i)
    assert run(spark, tmp_path, None) == {r["source_id"]: (r["last_batch"], r["batches"]) for r in e.source_batches().collect()}


def test_empty_window_is_refused(spark):
    with pytest.raises(ValueError):
        registry.changes(spark.createDataFrame([("a", 0)], "source_id string, batch_index long"), 0)
