"""The run log as a stream: each id once for ever, state that doesn't grow, retries that change nothing."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from mentionforge.streaming import link_stream as LS

SCHEMA = "query_id long, ts timestamp, api_token string"
BEGIN = dt.datetime(2024, 1, 1)


def feed(spark, folder, batches):
    """One file a batch, in the order of their times."""
    for n, rows in enumerate(batches):
        spark.createDataFrame([(i, BEGIN + dt.timedelta(hours=h), "t") for i, h in rows], SCHEMA).coalesce(1).write.parquet(f"{folder}/{n}")
        for name in os.listdir(f"{folder}/{n}"):
            os.utime(f"{folder}/{n}/{name}", (1_700_000_000 + n, 1_700_000_000 + n))


def start(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    return LS.run_log_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", "1 hour")


def logged(spark, tmp_path):
    return sorted(((r.query_id if r.query_id is not None else -1, r.api_token) for r in spark.read.schema(SCHEMA).json(f"{tmp_path}/out").collect()))


@pytest.mark.parametrize("number", [0, 1, 2, 3, 8, 9, 10, 26, 27, 80, 250])
def test_runs_cover_all_batches_before(number, monkeypatch):
    monkeypatch.setattr(LS, "FAN", 3)
    runs = LS.seen_runs(number)
    assert [b for first, size in runs for b in range(first, first + size)] == list(range(number)) and len(runs) <= 12
    # each is there: written by its batch or merged at its end
    assert all(size == 1 or (first, size) in LS._merged(first + size) for first, size in runs)


def test_ids_count_once_though_state_forgets_them(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LS, "FAN", 3)
    # every two hours four new ids, one of them twice; id 0 and a null id return in every batch, and each id after six hours
    batches = [[(0, 2 * n), (None, 2 * n), *((4 * n + k, 2 * n) for k in (0, 1, 2, 3)), (4 * n + 1, 2 * n), *((4 * n - 12 + k, 2 * n) for k in (0, 1) if n >= 3)] for n in range(12)]
    feed(spark, f"{tmp_path}/in", batches)
    query = start(spark, tmp_path)
    query.awaitTermination()
    assert logged(spark, tmp_path) == [(-1, "[REDACTED]"), *((i, "[REDACTED]") for i in range(48))]
    held = [p["stateOperators"][0]["numRowsTotal"] for p in (json.loads(x.json) for x in query.recentProgress) if p["stateOperators"]]
    assert len(held) >= 12 and max(held) <= 2 * 9  # the ids of two batches at most
    # merged runs only, but for those that the last batch was still to see
    assert len(os.listdir(f"{tmp_path}/check-ids")) <= 3 * 3


def test_a_killed_batch_is_written_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(LS, "FAN", 2)
    feed(spark, f"{tmp_path}/in", [[(n, 3 * n), (n - 1, 3 * n), (0, 3 * n)] for n in range(1, 6)])
    real, calls = LS.redact, []

    def killed_after(df):  # the rows of the third batch are written, its ids aren't
        calls.append(1)
        if len(calls) == 3:
            real(df).write.json(f"{tmp_path}/out/batch=2")
            raise RuntimeError("killed")
        return real(df)

    with monkeypatch.context() as m:
        m.setattr(LS, "redact", killed_after)
        with pytest.raises(Exception, match="killed"):
            start(spark, tmp_path).awaitTermination()
    start(spark, tmp_path).awaitTermination()
    assert [i for i, _ in logged(spark, tmp_path)] == [0, 1, 2, 3, 4, 5]


def test_an_empty_stream_logs_nothing(spark, tmp_path):
    feed(spark, f"{tmp_path}/in", [[]])
    start(spark, tmp_path).awaitTermination()
    assert not os.path.exists(f"{tmp_path}/out") or logged(spark, tmp_path) == []
