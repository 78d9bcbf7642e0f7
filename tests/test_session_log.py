"""Sessions kept by a stream's aggregation and by panes of due times, against the batch form after every micro-batch."""

from pyspark.sql import functions as F

from sentryspark.config import Config
from sentryspark.functions.scalar import seconds
from sentryspark.operators import ingest
from sentryspark.schema import EVENTS, SESSIONS
from sentryspark.streaming import state
from sentryspark.streaming.session_log import SessionLog, session_folds
from tests.test_state import batches_of_events, stamp, stateful  # noqa: F401


def test_sessions_fold_and_fail_without_python_state(stateful, tmp_path):  # noqa: F811
    config, batches = Config(stale_session_seconds=1500), batches_of_events(2, 6)
    batches += [[(9998, "quiet", "node-01", "s98", "command", stamp(3600), None, None, "{}", stamp(3600))], [(9999, "last", "node-01", "s99", "command", stamp(9000), None, None, "{}", stamp(9000))]]
    log, plans = SessionLog(stateful, str(tmp_path / "log"), config), []
    seen = []

    def step(frame, number):
        log.add(frame, number)
        log.add(frame, number)  # a batch that is tried again
        seen.append(number)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        rows = [r for b in batches[: number + 1] for r in b]
        now = max(r[9] for r in rows if r[3])
        events = stateful.createDataFrame(rows, EVENTS)
        expected = ingest.closed_stale_sessions(ingest.folded_sessions(events), events, now, config).select(*SESSIONS.fieldNames())
        assert sorted(map(str, log.rows().select(*SESSIONS.fieldNames()).collect())) == sorted(map(str, expected.collect()))

    for rows in batches:
        stateful.createDataFrame(rows, EVENTS).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = session_folds(stateful.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), seconds(F.col("received_at")))
        stream.writeStream.outputMode("update").foreachBatch(step).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(150)
    assert seen == list(range(len(batches)))
    assert not any("TransformWithState" in x for x in plans)
    changes = stateful.read.parquet(str(tmp_path / "log" / "changes"))
    assert changes.where("change = 'time'").count() > 1 and changes.groupBy("session_id", "batch", "change").count().where("count > 1").isEmpty()
    assert changes.where("session_id = 's98' and change = 'time'").select("status", "batch").collect()[0][:] == ("failed", 7)
