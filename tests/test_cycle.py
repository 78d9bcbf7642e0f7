"""What a cycle goes through once."""

from sentryspark.plans import catalogue, screens
from tests.conftest import SMALL


def test_a_feed_is_written_from_stored_rows(spark, tmp_path, monkeypatch):
    plans = []
    monkeypatch.setattr(screens.feed, "write_feed", lambda flat, alerts, *_: plans.extend(x._jdf.queryExecution().analyzed().toString() for x in (flat, alerts)))
    screens.cycle(catalogue.Tables(spark, SMALL), catalogue.SINCE, catalogue.NOW, str(tmp_path))
    assert len(plans) == 2 and not any("Aggregate" in x or "Join" in x for x in plans)
