"""Queries that answer for every event, not for a sample by event_id."""

from ledgerlens.plans import registry
from ledgerlens.plans.views import evt


def test_history_of_every_event(spark, sf_dir):
    got = [r["probe_id"] for r in registry.queries()["history_as_of_all"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r["event_id"] for r in evt(spark, sf_dir).collect())
