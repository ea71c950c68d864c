"""The explanation queries have rows to explain."""

from ledgerlens.workload.learning import alerts


def test_there_are_alerts_at_the_default_threshold(spark):
    _, flagged, _ = alerts(spark, "/root/testdata/sf0.01")
    assert flagged.count() > 0
