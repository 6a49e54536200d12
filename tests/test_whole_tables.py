"""Queries take whole tables."""

import re

from tickloom.plans.catalogue import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


def test_no_filter_by_modulo():
    assert not [n for n, sql in ORACLE.items() if re.search(r"WHERE\s+\w+ % \d+ = 0", sql)]


def test_every_event_goes_in(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    for name in ("event_id_sha1", "asof_events_to_features", "triple_barrier"):
        assert events * 0.9 < QUERIES[name](spark, SF).count() <= events


def test_nonoverlap_against_a_loop(spark):
    from datetime import timedelta

    free, want = {}, []
    for e in sorted(spark.read.parquet(f"{SF}/events.parquet").collect(), key=lambda e: (e.ts, e.event_id)):
        if e.event_type not in free or e.ts >= free[e.event_type]:
            free[e.event_type] = e.ts + timedelta(hours=2 + e.event_id % 5)
            want.append((e.event_type, e.event_id, e.ts, free[e.event_type]))
    found = QUERIES["nonoverlap_trades"](spark, SF).select("symbol", "event_id", "entry_ts", "exit_ts").collect()
    assert sorted(map(tuple, found)) == sorted(want)
