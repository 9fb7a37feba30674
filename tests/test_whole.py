"""Queries over whole tables, against plain restatements of their rules."""

import pandas as pd

from basalt.plans import catalogue
from basalt.sources import readers


def test_schedules_of_all_users(spark):
    sf = "/root/testdata/sf0.01"  # the smallest tables have 15 users
    e = pd.read_parquet(f"{sf}/events.parquet").sort_values("event_id")
    days = {}
    for user, ts, kind in zip(e["user_id"], e["ts"], e["event_type"], strict=True):
        days.setdefault(str(user), {}).setdefault(f"{ts:%Y-%m-%d}", []).append(kind)
    want = {name: "\n".join(f"{d}: {', '.join(v)}" for d, v in sorted(of.items())) for name, of in days.items()}
    got = {r["name"]: r["schedule"] for r in catalogue.QUERIES["q_schedule_lines"](spark, sf).collect()}
    assert got == want and any(int(name) >= 40 for name in got)


def test_best_run_of_all_sessions(spark, small):
    e = pd.read_parquet(f"{small}/events.parquet")
    n, run = max((g["user_id"].nunique(), kind) for kind, g in e.groupby("event_type"))
    assert [tuple(r) for r in catalogue.QUERIES["q_best_run"](spark, small).collect()] == [(run, n)]


def test_tree_scan_of_all_levels(spark, small):
    parts = set(pd.read_parquet(f"{small}/part.parquet")["p_partkey"])
    got = {r["node"]: r["depth"] for r in catalogue.QUERIES["q_tree_scan"](spark, small).collect()}
    assert got == {int(p): int(p).bit_length() - 1 for p in parts if p and all(p >> k in parts for k in range(int(p).bit_length()))}
    assert max(got.values()) > 6


def test_tree_deeper_than_32_levels(spark):
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 36)], "id long, parent_id long").coalesce(1)
    assert sorted(tuple(r) for r in readers.tree(spark, chain, 1).collect()) == [(k, k - 1) for k in range(1, 36)]
