"""Queries that once ran on id subsets, against brute force in plain Python over every row of small tables."""

import os
from collections import defaultdict

import pyarrow.parquet as pq
import pytest

from strandline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def ran(spark, name, sf=SF):
    return registry.QUERIES[name](spark, sf).collect()


def test_identity_lookup_takes_every_order(spark):
    events, lines = defaultdict(set), defaultdict(list)
    for r in rows("lineitem"):
        events[r["l_suppkey"], r["l_partkey"] % 300].add(r["l_partkey"] % 100)
        lines[r["l_orderkey"]].append(r)
    want = {o: {e for r in ls for e in events[r["l_suppkey"], r["l_partkey"] % 300]} for o, ls in lines.items()}
    assert {r.candidate: set(r.stored) for r in ran(spark, "jn01_identity_lookup")} == want


def test_fallback_and_controls_take_every_error(spark):
    events = rows("events")
    asked, bad = defaultdict(set), {e["user_id"] for e in events if e["event_type"] == "error"}
    for e in events:
        if e["event_type"] == "error":
            asked[e["user_id"]].add(e["event_id"] % 5)
    near = [(k % 5, k // 5 + 3) for k in (n["n_nationkey"] for n in rows("nation")) if k < 20]
    want = {u: {str(b) for a, b in near if a in regions and b not in regions} for u, regions in asked.items()}
    assert {r.request: set(r.fallback.split(",")) for r in ran(spark, "str15_fallback")} == {u: w for u, w in want.items() if w}
    assert {r.event_id for r in ran(spark, "rsk04_control_samples")} == {e["event_id"] for e in events if e["event_type"] == "view" and e["user_id"] not in bad}


def test_provider_health_counts_every_event(spark):
    feeds, errors = defaultdict(int), defaultdict(int)
    for e in rows("events"):
        feeds[e["user_id"]] += 1
        errors[e["user_id"]] += e["event_type"] == "error"
    assert {r.user_id: (r.feeds, r.errors) for r in ran(spark, "str14_provider_health")} == {u: (n, errors[u]) for u, n in feeds.items()}


def test_every_order_has_its_direction_and_loss(spark):
    orders = rows("orders")
    lined = {r["l_orderkey"] for r in rows("lineitem")}
    assert {r.o_orderkey for r in ran(spark, "rsk02_coin_direction")} == {o["o_orderkey"] for o in orders} & lined
    so_far, want = defaultdict(int), {}
    for o in sorted(orders, key=lambda o: o["o_orderkey"]):
        so_far[o["o_orderpriority"]] += int(o["o_totalprice"])
        want[o["o_orderkey"]] = so_far[o["o_orderpriority"]]
    assert {r.o_orderkey: r.so_far for r in ran(spark, "agg13_daily_losses")} == want


def test_every_customer_is_matched(spark):
    customers, parts = rows("customer"), rows("part")
    want = set()
    for c in customers:
        hits = sorted((p["p_name"], p["p_partkey"]) for p in parts if p["p_partkey"] % 1000 == c["c_custkey"] % 1000)
        want |= {(c["c_custkey"], key) for _, key in hits[:5]}
    assert {(r.entity, r.hit) for r in ran(spark, "set09_match_edges")} == want
    pairs = {(s["s_suppkey"], c["c_custkey"]) for s in rows("supplier") for c in customers if s["s_nationkey"] == c["c_nationkey"]}
    assert {(r.s_suppkey, r.c_custkey) for r in ran(spark, "sca11_format_distance")} == pairs


def test_identity_queries_take_every_line(spark):
    lines = rows("lineitem")
    root, met, links = {}, defaultdict(set), defaultdict(set)

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in lines:
        root[find(("s", r["l_partkey"]))] = find(("c", r["l_suppkey"] * 7 + r["l_partkey"] % 31))
        met[r["l_orderkey"] % 4000].add(r["l_partkey"] % 1500)
        k = r["l_suppkey"] % 9
        links[r["l_orderkey"] % 500].add((f"news:{k}" if k == 0 else f"s{r['l_suppkey'] % 2}", r["l_partkey"] % 700))
    counts = defaultdict(lambda: [0, 0])
    for node in list(root):
        counts[find(node)][node[0] == "c"] += 1
    assert sorted([r.stored, r.current] for r in ran(spark, "idr04_components")) == sorted(counts.values())
    verdicts = {r.candidate: r.verdict for r in ran(spark, "idr01_conflicts")}
    assert set(verdicts) == set(met) and all((v == "multiple") == (len(met[c]) > 1) for c, v in verdicts.items())
    assert {r.event_id: r.identities for r in ran(spark, "idr02_split_plan")} == {e: len(i) for e, i in links.items()}


def test_history_takes_every_line(spark):
    keys, titles = defaultdict(set), defaultdict(set)
    title = {o["o_orderkey"]: o["o_orderstatus"] for o in rows("orders")}
    for r in rows("lineitem"):
        keys[r["l_orderkey"]].add(r["l_suppkey"] % 6)
    seen = {(o % 800, k) for o, ks in keys.items() for k in ks}
    for o, ks in keys.items():
        if len(ks) == 1:
            titles[o % 800, *ks].add(title[o])
    status = lambda x: "missing_history" if x not in seen else "composite_context_only" if x not in titles else "multiple_singleton_titles" if len(titles[x]) > 1 else "singleton_context_available"
    assert {(r.event_id, r.key): r.status for r in ran(spark, "idr05_history")} == {(e, k): status((e, k)) for e in range(800) for k in range(6)}


@pytest.mark.parametrize("last", [8999, 9001, 20000])
def test_client_sync_sees_every_later_event(spark, tmp_path, last):
    table = pq.read_table(f"{SF}/events.parquet").slice(0, 1)
    at = table.schema.get_field_index("event_id")
    pq.write_table(table.set_column(at, "event_id", [[last]]), tmp_path / "events.parquet", use_deprecated_int96_timestamps=False)
    assert [r.sequence for r in ran(spark, "str07_client_sync", str(tmp_path))] == [last]
