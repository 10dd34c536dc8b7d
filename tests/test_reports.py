"""News clusters, current reports, file statistics and checksums against plain versions."""

import glob
import os
import random

import pyarrow.parquet as pq

from strandline.operators import feed, fusion, reconcile
from strandline.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
HOUR = 3_600_000
NOW = 10**12


def test_news_clusters_equal_the_sequential_version(spark):
    rng = random.Random(5)
    words = ["river", "rises", "quake", "hits", "town", "bridge"]
    rows = [
        (i, " ".join(rng.choices(words, k=4)), "News digest:\n• one\n• two" if rng.random() < 0.2 else "plain", f"s{rng.randrange(6)}", rng.choice([0.4, 1.0]), NOW - rng.randrange(-HOUR, 26 * HOUR) if i % 40 else None)
        for i in range(150)
    ]
    leaders, members = {}, {}
    for i, title, said, _, _, at in sorted((r for r in rows if r[5] is not None and -HOUR // 12 <= NOW - r[5] <= 24 * HOUR), key=lambda r: (-r[5], r[0])):
        mine = set(title.split())
        for head, (its, digest, when) in members.items():
            if when - at <= 6 * HOUR and digest == (said != "plain") and len(mine & its) / max(len(mine), len(its)) >= 0.58:
                leaders[i] = head
                break
        else:
            members[i], leaders[i] = (mine, said != "plain", at), i
    frame = spark.createDataFrame(rows, "doc_id long, title string, description string, source string, weight double, published_ms long")
    clusters = fusion.news_clusters(frame, NOW)
    assert {r.doc_id: r.leader for r in clusters.collect()} == leaders
    by = {r[0]: r for r in rows}
    want = []
    for head in sorted(members, key=lambda h: (-by[h][5], h))[:9]:
        own = [by[i] for i in leaders if leaders[i] == head]
        want.append((head, max(own, key=lambda r: (r[4], r[5], -r[0]))[0], len(own), len({r[3] for r in own})))
    assert [tuple(r) for r in fusion.news_primaries(frame, clusters, 9).collect()] == want


def test_current_reports(spark):
    schema = "id long, occurred_ms long, urls array<string>, supersedes array<string>, nws boolean, nws_only boolean, withdrawn boolean, expires_ms long, u string"
    rows = [
        (1, 10, ["https://w/a#x"], None, True, True, None, None, "extra"),  # superseded by 2
        (2, 10, ["https://w/b"], ["https://w/a", "https://w/c"], True, True, False, 200, None),
        (3, 11, ["https://w/a"], None, True, True, False, None, None),  # newer than what supersedes its URL
        (4, 5, ["https://w/a"], None, True, False, False, 20, None),  # other evidence too
        (5, 5, ["https://w/d"], None, True, True, False, 100, None),  # expired
        (6, 5, None, None, None, None, True, None, None),  # withdrawn
        (7, 5, ["https://w/z", "https://w/c"], ["https://w/b"], True, True, False, None, None),  # superseded by 2; too old to retire it
        (8, 5, ["https://w/e"], None, True, True, False, None, None),  # only another provider names it
        (9, 50, None, ["https://w/e"], False, False, None, None, None),
        (10, None, ["https://w/a"], ["https://w/e"], True, True, None, None, None),
    ]
    got = feed.current_reports(spark.createDataFrame(rows, schema), 100)
    assert sorted(r.id for r in got.collect()) == [2, 3, 4, 8, 9, 10]
    assert feed.current_reports(spark.createDataFrame([], schema), 100).count() == 0


def test_file_stats(spark):
    got = {r.file_name: (r.rows, r.bytes) for r in registry.QUERIES["agg18_file_stats"](spark, SF).collect()}
    path = f"{SF}/orders.parquet"
    files = glob.glob(f"{path}/*.parquet") if os.path.isdir(path) else [path]
    assert got == {os.path.basename(f): (pq.read_metadata(f).num_rows, os.path.getsize(f)) for f in files}


def test_checksum_counts_repeats_and_ignores_order(spark):
    of = lambda rows: reconcile.snapshot_checksum(spark.createDataFrame(rows, "b string, a long")).first()
    assert of([("x", 1), (None, 2), ("x", 1)]) == of([("x", 1), ("x", 1), (None, 2)])
    assert len({of(r).checksum for r in ([], [("x", 1)], [("x", 1), ("x", 1)], [("x", None)])}) == 4
