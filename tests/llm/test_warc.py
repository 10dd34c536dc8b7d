import gzip
import hashlib
import io
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.llm import warc


def record(i, body, **more):
    return warc.render(i, f"http://x/{i}", body, more.get("kind", "response"), more.get("refers_to"), hashlib.sha1(body).hexdigest())


def read(data):
    return list(warc.salvage(io.BytesIO(data), len(data)))


def test_salvage_finds_later_records_and_logs_gaps():
    bodies = [f"body {i} ".encode() * (i + 1) for i in range(6)]
    members = [gzip.compress(record(i, b)) for i, b in enumerate(bodies)]
    whole = b"".join(members)
    assert [x[0] for x in read(whole)] == ["record"] * 6
    for k in range(6):
        broken = bytearray(members[k])
        broken[len(broken) // 2] ^= 0x55
        data = b"".join([*members[:k], bytes(broken), *members[k + 1 :]])
        found = read(data)
        ids = [x[3]["warc-record-id"] for x in found if x[0] == "record"]
        assert ids == [f"<urn:page:{i}>" for i in range(6) if i != k]
        gap = [x for x in found if x[0] == "gap"]
        assert [(x[1], x[2]) for x in gap] == [(sum(map(len, members[:k])), len(members[k]))]
    cut_off = read(b"junk" + whole[:-7])
    assert [x[0] for x in cut_off] == ["gap", *["record"] * 5, "gap"]
    assert read(b"") == [] and [x[:3] for x in read(b"nothing here")] == [("gap", 0, 12)]


def test_salvage_of_plain_records_and_of_payloads_that_look_like_records():
    inner = record(9, b"inside")
    data = record(0, b"a") + record(1, inner) + record(2, b"c").replace(b"Content-Length: 7", b"Content-Length: 9") + gzip.compress(record(3, b"d"))
    found = read(data)
    assert [x[3]["warc-record-id"] for x in found if x[0] == "record"][:2] == ["<urn:page:0>", "<urn:page:1>"]
    damaged = record(0, b"a").replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9999", 1) + record(1, b"b")
    found = read(damaged)
    assert [x[0] for x in found] == ["gap", "record"] and found[0][1] == 0 and found[1][3]["warc-record-id"] == "<urn:page:1>"


def test_round_trip(spark):
    rng = random.Random(2)
    big = "x" * 990 + "é" * 5
    rows = [(1, "http://a", big), (2, "http://b c\r\nd", big), (7, None, big), (3, "u", "short"), (4, "u", "short"), (5, "", None), (6, "u", ""), (None, "n", big), (8, "u", "WARC/1.1\r\n\r\n" + "z" * 1200)]
    rows += [(10 + i, f"u{i}", "".join(rng.choices("ab\r\n é", k=rng.randint(0, 3000)))) for i in range(30)] + [(8, "u", "WARC/1.1\r\n\r\n" + "z" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, pages).collect())
    want = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None]
        again = len(body) >= 1000 and i != max(same)
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    assert got == sorted(want)
    assert warc.archive_round_trip(spark, pages.where("false")).count() == 0


def test_damage_in_a_round_trip_is_logged_and_reported(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(i, f"u{i}", "some page text " * 40 + str(i)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    write = warc.write_archives

    def damaged(records, folder):
        manifest = write(records, folder)
        for r in manifest.collect():
            with open(r.archive.removeprefix("file:"), "r+b") as f:
                f.seek(r.bytes // 2)
                f.write(b"!" * 7)
        return manifest

    monkeypatch.setattr(warc, "write_archives", damaged)
    folder = f"file:{tmp_path}/archives"
    with pytest.raises(RuntimeError, match="of 40 records"):
        warc.archive_round_trip(spark, pages, folder)
    gaps = spark.read.parquet(f"{folder}/quarantine").collect()
    assert gaps and all(r.length > 0 and r.reason for r in gaps)


def test_damaged_headers_and_digests_are_gaps():
    good = record(1, b"kept")
    for old, new in ((b"Content-Length: ", b"Content-Length: \xc2\xb2"), (b"Content-Length: ", b"Content-Length: " + b"9" * 5000), (b"Block-Digest: sha1:", b"Block-Digest: sha1:!"), (b"WARC-Type:", b"WARC-Type;")):
        bad = record(0, b"lost" * 50).replace(old, new, 2)
        for pack in (bytes, gzip.compress):
            found = read(pack(bad) + pack(good) + pack(good))
            assert [x[3]["warc-record-id"] for x in found if x[0] == "record"] == ["<urn:page:1>"] * 2 and found[0][0] == "gap"
    hexed = good.replace(warc._wire_digest(hashlib.sha1(b"kept").hexdigest()).encode(), b"sha1:" + hashlib.sha1(b"kept").hexdigest().upper().encode())
    assert [x[0] for x in read(hexed)] == ["record"]
    assert warc._hex_digest("sha1:" + "z" * 40) is None and warc._hex_digest("sha1:\xb2") is None and warc._hex_digest("md5:00") is None


@pytest.mark.parametrize("packed", [False, True])
def test_fuzzed_archives_never_raise_and_keep_intact_records(packed):
    rng = random.Random(4)
    pack = gzip.compress if packed else bytes
    records = [pack(record(i, rng.randbytes(rng.randrange(400)) + f" body {i}".encode())) for i in range(12)]
    for _ in range(150):
        data, k = list(records), rng.randrange(12)
        broken, at = bytearray(data[k]), rng.randrange(len(data[k]))
        how = rng.randrange(3)
        if how == 0:
            broken[at] ^= 1 << rng.randrange(8)
        elif how == 1:
            del broken[at : at + rng.randrange(1, 30)]
        else:
            broken[at:at] = rng.choice([b"\x1f\x8b\x08\x00", b"WARC/1.1\r\n", rng.randbytes(9), b"\xc2\xb2"])
        data[k] = bytes(broken)
        found = read(b"".join(data))
        assert sum(x[2] for x in found) == len(b"".join(data))
        starts = {x[1] for x in found if x[0] == "record"}
        at = 0
        for i, part in enumerate(data):
            assert i == k or at in starts
            at += len(part)


@pytest.mark.parametrize("junk", [b"\x1f\x8b\x08", b"WARC/1.", b"WARC/1.1\r\n", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x00\x00"])
def test_long_damage_takes_time_in_proportion(junk):
    data = junk * (2_000_000 // len(junk)) + record(7, b"after")
    begun = time.time()
    found = read(data)
    assert [x[0] for x in found][-1] == "record" and found[-1][3]["warc-record-id"] == "<urn:page:7>"
    assert time.time() - begun < 30


def test_text_ids_are_kept(spark):
    rows = [("a b+c/é%", "u", "x" * 1200), ("<z>", "u", "x" * 1200), (None, "u", "short"), ("", "u", "other")]
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.archive_round_trip(spark, spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    assert got == {("a b+c/é%", "response", None), ("<z>", "revisit", "a b+c/é%"), (None, "response", None), ("", "response", None)}
