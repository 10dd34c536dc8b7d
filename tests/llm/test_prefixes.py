import hashlib
import random
import re
import zlib

from strandline.llm import prefixes


def brute(turns):
    """The nodes by the rule: turns are (conv, turn, role, text)."""
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    by_turn = lambda t: (t[0], t[1] or 0, hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest())
    own = {c: [t[2:] for t in sorted(ts, key=by_turn)] for c, ts in own.items()}
    members = {}
    for c, ts in own.items():
        base = c - (abs(c) % 20) * (1 if c > 0 else -1)
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    out = []
    for node, own_members in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        saved = sum((len(members[x]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0) for x in below)
        ends = ",".join(str(c) for c in sorted(c for c, last in own_members if last))
        parent = min(c for c, _ in members[node[:-1]]) if node else None
        out.append((min(c for c, _ in own_members), len(node), parent, len(own_members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(frame):
    return sorted(map(tuple, frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


TEXTS = ["hello there", "a b  c", "", None, "\ttabs\nand lines ", "a\xa0b", "é è"]


def made(seed, convs, longest):
    rng = random.Random(seed)
    turns = []
    for c in convs:
        for t in range(rng.randrange(1, longest)):
            turns.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), TEXTS[min(rng.randrange(9), rng.randrange(9), 6)]))
    return turns


def test_equals_brute_force(spark):
    for seed, convs, longest in ((1, range(90), 4), (2, [*range(-45, 25), 61, 62, 139], 7), (3, range(100, 125), 12), (4, [20, 21, 35], 3)):
        turns = made(seed, convs, longest)
        turns += turns[:3] + [(None, 1, "user", "no conversation")]
        frame = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, depth int, node string")
        assert rows(prefixes.prefix_trie(frame.repartition(3))) == brute(turns)


def test_many_equal_conversations_and_a_long_one(spark):
    turns = [(c, t, "user", f"same words {t}") for c in range(700) for t in range(5)]
    turns += [(1000, t, "user", "x") for t in range(20_000)] + [(1001, t, "user", "x" if t < 15_000 else "y") for t in range(15_500)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in prefixes.prefix_trie(frame).collect()}
    assert len(got) == 1 + 5 + 20_000 + 500
    assert got[0, 0].n_convs == 702 and got[0, 0].n_children == 2 and got[0, 0].n_leaves == 3 and got[0, 0].parent_conv_id is None
    assert got[0, 5].n_convs == 700 and got[0, 1].saved_tokens == 5 * 3 * 699
    assert got[0, 5].ends_sha256 == hashlib.sha256(",".join(map(str, range(700))).encode()).hexdigest()
    assert got[1000, 15_000].n_children == 2 and got[1000, 15_000].n_leaves == 2 and got[1001, 15_001].parent_conv_id == 1000
    assert got[1000, 1].saved_tokens == 15_000


def test_no_conversation_has_no_node(spark):
    assert prefixes.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert prefixes.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")).collect() == []


def test_long_text(spark):
    frame = spark.createDataFrame([(41, 0, "user", "w " * 1_000_000), (42, 0, "user", "w " * 1_000_000)], "conv_id long, turn long, role string, text string")
    got = rows(prefixes.prefix_trie(frame))
    assert got == brute([(41, 0, "user", "w " * 1_000_000), (42, 0, "user", "w " * 1_000_000)])
