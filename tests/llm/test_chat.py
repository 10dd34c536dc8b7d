import random
import re
from functools import cache

from pyspark.sql import functions as F

from strandline.llm import chat

LEGAL = re.compile(r"(S?(UA)+|)\Z")


def least_cost(roles):
    """Shortest path by plain recursion over all actions, written apart from the operator."""
    follow = {"": "SU", "S": "U", "U": "A", "A": "U"}

    @cache
    def go(i, last):
        found = [] if last == "" and roles else []
        if i == len(roles):
            return 0 if last in ("A", "") else 3 + (0 if last == "U" else 3)
        found = [c for c in follow[last]]
        costs = [(0 if q == roles[i] else 5) + go(i + 1, q) for q in found]
        if last:
            costs.append(2 + (0 if last == roles[i] else 5) + go(i + 1, last))
        for x in found:
            if x != "S":
                costs += [3 + (0 if q == roles[i] else 5) + go(i + 1, q) for q in follow[x]]
        return min(costs)

    return go(0, "")


def test_cost_is_least_and_result_legal_however_it_is_split(spark):
    rng = random.Random(6)
    names = {"system": "S", "user": "U", "assistant": "A", "tool": "T", None: "T"}
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv if conv else None, turn, rng.choice(list(names)), None if rng.random() < 0.1 else f"text {conv} {turn}", "x"))
    rows += [(99, turn, rng.choice(["user", "assistant"]), "same" * (turn % 3), "x") for turn in range(400)]
    rows += [(5, 1, "user", "again", "x")] * 3
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, action string")
    results = []
    for parts in (1, 9):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = chat.repair_chats(frame).collect()
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        key = lambda r: (r.conv_id is not None, r.conv_id, r.turn, r.role is not None, r.role, r.text_hash)
        results.append(sorted(got, key=lambda r: tuple(str(x).zfill(30) for x in key(r))))
    assert results[0] == results[1] and len(results[0]) == len(rows)
    convs = {}
    for r in results[0]:
        convs.setdefault(r.conv_id, []).append(r)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r.turn, r.role is not None, r.role or "", r.text_hash))
        assert sum(r.cost for r in turns) == least_cost("".join(names[r.role] for r in turns)), conv
        text = "".join(r.rendered for r in turns)
        said = re.findall(r"<\|im_start\|>(\w+)\n", text)
        assert LEGAL.match("".join(names[x] for x in said)), said
        assert text.count("<|im_end|>\n") == len(said)
    assert chat.repair_chats(frame.where("false")).count() == 0


def test_good_chats_stay(spark):
    frame = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")], "conv_id long, turn long, role string, text string").withColumn("cost", F.lit(3))
    got = chat.repair_chats(frame).orderBy("turn").collect()
    assert [r.action for r in got] == ["keep"] * 3 and sum(r.cost for r in got) == 0
    assert "".join(r.rendered for r in got) == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
