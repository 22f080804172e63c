import random
import re
from functools import lru_cache
from itertools import product

import odd
from pyspark.sql import functions as F

from cleansheet.llm import queries, turn_repair
from cleansheet.llm.turn_repair import CLOSURE, combine, parse, row_cell

KINDS = "suaoSUAOx"


def all_edits(kinds):
    """The least (cost, audit) over every sequence of edits with at most two inserted rows in a gap."""
    best = None
    for edits in product("KRD", repeat=len(kinds)):
        if any(k == "x" and e != "D" or k.lower() == "o" and e == "K" for k, e in zip(kinds, edits)):
            continue
        for gaps in product(range(3), repeat=len(kinds) + 1):
            audit, slots, cost = "", [], 0
            for i, n in enumerate(gaps):
                audit += "I" * n
                slots += ["ua"] * n
                cost += 3 * n
                if i < len(kinds):
                    k, e = kinds[i], edits[i]
                    audit += e
                    cost += {"K": 0, "R": 3, "D": 4}[e] + (3 if k.isupper() and e != "D" else 0)
                    if e != "D":
                        slots.append(k.lower() if e == "K" else "ua")
            if (best is None or (cost, audit) < best) and any(
                    re.fullmatch(r"(s?(ua)+)?", "".join(roles)) for roles in product(*slots)):
                best = cost, audit
    return best


def every_split(kinds):
    """Interval parsing that combines all splits of every span."""
    @lru_cache(None)
    def cell(i, j):
        if j - i == 1:
            return row_cell(kinds[i])
        out = {}
        for k in range(i + 1, j):
            for at, value in combine(cell(i, k), cell(k, j)).items():
                turn_repair._put(out, at, value)
        return out

    top = cell(0, len(kinds)) if kinds else CLOSURE
    return min(top[0, q] for q in (0, 3) if (0, q) in top)


def test_all_short_conversations_against_all_edits():
    words = ["".join(w) for n in range(3) for w in product(KINDS, repeat=n)]
    rng = random.Random(1)
    words += ["".join(rng.choices(KINDS, k=3)) for _ in range(60)] + ["uau", "usa", "aua", "aau", "xsx"]
    for word in words:
        assert parse(word) == all_edits(word), word


def test_one_split_is_enough():
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choices(KINDS, k=rng.randint(0, 12)))
        assert parse(word) == every_split(word), word


def test_long_conversation():
    assert parse("s" + "ua" * 20_000) == (0, "K" * 40_001)
    cost, audit = parse("uau" * 3000 + "x")
    assert cost == 3 * 3000 + 4 and audit.replace("I", "") == "K" * 9000 + "D"


def test_repaired_roles_are_sound():
    rng = random.Random(4)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}
    for _ in range(300):
        word = "".join(rng.choices(KINDS, k=rng.randint(0, 9)))
        rows = [(names.get(k.lower(), "user"), str(i)) for i, k in enumerate(word)]
        fixed = turn_repair.repaired(rows, parse(word)[1])
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r[0] for r, _ in fixed)), word
        kept = [t for _, t in fixed if t]
        assert kept == sorted(kept, key=int)


def test_odd_rows(spark):
    long = odd.LONG * 20 + "."
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi!"), (1, 1, "assistant", "Hi!"), (1, 3, "user", "more"),
        (2, None, None, None), (2, 5, "user", " \n"), (3, None, "user", "a."), (3, None, "assistant", "b."),
        (None, 0, "user", long), (None, 1, "assistant", "x?"), (4, 7, "tool", "é."), (4, 9, "", "z."), (5, 1, "user", "q.\x0b "),
        (5, 1, "user", "q."), (6, 2, "assistant", "x."), (6, 1, "user", "y."),
    ]
    df = odd.frame(spark, rows, "conv_id long, turn long, role string, text string").withColumn("is_blank", F.lit("z"))
    got = {r["conv_id"]: r for r in turn_repair.repair(df).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    one = got[1]
    assert (one["gaps"], one["duplicate"], one["truncated"], one["illegal"], one["cost"], one["audit"]) == (
        1, 1, 1, 1, 8, "KKDD")
    assert (got[2]["blank"], got[2]["cost"], got[2]["audit"], got[2]["gaps"], got[2]["turns"]) == (2, 8, "DD", 0, [])
    assert got[3]["audit"] == "IKKI" and got[3]["gaps"] == 0  # equal turns come in the order of the role
    assert got[None]["cost"] == 0 and got[None]["turns"][0]["text"] == long
    assert got[4]["audit"] == "RR" and got[4]["illegal"] == 1 and got[4]["gaps"] == 1
    assert (got[5]["duplicate"], got[5]["truncated"]) == (0, 0)
    assert got[6]["cost"] == 0


def test_empty_table(spark):
    assert turn_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_conversations_that_lose_all_rows_are_returned(spark, tmp_path):
    rows = [(i, 0, "user", "a.") for i in range(200)] + [(None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = queries.op12_turn_repair(spark, str(tmp_path)).collect()
    assert len(got) == 201 and any(r["audit"] == "" for r in got)
