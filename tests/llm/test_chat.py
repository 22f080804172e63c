import random

from pyspark.sql import functions as F

from cleansheet.llm import chat

EVENTS = "conv_id long, seq long, message long, event string, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<s>", "<\\s>", "<\\\\/s> [\\INST]", "[INST][/INST]", "%0A %25", "", None, "<s", "s>", "é日\n\n",
         "\\", "[\\\\/INST] <s>[INST]", "x" * 20_000]


def fold(events):
    """What a log leaves behind, one event at a time."""
    rank = lambda e: (e[1] is not None, e[1] or 0, e[3] or "delta", e[5] is not None, e[5] or "")
    talks = {}
    for conv, seq, message, event, role, text in sorted(events, key=rank):
        messages = talks.setdefault(conv, {})
        event = event or "delta"
        if event == "regenerate":
            for later in [m for m in messages if m > message]:
                del messages[later]
        m = messages.setdefault(message, [None, ""])
        if role is not None and m[0] is None:
            m[0] = role
        if event == "delta":
            m[1] += text or ""
        elif event == "edit":
            m[1] = text or ""
        elif event == "regenerate":
            m[1] = ""
    return sorted((c, m, r or "", t) for c, ms in talks.items() for m, (r, t) in ms.items())


def test_fold_against_one_by_one(spark):
    rng = random.Random(3)
    events, seq = [], 0
    for conv in range(30):
        for _ in range(60):
            seq += 1
            events.append((conv, seq, rng.randint(0, 5), rng.choice(["delta"] * 6 + ["edit", "regenerate", None, "typing"]),
                           f"r{conv}", rng.choice(NASTY[:-1])))
    got = chat.fold_events(spark.createDataFrame(events, EVENTS).withColumn("log", F.lit(1)).withColumn("reset", F.lit(2)))
    assert sorted(tuple(r) for r in got.collect()) == fold(events)


def test_render_and_read_back(spark):
    rng = random.Random(4)
    rows = [(c, m, rng.choice(["user", "assistant", "system", None, "a\nb%", "<s>"]), rng.choice(NASTY))
            for c in range(20) for m in range(rng.randint(1, 12))]
    rows += [(None, 0, "user", "hi"), (None, 1, "assistant", None), (5, 0, "assistant", "tie"), (5, 0, "assistant", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, message long, role string, text string").withColumn("place", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.render(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((m, r or "", t or "") for c, m, r, t in rows if c == conv)
        assert [(t["role"], t["text"]) for t in got[conv]["read"]] == [(r, t) for _, r, t in own]
        assert got[conv]["loss"] == "".join(t for _, r, t in own if r == "assistant")
        assert got[conv]["formatted"].count("<s>") == len(own)


def test_offsets_point_at_the_text(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "<s> a"), (1, 2, "user", "z")],
                               "conv_id long, message long, role string, text string")
    row = chat.render(df).first()
    spans = [(t["loss_start"], t["loss_length"]) for t in row["turns"]]
    assert [row["formatted"][a : a + n] for a, n in (s for s in spans if s[0] is not None)] == ["<\\s> a"]
    assert sum(t["length"] for t in row["turns"]) == len(row["formatted"])


def test_null_events_and_empty_log(spark):
    rows = [(1, None, None, None, None, None), (None, 1, 1, "delta", None, "a"), (1, 2, 1, "edit", "user", None)]
    got = sorted((tuple(r) for r in chat.fold_events(spark.createDataFrame(rows, EVENTS)).collect()), key=repr)
    assert got == sorted([(1, None, "", ""), (None, 1, "", "a"), (1, 1, "user", "")], key=repr)
    empty = chat.read_back(chat.render(chat.fold_events(spark.createDataFrame([], EVENTS))))
    assert empty.count() == 0


def test_plan_has_no_python(spark):
    out = chat.read_back(chat.render(chat.fold_events(spark.createDataFrame([], EVENTS))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
