import random
from itertools import permutations

import numpy as np
import odd
from pyspark.sql import functions as F

from cleansheet.llm import filter_audit

SPACE = " \t\n\x0b\f\r"


def fails(text):
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def brute(rows, labels):
    """(part, order, step) -> the seven counts, one document after the other."""
    rows = [(d, t or "", s or "") for d, t, s in rows]
    judged = {}
    for d, q, x in labels:
        if d is not None:
            old = judged.get(d, (0, 0))
            judged[d] = (max(old[0], q == 1), max(old[1], x == 1))
    sets = []
    for d, t, s in rows:
        bad = {k for k, v in fails(t).items() if v}
        if d is not None and any(e is not None and e < d and u == t for e, u, _ in rows):
            bad.add("E")
        sets.append((s, bad, *judged.get(d, (0, 0))))
    out = {}
    for part in {s for s, *_ in sets}:
        mine = [x[1:] for x in sets if x[0] == part]
        sums = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for i, f in enumerate(order):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                sums[f] += len(gone)
                out[part, "".join(order), i + 1] = [
                    len(left), len(gone), sum(f in x[0] for x in mine) - len(gone), sum(x[0] == {f} for x in mine),
                    sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(sums[order[step - 1]])
    return out


def result(docs, labels):
    rows = filter_audit.interactions(filter_audit.mask_counts(docs, labels)).collect()
    return {(r["part"], r["filter_order"], r["step"]): [
        r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]] for r in rows}


def test_against_brute_force(spark):
    rng = random.Random(3)
    long = [odd.prose(i, 210) for i in range(6)]
    texts = [t for _, t in odd.texts()] + long + ["HEY " + t for t in long] + [t + " 5%" for t in long] + ["x " * 300] * 3
    rows = [(rng.choice([None, *range(-4, 40)]), rng.choice(texts), rng.choice(["a", "b", "", None])) for _ in range(150)]
    rows += rows[:20]
    labels = [(rng.choice([None, *range(-4, 40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = odd.frame(spark, rows, "doc_id long, text string, source string")
    docs = docs.withColumns({n: F.lit("z") for n in ("hash", "part", "mask", "quality", "is_first", "good", "repeat")})
    got = result(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert got == brute(rows, labels)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert result(spark.createDataFrame([], "doc_id long, text string, source string"), labels) == {}
    got = result(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string"), labels)
    assert len(got) == 600 and got["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]


def test_no_repeat_is_cleared_and_most_unique_texts_are(spark):
    values = spark.range(200_000).select(F.xxhash64("id").alias("hash"))
    twice = values.where(F.pmod("hash", F.lit(10)) == 0)
    test = filter_audit.possible_repeat(values.unionAll(twice).repartition(13))
    found = values.select("hash", test(F.col("hash")).alias("maybe")).groupBy(
        (F.pmod("hash", F.lit(10)) == 0).alias("is_twice"), "maybe").count().collect()
    count = {(r["is_twice"], r["maybe"]): r["count"] for r in found}
    assert (True, False) not in count
    assert count.get((False, True), 0) < 0.01 * count[False, False]


def test_a_full_filter_still_gives_exact_counts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "MAX_CELLS", 8)
    rows = [(i, f"text {i % 30}", "a") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(59, 1, 0)], "doc_id long, quality int, toxic int")
    assert result(docs, labels) == brute(rows, [(59, 1, 0)])


def test_hot_text_folds_in_its_task():
    hashes = np.repeat(np.array([5, 7]), [100_000, 1])
    import pyarrow as pa

    rows = list(filter_audit._partial(64, 3)([pa.RecordBatch.from_arrays([pa.array(hashes)], ["h"])]))
    assert sum(len(b.column(1)[0].as_py()) + len(b.column(2)[0].as_py()) for b in rows) <= 6 * 4
