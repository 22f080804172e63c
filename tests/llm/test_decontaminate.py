import random

import numpy as np
import odd

from cleansheet.llm import decontaminate

ITEM = "item_id long, text string"


def edits_within(pattern, text):
    """The least number of edits that turn the pattern into some part of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def alter(text, n, rng):
    out = list(text)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[i] = "#"
        elif kind == 1:
            out.insert(i, "#")
        else:
            del out[i]
    return "".join(out)


def planted():
    rng = random.Random(8)
    items = [(i, odd.prose(500 + i, rng.randint(15, 25))) for i in range(6)]
    docs = []
    for d in range(60):
        text = odd.prose(900 + d, rng.randint(30, 80))
        if d % 2:
            item = items[rng.randrange(6)][1]
            share = rng.choice([0, 0, 0.02, 0.05, 0.2])
            passage = alter(item, int(len(item) * share), rng)
            passage = rng.choice([str, str.upper, lambda x: x.replace(" ", "\n  ")])(passage)
            at = text.index(" ", rng.randrange(len(text) // 2)) + 1
            text = text[:at] + passage + text[at - 1 :]
        docs.append((d, text))
    return docs, items


def test_against_brute_force(spark):
    docs, items = planted()
    found = decontaminate.contaminated_regions(odd.frame(spark, docs), spark.createDataFrame(items, ITEM)).collect()
    got = {(r["doc"], r["item"]): r for r in found}
    text_of, item_of = dict(docs), dict(items)
    for d, text in docs:
        for i, item in items:
            pattern = decontaminate.strip(item)
            budget = min(int(len(pattern) * decontaminate.EDIT_RATE), (len(pattern) - decontaminate.Q) // decontaminate.Q)
            edits = edits_within(pattern, decontaminate.strip(text))
            assert ((d, i) in got) == (edits <= budget), (d, i, edits, budget)
            if edits <= budget:
                r = got[d, i]
                assert r["edits"] == edits
                span = decontaminate.strip(text_of[d][r["start"] : r["end"]])
                assert edits_within(pattern, span) == edits and abs(len(span) - len(pattern)) <= edits
    assert len(got) > 12 and len(item_of) == 6


def test_odd_tables(spark):
    items = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, odd.LONG), (6, odd.LONG), (None, odd.prose(2, 90))]
    df = odd.frame(spark)
    found = {(r["doc"], r["item"]) for r in decontaminate.contaminated_regions(df, spark.createDataFrame(items, ITEM)).collect()}
    assert found == {(9, 4), (10, 4), (11, 5), (12, 5), (11, 6), (12, 6), (4, None), (13, None)}
    kept = decontaminate.drop_contaminated(df, spark.createDataFrame(items, ITEM))
    assert kept.columns == df.columns
    assert kept.count() == len(odd.texts()) - 7


def test_null_id_and_empty_tables(spark):
    benchmark = spark.createDataFrame([(1, odd.prose(1, 120))], ITEM)
    assert {r["doc"] for r in decontaminate.contaminated_regions(odd.frame(spark), benchmark).collect()} == {None, 1, 2, 3}
    kept = decontaminate.drop_contaminated(odd.frame(spark), benchmark).collect()
    assert all(r["text"] is None for r in kept if r["doc_id"] is None)
    assert decontaminate.contaminated_regions(odd.frame(spark, []), benchmark).count() == 0
    assert decontaminate.contaminated_regions(odd.frame(spark), spark.createDataFrame([], ITEM)).count() == 0


def test_blocks_of_the_benchmark_change_nothing(spark, monkeypatch):
    docs, items = planted()
    df, benchmark = odd.frame(spark, docs), spark.createDataFrame(items, ITEM)
    whole = {tuple(r) for r in decontaminate.contaminated_regions(df, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    assert {tuple(r) for r in decontaminate.contaminated_regions(df, benchmark).collect()} == whole


def test_band_alignment():
    rng = random.Random(1)
    for _ in range(60):
        pattern = "".join(rng.choice("abcd") for _ in range(40))
        text = "".join(rng.choice("abcd") for _ in range(25)) + alter(pattern, rng.randrange(6), rng) + "dcab" * 5
        hit = decontaminate.align(decontaminate._points(pattern), decontaminate._points(text), 10, 30, 8)
        want = edits_within(pattern, text)
        assert (hit is None and want > 8) or hit[0] == want == edits_within(pattern, text[hit[1] : hit[2]])
        assert np.all(hit is None or hit[1] <= hit[2])


def test_case_of_every_script_is_folded(spark):
    item = "вот длинный отрывок из контрольного набора который повторяется в документе целиком и без изменений"
    docs = spark.createDataFrame([(1, "начало " + item.upper() + " конец"), (2, "ΑΒΓ " + item[:20])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {r["doc"] for r in decontaminate.contaminated_regions(docs, items).collect()} == {1}


def test_items_longer_than_a_part(monkeypatch):
    """An item in parts is found where the whole of it is within its edits, once, and nowhere else."""
    monkeypatch.setattr(decontaminate, "SEGMENT_CHARS", 60)
    rng = random.Random(21)
    items = [(i, odd.prose(40 + i, rng.randint(12, 40))) for i in range(8)]
    items += [(8, "tick tock " * 30), (9, odd.prose(1, 9) + " " + odd.prose(40, 20))]
    index = decontaminate.Index(items, decontaminate.Q, decontaminate.EDIT_RATE)
    assert len(index.texts) > 3 * len(items)
    docs = []
    for d in range(120):
        _, item = items[d % 10]
        share = rng.choice([0, 0.02, 0.05, 0.07, 0.08, 0.1, 0.2])
        passage = rng.choice([alter(item, int(len(item) * share), rng), item[: len(item) // 2], item[:70] + "#" * 40 + item[70:]])
        docs.append(f"{odd.prose(700 + d, rng.randint(0, 20))} {passage} {odd.prose(800 + d, rng.randint(0, 20))}")
    got = {}
    for text, item, start, end, edits in decontaminate.regions(index, docs):
        got.setdefault((text, item), []).append((start, end, edits))
    hits = misses = 0
    for d, text in enumerate(docs):
        for i in {d % 10, (d + 1) % 10}:
            pattern = decontaminate.strip(items[i][1])
            budget = min(int(len(pattern) * decontaminate.EDIT_RATE), (len(pattern) - decontaminate.Q) // decontaminate.Q)
            edits = edits_within(pattern, decontaminate.strip(text))
            assert ((d, i) in got) == (edits <= budget), (d, i, edits, budget)
            if edits <= budget:
                assert min(e for *_, e in got[d, i]) == edits and len(got[d, i]) == 1
                start, end, edits = got[d, i][0]
                span = decontaminate.strip(text[start:end])
                assert edits_within(pattern, span) == edits and abs(len(span) - len(pattern)) <= edits
            hits, misses = hits + (edits <= budget), misses + (edits > budget)
    assert hits > 30 and misses > 30


def test_one_rule_at_every_length(spark):
    """Half of an item is no occurrence, whether the item has 1,000 characters or a few more; a whole one is one region."""
    items = [(n, odd.prose(60 + n, 400)[:n].strip() + "x" * (n - len(odd.prose(60 + n, 400)[:n].strip()))) for n in (1000, 1003, 1999)]
    docs = [(2 * i, "before " + t + " after") for i, (_, t) in enumerate(items)]
    docs += [(2 * i + 1, "before " + t[: len(t) // 2] + " after") for i, (_, t) in enumerate(items)]
    found = decontaminate.contaminated_regions(odd.frame(spark, docs), spark.createDataFrame(items, ITEM)).collect()
    assert sorted((r["doc"], r["item"], r["start"], r["end"], r["edits"]) for r in found) == [
        (2 * i, n, 7, 7 + n, 0) for i, (n, _) in enumerate(items)]
