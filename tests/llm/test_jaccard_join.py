import random
from fractions import Fraction

import numpy as np
import odd

from cleansheet.llm import jaccard_join
from cleansheet.llm.common import components


def shingles(text, n=5):
    words = [w for w in (text or "").replace("\x0b", " ").replace("\f", " ").replace("\t", " ").replace("\r", " ").replace(
        "\n", " ").split(" ") if w]
    return {tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def brute(rows, share=Fraction(4, 5)):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets.setdefault(d, []).append(shingles(t))
    ids = sorted(sets)

    def near(a, b):
        return any(x and y and Fraction(len(x & y), len(x | y)) >= share for x in sets[a] for y in sets[b])

    links = {a: {b for b in ids if b != a and near(a, b)} for a in ids}
    root = {a: a for a in ids}
    for _ in ids:
        for a in ids:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    each = {a: sum(sum(any(x and y and Fraction(len(x & y), len(x | y)) >= share for y in sets[b]) for b in ids if b != a)
                   for x in {frozenset(x) for x in sets[a]}) for a in ids}
    return {a: (each[a], root[a], root[a] == a) for a in ids}


def group(seed, size, words=80, edits=3):
    """Near copies of one text that differ in a few places each, some of them below the threshold."""
    rng = random.Random(seed)
    base = odd.prose(seed, words).split()
    out = []
    for _ in range(size):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(len(own))] = f"w{rng.random()}"
        out.append(" ".join(own))
    return out


def check(spark, rows):
    got = jaccard_join.similar_documents(odd.frame(spark, rows)).collect()
    named = {r["doc_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None}
    assert len(named) == sum(r["doc_id"] is not None for r in got)
    assert named == brute(rows)
    return got


def test_odd_rows(spark):
    got = check(spark, [r for r in odd.texts() if r[0] != 14])
    assert sum(r["doc_id"] is None and r["kept"] and r["n_links"] == 0 for r in got) == 2


def test_groups_against_brute_force(spark):
    rows, n = [], 0
    for seed in range(12):
        for text in group(seed, 12):
            n += 1
            rows.append((n, text))
    check(spark, rows)


def test_groups_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 16)
    rows = list(enumerate(group(77, 90, words=120, edits=4) + [odd.prose(i, 60) for i in range(30)]))
    check(spark, rows)


def test_several_texts_of_one_id(spark):
    check(spark, [r for r in odd.texts() if r[0] in (14, 4, 5)] + [(20, odd.prose(4, 70)), (21, odd.prose(5, 70))])


def test_kept_rows(spark):
    df = odd.frame(spark)
    kept = jaccard_join.drop_similar(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [-3, 1, 4, 5, 6, 7, 8, 9, 11, 14, 14, 15]  # both texts of 14
    assert ids.count(None) == 2


def test_empty_table(spark):
    assert jaccard_join.similar_documents(odd.frame(spark, [])).count() == 0


def test_needed_matches_grow():
    needed = jaccard_join.needed_matches(0.8, 1e-6)
    steps = needed[jaccard_join.STEP :: jaccard_join.STEP]
    assert (np.diff(steps) > 0).all() and steps[-1] < 0.8 * jaccard_join.HASHES


def test_overlaps_in_column_chunks():
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.randint(0, 500, 200)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    got = jaccard_join.overlaps(sets)
    assert (got - np.diag(np.diag(got)) == np.array(want) - np.diag(np.diag(want))).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0
