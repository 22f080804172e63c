import hashlib
import random

import odd

from compare import differences

from cleansheet.llm import line_dedup, queries

SPACE = " \t\n\x0b\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs, min_chars, keep_first=False):
    docs = sorted({(d is not None, d or 0, d, t or "") for d, t in rows}, key=lambda x: x[:2])
    key = lambda line: line.strip(SPACE).translate(LOWER)
    count = {}
    for _, _, d, t in docs:
        for k in {key(x) for x in t.split("\n")}:
            count[k] = count.get(k, 0) + 1
    out, seen = [], set()
    for _, _, d, t in docs:
        kept = []
        for line in t.split("\n"):
            k = key(line)
            common = len(k) >= min_chars and count[k] >= min_docs
            if not common or (keep_first and k not in seen):
                kept.append(line)
            seen.add(k)
        out.append((d, t.count("\n") + 1, t.count("\n") + 1 - len(kept), "\n".join(kept)))
    return out


def result(df, **rules):
    rows = line_dedup.drop_lines(df, **rules).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted({tuple(r) for r in rows}, key=repr), len(rows)


def shared(n=40):
    rng = random.Random(5)
    lines = [odd.prose(i, 6) for i in range(30)] + ["", "  ", "x", "É", "é"]
    rows = [(d, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([str.upper, str])(rng.choice(lines))
                          for _ in range(rng.randint(1, 150)))) for d in range(n)]
    return rows + odd.texts()


def test_against_brute_force(spark):
    rows = shared()
    for min_docs, min_chars in ((10, 1), (2, 0), (3, 2)):
        got, n = result(odd.frame(spark, rows), min_docs=min_docs, min_chars=min_chars)
        assert n == len(rows)
        assert got == sorted(set(brute(rows, min_docs, min_chars)), key=repr)


def test_first_occurrence_stays(spark):
    rows = [(d, t) for d, t in shared() if d not in (4, 14)]
    distinct = list({d: (d, t) for d, t in rows}.values())
    got, _ = result(odd.frame(spark, distinct), min_docs=1, keep_first=True)
    assert got == sorted(set(brute(distinct, 1, 1, keep_first=True)), key=repr)


def test_empty_table_and_columns(spark):
    df = odd.frame(spark, [])
    out = line_dedup.drop_lines(df)
    assert out.count() == 0
    assert set(df.columns) <= set(out.columns)


def test_bitmaps_are_small(spark):
    rows = [(d, "\n".join(["common"] + [f"{d} {i}" for i in range(500)])) for d in range(12)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(maps) == 12 and all(len(m["keep"]) == 1 and m["n_dropped"] == 1 for m in maps)
    assert {tuple(m["keep"][0]) for m in maps} == {(0, 1, ~1)}


def test_bitmaps_are_runs(spark):
    """Long stretches that go, or stay, take one run; written out the bitmap says which lines stay."""
    rng = random.Random(3)
    shapes = ["k" * 6400 + "d" * 6400 + "k" * 100, "d" * 640, "k" * 70 + "d", "".join(rng.choice("kd") for _ in range(1000)),
              "d" * 64 + "k" * 64 + "d" * 128 + "kd" * 64, "k" * 300]
    rows = [(d, "\n".join("shared line" if c == "d" else f"{d} {i}" for i, c in enumerate(shape))) for d, shape in enumerate(shapes)]
    rows += [(100 + i, "shared line") for i in range(10)]
    maps = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc"]: r for r in maps.withColumn("words", line_dedup.bitmap(maps["keep"])).collect()}
    assert set(got) == {0, 1, 2, 3, 4, *range(100, 110)}
    for d in range(5):
        words, gone = got[d]["words"], {i for i, c in enumerate(shapes[d]) if c == "d"}
        assert {i for i in range(len(words) * 64) if not words[i // 64] >> i % 64 & 1} == gone and got[d]["n_dropped"] == len(gone)
        assert len(words) == max(gone) // 64 + 1
    assert [len(got[d]["keep"]) for d in (0, 1, 2)] == [1, 1, 1] and tuple(got[0]["keep"][0]) == (100, 100, 0)
    assert [tuple(r)[:2] for r in got[4]["keep"]] == [(0, 1), (1, 2), (0, 2)]


def test_plan_has_no_python(spark):
    plan = line_dedup.drop_lines(odd.frame(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_query_and_sql_agree_on_repeated_ids(spark, tmp_path):
    rows = [(d % 9, f"shared\n{d}") for d in range(10)] + [(d % 3, "thrice") for d in range(12)] + [(None, None), (None, "shared"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/in")
    (part,) = (tmp_path / "in").glob("part-*.parquet")
    part.rename(tmp_path / "documents.parquet")
    found = differences(spark, str(tmp_path), "op10", queries.op10_line_dedup, queries.OP10_SQL)
    assert found == []
    got = queries.op10_line_dedup(spark, str(tmp_path)).where("n_dropped > 0").count()
    assert got == 11  # ten documents of nine ids and one without an id share a line; "thrice" stands in three documents only


def test_digest_of_kept_text(spark):
    got, _ = result(odd.frame(spark, [(d, "a\nshared\nb") for d in range(10)]), min_docs=10)
    assert {hashlib.sha256(r[3].encode()).hexdigest() for r in got} == {hashlib.sha256(b"").hexdigest()}
