import numpy as np
import odd
import pytest

from cleansheet.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def test_gradients():
    rng = np.random.RandomState(0)
    x, counts, label = rng.randn(9, quality.FEATURES), np.array([4, 1, 3, 1]), np.array([1.0, 0.0, 1.0, 0.0])
    model = quality.fit(x, counts, label, epochs=1)
    loss = lambda: -np.mean(label * np.log(s := model.forward(x, counts)["score"]) + (1 - label) * np.log(1 - s))
    for name, slope in quality._gradients(model, x, counts, label).items():
        w = model.weights[name]
        for at in ([()] if w.ndim == 0 else [tuple(i) for i in np.argwhere(np.ones(w.shape))[:: max(1, w.size // 5)]]):
            old = np.array(w)
            moved = []
            for step in (1e-5, -1e-5):
                model.weights[name] = old.copy()
                model.weights[name][at] += step
                moved.append(loss())
            model.weights[name] = old
            assert abs((moved[0] - moved[1]) / 2e-5 - np.asarray(slope)[at]) < 1e-5


def test_attention_sums_to_one():
    model = quality.fit(np.random.RandomState(1).randn(5, quality.FEATURES), np.array([3, 2]), np.array([1.0, 0.0]), epochs=1)
    f = model.forward(np.ones((5, quality.FEATURES)), np.array([3, 2]))
    assert np.allclose(np.add.reduceat(f["attention"], [0, 3]), 1)


def test_held_out_accuracy(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet")
    model = quality.train(read("documents"), read("labels"))
    from pyspark.sql import functions as F
    rows = read("documents").join(read("labels"), "doc_id").where(quality.held_out(F.col("doc_id"))).select(
        "quality", quality.score(F.col("text"), model).alias("score")).collect()
    assert len(rows) > 50
    assert np.mean([(r["score"] >= quality.THRESHOLD) == r["quality"] for r in rows]) >= 0.95


def test_passages_cover_whole_texts():
    x, n = quality.passages([None, "", " \n", "a", "a b " * 64, odd.LONG, "x" * 300_000])
    assert n.tolist() == [1, 1, 1, 1, 2, -(-400 * 60 // 64), 1] and len(x) == n.sum() and np.isfinite(x).all()


@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(1, 1, 0), (1, 0, 0), (99, 1, 1), (None, 1, 0)]])
def test_odd_tables(spark, labels):
    from pyspark.sql import functions as F
    df = odd.frame(spark)
    model = quality.train(df, spark.createDataFrame(labels, LABELS))
    scores = [r["s"] for r in df.select(quality.score(F.col("text"), model).alias("s")).collect()]
    assert len(scores) == len(odd.texts()) and all(0 <= s <= 1 for s in scores)
    if len(labels) < 3:
        assert set(scores) == {0.5}
    kept = quality.reject_poor(df, spark.createDataFrame(labels, LABELS), threshold=0.0)
    assert kept.columns == df.columns and kept.count() == len(odd.texts())
    assert quality.reject_poor(odd.frame(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_nothing_learnt_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows in ([], [(1, None)], [(9, 1)]):
        assert quality.reject_poor(docs, spark.createDataFrame(rows, "doc_id long, quality int")).count() == 2
