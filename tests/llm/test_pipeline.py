"""The stages against brute-force versions, each over what the one before has kept."""

import corpus_pipeline
import odd
from test_jaccard_join import brute as similar
from test_line_dedup import brute as lines
from test_packing import check

SMALL = "/root/testdata/sf0.001"


def folder(spark, tmp_path, docs, labels=(), benchmark=()):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_copies", "decontamination", "packing"]
    docs = read("documents")
    good = stages["quality"](spark, docs, SMALL)
    poor = {r["doc_id"] for r in read("labels").where("quality = 0").collect()}
    fine = {r["doc_id"] for r in read("labels").where("quality = 1").collect()}
    kept = {r["doc_id"] for r in good.collect()}
    assert len(poor & kept) <= 0.1 * len(poor) and len(fine & kept) >= 0.97 * len(fine)
    lean = stages["line_dedup"](spark, good, SMALL)
    want = lines([(r["doc_id"], r["text"]) for r in good.collect()], 10, 1)
    assert rows(lean.select("doc_id", "text", "n_chars")) == sorted(((d, t, len(t)) for d, _, _, t in want), key=repr)
    one = stages["near_copies"](spark, lean, SMALL)
    keep = {d for d, (_, _, first) in similar([(r["doc_id"], r["text"]) for r in lean.collect()]).items() if first}
    assert rows(one) == [r for r in rows(lean) if r[0] in keep]
    clean = stages["decontamination"](spark, one, SMALL)
    items = [r["text"] for r in read("benchmark").collect()]
    leaky = {r["doc_id"] for r in one.collect() if any(i in r["text"] for i in items)}
    assert rows(clean) == [r for r in rows(one) if r[0] not in leaky]
    pieces = stages["packing"](spark, clean, SMALL)
    check([(r["doc_id"], r["text"]) for r in clean.collect()], pieces.collect(), 1024)
    assert rows(corpus_pipeline.run(spark, SMALL)) == rows(pieces)


def test_columns_and_odd_rows(spark, tmp_path):
    docs = [(d, t, None, None, None) for d, t in odd.texts()]
    where = folder(spark, tmp_path, docs, [(1, 1, 0), (4, 1, None), (9, None, 0)], [(1, None), (2, "one two")])
    df = spark.read.parquet(where + "/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        df = stage(spark, df, where)
        assert df.columns == list(corpus_pipeline.COLUMNS)
    pieces = corpus_pipeline.run(spark, where).collect()
    assert pieces and {p["doc_id"] for p in pieces} <= {d for d, _ in odd.texts()}
    (tmp_path / "unlabelled").mkdir()
    unlabelled = folder(spark, tmp_path / "unlabelled", [(1, "one clean text", None, None, None)], [(1, None, None)])
    assert [p["doc_id"] for p in corpus_pipeline.run(spark, unlabelled).collect()] == [1]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0
