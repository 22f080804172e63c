import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from cleansheet.llm import near_vectors


def clustered(n, d=32, groups=40, seed=1, spread=0.35):
    rng = np.random.RandomState(seed)
    centre = rng.randn(groups, d)
    return centre[rng.randint(0, groups, n)] + rng.randn(n, d) * spread * rng.rand(n, 1) * 2


def brute(rows, threshold=0.9):
    good = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and all(
        c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted({i for i, _ in rows if i is not None})
    links = {i: set() for i in ids}
    for i, x in good.items():
        for j, y in good.items():
            if i != j and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
    root = {i: i for i in ids}
    while True:
        new = {i: min([root[i], *(root[j] for j in links[i])]) for i in ids}
        if new == root:
            break
        root = new
    return {i: (len(links[i]), root[i], root[i] == i) for i in ids}


ODD = [(900, None), (901, []), (902, [0.0] * 32), (903, [None] + [1.0] * 31), (904, [float("nan")] * 32),
       (905, [float("inf")] + [1.0] * 31), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1e30] * 32), (909, [1e-30] * 32),
       (None, [1.0] * 32), (None, None)]


def test_against_brute_force(spark):
    rows = [(i, v) for i, v in enumerate(clustered(400).astype(np.float32).astype(float).tolist())]
    rows += ODD + rows[:7] + [(500 + i, rows[3][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns(
        {"label": F.lit(None).cast("int"), "raw": F.lit(1), "shard": F.lit("x")})
    got = near_vectors.near_duplicates(df).collect()
    named = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got if r["vec_id"] is not None}
    assert named == brute(rows)
    assert sum(r["vec_id"] is None for r in got) == 2


def test_empty_table(spark):
    assert near_vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_graph_recall_and_widening():
    vectors = near_vectors._unit(clustered(5000, d=48, groups=300, seed=2, spread=0.25))
    vectors[:400] = near_vectors._unit(vectors[:1] + np.random.RandomState(5).randn(400, 48) * 0.01)
    graph = near_vectors.Graph(vectors)
    assert graph.audit(0.9) >= near_vectors.AUDIT_RECALL and graph.beam <= 4 * near_vectors.FIRST_BEAM
    q = graph.vectors[::7]
    truth = {tuple(p) for p in np.argwhere(q @ graph.vectors.T >= 0.9)}
    got = list(zip(*graph.within(q, 0.9)))
    assert len(got) == len(set(got)) and set(got) <= truth
    assert len(got) >= 0.97 * len(truth)


def test_audit_counts_no_self_matches_and_every_query_alike():
    vectors = near_vectors._unit(np.random.RandomState(8).randn(3000, 32))
    vectors[1:3000:2] = near_vectors._altered(vectors[::2], 0.9)  # everyone has one partner
    vectors[:900] = near_vectors._unit(vectors[:1] + np.random.RandomState(9).randn(900, 32) * 0.01)  # a hot group
    graph = near_vectors.Graph(vectors)
    whole = graph._within

    def forgetful(q, threshold, beam):
        query, node, widened = whole(q, threshold, beam)
        ids = np.argmax(q @ graph.vectors.T, 1)
        keep = widened[query] | (node == ids[query])  # outside the hot group only the query itself, or its nearest
        return query[keep], node[keep], widened

    graph._within = forgetful
    graph.audit(0.9)
    assert graph.beam * 8 >= len(vectors)


def test_audit_asks_for_other_vectors():
    vectors = near_vectors._unit(np.random.RandomState(8).randn(3000, 32))
    graph = near_vectors.Graph(vectors)
    whole, seen = graph._within, []
    graph._within = lambda q, threshold, beam: seen.append(q) or whole(q, threshold, beam)
    others = near_vectors._altered(vectors[:50], 0.9, seed=1)
    graph.audit(0.9, others)
    assert any(len(q) == 50 and np.allclose(q, others) for q in seen)


def test_nodes_of_one_batch_are_linked():
    vectors = near_vectors._unit(np.random.RandomState(4).randn(2000, 32))
    vectors[1800:] = near_vectors._altered(vectors[1600:1800], 0.95)  # partners come in the last batch
    graph = near_vectors.Graph(vectors)
    linked = [i + 200 in graph.edges[0][i] or i in graph.edges[0][i + 200] for i in range(1600, 1800)]
    assert np.mean(linked) > 0.99


def test_several_shards_keep_recall(spark):
    rows = list(enumerate(clustered(6000, groups=900, seed=3).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors.near_duplicates(df, min_shards=2).collect()}
    unit = near_vectors._unit(np.array([v for _, v in rows]))
    want = (unit @ unit.T >= 0.9).sum(1) - 1
    assert sum(got.values()) >= 0.97 * want.sum() and all(got[i] <= want[i] for i in got)


def node_batches(vectors, rows=700):
    """What the tasks read of one shard, a few rows at a time."""
    for a in range(0, len(vectors), rows):
        part, many = vectors[a : a + rows], len(vectors[a : a + rows])
        yield pa.RecordBatch.from_pydict({
            "length": pa.array([vectors.shape[1]] * many, pa.int32()), "shard": pa.array([3] * many, pa.int32()),
            "node": pa.array(range(a, a + many), pa.int64()), "weight": pa.array([1] * many, pa.int64()),
            "raw": pa.array([x.tobytes() for x in part], pa.binary()), "probe": pa.array([0] * many, pa.int32())})


def peak_mb(work):
    tracemalloc.start()
    work()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_no_cell_of_the_graph_table_grows_with_the_shard():
    vectors = clustered(3000, groups=300, seed=6).astype(np.float32)
    batches = list(near_vectors._build(0.9)(node_batches(vectors)))
    assert max(len(c) for b in batches for name in ("raw", "edges") for c in b.column(name).to_pylist()) < 1000
    assert sum(b.num_rows for b in batches) == 3000 and max(b.num_rows for b in batches) <= 4096
    assert [x for b in batches for x in b.column("place").to_pylist()] == list(range(3000))
    reader = near_vectors._Reader()
    for b in batches:
        reader.add(b, 32)
    shard, graph = reader.shard(), near_vectors.Graph(near_vectors._unit(vectors))
    graph.audit(0.9 - near_vectors.SLACK)
    assert (shard.raw == vectors).all() and (shard.node == np.arange(3000)).all() and (shard.weight == 1).all()
    assert (shard.graph.vectors == graph.vectors).all() and shard.graph.beam == graph.beam
    assert all((a == b).all() for a, b in zip(shard.graph.layers, graph.layers, strict=True))
    assert all((a == b).all() for a, b in zip(shard.graph.edges, graph.edges, strict=True))


def test_pairs_of_a_large_group_are_not_held_together():
    rng = np.random.RandomState(3)
    vectors = (np.ones(32) + rng.randn(6000, 32) * 0.01).astype(np.float32)  # 36 million pairs
    parts = list(near_vectors._build(0.9)(node_batches(vectors)))
    count = [b.num_rows for b in parts]
    told = [b.append_column("block", pa.array([0] * n)).append_column("asks", pa.array([0] * n)) for b, n in zip(parts, count)]
    asked = pa.RecordBatch.from_pydict({
        "length": [32] * 6000, "shard": [3] * 6000, "block": [0] * 6000, "asks": [1] * 6000, "node": list(range(6000)),
        "raw": pa.array([x.tobytes() for x in vectors], pa.binary())})
    got = []
    assert peak_mb(lambda: got.extend(near_vectors._query(0.9)([*told, asked]))) < 150
    links = {}
    for row in got[0].to_pylist():
        links[row["node"]] = links.get(row["node"], 0) + row["links"]
    assert links == {i: 5999 for i in range(6000)}


def test_a_node_with_many_edges_does_not_widen_the_others():
    rng = np.random.RandomState(3)
    graph = near_vectors.Graph(near_vectors._unit(rng.randn(6000, 16)))
    batch = np.arange(3000, 6000)
    chosen = rng.randint(1, 3000, (3000, 16)).astype(np.int32)
    chosen[:, 0] = 0
    assert peak_mb(lambda: graph._link_back(0, batch, chosen)) < 50  # 2,994 nodes by 3,000 edges were 72 MB
    assert set(graph.edges[0][0]) & set(batch)


def test_many_shards_and_blocks_with_floats_and_doubles(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "SHARD_BYTES", 40_000)
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", 50)
    rows = [(i, v) for i, v in enumerate(clustered(300).tolist())]
    rows[::2] = [(i, np.float32(v).astype(float).tolist()) for i, v in rows[::2]]
    rows += [(1000 + i, v[:8]) for i, v in rows[:40]] + [(2000 + i, v) for i, v in rows[:5]] + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"])
           for r in near_vectors.near_duplicates(df).collect() if r["vec_id"] is not None}
    assert got == brute(rows)
