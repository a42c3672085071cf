"""Vector operators against brute force, and on odd rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dischargelab.llm import ann, queries, topk, vectors


def embeddings(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    return df["vec_id"].to_numpy(), np.stack(df["embedding"].to_numpy()).astype(float)


def ranked(ids, asked, scores, k):
    """Brute force: (query, rank, id, score) rows."""
    out = []
    for q, s in zip(asked, scores):
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out += [(int(q), r + 1, int(ids[i]), s[i]) for r, i in enumerate(order)]
    return sorted(out)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()))


def test_top_k_equals_brute_force(spark, small):
    ids, x = embeddings(spark, small)
    x = np.floor(256 * x)
    asked = ids % 50 == 0
    assert rows(queries.QUERIES["op4_topk"](spark, small)) == ranked(ids, ids[asked], x[asked] @ x.T, 5)


def test_blocks_are_pruned_without_loss():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(size=(4000, 8)) * 30)
    x = x[np.argsort(x[:, 0])]
    ids = np.arange(4000)
    blocks = topk.Blocks([ids[i: i + 100] for i in range(0, 4000, 100)], [x[i: i + 100] for i in range(0, 4000, 100)])
    for q in x[::400]:
        bounds = blocks.bounds(q[None])[0]
        assert all(b >= (r @ q).max() for b, r in zip(bounds, blocks.rows))
        found, scores = blocks.top(-1, q, bounds, topk.NONE, 5)
        order = np.lexsort((ids, -(x @ q)))[:5]
        assert found.tolist() == order.tolist() and scores.tolist() == (x @ q)[order].tolist()


def test_nearest_recall(spark, small):
    ids, x = embeddings(spark, small)
    asked = ids % 20 == 0
    want = ranked(ids, ids[asked], x[asked] @ x.T, 20)
    got = rows(queries.QUERIES["op9_ann"](spark, small))
    assert len(got) == len(want)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    at = {i: v for i, v in zip(ids, x)}
    assert all(abs(s - at[q] @ at[i]) < 1e-12 for q, _, i, s in got)


def test_nearest_recall_for_vectors_of_different_lengths(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.2, 2, (1500, 1))
    ids = np.arange(1500)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": ids, "embedding": list(x)}))
    got = rows(ann.nearest(df, F.expr("vec_id % 20 = 0"), 10))
    want = ranked(ids, ids[::20], x[::20] @ x.T, 10)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)


def test_tables_return_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 256, (600, 8), dtype=np.uint8)
    probes = codes[:40] ^ np.packbits(rng.random((40, 64)) < 0.12, axis=1)
    for radius in (0, 7, 12, 20):
        maps = ann.Tables(codes, radius).probe(probes)
        for p, m in zip(probes, maps):
            within = ann.distances(codes, p) <= radius
            assert not (within & ~np.unpackbits(m, count=600).astype(bool)).any()


ODD = [(0, [1.0, 0.5, -1.0]), (1, None), (2, [None, 1.0, 1.0]), (3, [float("nan"), 1.0, 1.0]), (4, [float("inf"), 0.0, 0.0]), (5, [1.0]),
       (6, [0.0, 0.0, 0.0]), (7, [1.0, 0.5, -1.0]), (7, [1.0, 0.5, -1.0]), (None, [9.0, 9.0, 9.0]), (8, []), (100, [1.0, 1.0, 1.0])]


def test_odd_vectors(spark):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in ODD], "vec_id long, embedding array<double>, v string, asks string")
    got = rows(topk.exact_top_k(df, F.expr("vec_id % 50 = 0")))
    assert [(q, i) for q, _, i, _ in got] == [(0, 7), (0, 7), (0, 5), (0, 100), (0, 6), (100, 5), (100, 0), (100, 7), (100, 7), (100, 6)]
    near = rows(ann.nearest(df, F.expr("vec_id % 50 = 0"), 3))
    assert [(q, i) for q, _, i, _ in near] == [(0, 7), (0, 7), (0, 5), (100, 5), (100, 0), (100, 7)]
    empty = df.where("false")
    assert topk.exact_top_k(empty, F.lit(True)).count() == 0 and ann.nearest(empty, F.lit(True)).count() == 0
    assert vectors.finite_vectors(df, F.lit(None).cast("boolean")).where("asks").count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 16)) * 1e6
    x[100:200] = x[:100]  # ties
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(300), "embedding": list(x)}))
    whole = [[int(v) for v in r] for r in np.floor(256 * x)]
    want = []
    for q in range(0, 300, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], r)), i) for i, r in enumerate(whole) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert rows(topk.exact_top_k(df, F.expr("vec_id % 50 = 0"))) == want


def test_ties_of_repeated_vectors_across_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(topk, "PART", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 33))[rng.integers(0, 60, 400)]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(400), "embedding": list(x)})).repartition(7)
    got = rows(ann.nearest(df, F.expr("vec_id % 20 = 0"), 20))
    assert all(a[3] > b[3] or a[3] == b[3] and a[2] < b[2] for a, b in zip(got, got[1:]) if a[0] == b[0])
    score = {(q, i): s for q, _, i, s in got}
    assert all(len({score[q, i] for q2, i in score if q2 == q and (x[i] == x[j]).all()}) == 1 for q, j in score)
    whole = np.floor(256 * x)
    want = ranked(np.arange(400), np.arange(0, 400, 50), whole[::50] @ whole.T, 5)
    assert rows(topk.exact_top_k(df, F.expr("vec_id % 50 = 0"))) == want


def test_repeated_query_ids_ask_once(spark):
    vs = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [5.0, -1.0]), (7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, [1.0, 1.0])] * 2
    df = spark.createDataFrame(vs, "vec_id long, embedding array<double>").repartition(4)
    for got, scale in ((rows(topk.exact_top_k(df, F.expr("vec_id = 0"))), 256**2), (rows(ann.nearest(df, F.expr("vec_id = 0"), 5)), 1)):
        assert [r for _, r, _, _ in got] == [1, 2, 3, 4, 5]
        one = [(i, s / scale) for _, _, i, s in got]
        assert one in ([(9, 3), (9, 3), (8, 2), (8, 2), (7, 1)], [(7, 5), (7, 5), (9, 4), (9, 4), (8, -1)])
