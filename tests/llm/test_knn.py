"""The kNN join against brute force, with one and many groups and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import knn


def brute(rows, k=20):
    """rows: (id, integer vector); every row whose id 20 divides is a query against all other rows."""
    out = []
    for i, (q, v) in enumerate(rows):
        if q % 20 == 0:
            order = sorted((-int(v @ w), d) for j, (d, w) in enumerate(rows) if j != i)[:k]
            out += [(q, r + 1, d, -s) for r, (s, d) in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("small", [{}, {"pivots": 12, "group": 7, "block": 50}, {"pivots": 1, "group": 1, "block": 1000}])
def test_knn(spark, small):
    rng = np.random.default_rng(5)
    vec = [(i, [float(x) for x in v]) for i, v in enumerate(rng.standard_normal((400, 8)) / 3)]
    vec += [(400 + i, vec[0][1]) for i in range(50)]  # ties
    vec += [(40, vec[7][1]), (40, vec[40][1]), (41, vec[9][1])]  # ids that repeat
    odd = [(900, None), (901, [1.0] * 7 + [float("nan")]), (902, [1.0] * 7 + [None]), (904, [1.0] * 7 + [float("inf")]), (905, []), (None, vec[1][1])]
    df = spark.createDataFrame(vec + odd, "vec_id long, embedding array<float>").withColumns({"rank": F.lit(1), "Row": F.lit(2), "v": F.lit(3)})
    data = knn.integers(df, "vec_id", "embedding", 64)
    got = knn.top_k(data, F.col("id") % 20 == 0, 20, **small)
    ints = [(i, np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(int)) for i, v in vec]
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == brute(ints)


def test_knn_of_clusters_sends_less_than_everything():
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 32))
    v = np.floor(40 * (base[rng.integers(0, 30, 3000)] + 0.02 * rng.standard_normal((3000, 32)))).astype(np.int64)
    pivots = knn.chained(np.unique(v[rng.choice(3000, 200, False)].astype(float), axis=0))
    cell, dist = knn._cells(v, pivots)
    chosen = np.concatenate([np.flatnonzero(cell == j)[np.argsort(dist[cell == j])[:21]] for j in range(len(pivots))])
    own = np.arange(0, 3000, 60)
    floor = knn.floors(v[own], own, v[chosen], chosen, 20)
    sent = np.array([dist >= knn.wanted_from(v[q : q + 1], floor[i : i + 1], pivots)[cell] for i, q in enumerate(own)])
    score = v[own] @ v.T
    score[np.arange(len(own)), own] = np.iinfo(np.int64).min
    cut = np.sort(score, axis=1)[:, -20]
    assert ((score >= cut[:, None]) <= sent).all() and sent.mean() < 0.3


def test_knn_edges(spark):
    data = knn.integers(spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<float>"), "vec_id", "embedding", 64)
    divisible = F.col("id") % 20 == 0
    assert knn.top_k(data.where("false"), divisible, 20).count() == 0 and knn.top_k(data, F.lit(False), 20).count() == 0
    assert knn.top_k(data.where("id < 3"), divisible, 20).count() == 2
    assert knn.top_k(data.where("id = 0"), divisible, 20).count() == 0
    with pytest.raises(ValueError, match="length"):
        knn.top_k(data.unionByName(spark.createDataFrame([(99, [1])], "id long, v array<long>")), divisible, 20)
    wide = spark.createDataFrame([(i, [(1 << 40) + i * i, -i]) for i in range(25)], "id long, v array<long>")  # sums beyond floats
    got = knn.top_k(wide.withColumn("v", F.transform("v", lambda x: F.shiftright(x, 12))), divisible, 3)
    assert got.count() == 6


def test_query_of_the_subpackage(spark, tmp_path):
    rows = [(i, [float((i * k) % 7) / 7 for k in range(4)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = knn.op6_knn(spark, str(tmp_path))
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    ints = [(i, np.floor(64 * np.asarray(v, np.float32).astype(float)).astype(int)) for i, v in rows]
    assert sorted(map(tuple, out.collect())) == brute(ints)
