"""Density clusters found over cells of rows are those found in one matrix."""

import numpy as np

from tidemark.operators import density as dn
from tidemark.operators import evaluate
from tidemark.operators import themes as th
from tidemark.plans.batch import run_batch


def planted(rng, sizes, noise, dims=6):
    centres = rng.standard_normal((len(sizes), dims)) * 6
    x = np.concatenate([c + 0.4 * rng.standard_normal((k, dims)) for c, k in zip(centres, sizes)] + [rng.uniform(-12, 12, (noise, dims))])
    x[1::9] = x[0::9][: len(x[1::9])]  # repeats, for equal distances
    return x.astype(np.float32)


def same_groups(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b)) and all((x < 0) == (y < 0) for x, y in zip(a, b))


def test_no_size_changes_the_clusters(spark):
    rng = np.random.default_rng(3)
    x = planted(rng, [60, 45, 30] + [20] * 12, 60)
    df = spark.createDataFrame([(int(i) * 7, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    one, many = (th.micro_clusters(df, p=th.Params(exact_density_most=most, cells=dn.Cells(rows=40, queries=60, top=100))).orderBy("vec_id").collect() for most in (5000, 10))
    a, b = [r.micro for r in one], [r.micro for r in many]
    assert [r.vec_id for r in one] == [r.vec_id for r in many] and same_groups(a, b) and a == b
    assert len(set(a) - {-1}) >= 14  # small themes stay apart
    assert min(a.count(c) for c in set(a) - {-1}) >= dn.min_cluster_size(len(x))


def test_tree_is_that_of_all_pairs():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (70, 3)).astype(float)
    core = dn.core_distances(x, 3)[:, -1]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert np.array_equal(core, np.sort(d, 1)[:, 3])
    i, j = np.triu_indices(len(x), 1)
    w = np.maximum(d[i, j], np.maximum(core[i], core[j]))
    want = {(int(i[k]), int(j[k])) for k in dn.forest(i, j, w)}
    a, b, _ = dn.spanning_tree(x, core)
    assert len(want) == len(x) - 1 and {(int(p), int(q)) for p, q in zip(a, b)} == want


def test_the_batch_finds_what_was_planted(spark):
    tables = run_batch(spark, "synthetic")
    reviews = tables["reviews"]
    found = {r.planted: (r.observed_status, r.detected) for r in evaluate.radar_recall(tables["issues"], reviews).collect()}
    assert set(found) == set(evaluate.PLANTED) and sum(ok for _, ok in found.values()) >= 4 and found["payment_failure"] == ("NEW", True), found
    assert evaluate.theme_recovery(reviews, "gt_theme", "theme_id").first().theme_recall >= 0.9
    assert tables["reports"].where("key = 'traceability'").first().data.count("PASS") == 1
