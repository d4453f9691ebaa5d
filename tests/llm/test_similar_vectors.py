import numpy as np

from timelode.llm.forest import fit_forest, search_leaves
from timelode.llm.similar_vectors import Search, most_similar

DIMS = 16
SCHEMA = "id string, grp string, vec array<double>, k1 int, leaf string"


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 4, DIMS))
    x = centres[rng.integers(len(centres), size=n)] + 0.15 * rng.standard_normal((n, DIMS))
    return [(f"r{i:05d}", f"g{i // 3}", (v * rng.uniform(0.5, 3)).tolist(), 1, "x") for i, v in enumerate(x.round(3))]


def brute(rows, k, least):
    rows = sorted({r[0]: r for r in rows if r[0] and r[1] and r[2] and len(r[2]) == DIMS and all(v is not None and np.isfinite(v) for v in r[2]) and any(r[2])}.values())
    x = np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos, out = np.round(x @ x.T, 6), set()
    for i, row in enumerate(rows):
        near = sorted((-cos[i, j], other[0]) for j, other in enumerate(rows) if other[1] != row[1] and cos[i, j] >= least)
        out |= {(row[0], n, round(-c, 6)) for c, n in near[:k]}
    return out


def run(spark, rows, k=5, least=0.85, **kw):
    found = most_similar(spark.createDataFrame(rows, SCHEMA), row_id="id", group="grp", vector="vec", dims=DIMS, k=k, min_cosine=least, **kw)
    return {(r["row_id"], r["neighbour_id"], round(r["cosine"], 6)) for r in found.collect()}


def test_small_collection_is_exact_with_dirt(spark):
    rows = clustered(300)
    rows += rows[:20] + [("n1", "g", None, 1, "x"), ("n2", "g", [0.0] * DIMS, 1, "x"), ("n3", "g", [1.0] * 3, 1, "x"), ("n4", None, rows[0][2], 1, "x"), (None, "g", rows[0][2], 1, "x")]
    rows += [("n5", "g", [None] + [1.0] * (DIMS - 1), 1, "x"), ("n6", "g", [float("nan")] + [1.0] * (DIMS - 1), 1, "x")]
    assert run(spark, rows) == brute(rows, 5, 0.85)


def test_recall_of_the_forest(spark):
    rows = clustered(6000, seed=1)
    expected = brute(rows, 5, 0.85)
    got = run(spark, rows, search=Search(leaf=60, block=128, fit_sample=2000))
    assert len(got & expected) >= 0.95 * len(expected)
    assert len(got - expected) <= 0.05 * len(expected)


def test_a_vector_that_many_records_share(spark):
    rows = clustered(200, seed=2)
    shared = rows[7][2]
    rows += [(f"s{i:04d}", f"h{i % 90}", shared, 1, "x") for i in range(400)] + [(f"t{i:04d}", "one", rows[9][2], 1, "x") for i in range(50)]
    assert run(spark, rows) == brute(rows, 5, 0.85)


def test_empty_collection(spark):
    assert run(spark, []) == set()


def test_level_by_level_search_is_the_shared_queue():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    forest = fit_forest(x, trees=3, depth=4)
    leaves, own = search_leaves(forest, x[:50], 10)
    assert (own.sum(axis=1) == 3).all()
    inner = forest.leaves - 1
    for row, found in zip(x[:50], leaves, strict=True):
        cost = {}
        for t in range(3):
            stack = [(0, 0.0)]
            while stack:
                node, far = stack.pop()
                if node >= inner:
                    cost[t * forest.leaves + node - inner] = far
                    continue
                margin = float(row @ forest.planes[t, node] - forest.cuts[t, node])
                side = margin >= 0
                stack += [(2 * node + 1 + side, far), (2 * node + 2 - side, max(far, abs(margin)))]
        worst = max(cost[f] for f in found)
        assert sum(c < worst - 1e-5 for c in cost.values()) <= 10


def test_more_near_copies_and_scaled_copies_than_candidates(spark):
    rng = np.random.default_rng(5)
    rows = clustered(200, seed=5)
    one, two = rng.standard_normal((2, DIMS))
    rows += [(f"n{i:04d}", f"n{i}", (one + 1e-3 * rng.standard_normal(DIMS)).tolist(), 1, "x") for i in rng.permutation(300)]
    rows += [(f"s{i:04d}", f"s{i}", (two * (1 + int(i))).tolist(), 1, "x") for i in rng.permutation(100)]
    assert run(spark, rows) == brute(rows, 5, 0.85)


def test_a_shared_vector_whose_nearest_lie_in_one_of_its_groups(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(DIMS)
    rows = [("a", "hot", centre.tolist(), 1, "x"), ("b", "cold", centre.tolist(), 1, "x")]
    rows += [(f"h{i:03d}", "hot", (centre + 0.01 * rng.standard_normal(DIMS)).tolist(), 1, "x") for i in range(40)]
    rows += [(f"o{i:03d}", f"o{i}", (centre + 0.2 * rng.standard_normal(DIMS)).tolist(), 1, "x") for i in range(10)]
    expected = brute(rows, 5, 0.85)
    assert sum(r[0] == "a" for r in expected) == 5
    assert run(spark, rows) == expected
