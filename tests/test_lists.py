"""Learning of lists: the order of components, coded centroids, relative and absolute codes, against plain arithmetic."""

import numpy as np
import pytest

from tessera.operators import lists
from tessera.operators import quantization as pq

N, D = 600, 8


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    half = rng.normal(size=(N, D // 2))
    m = np.hstack([half, half + rng.normal(scale=0.05, size=half.shape)])  # component i goes with i + 4
    return m, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "vec_id long, vec array<double>").repartition(3).cache()


def test_order_joins_what_is_correlated(points):
    order = lists.component_order(points[1], 4)
    assert sorted(order) == list(range(D))
    assert all(abs(order[i] - order[i + 1]) == 4 for i in range(0, D, 2))
    with pytest.raises(ValueError):
        lists.component_order(points[1], 3)


@pytest.mark.parametrize("relative, coarse", [(True, None), (False, None), (True, 4)])
def test_order_lowers_the_error(points, relative, coarse):
    m, rows = points
    found = [lists.learn(rows, 8, 4, 8, 3, relative, coarse, order) for order in (False, True)]
    plain, ordered = (lists.error(rows, model) for model in found)
    assert ordered < plain * 0.8
    model = found[1]
    own = m[:, model.order]
    of = ((own[:, None] - model.centroids[None]) ** 2).sum(2).argmin(1)
    rest = own - model.centroids[of] if relative else own
    made = model.quantizer.decode(model.quantizer.encode(rest))
    assert np.isclose(ordered, ((rest - made) ** 2).sum(1).mean())
    if coarse:
        assert model.codes.shape == (8, 4) and model.codes.max() < 4
        assert all(len(np.unique(model.centroids[:, q * 2 : q * 2 + 2], axis=0)) <= 4 for q in range(4))


@pytest.mark.parametrize("relative", [True, False])
def test_search_is_that_of_all_codes_in_the_lists(points, relative):
    m, rows = points
    model = lists.learn(rows, 8, 4, 8, 2, relative)
    queries = rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    found = lists.search(queries, lists.build(rows, model), model, 3, 5).collect()
    own = m[:, model.order]
    far = ((own[:, None] - model.centroids[None]) ** 2).sum(2)
    of, at = far.argmin(1), model.centroids if relative else np.zeros_like(model.centroids)
    made = model.quantizer.decode(model.quantizer.encode(own - at[of])) + at[of]
    for q in range(0, N, 20):
        probed = np.argsort(far[q], kind="stable")[:3]
        d = [(round(float(((own[q] - made[i]) ** 2).sum()), 6), i) for i in np.flatnonzero(np.isin(of, probed))]
        got = sorted((r["rnk"], round(r["d2"], 6)) for r in found if r["query_id"] == q)
        assert np.allclose([x for _, x in got], [x for x, _ in sorted(d)[:5]], atol=1e-5)
