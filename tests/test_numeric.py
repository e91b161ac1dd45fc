import numpy as np
import pytest

from lexmill.operators import numeric as N


def test_stream_states(spark):
    got = [r.state for r in N.lcg(spark, 1599, 7).orderBy("i").collect()]
    assert got[:4] == [1025555898, 3923423697, 2630631676, 3981355051] and got[-1] == 1408674952
    s = N.Stream(7)
    s.next()
    assert s.state == got[0]


def test_normals_are_the_sequential_ones(spark):
    s = N.Stream(5)
    want = [s.normal() for _ in range(9)]
    got = [r.z for r in N.normals(spark, 9, 5).orderBy("i").collect()]
    assert np.allclose(got, want)


def test_rings():
    d = N.ring_points()
    assert len(d) == 320 and d.label.sum() == 160
    assert d.x[0] == pytest.approx(0.4307407, abs=1e-6) and d.y[0] == pytest.approx(0.4829568, abs=1e-6) and d.label[0] == 0


def test_noisy_points(spark):
    assert N.noisy_points(spark, 800, 99).selectExpr("sum(label) s").first().s == 339
    for n, want in ((20, 7), (200, 93), (2000, 894)):
        assert N.noisy_points(spark, n, 10 + n).selectExpr("sum(label) s").first().s == want
    assert N.noisy_pandas(200, 210).label.sum() == 93


def test_toy_bigrams(spark):
    got = N.toy_bigrams(spark).orderBy("i").collect()
    assert len(got) == 2700 and [(r.input, r.target) for r in got[:4]] == [(0, 8), (3, 12), (6, 1), (1, 10)]


def test_ring_models(spark):
    r = {x.model: x for x in N.ring_models(spark).collect()}
    assert r["logistic"].accuracy == pytest.approx(0.525) and r["logistic"].loss == pytest.approx(0.692364, abs=1e-3)
    assert r["logistic"].w0 == pytest.approx(-0.0115757, abs=1e-3) and r["logistic"].w1 == pytest.approx(-0.0890920, abs=1e-3)
    assert r["relu_16"].accuracy == 1.0 and r["relu_16"].loss == pytest.approx(0.10203, abs=1e-3)
    assert r["five_linear"].w1 == pytest.approx(-0.0890920, abs=1e-3) and r["five_relu"].loss == pytest.approx(0.00477, abs=1e-3)


def test_gap(spark):
    r = {x.n: x for x in N.gap(spark).collect()}
    assert r[20].train_loss == pytest.approx(0.02147, abs=1e-3) and r[20].test_loss == pytest.approx(2.25210, abs=2e-3)
    assert r[200].train_loss == pytest.approx(0.44746, abs=1e-3) and r[2000].test_loss == pytest.approx(0.52066, abs=1e-3)


def test_toy_neighbours(spark):
    e = N.toy_embeddings(spark).where("id < 8")
    got = {}
    for r in N.neighbours(e, e, 2, "id").collect():
        got.setdefault(N.TOY[r.id], []).append((r.rank, N.TOY[r.neighbour]))
    assert [w for _, w in sorted(got["cat"])] == ["dog", "cow"]
    assert sorted(got["apple"])[0][1] == "mango" and [w for _, w in sorted(got["eat"])] == ["see", "chase"]


def test_collapse_equals_layers():
    layers = N.new_layers([2, 3, 1], N.Stream(3), 0.3, 0.3)
    x = np.array([[0.2, -1.0], [1.0, 2.0]])
    w, b = N.collapse(layers)
    assert np.allclose(N.sigmoid(x @ w + b), N.forward(layers, x, True)[-1])
