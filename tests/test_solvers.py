"""Solvers whose operator is a Spark job, the fits by products, and the variational bound, against dense numpy."""

import json
import tracemalloc

import numpy as np
import pytest

from cohortscore.model import em, krylov, products
from cohortscore.model.krylov import BlockDiagonal, Status
from cohortscore.model.posterior import Dense, Sparse, trust_region
from cohortscore.model.products import Design
from cohortscore.plans import special
from cohortscore.plans.relation import build

from .conftest import SF


def _spd(n=200, seed=0, spread=50.0):
    rng = np.random.default_rng(seed)
    z = rng.standard_normal((2 * n, n))
    return z.T @ z / 20 + np.diag(rng.uniform(0.5, spread, n)), rng


def _blocks(a, size=20):
    return BlockDiagonal(np.diag(a), [(at, a[np.ix_(at, at)]) for at in (np.arange(i, min(i + size, len(a))) for i in range(0, len(a), size))])


@pytest.mark.parametrize("precondition", [False, True])
def test_block_conjugate_gradients(precondition):
    a, rng = _spd()
    b = rng.standard_normal((len(a), 6))
    b[:, 3], b[:, 4], b[:, 5] = b[:, 2], 0, b[:, 0] + b[:, 1]  # right sides that say nothing new
    calls = []
    got = krylov.block_cg(lambda v: calls.append(v.shape[1]) or a @ v, b, _blocks(a) if precondition else None, tol=1e-10)
    assert set(got.status) == {Status.CONVERGED} and np.allclose(got.x, np.linalg.solve(a, b), atol=1e-9) and (got.x[:, 4] == 0).all()
    assert len(calls) == got.steps + 1 and set(calls) == {6}  # one product a step for all right sides
    again = krylov.block_cg(lambda v: a @ v, b, _blocks(a) if precondition else None, tol=1e-8, start=got.x)
    assert again.steps == 0


def test_blocks_share_their_search_space():
    a, rng = _spd(300, 1, 3000.0)
    b = rng.standard_normal((300, 12))
    one = krylov.block_cg(lambda v: a @ v, b[:, :1]).steps
    many = krylov.block_cg(lambda v: a @ v, b).steps
    better = krylov.block_cg(lambda v: a @ v, b, _blocks(a)).steps
    assert better < many < one


def test_status_codes():
    a, rng = _spd()
    b = rng.standard_normal((len(a), 2))
    assert krylov.block_cg(lambda v: a @ v, b, steps=2).status == [Status.STEPS] * 2
    bad = krylov.block_cg(lambda v: a @ v - 60 * v, np.column_stack([b[:, 0], 0 * b[:, 0]]))
    assert bad.status == [Status.INDEFINITE, Status.CONVERGED]  # zero is solved by zero
    assert krylov.block_cg(lambda v: a @ v, b, tol=1e-22, steps=4000).status == [Status.STAGNATED] * 2
    noise = np.random.default_rng(1)
    noisy = krylov.block_cg(lambda v: a @ v * (1 + 1e-3 * noise.standard_normal(v.shape)), b, tol=1e-12)
    assert Status.CONVERGED not in noisy.status and noisy.residuals.max() < 0.1


def test_preconditioner_of_blocks():
    a, rng = _spd(50)
    m = BlockDiagonal(np.diag(a), [(np.array([3, 9, 4]), a[np.ix_([3, 9, 4], [3, 9, 4])])])
    dense = np.diag(np.diag(a))
    dense[np.ix_([3, 9, 4], [3, 9, 4])] = a[np.ix_([3, 9, 4], [3, 9, 4])]
    x = rng.standard_normal((50, 2))
    assert np.allclose(m.solve(x), np.linalg.solve(dense, x)) and np.allclose(m.times(x), dense @ x) and np.allclose(m.solve_upper(m.upper(x)), x)
    assert np.allclose(m.inverse_diagonal(), np.diag(np.linalg.inv(dense))) and m.log_determinant() == pytest.approx(np.linalg.slogdet(dense)[1])


def test_region_steps():
    a, rng = _spd()
    g, m = rng.standard_normal(len(a)), _blocks(a)
    free = krylov.region_step(lambda v: a @ v, g, m, 1e9, 1e-12, 500)
    want = -np.linalg.solve(a, g)
    assert np.allclose(free.move, want, atol=1e-9) and not free.edge and free.model == pytest.approx(-g @ want / 2)
    l = np.linalg.cholesky(m.times(np.eye(len(a))))
    inner = np.linalg.inv(l)
    assert 1 < free.condition < 1.05 * np.linalg.cond(inner @ a @ inner.T)
    radius = 0.3 * np.linalg.norm(m.upper(want))
    held = krylov.region_step(lambda v: a @ v, g, m, radius, 1e-12, 500)
    assert held.edge and np.linalg.norm(m.upper(held.move)) == pytest.approx(radius) and 0 < held.model < free.model
    lost = krylov.region_step(lambda v: a @ v - 500 * v, g, m, 2.0, 1e-12, 500)
    assert lost.edge and np.linalg.norm(m.upper(lost.move)) == pytest.approx(2.0) and lost.model > 0


def test_steps_that_a_tolerance_asks_for():
    assert krylov.inner_steps(1e-6, 100.0) == int(np.ceil(5 * np.log(2e6))) and krylov.inner_steps(0.5, 1.0) == 4 and krylov.inner_steps(1e-12, 1e9) == 256
    a, rng = _spd(150, 3)
    b = rng.standard_normal(150)
    x, c = np.linalg.solve(a, b), np.linalg.cond(a)
    got = krylov.region_step(lambda v: a @ v, -b, BlockDiagonal(np.ones(150)), 1e9, 0.0, krylov.inner_steps(1e-3, c, most=10_000)).move
    assert (got - x) @ a @ (got - x) <= 1e-6 * x @ a @ x  # the bound that the number is from
    for bad in ((1.0, 4.0), (0.0, 4.0), (0.1, 0.5)):
        with pytest.raises(ValueError):
            krylov.inner_steps(*bad)


def test_mixing_is_faster_and_goes_on_from_its_state():
    rng = np.random.default_rng(2)
    g, c = np.diag(rng.uniform(0, 0.97, 40)), rng.standard_normal(40)
    want = np.linalg.solve(np.eye(40) - g, c)

    def run(steps, mix, x):
        for i in range(steps):
            if np.abs(g @ x + c - x).max() < 1e-9:
                return i, x, mix
            x = mix.propose(x, g @ x + c)
        return steps, x, mix

    fast, x, _ = run(500, krylov.Mixing(5, ridge=1e-10), np.zeros(40))
    plain, y, _ = run(2000, krylov.Mixing(0), np.zeros(40))
    assert np.allclose(x, want, atol=1e-6) and np.allclose(y, want, atol=1e-6) and fast * 5 < plain
    _, part, mix = run(10, krylov.Mixing(5, ridge=1e-10), np.zeros(40))
    rest, z, _ = run(500, krylov.Mixing(5, json.loads(json.dumps(mix.state())), ridge=1e-10), part)
    assert 10 + rest == fast and np.allclose(z, x)
    mix.forget()
    assert len(mix.xs) == 1


# Products over rows


def _rows(spark, n, p, seed=5, binary=True, rare=(0.02, 0.3)):
    rng = np.random.default_rng(seed)
    maf = rng.uniform(*rare, p)
    d = rng.binomial(2, maf, (n, p))
    mean, scale = d.mean(0), np.maximum(d.std(0), 1e-6)
    beta = np.zeros(p)
    beta[rng.choice(p, 10, False)] = 0.4 * rng.standard_normal(10)
    z = (d - mean) / scale
    cov = rng.standard_normal(n)
    y = (rng.random(n) < 1 / (1 + np.exp(-(z @ beta)))).astype(float) if binary else z @ beta + rng.standard_normal(n)
    data = []
    for i in range(n):
        at = np.flatnonzero(d[i])
        data.append(([1.0, float(cov[i])], float(y[i]), at.tolist() if len(at) else None, z[i, at].tolist() if len(at) else None))
    rows = spark.createDataFrame(data, "c array<double>, y double, at array<int>, z array<double>").repartition(3).persist()
    return rows, -mean / scale, np.column_stack([np.ones(n), cov, z]), y


def test_products_are_those_of_the_dense_matrix(spark):
    rows, zero, x, y = _rows(spark, 120, 30, rare=(0.0, 0.05))
    design = Design(rows, zero, 2)
    v = np.random.default_rng(1).standard_normal((32, 5))
    mu = 1 / (1 + np.exp(-x @ v[:, 0]))
    w = mu * (1 - mu)
    assert np.allclose(design.gram(v), x.T @ (x @ v)) and np.allclose(design.gram(v[:, 1:2], v[:, 0]), x.T @ (w[:, None] * (x @ v[:, 1:2])))
    assert np.allclose(design.gram(v[:, 1:], v[:, 0]), x.T @ (w[:, None] * (x @ v[:, 1:])))
    g, ll, weight, n = design.slope(v[:, 0])
    assert np.allclose(g, x.T @ (y - mu)) and ll == pytest.approx(np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))) and (weight, n) == (pytest.approx(w.mean()), 120)
    assert np.allclose(design.squares(), (x[:, 2:] ** 2).sum(0)) and np.allclose(design.target()[0], x.T @ y)
    assert design.loss(v[:, 0], False)[0] == pytest.approx(((y - x @ v[:, 0]) ** 2).sum()) and design.loss(v[:, 0], True)[0] == pytest.approx(-ll)
    spread = x[:, 2:] ** 2 @ np.full(30, 0.3)
    xi = np.sqrt((x @ v[:, 0]) ** 2 + spread)
    assert design.bound(v[:, 0], np.full(30, 0.3)) == (pytest.approx(((y - 0.5) * (x @ v[:, 0]) - xi / 2 - np.log1p(np.exp(-xi))).sum()), pytest.approx(spread.sum()))
    assert design.passes == 9


def test_cells_in_many_steps(monkeypatch):
    rng = np.random.default_rng(0)
    x = np.where(rng.random((50, 20)) < 0.2, rng.standard_normal((50, 20)), -0.5)
    row, at = np.nonzero(x != -0.5)
    cells = products.Cells(np.ones((50, 1)), np.zeros(50), row, at, x[row, at])
    whole, zero = np.column_stack([np.ones(50), x]), np.full(20, -0.5)
    for size in (7, 1 << 20):
        monkeypatch.setattr(products, "CELLS", size)
        for m in (1, 3):
            v, r, total = rng.standard_normal((21, m)), rng.standard_normal((50, m)), np.zeros((22, m))
            assert np.allclose(cells.times(v, zero), whole @ v)
            cells.add_to(total, r, zero)
            assert np.allclose(total[:-1] + np.r_[0, zero][:, None] * total[-1], whole.T @ r)


def test_trust_region_finds_the_mode(spark):
    rows, zero, x, y = _rows(spark, 300, 40)
    design, precision = Design(rows, zero, 2), np.r_[1e-8, 1e-8, np.full(40, 20.0)]
    squares = np.r_[np.full(2, 300.0), design.squares()]
    found = trust_region(design, precision, np.full(42, 0.7), lambda d, w: BlockDiagonal(w * squares + d), tol=1e-9, radius=0.5)
    mu = 1 / (1 + np.exp(-x @ found.x))
    assert found.converged and np.abs(x.T @ (y - mu) - precision * found.x).max() < 1e-5
    assert found.objective == pytest.approx(np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu)) - precision @ found.x**2 / 2)
    with pytest.raises(RuntimeError, match="did not get to the mode"):
        trust_region(design, precision, np.full(42, 3.0), lambda d, w: BlockDiagonal(w * squares + d), steps=2, radius=1e-6)


@pytest.mark.parametrize("binary", [False, True])
def test_fit_by_products_is_the_dense_fit(spark, binary):
    p = 200
    rows, zero, x, _ = _rows(spark, 400, p, binary=binary)
    blocks = [(np.arange(i, i + 20), x[:, 2 + i : 22 + i].T @ x[:, 2 + i : 22 + i]) for i in range(0, p, 20)]
    args = (rows, zero, 2, np.full(p, 0.05), np.full(p, 0.7), np.full(p, 0.5))
    dense = em.fit(*args, binary=binary, iterations=3, tol=0.0)
    own = em.fit(*args, binary=binary, iterations=3, tol=0.0, products=True, blocks=blocks)
    assert np.abs(own.beta - dense.beta).max() < 1e-6 and np.abs(own.beta_variance - dense.beta_variance).max() < 1e-6
    assert own.global_scale == pytest.approx(dense.global_scale, rel=1e-6) and np.allclose(own.history, dense.history, rtol=1e-6)


def test_variances_by_probes(spark):
    """More coordinates than exact solves: within a few per cent of the dense ones."""
    p = 600
    rows, zero, x, _ = _rows(spark, 300, p, binary=False)
    precision = np.r_[1e-8, 1e-8, np.full(p, 400.0)]
    got = Sparse(rows, zero, 2, False).solve(precision, np.zeros(p + 2), 1.0, True)
    want = Dense(rows, zero, 2, False).solve(precision, np.zeros(p + 2), 1.0, True)
    assert np.allclose(got.x, want.x, atol=1e-6) and np.median(np.abs(got.variance / want.variance - 1)[2:]) < 0.05
    assert got.error == pytest.approx(want.error, rel=0.02)


def test_log_determinant_of_the_posterior(spark):
    p = 2000
    rows, zero, x, _ = _rows(spark, 200, p)
    sparse = Sparse(rows, zero, 2, True)
    precision = np.r_[1.0, 1.0, np.full(p, 30.0)]
    value, error = sparse.log_determinant(precision, np.zeros(p + 2), probes=8, steps=10)
    want = np.linalg.slogdet(x.T @ x / 4 + np.diag(precision))[1]
    assert value == pytest.approx(want, rel=0.01) and error < 0.01 * want


def test_twenty_thousand_variants_without_a_matrix(spark):
    n, p = 150, 20_000
    rng = np.random.default_rng(3)
    maf = rng.uniform(0.002, 0.02, p)
    mean, scale = 2 * maf, np.sqrt(2 * maf * (1 - maf))
    data = []
    for i in range(n):
        d = rng.binomial(2, maf)
        at = np.flatnonzero(d)
        data.append(([1.0], float(d[:50].sum() > 1), at.tolist(), ((d[at] - mean[at]) / scale[at]).tolist()))
    rows = spark.createDataFrame(data, "c array<double>, y double, at array<int>, z array<double>").repartition(4).persist()
    tracemalloc.start()
    got = em.fit(rows, -mean / scale, 1, np.full(p, 0.01), np.full(p, 0.7), np.full(p, 0.5), binary=True, iterations=2, products=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got.beta) == p and np.isfinite(got.beta).all() and (got.beta_variance > 0).all() and np.abs(got.beta[:50]).mean() > np.abs(got.beta[50:]).mean()
    assert peak < 600e6  # a matrix of all variants would be 3.2e9 bytes


def test_mixing_takes_fewer_iterations_to_the_same_fit(spark):
    p = 30
    rows, zero, _, _ = _rows(spark, 300, p, binary=False)
    args = (rows, zero, 2, np.full(p, 0.05), np.full(p, 0.7), np.full(p, 0.5))
    plain = em.fit(*args, iterations=4000, tol=1e-7)
    kept = []
    mixed = em.fit(*args, iterations=4000, tol=1e-7, mixing=8, keep=lambda s: kept.append(json.loads(json.dumps(s))), keep_every=5)
    assert plain.converged and mixed.converged and len(mixed.history) * 5 < len(plain.history) and np.abs(plain.beta - mixed.beta).max() < 2e-3
    again = em.fit(*args, iterations=4000, tol=1e-7, mixing=8, state=kept[0])
    assert len(again.history) == len(mixed.history) and np.allclose(again.beta, mixed.beta, atol=1e-8)


@pytest.mark.parametrize("binary", [False, True])
def test_the_bound(spark, binary):
    rows, zero, x, y = _rows(spark, 200, 10, binary=binary)
    rng = np.random.default_rng(4)
    tau = np.full(10, 0.05)
    solver = Dense(rows, zero, 2, binary)
    at = solver.solve(np.r_[1e-8, 1e-8, 1 / tau], np.zeros(12), 1.0, True)
    weight = 0.25 if binary else 1.0
    own = 1 / (weight * (x[:, 2:] ** 2).sum(0) + 1 / tau)
    error = None if binary else 1.0
    best = em.bound(rows, zero, at.x, own, tau, 2, error)
    assert best["bound"] == pytest.approx(best["data"] + best["prior"] + best["entropy"])
    if not binary:  # the bound is highest at the mean-field optimum, and never above the evidence
        for _ in range(5):
            other = em.bound(rows, zero, at.x + 0.05 * rng.standard_normal(12), own * rng.uniform(0.5, 2, 10), tau, 2, error)
            assert other["bound"] < best["bound"]
        cov = np.eye(200) + (x[:, 2:] * tau) @ x[:, 2:].T
        left = y - x[:, :2] @ at.x[:2]
        evidence = -0.5 * (200 * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + left @ np.linalg.solve(cov, left))
        assert best["bound"] <= evidence + 1e-6
    else:  # not above the expected log-likelihood, by sampling
        draws = at.x[None, :] + np.column_stack([np.zeros((400, 2)), rng.standard_normal((400, 10)) * np.sqrt(own)])
        eta = draws @ x.T
        assert best["data"] <= (y * eta - np.logaddexp(0, eta)).sum(1).mean() + 0.5


def test_registered_solve_and_determinant(spark):
    got = special.cg_solve(spark, SF).toPandas().sort_values("variant_id")
    assert set(got["status"]) == {"CONVERGED"}
    s = build(spark, SF, "samples").toPandas().set_index("sample_id")
    few = special.reduced_variants(spark, SF, {}).toPandas().set_index("variant_id").loc[got["variant_id"]]
    z = np.tile((-few["mean"] / few["scale"]).to_numpy(), (len(s), 1))
    rows, cols = {k: i for i, k in enumerate(s.index)}, {k: i for i, k in enumerate(few.index)}
    for c in build(spark, SF, "calls").toPandas().itertuples():
        if c.variant_id in cols and c.sample_id in rows:
            j = cols[c.variant_id]
            z[rows[c.sample_id], j] = 0.0 if np.isnan(c.dosage) else (c.dosage - few["mean"].iloc[j]) / few["scale"].iloc[j]
    classes = build(spark, SF, "variants").toPandas().set_index("variant_id")["variant_class"]
    base = np.exp([special.CLASS_PRIORS[classes.get(v, "snv")][0] for v in few.index])
    a = z.T @ z / 4 + np.diag(1 / base**2)
    rhs = z.T @ np.column_stack([s["y"] / 1000, s["cov"], s["target"]])
    want = np.linalg.solve(a, rhs)
    assert np.allclose(got[["of_y", "of_cov", "of_target"]].to_numpy(), want, atol=1e-8)
    row = special.posterior_logdet(spark, SF).first()
    c = np.column_stack([np.ones(len(s)), s["cov"]])
    whole = np.column_stack([c, z])
    value = np.linalg.slogdet(whole.T @ whole / 4 + np.diag(np.r_[1e-8, 1e-8, 1 / base**2]))[1]
    assert row["n_variants"] == len(few) and abs(row["logdet"] - value) < 5 * row["standard_error"] + 0.01 * abs(value)
