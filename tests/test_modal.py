"""Closed forms, invariants and published spectra."""

import numpy as np
import pytest

from eigenflux import from_array
from eigenflux.functions import numeric
from eigenflux.operators import lifts, modal, reports, tall
from eigenflux.sources import generate

#: Energy fractions and DMD magnitudes of the wake 100 x 50 x 500 (seed 42), gyre 80 x 40 x 200.
WAKE = [0.48750505063134514, 0.4311000310138392, 0.0002800704229744001]
GYRE = [0.9719599792380467, 0.028000084292218962, 3.977899687911923e-05]
GYRE_DMD = [0.9999999999999997, 0.9980068533314912, 0.9920353585932681]


def wide(table, key, column="re"):
    return table.toPandas().pivot(index=key, columns="mode", values=column).to_numpy()


def field(seed=0, n=40, m=12):
    rng = np.random.default_rng(seed)
    t, x = np.arange(n)[:, None], np.linspace(0, 1, m)[None, :]
    return 3 + np.sin(0.4 * t) * np.sin(np.pi * x) + 0.5 * np.cos(0.9 * t) * np.sin(2 * np.pi * x) + 0.1 * rng.standard_normal((n, m))


@pytest.mark.parametrize("shape", [(40, 12), (12, 40)])
@pytest.mark.parametrize("solver", ["eigh", "svd"])
def test_pod_identities(spark, shape, solver):
    q = field(n=shape[0], m=shape[1])
    w = np.linspace(0.5, 2, shape[1])
    w[3] = 0.0
    data = from_array(spark, q, 0.1, w=w)
    r = modal.pod(data, n_modes=50, solver=solver)
    c = q - q.mean(0)
    lam = r.eig.orderBy("mode").toPandas()["lambda_re"].to_numpy()
    expected = np.linalg.svd(c * np.sqrt(w), compute_uv=False) ** 2 / len(q)
    assert np.allclose(lam, expected[: len(lam)], rtol=1e-9)
    assert np.isclose(r.attrs["total_energy"], (c**2 * w).sum() / len(q))
    phi, a = wide(r.modes, "s"), wide(r.coef, "t")
    assert np.allclose(phi.T @ (phi * w[:, None]), np.eye(phi.shape[1]), atol=1e-9)
    assert np.allclose(a.T @ a / len(q), np.diag(lam), atol=1e-9)
    assert np.allclose((a @ phi.T)[:, w > 0], c[:, w > 0], atol=1e-8)
    assert (phi[3] == 0).all()
    top = numeric.pivot(np.abs(phi))
    assert (phi[top, np.arange(phi.shape[1])] > 0).all()


def test_partitions_do_not_matter(spark):
    data = from_array(spark, field(), 0.1)
    one = modal.pod(data).eig.orderBy("mode").toPandas()["lambda_re"]
    from dataclasses import replace

    many = modal.pod(replace(data, long=data.long.repartition(7))).eig.orderBy("mode").toPandas()["lambda_re"]
    assert np.allclose(one, many, rtol=1e-12)


def test_published_spectra(spark):
    r = modal.pod(generate(spark, "double_gyre"), n_modes=8)
    assert np.allclose(r.eig.orderBy("mode").toPandas()["fraction"][:3], GYRE, rtol=1e-6)
    d = modal.dmd(generate(spark, "double_gyre"), rank=8)
    assert np.allclose(d.eig.orderBy("mode").toPandas()["abs"][:3], GYRE_DMD, rtol=1e-6)
    t = generate(spark, "taylor_green", {"Nx": 24, "Ny": 24, "Nt": 60})
    for method in ("ls", "tls"):
        e = modal.dmd(t, rank=1, method=method).eig.first()
        assert np.isclose(e["lambda_re"], t.meta["dmd_eigenvalue"], rtol=1e-10)


def test_wake_frequency(spark):
    data = generate(spark, "cylinder_wake", {"Nx": 40, "Ny": 24, "Nt": 400})
    e = modal.dmd(data, rank=10).eig.toPandas()
    shed = data.meta["f_shed"]
    assert abs(e["freq"].abs() - shed).min() < 1e-3


@pytest.mark.parametrize("method", ["ls", "tls"])
@pytest.mark.parametrize("delays", [1, 2, 3])
def test_linear_system(spark, method, delays):
    a = np.array([[0.9, 0.1], [-0.1, 0.8]])
    x = [np.array([1.0, 0.5])]
    for _ in range(50):
        x.append(a @ x[-1])
    data = from_array(spark, np.array(x), 1.0)
    r = modal.dmd(data, rank=2, method=method, delays=delays)
    e = r.eig.orderBy("mode").toPandas()
    got = e["lambda_re"].to_numpy() + 1j * e["lambda_im"].to_numpy()
    want = np.linalg.eigvals(a)
    assert np.allclose(np.sort_complex(got), np.sort_complex(want.astype(complex)), atol=1e-7)
    if delays == 1:
        m = r.modes.toPandas()
        phi = np.zeros((2, 2), complex)
        for row in m.itertuples():
            phi[row.s, row.mode] = row.re + 1j * row.im
        b = e["amplitude_re"].to_numpy() + 1j * e["amplitude_im"].to_numpy()
        assert np.allclose(phi @ b, x[0], atol=1e-7)


def test_wide_and_tall_dmd_agree(spark):
    q = field(n=10, m=30)
    r = modal.dmd(from_array(spark, q, 1.0), rank=4).eig.orderBy("mode").toPandas()
    u, s, vt = np.linalg.svd(q[:-1].T, full_matrices=False)
    small = u[:, :4].T @ q[1:].T @ vt[:4].T / s[:4]
    want = np.linalg.eigvals(small)
    want = want[numeric.spectrum_order(want)]
    assert np.allclose(r["lambda_re"] + 1j * r["lambda_im"], want, atol=1e-9)


def test_rank_is_asked_for(spark):
    data = from_array(spark, field(), 0.1)
    with pytest.raises(ValueError):
        modal.dmd(data, rank=None)
    with pytest.raises(ValueError):
        modal.hodmd(data, rank=2, delays=1)


def test_stpod_is_hankel_svd(spark):
    for n, m in ((30, 3), (12, 20)):
        q = field(n=n, m=m)
        c = q - q.mean(0)
        lifted = np.concatenate([c[k : n - 2 + k] for k in range(3)], 1)
        want = np.linalg.svd(lifted, compute_uv=False) ** 2 / (n - 2)
        r = modal.stpod(from_array(spark, q, 1.0), delays=3, n_modes=5)
        assert np.allclose(r.eig.orderBy("mode").toPandas()["lambda_re"], want[:5], rtol=1e-9)
        assert np.isclose(r.attrs["total_energy"], want.sum())
        inner = reports.orthogonality(from_array(spark, q, 1.0), r).toPandas()
        assert np.allclose(inner["inner"], (inner["i"] == inner["j"]).astype(float), atol=1e-8)


def tones(n=128, nfft=16):
    """Two Walsh shapes: bin 3 with amplitude 3, bin 5 with amplitude 2."""
    t = np.arange(n)
    s1, s2 = np.array([1, 1, 1, 1]) / 2, np.array([1, -1, 1, -1]) / 2
    return 3 * np.cos(2 * np.pi * 3 * t / nfft)[:, None] * s1 + 2 * np.cos(2 * np.pi * 5 * t / nfft)[:, None] * s2


@pytest.mark.parametrize("window", ["boxcar", "hann", "hamming"])
def test_spod_closed_form(spark, window):
    dt = 0.5
    r = modal.spod(from_array(spark, tones(), dt), nfft=16, overlap=0.0, window=window, norm="amplitude", length=2.0, speed=4.0)
    e = r.eig.where("mode = 0").orderBy("f").toPandas()["lambda_re"].to_numpy()
    step = 1 / (16 * dt) * 2 / 4
    assert np.isclose(e[3], (3 / 2) ** 2 / step, rtol=1e-9)
    assert np.isclose(e[5], (2 / 2) ** 2 / step, rtol=1e-9)
    assert reports.peak(r).first()["f"] == 3


def test_spod_modes_are_orthonormal(spark):
    data = from_array(spark, field(n=120, m=5), 1.0)
    r = modal.spod(data, nfft=16)
    m = r.modes.where("f = 2").toPandas()
    phi = np.zeros((5, int(m["mode"].max()) + 1), complex)
    for row in m.itertuples():
        phi[row.s, row.mode] = row.re + 1j * row.im
    live = np.linalg.norm(phi, axis=0) > 0
    g = phi[:, live].conj().T @ phi[:, live]
    assert np.allclose(g, np.eye(len(g)), atol=1e-7)


def test_psd_pod_rebuilds_the_ensemble(spark):
    q = field(n=60, m=6)
    data = from_array(spark, q, 1.0)
    r = modal.psd_pod(data, nfft=16, n_modes=200)
    welch = lifts.Welch(60, 1.0, 16)
    e = welch.transform(q.T).reshape(6, -1).T
    phi, a = np.zeros((6, r.eig.count()), complex), np.zeros((len(e), r.eig.count()), complex)
    for row in r.modes.toPandas().itertuples():
        phi[row.s, row.mode] = row.re + 1j * row.im
    for row in r.coef.toPandas().itertuples():
        a[row.f * welch.blocks + row.b, row.mode] = row.re + 1j * row.im
    assert np.allclose(a @ phi.conj().T, e, atol=1e-8)


def test_mpod_bands(spark):
    data = from_array(spark, field(n=60), 1.0)
    assert np.allclose(
        modal.mpod(data, [0.0, 0.5]).eig.orderBy("mode").toPandas()["lambda_re"], modal.pod(data).eig.orderBy("mode").toPandas()["lambda_re"]
    )
    r = modal.mpod(data, [0.0, 0.4, 1.0], scale="normalized_nyquist", n_modes=100)
    assert np.isclose(r.attrs["energy_captured_fraction"], 1.0)
    with pytest.raises(ValueError):
        modal.mpod(data, [0.2, 0.1])
    with pytest.raises(ValueError):
        modal.mpod(data, [0.0, 0.6])


def test_bsmd_resonance(spark):
    rng = np.random.default_rng(1)
    n, nfft = 1024, 32
    t = np.arange(n)
    shapes = rng.standard_normal((3, 6))
    q = sum(np.cos(2 * np.pi * k * t / nfft)[:, None] * s for k, s in zip((3, 5, 8), shapes))
    r = modal.bsmd(from_array(spark, q, 1.0), nfft=nfft, overlap=0.0, window="boxcar")
    top = reports.top_triads(r, 3).toPandas()
    assert (8, -5, 3) in set(zip(top["p1"], top["p2"], top["p3"])) | {(5, 3, 8)}
    best = top.iloc[0]
    assert {abs(best["p1"]), abs(best["p2"]), abs(best["p3"])} <= {3, 5, 8, 0}
    doubled = modal.bsmd(from_array(spark, 2 * q, 1.0), nfft=nfft, overlap=0.0, window="boxcar")
    a, b = (x.eig.where("p1 = 5 and p2 = 3").first()["modulus"] for x in (r, doubled))
    assert np.isclose(b, 8 * a)
    with pytest.raises(ValueError):
        modal.bsmd(from_array(spark, q, 1.0), nfft=8, triad_list=[(8, -8, 0)])
    bad = modal.bsmd(from_array(spark, q, 1.0), nfft=nfft, triad_list=[(1, 2, 4)]).eig.first()
    assert np.isnan(bad["modulus"])


def test_triangle_keeps_weak_directions(spark):
    rng = np.random.default_rng(0)
    u, v = np.linalg.qr(rng.standard_normal((200, 6)))[0], np.linalg.qr(rng.standard_normal((6, 6)))[0]
    s = 10.0 ** -np.arange(0, 12, 2)
    x = (u * s) @ v.T
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, v array<double>").repartition(5)
    got = np.linalg.svd(tall.triangle(rows, 6), compute_uv=False)
    assert np.allclose(got, s, rtol=1e-4)
    assert np.allclose(tall.gram(rows, 6), x.T @ x, atol=1e-12)
    sigma, right = tall.randomized(rows, 6, 3)
    assert np.allclose(sigma, s[:3], rtol=1e-8)
    assert right.shape == (6, 3)


def test_thresholds():
    assert np.isclose(numeric.threshold_known(1.0), 4 / np.sqrt(3))
    assert np.isclose(numeric.threshold_median(1.0), 2.858, atol=2e-3)
    assert np.isclose(numeric.threshold_median(1e-9), np.sqrt(2), atol=1e-3)
    assert numeric.rank_of(np.array([3.0, 1.0, 1e-20]), (5, 3), 9) == 2
    assert numeric.rank_of(np.array([3.0, 1.0, 0.1]), (5, 3), "energy", 0.85) == 1
    for bad in (None, True, 0, "x"):
        with pytest.raises(ValueError):
            numeric.rank_of(np.ones(2), (2, 2), bad)


def test_orders():
    v = np.array([1 + 1e-14j, -1, 2, 1j])
    assert v[numeric.spectrum_order(v)].tolist() == [2, -1, 1j, 1 + 1e-14j]
    assert numeric.pooled_order(np.array([1.0, 3.0, 1.0 + 1e-15]), np.array([1, 0, 0])).tolist() == [1, 2, 0]


@pytest.mark.parametrize("shape", [(40, 9), (9, 40)])
def test_randomized_route_agrees(spark, shape):
    rng = np.random.default_rng(3)
    q = rng.standard_normal((shape[0], 4)) @ np.diag([9.0, 4.0, 2.0, 1.0]) @ rng.standard_normal((4, shape[1]))
    data = from_array(spark, q, 0.5)
    exact, random = modal.pod(data, n_modes=3), modal.pod(data, n_modes=3, solver="randomized")
    for name in ("eig", "modes", "coef"):
        a, b = (r.tables[name].toPandas() for r in (exact, random))
        keys = [c for c in a.columns if c in ("mode", "s", "t")]
        a, b = (f.sort_values(keys).reset_index(drop=True) for f in (a, b))
        np.testing.assert_allclose(a.to_numpy(float), b[a.columns].to_numpy(float), atol=1e-8)
    assert modal.pod(data, solver="auto").attrs["solver"] == "eigh"


def test_climbing_rows_keep_the_first_largest():
    keys = np.array([4, 1, 3, 2])
    x = np.array([[2.0, 1.0], [2.0, 0.0], [1.0, 5.0], [2.0, 1.0]])
    kept, rows = tall._climbing(keys, x)
    assert kept.tolist() == [1, 2, 3] and rows.tolist() == [[2.0, 0.0], [2.0, 1.0], [1.0, 5.0]]


def test_dynamic_modes_rebuild_a_linear_system(spark):
    a = np.array([[0.9, 0.2], [-0.2, 0.9]])
    q = [np.array([1.0, 0.5])]
    for _ in range(29):
        q.append(a @ q[-1])
    data = from_array(spark, np.array(q), 1.0)
    assert reports.evolution_error(data, modal.dmd(data, rank=2)).first()[0] < 1e-6


def test_windows_of_ones_own_and_kernel_bounds(spark):
    numeric.add_window("half", lambda n: np.full(n, 0.5))
    try:
        assert numeric.window("half", 3).tolist() == [0.5] * 3
    finally:
        del numeric.WINDOWS["half"]
    for bad in ("half", "none"):
        with pytest.raises(ValueError, match="unknown window"):
            numeric.window(bad, 8)
    with pytest.raises(ValueError, match="fixed"):
        numeric.add_window("hann", np.ones)
    assert abs(numeric.window("flattop", 16)[8] - 1.0) < 1e-6
    with pytest.raises(ValueError, match="kernels"):
        modal._fits(65, 8000)


def test_periodogram_of_short_and_odd_series(spark):
    rng = np.random.default_rng(4)
    q = rng.standard_normal((7, 2))
    got = reports.periodogram(from_array(spark, q, 0.5).long, 7, 0.5).toPandas().pivot(index="f", columns="s", values="power").to_numpy()
    c = q - q.mean(0)
    want = np.abs(np.fft.rfft(c, axis=0)) ** 2 * 0.5 / 7 * np.array([1, 2, 2, 2])[:, None]
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_tall_pod_gathers_no_record(spark, tmp_path, monkeypatch):
    """A place's record is the long side: no row holds it, and stored vectors are read as they are."""
    from eigenflux.dataset import Dataset
    from eigenflux.operators import modal
    from eigenflux.sources import tables

    q = np.random.default_rng(5).standard_normal((90, 64)).astype(np.float32) + 3
    rows = [(t, row.tolist()) for t, row in enumerate(q)]
    whole, holed = str(tmp_path / "whole"), str(tmp_path / "holed")
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{whole}/embeddings.parquet")
    spark.createDataFrame([*rows[:-1], (89, [None, *rows[-1][1][1:]])], "vec_id long, embedding array<float>").write.parquet(f"{holed}/embeddings.parquet")
    assert not tables.vectors(spark, holed).has_stored

    def refuse(*_):
        raise AssertionError("a whole record was gathered")

    monkeypatch.setattr(Dataset, "series", refuse)
    data = tables.vectors(spark, whole)
    centred = q.astype(float) - q.astype(float).mean(0)
    expected = np.linalg.svd(centred, compute_uv=False) ** 2 / len(q)
    for solver in ("eigh", "randomized"):
        for field in (data, tables.vectors(spark, whole).strided(0, None, 1)):  # the second gathers its snapshots
            out = modal.pod(field, n_modes=64, solver=solver)
            assert field.has_stored == (field is data)
            got = np.array([r["lambda_re"] for r in out.eig.orderBy("mode").collect()])
            np.testing.assert_allclose(got, expected, rtol=1e-9)
            assert abs(out.attrs["energy_captured_fraction"] - 1) < 1e-12
    a = np.zeros((90, 64))
    for r in out.coef.collect():
        a[r["t"], r["mode"]] = r["re"]
    phi = np.zeros((64, 64))
    for r in out.modes.collect():
        phi[r["s"], r["mode"]] = r["re"]
    np.testing.assert_allclose(a @ phi.T, centred, atol=1e-9)


def test_trace_of_vectors_is_their_variance(spark, tmp_path, monkeypatch):
    """The trace query over stored vectors explodes none of them; ids need not come in order and means may be large."""
    from eigenflux.dataset import Dataset
    from eigenflux.plans import catalog

    q = np.random.default_rng(6).standard_normal((130, 64)).astype(np.float32) + 1000
    order = np.random.default_rng(7).permutation(130)
    rows = [(int(t), q[t].tolist()) for t in order]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    for way in ("series", "weighted", "centred"):
        monkeypatch.setattr(Dataset, way, lambda *_: pytest.fail("the field was exploded"))
    got = catalog.queries()["pod_trace_E"](spark, str(tmp_path)).first()["trace"]
    assert got == pytest.approx(round(float(q.astype(float).var(0).sum()), 6), abs=2e-6)


def test_vectors_are_read_once(spark, tmp_path, monkeypatch):
    """Count, wholeness, means, energy and kernel of stored vectors come from one reading; a large mean costs no digits."""
    from eigenflux.operators import tall
    from eigenflux.plans import catalog

    q = (np.random.default_rng(8).standard_normal((500, 64)) + 4096).astype(np.float32)
    q[:, 3] += np.arange(500)  # partitions and batches with means of their own
    rows = [(t, v.tolist()) for t, v in enumerate(q)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    readings = []
    reduce_sum = tall.reduce_sum
    monkeypatch.setattr(tall, "reduce_sum", lambda *a: readings.append(1) or reduce_sum(*a))
    got = catalog.queries()["pod_trace_E"](spark, str(tmp_path)).first()["trace"]
    assert got == pytest.approx(float(q.astype(float).var(0).sum()), abs=2e-6)
    eig = catalog.queries()["pod_E"](spark, str(tmp_path))
    assert len(readings) == 2  # one a query
    centred = q.astype(float) - q.astype(float).mean(0)
    expected = np.linalg.svd(centred, compute_uv=False)[:10] ** 2 / 500
    np.testing.assert_allclose([r["lambda_re"] for r in eig.orderBy("mode").collect()], expected, rtol=1e-10)
