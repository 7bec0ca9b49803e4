"""Fields, metrics, sources, results, run files, command line, stream, queries against SQL twins."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import eigenflux as ef
from eigenflux import cli, config, registry, results
from eigenflux.dataset import densify
from eigenflux.functions import metric
from eigenflux.operators import lifts, modal, reports
from eigenflux.plans import catalog
from eigenflux.sources import files, generate
from eigenflux.streaming import IncrementalPOD, hourly_snapshots

DATA = "/root/testdata/sf0.01"


def test_metric_rules():
    assert metric.diagonal(np.diag([1.0, 2.0]), 2).tolist() == [1, 2]
    assert metric.diagonal([[1.0], [2.0]], 2).tolist() == [1, 2]
    for bad in ([[1.0, 0.5], [0.5, 1.0]], [1.0, -1.0], [0.0, 0.0], [1.0, np.nan], [1.0, 1j], [1.0]):
        with pytest.raises(ValueError):
            metric.diagonal(bad, 2)
    w = metric.polar(np.array([0.0, 1.0, 3.0]), np.array([0.0, 1.0]))
    assert np.allclose(w, np.outer([0.5, 1.5, 1.0], [np.pi * 0.25, np.pi * 0.75]).ravel())
    assert np.allclose(metric.polar(np.array([2.0]), np.array([3.0])), [np.pi * 9])


def test_metric_kinds(spark):
    data = ef.from_array(spark, np.ones((3, 6)), 1.0, x=[0, 1, 2], y=[0.5, 1.5])
    assert np.allclose(data.with_metric("polar").weights(), metric.polar(np.arange(3.0), np.array([0.5, 1.5])))
    for kind, values in (("auto", None), ("uniform", [1] * 6), ("prescribed", None)):
        with pytest.raises(ValueError):
            data.with_metric(kind, values)


def test_checks(spark):
    with pytest.raises(ValueError):
        ef.from_array(spark, np.ones((3, 2)), 0.0)
    q = np.ones((3, 2))
    q[1, 1] = np.nan
    with pytest.raises(ValueError):
        ef.from_array(spark, q, 1.0).check()
    rows = spark.createDataFrame([(0, 0, 1.0), (0, 0, 2.0), (2, 1, 5.0)], "t long, s long, q double")
    data = densify(rows, 3, 2, 1.0).check()
    assert data.long.agg(F.sum("q")).first()[0] == 8.0
    with pytest.raises(ValueError):
        lifts.Welch(10, 1.0, 16)
    with pytest.raises(ValueError):
        lifts.Welch(100, 1.0, 16, overlap=1.0)


def test_crop_and_stride(spark):
    data = generate(spark, "taylor_green", {"Nx": 6, "Ny": 4, "Nt": 5})
    small = data.crop(F.col("ix") >= 2, (2, 1, 1)).check()
    assert small.shape == (2, 4, 1)
    q = data.long.toPandas().pivot(index="t", columns="s", values="q").to_numpy().reshape(5, 6, 4)
    got = small.long.toPandas().pivot(index="t", columns="s", values="q").to_numpy().reshape(5, 2, 4)
    assert np.allclose(got, q[:, 2::2])
    assert data.strided(1, 5, 2).check().n_time == 2


def test_npz(spark, tmp_path):
    rng = np.random.default_rng(0)
    q = rng.standard_normal((7, 3, 2))
    for i, part in ((2, slice(0, 4)), (10, slice(4, 7))):
        np.savez(tmp_path / f"block{i}.npz", u=q[part], x=np.arange(3.0), y=np.arange(2.0), times=np.arange(7)[part] * 0.5)
    data = files.load(spark, str(tmp_path)).check()
    assert (data.n_time, data.n_space, data.dt) == (7, 6, 0.5)
    got = data.long.toPandas().pivot(index="t", columns="s", values="q").to_numpy()
    assert np.allclose(got, q.reshape(7, 6))
    assert files.fields(str(tmp_path / "block2.npz")) == ["u"]
    with pytest.raises(FileNotFoundError):
        files.load(spark, str(tmp_path / "none*.npz"))
    files.register_loader("mine", lambda s, p, **o: ef.from_array(s, np.ones((2, 2)), 1.0))
    assert files.load(spark, "x", kind="mine").n_time == 2
    assert files.time_axis((5, 9), 9) == 0 and files.time_axis((5, 9), 5) == 1 and files.time_axis((5, 9), 0) == 1


def test_results_round_trip(spark, tmp_path):
    data = ef.from_array(spark, np.random.default_rng(0).standard_normal((12, 5)), 0.5)
    a = registry.PODAnalyzer(data, n_modes=3)
    a.run()
    path = a.save(str(tmp_path))
    assert path.endswith("case_12snapshots_pod")
    back = ef.Result.load(spark, path)
    assert back.attrs["n_modes_saved"] == 3 and len(back.attrs["prov_config_sha256"]) == 64
    assert back.eig.count() == 3
    assert {r["name"] for r in results.inspect(spark, path).collect()} == {"attrs", "coef", "eig", "modes"}
    assert results.latest(spark, str(tmp_path)).endswith("_pod")
    a.release()
    with pytest.raises(FileNotFoundError):
        ef.Result.load(spark, str(tmp_path))
    with pytest.raises(ValueError):
        registry.DMDAnalyzer(data)
    with pytest.raises(ValueError):
        registry.PODAnalyzer(data, rank=2)


def test_fourier_cache(spark, tmp_path):
    data = ef.from_array(spark, np.random.default_rng(0).standard_normal((64, 3)), 1.0)
    w = lifts.Welch(64, 1.0, 16)
    one = registry.fourier_cache(data, w, str(tmp_path))
    two = registry.fourier_cache(data, w, str(tmp_path))
    assert one.count() == two.count() == 9 * 3 * w.blocks
    assert len(list(tmp_path.iterdir())) == 1


def test_run_files(spark, tmp_path):
    text = """{ // a suite
      "name": "s", /* with "comments" */
      "case": {"name": "tg", "data": {"kind": "generator", "name": "taylor_green", "params": {"Nx": 6, "Ny": 6, "Nt": 20}}, "rank": 1, "nfft": 8, "n_modes_save": 2},
      "runs": [{"id": "a", "method": "pod"}, {"id": "b", "method": "TLS-HODMD", "params": {"delays": 2}}, {"id": "c", "method": "spod", "enabled": false}]
    }"""
    suite = tmp_path / "suite.jsonc"
    suite.write_text(text)
    assert config.strip_comments('{"a": "http://x"} // y') == '{"a": "http://x"} '
    rows = config.execute(spark, str(suite), str(tmp_path / "out")).collect()
    assert [(r["run"], r["executed"]) for r in rows] == [("a", True), ("b", True)]
    assert not any(r["executed"] for r in config.execute(spark, str(suite), dry=True).collect())
    (tmp_path / "loop.jsonc").write_text('{"configs": ["loop.jsonc"]}')
    with pytest.raises(ValueError):
        config.read(str(tmp_path / "loop.jsonc"))
    bad = json.loads(config.strip_comments(text)) | {"colour": 1}
    (tmp_path / "bad.jsonc").write_text(json.dumps(bad))
    with pytest.raises(ValueError):
        config.read(str(tmp_path / "bad.jsonc"))


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["methods", "list"]) == 0
    assert "bsmd" in capsys.readouterr().out
    assert cli.main(["methods", "show", "tls-hodmd"]) == 0
    assert cli.main(["examples", "list"]) == 0
    assert cli.main(["analyze", "dmd", "--generator", "taylor_green", "--rank", "1", "--max-snapshots", "10"]) == 0
    assert '"rank": 1' in capsys.readouterr().out


def test_reports(spark):
    data = generate(spark, "double_gyre", {"Nx": 12, "Ny": 6, "Nt": 30})
    r = modal.pod(data, n_modes=4)
    err = reports.reconstruction(data, r).orderBy("k").toPandas()["error_pct"].to_numpy()
    cum = reports.cumulative(r).orderBy("mode").toPandas()["cum_pct"].to_numpy()
    assert np.allclose(err[:2] ** 2, 1e4 * (1 - cum[:2] / 100), rtol=1e-6)
    assert reports.modes_for(r, 50.0) == 1
    t = np.arange(64)
    wave = np.cos(0.5 * np.pi * t)[:, None] * [1, 0, 0] + np.sin(0.5 * np.pi * t)[:, None] * [0, 0.9, 0]
    assert reports.mode_pairs(modal.pod(ef.from_array(spark, wave, 1.0))) == [(0, 1)]
    flat = spark.createDataFrame([(0.0,), (0.0,), (float("nan"),)], "v double")
    for kind in ("percentile", "sigma", "minmax"):
        assert tuple(reports.limits(flat, "v", kind).first()) == (-1.0, 1.0)
    assert reports.masked(r.modes, data.grid).where("isnan(re)").count() > 0


def test_stream(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    src = tmp_path / "in"
    events.where("day(ts) <= 3").repartition(2).write.parquet(str(src))
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]
    stream = spark.readStream.schema(events.schema).parquet(str(src))
    inc = IncrementalPOD(spark, str(tmp_path / "sums"), len(kinds))
    query = inc.attach(hourly_snapshots(stream, kinds).select("v"), str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    count, values, _ = inc.eigen()
    assert count > 24 and (values > 0).all()
    rows = spark.createDataFrame([([1.0, 2.0],), ([3.0, 1.0],), ([0.0, 0.0],)], "v array<double>")
    two = IncrementalPOD(spark, str(tmp_path / "two"), 2)
    two.add(rows.limit(2), 0)
    two.add(rows.exceptAll(rows.limit(2)), 1)
    two.add(rows.exceptAll(rows.limit(2)), 1)  # a batch that is run again counts once
    n, values, _ = two.eigen()
    x = np.array([[1, 2], [3, 1], [0, 0.0]])
    assert n == 3 and np.allclose(values.sum(), x.var(0).sum())


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    got, want = catalog.queries()[name](spark, DATA).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = [c for c in columns if want[c].dtype.kind == "i"] or columns
    got, want = (x[columns].sort_values(order).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and np.allclose(got.to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=2e-4)


def test_queries_over_all_event_types(spark):
    got = {n: catalog.queries()[n](spark, DATA).toPandas() for n in (
        "snapshot_long_H", "pod_cumulative_H", "pod_recon_error_H", "pod_orthogonality_H", "mode_pair_corr_H", "stpod_eig_H_d2", "shifted_pairs_H", "dmd_operator_H", "dmd_eig_H",
        "hodmd_eig_H_d2", "welch_qhat_H", "spod_eig_H", "spod_peak_H", "psdpod_eig_H", "mpod_eig_H", "bispectrum_H", "bsmd_eig_H", "bsmd_energy_map_H",
    )}
    x = got["snapshot_long_H"].pivot(index="s", columns="t", values="q").to_numpy()
    assert x.shape == (5, 720)
    z = x - x.mean(1, keepdims=True)
    value = np.linalg.eigvalsh(z @ z.T / 720)[::-1]
    assert np.allclose(got["pod_cumulative_H"].sort_values("mode")["cum_pct"], 100 * np.cumsum(value) / value.sum(), atol=1e-5)
    assert np.allclose(got["pod_recon_error_H"].sort_values("k")["error_pct"], 100 * np.sqrt(1 - np.cumsum(value)[:4] / value.sum()), atol=1e-4)
    inner = got["pod_orthogonality_H"]
    assert len(inner) == 15 and np.allclose(inner["inner_product"], inner["i"] == inner["j"], atol=1e-6)
    assert len(got["mode_pair_corr_H"]) == 10 and np.allclose(got["mode_pair_corr_H"]["r"], 0, atol=1e-5)
    late = np.concatenate((z[:, :-1], z[:, 1:]))
    assert np.allclose(got["stpod_eig_H_d2"].sort_values("mode")["lambda"], np.linalg.eigvalsh(late @ late.T / 719)[::-1])
    assert len(got["shifted_pairs_H"]) == 5 * 719
    a = x[:, 1:] @ np.linalg.pinv(x[:, :-1])
    assert np.allclose(got["dmd_operator_H"].pivot(index="i", columns="j", values="a"), a, atol=1e-5)
    order = lambda v: sorted(v, key=lambda c: (round(c.real, 5), round(c.imag, 5)))
    assert np.allclose(order(got["dmd_eig_H"]["lambda_re"] + 1j * got["dmd_eig_H"]["lambda_im"]), order(np.linalg.eigvals(a)), atol=1e-5)
    x2 = np.concatenate((x[:, :-1], x[:, 1:]))
    a2 = x2[:, 1:] @ np.linalg.pinv(x2[:, :-1])
    assert np.allclose(order(got["hodmd_eig_H_d2"]["lambda_re"] + 1j * got["hodmd_eig_H_d2"]["lambda_im"]), order(np.linalg.eigvals(a2)), atol=1e-5)
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(24) / 24)
    blocks = np.stack([z[:, b * 12 : b * 12 + 24] for b in range(59)], 1) * window
    q = np.fft.rfft(blocks)[..., :13] / 24 / np.sqrt((window**2).mean())  # s, b, f
    mine = got["welch_qhat_H"].sort_values(["s", "b", "f"])
    assert np.allclose((mine["re"] + 1j * mine["im"]).to_numpy().reshape(5, 59, 13), q, atol=1e-5)
    spod = np.stack([np.linalg.eigvalsh(q[:, :, f] @ q[:, :, f].conj().T * 24 / 59)[::-1] for f in range(13)])
    assert np.allclose(got["spod_eig_H"].pivot(index="f", columns="mode", values="lambda"), spod, rtol=1e-6, atol=1e-4)
    peak = got["spod_peak_H"].iloc[0]
    assert peak["f"] == spod[:, 0].argmax() and np.isclose(peak["lambda"], spod[:, 0].max())
    flat = q.reshape(5, -1)
    assert np.allclose(got["psdpod_eig_H"].sort_values("mode")["lambda"][:5], np.linalg.eigvalsh(flat @ flat.conj().T / flat.shape[1])[::-1], atol=1e-5)
    assert got["mpod_eig_H"].groupby("band").size().tolist() == [5, 5, 5] and np.isclose(got["mpod_eig_H"]["lambda"].sum(), value.sum())
    at = lambda p: q[:, :, p] if p >= 0 else q[:, :, -p].conj()
    triple = got["bispectrum_H"]
    want = [(at(p1) * at(p2) * at(p3).conj())[s].mean() for p1, p2, p3, s in triple[["p1", "p2", "p3", "s"]].itertuples(index=False)]
    assert set(triple["s"]) == set(range(5)) and np.allclose(triple["re"] + 1j * triple["im"], want, rtol=1e-6, atol=1e-4)
    assert len(triple) == 5 * len(got["bsmd_eig_H"])
    seen = got["bsmd_energy_map_H"]
    assert len(seen) == 17 * 17 and np.allclose(sorted(seen["modulus"][seen["modulus"] >= 0]), sorted(got["bsmd_eig_H"]["modulus"]))


def test_generators_have_queries_of_default_size(spark):
    for name, rows in {"gen_double_gyre_full": 80 * 40 * 200, "gen_taylor_green_full": 64 * 64 * 100, "gen_cylinder_wake": 100 * 50 * 500}.items():
        assert catalog.queries()[name](spark, DATA).count() == rows
