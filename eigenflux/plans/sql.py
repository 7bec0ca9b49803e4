"""SQL twins for DuckDB. They share nothing with the engine: fields by joins, spectra by closed forms of 2 x 2 matrices."""

from __future__ import annotations

import math

HOURS = """kinds AS (SELECT event_type, CAST(row_number() OVER (ORDER BY event_type) - 1 AS BIGINT) AS s FROM (SELECT DISTINCT event_type FROM events {only})),
found AS (SELECT CAST(datediff('hour', TIMESTAMP '2024-01-01', ts) AS BIGINT) AS t, s, sum(value) AS q FROM events JOIN kinds USING (event_type) GROUP BY 1, 2),
cells AS (SELECT range AS t, s FROM range(720), kinds),
H AS (SELECT c.t, c.s, coalesce(f.q, 0.0) AS q FROM cells c LEFT JOIN found f ON c.t = f.t AND c.s = f.s)"""
H = HOURS.format(only="")
H2 = HOURS.format(only="WHERE event_type IN ('click', 'purchase')")
M = """kinds AS (SELECT o_orderpriority, CAST(row_number() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS s FROM (SELECT DISTINCT o_orderpriority FROM orders)),
found AS (SELECT CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS BIGINT) AS t, s, sum(o_totalprice) AS q FROM orders JOIN kinds USING (o_orderpriority) GROUP BY 1, 2),
cells AS (SELECT range AS t, s FROM range(80), kinds),
M AS (SELECT c.t, c.s, coalesce(f.q, 0.0) AS q FROM cells c LEFT JOIN found f ON c.t = f.t AND c.s = f.s)"""
D = f"""{H},
D AS (SELECT t // 24 AS t, (t % 24) * (SELECT count(*) FROM kinds) + s AS s, q FROM H)"""
E = """E AS (SELECT vec_id AS t, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS s, CAST(unnest(embedding) AS DOUBLE) AS q FROM embeddings)"""

# Two series side by side, centred; moments; the closed form of a symmetric 2 x 2 matrix.
WIDE2 = f"""{H2},
raw AS (SELECT t, max(q) FILTER (WHERE s = 0) AS x, max(q) FILTER (WHERE s = 1) AS y FROM H GROUP BY t),
Z AS (SELECT t, x - avg(x) OVER () AS x, y - avg(y) OVER () AS y FROM raw)"""
EIG2 = f"""{WIDE2},
k AS (SELECT sum(x * x) / 720 AS a, sum(x * y) / 720 AS b, sum(y * y) / 720 AS d FROM Z),
e AS (SELECT a, b, d, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS l0, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS l1 FROM k),
lam AS (SELECT CAST(0 AS BIGINT) AS mode, l0 AS ev, a, b, d FROM e UNION ALL SELECT 1, l1, a, b, d FROM e),
raws AS (SELECT mode, ev, a, b, d, b AS u, ev - a AS v FROM lam),
unit AS (SELECT mode, ev, a, d, u / sqrt(u * u + v * v) AS u, v / sqrt(u * u + v * v) AS v FROM raws),
phi AS (SELECT mode, ev, a, d, u * sg AS u, v * sg AS v FROM (SELECT *, CASE WHEN abs(u) >= abs(v) * (1 - 1e-12) THEN sign(u) ELSE sign(v) END AS sg FROM unit))"""

N, TAU = 24, 2 * math.pi
HOP, BLOCKS = 12, 59
HAMMING_POWER = 0.54**2 + 0.46**2 / 2

def blocks(field: str, window: str) -> str:
    """Welch transform of ``field(t, s, q)``: power-normalised window, half overlap, mean of the record."""
    win = "1.0" if window == "boxcar" else f"(0.54 - 0.46 * cos({TAU!r} * n.range / {N}))"
    power = 1.0 if window == "boxcar" else HAMMING_POWER
    return f"""mean AS (SELECT s, avg(q) AS m FROM {field} GROUP BY s),
pieces AS (SELECT b.range AS b, n.range AS n, f.s, (f.q - m) * {win} AS q FROM range({BLOCKS}) b, range({N}) n, {field} f JOIN mean USING (s) WHERE f.t = b.range * {HOP} + n.range),
Q AS (SELECT k.range AS f, s, b, sum(q * cos({TAU!r} * ((k.range * n) % {N}) / {N})) / {N} / sqrt({power!r}) AS re, -sum(q * sin({TAU!r} * ((k.range * n) % {N}) / {N})) / {N} / sqrt({power!r}) AS im
 FROM pieces, range({N // 2 + 1}) k GROUP BY 1, 2, 3)"""

PAIR = """P AS (SELECT x.f, x.b, x.re AS xr, x.im AS xi, y.re AS yr, y.im AS yi FROM Q x JOIN Q y ON x.f = y.f AND x.b = y.b WHERE x.s = 0 AND y.s = 1)"""
HERMITIAN = "(a + d) / 2 {sign} sqrt(((a - d) / 2) ** 2 + br * br + bi * bi)"


def queries() -> dict[str, str]:
    q: dict[str, str] = {}
    r = lambda e, n: f"round({e}, 6) + 0.0 AS {n}"
    q["snapshot_long_H"] = f"WITH {H} SELECT t, s, {r('q', 'q')} FROM H"
    q["snapshot_M"] = f"WITH {M} SELECT t, s, round(q, 2) AS q FROM M"
    q["temporal_mean_H"] = f"WITH {H} SELECT s, {r('avg(q)', 'q_mean')} FROM H GROUP BY s"
    q["centered_H"] = f"WITH {H} SELECT t, s, {r('q - avg(q) OVER (PARTITION BY s)', 'q')} FROM H"
    q["max_snapshots"] = f"WITH {H} SELECT t, s, {r('q', 'q')} FROM H WHERE t < 100"
    q["time_stride"] = f"WITH {H} SELECT (t - 5) // 7 AS t, s, {r('q', 'q')} FROM H WHERE t >= 5 AND t < 500 AND (t - 5) % 7 = 0"
    q["space_stride"] = f"WITH {H} SELECT t, s // 2 AS s, {r('q', 'q')} FROM H WHERE s % 2 = 0"
    q["nearest_index"] = "SELECT CAST(k.range AS BIGINT) AS k, CAST(arg_min(i.range, abs(i.range * 2.0 / 79 - k.range * 0.13)) AS BIGINT) AS ix FROM range(16) k, range(80) i GROUP BY k.range"
    q["infer_dt"] = f"WITH {H}, g AS (SELECT DISTINCT t FROM found), l AS (SELECT abs(t - lag(t) OVER (ORDER BY t)) AS d FROM g) SELECT {r('avg(d)', 'dt')} FROM l WHERE d <> 0"
    q["weights_uniform"] = "SELECT range AS s, CAST(1.0 AS DOUBLE) AS w FROM range(12)"
    q["weights_polar"] = f"""WITH x AS (SELECT range AS i, range * 2.0 / 5 AS x FROM range(6)), r AS (SELECT range AS j, 0.1 + range * 0.3 AS r FROM range(4)),
wx AS (SELECT i, (coalesce(lead(x) OVER o, x) - coalesce(lag(x) OVER o, x)) / 2 AS w FROM x WINDOW o AS (ORDER BY i)),
wr AS (SELECT j, {math.pi!r} * ((CASE WHEN lead(r) OVER o IS NULL THEN r ELSE (r + lead(r) OVER o) / 2 END) ** 2 - (CASE WHEN lag(r) OVER o IS NULL THEN 0 ELSE (r + lag(r) OVER o) / 2 END) ** 2) AS w FROM r WINDOW o AS (ORDER BY j))
SELECT i * 4 + j AS s, {r('wx.w * wr.w', 'w')} FROM wx, wr"""
    q["weighted_energy"] = f"WITH {H} SELECT {r('sum(e)', 'energy')} FROM (SELECT (s + 1) * var_pop(q) AS e FROM H GROUP BY s)"
    q["gram_spatial_H"] = f"WITH {H}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H) SELECT a.s AS i, b.s AS j, {r('sum(a.q * b.q) / 720', 'k')} FROM c a JOIN c b USING (t) WHERE a.s <= b.s GROUP BY 1, 2"
    q["gram_temporal_D"] = f"WITH {D}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM D) SELECT a.t AS i, b.t AS j, {r('sum(a.q * b.q) / 30', 'k')} FROM c a JOIN c b USING (s) WHERE a.t <= b.t GROUP BY 1, 2"
    q["gram_E"] = f"WITH {E}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM E) SELECT a.s AS i, b.s AS j, round(sum(a.q * b.q) / (SELECT count(*) FROM embeddings), 9) + 0.0 AS k FROM c a JOIN c b USING (t) WHERE a.s <= b.s GROUP BY 1, 2"
    q["pod_total_energy_H"] = f"WITH {H} SELECT {r('sum(v)', 'energy')} FROM (SELECT var_pop(q) AS v FROM H GROUP BY s)"
    q["pod_trace_check_H"] = q["pod_total_energy_H"].replace("AS energy", "AS trace")
    q["pod_frobenius_check_H"] = f"WITH {H}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H), k AS (SELECT sum(a.q * b.q) / 720 AS k FROM c a JOIN c b USING (t) GROUP BY a.s, b.s) SELECT round(sum(k * k), 1) AS squares FROM k"
    q["pod_eig_H2"] = f"WITH {EIG2} SELECT mode, {r('ev', 'lambda')}, {r('ev / (a + d)', 'fraction')} FROM phi"
    q["pod_modes_H2"] = f"WITH {EIG2} SELECT mode, CAST(0 AS BIGINT) AS s, {r('u', 'phi')} FROM phi UNION ALL SELECT mode, 1, {r('v', 'phi')} FROM phi"
    q["pod_coeffs_H2"] = f"WITH {EIG2} SELECT mode, t, {r('x * u + y * v', 'a')} FROM phi, Z"
    q["pod_cumulative_H2"] = f"WITH {EIG2} SELECT mode, {r('100 * ev / (a + d)', 'pct')}, {r('100 * sum(ev) OVER (ORDER BY mode) / (a + d)', 'cum_pct')} FROM phi"
    q["pod_recon_error_H2"] = f"WITH {EIG2} SELECT CAST(1 AS INTEGER) AS k, {r('100 * sqrt(1 - ev / (a + d))', 'error_pct')} FROM phi WHERE mode = 0"
    q["pod_orthogonality_H2"] = f"WITH {EIG2} SELECT p.mode AS i, o.mode AS j, {r('p.u * o.u + p.v * o.v', 'inner_product')} FROM phi p, phi o WHERE p.mode <= o.mode"
    q["mode_pair_corr_H2"] = f"WITH {EIG2}, c AS (SELECT mode, t, x * u + y * v AS a FROM phi, Z) SELECT p.mode AS i, o.mode AS j, {r('corr(p.a, o.a)', 'r')} FROM c p JOIN c o USING (t) WHERE p.mode < o.mode GROUP BY 1, 2"
    q["delay_embed_H"] = f"WITH {H} SELECT H.t - d.range AS t, d.range AS d, s, {r('q', 'q')} FROM H, range(4) d WHERE H.t - d.range BETWEEN 0 AND 716"
    q["stpod_energy_H"] = f"WITH {H}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H) SELECT {r('sum(q * q) / 717', 'energy')} FROM c, range(4) d WHERE c.t - d.range BETWEEN 0 AND 716"
    q["stpod_gram_d2"] = f"WITH {H}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H), l AS (SELECT c.t - d.range AS t, d.range * 5 + s AS k, q FROM c, range(2) d WHERE c.t - d.range BETWEEN 0 AND 718) SELECT a.k AS i, b.k AS j, {r('sum(a.q * b.q) / 719', 'k')} FROM l a JOIN l b USING (t) WHERE a.k <= b.k GROUP BY 1, 2"
    one = f"{WIDE2}, l AS (SELECT t, x, lead(x) OVER (ORDER BY t) AS y FROM Z)"
    q["stpod_eig_1dof_d2"] = f"WITH {one}, k AS (SELECT sum(x * x) / 719 AS a, sum(x * y) / 719 AS b, sum(y * y) / 719 AS d FROM l WHERE y IS NOT NULL) SELECT CAST(0 AS BIGINT) AS mode, {r('(a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b)', 'lambda')} FROM k UNION ALL SELECT 1, {r('(a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b)', 'lambda')} FROM k"
    q["shifted_pairs_H2"] = f"WITH {H2}, l AS (SELECT t, s, q AS x1, lead(q) OVER (PARTITION BY s ORDER BY t) AS x2 FROM H) SELECT t, s, {r('x1', 'x1')}, {r('x2', 'x2')} FROM l WHERE x2 IS NOT NULL"
    dmd = f"""{WIDE2}, l AS (SELECT t, x, y, lead(x) OVER (ORDER BY t) AS x2, lead(y) OVER (ORDER BY t) AS y2 FROM raw),
g AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(x2 * x) AS ax, sum(x2 * y) AS ay, sum(y2 * x) AS bx, sum(y2 * y) AS byy FROM l WHERE x2 IS NOT NULL),
A AS (SELECT (ax * yy - ay * xy) / det AS a, (ay * xx - ax * xy) / det AS b, (bx * yy - byy * xy) / det AS c, (byy * xx - bx * xy) / det AS d FROM (SELECT *, xx * yy - xy * xy AS det FROM g))"""
    q["dmd_operator_H2"] = f"WITH {dmd} SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, {r('a', 'a')} FROM A UNION ALL SELECT 0, 1, {r('b', 'a')} FROM A UNION ALL SELECT 1, 0, {r('c', 'a')} FROM A UNION ALL SELECT 1, 1, {r('d', 'a')} FROM A"
    real = f"{dmd}, e AS (SELECT (a + d) / 2 AS h, ((a - d) / 2) ** 2 + b * c AS z FROM A), l2 AS (SELECT h + sqrt(greatest(z, 0)) AS re, CASE WHEN z < 0 THEN -sqrt(-z) ELSE 0.0 END AS im FROM e UNION ALL SELECT h - sqrt(greatest(z, 0)), CASE WHEN z < 0 THEN sqrt(-z) ELSE 0.0 END FROM e), o AS (SELECT CAST(row_number() OVER (ORDER BY round(re * re + im * im, 12) DESC, re, im) - 1 AS BIGINT) AS mode, re, im FROM l2)"
    q["dmd_eig_H2"] = f"WITH {real} SELECT mode, {r('re', 'lambda_re')}, {r('im', 'lambda_im')} FROM o"
    q["dmd_omega_H2"] = f"WITH {real} SELECT mode, {r('ln(sqrt(re * re + im * im))', 'growth')}, {r(f'atan2(im, re) / {TAU!r}', 'freq')} FROM o"
    hod = f"""{WIDE2}, l AS (SELECT t, x, lead(x, 1) OVER (ORDER BY t) AS y, lead(x, 2) OVER (ORDER BY t) AS z FROM raw),
g AS (SELECT sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy, sum(z * x) AS zx, sum(z * y) AS zy FROM l WHERE z IS NOT NULL),
A AS (SELECT (zx * yy - zy * xy) / (xx * yy - xy * xy) AS c, (zy * xx - zx * xy) / (xx * yy - xy * xy) AS d FROM g),
e AS (SELECT d / 2 AS h, (d / 2) ** 2 + c AS z FROM A), l2 AS (SELECT h + sqrt(greatest(z, 0)) AS re, CASE WHEN z < 0 THEN -sqrt(-z) ELSE 0.0 END AS im FROM e UNION ALL SELECT h - sqrt(greatest(z, 0)), CASE WHEN z < 0 THEN sqrt(-z) ELSE 0.0 END FROM e),
o AS (SELECT CAST(row_number() OVER (ORDER BY round(re * re + im * im, 12) DESC, re, im) - 1 AS BIGINT) AS mode, re, im FROM l2)"""
    q["hodmd_eig_1dof_d2"] = f"WITH {hod} SELECT mode, {r('re', 'lambda_re')}, {r('im', 'lambda_im')} FROM o"
    q["welch_blocks_H"] = f"WITH {H} SELECT b.range AS b, n.range AS n, s, {r('q', 'q')} FROM range({BLOCKS}) b, range({N}) n, H WHERE H.t = b.range * {HOP} + n.range"
    q["welch_qhat_H2"] = f"WITH {H2}, {blocks('H', 'hamming')} SELECT f, s, b, {r('re', 're')}, {r('im', 'im')} FROM Q"
    q["welch_psd_H"] = f"WITH {H}, {blocks('H', 'boxcar')} SELECT f, s, {r('avg(re * re + im * im)', 'psd')} FROM Q GROUP BY 1, 2"
    q["blockwise_mean_H"] = f"WITH {H} SELECT b.range AS b, s, {r('avg(q)', 'm')} FROM range({BLOCKS}) b, H WHERE H.t BETWEEN b.range * {HOP} AND b.range * {HOP} + {N - 1} GROUP BY 1, 2"
    q["normvar_H"] = f"WITH {H} SELECT b.range AS b, s, round(var_samp(q), 3) AS v FROM range({BLOCKS}) b, H WHERE H.t BETWEEN b.range * {HOP} AND b.range * {HOP} + {N - 1} GROUP BY 1, 2"
    q["spod_trace_H"] = f"WITH {H}, {blocks('H', 'hamming')} SELECT f, {r(f'sum(re * re + im * im) * {N} / {BLOCKS}', 'trace')} FROM Q GROUP BY f"
    her = f"{H2}, {blocks('H', 'hamming')}, {PAIR}"
    sums = "sum(xr * xr + xi * xi) * {c} AS a, sum(yr * yr + yi * yi) * {c} AS d, sum(xr * yr + xi * yi) * {c} AS br, sum(xi * yr - xr * yi) * {c} AS bi"
    plus, minus = HERMITIAN.format(sign="+"), HERMITIAN.format(sign="-")
    both = f"k AS (SELECT f, {sums.format(c=f'{N} / {BLOCKS}')} FROM P GROUP BY f)"
    q["spod_eig_H2"] = f"WITH {her}, {both} SELECT f, CAST(0 AS BIGINT) AS mode, {r(plus, 'lambda')} FROM k UNION ALL SELECT f, 1, {r(minus, 'lambda')} FROM k"
    q["spod_peak_H2"] = f"WITH {her}, {both}, l AS (SELECT f, {plus} AS v FROM k) SELECT arg_max(f, v) AS f, {r('max(v)', 'lambda')} FROM l"
    size = BLOCKS * (N // 2 + 1)
    q["psdpod_trace_H2"] = f"WITH {H2}, {blocks('H', 'hamming')} SELECT {r(f'sum(re * re + im * im) / {size}', 'trace')} FROM Q"
    q["psdpod_trace_H"] = f"WITH {H}, {blocks('H', 'hamming')} SELECT {r(f'sum(re * re + im * im) / {size}', 'trace')} FROM Q"
    pooled = f"k AS (SELECT {sums.format(c=f'1.0 / {size}')} FROM P)"
    q["psdpod_eig_H2"] = f"WITH {her}, {pooled} SELECT CAST(0 AS BIGINT) AS mode, {r(plus, 'lambda')} FROM k UNION ALL SELECT 1, {r(minus, 'lambda')} FROM k"
    dft = "F AS (SELECT k.range AS k, s, sum(q * cos({tau} * ((k.range * t) % 720) / 720)) AS re, -sum(q * sin({tau} * ((k.range * t) % 720) / 720)) AS im FROM {field}, range(361) k GROUP BY 1, 2), B AS (SELECT *, CASE WHEN k = 0 OR k = 360 THEN 1.0 ELSE 2.0 END AS c, CASE WHEN k / 720.0 < 0.05 THEN 0 WHEN k / 720.0 < 0.2 THEN 1 ELSE 2 END AS band FROM F)"
    full = f"WITH {H}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H), {dft.format(tau=repr(TAU), field='c')}"
    q["mpod_band_energy_H"] = f"{full} SELECT CAST(band AS BIGINT) AS band, {r('sum(c * (re * re + im * im)) / 518400', 'energy')} FROM B GROUP BY band"
    two = f"WITH {H2}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H), {dft.format(tau=repr(TAU), field='c')}, k AS (SELECT x.band, sum(x.c * (x.re * x.re + x.im * x.im)) / 518400 AS a, sum(x.c * (y.re * y.re + y.im * y.im)) / 518400 AS d, sum(x.c * (x.re * y.re + x.im * y.im)) / 518400 AS b FROM B x JOIN B y ON x.k = y.k WHERE x.s = 0 AND y.s = 1 GROUP BY x.band), l AS (SELECT band, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS v FROM k UNION ALL SELECT band, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) FROM k)"
    q["mpod_eig_H2"] = f"{two} SELECT CAST(row_number() OVER (ORDER BY v DESC) - 1 AS BIGINT) AS mode, CAST(band AS BIGINT) AS band, {r('v', 'lambda')} FROM l"
    tri = "(SELECT a.range AS p1, b.range AS p2, a.range + b.range AS p3 FROM range(-8, 9) a, range(-8, 9) b WHERE a.range >= abs(b.range) AND abs(a.range + b.range) <= 8)"
    q["triads_static"] = f"SELECT p1, p2, p3 FROM {tri}"
    q["triads_filtered"] = f"SELECT p1, p2, p3 FROM {tri} WHERE greatest(abs(p1), abs(p2), abs(p3)) <= 6"
    sgn = "X AS (SELECT k.range AS p, s, b, re, CASE WHEN k.range < 0 THEN -im ELSE im END AS im FROM Q JOIN range(-8, 9) k ON Q.f = abs(k.range))"
    prod = f"""{H2}, {blocks('H', 'hamming')}, {sgn}, T AS {tri}, G AS (SELECT T.p1, T.p2, T.p3, x.s, x.b, x.re * y.re - x.im * y.im AS re, x.re * y.im + x.im * y.re AS im FROM T JOIN X x ON x.p = T.p1 JOIN X y ON y.p = T.p2 AND y.s = x.s AND y.b = x.b)"""
    q["bispectrum_1dof"] = f"WITH {prod} SELECT G.p1, G.p2, G.p3, {r(f'sum(G.re * z.re + G.im * z.im) / {BLOCKS}', 're')}, {r(f'sum(G.im * z.re - G.re * z.im) / {BLOCKS}', 'im')} FROM G JOIN X z ON z.p = G.p3 AND z.s = G.s AND z.b = G.b WHERE G.s = 0 GROUP BY 1, 2, 3"
    # trace and determinant of the 2 x 2 twin W (Q1 o Q2) Q3^H / n_b
    mat = f"""{prod}, C AS (SELECT G.p1, G.p2, G.p3, G.s AS i, z.s AS j, sum(G.re * z.re + G.im * z.im) / {BLOCKS} AS re, sum(G.im * z.re - G.re * z.im) / {BLOCKS} AS im FROM G JOIN X z ON z.p = G.p3 AND z.b = G.b GROUP BY 1, 2, 3, 4, 5),
W AS (SELECT p1, p2, p3, max(re) FILTER (WHERE i = 0 AND j = 0) AS ar, max(im) FILTER (WHERE i = 0 AND j = 0) AS ai, max(re) FILTER (WHERE i = 0 AND j = 1) AS br, max(im) FILTER (WHERE i = 0 AND j = 1) AS bi, max(re) FILTER (WHERE i = 1 AND j = 0) AS cr, max(im) FILTER (WHERE i = 1 AND j = 0) AS ci, max(re) FILTER (WHERE i = 1 AND j = 1) AS dr, max(im) FILTER (WHERE i = 1 AND j = 1) AS di FROM C GROUP BY 1, 2, 3),
S AS (SELECT *, (ar + dr) / 2 AS hr, (ai + di) / 2 AS hi, ((ar - dr) / 2) ** 2 - ((ai - di) / 2) ** 2 + br * cr - bi * ci AS zr, 2 * ((ar - dr) / 2) * ((ai - di) / 2) + br * ci + bi * cr AS zi FROM W),
R AS (SELECT *, sqrt(sqrt(zr * zr + zi * zi)) * cos(atan2(zi, zr) / 2) AS qr, sqrt(sqrt(zr * zr + zi * zi)) * sin(atan2(zi, zr) / 2) AS qi FROM S),
L AS (SELECT p1, p2, p3, greatest(sqrt((hr + qr) ** 2 + (hi + qi) ** 2), sqrt((hr - qr) ** 2 + (hi - qi) ** 2)) AS m FROM R)"""
    q["bsmd_eig_H2"] = f"WITH {mat} SELECT p1, p2, p3, round(m, 4) + 0.0 AS modulus FROM L"
    q["bsmd_energy_map"] = f"WITH {mat} SELECT a.range AS p1, b.range AS p2, round(coalesce(m, -1.0), 4) + 0.0 AS modulus FROM range(-8, 9) a CROSS JOIN range(-8, 9) b LEFT JOIN L ON L.p1 = a.range AND L.p2 = b.range"
    q["robust_clim_H"] = f"WITH {H}, v AS (SELECT greatest(abs(quantile_cont(q, 0.02)), abs(quantile_cont(q, 0.98))) AS m FROM H) SELECT {r('-m', 'low')}, {r('m', 'high')} FROM v"
    q["gen_double_gyre"] = f"WITH g AS (SELECT t.range AS t, i.range * 10 + j.range AS s, i.range * 2.0 / 19 AS x, j.range * 1.0 / 9 AS y, 0.25 * sin({TAU / 10!r} * t.range * 20.0 / 29) AS w FROM range(30) t, range(20) i, range(10) j) SELECT t, s, {r(f'-{math.pi * 0.25!r} * sin({math.pi!r} * (w * x * x + (1 - 2 * w) * x)) * cos({math.pi!r} * y)', 'q')} FROM g"
    q["gen_taylor_green"] = f"SELECT t.range AS t, i.range * 16 + j.range AS s, {r(f'-cos(i.range * {TAU / 16!r}) * sin(j.range * {TAU / 16!r}) * exp(-0.02 * t.range * 150.0 / 19)', 'q')} FROM range(20) t, range(16) i, range(16) j"
    q["gen_double_gyre_full"] = f"WITH g AS (SELECT t.range AS t, i.range * 40 + j.range AS s, i.range * 2.0 / 79 AS x, j.range * 1.0 / 39 AS y, 0.25 * sin({TAU / 10!r} * t.range * 20.0 / 199) AS w FROM range(200) t, range(80) i, range(40) j) SELECT t, s, {r(f'-{math.pi * 0.25!r} * sin({math.pi!r} * (w * x * x + (1 - 2 * w) * x)) * cos({math.pi!r} * y)', 'q')} FROM g"
    q["gen_taylor_green_full"] = f"SELECT t.range AS t, i.range * 64 + j.range AS s, {r(f'-cos(i.range * {TAU / 64!r}) * sin(j.range * {TAU / 64!r}) * exp(-0.02 * t.range * 150.0 / 99)', 'q')} FROM range(100) t, range(64) i, range(64) j"
    q["periodogram_H"] = f"WITH {H}, c AS (SELECT t, s, q - avg(q) OVER (PARTITION BY s) AS q FROM H), F AS (SELECT k.range AS f, s, sum(q * cos({TAU!r} * ((k.range * t) % 720) / 720)) AS re, sum(q * sin({TAU!r} * ((k.range * t) % 720) / 720)) AS im FROM c, range(361) k GROUP BY 1, 2) SELECT s, f, {r('CASE WHEN f = 0 OR f = 360 THEN 1 ELSE 2 END * (re * re + im * im) / 720', 'power')} FROM F"
    q["limits_minmax_H"] = f"WITH {H}, v AS (SELECT max(abs(q)) AS m FROM H) SELECT {r('-m', 'low')}, {r('m', 'high')} FROM v"
    q["limits_sigma_H"] = f"WITH {H}, a AS (SELECT median(q) AS med FROM H), b AS (SELECT max(med) AS med, 3.7065 * median(abs(q - med)) AS w FROM H, a), v AS (SELECT greatest(abs(med - w), abs(med + w)) AS m FROM b), u AS (SELECT CASE WHEN m > 0 THEN m ELSE 1.0 END AS m FROM v) SELECT {r('-m', 'low')}, {r('m', 'high')} FROM u"
    q["reductions_H"] = f"WITH {H} SELECT 0::BIGINT AS kind, {r('min(q)', 'v')} FROM H UNION ALL SELECT 1, {r('max(q)', 'v')} FROM H UNION ALL SELECT 2, {r('avg(q)', 'v')} FROM H"
    q["centredness_H"] = f"WITH {H}, m AS (SELECT max(abs(a)) AS top FROM (SELECT avg(q) AS a FROM H GROUP BY s)) SELECT 0::BIGINT AS centred, {r('max(top) / stddev_pop(q)', 'ratio')} FROM H, m UNION ALL SELECT 1, 0.0"
    q["time_axis_H"] = "SELECT range AS t, CAST(range AS DOUBLE) AS time FROM range(720)"
    q["mpod_band_counts_H2"] = f"SELECT band, count(*) AS n FROM ({q['mpod_eig_H2']}) GROUP BY band"
    q["missing_bins"] = f"SELECT DISTINCT f FROM (SELECT abs(unnest([p1, p2, p3])) AS f FROM {tri}) WHERE f >= 4"
    q["top_triads_H2"] = f"SELECT * FROM ({q['bsmd_eig_H2']}) ORDER BY modulus DESC LIMIT 5"
    q["pod_modes_for_H2"] = f"SELECT threshold, min(mode) + 1 AS n FROM ({q['pod_cumulative_H2']}), (VALUES (CAST(50 AS BIGINT)), (90), (99)) v(threshold) WHERE cum_pct > threshold GROUP BY threshold"
    q["pod_capped_H2"] = f"SELECT * FROM ({q['pod_eig_H2']}) WHERE mode = 0"
    for same in ("pod_svd_H2", "pod_randomized_H2", "result_saved_H2"):
        q[same] = q["pod_eig_H2"]
    q["coefficient_gram_H2"] = f"WITH {EIG2} SELECT p.mode AS i, o.mode AS j, {r('CASE WHEN p.mode = o.mode THEN p.ev ELSE 0.0 END', 'inner_product')} FROM phi p, phi o WHERE p.mode <= o.mode"
    q["dmd_energy_rank_H2"] = f"WITH {dmd}, sv AS (SELECT (xx + yy) / 2 + sqrt(((xx - yy) / 2) ** 2 + xy * xy) AS top, xx + yy AS whole FROM g) SELECT permille, CAST(CASE WHEN top / whole >= permille / 1000 THEN 1 ELSE 2 END AS BIGINT) AS r FROM sv, (VALUES (CAST(500 AS BIGINT)), (900), (999)) v(permille)"
    # the linear map applied over and over to the first snapshot
    run = f"{dmd}, walk AS (SELECT CAST(0 AS BIGINT) AS t, x, y FROM raw WHERE t = 0 UNION ALL SELECT t + 1, a * x + b * y, c * x + d * y FROM walk, A WHERE t < 719)"
    q["dmd_recon_error_H2"] = f"WITH RECURSIVE {run} SELECT {r('100 * sqrt(sum((raw.x - walk.x) ** 2 + (raw.y - walk.y) ** 2) / sum(raw.x ** 2 + raw.y ** 2))', 'error_pct')} FROM raw JOIN walk USING (t)"
    q["spod_capped_H2"] = f"SELECT * FROM ({q['spod_eig_H2']}) WHERE mode = 0"
    q["spod_weights_H"] = f"WITH {H}, {blocks('H', 'hamming')} SELECT f, {r(f'sum((s + 1) * (re * re + im * im)) * {N} / {BLOCKS}', 'trace')} FROM Q GROUP BY f"
    q["bsmd_user_triads_H2"] = f"SELECT p1, p2, p3, modulus FROM ({q['bsmd_eig_H2']}) WHERE (p1 = 1 AND p2 = 1) OR (p1 = 3 AND p2 = -2) UNION ALL SELECT 1, 1, 3, -1.0"
    q["periodogram_peaks_H"] = f"WITH P AS ({q['periodogram_H']}), n AS (SELECT *, lag(power) OVER o AS l, lead(power) OVER o AS m FROM P WINDOW o AS (PARTITION BY s ORDER BY f)), k AS (SELECT s, f, power, CAST(row_number() OVER (PARTITION BY s ORDER BY power DESC, f) - 1 AS BIGINT) AS rank FROM n WHERE power > l AND power > m) SELECT s, rank, f, power FROM k WHERE rank < 3"
    gyre = f"g AS (SELECT i.range * 10 + j.range AS s, i.range * 2.0 / 19 AS x, j.range * 1.0 / 9 AS y FROM range(20) i, range(10) j), v AS (SELECT s, x, y, -{math.pi * 0.25!r} * sin({math.pi!r} * x) * cos({math.pi!r} * y) AS q FROM g)"
    q["masked_gyre"] = f"WITH {gyre} SELECT s, x * x + y * y <= 0.64 AS hidden, {r('CASE WHEN x * x + y * y <= 0.64 THEN 0.0 ELSE q END', 're')} FROM v"
    q["volume_gyre"] = f"WITH {gyre} SELECT s, {r('q', 're')} FROM v WHERE x BETWEEN 0.5 AND 1.5 AND y BETWEEN 0 AND 0.5"
    q["track_crop_gyre"] = f"WITH f AS ({q['gen_double_gyre']}), x AS (SELECT arg_min(range, abs(range * 2.0 / 19 - v)) AS i0 FROM range(20), (SELECT (0.4 + 0.9 + 0.6) / 3 + 0.1 AS v)), y AS (SELECT arg_min(range, abs(range / 9.0 - 0.6)) AS j1 FROM range(10)) SELECT t, (s // 10 - i0) * j1 + s % 10 AS s, q FROM f, x, y WHERE s // 10 >= i0 AND s % 10 < j1"
    q["phase_unwrap_H"] = f"WITH {H}, {blocks('H', 'hamming')}, a AS (SELECT f, s, b, atan2(im, re) AS p FROM Q WHERE f BETWEEN 1 AND 11), d AS (SELECT *, p - lag(p) OVER (PARTITION BY f, s ORDER BY b) AS d FROM a), w AS (SELECT f, s, b, p, sum(CASE WHEN d > pi() THEN -1 WHEN d < -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY f, s ORDER BY b) AS n FROM d) SELECT f, s, b, {r('p + 2 * pi() * n', 'phase')} FROM w"
    q["pod_trace_D"] = f"WITH {D} SELECT {r('sum(v)', 'trace')} FROM (SELECT var_pop(q) AS v FROM D GROUP BY s)"
    q["pod_trace_E"] = f"WITH {E} SELECT {r('sum(v)', 'trace')} FROM (SELECT var_pop(q) AS v FROM E GROUP BY s)"
    q["stpod_trace_H"] = q["stpod_energy_H"].replace("AS energy", "AS trace")
    return q
