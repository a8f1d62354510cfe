"""DuckDB SQL of the registered queries, written from the formulas and apart from the DataFrame plans."""

from __future__ import annotations

from incrementa.functions.binning import phi_edges, product_edges, theta_edges, value_edges
from incrementa.operators.channels import MAGNITUDES, PRODUCTS
from incrementa.plans.fixtures import DISPLACEMENTS, ELL, SAMPLES

XYZ = "xyz"
VECS = ["v", "b", "va", "zp", "zm", "omega", "j", "curv", "grad_rho"]
FIELDS = ["rho", *(f"{v}_{c}" for v in VECS for c in XYZ)]


def num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def edges_list(edges: list[float]) -> str:
    return "[" + ", ".join(map(num, edges)) + "]"


def bin_of(value: str, edges: list[float]) -> str:
    n = len(edges) - 1
    k = f"(len(list_filter({edges_list(edges)}, lambda e: e <= {value})) - 1)"
    return f"CAST(CASE WHEN isnan({value}) OR {value} < {num(edges[0])} OR {value} >= {num(edges[-1])} THEN -1 ELSE least({k}, {n - 1}) END AS INTEGER)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes)


LINES = """li AS (SELECT l_orderkey, max(l_extendedprice) AS hi, min(l_extendedprice) AS lo, CAST(sum(l_partkey) AS BIGINT) AS p,
 CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(l_suppkey) AS BIGINT) AS s FROM lineitem GROUP BY l_orderkey)"""
SEVEN = """0.5e0 + o_totalprice / 250000e0 AS {0}, coalesce((hi - 50000e0) / 50000e0, 0e0) AS {1},
 coalesce(((p * 7919) % 10007) / 10007e0 - 0.5e0, 0e0) AS {2}, coalesce(((q * 104729 + s) % 9973) / 9973e0 - 0.5e0, 0e0) AS {3},
 coalesce((lo - 20000e0) / 20000e0, 0e0) AS {4}, coalesce(((s * 7907 + p) % 10009) / 10009e0 - 0.5e0, 0e0) AS {5},
 coalesce(((p * 31 + q * 17 + s * 13) % 9967) / 9967e0 - 0.5e0, 0e0) AS {6}"""
NN = "nn AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM orders)"
PLANE = f"""{NN}, {LINES}, plane AS (SELECT CAST(o_orderkey // n AS INTEGER) AS j, CAST(o_orderkey % n AS INTEGER) AS i,
 {SEVEN.format("rho", "v_x", "v_y", "v_z", "b_x", "b_y", "b_z")}
 FROM orders CROSS JOIN nn LEFT JOIN li ON l_orderkey = o_orderkey WHERE o_orderkey < n * n)"""


def _grid() -> str:
    near = {"jp": (1, 0), "jm": (-1, 0), "ip": (0, 1), "im": (0, -1)}
    joins = " ".join(f"JOIN un {t} ON {t}.j = (a.j + {dj} + n) % n AND {t}.i = (a.i + {di} + n) % n" for t, (dj, di) in near.items())
    dx = lambda f: f"(ip.{f} - im.{f}) / (2e0 / n)"
    dy = lambda f: f"(jp.{f} - jm.{f}) / (2e0 / n)"
    out = {"omega": (dy("v_z"), f"-({dx('v_z')})", f"{dx('v_y')} - {dy('v_x')}"), "j": (dy("b_z"), f"-({dx('b_z')})", f"{dx('b_y')} - {dy('b_x')}"), "curv": tuple(f"a.n_x * ({dx('n_' + c)}) + a.n_y * ({dy('n_' + c)})" for c in XYZ), "grad_rho": (dx("rho"), dy("rho"), "0e0")}
    cols = ", ".join(f"{e} AS {v}_{c}" for v, es in out.items() for c, e in zip(XYZ, es))
    unit = ", ".join(f"b_{c} / sqrt(b_x * b_x + b_y * b_y + b_z * b_z + 1e-10) AS n_{c}" for c in XYZ)
    va = ", ".join(f"CASE WHEN rho > 0 AND NOT isnan(rho) THEN b_{c} * (1e0 / sqrt(greatest(rho, 1e-10))) ELSE 0e0 END AS va_{c}" for c in XYZ)
    z = ", ".join(f"v_{c} {s} va_{c} AS {name}_{c}" for name, s in (("zp", "+"), ("zm", "-")) for c in XYZ)
    base = "a.j, a.i, a.rho, " + ", ".join(f"a.{v}_{c}" for v in "vb" for c in XYZ)
    return f"""un AS (SELECT *, {unit} FROM plane), der AS (SELECT {base}, {cols} FROM un a CROSS JOIN nn {joins}),
 alf AS (SELECT *, {va} FROM der), grid AS (SELECT *, {z} FROM alf)"""


GRID = _grid()
DISP = "disp AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {di}, {dj})" for k, (di, dj) in enumerate(DISPLACEMENTS)) + ") AS t(disp_id, di, dj))"
SCALED = f"dr AS (SELECT *, sqrt(CAST(di * di + dj * dj AS DOUBLE)) AS r FROM disp), scaled AS (SELECT *, {bin_of('r', ELL)} AS ell_bin FROM dr WHERE {bin_of('r', ELL)} >= 0)"


def stirred(x: str, key: str) -> str:
    y = f"(({x}) * 48271 + ({key})) % 2147483647"
    return f"(({y}) * ((({y}) * ({y}) + 16807) % 2147483647)) % 2147483647"


def permuted(n: str, seed: int = 0) -> str:
    """CTEs up to ``samp``: ``n`` places of a keyed permutation for each displacement."""
    key = f"({stirred('CAST(disp_id AS BIGINT) * 69621 % 2147483647', str(seed))} * 40692 + disp_id) % 2147483647"
    ctes = [f"t0 AS (SELECT s.*, CAST(t.k AS INTEGER) AS k, {key} AS key, t.k // n AS j, t.k % n AS i, n AS size FROM scaled s CROSS JOIN nn CROSS JOIN (SELECT unnest(range({n})) AS k) t)"]
    for turn in range(4):
        at = f"(key + {turn * 1000003}) % 2147483647"
        ctes += [f"r{turn} AS (SELECT * REPLACE ((j + {stirred('i', at)}) % size AS j) FROM t{turn})", f"t{turn + 1} AS (SELECT * REPLACE ((i + {stirred('j', at)}) % size AS i) FROM r{turn})"]
    return ",\n ".join(ctes) + ",\n samp AS (SELECT disp_id, di, dj, r, ell_bin, k, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i FROM t4)"


SAMP = permuted(str(SAMPLES))
AFFINE = f"""pos AS (SELECT s.*, CAST(t.k AS INTEGER) AS k, (t.k * 7919 + disp_id * 104729) % (n * n) AS pos FROM scaled s CROSS JOIN nn CROSS JOIN (SELECT unnest(range({SAMPLES})) AS k) t),
 samp AS (SELECT disp_id, di, dj, r, ell_bin, k, CAST(pos // n AS INTEGER) AS j, CAST(pos % n AS INTEGER) AS i FROM pos CROSS JOIN nn)"""
POINTS = {2: (0, 1), 3: (-1, 0, 1), 5: (-2, -1, 0, 1, 2)}


def at(k: int) -> str:
    return f"g{'m' if k < 0 else ''}{abs(k)}"


def stencil_joins(width: int, source: str = "samp") -> str:
    return f"FROM {source} s CROSS JOIN nn " + " ".join(f"JOIN grid {at(k)} ON {at(k)}.j = ((s.j + {k} * s.dj) % n + n) % n AND {at(k)}.i = ((s.i + {k} * s.di) % n + n) % n" for k in POINTS[width])


def diff(f: str, width: int) -> str:
    if width == 2:
        return f"g1.{f} - g0.{f}"
    if width == 3:
        return f"g1.{f} - 2e0 * g0.{f} + gm1.{f}"
    return f"-1e0 * g2.{f} + 16e0 * g1.{f} + -30e0 * g0.{f} + 16e0 * gm1.{f} + -1e0 * gm2.{f}"


def mean(f: str, width: int) -> str:
    order = {2: (1, 0), 3: (1, 0, -1), 5: (2, 1, 0, -1, -2)}[width]
    return "(" + " + ".join(f"{at(k)}.{f}" for k in order) + f") / {width}e0"


def dot(a: str, b: str) -> str:
    return " + ".join(f"{a}_{c} * {b}_{c}" for c in XYZ)


def length(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def frames(width: int = 2, axis: int = 3) -> str:
    inc = ", ".join(f"{diff(f, width)} AS d_{f}" for f in FIELDS)
    m = ", ".join(f"{mean('b_' + c, width)} AS m_{c}" for c in XYZ)
    d = {1: ("0e0", "di", "dj"), 2: ("di", "0e0", "dj")}.get(axis, ("di", "dj", "0e0"))
    d = ", ".join(f"CAST({e} AS DOUBLE) AS d0_{c}" for c, e in zip(XYZ, d))
    perp = ", ".join(f"d_{v}_{c} - u_{c} * (d_{v}_x * u_x + d_{v}_y * u_y + d_{v}_z * u_z) AS q_{v}_{c}" for v in ("v", "b", "va", "omega", "j") for c in XYZ)
    return f"""inc AS (SELECT s.disp_id, s.di, s.dj, s.r, s.ell_bin, s.k, {inc}, {m} {stencil_joins(width)}),
 f1 AS (SELECT *, {d}, {length('m')} AS m_mag FROM inc),
 f2 AS (SELECT *, abs({dot('d0', 'm')}) / (r * m_mag) AS ct, {", ".join(f"m_{c} / m_mag AS u_{c}" for c in XYZ)}, ({dot('d0', 'm')}) / (m_mag * m_mag) AS along FROM f1 WHERE NOT (m_mag < 1e-10)),
 f3 AS (SELECT *, {perp}, {", ".join(f"d0_{c} - m_{c} * along AS e_{c}" for c in XYZ)} FROM f2),
 f4 AS (SELECT *, {length('e')} AS e_mag, {length('q_b')} AS p_mag, {dot('e', 'q_b')} AS ep FROM f3),
 f5 AS (SELECT *, acos(CASE WHEN isnan(ct) THEN ct ELSE least(ct, 1e0) END) AS theta,
  CASE WHEN e_mag > 0 AND p_mag > 0 AND NOT isnan(e_mag) AND NOT isnan(p_mag) THEN acos(CASE WHEN isnan(ep) THEN ep ELSE greatest(least(ep / (e_mag * p_mag), 1e0), -1e0) END) ELSE 0e0 END AS phi FROM f4),
 f6 AS (SELECT *, {bin_of('theta', theta_edges())} AS theta_bin, {bin_of('phi', phi_edges())} AS phi_bin FROM f5),
 framed AS (SELECT * FROM f6 WHERE theta_bin >= 0 AND phi_bin >= 0)"""


BASE = with_(PLANE, GRID, DISP, SCALED, SAMP)
BASE_AFFINE = with_(PLANE, GRID, DISP, SCALED, AFFINE)


def crossed(a: str, b: str) -> str:
    parts = [f"({a}_{p} * {b}_{q} - {a}_{q} * {b}_{p})" for p, q in (("y", "z"), ("z", "x"), ("x", "y"))]
    return "sqrt(" + " + ".join(f"{x} * {x}" for x in parts) + ")"


def value_of(channel: str) -> str:
    if channel in MAGNITUDES:
        return "abs(d_rho)" if MAGNITUDES[channel] == "rho" else length(f"d_{MAGNITUDES[channel]}")
    kind, a, b = PRODUCTS[channel]
    pre = "q_" if kind.startswith("perp") else "d_"
    return crossed(pre + a, pre + b) if kind.endswith("cross") else f"{length(pre + a)} * {length(pre + b)}"


def magnitude_rows(channels: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS channel, ell_bin, theta_bin, phi_bin, {bin_of('x', value_edges())} AS sf_bin FROM (SELECT *, {value_of(c)} AS x FROM framed)" for c in channels)


def product_rows(channels: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS channel, ell_bin, {bin_of('x', product_edges())} AS product_bin FROM (SELECT *, {value_of(c)} AS x FROM framed)" for c in channels)


def hist(channels: list[str]) -> str:
    return f"hist AS (SELECT channel, ell_bin, theta_bin, phi_bin, sf_bin, count(*) AS count FROM ({magnitude_rows(channels)}) WHERE sf_bin >= 0 GROUP BY ALL)"


def prod(channels: list[str]) -> str:
    return f"prod AS (SELECT channel, ell_bin, product_bin, count(*) AS count FROM ({product_rows(channels)}) WHERE product_bin >= 0 GROUP BY ALL)"
