"""SQL for the queries, in the dialect of the engine they are compared with."""

from __future__ import annotations

from ..functions.exprs import FAR, MEDIAN, NEAR, TAIL

MICRO = "CAST(floor(({0}) * 1e6 + 0.5137) AS BIGINT)"
MILLI = "CAST(floor(({0}) * 1e3 + 0.5137) AS BIGINT)"
NANO = "CAST(floor(({0}) * 1e9 + 0.5137) AS BIGINT)"


def sql(ctes: list[str], last: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + last


CO_PURCHASE = [
    "items AS (SELECT CAST(c_nationkey AS BIGINT) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS graph_id, l_orderkey, p_brand, l_returnflag, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)",
    "nodes AS MATERIALIZED (SELECT graph_id, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY p_brand) - 1 AS INTEGER) AS node_id, p_brand AS label, d FROM (SELECT graph_id, p_brand, avg(l_discount) AS d FROM items GROUP BY ALL))",
    "baskets AS (SELECT DISTINCT graph_id, l_orderkey, p_brand, l_returnflag FROM items)",
    "held AS (SELECT x.graph_id, x.p_brand AS a, y.p_brand AS b, x.l_orderkey, bool_or(x.l_returnflag = y.l_returnflag) AS same FROM baskets x JOIN baskets y ON x.graph_id = y.graph_id AND x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY ALL)",
    "counted AS (SELECT graph_id, a, b, CAST(count(*) AS DOUBLE) AS weight, CASE WHEN bool_or(same) THEN 'S' ELSE 'D' END AS edge_label FROM held GROUP BY 1, 2, 3)",
    "above AS (SELECT * FROM (SELECT *, avg(weight) OVER (PARTITION BY graph_id) AS mean FROM counted) WHERE weight > mean)",
    "edges AS MATERIALIZED (SELECT e.graph_id, x.node_id AS src, y.node_id AS dst, e.weight, e.edge_label FROM above e JOIN nodes x ON x.graph_id = e.graph_id AND x.label = e.a JOIN nodes y ON y.graph_id = e.graph_id AND y.label = e.b)",
    "graphs AS MATERIALIZED (SELECT DISTINCT graph_id, CAST(1 + (graph_id // 10) % 2 AS INTEGER) AS sample FROM nodes)",
    "arcs AS MATERIALIZED (SELECT graph_id, src, dst, weight, edge_label FROM edges UNION ALL SELECT graph_id, dst, src, weight, edge_label FROM edges)",
]
EVENTS = [
    "ev AS (SELECT CAST(strftime(ts, '%Y%m%d') AS BIGINT) AS graph_id, event_type, lead(event_type) OVER (PARTITION BY CAST(ts AS DATE), user_id ORDER BY ts, event_id) AS next FROM events)",
    "nodes AS MATERIALIZED (SELECT graph_id, CAST(dense_rank() OVER (PARTITION BY graph_id ORDER BY event_type) - 1 AS INTEGER) AS node_id, event_type AS label FROM (SELECT DISTINCT graph_id, event_type FROM ev))",
    "edges AS MATERIALIZED (SELECT e.graph_id, x.node_id AS src, y.node_id AS dst, CAST(count(*) AS DOUBLE) AS weight FROM ev e JOIN nodes x ON x.graph_id = e.graph_id AND x.label = e.event_type JOIN nodes y ON y.graph_id = e.graph_id AND y.label = e.next GROUP BY ALL)",
    "graphs AS MATERIALIZED (SELECT DISTINCT graph_id, CASE WHEN graph_id % 100 < 16 THEN 1 ELSE 2 END AS sample FROM nodes)",
    "arcs AS MATERIALIZED (SELECT graph_id, src, dst, weight FROM edges)",
]
#: EVENTS without direction, weights of both directions added.
UNDIRECTED = [
    EVENTS[0], EVENTS[1], EVENTS[2].replace("edges AS MATERIALIZED", "directed_edges AS MATERIALIZED"),
    "edges AS MATERIALIZED (SELECT graph_id, least(src, dst) AS src, greatest(src, dst) AS dst, sum(weight) AS weight FROM directed_edges GROUP BY ALL)", EVENTS[3],
    "arcs AS MATERIALIZED (SELECT graph_id, src, dst, weight FROM edges UNION ALL SELECT graph_id, dst, src, weight FROM edges WHERE src <> dst)",
]


def unweighted(ctes: list[str]) -> list[str]:
    """The same graphs, every edge of weight 1."""
    return [x.replace(" weight", " CAST(1 AS DOUBLE) AS weight") if x.startswith("arcs ") else x for x in ctes]


POOLED = "pooled AS MATERIALIZED (SELECT *, CAST(row_number() OVER (ORDER BY sample, graph_id) - 1 AS INTEGER) AS ord, row_number() OVER (PARTITION BY sample ORDER BY graph_id) - 1 AS pos FROM graphs)"
PAIRS = "pairs AS MATERIALIZED (SELECT a.ord AS i, b.ord AS j FROM pooled a JOIN pooled b ON a.ord <= b.ord)"
DEGREES = "degrees AS (SELECT n.graph_id, n.node_id, count(e.p) AS degree FROM nodes n LEFT JOIN (SELECT graph_id, src AS p FROM edges UNION ALL SELECT graph_id, dst FROM edges) e ON e.graph_id = n.graph_id AND e.p = n.node_id GROUP BY ALL)"


def refined(h: int, label: str = "label", nodes: str = "nodes") -> list[str]:
    out = [f"w0 AS MATERIALIZED (SELECT graph_id, node_id, coalesce({label}, '-1') AS l FROM {nodes})"]
    for t in range(1, h + 1):
        out.append(f"w{t} AS MATERIALIZED (SELECT n.graph_id, n.node_id, md5(concat_ws('-', n.l, coalesce(string_agg(m.l, '-' ORDER BY m.l), ''))) AS l FROM w{t - 1} n LEFT JOIN arcs a ON a.graph_id = n.graph_id AND a.src = n.node_id LEFT JOIN w{t - 1} m ON m.graph_id = a.graph_id AND m.node_id = a.dst GROUP BY n.graph_id, n.node_id, n.l)")
    out.append("wl AS (" + " UNION ALL ".join(f"SELECT graph_id, node_id, {t} AS it, l AS label FROM w{t}" for t in range(h + 1)) + ")")
    out.append("wc AS MATERIALIZED (SELECT graph_id, it, label, CAST(count(*) AS DOUBLE) AS n FROM wl GROUP BY ALL)")
    return out


WL_FREQ = "feat AS MATERIALIZED (SELECT graph_id, concat_ws('+', CAST(it AS VARCHAR), label) AS feature, n / sum(n) OVER (PARTITION BY graph_id) AS v FROM wc)"
WL_FREQ_IT = "feat AS MATERIALIZED (SELECT graph_id, concat_ws('+', CAST(it AS VARCHAR), label) AS feature, n / sum(n) OVER (PARTITION BY graph_id, it) AS v FROM wc)"
WL_COUNT = "feat AS MATERIALIZED (SELECT graph_id, concat_ws('+', CAST(it AS VARCHAR), label) AS feature, n AS v FROM wc)"
DOT = [
    POOLED, PAIRS, "fo AS (SELECT p.ord, f.feature, f.v FROM feat f JOIN pooled p USING (graph_id))",
    "prod AS (SELECT a.ord AS i, b.ord AS j, sum({how}) AS k FROM fo a JOIN fo b ON a.feature = b.feature AND a.ord <= b.ord GROUP BY 1, 2)",
    "gram AS MATERIALIZED (SELECT i, j, coalesce(k, 0.0) AS k FROM pairs LEFT JOIN prod USING (i, j))",
]


def dot(how: str = "a.v * b.v") -> list[str]:
    return [x.replace("{how}", how) for x in DOT]


def walk(steps: int, first: str, arcs: str, keys: str = "graph_id") -> list[str]:
    """v0 .. v_steps from a table `first` (keys, node_id, v) over a table `arcs` (graph_id, src, dst, weight)."""
    ks = [k.strip() for k in keys.split(",")]
    out = [f"v0 AS MATERIALIZED (SELECT {keys}, node_id, v FROM {first})"]
    at = lambda a: ", ".join(f"{a}.{k}" for k in ks)
    same = " AND ".join(f"b.{k} = a.{k}" for k in ks)
    for k in range(1, steps + 1):
        arc_keys = " AND ".join(f"x.{c} = m.{c}" for c in (ks if arcs == "larcs" else ["graph_id"]))
        out.append(f"s{k} AS (SELECT {at('m')}, x.src AS node_id, sum(x.weight * m.v) AS v FROM {arcs} x JOIN v{k - 1} m ON {arc_keys} AND x.dst = m.node_id GROUP BY ALL)")
        out.append(f"v{k} AS MATERIALIZED (SELECT {at('a')}, a.node_id, coalesce(b.v, 0.0) AS v FROM v{k - 1} a LEFT JOIN s{k} b ON {same} AND b.node_id = a.node_id)")
    return out


START = "p AS MATERIALIZED (SELECT graph_id, node_id, 1.0 / count(*) OVER (PARTITION BY graph_id) AS v FROM nodes)"
SERIES = [
    POOLED, PAIRS, "fo AS (SELECT p.ord, f.feature, f.power, f.v FROM feat f JOIN pooled p USING (graph_id))",
    "prod AS (SELECT a.ord AS i, b.ord AS j, sum(pow(CAST({c} AS DOUBLE), a.power) * a.v * b.v) AS k FROM fo a JOIN fo b ON a.feature = b.feature AND a.power = b.power AND a.ord <= b.ord GROUP BY 1, 2)",
    "gram AS MATERIALIZED (SELECT i, j, coalesce(k, 0.0) AS k FROM pairs LEFT JOIN prod USING (i, j))",
]


def series(c: float) -> list[str]:
    return [x.replace("{c}", repr(c)) for x in SERIES]


def simple_walk(c: float, steps: int, arcs: str) -> list[str]:
    feat = " UNION ALL ".join(f"SELECT p.graph_id, '{k}' AS feature, {k} AS power, sum(p.v * v{k}.v) AS v FROM p JOIN v{k} USING (graph_id, node_id) GROUP BY 1" for k in range(steps + 1))
    return [START, *walk(steps, "p", arcs), f"feat AS MATERIALIZED ({feat})", *series(c)]


LEADING = [
    POOLED, PAIRS, "modes AS MATERIALIZED (SELECT ord, base, coalesce(mu, 0.0) AS mu, coalesce(sigma, 0.0) AS sigma FROM pooled JOIN (SELECT graph_id, sum(v * v) AS base FROM p GROUP BY 1) USING (graph_id) LEFT JOIN top USING (graph_id))",
    "gram AS MATERIALIZED (SELECT i, j, a.base * b.base + {c} * a.sigma * b.sigma / (1 - {c} * a.mu * b.mu) AS k FROM pairs JOIN modes a ON a.ord = i JOIN modes b ON b.ord = j)",
]


def leading(c: float) -> list[str]:
    return [x.replace("{c}", f"CAST({c!r} AS DOUBLE)") for x in LEADING]


def leading_eigenvalue(c: float, steps: int = 40) -> list[str]:
    """The symmetric kernel at rank 1: powers of the adjacency on p leave its leading mode, mu = m81 / m80 and sigma = mu (p . u)^2, where m80 = (p . u)^2 mu^80."""
    ends = f"SELECT graph_id, sum(a.v * a.v) AS m, sum(a.v * b.v) AS m1 FROM v{steps} a JOIN v{steps + 1} b USING (graph_id, node_id) GROUP BY 1"
    return [START, "narcs AS MATERIALIZED (SELECT graph_id, src, dst, weight / 16 AS weight FROM arcs)", *walk(steps + 1, "p", "narcs"), f"top AS (SELECT graph_id, 16 * m1 / m AS mu, 16 * m1 / m * m / pow(m1 / m, {2 * steps}) AS sigma FROM ({ends}) WHERE m > 0)", *leading(c)]


def leading_singular(c: float, arcs: str, rounds: int = 24) -> list[str]:
    """The kernel of X (a table arcs) at rank 1: (X'X)^k p leaves v, u = X v / w; mu = w v.u, sigma = w (p.u) (v.p)."""
    out = [START, f"back AS MATERIALIZED (SELECT graph_id, dst AS src, src AS dst, weight FROM {arcs})", "z0 AS MATERIALIZED (SELECT graph_id, node_id, v FROM p)"]
    for k in range(1, rounds + 1):
        for name, source, over in ((f"y{k}", f"z{k - 1}", arcs), (f"x{k}", f"y{k}", "back")):
            out.append(f"{name} AS MATERIALIZED (SELECT n.graph_id, n.node_id, coalesce(sum(x.weight * m.v), 0.0) AS v FROM nodes n LEFT JOIN {over} x ON x.graph_id = n.graph_id AND x.src = n.node_id LEFT JOIN {source} m ON m.graph_id = x.graph_id AND m.node_id = x.dst GROUP BY ALL)")
        out.append(f"z{k} AS MATERIALIZED (SELECT graph_id, node_id, v / nullif(sqrt(sum(v * v) OVER (PARTITION BY graph_id)), 0) AS v FROM x{k})")
    out.append(f"wu AS MATERIALIZED (SELECT n.graph_id, n.node_id, coalesce(sum(x.weight * m.v), 0.0) AS v FROM nodes n LEFT JOIN {arcs} x ON x.graph_id = n.graph_id AND x.src = n.node_id LEFT JOIN z{rounds} m ON m.graph_id = x.graph_id AND m.node_id = x.dst GROUP BY ALL)")
    out.append(f"top AS (SELECT graph_id, sum(a.v * b.v) AS mu, sum(p.v * a.v) * sum(p.v * b.v) AS sigma FROM wu a JOIN z{rounds} b USING (graph_id, node_id) JOIN p USING (graph_id, node_id) GROUP BY 1)")
    return [*out, *leading(c)]


def sinkhorn(h: int, reg: float, rounds: int = 50) -> list[str]:
    """The entropic plan over all node pairs, scalings in turn, from labels wl (graph_id, node_id, it, label)."""
    out = [
        POOLED, PAIRS, "seq AS MATERIALIZED (SELECT ord, node_id, it, wl.label FROM wl JOIN pooled USING (graph_id))", "mass AS MATERIALIZED (SELECT ord, count(DISTINCT node_id) AS n FROM seq GROUP BY 1)",
        f"cells AS MATERIALIZED (SELECT x.ord AS i, y.ord AS j, x.node_id AS a, y.node_id AS b, avg(CASE WHEN x.label = y.label THEN 0.0 ELSE 1.0 END) AS c FROM seq x JOIN seq y ON x.ord <= y.ord AND x.it = y.it GROUP BY ALL)",
        f"kern AS MATERIALIZED (SELECT i, j, a, b, c, exp(-c / {reg!r}) AS k, p.n AS ni, q.n AS nj FROM cells JOIN mass p ON p.ord = i JOIN mass q ON q.ord = j)", "u0 AS MATERIALIZED (SELECT DISTINCT i, j, a, CAST(1 AS DOUBLE) AS s FROM kern)",
    ]
    for r in range(1, rounds + 1):
        out.append(f"s{r} AS MATERIALIZED (SELECT i, j, b, 1 / (any_value(nj) * sum(k * s)) AS s FROM kern JOIN u{r - 1} USING (i, j, a) GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY i, j, b"))
        out.append(f"u{r} AS MATERIALIZED (SELECT i, j, a, 1 / (any_value(ni) * sum(k * s)) AS s FROM kern JOIN s{r} USING (i, j, b) GROUP BY i, j, a)")
    return [*out, f"gram AS (SELECT i, j, sum(u.s * k * v.s * c) AS k FROM kern JOIN u{rounds} u USING (i, j, a) JOIN s{rounds} v USING (i, j, b) GROUP BY i, j)"]


def propagation(t_max: int, w: float, seed: int = 0) -> list[str]:
    """Bins of diffused label distributions under Cauchy directions drawn by hashes."""
    unit = lambda *parts: f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 12) AS BIGINT) + 0.5) / {float(1 << 48)!r})"
    out = ["step AS MATERIALIZED (SELECT graph_id, src, dst, 1.0 / count(*) OVER (PARTITION BY graph_id, src) AS p FROM arcs)", "d0 AS MATERIALIZED (SELECT graph_id, node_id, label AS dim, CAST(1 AS DOUBLE) AS v FROM nodes)"]
    for t in range(t_max + 1):
        if t:
            out.append(f"d{t} AS MATERIALIZED (SELECT s.graph_id, s.src AS node_id, dim, sum(p * v) AS v FROM step s JOIN d{t - 1} d ON d.graph_id = s.graph_id AND d.node_id = s.dst GROUP BY 1, 2, 3)")
        draw = f"tan(pi() * ({unit(repr(str(seed)), repr(str(t)), 'dim')} - 0.5))"
        shift = f"({w!r} * {unit(repr(str(seed)), repr(str(t)), repr('shift'))})"
        out.append(f"b{t} AS MATERIALIZED (SELECT n.graph_id, CAST(floor((coalesce(x, 0.0) + {shift}) / {w!r}) AS BIGINT) AS bin FROM nodes n LEFT JOIN (SELECT graph_id, node_id, sum(v * {draw}) AS x FROM d{t} GROUP BY 1, 2) USING (graph_id, node_id))")
    bins = " UNION ALL ".join(f"SELECT graph_id, '{t}+' || bin AS feature FROM b{t}" for t in range(t_max + 1))
    return [*out, f"feat AS MATERIALIZED (SELECT graph_id, feature, CAST(count(*) AS DOUBLE) AS v FROM ({bins}) GROUP BY 1, 2)", *dot()]


def pyramid(levels: int) -> list[str]:
    """Points from the attribute d, rounded to 9 places; levels as the sums of their definition, without the weights."""
    out = [POOLED, PAIRS, "points AS (SELECT p.ord, n.label, round(n.d, 9) AS x FROM nodes n JOIN pooled p USING (graph_id))"]
    out.append(f"cells AS MATERIALIZED (SELECT ord, l, label, least(floor(x * pow(2, l)), pow(2, l) - 1) AS cell, count(*) AS n FROM points CROSS JOIN (SELECT unnest(range({levels})) AS l) GROUP BY ALL)")
    out.append("met AS (SELECT a.ord AS i, b.ord AS j, a.l, sum(least(a.n, b.n)) AS same FROM cells a JOIN cells b ON a.l = b.l AND a.label = b.label AND a.cell = b.cell AND a.ord <= b.ord GROUP BY ALL)")
    out.append(f"graded AS (SELECT i, j, l, coalesce(same, 0) AS same, lead(coalesce(same, 0)) OVER (PARTITION BY i, j ORDER BY l) AS finer FROM pairs CROSS JOIN (SELECT unnest(range({levels})) AS l) LEFT JOIN met USING (i, j, l))")
    out.append(f"gram AS (SELECT i, j, sum(CASE WHEN finer IS NULL THEN same ELSE (same - finer) / pow(2, {levels - 1} - l) END) AS k FROM graded GROUP BY i, j)")
    return out


def edge_walk(c: float, steps: int) -> list[str]:
    feat = "SELECT graph_id, '0' AS feature, 0 AS power, sum(v * v) AS v FROM p GROUP BY 1" + "".join(f" UNION ALL SELECT p.graph_id, '{k}:' || l, {k}, sum(p.v * v{k}.v) FROM p JOIN v{k} ON p.graph_id = v{k}.graph_id AND p.node_id = v{k}.node_id GROUP BY p.graph_id, l" for k in range(1, steps + 1))
    return [
        START, "vocab AS (SELECT DISTINCT edge_label AS l FROM edges)", "larcs AS MATERIALIZED (SELECT graph_id, l, src, dst, weight FROM arcs, vocab WHERE edge_label <> l)",
        "lp AS (SELECT graph_id, l, node_id, v FROM p, vocab)", *walk(steps, "lp", "larcs", "graph_id, l"), f"feat AS MATERIALIZED ({feat})", *series(c),
    ]


def label_walk(c: float, steps: int, label: str = "substr(label, 7, 1)") -> list[str]:
    feat = "SELECT graph_id, '0' AS feature, 0 AS power, sum(v * v) AS v FROM p GROUP BY 1" + "".join(f" UNION ALL SELECT n.graph_id, '{k}:' || n.label || ':' || l, {k}, sum(p.v * v{k}.v) FROM nl n JOIN p ON p.graph_id = n.graph_id AND p.node_id = n.node_id JOIN v{k} ON v{k}.graph_id = n.graph_id AND v{k}.node_id = n.node_id GROUP BY n.graph_id, n.label, l" for k in range(1, steps + 1))
    return [
        START, f"nl AS MATERIALIZED (SELECT graph_id, node_id, {label} AS label FROM nodes)", "vocab AS (SELECT DISTINCT graph_id, label AS l FROM nl)",
        "lp AS (SELECT p.graph_id, l, p.node_id, CASE WHEN n.label = l THEN p.v ELSE 0.0 END AS v FROM p JOIN nl n USING (graph_id, node_id) JOIN vocab USING (graph_id))",
        *walk(steps, "lp", "arcs", "graph_id, l"), f"feat AS MATERIALIZED ({feat})", *series(c),
    ]


def tangent(mlps: int, scale: str, feature: str) -> list[str]:
    f = "SELECT graph_id, node_id, degree AS dim, CAST(1 AS DOUBLE) AS v FROM degrees" if feature == "degree" else "SELECT graph_id, node_id, 0 AS dim, d AS v FROM nodes"
    out = [
        DEGREES, POOLED, PAIRS, f"f AS MATERIALIZED ({f})",
        "nb AS MATERIALIZED (SELECT graph_id, src AS node_id, dst AS other, 1 AS m FROM edges UNION ALL SELECT graph_id, dst, src, 1 FROM edges UNION ALL SELECT graph_id, node_id, node_id, 1 FROM nodes)",
        "size AS (SELECT graph_id, node_id, sum(m) AS m FROM nb GROUP BY ALL)",
        f"h AS MATERIALIZED (SELECT p.ord, nb.node_id, f.dim, sum(nb.m * f.v){' / any_value(size.m)' if scale == 'degree' else ''} AS v FROM nb JOIN f ON f.graph_id = nb.graph_id AND f.node_id = nb.other JOIN size ON size.graph_id = nb.graph_id AND size.node_id = nb.node_id JOIN pooled p ON p.graph_id = nb.graph_id GROUP BY p.ord, nb.node_id, f.dim)",
        "dg AS MATERIALIZED (SELECT ord, node_id, sqrt(sum(v * v)) AS d FROM h GROUP BY ALL)",
        "s AS (SELECT a.ord AS i, b.ord AS j, a.node_id AS u, b.node_id AS w, sum(a.v * b.v) AS s FROM h a JOIN h b ON a.dim = b.dim AND a.ord <= b.ord GROUP BY ALL)",
        "t0 AS (SELECT i, j, u, w, d1, d2, coalesce(s, 0.0) AS s, coalesce(s, 0.0) AS t FROM (SELECT a.ord AS i, b.ord AS j, a.node_id AS u, b.node_id AS w, a.d AS d1, b.d AS d2 FROM dg a JOIN dg b ON a.ord <= b.ord) LEFT JOIN s USING (i, j, u, w))",
    ]
    for k in range(mlps):
        r = f"(CASE WHEN abs(s / d1 / d2) > {1 - NEAR!r} THEN sign(s) ELSE s / d1 / d2 END)"
        out.append(f"t{k + 1} AS (SELECT i, j, u, w, d1, d2, n AS s, t * ds + n AS t FROM (SELECT *, CASE WHEN d1 > 0 AND d2 > 0 THEN ({r} * (pi() - acos({r})) + sqrt(greatest(1 - {r} * {r}, 0.0))) / pi() * d1 * d2 ELSE 0.0 END AS n, CASE WHEN d1 > 0 AND d2 > 0 THEN (pi() - acos({r})) / pi() ELSE 0.0 END AS ds FROM t{k}))")
    return [
        *out, "g AS (SELECT p.ord, dim, sum(v) AS v FROM f JOIN pooled p USING (graph_id) GROUP BY ALL)",
        "raw AS (SELECT a.ord AS i, b.ord AS j, sum(a.v * b.v) AS raw FROM g a JOIN g b ON a.dim = b.dim AND a.ord <= b.ord GROUP BY ALL)",
    ]


def tangent_deep(mlps: int, scale: str, feature: str) -> list[str]:
    """Three layers: tangent, then one more aggregation over neighbours of covariances and derivatives, and its perceptrons."""
    by = " / (any_value(x.m) * any_value(y.m))" if scale == "degree" else ""
    out = [
        *tangent(mlps, scale, feature),
        "nbo AS MATERIALIZED (SELECT p.ord, nb.node_id, nb.other, sum(nb.m) AS c, any_value(size.m) AS m FROM nb JOIN size USING (graph_id, node_id) JOIN pooled p USING (graph_id) GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY 1, 2, 3"),
        f"q AS MATERIALIZED (SELECT t.i, t.j, x.node_id AS u, y.node_id AS w, sum(x.c * y.c * t.s){by} AS s, sum(x.c * y.c * t.t){by} AS t FROM t{mlps} t JOIN nbo x ON x.ord = t.i AND x.other = t.u JOIN nbo y ON y.ord = t.j AND y.other = t.w GROUP BY 1, 2, 3, 4)",
        "dq AS (SELECT i AS ord, u AS node_id, sqrt(greatest(s, 0.0)) AS d FROM q WHERE i = j AND u = w)",
        "u0 AS (SELECT q.i, q.j, q.u, q.w, a.d AS d1, b.d AS d2, q.s, q.t FROM q JOIN dq a ON a.ord = q.i AND a.node_id = q.u JOIN dq b ON b.ord = q.j AND b.node_id = q.w)",
    ]
    step = {x.split(" ")[0]: x for x in out}["t1"]
    for k in range(mlps):
        out.append(step.replace("t1 AS", f"u{k + 1} AS").replace("FROM t0", f"FROM u{k}"))
    return out


def sums(by: str, pairs: str) -> str:
    w = "CASE WHEN same THEN k ELSE 2 * k END"
    return f"SELECT {by}sum(CASE WHEN a = 1 AND b = 1 THEN {w} ELSE 0 END) AS xx, sum(CASE WHEN a = 2 AND b = 2 THEN {w} ELSE 0 END) AS yy, sum(CASE WHEN a = 1 AND same THEN k ELSE 0 END) AS dx, sum(CASE WHEN a = 2 AND same THEN k ELSE 0 END) AS dy, sum(CASE WHEN a <> b THEN k ELSE 0 END) AS xy FROM {pairs} GROUP BY ALL"


SIZES = "sizes AS (SELECT CAST(count(*) FILTER (sample = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (sample = 2) AS DOUBLE) AS n2 FROM graphs)"
OBSERVED = [SIZES, "op AS (SELECT k, x.sample AS a, y.sample AS b, i = j AS same FROM gram JOIN pooled x ON x.ord = i JOIN pooled y ON y.ord = j)", f"os AS ({sums('', 'op')})"]
FORMULA = {
    "MMD_u": "(xx - dx) / (n1 * (n1 - 1)) + (yy - dy) / (n2 * (n2 - 1)) - 2 * xy / (n1 * n2)",
    "MMD_b": "xx / (n1 * n1) + yy / (n2 * n2) - 2 * xy / (n1 * n2)",
    "compat": "xx / (n1 * n1) + yy / (n1 * n2) - 2 * xy / (n2 * n2)",
}


def permuted(b: int, seed: int) -> list[str]:
    return [
        f"asg AS MATERIALIZED (SELECT b, ord, CASE WHEN row_number() OVER (PARTITION BY b ORDER BY md5(concat_ws('|', '{seed}', CAST(b AS VARCHAR), CAST(graph_id AS VARCHAR))), graph_id) <= (SELECT n1 FROM sizes) THEN 1 ELSE 2 END AS a FROM pooled, (SELECT unnest(range(1, {b + 1})) AS b))",
        "np AS (SELECT x.b AS round, k, x.a AS a, y.a AS b, i = j AS same FROM gram JOIN asg x ON x.ord = i JOIN asg y ON y.ord = j AND y.b = x.b)", f"ns AS MATERIALIZED ({sums('round, ', 'np')})",
    ]


def booted(b: int, seed: int) -> list[str]:
    return [
        f"asg AS MATERIALIZED (SELECT b, ord AS slot, CAST(CAST('0x' || substr(md5(concat_ws('|', '{seed}', CAST(b AS VARCHAR), CAST(ord AS VARCHAR))), 1, 8) AS BIGINT) % (SELECT count(*) FROM pooled) AS INTEGER) AS ord, CASE WHEN ord < (SELECT n1 FROM sizes) THEN 1 ELSE 2 END AS a FROM pooled, (SELECT unnest(range(1, {b + 1})) AS b))",
        "full_ AS (SELECT i, j, k FROM gram UNION ALL SELECT j, i, k FROM gram WHERE i < j)",
        "np AS (SELECT x.b AS round, k, x.a AS a, y.a AS b, x.slot = y.slot AS same FROM full_ JOIN asg x ON x.ord = i JOIN asg y ON y.ord = j AND y.b = x.b AND x.slot <= y.slot)", f"ns AS MATERIALIZED ({sums('round, ', 'np')})",
    ]


OBS = [
    "obs AS (SELECT CAST(1 + (vec_id // 25) % 2 AS INTEGER) AS sample, vec_id AS row_idx, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)",
    "win AS (SELECT *, row_idx // 25 AS win FROM obs QUALIFY count(*) OVER (PARTITION BY sample, row_idx // 25) = 25)",
    "cells AS (SELECT sample, win, row_idx, CAST(c - 1 AS INTEGER) AS col, x[c] AS x FROM win, (SELECT unnest(range(1, 65)) AS c))",
]


def horner(of: tuple[tuple[float, ...], tuple[float, ...]], x: str) -> str:
    """exprs.ratio in SQL, in doubles."""

    def poly(cs):
        out = f"CAST({cs[-1]!r} AS DOUBLE)"
        for c in reversed(cs[:-1]):
            out = f"({out} * ({x}) + CAST({c!r} AS DOUBLE))"
        return out

    return f"({poly(of[0])} / {poly(of[1])})"


RANKED = [
    *OBS,
    "ranked AS (SELECT *, rank() OVER (PARTITION BY sample, win, col ORDER BY x) + (count(*) OVER (PARTITION BY sample, win, col, x) - 1) / 2.0 AS r, CAST(count(*) OVER w AS DOUBLE) AS n, avg(x) OVER w AS mean, sqrt(var_pop(x) OVER w) AS sd FROM cells WINDOW w AS (PARTITION BY sample, win, col))",
    "clipped AS (SELECT *, greatest(d, least(1 - d, r / n)) AS p FROM (SELECT *, 1 / (4 * pow(n, 0.25) * sqrt(pi() * ln(n))) AS d FROM ranked))",
    f"scored AS (SELECT *, CASE WHEN abs(p - 0.5) <= 0.425 THEN (p - 0.5) * {horner(MEDIAN, '0.180625 - (p - 0.5) * (p - 0.5)')} WHEN t <= 5 THEN sign(p - 0.5) * {horner(TAIL, 't - 1.6')} ELSE sign(p - 0.5) * {horner(FAR, 't - 5')} END AS z FROM (SELECT *, sqrt(-ln(least(p, 1 - p))) AS t FROM clipped))",
]


def compared(estimator: str, unit: str, null: str, observed: str, name: str) -> list[str]:
    """(estimator, statistic, p_value) as a table `name`, from a statistic over the resamples and the observed one."""
    return [
        f"n_{name} AS MATERIALIZED ({null})", f"o_{name} AS MATERIALIZED ({observed})",
        f"r_{name} AS (SELECT '{estimator}' AS estimator, {unit.format('any_value(o.s)')} AS statistic_units, avg(CASE WHEN n.s >= o.s - 1e-9 * greatest(abs(o.s), top) THEN 1.0 ELSE 0.0 END) AS p_value FROM n_{name} n, o_{name} o, (SELECT max(abs(s)) AS top FROM n_{name}))",
    ]


def full_test(gram: list[str], b: int, seed: int, scheme: str = "permutation", estimators: tuple[str, ...] = ("MMD_u", "MMD_b"), unit: str = NANO) -> str:
    """two_sample_test in SQL: one row per estimator, on shared resamples."""
    out = [*gram, *OBSERVED, *(permuted(b, seed) if scheme == "permutation" else booted(b, seed))]
    for e in estimators:
        if e == "MMD_l":
            half = "CAST(n1 - n1 % 2 AS BIGINT)"
            place = "asgp AS MATERIALIZED (SELECT b, ord, a, row_number() OVER (PARTITION BY b, a ORDER BY md5(concat_ws('|', '{0}', CAST(b AS VARCHAR), CAST(graph_id AS VARCHAR))), graph_id) - 1 AS q FROM asg JOIN pooled USING (ord))".replace("{0}", str(seed))
            pairs = "FROM gram JOIN {0} x ON x.ord = i JOIN {0} y ON y.ord = j{1}, sizes WHERE x.{2} <> y.{2} AND x.{2} // 2 = y.{2} // 2 AND x.{2} < " + half + " AND y.{2} < " + half
            total = "sum(CASE WHEN x.{3} = y.{3} THEN k ELSE -k END) / any_value(" + half + " / 2) AS s "
            out.append(place)
            null = "SELECT x.b AS b, " + (total + pairs).format("asgp", " AND y.b = x.b", "q", "a") + " GROUP BY x.b"
            seen = "SELECT " + (total + pairs).format("pooled", "", "pos", "sample")
            out += compared(e, unit, null, seen, e)
        else:
            out += compared(e, unit, f"SELECT {FORMULA[e]} AS s FROM ns, sizes", f"SELECT {FORMULA[e]} AS s FROM os, sizes", e)
    rows = " UNION ALL ".join(f"SELECT estimator, statistic_units, p_value, CAST(n1 AS INTEGER) AS n1, CAST(n2 AS INTEGER) AS n2, CAST({b} AS INTEGER) AS B FROM r_{e}, sizes" for e in estimators)
    last = f"SELECT * FROM ({rows})"
    return "WITH " + ("RECURSIVE " if any(x.startswith("bfs ") for x in out) else "") + ",\n".join(out) + "\n" + last
