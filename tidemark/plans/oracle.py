"""The drift queries as DuckDB SQL, put together from the same formulas."""

from __future__ import annotations

from .queries import COUNTED, GROWING, NULLED, TABLE_COLUMNS

EPS = "1e-12::DOUBLE"
CUBE = "(-0.3333333432674408)::DOUBLE"
BEFORE, AFTER = "l_shipdate < TIMESTAMP '1998-07-01'", "l_shipdate >= TIMESTAMP '1998-07-01'"
CONTINUOUS = ("JensenShannon", "PopulationStabilityIndex", "WassersteinDistance", "KullbackLeibler", "KolmogorovSmirnov", "Hellinger")
CATEGORICAL = ("JensenShannon", "PopulationStabilityIndex", "WassersteinDistance", "KullbackLeibler", "ChiSquared", "Hellinger", "GTest")

SHARED = {
    "JensenShannon": "sum(0.5 * p * ln(p / ((p + q) / 2)) + 0.5 * q * ln(q / ((p + q) / 2))) / ln(2::DOUBLE)",
    "PopulationStabilityIndex": "sum((p - q) * ln(p / q))",
    "KullbackLeibler": f"sum(p * ln(greatest(p / q, {EPS})))",
    "Hellinger": "sqrt(0.5 * sum((sqrt(p) - sqrt(q)) ** 2))",
}
FORMULAS = {
    "Continuous": SHARED | {"WassersteinDistance": "coalesce(sum(CASE WHEN bin BETWEEN 1 AND nb - 2 THEN abs(p - q) END), 0) / max(greatest(nb - 2, 1))", "KolmogorovSmirnov": "max(gap)"},
    "Categorical": SHARED
    | {
        "WassersteinDistance": "0.5 * sum(abs(p - q))",
        "ChiSquared": "sum((bl - eb) ** 2 / eb + (rt - er) ** 2 / er)",
        "GTest": f"2 * sum(bl * ln(greatest((bl + {EPS}) / eb, {EPS})) + rt * ln(greatest((rt + {EPS}) / er, {EPS})))",
    },
}


def n_bins(rule: str, n: str = "n", lo: str = "lo", hi: str = "hi", single: bool = False) -> str:
    t = "FLOAT" if single else "DOUBLE"
    if rule == "Sturges":
        return f"greatest(floor(log2({n}::DOUBLE))::BIGINT + 1, 3)"
    scale = f"(pow({n}::DOUBLE, {CUBE}))::{t}"
    width = f"(3.490000009536743::{t} * sd::{t} * {scale})" if rule == "Scott" else f"(2::{t} * (p75 - p25)::{t} * {scale})"
    flat = f"{hi} = {lo}" if rule == "Scott" else "p75 = p25"
    return f"CASE WHEN {flat} THEN 3 ELSE greatest(ceil((({hi} - {lo})::{t} / {width})::{t})::BIGINT, 3) END"


def stats(source: str) -> str:
    """CTEs st: n, rows, lo, hi, sd, p25, p75 of column v of a source."""
    return f"""
    vals AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM ({source}) WHERE v IS NOT NULL),
    st AS (SELECT count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v::DOUBLE) AS sd,
      max(CASE WHEN k = floor(0.25 * n)::BIGINT THEN v END) AS p25, max(CASE WHEN k = least(floor(0.75 * n)::BIGINT, n - 1) THEN v END) AS p75 FROM vals)"""


def edges(rule: str, single: bool = False) -> str:
    t = "FLOAT" if single else "DOUBLE"
    return f"""
    shape AS (SELECT *, {n_bins(rule, single=single)} AS nb FROM st),
    edges(i, e) AS (SELECT 0, lo::{t} FROM shape UNION ALL SELECT i + 1, (e + ((hi - lo)::{t} / nb::{t})::{t})::{t} FROM edges, shape WHERE i + 1 < nb - 1),
    es AS (SELECT list(e ORDER BY i) AS l FROM edges)"""


def binned(source: str) -> str:
    return f"SELECT CASE WHEN v IS NULL THEN NULL ELSE len(list_filter(l, lambda e: e <= v)) END AS bin, count(*)::DOUBLE AS n FROM ({source}), es GROUP BY 1"


def continuous_pairs(bl: str, rt: str, rule: str = "FreedmanDiaconis", with_nulls: bool = False, single: bool = False) -> str:
    """WITH clause ending in pairs(bin, bl, rt, bl_n, rt_n, nb, np). with_nulls: sizes include nulls."""
    size = "" if with_nulls else "WHERE bin IS NOT NULL"
    return f"""WITH RECURSIVE {stats(bl)}, {edges(rule, single)},
    hb AS ({binned(bl)}), hr AS ({binned(rt)}),
    pairs AS (SELECT g.bin, coalesce(hb.n, 0) AS bl, coalesce(hr.n, 0) AS rt, (SELECT sum(n) FROM hb {size}) AS bl_n, (SELECT sum(n) FROM hr {size}) AS rt_n, nb,
      (SELECT coalesce(sum(CASE WHEN bin IS NULL THEN n END), 0) / sum(n) FROM hr) AS np
      FROM (SELECT unnest(range(nb)) AS bin, nb FROM shape) g LEFT JOIN hb ON hb.bin = g.bin LEFT JOIN hr ON hr.bin = g.bin)"""


def categorical_pairs(bl: str, rt: str, with_nulls: bool = False, boolean: bool = False) -> str:
    size = "" if with_nulls else "WHERE v IS NOT NULL"
    seen = "(SELECT v, n FROM hb WHERE v IS NOT NULL)" if not boolean else "(SELECT x.v, coalesce(hb.n, 0) AS n FROM (VALUES (FALSE), (TRUE)) x(v) LEFT JOIN hb USING (v))"
    return f"""WITH hb AS (SELECT v, count(*)::DOUBLE AS n FROM ({bl}) GROUP BY v), hr AS (SELECT v, count(*)::DOUBLE AS n FROM ({rt}) GROUP BY v),
    pairs0 AS (
      SELECT s.n AS bl, coalesce(hr.n, 0) AS rt FROM {seen} s LEFT JOIN hr ON hr.v = s.v
      UNION ALL SELECT 0, coalesce((SELECT sum(n) FROM hr WHERE v IS NOT NULL AND v NOT IN (SELECT v FROM {seen})), 0)),
    pairs AS (SELECT 0 AS bin, bl, rt, (SELECT sum(n) FROM hb {size}) AS bl_n, (SELECT sum(n) FROM hr {size}) AS rt_n, 0 AS nb,
      (SELECT coalesce(sum(CASE WHEN v IS NULL THEN n END), 0) / sum(n) FROM hr) AS np FROM pairs0)"""


def measured(pairs: str, kind: str, metrics=None, by: str = "") -> str:
    """SELECT metric, drift_magnitude, null_percentage from a WITH clause that ends in pairs."""
    names = metrics or (CONTINUOUS if kind == "Continuous" else CATEGORICAL)
    r = lambda c, n: f"greatest({c} / ({n} + {EPS}), {EPS})"
    pooled = f"(bl + rt) / (bl_n + rt_n + {EPS})"
    over = f"OVER ({'PARTITION BY ' + by if by else ''} ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    gap = f"abs({r(f'sum(bl) {over}', 'bl_n')} - {r(f'sum(rt) {over}', 'rt_n')})"
    first = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    rows = " UNION ALL ".join(f"SELECT {first}'{m}' AS metric, round({m}, {6 if m in GROWING else 9}) + 0.0 AS drift_magnitude, round(np, 9) AS null_percentage FROM agg" for m in names)
    columns = ", ".join(f"{FORMULAS[kind][m]} AS {m}" for m in dict.fromkeys(names))
    return f"""{pairs}, pq AS (SELECT *, {r("bl", "bl_n")} AS p, {r("rt", "rt_n")} AS q, greatest(bl_n * {pooled}, {EPS}) AS eb, greatest(rt_n * {pooled}, {EPS}) AS er, {gap} AS gap FROM pairs),
    agg AS (SELECT {first}max(np) AS np, {columns} FROM pq {group}) {rows}"""


def sides(expression: str, baseline: str = "true", candidate: str = "true") -> tuple[str, str]:
    return f"SELECT {expression} AS v FROM lineitem WHERE {BEFORE} AND {baseline}", f"SELECT {expression} AS v FROM lineitem WHERE {AFTER} AND {candidate}"


def cont(expression: str, rule: str = "FreedmanDiaconis", metrics=None, candidate: str = "true", single: bool = False) -> str:
    return measured(continuous_pairs(*sides(expression, "true", candidate), rule, single=single), "Continuous", metrics)


def orders(metrics=None) -> str:
    bl = "SELECT o_orderpriority AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' AND o_orderpriority <> '1-URGENT'"
    return measured(categorical_pairs(bl, "SELECT o_orderpriority AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'"), "Categorical", metrics)


def halves(name: str, column: str, when: str, at: str) -> str:
    source = f"SELECT {column} AS v FROM {name} WHERE {when} "
    return measured(continuous_pairs(source + f"< TIMESTAMP '{at}'", source + f">= TIMESTAMP '{at}'"), "Continuous")


def cat(expression: str, baseline: str = "true", boolean: bool = False) -> str:
    return measured(categorical_pairs(*sides(expression, baseline), boolean=boolean), "Categorical")


def table_rows(nulled: bool) -> str:
    parts = []
    for c in TABLE_COLUMNS:
        value = NULLED.format(c) if nulled and c in ("l_discount", "l_returnflag") else c
        bl, rt = sides(value, "true", "l_quantity > 20")
        kind = "Continuous" if c in ("l_quantity", "l_extendedprice", "l_discount") else "Categorical"
        pairs = continuous_pairs(bl, rt, with_nulls=True) if kind == "Continuous" else categorical_pairs(bl, rt, with_nulls=True)
        parts.append(f"SELECT '{c}' AS \"column\", '{kind}' AS column_class, * FROM ({measured(pairs, kind)})")
    return " UNION ALL ".join(parts)


LIMITS = {
    "JensenShannon": 0.1, "PopulationStabilityIndex": 0.25, "WassersteinDistance": 0.1, "KullbackLeibler": 0.2, "KolmogorovSmirnov": 0.1, "ChiSquared": 50.0, "GTest": 10.0,
}


def checked() -> str:
    cases = " ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in LIMITS.items())
    return f"""SELECT *, drift_magnitude - threshold AS d FROM (SELECT *, CASE metric {cases} WHEN 'Hellinger' THEN CASE column_class WHEN 'Continuous' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END END AS threshold FROM ({table_rows(True)}))"""


def contract(kind: str) -> str:
    return f"SELECT \"column\", metric, threshold, CASE WHEN d > 0 THEN round(d, 6) END AS delta, CASE WHEN d > 0 THEN 'Failed' ELSE 'Passed' END AS result FROM ({checked()}) WHERE column_class = '{kind}'"


STATE = f"""SELECT "column", passed, failed, CASE WHEN failed = 0 THEN 'Healthy' WHEN passed = 0 THEN 'Unhealthy' ELSE 'PartiallyHealthy' END AS state, CASE WHEN np > 0.1 THEN 'Failed' ELSE 'Passed' END AS null_state
FROM (SELECT "column", count(*) FILTER (NOT d > 0) AS passed, count(*) FILTER (d > 0) AS failed, max(null_percentage) AS np FROM ({checked()}) GROUP BY 1)"""


def approx(rule: str) -> str:
    source = "SELECT l_extendedprice AS v FROM lineitem"
    return f"WITH RECURSIVE {stats(source)}, {edges(rule)}, h AS ({binned(source)}) SELECT g.bin::INTEGER AS bin, coalesce(h.n, 0)::DOUBLE AS n FROM (SELECT unnest(range(nb)) AS bin FROM shape) g LEFT JOIN h ON h.bin = g.bin"


PROFILE = f"""WITH RECURSIVE {stats("SELECT o_totalprice AS v FROM orders")}, {edges("FreedmanDiaconis")}, h AS ({binned("SELECT o_totalprice AS v FROM orders")})
SELECT g.bin::INTEGER AS bin, round(a.e, 6) AS low, round(b.e, 6) AS high, coalesce(h.n, 0)::DOUBLE AS n
FROM (SELECT unnest(range(nb)) AS bin FROM shape) g LEFT JOIN h ON h.bin = g.bin LEFT JOIN edges a ON a.i = g.bin - 1 LEFT JOIN edges b ON b.i = g.bin"""


def counted() -> str:
    parts = []
    for name, column in COUNTED:
        for rule in ("FreedmanDiaconis", "Scott", "Sturges"):
            parts.append(f"SELECT '{column}' AS \"column\", '{rule}' AS rule, (WITH {stats(f'SELECT {column} AS v FROM {name}')} SELECT {n_bins(rule)} FROM st)::BIGINT AS n_bins")
    return " UNION ALL ".join(parts)


def all_edges() -> str:
    parts = [f"SELECT '{rule}' AS rule, i::INTEGER AS edge, round(e, 9) AS value FROM (WITH RECURSIVE {stats('SELECT c_acctbal AS v FROM customer')}, {edges(rule)} SELECT i, e FROM edges)" for rule in ("FreedmanDiaconis", "Scott", "Sturges")]
    return " UNION ALL ".join(parts)


NULLABLE = f"""WITH {stats(f"SELECT {NULLED.format('l_discount')} AS v FROM lineitem")}
SELECT 'l_discount' AS "column", ({n_bins("FreedmanDiaconis")})::BIGINT AS n_bins, (SELECT count(*) FROM lineitem)::DOUBLE AS size, (SELECT count(*) FROM lineitem WHERE l_linenumber = 7)::DOUBLE AS null_count FROM st
UNION ALL SELECT 'l_returnflag', (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_linenumber <> 7) + 1, (SELECT count(*) FROM lineitem)::DOUBLE, (SELECT count(*) FROM lineitem WHERE l_linenumber = 7)::DOUBLE"""

FLUSH = measured(
    f"""WITH RECURSIVE {stats("SELECT value AS v FROM events WHERE event_id % 10 < 2")}, {edges("FreedmanDiaconis")},
    runtime AS (SELECT (event_id % 8)::INTEGER AS batch, value AS v FROM events WHERE event_id % 10 >= 2),
    sizes AS (SELECT batch, count(*) AS n, (SELECT floor(count(*) * 3 / 8.0) FROM runtime) AS size, row_number() OVER (ORDER BY batch) AS k FROM runtime GROUP BY batch),
    windows(k, batch, total, start) AS (
      SELECT k, batch, n, k FROM sizes WHERE k = 1
      UNION ALL SELECT s.k, s.batch, CASE WHEN w.total + 255 >= s.size THEN s.n ELSE w.total + s.n END, CASE WHEN w.total + 255 >= s.size THEN s.k ELSE w.start END FROM windows w JOIN sizes s ON s.k = w.k + 1),
    hr AS (SELECT batch, len(list_filter(l, lambda e: e <= v)) AS bin, count(*)::DOUBLE AS n FROM runtime, es GROUP BY 1, 2),
    hb AS ({binned("SELECT value AS v FROM events WHERE event_id % 10 < 2")}),
    grid AS (SELECT w.*, b.bin, b.nb FROM windows w, (SELECT unnest(range(nb)) AS bin, nb FROM shape) b),
    pairs AS (SELECT g.batch, g.total, g.bin, g.nb, coalesce(hb.n, 0) AS bl, (SELECT sum(n) FROM hb) AS bl_n, g.total::DOUBLE AS rt_n, 0.0 AS np,
      coalesce((SELECT sum(hr.n) FROM hr JOIN sizes s ON s.batch = hr.batch WHERE hr.bin = g.bin AND s.k BETWEEN g.start AND g.k), 0) AS rt FROM grid g LEFT JOIN hb ON hb.bin = g.bin)""",
    "Continuous", None, "batch, total",
)

DECAY = measured(
    """WITH known AS (SELECT event_type AS v, count(*)::DOUBLE AS n FROM events WHERE event_id % 10 < 2 AND event_type <> 'click' GROUP BY 1),
    runtime AS (SELECT (event_id % 8)::INTEGER AS batch, CASE WHEN event_type IN (SELECT v FROM known) THEN event_type END AS v, count(*)::DOUBLE AS n FROM events WHERE event_id % 10 >= 2 GROUP BY 1, 2),
    batches AS (SELECT batch, row_number() OVER (ORDER BY batch) AS k FROM (SELECT DISTINCT batch FROM runtime)),
    bins AS (SELECT v, n FROM known UNION ALL SELECT NULL, 0),
    cells AS (SELECT b.batch, b.k, x.v, x.n AS bl, coalesce((SELECT sum(r.n * pow(pow(0.5, 0.5), b.k - c.k + 1)) FROM runtime r JOIN batches c ON c.batch = r.batch WHERE r.v IS NOT DISTINCT FROM x.v AND c.k <= b.k), 0) AS rt FROM batches b, bins x),
    pairs AS (SELECT batch, 0 AS bin, bl, rt, (SELECT sum(n) FROM known) AS bl_n, sum(rt) OVER (PARTITION BY batch) AS rt_n, 0 AS nb, 0.0 AS np FROM cells)""",
    "Categorical", None, "batch, rt_n",
)

SEGMENT = measured(
    f"""WITH RECURSIVE {stats(f"SELECT l_quantity AS v FROM lineitem WHERE {BEFORE}")}, {edges("FreedmanDiaconis")}, hb AS ({binned(f"SELECT l_quantity AS v FROM lineitem WHERE {BEFORE}")}),
    hr AS (SELECT l_returnflag, len(list_filter(l, lambda e: e <= l_quantity)) AS bin, count(*)::DOUBLE AS n FROM lineitem, es WHERE {AFTER} GROUP BY 1, 2),
    grid AS (SELECT * FROM (SELECT l_returnflag, sum(n) AS rt_n FROM hr GROUP BY 1), (SELECT unnest(range(nb)) AS bin, nb FROM shape)),
    pairs AS (SELECT g.l_returnflag, g.bin, g.nb, coalesce(hb.n, 0) AS bl, coalesce(hr.n, 0) AS rt, (SELECT sum(n) FROM hb) AS bl_n, g.rt_n, 0.0 AS np FROM grid g LEFT JOIN hb ON hb.bin = g.bin LEFT JOIN hr ON hr.bin = g.bin AND hr.l_returnflag = g.l_returnflag)""",
    "Continuous", None, "l_returnflag",
)

SCHEMA = """SELECT * FROM (VALUES ('invalid_type', 'l_linenumber', 'int', 'string'), ('missing', 'l_linestatus', NULL, NULL),
('extra', 'l_discount', NULL, NULL), ('extra', 'l_extendedprice', NULL, NULL), ('extra', 'l_tax', NULL, NULL)) x(kind, "column", expected, found)"""

STREAM_NULL = "CASE WHEN event_id % 11 = 0 THEN NULL ELSE {} END"


def stream_cells(kind: str, nulls: bool) -> str:
    """WITH clause: bins(b, bl), cells(batch, b, n) with b null for nulls, sizes(k, batch, n) with all rows of a batch."""
    column = "value" if kind == "Continuous" else "event_type"
    v = STREAM_NULL.format(column) if nulls else column
    seen = "event_id % 10 < 2" + (" AND event_type <> 'click'" if kind == "Categorical" else "")
    runtime = f"runtime AS (SELECT (event_id % 8)::INTEGER AS batch, {v} AS v FROM events WHERE event_id % 10 >= 2)"
    source = f"SELECT {v} AS v FROM events WHERE {seen}"
    if kind == "Continuous":
        head = f"""{stats(source)}, {edges("FreedmanDiaconis")}, {runtime}, hb AS ({binned(source)}),
        bins AS (SELECT g.b, coalesce(hb.n, 0) AS bl, g.nb FROM (SELECT unnest(range(nb)) AS b, nb FROM shape) g LEFT JOIN hb ON hb.bin = g.b),
        cells AS (SELECT batch, CASE WHEN v IS NOT NULL THEN len(list_filter(l, lambda e: e <= v)) END AS b, count(*)::DOUBLE AS n FROM runtime, es GROUP BY 1, 2)"""
    else:
        head = f"""hb AS (SELECT v, count(*)::DOUBLE AS n FROM ({source}) WHERE v IS NOT NULL GROUP BY v), {runtime},
        placed AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS b, n FROM hb),
        bins AS (SELECT b, n AS bl, 0 AS nb FROM placed UNION ALL SELECT count(*), 0, 0 FROM placed),
        cells AS (SELECT batch, CASE WHEN r.v IS NOT NULL THEN coalesce(p.b, (SELECT count(*) FROM placed)) END AS b, count(*)::DOUBLE AS n FROM runtime r LEFT JOIN placed p ON p.v = r.v GROUP BY 1, 2)"""
    return f"WITH RECURSIVE {head}, sizes AS (SELECT batch, sum(n) AS n, row_number() OVER (ORDER BY batch) AS k, (SELECT floor(count(*) * 3 / 8.0) FROM runtime) AS size FROM cells GROUP BY batch)"


def windowed(kind: str, mode: str, nulls: bool, base: bool = False) -> str:
    """WITH clause with windows(k, batch, total, nulls) and weighted(k, b, n): each batch's share in the window. base: the window is emptied after four batches.

    A decaying window that is restored empty starts with the fifth batch."""
    began = "CASE WHEN k > 4 THEN 5 ELSE 1 END" if base else "1"
    if mode == "decay":
        share = f"spans AS (SELECT k, batch, {began} AS start FROM sizes), shares AS (SELECT w.k, w.batch, c.batch AS of, pow(pow(0.5, 0.5), w.k - c.k + 1) AS f FROM spans w JOIN sizes c ON c.k BETWEEN w.start AND w.k)"
    else:
        if mode == "cadence":
            spans = "spans AS (SELECT k, batch, 3 * ((k - 1) // 3) + 1 AS start FROM sizes)"
        else:
            empty = f"(w.total + 255 >= s.size{' OR s.k = 5' if base else ''})"
            spans = f"""spans(k, batch, total, start) AS (SELECT k, batch, n, k FROM sizes WHERE k = 1
            UNION ALL SELECT s.k, s.batch, CASE WHEN {empty} THEN s.n ELSE w.total + s.n END, CASE WHEN {empty} THEN s.k ELSE w.start END FROM spans w JOIN sizes s ON s.k = w.k + 1)"""
        share = f"{spans}, shares AS (SELECT w.k, w.batch, c.batch AS of, 1.0::DOUBLE AS f FROM spans w JOIN sizes c ON c.k BETWEEN w.start AND w.k)"
    return f"{stream_cells(kind, nulls)}, {share}, weighted AS (SELECT s.k, s.batch, c.b, sum(c.n * s.f) AS n FROM shares s JOIN cells c ON c.batch = s.of GROUP BY 1, 2, 3)"


def stream(kind: str, mode: str, nulls: bool, base: bool = False) -> str:
    pairs = f"""{windowed(kind, mode, nulls, base)}, pairs AS (SELECT w.batch, w.total, b.b AS bin, b.nb, b.bl, (SELECT sum(bl) FROM bins) AS bl_n, w.rt_n, 0.0 AS np, coalesce(x.n, 0) AS rt
    FROM (SELECT k, batch, sum(n) AS total, sum(n) FILTER (b IS NOT NULL) AS rt_n FROM weighted GROUP BY 1, 2) w, bins b LEFT JOIN weighted x ON x.k = w.k AND x.b = b.b)"""
    return f"SELECT batch, round(total, 6) AS total, metric, drift_magnitude FROM ({measured(pairs, kind, None, 'batch, total')})"


def null_shares() -> str:
    parts = [
        f"SELECT '{kind}' AS kind, '{mode}' AS mode, t AS total, s AS null_percentage FROM ({windowed(kind, mode, True)} SELECT round(sum(n), 6) AS t, round(sum(n) FILTER (b IS NULL) / sum(n), 9) AS s FROM weighted WHERE k = (SELECT max(k) FROM weighted))"
        for kind in ("Continuous", "Categorical")
        for mode in ("flush", "decay")
    ]
    return " UNION ALL ".join(parts)


def single(kind: str) -> str:
    column = "value" if kind == "Continuous" else "event_type"
    v, seen = STREAM_NULL.format(column), "event_id % 10 < 2" + (" AND event_type <> 'click'" if kind == "Categorical" else "")
    bl, rt = f"SELECT {v} AS v FROM events WHERE {seen}", f"SELECT {v} AS v FROM events WHERE event_id < 300"
    pairs = continuous_pairs(bl, rt) if kind == "Continuous" else categorical_pairs(bl, rt)
    return f"SELECT 0::INTEGER AS batch, (SELECT count(*) FROM events WHERE event_id < 300)::DOUBLE AS total, metric, drift_magnitude FROM ({measured(pairs, kind)})"


def exported(kind: str, nulls: bool) -> str:
    column = "l_discount" if kind == "Continuous" else "l_returnflag"
    v = NULLED.format(column) if nulls else column
    bl, rt = sides(v, "l_returnflag <> 'R'")
    return measured(continuous_pairs(bl, rt) if kind == "Continuous" else categorical_pairs(bl, rt), kind)


NULL_ORDERS = [
    f"SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS v FROM orders WHERE {when}"
    for when in ("o_orderdate < TIMESTAMP '1998-07-01' AND o_orderpriority <> '1-URGENT'", "o_orderdate >= TIMESTAMP '1998-07-01'")
]
UNSIGNED = [
    f"SELECT 18446744073709551600 + o_orderkey % 7 AS v FROM orders WHERE {when}"
    for when in ("o_orderdate < TIMESTAMP '1998-07-01' AND o_orderpriority <> '1-URGENT'", "o_orderdate >= TIMESTAMP '1998-07-01' AND o_orderkey % 7 < 5")
]

LIFE = """WITH n AS (SELECT count(*)::DOUBLE AS n FROM events WHERE event_id % 10 >= 2)
SELECT step, total, last_flush FROM (SELECT 'new' AS step, 0.0::DOUBLE AS total, 10.0::DOUBLE AS last_flush UNION ALL SELECT 'batch', n, 20.0 FROM n UNION ALL SELECT 'flush', 0, 0 UNION ALL SELECT 'again', n, 10 FROM n
UNION ALL SELECT 'reset', 0, 0 UNION ALL SELECT 'decay', floor(n / 2), 0 FROM n UNION ALL SELECT 'decay cannot flush', 1, 0)"""

FAULTS = """SELECT * FROM (VALUES ('NaN in a baseline', 'NaNValueError'), ('infinity in a baseline', 'NaNValueError'), ('empty baseline', 'EmptyBaselineData'), ('empty candidate', 'EmptyRuntimeData'),
('empty candidate table', 'EmptyRuntimeData'), ('an edge too many', 'InvalidDataShape'), ('a value too many', 'InvalidDataShape'), ('no JSON', 'DeserializationError'), ('a field missing', 'DeserializationError'),
('decay as flush', 'InvalidDriftMode'), ('metric name', 'UnsupportedDriftType'), ('categorical metric name', 'UnsupportedDriftType'), ('rule name', 'UnsupportedDriftType'), ('good names', NULL)) x("case", error)"""

LIMITED = " ".join(f"WHEN '{m}' THEN {1e-6 if m == 'KullbackLeibler' else v}::DOUBLE" for m, v in (LIMITS | {"Hellinger": 0.1}).items())


def on_results() -> str:
    rows = cont(NULLED.format("l_discount"), candidate="l_quantity > 25")
    return f"""WITH d AS (SELECT metric, np, round(drift_magnitude, 9) - CASE metric {LIMITED} END AS d FROM (SELECT metric, drift_magnitude, null_percentage AS np FROM ({rows})))
    SELECT metric, CASE WHEN d > 0 THEN round(d, 6) END AS delta, NOT d > 0 AS passed, (SELECT CASE WHEN max(d) <= 0 THEN 'Healthy' WHEN min(d) > 0 THEN 'Unhealthy' ELSE 'PartiallyHealthy' END FROM d) AS state, np <= 0.01 AS nulls_passed FROM d"""


PRICE = "l_extendedprice"
ORACLE: dict[str, str] = {
    "cont_psi": cont(PRICE, metrics=["PopulationStabilityIndex"]),
    "cont_kl": cont(PRICE, metrics=["KullbackLeibler"]),
    "cont_js": cont(PRICE, metrics=["JensenShannon"]),
    "cont_wasserstein": cont(PRICE, metrics=["WassersteinDistance"]),
    "cont_ks": cont(PRICE, metrics=["KolmogorovSmirnov"]),
    "cont_hellinger": cont(PRICE, metrics=["Hellinger"]),
    "cont_multi_fd": cont(PRICE, candidate="l_quantity > 25"),
    "cont_multi_scott": cont(PRICE, "Scott", candidate="l_quantity > 25"),
    "cont_multi_sturges": cont(PRICE, "Sturges", candidate="l_quantity > 25"),
    "cont_repeated_metrics": cont(PRICE, metrics=["Hellinger", "JensenShannon", "Hellinger"]),
    "cont_orders": halves("orders", "o_totalprice", "o_orderdate", "1998-07-01"),
    "cont_events": halves("events", "value", "ts", "2024-01-15"),
    "cont_float32": cont("l_extendedprice::FLOAT", candidate="l_quantity > 25", single=True),
    "cont_constant_column": cont("5::DOUBLE"),
    "cont_zero_iqr": cont("CASE WHEN l_linenumber = 7 THEN l_quantity ELSE 1.0::DOUBLE END", candidate="l_quantity > 25"),
    "cat_psi": orders(["PopulationStabilityIndex"]),
    "cat_kl": orders(["KullbackLeibler"]),
    "cat_js": orders(["JensenShannon"]),
    "cat_wasserstein": orders(["WassersteinDistance"]),
    "cat_chi2": orders(["ChiSquared"]),
    "cat_hellinger": orders(["Hellinger"]),
    "cat_gtest": orders(["GTest"]),
    "cat_multi": orders(),
    "cat_int_labels": cat("l_linenumber"),
    "cat_bool": cat("(l_discount > 0.05)", boolean=True),
    "cat_novel_labels": cat("l_returnflag", "l_returnflag <> 'R'"),
    "null_cont_multi": cont(NULLED.format("l_discount"), candidate="l_quantity > 25"),
    "null_cat_multi": cat(NULLED.format("l_returnflag"), "l_returnflag <> 'R'"),
    "table_drift": table_rows(False),
    "table_drift_nulls": table_rows(True),
    "table_null_percentage": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(count(*) FILTER ({'l_linenumber = 7' if c in ('l_discount', 'l_returnflag') else 'false'}) / count(*), 9) AS null_percentage FROM lineitem WHERE {AFTER} AND l_quantity > 20" for c in TABLE_COLUMNS
    ),
    "merge_batches": table_rows(False),
    "contract_check_cont": contract("Continuous"),
    "contract_check_cat": contract("Categorical"),
    "contract_state": STATE,
    "approx_dataset_fd": approx("FreedmanDiaconis"),
    "approx_dataset_scott": approx("Scott"),
    "approx_dataset_sturges": approx("Sturges"),
    "approx_with_edges": "SELECT b.bin::INTEGER AS bin, count(l_quantity)::DOUBLE AS n FROM (SELECT unnest(range(5)) AS bin) b LEFT JOIN lineitem ON (l_quantity >= 5)::INT + (l_quantity >= 10)::INT + (l_quantity >= 25)::INT + (l_quantity >= 40)::INT = b.bin GROUP BY 1",
    "profile_continuous": PROFILE,
    "profile_categorical": "SELECT o_orderpriority AS value, count(*)::DOUBLE AS n FROM orders GROUP BY 1",
    "profile_nullable": NULLABLE,
    "bin_counts_table": counted(),
    "edges_table": all_edges(),
    "stream_flush_window": f"SELECT batch, round(total, 6)::DOUBLE AS total, metric, drift_magnitude FROM ({FLUSH})",
    "stream_decay": f"SELECT batch, round(rt_n, 6) AS total, metric, drift_magnitude FROM ({DECAY})",
    "drift_by_segment": f"SELECT l_returnflag, metric, drift_magnitude FROM ({SEGMENT})",
    "schema_report": SCHEMA,
    "export_cont": exported("Continuous", False),
    "export_null_cont": exported("Continuous", True),
    "export_cat": exported("Categorical", False),
    "export_null_cat": exported("Categorical", True),
    "stream_cont_decay": stream("Continuous", "decay", False),
    "stream_cat_flush": stream("Categorical", "flush", False),
    "stream_null_cont_flush": stream("Continuous", "flush", True),
    "stream_null_cont_decay": stream("Continuous", "decay", True),
    "stream_null_cat_flush": stream("Categorical", "flush", True),
    "stream_null_cat_decay": stream("Categorical", "decay", True),
    "stream_null_percentage": null_shares(),
    "stream_restore_cont": stream("Continuous", "decay", False),
    "stream_restore_cat": stream("Categorical", "flush", False),
    "stream_restore_null_cont": stream("Continuous", "flush", True),
    "stream_restore_null_cat": stream("Categorical", "decay", True),
    "stream_base_cont": stream("Continuous", "decay", False, True),
    "stream_base_cat": stream("Categorical", "flush", False, True),
    "stream_base_null_cont": stream("Continuous", "flush", True, True),
    "stream_base_null_cat": stream("Categorical", "decay", True, True),
    "stream_cadence": stream("Continuous", "cadence", False),
    "stream_single_cont": single("Continuous"),
    "stream_single_cat": single("Categorical"),
    "stream_lifecycle": LIFE,
    "faults": FAULTS,
    "one_call_continuous": cont(PRICE, "Sturges", candidate="l_quantity > 25"),
    "one_call_categorical": orders(),
    "one_call_categorical_par": orders(),
    "one_call_nullable": measured(categorical_pairs(*NULL_ORDERS), "Categorical"),
    "candidate_column": f"SELECT {NULLED.format('l_returnflag')} AS key, count(*)::DOUBLE AS rt FROM lineitem WHERE {AFTER} AND l_quantity > 20 GROUP BY 1",
    "built_contracts": STATE,
    "contract_on_results": on_results(),
    "unsigned_labels": measured(categorical_pairs(*UNSIGNED), "Categorical"),
}
