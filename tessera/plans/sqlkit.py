"""Common table expressions for the SQL twins of the queries."""

from __future__ import annotations

PRICES = """
li AS (SELECT {entity} AS entity, CAST(l_shipdate AS DATE) AS date, l_quantity AS q, l_extendedprice AS e, l_extendedprice / l_quantity AS price FROM lineitem),
{name}0 AS (SELECT entity, date, round(avg(price), 6) AS open, max(price) AS high, min(price) AS low, CAST(sum(CAST(q AS DECIMAL(18,2))) AS DOUBLE) AS vol,
  CAST(sum(CAST(e AS DECIMAL(18,2))) AS DOUBLE) AS cap FROM li GROUP BY entity, date),
{name}1 AS (SELECT *, cap / nullif(vol, 0) AS close FROM {name}0),
{name} AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS ret FROM {name}1)"""

CTE = {
    "su": PRICES.format(entity="l_suppkey", name="su"),
    "ev": """
e0 AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close,
  CAST(count(*) AS DOUBLE) AS vol, round(sum(value), 6) AS cap FROM events GROUP BY 1, 2),
ev AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS ret FROM e0)""",
    "month": """
m0 AS (SELECT entity, CAST(date_trunc('month', date) AS DATE) AS period, arg_max(open, date) AS open, arg_max(high, date) AS high, arg_max(low, date) AS low, arg_max(close, date) AS close,
  arg_max(vol, date) AS vol, arg_max(cap, date) AS cap, max(date) AS date FROM su GROUP BY 1, 2),
mo AS (SELECT *, close / nullif(lag(close) OVER (PARTITION BY entity ORDER BY date), 0) - 1 AS ret FROM m0)""",
    "cal": "cal AS (SELECT date, row_number() OVER (ORDER BY date) AS ord FROM (SELECT DISTINCT date FROM su))",
    "mkt": "mkt AS (SELECT date, sum(cap * ret) / nullif(sum(cap), 0) AS mkt_ret FROM su WHERE ret IS NOT NULL AND cap > 0 GROUP BY date)",
    "panel": "panel AS (SELECT * FROM (SELECT entity, date, ret AS signal, lead(ret) OVER (PARTITION BY entity ORDER BY date) AS ret, cap FROM ev) WHERE signal IS NOT NULL AND ret IS NOT NULL)",
    "std": """
z1 AS (SELECT *, (signal - avg(signal) OVER (PARTITION BY date)) / nullif(stddev_samp(signal) OVER (PARTITION BY date), 0) AS z FROM panel),
z2 AS (SELECT * EXCLUDE (z), CASE WHEN z IS NOT NULL THEN greatest(least(z, 3.0), -3.0) END AS z FROM z1),
std AS (SELECT * EXCLUDE (z, signal), (z - avg(z) OVER (PARTITION BY date)) / nullif(stddev_samp(z) OVER (PARTITION BY date), 0) AS signal FROM z2)""",
    "grp": """
g0 AS (SELECT *, count(*) OVER (PARTITION BY date) AS n_names, row_number() OVER (PARTITION BY date ORDER BY signal, entity) AS rn FROM std WHERE signal IS NOT NULL),
grp AS (SELECT * EXCLUDE (n_names, rn), CAST(least(5, floor((rn - 1) * 5 / n_names) + 1) AS INTEGER) AS grp FROM g0 WHERE n_names >= 5)""",
    "wt": """
wt AS (SELECT g.*, s.scheme, CASE WHEN s.scheme = 'equal' THEN 1.0 WHEN cap > 0 THEN cap END AS w FROM grp g CROSS JOIN (VALUES ('equal'), ('float'), ('total')) AS s(scheme)
  WHERE s.scheme = 'equal' OR cap > 0)""",
    "port": """
p0 AS (SELECT scheme, date, grp, sum(w * ret) AS wr, sum(w) AS ww, count(*) AS n FROM wt GROUP BY 1, 2, 3),
p1 AS (SELECT *, wr / ww AS raw, sum(wr) OVER (PARTITION BY scheme, date) / sum(ww) OVER (PARTITION BY scheme, date) AS mkt FROM p0),
port AS (SELECT scheme, date, grp, n, raw, mkt, raw - mkt AS act FROM p1)""",
    "hl": "hl AS (SELECT scheme, date, max(CASE WHEN grp = 5 THEN raw END) - max(CASE WHEN grp = 1 THEN raw END) AS raw, max(CASE WHEN grp = 5 THEN act END) - max(CASE WHEN grp = 1 THEN act END) AS act FROM port GROUP BY 1, 2)",
    "turn": """
t0 AS (SELECT scheme, entity, grp, date, w / sum(w) OVER (PARTITION BY scheme, date, grp) AS p FROM wt),
t1 AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM wt)),
t2 AS (SELECT t0.scheme, t0.entity, t0.grp, t1.date, t0.p FROM t0 JOIN t1 ON t0.date = t1.nxt),
turn AS (SELECT coalesce(a.scheme, b.scheme) AS scheme, coalesce(a.date, b.date) AS date, coalesce(a.grp, b.grp) AS grp, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS turnover
  FROM t0 a FULL JOIN t2 b ON a.scheme = b.scheme AND a.entity = b.entity AND a.grp = b.grp AND a.date = b.date GROUP BY 1, 2, 3)""",
    "ser": "ser AS (SELECT scheme, date, grp, raw, act FROM port UNION ALL SELECT scheme, date, 0, raw, act FROM hl)",
    "dd": """
d0 AS (SELECT *, exp(sum(CASE WHEN raw > -1 THEN ln(1 + raw) END) OVER (PARTITION BY scheme, grp ORDER BY date)) AS c1, exp(sum(CASE WHEN act > -1 THEN ln(1 + act) END) OVER (PARTITION BY scheme, grp ORDER BY date)) AS c2 FROM ser),
d1 AS (SELECT *, c1 / max(c1) OVER (PARTITION BY scheme, grp ORDER BY date) - 1 AS f1, c2 / max(c2) OVER (PARTITION BY scheme, grp ORDER BY date) - 1 AS f2 FROM d0),
dd AS (SELECT scheme, grp, CASE WHEN count(raw) = count(*) THEN -min(f1) END AS max_dd, CASE WHEN count(act) = count(*) THEN -min(f2) END AS act_max_dd FROM d1 GROUP BY 1, 2)""",
    "perf": """
s0 AS (SELECT scheme, grp, avg(raw) * 52.0 AS ann_ret, stddev_samp(raw) * sqrt(52.0) AS ann_risk, avg(act) * 52.0 AS act_ret, stddev_samp(act) * sqrt(52.0) AS act_risk FROM ser GROUP BY 1, 2),
to0 AS (SELECT scheme, grp, avg(turnover) * 52.0 AS turnover FROM turn GROUP BY 1, 2),
to1 AS (SELECT * FROM to0 UNION ALL SELECT scheme, 0, sum(turnover) / 2 FROM to0 WHERE grp IN (1, 5) GROUP BY scheme),
pw AS (SELECT s0.scheme, s0.grp, round(ann_ret, 4) AS ann_ret, round(ann_risk, 4) AS ann_risk, round(ann_ret / nullif(ann_risk, 0), 3) AS sharpe, round(act_ret, 4) AS act_ret, round(act_risk, 4) AS act_risk,
  round(act_ret / nullif(act_risk, 0), 3) AS info_ratio, round(max_dd, 4) AS max_dd, round(act_max_dd, 4) AS act_max_dd, round(turnover, 2) AS turnover
  FROM s0 JOIN dd ON s0.scheme = dd.scheme AND s0.grp = dd.grp LEFT JOIN to1 ON s0.scheme = to1.scheme AND s0.grp = to1.grp),
perf AS (UNPIVOT_HERE)""",
}
_METRICS = ("ann_ret", "ann_risk", "sharpe", "act_ret", "act_risk", "info_ratio", "max_dd", "act_max_dd", "turnover")
CTE["perf"] = CTE["perf"].replace("UNPIVOT_HERE", " UNION ALL ".join(f"SELECT scheme, grp, '{m}' AS metric, {m} AS value FROM pw" for m in _METRICS))
NEEDS = {"month": ["su"], "cal": ["su"], "mkt": ["su"], "panel": ["ev"], "std": ["panel"], "grp": ["std"], "wt": ["grp"], "port": ["wt"], "hl": ["port"], "turn": ["wt"], "ser": ["port", "hl"], "dd": ["ser"], "perf": ["dd", "turn"]}


def sql(needs: str, body: str, extra: str = "") -> str:
    """A query over the named expressions and all that these need; ``extra`` holds its own expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for n in needs.split():
        add(n)
    parts = [CTE[n].strip() for n in order] + ([extra.strip()] if extra else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def frame(first: int, last: int | None, by: str = "entity") -> str:
    edge = lambda x: "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    return f"(PARTITION BY {by} ORDER BY date ROWS BETWEEN {edge(first)} AND {edge(last)})"


def roll(agg: str, c: str, first: int, last: int) -> str:
    f = frame(first, last)
    return f"CASE WHEN count({c}) OVER {f} = {last - first + 1} THEN {agg}({c}) OVER {f} END"


def comp(first: int, last: int, r: str = "ret") -> str:
    return f"exp({roll('sum', f'(CASE WHEN {r} > -1 THEN ln(1 + {r}) END)', first, last)}) - 1"


def backtest_sql(source: str, groups: int, ppy: int, keys: tuple[str, ...] = ()) -> tuple[str, str]:
    """Expressions and body of a backtest of ``source`` (keys, entity, date, signal, ret, cap): its performance table with
    the t statistic of high minus low. Dates with fewer names than groups are left out."""
    k = "".join(f"{c}, " for c in keys)
    same = lambda a, b, *more: " AND ".join(f"{a}.{c} = {b}.{c}" for c in (*keys, *more))
    z = lambda c, by: f"({c} - avg({c}) OVER (PARTITION BY {k}{by})) / nullif(stddev_samp({c}) OVER (PARTITION BY {k}{by}), 0)"
    root = f"sqrt({ppy}.0)"
    metrics = {"ann_ret": "round(ann_ret, 4)", "ann_risk": "round(ann_risk, 4)", "sharpe": "round(ann_ret / nullif(ann_risk, 0), 3)", "act_ret": "round(act_ret, 4)", "act_risk": "round(act_risk, 4)",
               "info_ratio": "round(act_ret / nullif(act_risk, 0), 3)", "max_dd": "round(max_dd, 4)", "act_max_dd": "round(act_max_dd, 4)", "turnover": "round(turnover, 2)"}
    cum = lambda c: f"exp(sum(CASE WHEN {c} > -1 THEN ln(1 + {c}) END) OVER (PARTITION BY {k}scheme, grp ORDER BY date))"
    ctes = f"""
x0 AS (SELECT * FROM {source} WHERE signal IS NOT NULL AND ret IS NOT NULL),
x1 AS (SELECT *, {z('signal', 'date')} AS z FROM x0),
x2 AS (SELECT * EXCLUDE (z), CASE WHEN z IS NOT NULL THEN greatest(least(z, 3.0), -3.0) END AS z FROM x1),
x3 AS (SELECT * EXCLUDE (z, signal), {z('z', 'date')} AS signal FROM x2),
x4 AS (SELECT *, count(*) OVER (PARTITION BY {k}date) AS names, row_number() OVER (PARTITION BY {k}date ORDER BY signal, entity) AS rn FROM x3 WHERE signal IS NOT NULL),
x5 AS (SELECT *, CAST(least({groups}, floor((rn - 1) * {groups} / names) + 1) AS INTEGER) AS grp FROM x4 WHERE names >= {groups}),
xw AS (SELECT x5.*, v.scheme, CASE WHEN v.scheme = 'equal' THEN 1.0 WHEN cap > 0 THEN cap END AS w FROM x5 CROSS JOIN (VALUES ('equal'), ('float'), ('total')) AS v(scheme) WHERE v.scheme = 'equal' OR cap > 0),
xp0 AS (SELECT {k}scheme, date, grp, sum(w * ret) AS wr, sum(w) AS ww FROM xw GROUP BY ALL),
xp AS (SELECT {k}scheme, date, grp, wr / ww AS raw, wr / ww - sum(wr) OVER (PARTITION BY {k}scheme, date) / sum(ww) OVER (PARTITION BY {k}scheme, date) AS act FROM xp0),
xhl AS (SELECT {k}scheme, date, max(CASE WHEN grp = {groups} THEN raw END) - max(CASE WHEN grp = 1 THEN raw END) AS raw, max(CASE WHEN grp = {groups} THEN act END) - max(CASE WHEN grp = 1 THEN act END) AS act FROM xp GROUP BY ALL),
xs AS (SELECT {k}scheme, date, grp, raw, act FROM xp UNION ALL SELECT {k}scheme, date, 0, raw, act FROM xhl),
xd0 AS (SELECT *, {cum('raw')} AS c1, {cum('act')} AS c2 FROM xs),
xd1 AS (SELECT *, c1 / max(c1) OVER (PARTITION BY {k}scheme, grp ORDER BY date) - 1 AS f1, c2 / max(c2) OVER (PARTITION BY {k}scheme, grp ORDER BY date) - 1 AS f2 FROM xd0),
xm AS (SELECT {k}scheme, grp, avg(raw) * {ppy}.0 AS ann_ret, stddev_samp(raw) * {root} AS ann_risk, avg(act) * {ppy}.0 AS act_ret, stddev_samp(act) * {root} AS act_risk,
  CASE WHEN count(raw) = count(*) THEN -min(f1) END AS max_dd, CASE WHEN count(act) = count(*) THEN -min(f2) END AS act_max_dd FROM xd1 GROUP BY ALL),
xn AS (SELECT {k}scheme, entity, grp, date, w / sum(w) OVER (PARTITION BY {k}scheme, date, grp) AS p FROM xw),
xc AS (SELECT {k}date, lead(date) OVER ({'PARTITION BY ' + k.rstrip(', ') if keys else ''} ORDER BY date) AS nxt FROM (SELECT DISTINCT {k}date FROM xw)),
xb AS (SELECT {''.join(f'xn.{c}, ' for c in keys)}xn.scheme, xn.entity, xn.grp, xc.date, xn.p FROM xn JOIN xc ON xn.date = xc.nxt {''.join(f' AND xn.{c} = xc.{c}' for c in keys)}),
xt0 AS (SELECT {''.join(f'coalesce(a.{c}, b.{c}) AS {c}, ' for c in keys)}coalesce(a.scheme, b.scheme) AS scheme, coalesce(a.date, b.date) AS date, coalesce(a.grp, b.grp) AS grp, sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) AS turnover
  FROM xn a FULL JOIN xb b ON {same('a', 'b', 'scheme', 'entity', 'grp', 'date')} GROUP BY ALL),
xt1 AS (SELECT {k}scheme, grp, avg(turnover) * {ppy}.0 AS turnover FROM xt0 GROUP BY ALL),
xt AS (SELECT * FROM xt1 UNION ALL SELECT {k}scheme, 0, sum(turnover) / 2 FROM xt1 WHERE grp IN (1, {groups}) GROUP BY ALL),
xa AS (SELECT {''.join(f'xm.{c}, ' for c in keys)}xm.scheme, xm.grp, {', '.join(f'{e} AS {m}' for m, e in metrics.items())} FROM xm LEFT JOIN xt ON {same('xm', 'xt', 'scheme', 'grp')}),
y0 AS (SELECT {k}scheme, date, raw AS x, raw - avg(raw) OVER (PARTITION BY {k}scheme) AS e, count(*) OVER (PARTITION BY {k}scheme) AS n, row_number() OVER (PARTITION BY {k}scheme ORDER BY date) AS i FROM xhl WHERE raw IS NOT NULL),
y1 AS (SELECT *, CAST(least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9.0)), 1), n - 1) AS INTEGER) AS lag FROM y0),
y2 AS (SELECT {''.join(f'a.{c}, ' for c in keys)}a.scheme, max(a.n) AS n, sum(CASE WHEN b.i = a.i THEN 1.0 ELSE 2 * (1 - (b.i - a.i) / (a.lag + 1.0)) END * a.e * b.e) AS s FROM y1 a JOIN y1 b ON {same('a', 'b', 'scheme')} AND b.i BETWEEN a.i AND a.i + a.lag GROUP BY ALL),
y3 AS (SELECT {''.join(f'y2.{c}, ' for c in keys)}y2.scheme, m.mean / nullif(sqrt(greatest(s, 0) / n / n), 0) AS t FROM y2 JOIN (SELECT {k}scheme, avg(x) AS mean FROM y0 GROUP BY ALL) m ON {same('y2', 'm', 'scheme')})"""
    body = " UNION ALL ".join(f"SELECT {k}scheme, grp, '{m}' AS metric, {m} AS value FROM xa" for m in metrics) + f" UNION ALL SELECT {k}scheme, 0, 'nw_t', round(t, 2) FROM y3"
    return ctes, body
