"""SQL building blocks for the comparison queries.

They state each rule the direct way (whole-series windows, recursive CTEs) and
share no code with the Spark side.
"""
from __future__ import annotations

TICKS = """ticks AS (
  SELECT p_brand AS asset, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS qty,
         l_orderkey, l_linenumber, l_extendedprice, l_discount, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_ORD = "l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)"

BARS = TICKS + f""", bars AS (
  SELECT *, row_number() OVER (PARTITION BY asset ORDER BY ts) - 1 AS pos FROM (
    SELECT asset, ts, first(price ORDER BY {_ORD}) AS open, max(price) AS high, min(price) AS low,
           last(price ORDER BY {_ORD}) AS close, sum(qty) AS volume
    FROM ticks GROUP BY asset, ts))"""

FUNDING = """funding AS (
  SELECT asset, ts, (CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 0.05::DOUBLE)
         / 100.0::DOUBLE AS funding_rate
  FROM ticks GROUP BY asset, ts)"""

PANEL = """panel AS (
  SELECT n_name AS asset, CAST(date_trunc('week', l_shipdate) AS TIMESTAMP) AS day,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE)
         / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2),
days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS d FROM (SELECT DISTINCT day FROM panel)),
grid AS (
  SELECT days.day, days.d, a.asset, panel.close
  FROM days CROSS JOIN (SELECT DISTINCT asset FROM panel) a
  LEFT JOIN panel ON panel.day = days.day AND panel.asset = a.asset)"""

WEEK_FUNDING = """wfund AS (
  SELECT n_name AS asset, l_shipdate AS ts,
         (CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 0.05::DOUBLE)
         / 1000.0::DOUBLE AS funding_rate
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY 1, 2)"""

STREAM = """sticks AS (
  SELECT event_type AS asset, ts, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty,
         event_id AS seq FROM events)"""


def ewm(name: str, source: str, alpha: float, value: str) -> str:
    """Recursive exponential average of ``value`` over ``source`` rows (asset, pos)."""
    return f"""{name} AS (
  SELECT asset, pos, x AS y FROM (SELECT asset, pos, {value} AS x, row_number() OVER (PARTITION BY asset ORDER BY pos) AS rn
    FROM {source} WHERE {value} IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT s.asset, s.pos, {alpha!r}::DOUBLE * {value_of(value)} + (1.0::DOUBLE - {alpha!r}::DOUBLE) * e.y
  FROM {name} e JOIN {source} s ON s.asset = e.asset AND s.pos = e.pos + 1)"""


def value_of(value: str) -> str:
    return value


def roll(fn: str, value: str, n: int, shift: int = 0) -> str:
    w = f"(PARTITION BY asset ORDER BY pos ROWS BETWEEN {n - 1 + shift} PRECEDING AND {shift} {'PRECEDING' if shift else 'PRECEDING'})"
    return f"CASE WHEN count({value}) OVER {w} = {n} THEN {fn}({value}) OVER {w} END"


def lag(value: str, k: int = 1) -> str:
    return f"lag({value}, {k}) OVER (PARTITION BY asset ORDER BY pos)"


# Price features on bars: ``feat`` holds every column of the feature table on
# all bars (pos) and ``tf`` the usable ones with restarted positions (bar).
def feature_ctes(extra_cols: str = "") -> str:
    a = {12: 2 / 13, 26: 2 / 27, 9: 2 / 10, 14: 1 / 14, 70: 1 / 70}
    c = "close"
    return f"""b1 AS (
  SELECT *, close - {lag(c)} AS delta,
    greatest(high - low, abs(high - {lag(c)}), abs(low - {lag(c)})) AS tr,
    ln(close / {lag(c)}) AS log_ret,
    coalesce(sign(close - {lag(c)}) * volume, 0) AS sv FROM bars),
b2 AS (
  SELECT *, CASE WHEN delta IS NULL THEN NULL WHEN delta > 0 THEN delta ELSE 0 END AS up,
    CASE WHEN delta IS NULL THEN NULL WHEN delta < 0 THEN -delta ELSE 0 END AS down,
    sum(sv) OVER (PARTITION BY asset ORDER BY pos) AS obv FROM b1),
{ewm('e12', 'b2', a[12], 'close')},
{ewm('e26', 'b2', a[26], 'close')},
{ewm('eu14', 'b2', a[14], 'up')},
{ewm('ed14', 'b2', a[14], 'down')},
{ewm('eu70', 'b2', a[70], 'up')},
{ewm('ed70', 'b2', a[70], 'down')},
mc AS (SELECT b2.*, e12.y AS ema_12, e26.y AS ema_26, (e12.y - e26.y) / (close + 1e-9) AS macd
  FROM b2 JOIN e12 USING (asset, pos) JOIN e26 USING (asset, pos)),
{ewm('es', 'mc', a[9], 'macd')},
b3 AS (
  SELECT mc.*, es.y AS macds,
    100 - 100 / (1 + eu14.y / (ed14.y + 1e-9)) AS "RSI_14",
    100 - 100 / (1 + eu70.y / (ed70.y + 1e-9)) AS "RSI_70",
    {roll('avg', 'close', 10)} AS s10, {roll('avg', 'close', 20)} AS s20, {roll('avg', 'close', 50)} AS s50,
    {roll('stddev_samp', 'close', 20)} AS d20,
    {roll('avg', 'tr', 14)} AS tr14, {roll('avg', 'tr', 50)} AS tr50,
    {roll('stddev_samp', 'log_ret', 10)} * sqrt(365) AS realized_vol_10,
    {roll('stddev_samp', 'log_ret', 30)} * sqrt(365) AS realized_vol_30,
    {roll('avg', 'volume', 20)} AS vol_sma_20,
    {roll('avg', 'obv', 20)} AS "OBV_sma_20", {roll('avg', 'obv', 70)} AS "OBV_sma_70"
  FROM mc JOIN es USING (asset, pos) LEFT JOIN eu14 USING (asset, pos) LEFT JOIN ed14 USING (asset, pos)
  LEFT JOIN eu70 USING (asset, pos) LEFT JOIN ed70 USING (asset, pos)),
feat AS (
  SELECT asset, ts, pos, pos - 69 AS bar, open, high, low, close, volume, obv, tr, ema_12, ema_26{extra_cols},
    close / {lag(c, 1)} - 1 AS ret_1d, close / {lag(c, 2)} - 1 AS ret_2d, close / {lag(c, 3)} - 1 AS ret_3d,
    close / {lag(c, 5)} - 1 AS ret_5d, close / {lag(c, 10)} - 1 AS roc_10, close / {lag(c, 20)} - 1 AS roc_20,
    macd AS "MACD_12_26_9", macds AS "MACDs_12_26_9", macd - macds AS "MACDh_12_26_9", "RSI_14", "RSI_70",
    tr14 / (close + 1e-9) AS "ATR_14", tr50 / (close + 1e-9) AS "ATR_50",
    (tr14 / (close + 1e-9)) / (tr50 / (close + 1e-9) + 1e-9) AS "ATR_ratio",
    tr14 / (close + 1e-9) * close AS atr,
    ((s20 + d20 * 2) - (s20 - d20 * 2)) / (s20 + 1e-9) AS bb_width,
    (close - (s20 - d20 * 2)) / ((s20 + d20 * 2) - (s20 - d20 * 2) + 1e-9) AS bb_pct,
    (close - s20) / (d20 * 2 + 1e-9) AS bb_position,
    s10 / s50 - 1 AS sma_dist, close / (s20 + 1e-9) - 1 AS close_to_sma20, close / (s50 + 1e-9) - 1 AS close_to_sma50,
    realized_vol_10, realized_vol_30, realized_vol_10 / (realized_vol_30 + 1e-9) AS vol_regime,
    volume / {lag('volume')} - 1 AS vol_change_1d, volume / {lag('volume', 3)} - 1 AS vol_change_3d,
    vol_sma_20, volume / (vol_sma_20 + 1e-9) AS vol_ratio, "OBV_sma_20", "OBV_sma_70",
    (obv - "OBV_sma_20") / (CASE WHEN "OBV_sma_20" = 0 THEN 1e-9 ELSE "OBV_sma_20" END) AS "OBV_dist",
    (obv - "OBV_sma_70") / (CASE WHEN "OBV_sma_70" = 0 THEN 1e-9 ELSE "OBV_sma_70" END) AS "OBV_trend",
    isodow(ts) - 1 AS dow, hour(ts) AS hour,
    sqrt(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) AS garman_klass_vol
  FROM b3),
tf AS (SELECT * FROM feat WHERE bar >= 0)"""


FEATURES = BARS + ",\n" + feature_ctes()


def with_(*ctes: str, recursive: bool = False) -> str:
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n"


PERMUTATIONS = 10_000
#: A bound of the Wilson interval of n_wins among n; the sign s is put in.
WILSON = """(n_wins / n::DOUBLE + 1.959963984540054 ** 2 / (2 * n) {s} 1.959963984540054 * sqrt((n_wins / n::DOUBLE) * (1 - n_wins / n::DOUBLE) / n
  + 1.959963984540054 ** 2 / (4 * n::DOUBLE * n))) / (1 + 1.959963984540054 ** 2 / n)"""


def null_means(key: str) -> str:
    """nul (key, it, m): the wins of random picks from a pool (key, label, sel) of 0/1 labels, one hypergeometric count an iteration."""
    return f"""facts AS (SELECT {key}, avg(label) FILTER (WHERE sel) AS stat, count(*) FILTER (WHERE sel) AS n_selected, count(*) AS n_pool,
  count(*) FILTER (WHERE label = 0) AS losses FROM pool GROUP BY {key}),
span AS (SELECT *, n_selected * losses / n_pool::DOUBLE AS mid,
  10 * sqrt(n_selected * losses / n_pool::DOUBLE * (n_pool - losses) / n_pool * (n_pool - n_selected) / greatest(n_pool - 1, 1)) + 1 AS wide FROM facts),
support AS (SELECT *, greatest(0, n_selected - (n_pool - losses), CAST(floor(mid - wide) AS BIGINT)) AS lo,
  unnest(range(greatest(0, n_selected - (n_pool - losses), CAST(floor(mid - wide) AS BIGINT)), least(n_selected, losses, CAST(ceil(mid + wide) AS BIGINT)) + 1)) AS x FROM span),
logs AS (SELECT *, sum(CASE WHEN x = lo THEN 0 ELSE ln((losses - x + 1)::DOUBLE * (n_selected - x + 1) / (x::DOUBLE * (n_pool - losses - n_selected + x))) END)
  OVER (PARTITION BY {key} ORDER BY x) AS lg FROM support),
mass AS (SELECT *, exp(lg - max(lg) OVER (PARTITION BY {key})) AS m FROM logs),
starts AS (SELECT {key}, x, coalesce(sum(m) OVER (PARTITION BY {key} ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  / sum(m) OVER (PARTITION BY {key}) AS at FROM mass),
its AS (SELECT {key}, it, n_selected, (('0x' || substr(md5(concat_ws('_', {key}, it, 0, 0)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM facts, range(1, {PERMUTATIONS + 1}) r(it)),
nul AS (SELECT i.{key}, i.it, (i.n_selected - s.x) / i.n_selected::DOUBLE AS m FROM its i ASOF JOIN starts s ON i.{key} = s.{key} AND i.u >= s.at)"""
