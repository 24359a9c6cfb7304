"""Equivalent SQL (DuckDB) for the queries of ``registry``, put together from shared steps."""

from __future__ import annotations

from ..operators.targets import REASONS
from . import fixture as fx

ZONE = "America/Chicago"

TRADES = """
trades AS (
  SELECT ts AS ts_event, event_id AS seq, CAST(CASE WHEN ts < TIMESTAMP '2024-01-11 18:00:00' THEN 1 WHEN ts < TIMESTAMP '2024-01-21 18:00:00' THEN 2 ELSE 3 END AS BIGINT) AS instrument_id,
    greatest(round(value * 4) / 4, 0.25) AS price, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS size,
    CASE event_type WHEN 'purchase' THEN 'B' WHEN 'error' THEN 'A' ELSE 'N' END AS side
  FROM events
), ctx AS (
  SELECT *, epoch_us(ts_event) AS ts_us, epoch_us(ts_event) // 1000000 * 1000000 AS sec_us,
    CAST((ts_event AT TIME ZONE 'UTC' AT TIME ZONE 'America/Chicago') + INTERVAL 7 HOUR AS DATE) AS session_date, 'TAPE' || instrument_id AS contract,
    CASE side WHEN 'B' THEN size ELSE 0 END AS native_buy_volume, CASE side WHEN 'A' THEN size ELSE 0 END AS native_sell_volume,
    CASE WHEN side IN ('A', 'B') THEN 0 ELSE size END AS native_unknown_volume, CASE side WHEN 'B' THEN size WHEN 'A' THEN -size ELSE 0 END AS native_delta
  FROM trades
)"""
_SOURCE = TRADES[: TRADES.index("), ctx AS")]
DENSE = TRADES.replace(_SOURCE, """
placed AS (
  SELECT *, event_id % 25 AS day, ((event_id // 25) * 18) % 7200 AS second FROM events
), trades AS (
  SELECT make_timestamp(1704204000000000 + day * 86400000000 + second * 1000000 + (event_id % 10) * 100000) AS ts_event, event_id AS seq,
    CAST(CASE WHEN ts_event < TIMESTAMP '2024-01-11 15:00:00' THEN 1 WHEN ts_event < TIMESTAMP '2024-01-19 14:40:00' THEN 2 ELSE 3 END AS BIGINT) AS instrument_id,
    greatest(round(value * 4) / 4, 0.25) AS price, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) + 1 AS size,
    CASE event_type WHEN 'purchase' THEN 'B' WHEN 'error' THEN 'A' ELSE 'N' END AS side
  FROM placed WHERE NOT (day % 6 = 5 AND second BETWEEN 3600 AND 3719)
""")
TICKS = TRADES + """, k0 AS (
  SELECT *, lag(price) OVER w AS p, lag(instrument_id) OVER w AS i FROM ctx WINDOW w AS (ORDER BY ts_event, seq)
), k1 AS (
  SELECT *, CASE WHEN i = instrument_id THEN CAST(sign(price - p) AS INTEGER) END AS change,
    sum(CASE WHEN i <> instrument_id THEN 1 ELSE 0 END) OVER (ORDER BY ts_event, seq) AS seg FROM k0
), k2 AS (
  SELECT *, coalesce(last_value(nullif(change, 0) IGNORE NULLS) OVER (PARTITION BY seg ORDER BY ts_event, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS direction FROM k1
), ticks AS (
  SELECT *, CASE WHEN change > 0 THEN 1 ELSE 0 END AS uptick, CASE WHEN change < 0 THEN 1 ELSE 0 END AS downtick, CASE WHEN change = 0 THEN 1 ELSE 0 END AS same_price,
    CASE WHEN direction = 1 THEN size ELSE 0 END AS inferred_buy_volume, CASE WHEN direction = -1 THEN size ELSE 0 END AS inferred_sell_volume,
    CASE WHEN direction = 0 THEN size ELSE 0 END AS inferred_unknown_volume, direction * size AS inferred_delta
  FROM k2
)"""


def _sum(expression: str, name: str) -> str:
    return f"CAST(sum({expression}) AS BIGINT) AS {name}"


_COUNTS = {
    "total_volume": "size", "size_squared_sum": "size * size", "uptick_count": "uptick", "downtick_count": "downtick", "same_price_count": "same_price",
    "inferred_buy_volume": "inferred_buy_volume", "inferred_sell_volume": "inferred_sell_volume", "inferred_unknown_volume": "inferred_unknown_volume",
    "inferred_buy_trade_count": "CASE WHEN direction = 1 THEN 1 ELSE 0 END", "inferred_sell_trade_count": "CASE WHEN direction = -1 THEN 1 ELSE 0 END",
    "inferred_unknown_trade_count": "CASE WHEN direction = 0 THEN 1 ELSE 0 END", "inferred_delta": "inferred_delta", "native_buy_volume": "native_buy_volume",
    "native_sell_volume": "native_sell_volume", "native_unknown_volume": "native_unknown_volume", "native_delta": "native_delta",
}
SECONDS = TICKS + f""", levels AS (
  SELECT sec_us, instrument_id, price, sum(size) AS v FROM ticks GROUP BY ALL
), top AS (
  SELECT sec_us, instrument_id, CAST(max(v) AS BIGINT) AS max_volume_at_price, count(*) AS unique_price_levels FROM levels GROUP BY ALL
), s0 AS (
  SELECT sec_us, session_date, instrument_id, contract, arg_min(price, (ts_event, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts_event, seq)) AS close,
    sum(price * size) AS price_volume_sum, sum(price * price * size) AS price_squared_volume_sum, count(*) AS trade_count, max(size) AS max_trade_size,
    min(ts_us) AS first_trade_timestamp_us, max(ts_us) AS last_trade_timestamp_us, {", ".join(_sum(e, n) for n, e in _COUNTS.items())}
  FROM ticks GROUP BY ALL
), seconds AS (
  SELECT s0.*, max_volume_at_price, unique_price_levels, coalesce(lag(instrument_id) OVER (ORDER BY sec_us, instrument_id) <> instrument_id, FALSE) AS contract_change
  FROM s0 JOIN top USING (sec_us, instrument_id)
)"""


def bars(width: int) -> str:
    w = width * 1_000_000
    counts = ", ".join(_sum(n, n) for n in [*_COUNTS, "trade_count"])
    return SECONDS + f""", bars AS (
  SELECT sec_us // {w} * {w} + {w} AS decision_us, sec_us // {w} * {w} AS start_us, session_date, min(instrument_id) AS instrument_id, min(contract) AS contract,
    arg_min(open, (sec_us, instrument_id)) AS open, max(high) AS high, min(low) AS low, arg_max(close, (sec_us, instrument_id)) AS close,
    sum(price_volume_sum) AS price_volume_sum, sum(price_squared_volume_sum) AS price_squared_volume_sum, max(max_trade_size) AS max_trade_size, count(*) AS active_second_count,
    min(first_trade_timestamp_us) AS first_trade_timestamp_us, max(last_trade_timestamp_us) AS last_trade_timestamp_us, bool_or(contract_change) AS contract_change, {counts}
  FROM seconds GROUP BY 1, 2, 3
)"""


def _local(date: str, minutes: int) -> str:
    return f"epoch_us((CAST({date} AS TIMESTAMP) + INTERVAL ({minutes}) MINUTE) AT TIME ZONE '{ZONE}')"


def _us(text: str) -> str:
    return f"epoch_us(TIMESTAMP '{text}')"


def prep(s) -> str:
    by = "PARTITION BY session_date ORDER BY t"
    return bars(s.width) + f""", p0 AS (
  SELECT *, decision_us // 1000000 AS t, {_local("session_date", -420)} AS open_us, {_local("session_date", 960)} AS close_us FROM bars
), p1 AS (
  SELECT *, lag(t) OVER s AS pt, lag(instrument_id) OVER s AS pi, lag(close) OVER s AS pc FROM p0 WINDOW s AS ({by})
), p2 AS (
  SELECT *, CASE WHEN pi <> instrument_id THEN 1 ELSE 0 END AS roll, CASE WHEN pt IS NULL OR t - pt <> {s.width} OR pi <> instrument_id THEN 1 ELSE 0 END AS brk FROM p1
), p3 AS (
  SELECT *, sum(roll) OVER s AS segment, sum(brk) OVER s AS run FROM p2 WINDOW s AS ({by})
), p4 AS (
  SELECT *, row_number() OVER (PARTITION BY session_date, run ORDER BY t) - 1 AS nth FROM p3
), p5 AS (
  SELECT *, CASE WHEN nth > 0 THEN ln(close / pc) END AS r, CAST((decision_us - open_us) // 60000000 AS INTEGER) AS slot FROM p4
), prep AS (
  SELECT *, CASE WHEN nth >= {s.scale} THEN sqrt(sum(r * r) OVER (PARTITION BY session_date, run ORDER BY t ROWS BETWEEN {s.scale - 1} PRECEDING AND CURRENT ROW)) END AS scale FROM p5
)"""


def _overlaps(start: str, end: str) -> str:
    return " OR ".join(f"(session_date = DATE '{d}' AND {start} < {_us(b)} AND {_us(a)} < {end})" for d, a, b in fx.COVERAGE.gaps)


def _valid(start: str, end: str) -> str:
    c = fx.COVERAGE
    return f"({_us(c.start)} <= {start} AND {end} <= {_us(c.end)} AND {start} >= open_us AND {end} <= close_us AND NOT ({_overlaps(start, end)}))"


def _first_gap() -> str:
    return "CASE " + " ".join(f"WHEN session_date = DATE '{d}' THEN {_us(a)}" for d, a, _ in fx.COVERAGE.gaps) + " END"


def _frame(s, first: int, last: int = 0) -> str:
    end = "CURRENT ROW" if last == 0 else f"{-last * s.width} PRECEDING"
    return f"(PARTITION BY session_date ORDER BY t RANGE BETWEEN {-first * s.width} PRECEDING AND {end})"


def _clean(s, first: int, last: int, roll_first: int) -> str:
    f, g = _frame(s, first, last), _frame(s, min(roll_first, 0))
    rolls = f"sum(roll) OVER {g} = 0" if roll_first <= 0 else "TRUE"
    return f"coalesce(min(instrument_id) OVER {f} = instrument_id AND max(instrument_id) OVER {f} = instrument_id, TRUE) AND {rolls}"


def _elapsed(s, h: int) -> str:
    return f"{_valid(f'decision_us - {h * s.width * 1000000}', 'decision_us')} AND {_clean(s, -(h - 1), 0, -(h - 2))}"


def _recent(s) -> str:
    k, w = s.recent, s.width * 1_000_000
    return f"{_valid(f'decision_us - {(k + 1) * w}', f'decision_us - {w}')} AND {_clean(s, -k, -1, -(k - 1))}"


def _rows(h: int) -> str:
    return f"(PARTITION BY session_date, run ORDER BY t ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW)"


def _efficiency(h: int) -> str:
    return f"CASE WHEN nth >= {h} THEN CASE WHEN sum(abs(r)) OVER {_rows(h)} = 0 THEN 0.0 ELSE sum(r) OVER {_rows(h)} / sum(abs(r)) OVER {_rows(h)} END END"


def _volatility(h: int) -> str:
    return f"CASE WHEN nth >= {h} THEN sqrt(sum(r * r) OVER {_rows(h)} / {h}) END"


def _distance(level: str) -> str:
    return f"CASE WHEN scale > 1e-12 THEN ln(close / {level}) / scale END"


def _r9(expression: str, name: str) -> str:
    return f"round({expression}, 9) + 0.0 AS {name}"


def _select(steps: str, columns: list[str], source: str = "prep") -> str:
    return f"WITH {steps}\nSELECT decision_us AS decision_timestamp_us, {', '.join(columns)} FROM {source}"


def _baseline(s, steps: str) -> str:
    c = fx.COVERAGE
    list_ = "list({}) FILTER (WHERE admitted) OVER (PARTITION BY slot ORDER BY session_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    d = s.baseline_depth
    return steps + f""", a0 AS (
  SELECT *, ({_us(c.start)} <= start_us AND decision_us <= {_us(c.end)} AND NOT ({_overlaps("start_us", "decision_us")})) AS admitted FROM prep
), a1 AS (
  SELECT *, {list_.format("ln(1 + total_volume)")} AS vs, {list_.format("ln(1 + trade_count)")} AS ns FROM a0
), based AS (
  SELECT *, CASE WHEN len(vs) >= {d} THEN list_median(vs[-{d}:]) END AS bv, CASE WHEN len(ns) >= {d} THEN list_median(ns[-{d}:]) END AS bn FROM a1
)"""


def _flow(s) -> str:
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) END"
    sums = lambda f: share(f"sum(inferred_delta) OVER {f}", f"sum(total_volume) OVER {f}")
    recent = _frame(s, -s.recent, -1)
    deltas = {f"delta_{h}m": f"CASE WHEN {_elapsed(s, h)} THEN {sums(_frame(s, -(h - 1)))} END" for h in s.ranges}
    steps = _baseline(s, prep(s)) + f""", flow AS (
  SELECT *, {share("inferred_delta", "total_volume")} AS delta_1m, {", ".join(f"{e} AS {n}" for n, e in deltas.items())},
    {share("inferred_buy_trade_count - inferred_sell_trade_count", "(inferred_buy_trade_count + inferred_sell_trade_count)")} AS trade_count_imbalance,
    {share("uptick_count - downtick_count", "(uptick_count + downtick_count)")} AS tick_imbalance,
    CASE WHEN {_recent(s)} THEN {sums(recent)} END AS before, {", ".join(f"{_efficiency(h)} AS te_{h}" for h in s.ranges)},
    CASE WHEN scale > 1e-12 THEN abs(r) / scale END AS z, exp(bv) AS usual
  FROM based
)"""
    columns = {n: n for n in ["delta_1m", *deltas, "trade_count_imbalance", "tick_imbalance"]}
    columns |= {"delta_acceleration": "delta_1m - before"} | {f"divergence_{h}m": f"-te_{h} * delta_{h}m" for h in s.ranges}
    columns |= {
        "price_movement_per_volume": "z / (1 + (1 + total_volume) / usual)",
        "price_movement_per_absolute_inferred_delta": "z / (1 + abs(inferred_delta) / usual)",
        "delta_price_alignment": "delta_1m * CASE WHEN scale > 1e-12 THEN r / scale END",
    }
    return _select(steps, [_r9(e, n) for n, e in columns.items()], "flow")


def _targets(safe: bool, s=fx.HOUR, h: int = fx.HORIZON, tolerance: int = fx.TOLERANCE) -> str:
    w = s.width * 1_000_000
    ahead = f"(PARTITION BY session_date ORDER BY t RANGE BETWEEN CURRENT ROW AND {h * s.width} FOLLOWING)"
    mismatch = lambda x, i: f"WHEN {x}_id <> instrument_id THEN '{REASONS[i]}'" if safe else ""
    return bars(s.width) + f""", refs AS (
  SELECT session_date, sec_us // {w} * {w} AS boundary_us, arg_min((first_trade_timestamp_us, open, instrument_id), (first_trade_timestamp_us, instrument_id)) AS ref,
    arg_min(first_trade_timestamp_us, (first_trade_timestamp_us, instrument_id)) AS ref_ts, arg_min(open, (first_trade_timestamp_us, instrument_id)) AS ref_price,
    arg_min(instrument_id, (first_trade_timestamp_us, instrument_id)) AS ref_id
  FROM seconds WHERE sec_us % {w} < {tolerance * 1000000} GROUP BY 1, 2
), b0 AS (SELECT *, decision_us // 1000000 AS t, decision_us + {h * w} AS future_us FROM bars
), b1 AS (
  SELECT *, CASE WHEN max(t) OVER {ahead} <> t + {h * s.width} THEN '{REASONS[0]}' WHEN min(instrument_id) OVER {ahead} <> instrument_id OR max(instrument_id) OVER {ahead} <> instrument_id THEN '{REASONS[2]}'
    WHEN count(*) OVER {ahead} <> {h + 1} THEN '{REASONS[3]}' END AS structure FROM b0
), b2 AS (
  SELECT b1.*, CASE WHEN structure IS NULL THEN x.ref_ts END AS start_ts, CASE WHEN structure IS NULL THEN x.ref_price END AS start_price, CASE WHEN structure IS NULL THEN x.ref_id END AS start_id,
    CASE WHEN structure IS NULL THEN y.ref_ts END AS future_ts, CASE WHEN structure IS NULL THEN y.ref_price END AS future_price, CASE WHEN structure IS NULL THEN y.ref_id END AS future_id
  FROM b1 LEFT JOIN refs x ON x.session_date = b1.session_date AND x.boundary_us = b1.decision_us LEFT JOIN refs y ON y.session_date = b1.session_date AND y.boundary_us = b1.future_us
), b3 AS (
  SELECT *, CASE WHEN structure IS NOT NULL THEN structure WHEN start_ts IS NULL THEN '{REASONS[4]}' {mismatch("start", 5)} WHEN future_ts IS NULL THEN '{REASONS[6]}' {mismatch("future", 7)}
    WHEN start_price = future_price THEN '{REASONS[8]}' ELSE '{REASONS[9]}' END AS eligibility_reason FROM b2
), targets AS (
  SELECT *, eligibility_reason IN ('{REASONS[8]}', '{REASONS[9]}') AS priced, eligibility_reason = '{REASONS[9]}' AS target_eligible,
    CASE WHEN eligibility_reason = '{REASONS[9]}' THEN CAST(future_price > start_price AS INTEGER) END AS label,
    (start_ts - decision_us) / 1e6 AS start_delay, (future_ts - future_us) / 1e6 AS future_delay
  FROM b3
)"""


def _target_rows(safe: bool, *settings) -> str:
    ids = ", start_id AS start_reference_instrument_id, future_id AS future_reference_instrument_id" if safe else ""
    return f"""WITH {_targets(safe, *settings)}
SELECT decision_us AS decision_timestamp_us, CAST(session_date AS VARCHAR) AS session_date, instrument_id, contract, start_ts AS start_reference_timestamp_us,
  round(start_delay, 9) AS start_reference_delay_seconds, start_price AS start_reference_price, future_us AS future_boundary_timestamp_us, future_ts AS future_reference_timestamp_us,
  round(future_delay, 9) AS future_reference_delay_seconds, future_price AS future_reference_price, CASE WHEN priced THEN future_price - start_price END AS forward_price_change,
  CASE WHEN priced THEN round(ln(future_price / start_price), 9) + 0.0 END AS forward_log_return, label AS target_up_15m, target_eligible, eligibility_reason{ids}
FROM targets"""


def _development() -> str:
    """The targets' steps, then the features' steps of the same bars, folds and parts."""
    s = fx.HOUR
    features = prep(s)[len(bars(s.width)):]
    share = f"ln(1 + total_volume) - ln(1 + coalesce(sum(total_volume) OVER {_frame(s, -s.recent, -1)}, 0) / {float(s.recent)})"
    spans = ", ".join(f"({n}, DATE '{a}', DATE '{b}')" for n, (a, b) in enumerate(fx.FOLDS, 1))
    names = {
        "return_1m": f"CASE WHEN nth >= 1 THEN ln(close / lag(close, 1) OVER (PARTITION BY session_date, run ORDER BY t)) END",
        "return_3m": f"CASE WHEN nth >= 3 THEN ln(close / lag(close, 3) OVER (PARTITION BY session_date, run ORDER BY t)) END",
        "log_volume_1m": "ln(1 + total_volume)", "log_trade_count_1m": "ln(1 + trade_count)",
        "trade_size_dispersion_1m": "sqrt(greatest(size_squared_sum / CAST(trade_count AS DOUBLE) - (total_volume / CAST(trade_count AS DOUBLE)) ** 2, 0)) / (total_volume / CAST(trade_count AS DOUBLE))",
        "delta_1m": "inferred_delta / CAST(total_volume AS DOUBLE)", "activity_acceleration_3m": f"CASE WHEN {_recent(s)} THEN {share} END",
    }
    return _targets(True) + features + f""", d0 AS (
  SELECT *, {", ".join(f"{e} AS {n}" for n, e in names.items())}, {_regimes()} FROM prep
), sample AS (
  SELECT d0.*, label AS y, future_ts FROM d0 JOIN targets g USING (decision_us, session_date, instrument_id, contract) WHERE g.target_eligible AND session_date < DATE '2024-01-29'
), spans(fold, a, b) AS (VALUES {spans}), e0 AS (
  SELECT sample.*, CAST(fold AS INTEGER) AS fold, session_date >= a AS v FROM sample JOIN spans ON session_date <= b
), dev AS (
  SELECT *, CASE WHEN v THEN 'validation' WHEN future_ts >= min(CASE WHEN v THEN decision_us END) OVER (PARTITION BY fold) THEN 'purged' ELSE 'train' END AS part FROM e0
)"""


def _regimes() -> str:
    m = f"(hour(make_timestamp(decision_us) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}') * 60 + minute(make_timestamp(decision_us) AT TIME ZONE 'UTC' AT TIME ZONE '{ZONE}'))"
    return (
        f"CAST({m} >= 1020 OR {m} < 120 AS INTEGER) AS asia_flag, CAST({m} >= 120 AND {m} < 510 AS INTEGER) AS europe_flag, "
        f"CAST({m} >= 510 AND {m} < 960 AS INTEGER) AS us_flag, CAST({m} >= 510 AND {m} < 900 AS INTEGER) AS us_rth_flag"
    )


def _baselines() -> str:
    up = f"count(*) FILTER (WHERE {fx.MOMENTUM} > 0)"
    down = f"count(*) FILTER (WHERE {fx.MOMENTUM} < 0)"
    return _development() + f""", rates AS (
  SELECT fold, (sum(y) + 1) / (count(*) + 2) AS p_base, (coalesce(sum(y) FILTER (WHERE {fx.MOMENTUM} > 0), 0) + 1) / ({up} + 2) AS p_up, (coalesce(sum(y) FILTER (WHERE {fx.MOMENTUM} < 0), 0) + 1) / ({down} + 2) AS p_down
  FROM dev WHERE part = 'train' GROUP BY fold
), predicted AS (
  SELECT dev.*, p_base, CASE WHEN {fx.MOMENTUM} > 0 THEN p_up WHEN {fx.MOMENTUM} < 0 THEN p_down ELSE p_base END AS p_momentum FROM dev JOIN rates USING (fold) WHERE part = 'validation'
), scored AS (
  SELECT *, 'baseline_0' AS model, p_base AS p FROM predicted UNION ALL SELECT *, 'baseline_1', p_momentum FROM predicted
)"""


def _metrics(keys: str, source: str) -> str:
    return f"""ranked AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY p) AS least_rank, count(*) OVER (PARTITION BY {keys}, p) AS ties FROM {source}
)
SELECT {keys}, count(*) AS rows, CAST(sum(y) AS BIGINT) AS up, CAST(count(*) - sum(y) AS BIGINT) AS down, round(avg(y), 9) AS up_rate, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 9) AS log_loss,
  round(avg((p - y) * (p - y)), 9) AS brier_score,
  round(CASE WHEN sum(y) > 0 AND sum(y) < count(*) THEN (sum(CASE WHEN y = 1 THEN least_rank + (ties - 1) / 2.0 END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) END, 9) AS roc_auc,
  round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM ranked GROUP BY {keys}"""


def _preprocessing(tail: str) -> str:
    long = " UNION ALL ".join(f"SELECT fold, '{c}' AS feature, {c} AS x FROM dev WHERE part = 'train'" for c in fx.MODEL_FEATURES)
    return f"""WITH {_development()}, long AS ({long}), med AS (
  SELECT fold, feature, count(*) AS rows, count(*) - count(x) AS nulls, median(x) AS median FROM long GROUP BY ALL
), filled AS (SELECT fold, feature, coalesce(x, median) AS x FROM long JOIN med USING (fold, feature))
{tail}"""


def _session_state(s) -> str:
    return _select(prep(s) + f""", so_far AS (
  SELECT *, sum(price_volume_sum) OVER w / sum(total_volume) OVER w AS vwap, max(high) OVER w AS hi, min(low) OVER w AS lo, ({_us(fx.COVERAGE.start)} <= open_us AND coalesce(decision_us <= {_first_gap()}, TRUE)) AS ok
  FROM prep WINDOW w AS (PARTITION BY session_date, segment ORDER BY t ROWS UNBOUNDED PRECEDING)
)""", [
        _r9(f"CASE WHEN ok THEN {_distance('vwap')} END", "session_vwap_distance"), _r9("CASE WHEN ok THEN CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / (hi - lo) END END", "session_range_position"),
        _r9(f"CASE WHEN ok THEN {_distance('hi')} END", "session_high_distance"), _r9(f"CASE WHEN ok THEN {_distance('lo')} END", "session_low_distance"),
    ], "so_far")


def _prior_session(s) -> str:
    return _select(prep(s) + f""", lv AS (
  SELECT session_date, max(high) AS h, min(low) AS l, arg_max(close, decision_us) AS c, max(decision_us) AS d, min(instrument_id) AS id,
    min(instrument_id) = max(instrument_id) AND {_us(fx.COVERAGE.start)} <= min(open_us) AND min(close_us) <= {_us(fx.COVERAGE.end)} AND session_date NOT IN ({", ".join(f"DATE '{g[0]}'" for g in fx.COVERAGE.gaps)}) AS ok
  FROM prep GROUP BY session_date
), pv AS (
  SELECT session_date, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c, lag(d) OVER w AS d, lag(id) OVER w AS id, lag(ok) OVER w AS ok FROM lv WINDOW w AS (ORDER BY session_date)
), against AS (SELECT prep.*, h, l, c, ok AND d < decision_us AND id = instrument_id AS usable FROM prep JOIN pv USING (session_date))""", [
        _r9(f"CASE WHEN usable THEN {_distance(x)} END", f"prior_session_{n}_distance") for x, n in (("h", "high"), ("l", "low"), ("c", "close"))
    ], "against")


def _opening_range(s) -> str:
    return _select(prep(s) + f""", o0 AS (
  SELECT *, {_local("session_date", s.opening[0])} AS a, {_local("session_date", s.opening[1])} AS b FROM prep
), o1 AS (
  SELECT session_date, max(high) AS hi, min(low) AS lo, min(instrument_id) AS i1, max(instrument_id) AS i2, count(DISTINCT start_us) AS n FROM o0 WHERE start_us >= a AND start_us < b GROUP BY session_date
), opened AS (
  SELECT o0.*, hi, lo, decision_us >= b AND n = {(s.opening[1] - s.opening[0]) * 60 // s.width} AND i1 = i2 AND i1 = instrument_id AND {_valid("a", "b")} AS ok FROM o0 LEFT JOIN o1 USING (session_date)
)""", [_r9("CASE WHEN ok THEN CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / (hi - lo) END END", "us_opening_range_position")], "opened")  # fmt: skip


def _clock_columns() -> list[str]:
    return ["slot AS minutes_since_cme_open", _r9("sin(2 * pi() * slot / 1380)", "time_of_day_sin"), _r9("cos(2 * pi() * slot / 1380)", "time_of_day_cos"), _regimes()]


def _returns(s) -> list[str]:
    return [_r9(f"CASE WHEN nth >= {h} THEN ln(close / lag(close, {h}) OVER (PARTITION BY session_date, run ORDER BY t)) END", f"return_{h}m") for h in s.returns]


def _path_columns(s) -> list[str]:
    a, b = s.volatilities
    return [
        *[_r9(_efficiency(h), f"trend_efficiency_{h}m") for h in s.efficiencies], *[_r9(_volatility(h), f"realized_volatility_{h}m") for h in s.volatilities],
        _r9(f"CASE WHEN {_volatility(b)} > 1e-12 THEN {_volatility(a)} / {_volatility(b)} END", f"volatility_ratio_{a}m_{b}m"),
    ]


def _range_columns(s) -> list[str]:
    return [_r9(f"CASE WHEN {_elapsed(s, h)} THEN ln(max(high) OVER {_frame(s, -(h - 1))} / min(low) OVER {_frame(s, -(h - 1))}) END", f"range_{h}m") for h in s.ranges]


def _acceleration_column(s) -> str:
    k = s.recent
    return _r9(f"CASE WHEN {_recent(s)} THEN ln(1 + total_volume) - ln(1 + coalesce(sum(total_volume) OVER {_frame(s, -k, -1)}, 0) / {float(k)}) END", f"activity_acceleration_{k}m")


def _participation_columns(s) -> list[str]:
    return [
        _r9("ln(1 + total_volume)", "log_volume_1m"), _r9("ln(1 + trade_count)", "log_trade_count_1m"), _r9("ln(total_volume / CAST(trade_count AS DOUBLE))", "log_average_trade_size_1m"),
        _r9("sqrt(greatest(size_squared_sum / CAST(trade_count AS DOUBLE) - (total_volume / CAST(trade_count AS DOUBLE)) ** 2, 0)) / (total_volume / CAST(trade_count AS DOUBLE))", "trade_size_dispersion_1m"),
        _r9("ln(1 + max_trade_size)", "log_max_trade_size_1m"), _r9(f"active_second_count / {float(s.width)}", "active_second_fraction_1m"),
    ]


def _relative(s) -> str:
    return _select(_baseline(s, prep(s)), [_r9("ln(1 + total_volume) - bv", "relative_volume_q"), _r9("ln(1 + trade_count) - bn", "relative_trade_count_q")], "based")


def _bar_rows(s) -> str:
    return f"WITH {bars(s.width)} SELECT * EXCLUDE (decision_us, start_us, session_date), decision_us AS decision_timestamp_us, start_us AS minute_start_us, CAST(session_date AS VARCHAR) AS session_date FROM bars"


def _minutes() -> dict[str, str]:
    """The same steps with the settings of one-minute bars, over the dense tape."""
    s = fx.MINUTE
    sql = {
        "minute_bars": _bar_rows(s), "minute_paths": _select(prep(s), [*_returns(s), *_path_columns(s)]),
        "minute_activity": _select(prep(s), [*_range_columns(s), _acceleration_column(s), *_participation_columns(s), *_clock_columns()]),
        "minute_session": _session_state(s), "minute_prior": _prior_session(s), "minute_opening": _opening_range(s), "minute_baseline": _relative(s), "minute_flow": _flow(s),
        "minute_targets": _target_rows(True, s, 15, 10), "minute_reasons": f"WITH {_targets(True, s, 15, 10)} SELECT eligibility_reason, count(*) AS rows FROM targets GROUP BY 1",
    }
    return {name: text.replace(TRADES, DENSE) for name, text in sql.items()}


def _build() -> dict[str, str]:
    ten, half, hour = fx.TEN, fx.HALF, fx.HOUR
    date = "CAST(session_date AS VARCHAR) AS session_date"
    sql = {
        "trade_context": f"WITH {TRADES} SELECT seq, ts_us AS ts_event_us, sec_us AS timestamp_second_us, {date}, contract, instrument_id, price, size, native_buy_volume, native_sell_volume, native_unknown_volume, native_delta FROM ctx",
        "tick_rule": f"WITH {TICKS} SELECT seq, change, direction, CAST(uptick AS BIGINT) AS uptick, CAST(downtick AS BIGINT) AS downtick, CAST(same_price AS BIGINT) AS same_price, inferred_buy_volume, inferred_sell_volume, inferred_unknown_volume, CAST(inferred_delta AS BIGINT) AS inferred_delta FROM ticks",
        "bars_1s": f"WITH {SECONDS} SELECT * EXCLUDE (sec_us, session_date), sec_us AS timestamp_second_us, {date} FROM seconds",
        "bars_rollup": _bar_rows(ten),
        "session_manifest": f"""WITH {SECONDS} SELECT {date}, count(*) AS bar_rows, CAST(sum(trade_count) AS BIGINT) AS trades, CAST(sum(total_volume) AS BIGINT) AS volume, min(first_trade_timestamp_us) AS first_trade_us,
  max(last_trade_timestamp_us) AS last_trade_us, count(DISTINCT instrument_id) AS instruments, count(*) FILTER (WHERE contract_change) AS contract_changes,
  {_us(fx.COVERAGE.start)} <= {_local("seconds.session_date", -420)} AND {_local("seconds.session_date", 960)} <= {_us(fx.COVERAGE.end)} AS complete,
  seconds.session_date IN (DATE '2024-01-05', DATE '2024-01-20') OR seconds.session_date - 1 IN (DATE '2024-01-05', DATE '2024-01-20') AS degraded FROM seconds GROUP BY seconds.session_date""",
        "session_clock": _select(prep(ten), _clock_columns()),
        "path_returns": _select(prep(half), _returns(half)),
        "path_volatility": _select(prep(half), _path_columns(half)),
        "elapsed_ranges": _select(prep(ten), _range_columns(ten)),
        "activity_acceleration": _select(prep(ten), [_acceleration_column(ten)]),
        "participation": _select(prep(ten), _participation_columns(ten)),
        "activity_baseline": _relative(hour),
        "session_state": _session_state(half),
        "prior_session_levels": _prior_session(half),
        "opening_range": _opening_range(half),
        "order_flow_features": _flow(hour),
        "asof_reference": f"WITH {_targets(True)} SELECT {date}, boundary_us, ref_ts AS ts_us, ref_price AS price, ref_id AS id FROM refs",
        "forward_targets_v1": _target_rows(False),
        "forward_targets_v2": _target_rows(True),
        "target_funnel": f"""WITH {_targets(True)} SELECT {date}, count(*) AS candidates, count(*) FILTER (WHERE structure IS NULL) AS structurally_valid, count(*) FILTER (WHERE priced) AS reference_pairs,
  count(*) FILTER (WHERE priced AND NOT target_eligible) AS equal_price, count(*) FILTER (WHERE target_eligible) AS eligible, count(*) FILTER (WHERE label = 1) AS up, count(*) FILTER (WHERE label = 0) AS down,
  round(median(start_delay), 9) AS median_start_delay, round(max(start_delay), 9) AS longest_start_delay, min(CASE WHEN target_eligible THEN decision_us END) AS first_eligible_us, max(CASE WHEN target_eligible THEN decision_us END) AS last_eligible_us
FROM targets GROUP BY targets.session_date""",
        "target_reasons": f"WITH {_targets(True)} SELECT eligibility_reason, count(*) AS rows FROM targets GROUP BY 1",
        "target_version_diff": f"""WITH o AS (WITH {_targets(False)} SELECT decision_us, session_date, eligibility_reason, label FROM targets), n AS (WITH {_targets(True)} SELECT decision_us, session_date, eligibility_reason, label FROM targets)
SELECT coalesce(o.decision_us, n.decision_us) AS decision_timestamp_us, CAST(coalesce(o.session_date, n.session_date) AS VARCHAR) AS session_date, o.eligibility_reason AS old_reason, o.label AS old_label, n.eligibility_reason AS new_reason, n.label AS new_label
FROM o FULL JOIN n ON o.decision_us = n.decision_us AND o.session_date = n.session_date WHERE o.eligibility_reason IS DISTINCT FROM n.eligibility_reason OR o.label IS DISTINCT FROM n.label""",
        "dev_sample": f"WITH {_development()} SELECT fold, part, decision_us AS decision_timestamp_us, round(return_1m, 9) + 0.0 AS return_1m, y AS target_up_15m, future_ts AS future_reference_timestamp_us FROM dev",
        "dev_folds": f"""WITH {_development()} SELECT fold, count(*) FILTER (WHERE part <> 'validation') AS raw_training_rows, count(*) FILTER (WHERE part = 'purged') AS purged_rows, count(*) FILTER (WHERE part = 'train') AS final_training_rows,
  count(*) FILTER (WHERE part = 'validation') AS validation_rows, count(DISTINCT CASE WHEN part = 'validation' THEN session_date END) AS validation_sessions, max(CASE WHEN part = 'train' THEN future_ts END) AS latest_training_reference_us,
  min(CASE WHEN part = 'validation' THEN decision_us END) AS earliest_validation_decision_us FROM dev GROUP BY fold""",
        "baseline_probabilities": f"WITH {_baselines()} SELECT fold, decision_us AS decision_timestamp_us, y AS target_up_15m, round(p_base, 9) AS p_base, round(p_momentum, 9) AS p_momentum FROM predicted",
        "probability_metrics": f"WITH {_baselines()}, {_metrics('fold, model', 'scored')}",
        "calibration": f"""WITH {_baselines()}, bins AS (SELECT fold, model, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS rows, avg(p) AS m, avg(y) AS o FROM scored GROUP BY 1, 2, 3)
SELECT k.fold, k.model, CAST(b.bin AS INTEGER) AS bin, coalesce(rows, 0) AS rows, round(m, 9) AS mean_predicted_up, round(o, 9) AS observed_up_rate
FROM (SELECT DISTINCT fold, model FROM scored) k CROSS JOIN (SELECT unnest(range(10)) AS bin) b LEFT JOIN bins ON bins.fold = k.fold AND bins.model = k.model AND bins.bin = b.bin""",
        "stability": f"""WITH {_baselines()}, grouped AS (
  SELECT *, 'month:' || strftime(session_date, '%Y-%m') AS grp FROM scored UNION ALL SELECT *, 'regime:Asia' FROM scored WHERE asia_flag = 1 UNION ALL SELECT *, 'regime:Europe' FROM scored WHERE europe_flag = 1
  UNION ALL SELECT *, 'regime:U.S.' FROM scored WHERE us_flag = 1 UNION ALL SELECT *, 'regime:U.S. RTH' FROM scored WHERE us_rth_flag = 1), {_metrics('grp, model', 'grouped')}""",
        "probability_quantiles": f"WITH {_baselines()} SELECT fold, model, " + ", ".join(f"round(quantile_cont(p, {q}), 9) AS q{round(q * 100)}" for q in (0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1)) + " FROM scored GROUP BY fold, model",
        "training_medians": _preprocessing("SELECT fold, feature, rows, nulls, round(median, 9) + 0.0 AS median FROM med"),
        "training_scaler": _preprocessing("SELECT fold, feature, round(avg(x), 9) + 0.0 AS mean, round(CASE WHEN min(x) < max(x) THEN stddev_pop(x) ELSE 1.0 END, 9) AS scale FROM filled GROUP BY fold, feature"),
        "feature_distribution": f"""WITH {prep(ten)}, fd AS (SELECT {", ".join(f"CASE WHEN {_elapsed(ten, h)} THEN ln(max(high) OVER {_frame(ten, -(h - 1))} / min(low) OVER {_frame(ten, -(h - 1))}) END AS range_{h}m" for h in (5, 15))},
  ln(1 + total_volume) AS log_volume_1m, sqrt(greatest(size_squared_sum / CAST(trade_count AS DOUBLE) - (total_volume / CAST(trade_count AS DOUBLE)) ** 2, 0)) / (total_volume / CAST(trade_count AS DOUBLE)) AS trade_size_dispersion_1m FROM prep)
""" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS present, count(*) - count({c}) AS absent, count(*) FILTER (WHERE isfinite({c})) AS finite, round((count(*) - count({c})) / count(*), 9) AS null_share, round(min({c}), 9) + 0.0 AS least, round(median({c}), 9) + 0.0 AS median, round(max({c}), 9) + 0.0 AS greatest FROM fd" for c in ("range_5m", "range_15m", "log_volume_1m", "trade_size_dispersion_1m")),
        "direction_agreement": f"""WITH {TICKS}, known AS (SELECT *, CASE side WHEN 'B' THEN 1 WHEN 'A' THEN -1 END AS native FROM ticks WHERE side IN ('A', 'B') AND direction <> 0)
SELECT coalesce(change <> 0, FALSE) AS moved, count(*) AS trades, count(*) FILTER (WHERE native = direction) AS agreeing_trades, CAST(sum(size) AS BIGINT) AS volume, CAST(coalesce(sum(size) FILTER (WHERE native = direction), 0) AS BIGINT) AS agreeing_volume FROM known GROUP BY 1""",
        "first_second_coverage": f"""WITH {_targets(True)}, seen AS (SELECT boundary_us, bool_or(ref_ts < boundary_us + 1000000) AS exact FROM refs GROUP BY 1)
SELECT count(*) AS bars, count(*) FILTER (WHERE x.exact) AS exact_start, count(*) FILTER (WHERE x.exact AND y.exact) AS exact_pair, count(x.exact) AS within_start, count(*) FILTER (WHERE x.exact IS NOT NULL AND y.exact IS NOT NULL) AS within_pair
FROM b0 LEFT JOIN seen x ON x.boundary_us = decision_us LEFT JOIN seen y ON y.boundary_us = future_us""",
    }
    return sql | _minutes()


SQL = _build()
