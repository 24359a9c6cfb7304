"""Equivalent SQL (DuckDB) for the audits, over layers that SQL makes from the tables itself."""

from __future__ import annotations

from ..operators.targets import ALLOWED, NEW_REASONS, REASONS
from ..schemas import TARGETS
from . import fixture as fx
from . import oracle as o

HOLDOUT = "2024-01-29"


def _rules(source: str, rules: dict[str, str]) -> list[str]:
    """Rows and violations of each rule that must hold; one that is null is broken."""
    return [f"SELECT '{n}' AS \"check\", count(*) AS rows, count(*) FILTER (WHERE NOT coalesce({r}, FALSE)) AS violations FROM {source}" for n, r in rules.items()]


def _once(name: str, source: str, keys: str) -> list[str]:
    return _rules(f"(SELECT {keys}, count(*) AS n FROM {source} GROUP BY ALL)", {name: "n = 1"})


def _all(selects: list[str]) -> str:
    return "\nUNION ALL ".join(selects)


def _compare(a: str, b: str, keys: list[str], columns: dict[str, bool], tolerance: float) -> list[str]:
    """Column by column; columns say whether they are numbers."""
    out = []
    for c, number in columns.items():
        far = f"abs(a.{c} - b.{c}) > greatest(1.0, abs(a.{c}), abs(b.{c})) * {tolerance}" if number else f"a.{c} <> b.{c}"
        broken = f"a.{keys[0]} IS NULL OR b.{keys[0]} IS NULL OR (a.{c} IS NULL) <> (b.{c} IS NULL) OR coalesce({far}, FALSE)"
        on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
        out.append(f"SELECT '{c}' AS \"check\", count(a.{c}) AS rows, count(*) FILTER (WHERE {broken}) AS violations FROM {a} a FULL JOIN {b} b ON {on}")
    return out


def _layer_checks() -> str:
    s = fx.HOUR
    steps = o._targets(True) + o.prep(s)[len(o.bars(s.width)):]
    inside = "low <= open AND open <= high AND low <= close AND close <= high AND low <= high"
    seconds = {
        "seconds_prices": inside, "seconds_positive": "low > 0 AND total_volume > 0 AND trade_count > 0",
        "seconds_inferred_volume": "inferred_buy_volume + inferred_sell_volume + inferred_unknown_volume = total_volume",
        "seconds_native_volume": "native_buy_volume + native_sell_volume + native_unknown_volume = total_volume",
        "seconds_inferred_delta": "inferred_buy_volume - inferred_sell_volume = inferred_delta", "seconds_native_delta": "native_buy_volume - native_sell_volume = native_delta",
        "seconds_counts": "inferred_buy_trade_count + inferred_sell_trade_count + inferred_unknown_trade_count = trade_count",
        "seconds_moves": "uptick_count + downtick_count + same_price_count <= trade_count", "seconds_level_volume": "max_volume_at_price <= total_volume AND unique_price_levels <= trade_count",
        "seconds_times": "first_trade_timestamp_us <= last_trade_timestamp_us AND first_trade_timestamp_us // 1000000 * 1000000 = sec_us AND last_trade_timestamp_us // 1000000 * 1000000 = sec_us",
        "seconds_session": f"CAST((make_timestamp(sec_us) AT TIME ZONE 'UTC' AT TIME ZONE '{o.ZONE}') + INTERVAL 7 HOUR AS DATE) = session_date",
    }
    hour = {
        "bars_time": "last_trade_timestamp_us < decision_us", "bars_start": "first_trade_timestamp_us >= start_us",
        "bars_positive": "total_volume > 0 AND trade_count > 0 AND low > 0", "bars_prices": "low <= open AND open <= high AND low <= close AND close <= high",
    }
    late = lambda c: f"({c} IS NULL OR ({c} >= 0 AND {c} < {fx.TOLERANCE}))"
    labels = {
        "targets_reason": "eligibility_reason IN (" + ", ".join(f"'{r}'" for r in REASONS) + ")", "targets_eligible": f"target_eligible = (eligibility_reason = '{REASONS[9]}')",
        "targets_label": "(label IS NOT NULL) = target_eligible", "targets_sign": "label IS NULL OR label = CAST(future_price - start_price > 0 AS INTEGER)",
        "targets_delay": f"{late('start_delay')} AND {late('future_delay')}", "targets_contract": "NOT target_eligible OR (start_id = instrument_id AND future_id = instrument_id)",
        "targets_equal": f"(eligibility_reason = '{REASONS[8]}') = (priced AND future_price = start_price)",
    }
    te = {h: o._efficiency(h) for h in s.efficiencies}
    vol = {h: o._volatility(h) for h in s.volatilities}
    between = lambda c, a, b: f"({c} IS NULL OR {c} BETWEEN {a} - 1e-12 AND {b} + 1e-12)"
    steps += f""", ff AS (
  SELECT *, {", ".join(f"{e} AS te_{h}" for h, e in te.items())}, {", ".join(f"{e} AS vol_{h}" for h, e in vol.items())}, {o._regimes()},
    active_second_count / {float(s.width)} AS active, (close - min(low) OVER sf) / nullif(max(high) OVER sf - min(low) OVER sf, 0) AS place
  FROM prep WINDOW sf AS (PARTITION BY session_date, segment ORDER BY t ROWS UNBOUNDED PRECEDING)
)"""
    names = [f"te_{h}" for h in te] + [f"vol_{h}" for h in vol] + ["active", "place", "scale", "r"]
    full = {
        "features_flags": " AND ".join(f"{f} IN (0, 1)" for f in ("asia_flag", "europe_flag", "us_flag", "us_rth_flag")), "features_fraction": between("active", 0, 1),
        "features_position": between("place", 0, 1), "features_efficiency": " AND ".join(between(f"te_{h}", -1, 1) for h in te),
        "features_volatility": " AND ".join(f"coalesce(vol_{h} >= -1e-12, TRUE)" for h in vol), "features_not_finite": " AND ".join(f"coalesce(isfinite({c}), TRUE)" for c in names),
    }
    totals = """(SELECT * FROM (SELECT session_date, sum(total_volume) AS av, sum(trade_count) AS an, sum(price_volume_sum) AS ap FROM bars GROUP BY 1)
      FULL JOIN (SELECT session_date, sum(size) AS bv, count(*) AS bn, sum(price * size) AS bp FROM ticks GROUP BY 1) USING (session_date))"""
    ordered = "(SELECT first_trade_timestamp_us, lag(last_trade_timestamp_us) OVER (PARTITION BY session_date ORDER BY sec_us, instrument_id) AS before FROM seconds)"
    parts = [
        *_rules("seconds", seconds), *_rules(ordered, {"seconds_order": "before IS NULL OR first_trade_timestamp_us >= before"}),
        *_rules("(SELECT instrument_id, count(DISTINCT contract) AS n FROM seconds GROUP BY 1)", {"seconds_contract": "n = 1"}),
        *_rules("(SELECT sec_us, count(DISTINCT session_date) AS n FROM seconds GROUP BY 1)", {"seconds_single_session": "n = 1"}),
        *_once("seconds_key", "seconds", "sec_us, instrument_id"), *_rules("bars", hour), *_rules(totals, {"bars_totals": "av = bv AND an = bn AND abs(ap - bp) <= 1e-9 * abs(bp)"}),
        *_once("bars_key", "bars", "decision_us"), *_rules("targets", labels), *_once("targets_key", "targets", "decision_us"), *_rules("ff", full),
    ]
    return f"WITH {steps}\n{_all(parts)}"


def _dataset_audit() -> str:
    return f"""WITH {o.SECONDS}, raw AS (
  SELECT session_date, count(DISTINCT (sec_us, instrument_id)) AS raw_seconds, count(*) AS raw_trades, CAST(sum(size) AS BIGINT) AS raw_volume, count(DISTINCT instrument_id) AS raw_instruments,
    min(sec_us) AS raw_first_second_us, max(sec_us) AS raw_last_second_us FROM ctx GROUP BY 1
), layer AS (
  SELECT session_date, count(*) AS bar_rows, CAST(sum(trade_count) AS BIGINT) AS bar_trades, CAST(sum(total_volume) AS BIGINT) AS bar_volume, count(DISTINCT instrument_id) AS bar_instruments,
    min(sec_us) AS bar_first_second_us, max(sec_us) AS bar_last_second_us FROM seconds GROUP BY 1
)
SELECT * REPLACE (CAST(session_date AS VARCHAR) AS session_date), raw_seconds = bar_rows AND raw_trades = bar_trades AND raw_volume = bar_volume AND raw_instruments = bar_instruments
  AND raw_first_second_us = bar_first_second_us AND raw_last_second_us = bar_last_second_us AS agrees FROM raw FULL JOIN layer USING (session_date)"""


def _breakdown() -> str:
    """A change is found in the trades: the first of the session whose instrument is not that of the trade before."""
    return f"""WITH {o.TICKS}, turned AS (
  SELECT session_date, instrument_id, min(ts_us) AS changed_at_us FROM ticks WHERE i <> instrument_id GROUP BY 1, 2
), summed AS (
  SELECT session_date, instrument_id, contract, count(DISTINCT sec_us) AS bar_rows, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume, min(ts_us) AS first_trade_us, max(ts_us) AS last_trade_us FROM ticks GROUP BY 1, 2, 3
)
SELECT summed.* REPLACE (CAST(summed.session_date AS VARCHAR) AS session_date), changed_at_us FROM summed LEFT JOIN turned USING (session_date, instrument_id)"""


def _totals() -> str:
    return f"""WITH {o.TICKS} SELECT count(DISTINCT session_date) AS sessions, count(DISTINCT (sec_us, instrument_id)) AS bar_rows, count(*) AS trades, CAST(sum(size) AS BIGINT) AS volume,
  count(*) FILTER (WHERE i <> instrument_id) AS contract_changes, min(ts_us) AS first_trade_us, max(ts_us) AS last_trade_us FROM ticks"""


def _sessions() -> str:
    found = " UNION ALL ".join(f"SELECT DISTINCT session_date, '{n}' AS layer FROM {n}" for n in ("seconds", "bars", "targets"))
    order = lambda a, b, n: f"(SELECT min({a}) AS a, lag(max({b})) OVER (ORDER BY session_date) AS before FROM {n} GROUP BY session_date)"
    parts = _rules("held", {f"{n}_sessions": f"list_contains(layers, '{n}')" for n in ("seconds", "bars", "targets")})
    parts += _rules(order("first_trade_timestamp_us", "last_trade_timestamp_us", "seconds"), {"seconds_session_order": "before IS NULL OR a > before"})
    parts += _rules(order("decision_us", "decision_us", "bars"), {"bars_session_order": "before IS NULL OR a > before"})
    return f"WITH {o._targets(True)}, held AS (SELECT session_date, list(layer) AS layers FROM ({found}) GROUP BY 1)\n{_all(parts)}"


def _bars() -> str:
    s = fx.TEN
    w = s.width * 1_000_000
    sums = {"price_volume_sum": "price * size", "price_squared_volume_sum": "price * price * size", **o._COUNTS}
    cols = ["price_volume_sum", "price_squared_volume_sum", "total_volume", "trade_count", "size_squared_sum", "uptick_count", "downtick_count", "same_price_count", *[n for n in o._COUNTS if n.startswith(("inferred", "native"))]]
    names = ["instrument_id", "contract", "open", "high", "low", "close", *cols, "max_trade_size", "active_second_count", "first_trade_timestamp", "last_trade_timestamp"]
    found = ", ".join(f"sum({sums[n]}) AS {n}" for n in cols if n != "trade_count")
    steps = o.bars(s.width) + f""", layer AS (SELECT *, first_trade_timestamp_us AS first_trade_timestamp, last_trade_timestamp_us AS last_trade_timestamp FROM bars), again AS (
  SELECT ts_us // {w} * {w} + {w} AS decision_us, session_date, max(instrument_id) AS instrument_id, max(contract) AS contract, first(price ORDER BY ts_event, seq) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts_event, seq) AS close, {found}, count(*) AS trade_count, max(size) AS max_trade_size, count(DISTINCT sec_us) AS active_second_count, min(ts_us) AS first_trade_timestamp, max(ts_us) AS last_trade_timestamp
  FROM ticks GROUP BY 1, 2
)"""
    return f"WITH {steps}\n" + _all(_compare("layer", "again", ["decision_us", "session_date"], {n: n != "contract" for n in names}, 1e-10))


def _targets(s, h: int, tolerance: int) -> str:
    """Paths as a join with a series of steps, references as an as-of join."""
    w = s.width
    columns = {"eligibility_reason": False, "start_us": True, "future_us": True, "start_reference_price": True, "future_reference_price": True, "start_reference_instrument_id": True,
               "future_reference_instrument_id": True, "forward_price_change": True, "forward_log_return": True, "target_up_15m": True}
    reference = lambda n, at: f"""{n} AS (
  SELECT b.session_date, b.t, s.first_trade_timestamp_us AS ts, s.open AS price, s.instrument_id AS id FROM (SELECT session_date, t, {at} AS at FROM b0) b
  ASOF JOIN (SELECT session_date, first_trade_timestamp_us, open, instrument_id FROM seconds QUALIFY row_number() OVER (PARTITION BY session_date, first_trade_timestamp_us ORDER BY instrument_id) = 1) s
    ON b.session_date = s.session_date AND s.first_trade_timestamp_us >= b.at WHERE s.first_trade_timestamp_us < b.at + {tolerance * 1000000})"""  # noqa: E731
    steps = o._targets(True, s, h, tolerance) + f""", layer AS (
  SELECT decision_us, session_date, eligibility_reason, start_ts AS start_us, future_ts AS future_us, start_price AS start_reference_price, future_price AS future_reference_price, start_id AS start_reference_instrument_id,
    future_id AS future_reference_instrument_id, CASE WHEN priced THEN future_price - start_price END AS forward_price_change, CASE WHEN priced THEN ln(future_price / start_price) END AS forward_log_return, label AS target_up_15m FROM targets
), ahead AS (SELECT session_date, t, instrument_id, unnest(range(0, {h + 1})) AS k FROM b0
), path AS (
  SELECT x.session_date, x.t, count(y.t) AS n, count(y.t) FILTER (WHERE k = {h}) AS ends, count(*) FILTER (WHERE y.instrument_id <> x.instrument_id) AS others
  FROM ahead x LEFT JOIN b0 y ON y.session_date = x.session_date AND y.t = x.t + k * {w} GROUP BY 1, 2
), {reference("ra", "decision_us")}, {reference("rb", "future_us")}, joined AS (
  SELECT b0.*, n, ends, others, ra.ts AS ts1, ra.price AS p1, ra.id AS i1, rb.ts AS ts2, rb.price AS p2, rb.id AS i2
  FROM b0 JOIN path USING (session_date, t) LEFT JOIN ra USING (session_date, t) LEFT JOIN rb USING (session_date, t)
), told AS (
  SELECT *, CASE WHEN ends = 0 THEN '{REASONS[0]}' WHEN others > 0 THEN '{REASONS[2]}' WHEN n < {h + 1} THEN '{REASONS[3]}' WHEN ts1 IS NULL THEN '{REASONS[4]}' WHEN i1 <> instrument_id THEN '{REASONS[5]}'
    WHEN ts2 IS NULL THEN '{REASONS[6]}' WHEN i2 <> instrument_id THEN '{REASONS[7]}' WHEN p1 = p2 THEN '{REASONS[8]}' ELSE '{REASONS[9]}' END AS eligibility_reason FROM joined
), again AS (
  SELECT decision_us, session_date, eligibility_reason, CASE WHEN ok THEN ts1 END AS start_us, CASE WHEN ok THEN ts2 END AS future_us, CASE WHEN ok THEN p1 END AS start_reference_price, CASE WHEN ok THEN p2 END AS future_reference_price,
    CASE WHEN ok THEN i1 END AS start_reference_instrument_id, CASE WHEN ok THEN i2 END AS future_reference_instrument_id, CASE WHEN fine THEN p2 - p1 END AS forward_price_change, CASE WHEN fine THEN ln(p2) - ln(p1) END AS forward_log_return,
    CASE WHEN eligibility_reason = '{REASONS[9]}' THEN CAST(p2 > p1 AS INTEGER) END AS target_up_15m
  FROM (SELECT *, eligibility_reason NOT IN ({", ".join(f"'{r}'" for r in REASONS[:4])}) AS ok, eligibility_reason IN ('{REASONS[8]}', '{REASONS[9]}') AS fine FROM told)
)"""
    return f"WITH {steps}\n" + _all(_compare("layer", "again", ["decision_us", "session_date"], columns, 1e-10))


def _features() -> str:
    s = fx.MINUTE
    w, k, most = s.width, s.recent, 60
    layer = o._returns(s) + o._path_columns(s)[:-1] + o._range_columns(s) + [o._acceleration_column(s)]
    layer = ", ".join(c.replace("round(", "(", 1).replace(", 9) + 0.0 AS", ") AS", 1) for c in layer)
    share = lambda f: f"CASE WHEN sum(total_volume) OVER {f} > 0 THEN sum(inferred_delta) OVER {f} / CAST(sum(total_volume) OVER {f} AS DOUBLE) END"
    layer += "".join(f", CASE WHEN {o._elapsed(s, h)} THEN {share(o._frame(s, -(h - 1)))} END AS delta_{h}m" for h in s.ranges)
    layer += f", inferred_delta / CAST(total_volume AS DOUBLE) - CASE WHEN {o._recent(s)} THEN {share(o._frame(s, -k, -1))} END AS delta_acceleration"
    steps = o._session_state(s)
    state = steps[len("WITH "): steps.rindex("\nSELECT")].removeprefix(o.prep(s)).lstrip(", ")
    columns = [f"return_{h}m" for h in s.returns] + [f"trend_efficiency_{h}m" for h in s.efficiencies] + [f"realized_volatility_{h}m" for h in s.volatilities]
    columns += [x for h in s.ranges for x in (f"range_{h}m", f"delta_{h}m")] + [f"activity_acceleration_{k}m", "delta_acceleration"]
    columns += ["session_vwap_distance", "session_high_distance", "session_low_distance", "session_range_position"]
    aggs = [f"count(*) FILTER (WHERE back <= {h} AND mine) AS path_{h}" for h in sorted({*s.returns, *s.efficiencies, *s.volatilities, s.scale})]
    aggs += [f"max(bclose) FILTER (WHERE back = {h}) AS close_{h}" for h in s.returns]
    aggs += [f"sum(step) FILTER (WHERE back < {h}) AS sum_{h}, sum(abs(step)) FILTER (WHERE back < {h}) AS travel_{h}, sum(step * step) FILTER (WHERE back < {h}) AS square_{h}" for h in sorted({*s.efficiencies, *s.volatilities, s.scale})]
    aggs += [f"max(bhigh) FILTER (WHERE back < {h}) AS high_{h}, min(blow) FILTER (WHERE back < {h}) AS low_{h}, count(*) FILTER (WHERE (back < {h} AND NOT mine) OR (back <= {h - 2} AND rolled)) AS others_{h}, "
             f"sum(bdelta) FILTER (WHERE back < {h}) AS d_{h}, sum(bvolume) FILTER (WHERE back < {h}) AS v_{h}" for h in s.ranges]  # fmt: skip
    aggs += [f"sum(bvolume) FILTER (WHERE back BETWEEN 1 AND {k}) AS recent, sum(bdelta) FILTER (WHERE back BETWEEN 1 AND {k}) AS recent_delta, count(*) FILTER (WHERE (back BETWEEN 1 AND {k} AND NOT mine) OR (back <= {k - 1} AND rolled)) AS recent_others"]
    whole = lambda h: f"path_{h} = {h + 1}"
    out = [f"CASE WHEN {whole(h)} THEN ln(close) - ln(close_{h}) END AS return_{h}m" for h in s.returns]
    out += [f"CASE WHEN {whole(h)} THEN CASE WHEN travel_{h} = 0 THEN 0.0 ELSE sum_{h} / travel_{h} END END AS trend_efficiency_{h}m" for h in s.efficiencies]
    out += [f"CASE WHEN {whole(h)} THEN sqrt(square_{h} / {h}) END AS realized_volatility_{h}m" for h in s.volatilities]
    for h in s.ranges:
        fine = f"{o._valid(f'decision_us - {h * w * 1000000}', 'decision_us')} AND others_{h} = 0"
        out += [f"CASE WHEN {fine} THEN ln(high_{h}) - ln(low_{h}) END AS range_{h}m", f"CASE WHEN {fine} THEN d_{h} / CAST(v_{h} AS DOUBLE) END AS delta_{h}m"]
    fine = f"{o._valid(f'decision_us - {(k + 1) * w * 1000000}', f'decision_us - {w * 1000000}')} AND recent_others = 0"
    out += [f"CASE WHEN {fine} THEN ln(1 + total_volume) - ln(1 + coalesce(recent, 0) / {float(k)}) END AS activity_acceleration_{k}m"]
    out += [f"CASE WHEN {fine} AND recent > 0 THEN inferred_delta / CAST(total_volume AS DOUBLE) - recent_delta / CAST(recent AS DOUBLE) END AS delta_acceleration"]
    distance = lambda x: f"CASE WHEN ok AND scale2 > 1e-12 THEN (ln(close) - ln({x})) / scale2 END"
    sql = f"""WITH {o.prep(s)}, {state}, layer AS (
  SELECT so_far.decision_us, session_date, {layer}, CASE WHEN ok THEN {o._distance("vwap")} END AS session_vwap_distance, CASE WHEN ok THEN {o._distance("hi")} END AS session_high_distance,
    CASE WHEN ok THEN {o._distance("lo")} END AS session_low_distance, CASE WHEN ok THEN CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / (hi - lo) END END AS session_range_position FROM so_far
), own AS (SELECT decision_us, session_date, t, open_us, close_us, instrument_id, high, low, close, total_volume, inferred_delta, price_volume_sum FROM p0
), rolls AS (
  SELECT a.session_date, a.t, coalesce(arg_max(b.instrument_id, b.t) <> any_value(a.instrument_id), FALSE) AS rolled FROM own a LEFT JOIN own b ON b.session_date = a.session_date AND b.t < a.t GROUP BY 1, 2
), steps AS (
  SELECT a.*, rolled, CASE WHEN b.instrument_id = a.instrument_id THEN ln(a.close) - ln(b.close) END AS step FROM own a JOIN rolls USING (session_date, t) LEFT JOIN own b ON b.session_date = a.session_date AND b.t = a.t - {w}
), met AS (
  SELECT a.session_date, a.t, (a.t - b.t) // {w} AS back, a.instrument_id = b.instrument_id AS mine, rolled, step, b.close AS bclose, b.high AS bhigh, b.low AS blow, b.inferred_delta AS bdelta, b.total_volume AS bvolume
  FROM own a JOIN steps b ON b.session_date = a.session_date AND b.t BETWEEN a.t - {most * w} AND a.t
), g AS (SELECT session_date, t, {", ".join(aggs)} FROM met GROUP BY 1, 2
), cuts AS (
  SELECT a.session_date, a.t, max(b.t) AS cut FROM own a JOIN own b ON b.session_date = a.session_date AND b.t <= a.t AND b.instrument_id <> a.instrument_id GROUP BY 1, 2
), since AS (
  SELECT a.session_date, a.t, sum(b.price_volume_sum) / sum(b.total_volume) AS vwap, max(b.high) AS hi, min(b.low) AS lo
  FROM own a LEFT JOIN cuts USING (session_date, t) JOIN own b ON b.session_date = a.session_date AND b.t <= a.t AND (cut IS NULL OR b.t > cut) GROUP BY 1, 2
), again AS (
  SELECT decision_us, session_date, {", ".join(out)}, {distance("vwap")} AS session_vwap_distance, {distance("hi")} AS session_high_distance, {distance("lo")} AS session_low_distance,
    CASE WHEN ok THEN CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / (hi - lo) END END AS session_range_position
  FROM (SELECT *, CASE WHEN {whole(s.scale)} THEN sqrt(square_{s.scale}) END AS scale2, ({o._us(fx.COVERAGE.start)} <= open_us AND coalesce(decision_us <= {o._first_gap()}, TRUE)) AS ok FROM own JOIN g USING (session_date, t) JOIN since USING (session_date, t))
)
""" + _all(_compare("layer", "again", ["decision_us", "session_date"], dict.fromkeys(columns, True), 1e-9))  # fmt: skip
    return sql.replace(o.TRADES, o.DENSE)


def _firewall() -> str:
    sample = o._development()
    sample = sample[: sample.index(", spans(fold")]
    parts = _rules("sample", {"sample_holdout": f"session_date < DATE '{HOLDOUT}'", "sample_label": "y IN (0, 1)", "sample_decision": "decision_us IS NOT NULL"})
    return f"WITH {sample}\n" + _all(parts + _once("sample_unique", "sample", "decision_us"))


def _development() -> str:
    parts = []
    for n, (a, b) in enumerate(fx.FOLDS, 1):
        inside = f"session_date BETWEEN DATE '{a}' AND DATE '{b}'"
        edge = f"(SELECT min(decision_us) FROM sample WHERE {inside})"
        want = f"(SELECT decision_us, CASE WHEN {inside} THEN 'validation' WHEN future_ts >= {edge} THEN 'purged' ELSE 'train' END AS part FROM sample WHERE session_date <= DATE '{b}')"
        parts += [x.replace("'part' AS", f"'fold_{n}_parts' AS") for x in _compare(f"(SELECT decision_us, part FROM dev WHERE fold = {n})", want, ["decision_us"], {"part": False}, 0)]
    m = fx.MOMENTUM
    steps = o._baselines() + f""", states AS (
  SELECT fold, coalesce(sign({m}), 0) AS state, sum(y) AS up, count(*) AS n FROM dev WHERE part = 'train' GROUP BY 1, 2
), base AS (SELECT fold, (sum(up) + 1) / (sum(n) + 2) AS p_base FROM states GROUP BY 1
), again AS (
  SELECT d.fold, d.decision_us, d.y, p_base, CASE WHEN coalesce(sign({m}), 0) = 0 THEN p_base ELSE coalesce((up + 1) / (n + 2), 0.5) END AS p_momentum
  FROM dev d JOIN base USING (fold) LEFT JOIN states s ON s.fold = d.fold AND s.state = coalesce(sign({m}), 0) WHERE part = 'validation'
), long AS ({" UNION ALL ".join(f"SELECT fold, '{c}' AS feature, {c} AS x FROM dev WHERE part = 'train'" for c in fx.MODEL_FEATURES)}
), med AS (SELECT fold, feature, median(x) AS median FROM long GROUP BY ALL
), mid AS (
  SELECT fold, feature, avg(x) AS median FROM (SELECT *, row_number() OVER (PARTITION BY fold, feature ORDER BY x) AS i, count(*) OVER (PARTITION BY fold, feature) AS n FROM long WHERE x IS NOT NULL) WHERE i IN ((n + 1) // 2, (n + 2) // 2) GROUP BY ALL
), paired AS (SELECT fold, 'baseline_0' AS model, p_base AS p, y FROM again UNION ALL SELECT fold, 'baseline_1', p_momentum, y FROM again
), pairs AS (
  SELECT a.fold, a.model, avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END) AS roc_auc FROM paired a JOIN paired b ON a.fold = b.fold AND a.model = b.model WHERE a.y = 1 AND b.y = 0 GROUP BY 1, 2
), direct AS (
  SELECT fold, model, avg(CASE WHEN y = 1 THEN -ln(p) ELSE -ln(1 - p) END) AS log_loss, avg((p - y) ** 2) AS brier_score, any_value(roc_auc) AS roc_auc, avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS accuracy
  FROM paired LEFT JOIN pairs USING (fold, model) GROUP BY 1, 2
), told AS (SELECT * FROM (WITH {o._metrics("fold, model", "scored")}))"""  # fmt: skip
    parts += _compare("predicted", "again", ["fold", "decision_us"], {"p_base": True, "p_momentum": True}, 1e-14)
    parts += _compare("med", "mid", ["fold", "feature"], {"median": True}, 1e-12)
    parts += _compare("told", "direct", ["fold", "model"], {"log_loss": True, "brier_score": True, "roc_auc": True, "accuracy": True}, 1e-8)
    return f"WITH {steps}\n" + _all(parts)


def _deltas() -> str:
    names = ["log_loss", "brier_score", "roc_auc", "accuracy"]
    return f"""WITH {o._baselines()}, told AS (SELECT * FROM (WITH {o._metrics("fold, model", "scored").replace("round(", "(").replace(", 9) AS", ") AS")}))
SELECT a.fold, a.model, {", ".join(f"round({'b' if n in ('log_loss', 'brier_score') else 'a'}.{n} - {'a' if n in ('log_loss', 'brier_score') else 'b'}.{n}, 9) + 0.0 AS {n}_improvement" for n in names)}
FROM told a JOIN told b ON a.fold = b.fold AND b.model = 'baseline_0' WHERE a.model <> 'baseline_0'"""


def _correlation() -> str:
    both = "inferred_delta <> 0 AND native_delta <> 0"
    return f"""WITH {o.SECONDS} SELECT CAST(session_date AS VARCHAR) AS session_date, count(*) AS seconds, count(*) FILTER (WHERE {both}) AS both_known,
  count(*) FILTER (WHERE {both} AND sign(inferred_delta) = sign(native_delta)) AS same_sign, CASE WHEN isfinite(corr(inferred_delta, native_delta)) THEN round(corr(inferred_delta, native_delta), 9) + 0.0 END AS correlation FROM seconds GROUP BY seconds.session_date"""


def _by_regime() -> str:
    w, tolerance = fx.HOUR.width * 1_000_000, fx.TOLERANCE * 1_000_000
    flags = ["asia", "europe", "us", "us_rth"]
    rows = " UNION ALL ".join(f"SELECT '{f}' AS regime, delay FROM flagged WHERE {f}_flag = 1" for f in flags)
    return f"""WITH {o.bars(fx.HOUR.width)}, flagged AS (
  SELECT b.decision_us, {o._regimes()}, min(s.first_trade_timestamp_us) - b.decision_us AS delay
  FROM bars b LEFT JOIN seconds s ON s.session_date = b.session_date AND s.first_trade_timestamp_us >= b.decision_us AND s.first_trade_timestamp_us < b.decision_us + {tolerance} AND s.sec_us < b.decision_us + {w} GROUP BY b.decision_us
), rows AS ({rows})
SELECT regime, count(*) AS bars, count(*) FILTER (WHERE delay < 1000000) AS exact, count(delay) AS within FROM rows GROUP BY 1"""


def _reconciliation() -> str:
    sample = o._development()
    sample = sample[: sample.index(", spans(fold")].replace("label AS y, future_ts FROM d0", "label AS y, future_ts, future_us FROM d0")
    taken = {"session_date": "session_date", "instrument_id": "instrument_id", "contract": "contract", "target_up_15m": "label", "future_boundary_timestamp": "future_us", "future_reference_timestamp": "future_ts"}
    mine = {"label": "y"}
    both = "(SELECT l.decision_us AS l, s.decision_us AS s, " + ", ".join(f"l.{c} AS l_{c}, s.{mine.get(c, c)} AS s_{c}" for c in taken.values())
    both += f" FROM (SELECT * FROM targets WHERE target_eligible AND session_date < DATE '{HOLDOUT}') l FULL JOIN sample s ON l.decision_us = s.decision_us)"
    parts = _once("feature_keys", "bars", "decision_us") + _once("label_keys", "targets", "decision_us") + _once("sample_keys", "sample", "decision_us")
    parts += _rules(both, {"labels_met": "s IS NOT NULL", "rows_with_label": "l IS NOT NULL"} | {f"label_{n}": f"l_{c} IS NOT DISTINCT FROM s_{c}" for n, c in taken.items()})
    parts += _rules(f"(SELECT f.decision_us AS f FROM sample s LEFT JOIN (SELECT decision_us FROM bars WHERE session_date < DATE '{HOLDOUT}') f ON f.decision_us = s.decision_us)", {"rows_with_features": "f IS NOT NULL"})
    parts += _rules("sample", {"sample_holdout": f"session_date < DATE '{HOLDOUT}'", "sample_label": "y IN (0, 1)", "sample_decision": "decision_us IS NOT NULL"})
    return f"WITH {sample}\n" + _all(parts + _once("sample_unique", "sample", "decision_us"))


def _order() -> str:
    rule = lambda key: f"(SELECT ts_event, lag(ts_event) OVER (ORDER BY {key}) AS before FROM trades)"
    parts = _rules(rule("seq"), {"tape_order": "before IS NULL OR ts_event >= before"}) + _rules(rule("-seq"), {"reversed_order": "before IS NULL OR ts_event >= before"})
    return f"WITH {o.TRADES}\n" + _all(parts)


def _midday() -> str:
    """The report of folds with the decision's day, changing at noon, for the session."""
    day = "CAST(make_timestamp(decision_us + 43200000000) AS DATE)"
    own = o.SQL["dev_folds"].replace("session_date >= a AS v", f"{day} >= a AS v").replace("ON session_date <= b", f"ON {day} <= b")
    return own.replace("THEN session_date END", f"THEN {day} END")


def _context() -> str:
    """How many values each feature has; none differs."""
    of = {
        "minute_activity": ["minutes_since_cme_open", "time_of_day_sin", "time_of_day_cos", "asia_flag", "europe_flag", "us_flag", "us_rth_flag", "log_volume_1m", "log_trade_count_1m",
                            "log_average_trade_size_1m", "trade_size_dispersion_1m", "log_max_trade_size_1m", "active_second_fraction_1m"],
        "minute_baseline": ["relative_volume_q", "relative_trade_count_q"], "minute_opening": ["us_opening_range_position"],
        "minute_prior": [f"prior_session_{x}_distance" for x in ("high", "low", "close")],
    }
    return " UNION ALL ".join(f"SELECT '{c}' AS \"check\", count({c}) AS rows, 0::BIGINT AS violations FROM ({o.SQL[q]})" for q, columns in of.items() for c in columns)


def _version_report() -> str:
    names = [c.split()[0] + ("_us" if "TIMESTAMP" in c else "") for c in TARGETS.split(", ")]
    fields = [c for c in names if c not in ("decision_timestamp_us", "session_date") and not c.endswith("reference_instrument_id")]
    known = f"coalesce(n.eligibility_reason IN ({', '.join(repr(x) for x in NEW_REASONS)}), FALSE)"
    parts = ["SELECT 'row' AS field, count(*) FILTER (WHERE one) AS changed, count(*) FILTER (WHERE one) AS unexpected FROM j"]
    for c in fields:
        name = c.removesuffix("_us")
        fine = "known" if name in ALLOWED else "FALSE"
        parts.append(f"SELECT '{name}', count(*) FILTER (WHERE NOT one AND d_{c}), count(*) FILTER (WHERE NOT one AND d_{c} AND NOT {fine}) FROM j")
    differs = ", ".join(f"o.{c} IS DISTINCT FROM n.{c} AS d_{c}" for c in fields)
    return f"""WITH o AS ({o.SQL["forward_targets_v1"]}), n AS ({o.SQL["forward_targets_v2"]}), j AS (
  SELECT o.decision_timestamp_us IS NULL OR n.decision_timestamp_us IS NULL AS one, {known} AS known, {differs}
  FROM o FULL JOIN n ON o.decision_timestamp_us = n.decision_timestamp_us AND o.session_date = n.session_date
) """ + " UNION ALL ".join(parts)


SQL = {
    "tape_order": _order(), "sample_reconciliation": _reconciliation(),
    "layer_checks": _layer_checks(), "dataset_audit": _dataset_audit(), "session_breakdown": _breakdown(), "run_totals": _totals(), "layer_sessions": _sessions(), "bars_recount": _bars(),
    "targets_recount": _targets(fx.HOUR, fx.HORIZON, fx.TOLERANCE), "minute_targets_recount": _targets(fx.MINUTE, 15, 10).replace(o.TRADES, o.DENSE), "minute_features_recount": _features(), "minute_context_recount": _context(), "target_version_report": _version_report(), "midday_folds": _midday(),
    "dev_firewall": _firewall(), "dev_recount": _development(), "metric_deltas": _deltas(), "flow_correlation": _correlation(), "first_second_by_regime": _by_regime(),
}
