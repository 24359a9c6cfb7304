"""Fixed layer schemas, in order."""

# fixed values: names, order and types of the layers
SECOND_BARS = (
    "timestamp_second TIMESTAMP, session_date DATE, instrument_id BIGINT, contract STRING, open DOUBLE, high DOUBLE, "
    "low DOUBLE, close DOUBLE, price_volume_sum DOUBLE, price_squared_volume_sum DOUBLE, total_volume BIGINT, "
    "trade_count BIGINT, max_trade_size BIGINT, size_squared_sum BIGINT, uptick_count BIGINT, downtick_count BIGINT, "
    "same_price_count BIGINT, unique_price_levels BIGINT, inferred_buy_volume BIGINT, inferred_sell_volume BIGINT, "
    "inferred_unknown_volume BIGINT, inferred_buy_trade_count BIGINT, inferred_sell_trade_count BIGINT, "
    "inferred_unknown_trade_count BIGINT, inferred_delta BIGINT, native_buy_volume BIGINT, native_sell_volume BIGINT, "
    "native_unknown_volume BIGINT, native_delta BIGINT, first_trade_timestamp TIMESTAMP, last_trade_timestamp TIMESTAMP, "
    "max_volume_at_price BIGINT, contract_change BOOLEAN"
)
BARS = (
    "decision_timestamp TIMESTAMP, minute_start TIMESTAMP, session_date DATE, instrument_id BIGINT, contract STRING, "
    "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, price_volume_sum DOUBLE, price_squared_volume_sum DOUBLE, "
    "total_volume BIGINT, trade_count BIGINT, max_trade_size BIGINT, size_squared_sum BIGINT, active_second_count BIGINT, "
    "uptick_count BIGINT, downtick_count BIGINT, same_price_count BIGINT, inferred_buy_volume BIGINT, "
    "inferred_sell_volume BIGINT, inferred_unknown_volume BIGINT, inferred_buy_trade_count BIGINT, "
    "inferred_sell_trade_count BIGINT, inferred_unknown_trade_count BIGINT, inferred_delta BIGINT, "
    "native_buy_volume BIGINT, native_sell_volume BIGINT, native_unknown_volume BIGINT, native_delta BIGINT, "
    "first_trade_timestamp TIMESTAMP, last_trade_timestamp TIMESTAMP, contract_change BOOLEAN"
)
TARGETS = (
    "decision_timestamp TIMESTAMP, session_date DATE, instrument_id BIGINT, contract STRING, "
    "start_reference_timestamp TIMESTAMP, start_reference_delay_seconds DOUBLE, start_reference_price DOUBLE, "
    "start_reference_instrument_id BIGINT, future_boundary_timestamp TIMESTAMP, future_reference_timestamp TIMESTAMP, "
    "future_reference_delay_seconds DOUBLE, future_reference_price DOUBLE, future_reference_instrument_id BIGINT, "
    "forward_price_change DOUBLE, forward_log_return DOUBLE, target_up_15m TINYINT, target_eligible BOOLEAN, "
    "eligibility_reason STRING"
)
# fixed values: the predictors, in the order of their contract
PREDICTORS = [
    "return_1m", "return_5m", "return_15m", "return_30m", "return_60m", "range_5m", "range_15m", "trend_efficiency_5m", "trend_efficiency_15m",
    "realized_volatility_15m", "realized_volatility_60m", "volatility_ratio_15m_60m", "log_volume_1m", "log_trade_count_1m",
    "log_average_trade_size_1m", "trade_size_dispersion_1m", "log_max_trade_size_1m", "active_second_fraction_1m", "relative_volume_q",
    "relative_trade_count_q", "activity_acceleration_5m", "session_vwap_distance", "session_range_position", "session_high_distance",
    "session_low_distance", "prior_session_high_distance", "prior_session_low_distance", "prior_session_close_distance",
    "us_opening_range_position", "time_of_day_sin", "time_of_day_cos", "minutes_since_cme_open", "asia_flag", "europe_flag", "us_flag",
    "us_rth_flag",
]
_SHORT = {"minutes_since_cme_open": "INT", **dict.fromkeys(["asia_flag", "europe_flag", "us_flag", "us_rth_flag"], "SMALLINT")}
_KEYS = "decision_timestamp TIMESTAMP, session_date DATE, instrument_id BIGINT, contract STRING, "
FEATURES = _KEYS + ", ".join(f"{p} {_SHORT.get(p, 'DOUBLE')}" for p in PREDICTORS)
SAMPLE = FEATURES + ", target_up_15m TINYINT, future_boundary_timestamp TIMESTAMP, future_reference_timestamp TIMESTAMP"
PREDICTIONS = _KEYS + "fold INT, model STRING, p DOUBLE, target_up_15m TINYINT"
IDENTITY = ["decision_timestamp", "session_date", "instrument_id", "contract"]
SUMS = [
    "price_volume_sum", "price_squared_volume_sum", "total_volume", "trade_count", "size_squared_sum", "uptick_count",
    "downtick_count", "same_price_count", "inferred_buy_volume", "inferred_sell_volume", "inferred_unknown_volume",
    "inferred_buy_trade_count", "inferred_sell_trade_count", "inferred_unknown_trade_count", "inferred_delta",
    "native_buy_volume", "native_sell_volume", "native_unknown_volume", "native_delta",
]
