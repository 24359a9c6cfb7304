"""Forward labels: a structural check of the path ahead, and a forward as-of lookup with a tolerance for both ends.

The lookup is an equi-join: boundaries are whole bar widths, the tolerance is at most one width, so the first trade at or
after a boundary and within the tolerance is the first one of its bar that is early enough. No range join is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TARGETS
from ..sources.layers import enforce
from .bars import floor_to

# fixed values: reasons in order of priority
REASONS = [
    "NO_FUTURE_BOUNDARY", "CROSSES_SESSION_BOUNDARY", "CROSSES_CONTRACT_ROLL", "CROSSES_INTERNAL_GAP",
    "NO_START_REFERENCE_WITHIN_10S", "START_REFERENCE_CONTRACT_MISMATCH", "NO_FUTURE_REFERENCE_WITHIN_10S",
    "FUTURE_REFERENCE_CONTRACT_MISMATCH", "EQUAL_REFERENCE_PRICE", "ELIGIBLE",
]


def first_references(seconds: DataFrame, width: int, tolerance: int) -> DataFrame:
    """(session_date, boundary, reference): the first trade of each boundary of ``width`` seconds that comes less than
    ``tolerance`` seconds after it."""
    if tolerance > width:
        raise ValueError("the tolerance is wider than a bar")
    boundary = floor_to(F.col("timestamp_second"), width)
    early = (F.unix_seconds("timestamp_second") - F.unix_seconds(boundary)) < tolerance
    trade = F.struct(F.col("first_trade_timestamp").alias("ts"), F.col("open").alias("price"), F.col("instrument_id").alias("id"))
    return seconds.where(early).groupBy("session_date", boundary.alias("boundary")).agg(
        F.min_by(trade, F.struct("first_trade_timestamp", "instrument_id")).alias("reference")
    )


def forward_targets(
    bars: DataFrame, seconds: DataFrame, width: int = 60, horizon: int = 15, tolerance: int = 10, contract_safe: bool = True,
    path_keys: tuple[str, ...] = ("session_date",),
) -> DataFrame:
    """One row for each bar: references, outcome, and the first reason of REASONS that holds.

    horizon is in bars. Without ``contract_safe`` the references' instruments are not compared (the older rule).
    path_keys says within which rows a path is looked up: a session, as bars are stored by session."""
    t = F.unix_seconds("decision_timestamp")
    df = bars.select("decision_timestamp", "session_date", "instrument_id", "contract", *[k for k in path_keys if k != "session_date"], t.alias("_t"))
    ahead = Window.partitionBy(*path_keys).orderBy("_t").rangeBetween(0, horizon * width)
    df = df.withColumns({
        "_end": F.max("_t").over(ahead), "_n": F.count("*").over(ahead), "_low": F.min("instrument_id").over(ahead),
        "_high": F.max("instrument_id").over(ahead), "_s1": F.min("session_date").over(ahead), "_s2": F.max("session_date").over(ahead),
    })
    structure = (
        F.when(F.col("_end") != F.col("_t") + horizon * width, REASONS[0])
        .when((F.col("_s1") != F.col("session_date")) | (F.col("_s2") != F.col("session_date")), REASONS[1])
        .when((F.col("_low") != F.col("instrument_id")) | (F.col("_high") != F.col("instrument_id")), REASONS[2])
        .when(F.col("_n") != horizon + 1, REASONS[3])
    )
    future = F.timestamp_micros(F.unix_micros("decision_timestamp") + horizon * width * 1_000_000)
    df = df.withColumns({"_structure": structure, "future_boundary_timestamp": future})
    found = first_references(seconds, width, tolerance)
    for name, at in (("start", "decision_timestamp"), ("future", "future_boundary_timestamp")):
        side = found.select("session_date", F.col("boundary").alias(at), F.col("reference").alias(f"_{name}"))
        df = df.join(side, ["session_date", at], "left")
        df = df.withColumn(f"_{name}", F.when(F.col("_structure").isNull(), F.col(f"_{name}")))
    a, b, own = F.col("_start"), F.col("_future"), F.col("instrument_id")
    reason = F.when(F.col("_structure").isNotNull(), F.col("_structure")).when(a.isNull(), REASONS[4])
    if contract_safe:
        reason = reason.when(a.id != own, REASONS[5])
    reason = reason.when(b.isNull(), REASONS[6])
    if contract_safe:
        reason = reason.when(b.id != own, REASONS[7])
    reason = reason.when(a.price == b.price, REASONS[8]).otherwise(REASONS[9])
    df = df.withColumn("eligibility_reason", reason)
    priced = F.col("eligibility_reason").isin(REASONS[8:])
    eligible = F.col("eligibility_reason") == REASONS[9]

    def delay(x: Column, at: str) -> Column:
        return (F.unix_micros(x.ts) - F.unix_micros(at)) / F.lit(1e6)

    out = df.withColumns({
        "start_reference_timestamp": a.ts, "start_reference_delay_seconds": delay(a, "decision_timestamp"),
        "start_reference_price": a.price, "start_reference_instrument_id": a.id,
        "future_reference_timestamp": b.ts, "future_reference_delay_seconds": delay(b, "future_boundary_timestamp"),
        "future_reference_price": b.price, "future_reference_instrument_id": b.id,
        "forward_price_change": F.when(priced, b.price - a.price), "forward_log_return": F.when(priced, F.ln(b.price / a.price)),
        "target_up_15m": F.when(eligible, (b.price > a.price).cast("tinyint")), "target_eligible": eligible,
    })
    return enforce(out.select(*[c.split()[0] for c in TARGETS.split(", ")]), TARGETS)


def funnel(targets: DataFrame) -> DataFrame:
    """One row a session of staged counts and delays."""
    at = lambda i: F.col("eligibility_reason").isin(REASONS[i:])
    return targets.groupBy("session_date").agg(
        F.count("*").alias("candidates"), F.count_if(at(4)).alias("structurally_valid"), F.count_if(at(8)).alias("reference_pairs"),
        F.count_if(F.col("eligibility_reason") == REASONS[8]).alias("equal_price"), F.count_if("target_eligible").alias("eligible"),
        F.count_if(F.col("target_up_15m") == 1).alias("up"), F.count_if(F.col("target_up_15m") == 0).alias("down"),
        F.percentile("start_reference_delay_seconds", F.lit(0.5)).alias("median_start_delay"), F.max("start_reference_delay_seconds").alias("longest_start_delay"),
        F.min(F.when(F.col("target_eligible"), F.col("decision_timestamp"))).alias("first_eligible"),
        F.max(F.when(F.col("target_eligible"), F.col("decision_timestamp"))).alias("last_eligible"),
    )


def reason_counts(targets: DataFrame) -> DataFrame:
    return targets.groupBy("eligibility_reason").agg(F.count("*").alias("rows"))


def version_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows whose reason or label differ between two versions, or that only one has, compared null-safely."""
    key = ["decision_timestamp", "session_date"]
    pick = lambda df, p: df.select(*key, F.col("eligibility_reason").alias(f"{p}_reason"), F.col("target_up_15m").alias(f"{p}_label"))
    both = pick(old, "old").join(pick(new, "new"), key, "full")
    same = F.col("old_reason").eqNullSafe(F.col("new_reason")) & F.col("old_label").eqNullSafe(F.col("new_label"))
    return both.where(~same)


#: What a second version of the labels may change, and only where it gives a reason that the first did not know.
ALLOWED = (
    "future_reference_timestamp", "future_reference_delay_seconds", "future_reference_price", "start_reference_timestamp", "start_reference_delay_seconds",
    "start_reference_price", "forward_price_change", "forward_log_return", "target_up_15m", "target_eligible", "eligibility_reason",
)
NEW_REASONS = (REASONS[5], REASONS[7])


def version_report(old: DataFrame, new: DataFrame, allowed: tuple[str, ...] = ALLOWED, reasons: tuple[str, ...] = NEW_REASONS) -> DataFrame:
    """(field, changed, unexpected) for each column that both versions have, and ``row``: rows that only one version has.
    A change is unexpected in a field that is not ``allowed``, and in a row whose new reason is not one of ``reasons``."""
    key = ["decision_timestamp", "session_date"]
    fields = [c for c in old.columns if c in new.columns and c not in key and not c.endswith("reference_instrument_id")]
    both = old.select(*key, F.lit(1).alias("_o"), *[F.col(c).alias(f"o_{c}") for c in fields]).join(new.select(*key, F.lit(1).alias("_n"), *fields), key, "full")
    one = F.col("_o").isNull() | F.col("_n").isNull()
    known = F.coalesce(F.col("eligibility_reason").isin(*reasons), F.lit(False))
    parts = [F.struct(F.lit("row").alias("field"), one.alias("changed"), one.alias("unexpected"))]
    for c in fields:
        differs = ~one & ~F.col(c).eqNullSafe(F.col(f"o_{c}"))
        parts.append(F.struct(F.lit(c).alias("field"), differs.alias("changed"), (differs & (~known if c in allowed else F.lit(True))).alias("unexpected")))
    flat = both.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return flat.groupBy("field").agg(F.count_if("changed").alias("changed"), F.count_if("unexpected").alias("unexpected"))
