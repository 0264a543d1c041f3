"""Cross-sectional ranks, positions, turnover, portfolio returns and selection by sweep.

A panel is a long table (keys..., date, entity, pred, actual). Only the extreme
``top_n`` names of a date ever leave the first ranking step, so everything
after it is small and independent of the number of entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barweave.functions.maths import as_col, at_least

SALTS = 16
BPS_GRID = [0.0, 5.0, 10.0, 20.0, 50.0]
TOP_N_GRID = [3, 5, 7, 10, 15]


def cross_section_rank(panel: DataFrame, keys: list[str], n_max: int, signal: str = "pred", entity: str = "entity",
                       date: str = "date", salts: int = SALTS, keep_dates: bool = False) -> DataFrame:
    """The ``n_max`` lowest and highest signals per (keys, date) with ``rank_low``, ``rank_high``, ``n_valid``.

    Two steps: extremes and counts inside hash salts of the entity, then the same on the survivors.
    A date holding most of the rows is spread over ``salts`` tasks (raise it with the universe: each
    task should see many times ``n_max`` names); ties go to (signal, entity).
    ``keep_dates`` also keeps one row of a date without any known signal.
    """
    group = [*keys, date]
    value = F.col(signal)
    up, down = [value.asc_nulls_last(), F.col(entity).asc()], [value.desc_nulls_last(), F.col(entity).desc()]
    salted = panel if keep_dates else panel.where(value.isNotNull())
    salted = salted.withColumn("_salt", F.pmod(F.hash(entity), F.lit(salts)))
    local = Window.partitionBy(*group, "_salt")
    near = salted.withColumns({
        "_lo": F.row_number().over(local.orderBy(*up)), "_hi": F.row_number().over(local.orderBy(*down)),
        "_n": F.count(signal).over(local)})
    near = near.where((F.col("_lo") <= n_max) | (value.isNotNull() & (F.col("_hi") <= n_max)))
    whole = Window.partitionBy(*group)
    ranked = near.withColumns({
        "rank_low": F.row_number().over(whole.orderBy(*up)), "rank_high": F.row_number().over(whole.orderBy(*down)),
        "n_valid": F.sum(F.when(F.col("_lo") == 1, F.col("_n"))).over(whole)})
    # Names dropped in the first step shift only ranks beyond n_max; those follow from the other end.
    low, high, mirror = F.col("rank_low"), F.col("rank_high"), F.col("n_valid") + 1
    extreme = value.isNotNull() & ((low <= n_max) | (high <= n_max))
    kept = ranked.where(extreme | (low == 1) if keep_dates else extreme)
    return kept.withColumns({
        "rank_low": F.when((low <= n_max) | value.isNull(), low).otherwise(mirror - high),
        "rank_high": F.when((high <= n_max) | value.isNull(), high).otherwise(mirror - low),
    }).drop("_salt", "_lo", "_hi", "_n")


#: Which end of the ranking a book holds, and with which sign.
LONG, SHORT = ("rank_high", 1.0), ("rank_low", -1.0)
MODES = {"long_short": [LONG, SHORT], "long_only": [LONG], "short_only": [SHORT]}


def legs(panel: DataFrame, keys: list[str], top_n: list[int] | str, mode: str, signal: str, entity: str, date: str,
         n_max: int | None = None, with_rows: bool = False, salts: int = SALTS) -> DataFrame:
    """One row per held name: ``side`` (+1/-1) for every requested book size the date can fill.

    ``with_rows`` adds the panel row number and, once per date and size, a marker with side 0.
    """
    listed = not isinstance(top_n, str)
    n_max = max(top_n) if listed else n_max
    ranked = cross_section_rank(panel, keys, n_max, signal, entity, date, salts, with_rows)
    if with_rows:
        by_date = Window.partitionBy(*keys).orderBy(date)
        ranked = ranked.withColumn("row_idx", F.dense_rank().over(by_date) - 1)
    ranked = ranked.withColumn("top_n", F.explode(F.array(*[F.lit(n) for n in top_n]))) if listed else \
        ranked.withColumn("top_n", F.col(top_n))
    filled = (F.col("n_valid") >= 2 * F.col("top_n")) & F.col(signal).isNotNull()
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode!r}")
    sides = [F.when(filled & (F.col(rank) <= F.col("top_n")), F.lit(side)) for rank, side in MODES[mode]]
    if with_rows:
        sides.append(F.when(F.col("rank_low") == 1, F.lit(0.0)))
    return ranked.withColumn("side", F.explode(F.array_compact(F.array(*sides)))).drop("rank_low", "rank_high")


def positions(panel: DataFrame, keys: list[str], top_n: list[int] | str = TOP_N_GRID, mode: str = "long_short",
              weighting: str = "equal", signal: str = "pred", min_abs: float | None = None, vol: str = "vol",
              sigma: str = "sigma", gate: str = "gate", gate_min: float = 0.0, alpha: float = 5.0,
              n_max: int | None = None, entity: str = "entity", date: str = "date", with_rows: bool = False,
              salts: int = SALTS) -> DataFrame:
    """Sparse non-flat weights per (keys, top_n, date, entity).

    ``weighting``: 'equal', 'inv_vol' (1/max(vol, 1e-6), leg sums to 1) or 'risk_aware'
    (rank by mu/sigma, size |tanh(alpha·mu/sigma)|·gate, leg sums to 1 or stays flat).
    """
    score = F.col(signal)
    if weighting == "risk_aware":
        score = F.when(F.col(gate) >= gate_min, F.col(signal) / at_least(sigma, 1e-3))
    if min_abs is not None:
        score = F.when(F.abs(F.col(signal)) > min_abs, score)
    held = legs(panel.withColumn("_score", score), keys, top_n, mode, "_score", entity, date, n_max, with_rows, salts)
    if weighting == "equal":
        return held.withColumn("weight", F.col("side") / F.col("top_n")).drop("_score")
    raw = {"inv_vol": lambda: 1.0 / at_least(vol, 1e-6),
           "risk_aware": lambda: F.abs(F.tanh(alpha * F.col("_score"))) * F.col(gate)}[weighting]()
    leg = Window.partitionBy(*keys, "top_n", date, "side")
    sized = held.withColumn("_raw", raw).withColumn("_sum", F.sum("_raw").over(leg))
    kept = sized.where((F.col("_sum") > 1e-9) | (F.col("side") == 0))
    return kept.withColumn("weight", F.when(F.col("side") == 0, 0.0).otherwise(
        F.col("side") * F.col("_raw") / F.col("_sum"))).drop("_raw", "_sum", "_score")


def panel_rows(panel: DataFrame, keys: list[str], date: str = "date") -> DataFrame:
    """0-based row number of every panel date per cell, dates without positions included."""
    w = Window.partitionBy(*keys).orderBy(date)
    return panel.select(*keys, date).distinct().withColumn("row_idx", F.row_number().over(w) - 1)


def trade_rows(placed: DataFrame, keys: list[str], entity: str = "entity", basis: int | Column = 1) -> DataFrame:
    """Per (keys, top_n, row): turnover against the row ``basis`` before, gross return, number of names held.

    Every weight is booked with + on its own row and with - on the later row; entries of the same name
    net out in one aggregation, which needs no self-join.
    """
    cell = [*keys, "top_n"]
    marker = F.col("side") == 0
    now = F.struct(F.col("row_idx").alias("row_idx"), F.col("weight").alias("dw"),
                   F.coalesce(F.col("weight") * F.col("actual"), F.lit(0.0)).alias("pnl"),
                   F.when(F.col("weight") != 0, 1).otherwise(0).alias("held"), F.when(marker, F.col("date")).alias("date"))
    later = F.when(~marker, F.struct(
        (F.col("row_idx") + basis).alias("row_idx"), (-F.col("weight")).alias("dw"), F.lit(0.0).alias("pnl"),
        F.lit(0).alias("held"), F.lit(None).cast("date").alias("date")))
    booked = placed.select(*cell, entity, F.explode(F.array_compact(F.array(now, later))).alias("_b")).select(*cell, entity, "_b.*")
    netted = booked.groupBy(*cell, "row_idx", entity).agg(
        F.sum("dw").alias("dw"), F.sum("pnl").alias("pnl"), F.sum("held").alias("held"), F.max("date").alias("date"))
    return netted.groupBy(*cell, "row_idx").agg(
        F.sum(F.abs("dw")).alias("turnover"), F.sum("pnl").alias("gross"), F.sum("held").alias("n_held"), F.max("date").alias("date"))


def turnover(pos: DataFrame, rows: DataFrame, keys: list[str], basis: int | Column = 1) -> DataFrame:
    """Sum of |w_t - w_(t-1)| per panel row; rows that only unwind count."""
    traded = trade_rows(pos.join(rows, [*keys, "date"]), keys, basis=basis).drop("date")
    return rows.join(traded, [*keys, "row_idx"]).select(*keys, "top_n", "date", "row_idx", "turnover")


def with_costs(traded: DataFrame, keys: list[str], bps: list[float], charge_unwind: bool) -> DataFrame:
    active = F.coalesce(F.col("n_held"), F.lit(0)) > 0
    moved = F.coalesce(F.col("turnover"), F.lit(0.0))
    live = (active | (moved > 0)) if charge_unwind else active
    out = traded.withColumns({
        "n_held": F.coalesce(F.col("n_held"), F.lit(0)), "turnover": F.when(live, moved).otherwise(0.0),
        "gross": F.when(live, F.coalesce(F.col("gross"), F.lit(0.0)))})
    costs = F.explode(F.array(*[F.lit(float(b)) for b in bps]))
    return out.withColumn("cost_bps", costs).withColumn(
        "net", F.col("gross") - F.col("cost_bps") / 10000.0 * F.col("turnover")
    ).select(*keys, "top_n", "date", "row_idx", "n_held", "gross", "turnover", "cost_bps", "net")


def portfolio_returns(pos: DataFrame, rows: DataFrame, keys: list[str], sizes: list[int], bps: list[float] = [20.0],
                      charge_unwind: bool = True, basis: int | Column = 1) -> DataFrame:
    """Gross and net return, turnover per (keys, top_n, row, cost) from given positions.

    Rows with neither position nor trade have NULL returns. ``charge_unwind=False`` is the older rule:
    any row without a position is NULL with zero turnover. ``basis`` sets how many rows back the
    turnover looks (1: the day before; the horizon, a number or a column of ``keys``: the previous rebalance).
    """
    grid = rows.withColumn("top_n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    traded = trade_rows(pos.join(rows, [*keys, "date"]), keys, basis=basis).drop("date")
    return with_costs(grid.join(traded, [*keys, "top_n", "row_idx"], "left"), keys, bps, charge_unwind)


def backtest(panel: DataFrame, keys: list[str], sizes: list[int] = TOP_N_GRID, mode: str = "long_short",
             bps: list[float] = [20.0], charge_unwind: bool = True, basis: int | Column = 1, **weights) -> DataFrame:
    """``positions`` and ``portfolio_returns`` in one pass over the panel.

    The ranking step keeps a marker per date, so row numbers, idle rows and books of all sizes come from
    the same ranked rows; the panel is read once and nothing is joined back to it.
    """
    pos = positions(panel, keys, sizes, mode, with_rows=True, **weights)
    return with_costs(trade_rows(pos, keys, basis=basis).where(F.col("date").isNotNull()), keys, bps, charge_unwind)


def non_overlap(ts: DataFrame, horizon: str | int = "horizon", row: str = "row_idx") -> DataFrame:
    """Every H-th panel row starting at row 0; idle rows keep their place in the count."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    return ts.where(F.col(row) % h == 0)


def select_topn(sweep: DataFrame, keys: list[str], grid: list[int], sharpe: str = "sharpe") -> DataFrame:
    """Book size with the best Sharpe; the earlier grid entry wins ties, the middle one when none is known."""
    index = F.array_position(F.array(*[F.lit(n) for n in grid]), F.col("top_n"))
    best = F.max_by("top_n", F.when(F.col(sharpe).isNotNull(), F.struct(F.col(sharpe), -index)))
    return sweep.groupBy(*keys).agg(F.coalesce(best, F.lit(grid[len(grid) // 2])).alias("top_n"))


def vol_gate(ts: DataFrame, held_vol_z: DataFrame, keys: list[str], k: float = 2.0, ret: str = "gross") -> DataFrame:
    """Return 0 on rows where the mean volatility z-score of the held names exceeds ``k``."""
    mean = held_vol_z.groupBy(*keys, "date").agg(F.avg("vol_z").alias("port_z"))
    killed = F.coalesce(F.col("port_z") > k, F.lit(False))
    return ts.join(mean, [*keys, "date"], "left").withColumns({
        "killed": killed, f"{ret}_gated": F.when(killed, 0.0).otherwise(F.col(ret))})
