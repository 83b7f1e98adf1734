"""Summaries of event paths: excursions, first passage, the bracket surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causalbars.operators.targets import LEVELS, PATH_HORIZONS

# The grid of the surface, the asymmetric barrier pairs (target, stop) and its horizons.
EXPIRIES = (15, 30, 60, 120)
ASYMMETRIC = ((1.0, 0.5), (2.0, 1.0), (0.5, 1.0), (1.0, 2.0))
TARGET, STOP, EXPIRED, AMBIGUOUS = 1, 2, 0, 3


def logs(p: DataFrame, h: int) -> tuple[Column, Column]:
    """Favourable and adverse extremes of horizon h in the log of the price, in the event's direction."""
    long, p0 = F.col("direction") > 0, F.col("p0")
    m, a = F.col(f"mfe_{h}"), F.col(f"mae_{h}")
    return F.when(long, F.ln((p0 + m) / p0)).otherwise(-F.ln((p0 - m) / p0)), F.when(long, F.ln((p0 + a) / p0)).otherwise(-F.ln((p0 - a) / p0))


def outcome(t_target: Column, t_stop: Column, expiry: Column) -> Column:
    """Which barrier is touched first within ``expiry`` bars; both in one bar is ambiguous."""
    far = F.lit(1 << 30)
    a, b = F.coalesce(t_target, far), F.coalesce(t_stop, far)
    return F.when(F.least(a, b) > expiry, EXPIRED).when(a < b, TARGET).when(b < a, STOP).otherwise(AMBIGUOUS)


def _long(p: DataFrame, by: list[str]) -> DataFrame:
    rows = []
    for h in PATH_HORIZONS:
        f, a = logs(p, h)
        rows.append(
            F.struct(
                F.lit(h).alias("h"), F.col(f"elig_{h}").alias("elig"), F.col(f"close_{h}").alias("close"), F.col(f"mfe_{h}").alias("mfe"), F.col(f"mae_{h}").alias("mae"),
                F.col(f"t_mfe_{h}").alias("t_mfe"), F.col(f"t_mae_{h}").alias("t_mae"), f.alias("mfe_log"), a.alias("mae_log"),
            )
        )
    return p.select(*by, "direction", "p0", *(["sigma"] if "sigma" in p.columns else []), F.inline(F.array(*rows)))


def _pct(c: str | Column, qs: list[float], name: str) -> list[Column]:
    return [F.percentile(c, q).alias(f"{name}_p{round(q * 100)}") for q in qs]


def excursion_summary(p: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` and horizon over eligible paths: endpoint returns, continuation, excursions, dominance and
    times to the extremes."""
    d = _long(p, by).where("elig").withColumn("dir_log", F.col("direction") * F.ln(F.col("close") / F.col("p0"))).withColumn("dom", F.col("mfe") + F.col("mae"))
    n = F.count(F.lit(1))
    return d.groupBy(*by, "h").agg(
        n.alias("n"),
        F.avg("dir_log").alias("dir_log_mean"), *_pct("dir_log", [0.05, 0.25, 0.5, 0.75, 0.95], "dir_log"), F.stddev_samp("dir_log").alias("dir_log_std"),
        (F.count(F.when(F.col("dir_log") > 0, 1)) / n).alias("continuation"), (F.count(F.when(F.col("dir_log") < 0, 1)) / n).alias("reversal"), (F.count(F.when(F.col("dir_log") == 0, 1)) / n).alias("flat"),
        F.avg("mfe").alias("mfe_mean"), *_pct("mfe", [0.5, 0.75, 0.95], "mfe"), F.avg(-F.col("mae")).alias("abs_mae_mean"), *_pct(-F.col("mae"), [0.5, 0.75, 0.95], "abs_mae"),
        F.avg("dom").alias("dominance_mean"), *_pct("dom", [0.25, 0.5, 0.75], "dominance"), (F.count(F.when(F.col("dom") > 0, 1)) / n).alias("dominance_gt_0"),
        F.avg("t_mfe").alias("t_mfe_mean"), *_pct("t_mfe", [0.5, 0.75, 0.95], "t_mfe"), F.avg("t_mae").alias("t_mae_mean"),
        (F.count(F.when(F.col("t_mfe") < F.col("t_mae"), 1)) / n).alias("mfe_first"), (F.count(F.when(F.col("t_mae") < F.col("t_mfe"), 1)) / n).alias("mae_first"),
    )


def sigma_excursions(p: DataFrame, by: list[str]) -> DataFrame:
    """Excursions in units of sigma, per ``by`` and horizon."""
    d = _long(p, by).where("elig and sigma > 0")
    f, a = F.col("mfe_log") / F.col("sigma"), -F.col("mae_log") / F.col("sigma")
    return d.groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"), F.avg(f).alias("mfe_sigma_mean"), *_pct(f, [0.5, 0.95], "mfe_sigma"), F.avg(a).alias("mae_sigma_mean"), *_pct(a, [0.5, 0.95], "mae_sigma"))


def first_passage(p: DataFrame, by: list[str]) -> DataFrame:
    """Shares of outcomes for the symmetric and asymmetric barrier pairs, per ``by`` and horizon."""
    cases = [F.struct(F.lit(t).alias("target_sigma"), F.lit(s).alias("stop_sigma"), F.lit(h).alias("h"), F.col(f"elig_{h}").alias("elig"), outcome(F.col(f"`t_fav_{t}`"), F.col(f"`t_adv_{s}`"), F.lit(h)).alias("code")) for t, s in [*((k, k) for k in LEVELS), *ASYMMETRIC] for h in EXPIRIES]
    d = p.where("sigma is not null").select(*by, F.inline(F.array(*cases))).where("elig")
    n = F.count(F.lit(1))
    share = lambda c: F.count(F.when(F.col("code") == c, 1)) / n
    return d.groupBy(*by, "target_sigma", "stop_sigma", "h").agg(n.alias("n"), share(TARGET).alias("target_first"), share(STOP).alias("stop_first"), share(AMBIGUOUS).alias("same_bar"), share(EXPIRED).alias("neither"))


def brackets(p: DataFrame, by: list[str]) -> DataFrame:
    """One row per event and cell of the surface: ``code, pnl`` (an ambiguous bar counts as the stop),
    ``raw_pnl`` (NULL there) and ``stop_points``.

    A cell is a number; its expiry and levels are looked up in arrays, so the code stays one expression."""
    k, cell = len(LEVELS), F.col("cell")
    arr = lambda cs: F.array(*(F.col(f"`{c}`") for c in cs))
    fixed = lambda xs: F.array(*(F.lit(x) for x in xs))
    d = p.where("sigma is not null").select(
        *by, *(c for c in ("direction", "p0", "sigma") if c not in by),
        arr([f"t_fav_{x}" for x in LEVELS]).alias("fav"), arr([f"t_adv_{x}" for x in LEVELS]).alias("adv"), arr([f"elig_{e}" for e in EXPIRIES]).alias("eligs"), arr([f"close_{e}" for e in EXPIRIES]).alias("closes"),
        F.explode(F.sequence(F.lit(0), F.lit(len(EXPIRIES) * k * k - 1))).alias("cell"),
    )
    e, s, t = F.floor(cell / (k * k)).cast("int"), F.floor(cell / k).cast("int") % k, cell % k
    d = d.withColumns({"e": e, "s": s, "t": t}).where(F.get("eligs", F.col("e")))
    d = d.withColumns({"expiry": F.get(fixed(EXPIRIES), F.col("e")), "stop_sigma": F.get(fixed(LEVELS), F.col("s")), "target_sigma": F.get(fixed(LEVELS), F.col("t"))})
    d = d.withColumn("code", outcome(F.get("fav", F.col("t")), F.get("adv", F.col("s")), F.col("expiry")))
    long, p0 = F.col("direction") > 0, F.col("p0")
    move = lambda x, up: F.when(up, p0 * (F.exp(F.col("sigma") * x) - 1)).otherwise(p0 * (1 - F.exp(-F.col("sigma") * x)))
    d = d.withColumn("stop_points", move(F.col("stop_sigma"), ~long))
    raw = F.when(F.col("code") == TARGET, move(F.col("target_sigma"), long)).when(F.col("code") == STOP, -F.col("stop_points")).when(F.col("code") == EXPIRED, F.col("direction") * (F.get("closes", F.col("e")) - p0))
    d = d.withColumn("raw_pnl", raw).withColumn("pnl", F.when(F.col("code") == AMBIGUOUS, -F.col("stop_points")).otherwise(F.col("raw_pnl")))
    return d.select(*by, "expiry", "stop_sigma", "target_sigma", "code", "raw_pnl", "stop_points", "pnl")


def bracket_surface(p: DataFrame, by: list[str]) -> DataFrame:
    """The 64-cell surface per ``by``: rates, points, multiples of the stop, profit factor, spread."""
    n, win, lose = F.count(F.lit(1)), F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    is_ = lambda *c: F.count(F.when(F.col("code").isin(*c), 1)) / n
    r = F.col("pnl") / F.col("stop_points")
    return brackets(p, by).groupBy(*by, "expiry", "stop_sigma", "target_sigma").agg(
        n.alias("n"), is_(TARGET).alias("target_rate"), is_(STOP, AMBIGUOUS).alias("stop_rate"), is_(EXPIRED).alias("expiry_rate"), is_(AMBIGUOUS).alias("same_bar_rate"),
        F.avg("pnl").alias("mean_points"), F.percentile("pnl", 0.5).alias("median_points"), F.avg(r).alias("mean_r"), F.percentile(r, 0.5).alias("median_r"),
        (win / F.abs(lose)).alias("profit_factor"), (F.count(F.when(F.col("pnl") > 0, 1)) / n).alias("win_rate"),
        F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))).alias("mean_winner"), F.avg(F.when(F.col("pnl") < 0, F.col("pnl"))).alias("mean_loser"),
        *_pct("pnl", [0.05, 0.25, 0.75, 0.95], "points"), F.avg("raw_pnl").alias("raw_mean_points"), F.count("raw_pnl").alias("n_unambiguous"),
    )


def year_stability(p: DataFrame, by: list[str], year: str, least: int = 20) -> DataFrame:
    """Per ``by`` and cell: years with ``least`` events or more, how many of them are positive, the worst, best
    and median yearly mean."""
    y = brackets(p, [*by, year]).groupBy(*by, year, "expiry", "stop_sigma", "target_sigma").agg(F.count(F.lit(1)).alias("n"), F.avg("pnl").alias("m")).where(F.col("n") >= least)
    return y.groupBy(*by, "expiry", "stop_sigma", "target_sigma").agg(F.count(F.lit(1)).alias("eligible_years"), F.count(F.when(F.col("m") > 0, 1)).alias("positive_years"), F.min("m").alias("worst_year"), F.max("m").alias("best_year"), F.percentile("m", 0.5).alias("median_year"))


def yearly_table(p: DataFrame, by: list[str], year: str, least: int = 20) -> DataFrame:
    """Per ``by``, year and horizon: continuation and excursion percentiles, years with ``least`` events or more."""
    d = _long(p, [*by, year]).where("elig")
    return d.groupBy(*by, year, "h").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.when(F.col("direction") * (F.col("close") - F.col("p0")) > 0, 1)) / F.count(F.lit(1))).alias("continuation"), *_pct("mfe", [0.5, 0.95], "mfe"), *_pct(-F.col("mae"), [0.5, 0.95], "abs_mae")
    ).where(F.col("n") >= least)


def ladder_paths(p: DataFrame, n_weeks: DataFrame) -> DataFrame:
    """Path summary of each ladder step and horizon with its change against the step before.

    ``p``: paths once per step they belong to (``step_no, step``); ``n_weeks``: one row. Steps without an eligible path at
    a horizon have no row there."""
    d = _long(p, ["step_no", "step"]).where("elig and sigma is not null").withColumn("up", (F.col("direction") * (F.col("close") - F.col("p0")) > 0).cast("double"))
    g = d.groupBy("step_no", "step", "h").agg(F.count(F.lit(1)).alias("n"), F.avg("up").alias("continuation"), *_pct("mfe", [0.5, 0.75, 0.95], "mfe"), *_pct(-F.col("mae"), [0.5, 0.75, 0.95], "abs_mae"))
    g = g.join(F.broadcast(n_weeks)).withColumn("per_week", F.col("n") / F.col("n_weeks")).drop("n_weeks")  # one row
    w = Window.partitionBy("h").orderBy("step_no")
    told = F.lag("step_no").over(w) == F.col("step_no") - 1
    return g.withColumns({f"d_{c}": F.when(told, F.col(c) - F.lag(c).over(w)) for c in ("per_week", "continuation", "mfe_p50", "abs_mae_p50")})


def digest(p: DataFrame, by: list[str], h: int = 60) -> DataFrame:
    """A few numbers per context: events, continuation, reversal and median excursions at ``h``, and how many cells of
    the bracket surface have a positive mean."""
    d = _long(p, by).where((F.col("h") == h) & F.col("elig"))
    side = F.col("direction") * (F.col("close") - F.col("p0"))
    share = lambda c: F.avg(c.cast("double"))
    a = d.groupBy(*by).agg(share(side > 0).alias("continuation"), share(side < 0).alias("reversal"), F.percentile("mfe", 0.5).alias("median_mfe"), F.percentile(-F.col("mae"), 0.5).alias("median_abs_mae"))
    cells = brackets(p, by).groupBy(*by, "expiry", "stop_sigma", "target_sigma").agg(F.avg("pnl").alias("m")).groupBy(*by).agg(F.count(F.when(F.col("m") > 0, 1)).alias("positive_cells"), F.count(F.lit(1)).alias("cells"))
    n = p.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"))
    return n.join(a, by, "left").join(cells, by, "left")


def group_contexts(members: DataFrame) -> DataFrame:
    """Contexts with the same events share a group: rows (context, event_id) to ``context, n, fingerprint``.

    The fingerprint is a sum of 128 bits of hashes, combined on the map side: no event list is gathered."""
    h = lambda s: F.sum(F.xxhash64("event_id", F.lit(s)).cast("decimal(38,0)")).cast("string")
    return members.groupBy("context").agg(F.count(F.lit(1)).alias("n"), h(1).alias("a"), h(2).alias("b")).select("context", "n", F.sha2(F.concat_ws("|", "n", "a", "b"), 256).alias("fingerprint"))


# Words that a diagnostic report must not use.
FORBIDDEN = ("BEST BRACKET", "OPTIMAL STOP", "OPTIMAL TARGET", "RECOMMENDED BRACKET")


def forbidden_phrases(texts: DataFrame, text: str) -> DataFrame:
    """The rows whose text holds a forbidden phrase, whatever the case, with ``phrases``: those found."""
    found = F.filter(F.array(*(F.lit(x) for x in FORBIDDEN)), lambda x: F.contains(F.upper(F.col(text)), x))
    return texts.withColumn("phrases", found).where(F.size("phrases") > 0)
