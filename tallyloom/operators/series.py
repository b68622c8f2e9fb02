"""Daily series: calendar, lags, rolling statistics, fills, backtests, flags and recursive forecasts.

Input: a frame with the key columns, a date and a value. All series advance together: windows are
partitioned by the keys, and a forecast step is one DataFrame transform over all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.exprs import even, exact_mean, exact_sum

LAGS = (7, 14, 28, 364)
FLAG_ABOVE = 0.80


def calendar(df: DataFrame, date: str = "datum") -> DataFrame:
    """Weekday (Monday 0), month, ISO week, weekend flag."""
    return df.withColumns({"wochentag": F.weekday(date), "monat": F.month(date), "kw": F.weekofyear(date), "wochenende": (F.weekday(date) >= 5).cast("int")})


def holidays(df: DataFrame, days: DataFrame, ranges: DataFrame, date: str = "datum") -> DataFrame:
    """Flags for days in a list (date) and within ranges (start, end), ends included.

    Ranges are unfolded to days first, so both are equi-joins with a small side; a row stays one row.
    """
    inside = ranges.select(F.explode(F.sequence("start", "end", F.expr("interval 1 day"))).alias("_day")).distinct().withColumn("ferien", F.lit(1))
    fixed = days.select(F.col("date").alias("_fix")).distinct().withColumn("feiertag", F.lit(1))
    out = df.join(fixed, F.col(date) == F.col("_fix"), "left").join(inside, F.col(date) == F.col("_day"), "left").drop("_fix", "_day")
    return out.fillna(0, ["feiertag", "ferien"])


def features(df: DataFrame, keys: list[str], date: str = "datum", value: str = "menge", lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Lags by rows, and mean and deviation of the rows before (28 and 14), as a model is trained on."""
    by = Window.partitionBy(*keys).orderBy(date)
    v = F.col(value).cast("double")

    def rolling(f, n: int, least: int) -> Column:
        w = by.rowsBetween(-n, -1)
        return F.when(F.count(v).over(w) >= least, f(v).over(w))

    return df.withColumns(
        {f"lag_{k}": F.lag(v, k).over(by) for k in lags}
        | {"roll_mean_28": rolling(F.avg, 28, 7), "roll_std_28": F.coalesce(rolling(F.stddev_samp, 28, 7), F.lit(0.0)), "roll_mean_14": rolling(F.avg, 14, 3)}
    )


def calendar_lags(df: DataFrame, keys: list[str], date: str = "datum", value: str = "menge", lags: tuple[int, ...] = LAGS) -> DataFrame:
    """Values exactly k days before; where that day is missing, the mean of the series."""
    by = Window.partitionBy(*keys)
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    mean = F.sum(F.col(value).cast("decimal(28,4)")).over(by).cast("double") / F.count(value).over(by)
    return df.withColumns({f"vor_{k}": F.coalesce(F.max(F.col(value).cast("double")).over(by.orderBy(day).rangeBetween(-k, -k)), mean) for k in lags})


def naive_baseline(df: DataFrame, keys: list[str], date: str = "datum", value: str = "menge") -> DataFrame:
    """The value 7 days before, else 14, else the rounded value 7 rows before."""
    by = Window.partitionBy(*keys)
    day = F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))
    at = lambda k: F.max(F.col(value).cast("double")).over(by.orderBy(day).rangeBetween(-k, -k))
    return df.withColumn("naiv", F.coalesce(at(7), at(14), even(F.lag(F.col(value).cast("double"), 7).over(by.orderBy(date)))))


def complete(df: DataFrame, keys: list[str], date: str = "datum", value: str = "menge") -> DataFrame:
    """A row for each day from a series' first to its last; new days have no value."""
    span = df.groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    days = span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(date))
    return days.join(df.select(*keys, date, value), [*keys, date], "left")


def filled(df: DataFrame, keys: list[str], date: str = "datum", value: str = "menge") -> DataFrame:
    """Missing values from the last before, at the start from the first after."""
    by = Window.partitionBy(*keys).orderBy(date)
    back = F.last(value, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn("gefuellt", F.coalesce(back, ahead))


def last_rows(df: DataFrame, keys: list[str], n: int, date: str = "datum") -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(F.desc(date))
    return df.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= n).drop("_n")


def normalised(df: DataFrame, keys: list[str], n: int = 528, date: str = "datum", value: str = "menge") -> DataFrame:
    """The last n values of each series less their mean, by their population deviation."""
    recent = last_rows(df, keys, n, date)
    by = Window.partitionBy(*keys)
    v = F.col(value).cast("double")
    return recent.withColumns({"mittel": F.avg(v).over(by), "streuung": F.stddev_pop(v).over(by) + 1e-8}).withColumn("z", (v - F.col("mittel")) / F.col("streuung"))


def denormalised(df: DataFrame, column: str = "z") -> DataFrame:
    """Values back from their normalised form (columns mittel and streuung of normalised()), not below 0."""
    return df.withColumn("wert", F.greatest(F.lit(0.0), F.col(column) * F.col("streuung") + F.col("mittel")))


def long_enough(df: DataFrame, keys: list[str], least: int = 528, value: str = "menge") -> DataFrame:
    """The number of rows of each series and whether it is too short for a model of that lookback, with the message."""
    short = F.col("n") < least
    out = df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("zu_kurz", short)
    return out.withColumn("meldung", F.when(short, F.concat(F.lit("Zu wenig Daten: "), F.col("n").cast("string"), F.lit(f" Zeilen, mindestens {least} benötigt."))))


def require_long(df: DataFrame, keys: list[str], least: int = 528) -> DataFrame:
    """df, or ValueError if one of its series is too short: one aggregate and one row to the driver."""
    first = long_enough(df, keys, least).where("zu_kurz").orderBy("n", *keys).limit(1).collect()
    if first:
        raise ValueError(first[0].meldung)
    return df


#: Fixed values of the year's daily greatest temperature: mean, swing, day of the mean in spring.
WARM, SWING, SPRING = 16.5, 12.5, 80


def temperature(df: DataFrame, live: DataFrame | None = None, date: str = "datum", noise: float = 0.0) -> DataFrame:
    """A temperature for each day: a measured one (live: date, temperatur), else the season's, with noise from the day's hash if asked for.

    The lookup is a left join with a small table of days; of several values of a day the greatest counts.
    """
    spread = F.pmod(F.xxhash64(F.col(date).cast("string")), F.lit(2_000_001)).cast("double") / 1_000_000 - 1
    season = F.lit(WARM) + F.lit(SWING) * F.sin((F.dayofyear(date) - SPRING) / 365.0 * 2 * F.pi()) + spread * noise
    if live is None:
        return df.withColumn("temperatur", season)
    own = live.where("temperatur IS NOT NULL").groupBy(F.col("date").alias("_day")).agg(F.max(F.col("temperatur").cast("double")).alias("_live"))
    return df.join(own, F.col(date).cast("date") == F.col("_day"), "left").withColumn("temperatur", F.coalesce("_live", season)).drop("_day", "_live")


def backtest(df: DataFrame, keys: list[str], days: int = 28, date: str = "datum", value: str = "menge", predicted: str = "prognose", naive: str = "naiv", least: int = 7) -> DataFrame:
    """Per series over its last days: WAPE, MAE and bias of a forecast and of the naive one, and the gain; NULL below least rows."""
    by = Window.partitionBy(*keys)
    recent = df.withColumn("_last", F.max(date).over(by)).where(F.col(date) > F.date_sub("_last", days)).dropna(subset=[value, predicted, naive])
    actual, p, q = F.col(value).cast("double"), F.col(predicted), F.col(naive)
    total = exact_sum(actual)
    rate = lambda x: F.when(total > 0, exact_sum(F.abs(actual - x)) / total).otherwise(0.0)
    out = recent.groupBy(*keys).agg(F.count("*").alias("n"), rate(p).alias("wape"), rate(q).alias("wape_naiv"), exact_mean(F.abs(actual - p)).alias("mae"), exact_mean(p - actual).alias("bias"))
    out = out.withColumn("verbesserung_pct", F.when(F.col("wape_naiv") > 0, (F.col("wape_naiv") - F.col("wape")) / F.col("wape_naiv") * 100).otherwise(0.0))
    return out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("wape", "wape_naiv", "mae", "bias", "verbesserung_pct")})


def interval(df: DataFrame, predicted: str = "prognose", deviation: str = "roll_std_28") -> DataFrame:
    """Lower and upper bound: 1.5 deviations (at least a tenth of the forecast), whole and not below 0."""
    sigma = F.greatest(F.col(deviation), F.col(predicted) * 0.1)
    return df.withColumns({"unten": F.greatest(F.lit(0.0), even(F.col(predicted) - sigma * 1.5)), "oben": even(F.col(predicted) + sigma * 1.5)})


def flags(df: DataFrame, predicted: str = "prognose", naive: str = "naiv", above: float = FLAG_ABOVE) -> DataFrame:
    """auffaellig where a forecast is further from the naive one than that share of it."""
    off = F.try_divide(F.abs(F.col(predicted) - F.col(naive)), F.col(naive))
    return df.withColumn("flag", F.when((F.col(naive) > 0) & (off > above), "auffaellig").otherwise("ok"))


def overview(df: DataFrame, keys: list[str], predicted: str = "prognose") -> DataFrame:
    """Per series: total, flagged days, whether any."""
    return df.groupBy(*keys).agg(exact_sum(F.col(predicted)).alias("summe"), F.count_if(F.col("flag") == "auffaellig").alias("n_auffaellig"), F.max((F.col("flag") == "auffaellig").cast("int")).alias("auffaellig"))


def corrected(df: DataFrame, corrections: DataFrame, keys: list[str], date: str = "datum", predicted: str = "prognose") -> DataFrame:
    """Manual corrections (keys, date, wert) over forecasts; a NULL wert or none keeps the forecast. The last of one key would be ambiguous: the greatest counts."""
    own = corrections.groupBy(*keys, date).agg(F.max("wert").alias("_wert"))
    return df.join(own, [*keys, date], "left").withColumn("final", F.coalesce(F.col("_wert").cast("double"), F.col(predicted))).drop("_wert")


MODEL_FEATURES = (
    "wochentag", "monat", "kw", "feiertag", "ferien", "temperatur", "aktion", "lag_7", "lag_14", "lag_28", "lag_364",
    "roll_mean_28", "roll_std_28", "roll_mean_14", "reihe_1", "reihe_2",
)
HISTORY = 400


def model_rows(df: DataFrame, keys: list[str], days: DataFrame | None, ranges: DataFrame | None, live: DataFrame | None, date: str, value: str) -> DataFrame:
    """All features of a model: calendar, holidays, temperature, promotion, lags, rolling statistics, and the series as numbers (of its first two keys)."""
    rows = temperature(calendar(features(df, keys, date, value), date), live, date)
    rows = holidays(rows, days, ranges, date) if days is not None and ranges is not None else rows.withColumns({"feiertag": F.lit(0), "ferien": F.lit(0)})
    code = lambda i: F.pmod(F.xxhash64(F.col(keys[i]).cast("string")), F.lit(64)) if i < len(keys) else F.lit(0)
    if "aktion" not in rows.columns:
        rows = rows.withColumn("aktion", F.lit(0))
    return rows.withColumns({"aktion": F.coalesce("aktion", F.lit(0)), "reihe_1": code(0), "reihe_2": code(1)})


def trained(df: DataFrame, keys: list[str], date: str = "datum", value: str = "menge", trees: int = 20, depth: int = 5, seed: int = 7, days: DataFrame | None = None, ranges: DataFrame | None = None, live: DataFrame | None = None):
    """One boosted-tree model over all series; returns the fitted pipeline of assembler and trees.

    Rows without a value a year before are left out, as the other lags'; if that leaves none, a series' missing lag is its mean.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = model_rows(df, keys, days, ranges, live, date, value)
    whole_rows = rows.dropna(subset=[*MODEL_FEATURES, value])
    if whole_rows.isEmpty():
        mean = F.avg(F.col(value).cast("double")).over(Window.partitionBy(*keys))
        whole_rows = rows.dropna(subset=[value]).withColumns({c: F.coalesce(F.col(c), mean) for c in MODEL_FEATURES if c.startswith(("lag", "roll"))})
    stages = [VectorAssembler(inputCols=list(MODEL_FEATURES), outputCol="features"), GBTRegressor(featuresCol="features", labelCol=value, predictionCol="prognose", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed, checkpointInterval=-1)]
    return Pipeline(stages=stages).fit(whole_rows.select(F.col(value).cast("double").alias(value), *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES]))


def forecast(df: DataFrame, keys: list[str], model, steps: int = 7, date: str = "datum", value: str = "menge", start: str | None = None, days: DataFrame | None = None, ranges: DataFrame | None = None, live: DataFrame | None = None, actions: tuple[int, ...] = (), most_gap: int = 120) -> DataFrame:
    """steps days from start (or the day after the last of all series), one after the other: a step's forecasts (whole, not below 0) are history for the next.

    Days between a series' last and start are filled by forecasts without being reported (a gap of more than most_gap days
    is refused). actions: for each step 1 if a promotion is planned. The naive forecast beside it is from real values alone: 7 days before, else 14, else
    the value 7 rows before.
    """
    from tallyloom.sources.session import cut

    own = df.select(*keys, date, F.col(value).cast("double").alias(value))
    ends = own.groupBy(*keys).agg(F.max(date).alias("_last"))
    first, last, now = ends.agg(F.min("_last"), F.max("_last"), F.coalesce(F.lit(start).cast("date"), F.date_add(F.max(F.col("_last").cast("date")), 1))).first()
    if first is None:
        return own.select(*keys, date, *[F.lit(None).cast("double").alias(c) for c in ("prognose", "roll_std_28", "naiv", "unten", "oben")]).limit(0)
    as_day = lambda x: x.date() if hasattr(x, "date") else x
    gap = max(0, (now - as_day(first)).days - 1)
    if gap > most_gap:
        raise ValueError(f"a series ends {gap} days before the forecast's start; at most {most_gap} are filled")
    history = cut(last_rows(own, keys, HISTORY, date).withColumn("aktion", F.lit(0)))
    real = history.where(F.col(value).isNotNull()).select(*keys, F.col(date).cast("date").alias("_tag"), F.col(value).alias("_echt"))
    series_keys = ends.select(*keys, F.col("_last").cast("date").alias("_last"))
    out = None
    for step in range(-gap, steps):
        day = F.date_add(F.lit(now), step)
        new = series_keys.where(F.col("_last") < day).select(*keys, day.cast(own.schema[date].dataType).alias(date), F.lit(None).cast("double").alias(value), F.lit(int(step >= 0 and step < len(actions) and bool(actions[step]))).alias("aktion"))
        rows = model_rows(history.unionByName(new), keys, days, ranges, live, date, value).where(F.col(value).isNull() & (F.col(date).cast("date") == day))
        mean = F.coalesce(F.col("roll_mean_28"), F.lit(0.0))
        rows = rows.withColumns({c: F.coalesce(F.col(c), mean) for c in MODEL_FEATURES if c.startswith(("lag", "roll"))})
        said = model.transform(rows.withColumns({c: F.col(c).cast("double") for c in MODEL_FEATURES}))
        said = cut(said.select(*keys, date, F.greatest(F.lit(0.0), even(F.col("prognose"))).alias("prognose"), "roll_std_28", "lag_7", "feiertag", "ferien", "temperatur", "aktion"))
        history = history.unionByName(said.select(*keys, date, F.col("prognose").alias(value), "aktion"))
        if step >= 0:
            out = said if out is None else out.unionByName(said)
    before = lambda k, name: real.select(*keys, F.date_add("_tag", k).alias("_tag"), F.col("_echt").alias(name))
    out = out.withColumn("_tag", F.col(date).cast("date")).join(before(7, "_a"), [*keys, "_tag"], "left").join(before(14, "_b"), [*keys, "_tag"], "left")
    return interval(out.withColumn("naiv", F.coalesce("_a", "_b", even(F.col("lag_7")))).drop("_tag", "_a", "_b", "lag_7"))


def importance(model, top: int = 10) -> list[tuple[str, float]]:
    """The model's features by share of importance, greatest first."""
    shares = model.stages[-1].featureImportances.toArray().tolist()
    return sorted(zip(MODEL_FEATURES, shares), key=lambda x: (-x[1], x[0]))[:top]


def frequency(df: DataFrame, date: str) -> str:
    """h, D or W: the distance of the first two stamps."""
    first = [r[0] for r in df.select(F.unix_timestamp(F.col(date).cast("timestamp")).alias("s")).orderBy("s").limit(2).collect()]
    if len(first) < 2:
        return "D"
    return "h" if first[1] - first[0] <= 3600 else "D" if first[1] - first[0] <= 86_400 else "W"


#: Steps of a horizon by frequency.
HORIZONS = {"h": {"1w": 168, "2w": 336, "4w": 672, "3m": 2160}, "D": {"1w": 7, "2w": 14, "4w": 28, "3m": 90}, "W": {"1w": 1, "2w": 2, "4w": 4, "3m": 13}}
MOST_STEPS = 720


def horizon(freq: str, name: str) -> int:
    """Steps of a named horizon, at most MOST_STEPS."""
    return min(HORIZONS[freq][name], MOST_STEPS)
