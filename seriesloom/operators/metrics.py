"""Forecast and classification metrics, each one grouped aggregation or a closed form over few counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .quantiles import depth_buckets
from .scan import prefix, span_of


def point_metrics(df: DataFrame, keys: list[str], actual: str, forecast: str) -> DataFrame:
    """MSE, MAE, R squared (NULL up to one row), MAPE, median absolute percentage error."""
    e = F.col(forecast) - F.col(actual)
    sse, sst = F.sum(e * e), F.var_pop(actual) * F.count(actual)
    share = F.abs(F.try_divide(e, F.col(actual)))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.when(F.count("*") > 1, 1 - F.try_divide(sse, sst)).alias("r2"), F.avg(share).alias("mape"), F.median(share).alias("median_ape")
    )


def pinball(actual: str | Column, forecast: str | Column, q: float) -> Column:
    e = (F.col(actual) if isinstance(actual, str) else actual) - (F.col(forecast) if isinstance(forecast, str) else forecast)
    return F.greatest(q * e, (q - 1) * e)


def interval_metrics(df: DataFrame, keys: list[str], actual: str, lower: str, mid: str, upper: str, q: tuple[float, float, float] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Coverage (ends included), width, misses on each side, error of the middle, mean pinball, direction."""
    a, lo, hi = F.col(actual), F.col(lower), F.col(upper)
    yes = lambda c: F.avg(c.cast("double"))
    loss = (pinball(actual, lower, q[0]) + pinball(actual, mid, q[1]) + pinball(actual, upper, q[2])) / 3
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), yes(a.between(lo, hi)).alias("coverage"), F.avg(hi - lo).alias("width"), yes(a > hi).alias("upper_miss"), yes(a < lo).alias("lower_miss"),
        F.avg(F.abs(a - F.col(mid))).alias("mae_mid"), F.avg(loss).alias("pinball"), yes(F.signum(mid) == F.signum(a)).alias("direction_accuracy"),
    )


def relative_metrics(df: DataFrame, keys: list[str], actual: str, mid: str, naive: str, lower: str, upper: str) -> DataFrame:
    """MAPE of the middle and of a naive forecast on the same rows, and the range's mean width in percent of the middle."""
    share = lambda c: F.avg(F.abs(F.try_divide(F.col(c) - F.col(actual), F.col(actual))))
    width = 100 * F.avg(F.try_divide(F.col(upper) - F.col(lower), F.col(mid)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), share(mid).alias("mape"), share(naive).alias("naive_mape"), width.alias("width_pct"))


def pit_histogram(df: DataFrame, keys: list[str], u: str, bins: int = 10) -> DataFrame:
    return df.groupBy(*keys, F.least(F.floor(F.col(u) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"))


def coverage_by_year(df: DataFrame, keys: list[str], ts: str, actual: str, lower: str, upper: str) -> DataFrame:
    return df.groupBy(*keys, F.year(ts).alias("year")).agg(F.count("*").alias("n"), F.avg(F.col(actual).between(F.col(lower), F.col(upper)).cast("double")).alias("coverage"))


def confusion(df: DataFrame, keys: list[str], truth: str, predicted: str) -> DataFrame:
    return df.groupBy(*keys, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(counts: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """Precision, recall, F1 and support of each fixed class from confusion counts; 0 over 0 is 0."""
    cells = [
        F.struct(
            F.lit(c).alias("class"),
            F.sum(F.when((F.col("truth") == c) & (F.col("predicted") == c), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("predicted") == c, F.col("n")).otherwise(0)).alias("said"),
            F.sum(F.when(F.col("truth") == c, F.col("n")).otherwise(0)).alias("support"),
        )
        for c in classes
    ]
    rows = counts.groupBy(*keys).agg(F.array(*cells).alias("c")).select(*keys, F.inline("c"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return rows.select(*keys, "class", "support", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"))


def confusion_metrics(counts: DataFrame, keys: list[str], classes: list) -> DataFrame:
    """Macro F1 over the fixed classes, and accuracy."""
    macro = class_report(counts, keys, classes).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))
    right = counts.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy"))
    return macro.join(right, keys) if keys else macro.crossJoin(right)  # one row each


AUC_BUCKETS = 256


def auc(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """Area under the ROC curve by average ranks: scores are counted first, then ranked by their counts.

    Distinct scores are ranked within buckets of about equal depth; totals of the buckets, at most AUC_BUCKETS a key,
    give each bucket's first rank.  So no task holds all scores of a key, however narrow their range.
    """
    counts = written(df.groupBy(*keys, score).agg(F.count("*").alias("m"), F.sum(F.col(label).cast("long")).alias("p")), "scores")
    counts = depth_buckets(counts, keys, score, AUC_BUCKETS)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(earlier(w)), F.lit(0))
    own = Window.partitionBy(*keys, "_b").orderBy(score)
    local = counts.withColumn("rank", before("m", own) + (F.col("m") + 1) / 2)
    sums = local.groupBy(*keys, "_b").agg(F.sum(F.col("rank") * F.col("p")).alias("r"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    sums = sums.withColumn("r", F.col("r") + F.col("p") * before("m", Window.partitionBy(*keys).orderBy("_b")))
    sums = sums.groupBy(*keys).agg(F.sum("r").alias("r"), F.sum("p").alias("p"), F.sum("m").alias("m"))
    return sums.select(*keys, F.try_divide(F.col("r") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("m") - F.col("p"))).alias("auc"))


def binary_counts(df: DataFrame, keys: list[str], label: str, predicted: Column) -> DataFrame:
    y, s = F.col(label) == 1, predicted
    return df.groupBy(*keys).agg(F.count_if(y & s).alias("tp"), F.count_if(~y & s).alias("fp"), F.count_if(y & ~s).alias("fn"), F.count_if(~y & ~s).alias("tn"))


def binary_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, macro F1, balanced accuracy and Matthews correlation from the four counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    z = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + fn + tn),
            "macro_f1": (z(2 * tp, 2 * tp + fp + fn) + z(2 * tn, 2 * tn + fp + fn)) / 2,
            "balanced_accuracy": (z(tp, tp + fn) + z(tn, tn + fp)) / 2,
            "mcc": z(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        }
    )


def evaluate_binary(df: DataFrame, keys: list[str], label: str, score: str, threshold: float | Column = 0.5) -> DataFrame:
    counts = binary_scores(binary_counts(df, keys, label, F.col(score) >= threshold))
    return counts.join(auc(df, keys, label, score), keys) if keys else counts.crossJoin(auc(df, keys, label, score))  # one row each


def threshold_grid(low: float = 0.05, count: int = 91, step: float = 0.01) -> list[float]:
    return [round(low + i * step, 2) for i in range(count)]


def threshold_scores(df: DataFrame, keys: list[str], label: str, score: str, thresholds: list[float] | None = None) -> DataFrame:
    """The four counts and scores at each threshold.

    Rows are counted by how many thresholds they reach, so each row is shuffled at most once, not once for
    each threshold.
    """
    grid = thresholds or threshold_grid()
    reached = F.size(F.filter(F.array(*map(F.lit, grid)), lambda t: F.col(score) >= t))
    counts = df.groupBy(*keys, reached.alias("k")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("m"))
    each = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))))  # thresholds squared, at most, for each key
    above = F.col("k") > F.col("i")
    total = lambda hit, c: F.sum(F.when(hit, F.col(c)).otherwise(0)).alias
    sums = each.groupBy(*keys, "i").agg(total(above, "p")("tp"), total(above, "m")("fp"), total(~above, "p")("fn"), total(~above, "m")("tn"))
    return binary_scores(sums.withColumn("threshold", F.get(F.array(*map(F.lit, grid)), F.col("i"))).drop("i"))


def best_threshold(df: DataFrame, keys: list[str], label: str, score: str) -> DataFrame:
    """The threshold of the largest macro F1; the least one on ties."""
    w = Window.partitionBy(*keys).orderBy(F.round("macro_f1", 12).desc(), "threshold")
    return threshold_scores(df, keys, label, score).withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, "threshold", "macro_f1")


def paired_outcomes(df: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    x, y = F.col(a) == F.col(truth), F.col(b) == F.col(truth)
    outcome = F.when(x & y, "both").when(x, "only_a").when(y, "only_b").otherwise("neither")
    return df.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def relative_loss(df: DataFrame, keys: list[str], method: str, loss: str, base: str) -> DataFrame:
    """Each method's loss over the base method's in the same group, less one."""
    own = df.where(F.col(method) == base).select(*keys, F.col(loss).alias("_base"))
    return df.join(own, keys).withColumn("relative_loss", F.try_divide(loss, "_base") - 1).drop("_base")


def kupiec(df: DataFrame, keys: list[str], miss: Column, p: float) -> DataFrame:
    """Likelihood ratio of the miss rate against p (Kupiec, 1995)."""
    c = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(miss).alias("misses"))
    n, x = F.col("n").cast("double"), F.col("misses").cast("double")
    term = lambda k, share: F.when(k > 0, k * F.ln(share)).otherwise(0.0)
    lr = -2 * (term(n - x, F.lit(1 - p)) + term(x, F.lit(p)) - term(n - x, 1 - x / n) - term(x, x / n))
    return c.withColumn("lr", lr)


def diebold_mariano(df: DataFrame, keys: list[str], ts: str, loss_a: str, loss_b: str, lags: int, block: Column | None = None) -> DataFrame:
    """Mean loss difference over its standard error with `lags` autocovariances (Diebold and Mariano, 1995).

    Differences `lags` rows apart are paired in blocks of time, each with the rows that the next ones lack: the last
    `lags` rows of every block visit the block after it.  So no task holds a series, nor all rows where there are no
    keys.  `block` must grow with the time; times are unique within a series.
    """
    d = df.withColumns({"_d": F.col(loss_a) - F.col(loss_b), "_block": span_of(df, ts) if block is None else block.cast("long")}).select(*keys, ts, "_block", "_d")
    means = d.groupBy(*keys).agg(F.avg("_d").alias("_mean"))
    d = (d.join(means, keys) if keys else d.crossJoin(means)).withColumn("_c", F.col("_d") - F.col("_mean")).select(*keys, ts, "_block", "_c", "_d")  # one row
    tail = d.groupBy(*keys, "_block").agg(F.slice(F.array_sort(F.collect_list(F.struct(ts, "_c")), lambda x, y: F.when(x[ts] > y[ts], -1).when(x[ts] < y[ts], 1).otherwise(0)), 1, max(1, lags)).alias("_tail"))
    # the last rows before each block, whichever blocks they are from, latest first
    carried = prefix(tail, keys, "_block", F.slice(F.array(F.struct(F.lit(None).cast(df.schema[ts].dataType).alias(ts), F.lit(None).cast("double").alias("_c"))), 1, 0), lambda s, x: F.slice(F.concat(x["_tail"], s), 1, max(1, lags)))
    visits = carried.select(*keys, "_block", F.inline("_carry")).withColumn("_own", F.lit(False))
    every = d.select(*keys, "_block", ts, "_c", F.lit(True).alias("_own"), "_d").unionByName(visits, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_block").orderBy(ts)
    shifted = every.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in range(1, lags + 1)}).where("_own")
    n = F.count("*")
    variance = F.sum(F.col("_c") * F.col("_c"))
    for k in range(1, lags + 1):
        variance = variance + 2 * F.coalesce(F.sum(F.col("_c") * F.col(f"_c{k}")), F.lit(0.0))
    return shifted.groupBy(*keys).agg(n.alias("n"), F.avg("_d").alias("mean_difference"), F.try_divide(F.avg("_d"), F.sqrt(F.when(variance > 0, variance / n / n))).alias("dm"))


def staged_change(df: DataFrame, stage: str, metrics: list[str]) -> DataFrame:
    """Mean of fold metrics by stage, and each one's change from the stage before."""
    means = df.groupBy(stage).agg(*[F.avg(m).alias(m) for m in metrics])
    w = Window.orderBy(stage)  # a row for each stage
    return means.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(w) for m in metrics})


def choose_on(df: DataFrame, period: str, select: str, test: str, method: str, loss: str) -> DataFrame:
    """The method with the least loss in the selection period, with its loss in the test period."""
    by_method = df.groupBy(method).agg(F.avg(F.when(F.col(period) == select, F.col(loss))).alias("selection_loss"), F.avg(F.when(F.col(period) == test, F.col(loss))).alias("test_loss"))
    return by_method.orderBy(F.col("selection_loss").asc_nulls_last(), method).limit(1)
