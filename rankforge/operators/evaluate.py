"""Classification metrics and rating metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankforge.functions.special import pearson_p_value
from rankforge.functions.verdicts import encode_label
from rankforge.operators.ordering import row_index
from rankforge.schemas import LABELS

CELLS = [(t, p) for t in LABELS for p in LABELS]
RUN_CHUNK = 4096


def cell(true: str, predicted: str) -> str:
    return f"n_{true}_{predicted}"


def confusion_counts(
    df: DataFrame, by: list[str] | None = None, truth: str = "winner",
    predicted: str = "predicted_winner",
) -> DataFrame:
    """The nine cells of the confusion grid as columns: one pass, constant-size state."""
    cells = [
        F.count_if((F.col(truth) == t) & (F.col(predicted) == p)).alias(cell(t, p)) for t, p in CELLS
    ]
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n"), *cells)


def confusion(df: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    """Long confusion table over the fixed label order, zeros included."""
    by = list(by or [])
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("true_winner"), F.lit(p).alias("predicted_winner"),
                     F.col(cell(t, p)).alias("n"))
            for t, p in CELLS
        ]
    )
    return confusion_counts(df, by, **names).select(*by, F.inline(rows))


def _total(columns: list[str]) -> Column:
    out = F.col(columns[0])
    for name in columns[1:]:
        out = out + F.col(name)
    return out


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where it is undefined."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_scores(label: str) -> dict[str, Column]:
    """Precision, recall, F1 and support of one class from the nine cells."""
    hit = F.col(cell(label, label))
    called = _total([cell(t, label) for t in LABELS])
    support = _total([cell(label, p) for p in LABELS])
    return {
        "precision": _ratio(hit, called), "recall": _ratio(hit, support),
        "f1": _ratio(2 * hit, called + support), "support": support,
    }


def classification_metrics(df: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    """Accuracy, macro / weighted / per-class F1 and counts per group, one pass for all."""
    return metrics_of_counts(confusion_counts(df, by, **names), by)


def metrics_of_counts(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The metric row of each row of confusion counters."""
    by = list(by or [])
    f1 = {label: class_scores(label)["f1"] for label in LABELS}
    support = {label: class_scores(label)["support"] for label in LABELS}
    hits = _total([cell(label, label) for label in LABELS])
    known = support["A"] + support["B"] + support["Equal"]
    weighted = sum(f1[label] * support[label] for label in LABELS)
    return counts.select(
        *by, F.col("n").alias("n_samples"), _ratio(hits, F.col("n")).alias("accuracy"),
        ((f1["A"] + f1["B"] + f1["Equal"]) / 3).alias("f1_macro"),
        _ratio(weighted, known).alias("f1_weighted"),
        *[f1[label].alias(f"f1_{label}") for label in LABELS], hits.alias("n_correct"),
        *[_total([cell(t, label) for t in LABELS]).alias(f"predicted_{label}") for label in LABELS],
        *[support[label].alias(f"true_{label}") for label in LABELS],
    )


def class_report(df: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    """Precision, recall, F1 and support per class plus macro and weighted averages."""
    by = list(by or [])
    counts = confusion_counts(df, by, **names)
    scores = {label: class_scores(label) for label in LABELS}
    total = sum(scores[label]["support"] for label in LABELS)
    measures = ("precision", "recall", "f1")

    def row(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), *[values[m].alias(m) for m in measures],
            support.cast("bigint").alias("support"),
        )

    rows = [row(label, scores[label], scores[label]["support"]) for label in LABELS]
    macro = {m: sum(scores[label][m] for label in LABELS) / 3 for m in measures}
    weighted = {
        m: _ratio(sum(scores[label][m] * scores[label]["support"] for label in LABELS), total)
        for m in measures
    }
    rows += [row("macro avg", macro, total), row("weighted avg", weighted, total)]
    return counts.select(*by, F.inline(F.array(*rows)))


def running_metrics(
    df: DataFrame, every: int, order: list[str], by: list[str] | None = None,
    truth: str = "winner", predicted: str = "predicted_winner",
) -> DataFrame:
    """Cumulative confusion cells and accuracy after each ``every`` rows in ``order``.

    The running sums go over one row per bucket, in chunks of buckets with carried-in
    totals, so no window sees more than a chunk.
    """
    by = list(by or [])
    slim = df.select(*{*by, *order, truth, predicted})
    indexed = row_index(slim, order, by, name="_i")
    buckets = confusion_counts(
        indexed.withColumn("bucket", F.floor(F.col("_i") / every).cast("bigint")),
        [*by, "bucket"], truth, predicted,
    ).withColumn("_chunk", F.floor(F.col("bucket") / RUN_CHUNK))
    sums = ["n", *[cell(t, p) for t, p in CELLS]]
    within = Window.partitionBy(*by, "_chunk").orderBy("bucket")
    before = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("_chunk")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.groupBy(*by, "_chunk").agg(*[F.sum(c).alias(c) for c in sums]).select(
        *by, "_chunk", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    out = buckets.join(carried, [*by, "_chunk"]).select(
        *by, "bucket",
        *[(F.sum(c).over(within) + F.col(f"_{c}")).cast("bigint").alias(c) for c in sums],
    )
    hits = _total([cell(label, label) for label in LABELS])
    return out.withColumnRenamed("n", "processed").withColumn(
        "accuracy", hits / F.col("processed")
    )


def student_t_tail(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson r over n points, for a single value on the driver.

    Tables use ``functions.special.pearson_p_value``. The tail is a regularised incomplete beta function, evaluated by its continued
    fraction (modified Lentz recurrence).
    """
    if n is None or r is None or math.isnan(r) or n < 2:
        return float("nan")
    if n == 2 or r == 0.0:
        return 1.0
    df = n - 2
    if abs(r) >= 1.0:
        return 0.0
    x, a, b = 1.0 - r * r, df / 2.0, 0.5  # x = df / (df + t**2)

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (
                m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
            ):
                d = 1.0 + num * d
                c = 1.0 + num / c
                d = 1.0 / (d if abs(d) > tiny else tiny)
                c = c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1.0) < 1e-15:
                break
        return h

    logs = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(logs) * fraction(a, b, x) / a
    return 1.0 - math.exp(logs) * fraction(b, a, 1.0 - x) / b


def pearson(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL if either side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def rating_metrics(
    df: DataFrame, by: list[str] | None = None, truth: str = "norm_response",
    rating: str = "elo_normalized", with_p: bool = True, round_to: int | None = None,
) -> DataFrame:
    """n, Pearson r, p-value, R squared, MAE and RMSE of ratings against truth.

    Rows lacking either value are ignored; fewer than two leave all metrics NULL.
    """
    by = list(by or [])
    t0, p0 = F.col(truth), F.col(rating)
    valid = t0.isNotNull() & ~F.isnan(t0) & p0.isNotNull() & ~F.isnan(p0)
    t, p = F.when(valid, t0), F.when(valid, p0)
    sums = df.groupBy(*by).agg(
        F.count(t).alias("n"), pearson(t, p).alias("_r"),
        F.var_pop(t).alias("_var"), F.avg((t - p) * (t - p)).alias("_mse"),
        F.avg(F.abs(t - p)).alias("_mae"),
    )
    enough = F.col("n") >= 2
    fit = F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).otherwise(
        F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    )
    values = {
        "pearson_r": F.when(enough, F.col("_r")), "r_squared": F.when(enough, fit),
        "mae": F.when(enough, F.col("_mae")), "rmse": F.when(enough, F.sqrt("_mse")),
    }
    if round_to is not None:
        values = {k: F.round(v, round_to) for k, v in values.items()}
    out = sums.withColumns(values)
    if with_p:
        out = out.withColumn("p_value", F.when(enough & F.col("_r").isNotNull(), pearson_p_value(F.col("_r"), F.col("n"))))
    return out.drop("_r", "_var", "_mse", "_mae")


RATING_SUMS = ["n", "t", "p", "tt", "pp", "tp", "miss"]


def rating_sums(
    df: DataFrame, by: list[str], truth: str = "norm_response", rating: str = "elo_normalized"
) -> DataFrame:
    """Sums per group from which ``metrics_of_sums`` has all rank-quality measures.

    Sums of parts add up to the sums of the whole, so a part that is replaced brings its own
    and the others are not read again. Rows lacking either value are left out.
    """
    t, p = F.col(truth).cast("double"), F.col(rating).cast("double")
    valid = df.filter(t.isNotNull() & ~F.isnan(t) & p.isNotNull() & ~F.isnan(p))
    return valid.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(t).alias("t"), F.sum(p).alias("p"), F.sum(t * t).alias("tt"),
        F.sum(p * p).alias("pp"), F.sum(t * p).alias("tp"), F.sum(F.abs(t - p)).alias("miss"),
    )


def metrics_of_sums(sums: DataFrame, by: list[str]) -> DataFrame:
    """n, Pearson r, R squared, MAE and RMSE per group, from ``rating_sums`` of its parts.

    Meant for values of the order of one, as scaled labels and ratings are. Fewer than two
    rows leave all metrics NULL; a constant side leaves r NULL.
    """
    total = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in RATING_SUMS])
    n, t, p = F.col("n"), F.col("t"), F.col("p")
    # what rounding leaves of a variance that is zero
    dust = 1e-13
    var_t, var_p = F.col("tt") / n - (t / n) ** 2, F.col("pp") / n - (p / n) ** 2
    flat_t, flat_p = var_t <= dust * F.col("tt") / n, var_p <= dust * F.col("pp") / n
    both = F.col("tp") / n - (t / n) * (p / n)
    square = F.greatest(F.lit(0.0), (F.col("tt") - 2 * F.col("tp") + F.col("pp")) / n)
    fit = F.when(flat_t, F.when(square <= dust, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(1 - square / var_t)
    r = F.when(~flat_t & ~flat_p, F.try_divide(both, F.sqrt(var_t) * F.sqrt(var_p)))
    values = {"pearson_r": r, "r_squared": fit, "mae": F.col("miss") / n, "rmse": F.sqrt(square)}
    return total.select(*by, "n", *[F.when(n >= 2, v).alias(k) for k, v in values.items()])


def label_metrics(
    df: DataFrame, by: list[str], truth: str = "winner", predicted: str = "predicted_winner"
) -> DataFrame:
    """Accuracy and Pearson r between class ids per group; an undefined r counts as 0."""
    t, p = encode_label(F.col(truth)).cast("double"), encode_label(F.col(predicted)).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((t == p).cast("double")).alias("accuracy"),
        F.coalesce(pearson(t, p), F.lit(0.0)).alias("pearson"),
    )


def dataset_averages(summary: DataFrame) -> DataFrame:
    """Per dataset: mean of the quality measures and rounds, sums of items and pairs."""
    means = [c for c in ("pearson_r", "r_squared", "mae", "rmse", "rounds") if c in summary.columns]
    return summary.groupBy("dataset").agg(
        *[F.avg(c).alias(c) for c in means],
        *[F.sum(c).cast("bigint").alias(c) for c in ("n_items", "n_pairs")],
    )


def top_bottom(ratings: DataFrame, by: list[str], k: int = 10, rating: str = "elo") -> DataFrame:
    """The k best and k worst rated rows per group, ties broken by id."""
    parts = []
    for side, order in (("top", F.desc(rating)), ("bottom", F.asc(rating))):
        w = Window.partitionBy(*by).orderBy(order, "response_id")
        ranked = ratings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
        parts.append(ranked.withColumn("side", F.lit(side)))
    return parts[0].unionByName(parts[1])
