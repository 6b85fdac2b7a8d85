"""Exact percentiles, fits and scores that combine before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numeric import count_if, ratio
from ..session import cut
from .scan import ordered_scan


def percentiles(df: DataFrame, by: list[str], value: str, picks: dict[str, tuple[float, str]],
                extra: list[Column] | None = None, weight: str | None = None) -> DataFrame:
    """Exact percentiles per group without gathering a group in one task.

    Values are counted (combined map-side), dealt by range into as many chunks as their number asks for, ranked chunk by
    chunk and picked by rank.  Methods: ``continuous`` interpolates; ``nearest`` takes rank ``round((n-1)q)`` half
    to even; ``truncate`` takes ``floor(n q)``; ``upper_median`` takes ``floor(n/2)``.
    A global call (``by`` empty) gives one row even without data.  ``weight`` names a column that tells how many equal values a row is.
    """
    keys = by or ["__all"]
    src = df.filter(F.col(value).isNotNull())
    if not by:
        src = src.withColumn("__all", F.lit(0))
    hist = src.groupBy(*keys, F.col(value).cast("double").alias("__v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("cnt"))
    hist = cut(hist.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()))
    ranked = ordered_scan(hist, keys, ["__v"], F.col("__range"), running_sum={"upto": F.col("cnt")}, total={"size": F.col("cnt")})

    def at(idx: Column) -> Column:
        return F.max(F.when((idx >= F.col("upto") - F.col("cnt")) & (idx < F.col("upto")), F.col("__v")))

    n = F.col("size")
    out = []
    for name, (q, method) in picks.items():
        if method == "continuous":
            pos = (n - 1) * F.lit(q)
            lo, hi = at(F.floor(pos)), at(F.ceil(pos))
            frac = F.max(pos - F.floor(pos))
            out.append((lo + (hi - lo) * frac).alias(name))
        elif method == "nearest":
            out.append(at(F.bround((n - 1) * F.lit(q))).alias(name))
        elif method == "truncate":
            out.append(at(F.least(F.floor(n * F.lit(q)), n - 1)).alias(name))
        elif method == "upper_median":
            out.append(at(F.floor(n / 2)).alias(name))
        else:
            raise ValueError(method)
    grouped = ranked.groupBy(*by) if by else ranked
    return grouped.agg(*out, *(extra or []))




def linear_fit(df: DataFrame, x_cols: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """Least squares of ``y`` on each covariate by itself; flat covariates are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("covariate"), F.col(c).cast("double").alias("x")) for c in x_cols])
    long = df.select(*(by or []), F.col(y).cast("double").alias("y"), F.explode(pairs).alias("p")).select(*(by or []), "p.covariate", "p.x", "y")
    out = long.filter("x is not null and y is not null").groupBy(*(by or []), "covariate").agg(
        F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("__vx"), F.regr_slope("y", "x").alias("slope"),
        F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))
    return out.filter(F.col("__vx") > 1e-12).drop("__vx")


def fit_translation(pairs: DataFrame, by: list[str], min_n: int = 3, width: float = 0.25) -> DataFrame:
    """Mean shift from (ax, ay) to (bx, by_) per group with residual p50 and p90."""
    shift = (pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("bx") - F.col("ax")).alias("dx"),
                                    F.avg(F.col("by_") - F.col("ay")).alias("dy")).filter(F.col("n") >= min_n))
    rest = pairs.join(shift.select(*by, "dx", "dy"), by).withColumn(
        "resid", F.hypot(F.col("ax") + F.col("dx") - F.col("bx"), F.col("ay") + F.col("dy") - F.col("by_")))
    p = percentiles(rest, by, "resid", {"resid_p50": (0.5, "nearest"), "resid_p90": (0.9, "nearest")})
    return shift.join(p, by)


def fit_similarity(pairs: DataFrame, by: list[str], min_n: int = 3, width: float = 0.25) -> DataFrame:
    """Best rotation, scale and shift in the plane from sums of products, with residuals."""
    m = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("ax").alias("max"), F.avg("ay").alias("may"), F.avg("bx").alias("mbx"), F.avg("by_").alias("mby"),
        F.var_pop("ax").alias("vax"), F.var_pop("ay").alias("vay"), F.covar_pop("ax", "bx").alias("xx"), F.covar_pop("ay", "by_").alias("yy"),
        F.covar_pop("ax", "by_").alias("xy"), F.covar_pop("ay", "bx").alias("yx")).filter(F.col("n") >= min_n)
    dot, cross = F.col("xx") + F.col("yy"), F.col("xy") - F.col("yx")
    var = F.col("vax") + F.col("vay")
    fit = m.filter(var > 1e-12).select(
        *by, "n", F.atan2(cross, dot).alias("theta"), (F.sqrt(dot * dot + cross * cross) / var).alias("scale"), "max", "may", "mbx", "mby")
    ux, uy = F.col("ax") - F.col("max"), F.col("ay") - F.col("may")
    c, s = F.cos("theta") * F.col("scale"), F.sin("theta") * F.col("scale")
    rest = pairs.join(fit.drop("n"), by).withColumn(
        "resid", F.hypot(ux * c - uy * s + F.col("mbx") - F.col("bx"), ux * s + uy * c + F.col("mby") - F.col("by_")))
    p = percentiles(rest, by, "resid", {"resid_p50": (0.5, "nearest"), "resid_p90": (0.9, "nearest")})
    return fit.withColumn("rotation_deg", F.degrees("theta")).drop("theta", "max", "may", "mbx", "mby").join(p, by)


def direction_concentration(vectors: DataFrame, dx: str, dy: str, by: list[str] | None = None) -> DataFrame:
    """Length of the mean unit vector: 1 all agree, 0 no common direction."""
    d = F.hypot(F.col(dx), F.col(dy))
    unit = vectors.filter(d > 1e-9).select(*(by or []), (F.col(dx) / d).alias("ux"), (F.col(dy) / d).alias("uy"))
    out = (unit.groupBy(*by) if by else unit).agg(F.hypot(F.avg("ux"), F.avg("uy")).alias("r"), F.count(F.lit(1)).alias("n"))
    # fixed values: agreement bands
    return out.withColumn("label", F.when(F.col("r") > 0.8, "coherent").when(F.col("r") >= 0.5, "mixed").otherwise("scattered"))


def confusion(pred: DataFrame, truth: DataFrame, exclude: DataFrame | None = None) -> DataFrame:
    """TP/TN/FP/FN of labelled bays with accuracy, precision and recall; labelled but unseen bays counted apart."""
    t = truth.filter("gt is not null").select("bay_id", "gt")
    if exclude is not None:
        t = t.join(exclude.select("bay_id").distinct(), "bay_id", "left_anti")
    joined = t.join(pred.select("bay_id", "occupied"), "bay_id", "left")
    return score(joined.agg(*confusion_counts()))


def confusion_counts(pred: str = "occupied", gt: str = "gt") -> list[Column]:
    p, g = F.col(pred), F.col(gt)
    return [count_if(p & g).alias("tp"), count_if(~p & ~g).alias("tn"), count_if(p & ~g).alias("fp"), count_if(~p & g).alias("fn"),
            count_if(p.isNull()).alias("unseen")]


def score(counts: DataFrame) -> DataFrame:
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return counts.withColumns({
        "accuracy": F.round(ratio(F.col("tp") + F.col("tn"), n), 4),
        "precision": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4),
        "recall": F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4)})


def count_errors(pairs: DataFrame, pred: str, gt: str, by: list[str] | None = None) -> DataFrame:
    """Total, mean absolute error, bias and share within one of predicted counts."""
    err = F.col(pred) - F.col(gt)
    src = pairs.filter(F.col(gt).isNotNull() & F.col(pred).isNotNull())
    return (src.groupBy(*by) if by else src).agg(
        F.count(F.lit(1)).alias("segments"), F.sum(pred).cast("bigint").alias("predicted"), F.sum(gt).cast("bigint").alias("counted"),
        F.round(F.avg(F.abs(err)), 3).alias("mae"), F.round(F.avg(err), 3).alias("bias"), count_if(F.abs(err) <= 1).alias("within_1"))


def majority_attr(df: DataFrame, key: list[str], attr: str) -> DataFrame:
    """Most common non-NULL value per group; ties to the least value."""
    n = df.filter(F.col(attr).isNotNull()).groupBy(*key, attr).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*key).agg(F.min_by(attr, F.struct(-F.col("__n"), F.col(attr))).alias(attr))


def profile(df: DataFrame, cols: list[str], top: int = 10) -> DataFrame:
    """Most frequent values per attribute with the attribute's coverage."""
    pairs = F.array(*[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in cols])
    counts = df.select(F.explode(pairs).alias("p")).groupBy("p.attribute", "p.value").agg(F.count(F.lit(1)).alias("n"))
    tagged = counts.groupBy("attribute").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("tagged"),
                                             F.sum("n").cast("bigint").alias("total"))
    from .scan import top_per_key

    best = top_per_key(counts.filter("value is not null"), ["attribute"], [F.col("n").desc(), F.col("value")], top, F.col("value"))
    return best.join(tagged, "attribute")


def field_presence(df: DataFrame, cols: list[str]) -> DataFrame:
    """Per column: rows with a value and ``ok``, ``partial`` or ``MISSING``."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in cols])
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("present")) for c in cols])
    return counts.select(F.explode(pairs).alias("p"), F.col("__n").alias("total")).select(
        "p.field", "p.present", "total",
        F.when(F.col("p.present") == 0, "MISSING").when(F.col("p.present") < F.col("total"), "partial").otherwise("ok").alias("status"))
