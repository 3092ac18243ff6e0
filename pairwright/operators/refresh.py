"""When reviewing can stop: the rate of reviews that change something, and what it foretells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def manual(reviews: DataFrame) -> DataFrame:
    """(seq, m): the reviews by people in their order, and whether each changed something."""
    rows = reviews.where(~F.col("user_id").startswith("algo"))
    return rows.select(F.col("review_id").alias("seq"), F.col("meaningful").cast("int").alias("m"))


def ewma(reviews: DataFrame, window: int = 20, start: float = 1.0) -> DataFrame:
    """(n, mu): how many manual reviews there are and their moving average, newest first in weight.

    The closed form is a sum, so it is one aggregation over the log; positions come from counts
    of ranges of ids, not from one sorted task.
    """
    alpha = 2.0 / (window + 1)
    rows = _newest_first(manual(reviews))
    weight = F.pow(F.lit(1 - alpha), F.col("age").cast("double"))
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.when(F.col("m") == 1, weight)).alias("s"))
    return sums.select("n", (start * F.pow(F.lit(1 - alpha), F.col("n").cast("double")) + alpha * F.coalesce("s", F.lit(0.0))).alias("mu"))


#: Ranges of review ids that are counted apart.
RANGES = 4096


def _newest_first(rows: DataFrame) -> DataFrame:
    """Rows (seq, m) with ``age``: how many of them are newer. No task sees more than one range of ids."""
    ends = rows.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    width = max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // RANGES))
    rows = rows.withColumn("r", F.floor((F.col("seq") - (ends["lo"] or 0)) / width))
    sizes = rows.groupBy("r").agg(F.count("*").alias("n"))
    later = sizes.select("r", (F.sum("n").over(Window.orderBy(F.desc("r"))) - F.col("n")).alias("later"))
    inside = F.row_number().over(Window.partitionBy("r").orderBy(F.desc("seq"))) - 1
    return rows.withColumn("i", inside).join(later, "r").select("seq", "m", (F.col("later") + F.col("i")).alias("age"))


def window_mean(reviews: DataFrame, window: int = 20) -> DataFrame:
    """(pos_frac): mean of the last ``window`` manual reviews."""
    return manual(reviews).orderBy(F.desc("seq")).limit(window).agg(F.avg("m").alias("pos_frac"))


def prob_any(mu: Column, patience: int = 72, method: str = "binomial") -> Column:
    """That any of the next ``patience`` reviews changes something."""
    return 1 - F.pow(1 - mu, F.lit(float(patience))) if method == "binomial" else 1 - F.exp(-mu * patience)


def stop(reviews: DataFrame, window: int = 20, patience: int = 72, thresh: float = 0.052, method: str = "binomial") -> DataFrame:
    """(n, mu, p_any, done)."""
    rows = ewma(reviews, window).withColumn("p_any", prob_any(F.col("mu"), patience, method))
    return rows.withColumn("done", F.col("p_any") < thresh)


def predicted(reviews: DataFrame, n_remaining: int, window: int = 20) -> DataFrame:
    """(n, mu, n_predicted): of so many reviews to come, how many will change something at the present rate."""
    return ewma(reviews, window).withColumn("n_predicted", F.col("mu") * n_remaining)


def blocks(log: DataFrame, state: str, order: str = "seq", by: str | None = None) -> DataFrame:
    """Runs of equal ``state`` in the order of the log: (first, last, n, state), within each ``by``."""
    part = [by] if by else []
    w = Window.partitionBy(*part).orderBy(order)
    new = F.when(F.lag(state).over(w).eqNullSafe(F.col(state)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    rows = log.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    return rows.groupBy(*part, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.first(state).alias(state)).drop("_run")
