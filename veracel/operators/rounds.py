"""Sampling for rounds, scorers over repeats, memory upkeep and rule checks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import hash_fraction, hash_int
from . import metrics as M

# Outputs at the edge of what a scorer should take.
EDGE_OUTPUTS = (
    "", "A" * 5000, "Output with\x00null\x00bytes and \ttabs\t and special chars: <>\"'&;", "   ", "\n\n\n",
    "123.456.789.0 SELECT * FROM users WHERE 1=1; DROP TABLE--",
)
# Two-sided 95 % quantiles of Student's t for 1 to 10 degrees of freedom.
T95 = (12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157, 2.228139)
NORMAL95 = 1.959964


def adversarial_rows(rounds: DataFrame, n: int = 2) -> DataFrame:
    """round, sample_id, output: n rows of edge outputs per round, chosen by a hash."""
    each = rounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    pick = (hash_int(F.concat_ws(":", (F.col("round") + 9999).cast("string"), F.col("i").cast("string"))) % len(EDGE_OUTPUTS) + 1).cast("int")
    return each.select("round", F.concat_ws("_", F.lit("adv"), F.col("round").cast("string"), F.col("i").cast("string")).alias("sample_id"), F.element_at(F.array(*map(F.lit, EDGE_OUTPUTS)), pick).alias("output"))


def interval(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Mean of repeats and its 95 % interval; the interval is the mean where all repeats agree."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.count(F.lit(1)).alias("n"))
    t = F.coalesce(F.try_element_at(F.array(*map(F.lit, T95)), F.greatest(F.col("n") - 1, F.lit(1)).cast("int")), F.lit(NORMAL95))
    half = F.when(F.col("std") == 0, 0.0).otherwise(t * F.col("std") / F.sqrt("n"))
    return g.select(*keys, "mean", "std", "n", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def broken_rules(df: DataFrame, rules: dict[str, Column], *keys: str) -> DataFrame:
    """One row per row and rule that it breaks."""
    told = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(*keys, F.explode(told).alias("rule"))


def keep_best(df: DataFrame, n: int, by: str, tie: str, *keys: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), tie)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= n).drop("__k")


def decayed(memory: DataFrame, wrong: Column, factor: float = 0.9, least: float = 0.1) -> DataFrame:
    """Outcomes of wrong memories decay; those below the least go."""
    return memory.withColumn("outcome", F.when(wrong, F.col("outcome") * factor).otherwise(F.col("outcome"))).where(F.col("outcome") >= least)


def clones(memory: DataFrame, key: str, value: str, n: int = 2, sigma: float = 0.05) -> DataFrame:
    """n jittered copies of each memory, the jitter from a hash in place of a random draw, cut to [0, 1]."""
    each = memory.withColumn("clone", F.explode(F.sequence(F.lit(1), F.lit(n))))
    jitter = (hash_fraction(F.concat_ws(":", F.col(key).cast("string"), F.col("clone").cast("string"))) - 0.5) * 2 * sigma
    return each.withColumn(value, M.clip(F.col(value) + jitter))


def variance_parts(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Variance between keys' means and the mean variance within them."""
    g = df.groupBy(*keys).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    return g.agg(F.var_pop("m").alias("between"), F.avg("v").alias("within"), F.count(F.lit(1)).alias("groups"))
