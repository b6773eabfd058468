"""Synthetic load: records that are a function of their number, and the times at which to send them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words by falling frequency.  The published searches look for the first, which is in most messages, and the last, which is rare.
WORDS = (
    "request", "apple", "barrel", "basket", "bellows", "bottle", "branch", "bucket", "candle", "carriage", "cellar", "cherry", "cider", "clay",
    "copper", "cork", "crate", "dairy", "ditch", "fence", "ferry", "flour", "furrow", "garden", "gate", "glass", "grain", "granite", "harbor",
    "harvest", "hedge", "honey", "horse", "kettle", "ladder", "lantern", "lemon", "linen", "meadow", "mill", "mortar", "mushroom", "needle",
    "nettle", "orchard", "oven", "pasture", "pepper", "plough", "plum", "pottery", "quarry", "rope", "saddle", "sickle", "stable", "timber",
    "vinegar", "wagon", "walnut", "willow", "window", "yard", "corrupt",
)
#: The cycle of levels (debug, three times info, warn, error).
LEVELS = (2, 3, 3, 3, 4, 5)
SKEW = 1.1


def _word(draw: Column) -> Column:
    """A word by its Zipf probability, from a number between 0 and 1."""
    weights = [(k + 1) ** -SKEW for k in range(len(WORDS))]
    total, run, edges = sum(weights), 0.0, []
    for w in weights[:-1]:
        run += w / total
        edges.append(run)
    return F.get(F.array(*map(F.lit, WORDS)), F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= draw)))


def records(spark: SparkSession, n: int, batch: int = 500, streams: int = 64, size: int = 200, env: str = "load", start: str = "2024-01-01 00:00:00") -> DataFrame:
    """n records: seq, its batch's stream in turn, levels in a cycle, and a message of `size` characters that only seq decides."""
    seq = F.col("id")
    stream = (F.floor(seq / batch) % streams).cast("string")
    head = F.concat(F.lit("synthetic record seq="), seq.cast("string"))
    count = -(-size // 3)  # words are two letters or more, and a space
    draws = F.transform(F.sequence(F.lit(0), F.lit(count)), lambda k: F.pmod(F.xxhash64(F.col("id"), k), F.lit(1 << 30)) / F.lit(float(1 << 30)))
    message = F.substring(F.concat_ws(" ", head, F.array_join(F.transform(draws, _word), " ")), 1, size)
    return spark.range(n).select(
        (F.lit(start).cast("timestamp") + F.make_dt_interval(secs=(seq / 1000).cast("decimal(18,6)"))).alias("time"), seq.alias("seq"),
        F.get(F.array(*map(F.lit, LEVELS)), (seq % len(LEVELS)).cast("int")).cast("short").alias("level"),
        F.when(F.length(head) >= size, head).otherwise(message).alias("message"),
        F.concat(F.lit("loadgen-svc-"), stream).alias("service"), F.concat(F.lit("loadgen-host-"), stream).alias("host"), F.lit(env).alias("env"),
    )


def release_at(n: Column, rate: float, ramp: float) -> Column:
    """Seconds after the start at which record n may go: the rate grows linearly during the ramp and is constant after it."""
    if rate <= 0:
        return F.lit(0.0)
    in_ramp = rate * ramp / 2
    return F.when(n < in_ramp, F.sqrt(2 * n * ramp / rate)).otherwise(F.lit(ramp) + (n - in_ramp) / rate)
