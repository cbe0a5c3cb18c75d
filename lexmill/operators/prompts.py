"""Prompt variants: their health as a fold over the log of their use, and which one to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Failures in a row that take a prompt out and that degrade it, seconds until it comes back, and requests remembered.
MOST_FAILURES, SOME_FAILURES, RETURN_AFTER, REMEMBERED = 2, 1, 15 * 60, 20
HEALTH = "status string, total_requests long, success_count long, failure_count long, consecutive_failures long, average_response_time double"


class Health:
    """What is known of one prompt.  A request, or a look at the clock, moves it on."""

    def __init__(self) -> None:
        self.status, self.total, self.good, self.bad, self.row, self.average = "healthy", 0, 0, 0, 0, 0.0
        self.out_at = 0.0
        self.recent: list[tuple[bool, float]] = []

    def at(self, now: float) -> None:
        """A prompt that was taken out long enough ago is tried again."""
        if self.status == "deactivated" and now - self.out_at >= RETURN_AFTER:
            self.status, self.row = "degraded", 0

    def used(self, now: float, success: bool, seconds: float) -> None:
        self.total += 1
        self.recent = [*self.recent, (success, seconds)][-REMEMBERED:]
        if success:
            self.good, self.row = self.good + 1, 0
            times = [t for ok, t in self.recent if ok and t > 0]
            if seconds > 0 and times:
                self.average = sum(times) / len(times)
            self.status = "healthy" if self.status == "degraded" else self.status
        else:
            self.bad, self.row = self.bad + 1, self.row + 1
            if self.row >= MOST_FAILURES:
                self.status, self.out_at = "deactivated", now
            elif self.row >= SOME_FAILURES:
                self.status = "degraded"


def health(log: DataFrame, key: str = "prompt_id", now: float | None = None) -> DataFrame:
    """(key, status, ...) after a log (key, at timestamp, event_id, success boolean, seconds double), and after a look at the clock at ``now`` (seconds) if that is given.

    The clock is looked at before each request.  The fold is windows over runs of failures.  Within a run a prompt has
    failed once or more often since it last came back; a failure after a long pause takes more often back to once,
    every other one gives more often, so how the pauses since the last short one alternate tells which.
    """
    order = Window.partitionBy(key).orderBy("now", "event_id")
    rows = log.select(key, (F.unix_micros("at") / 1e6).alias("now"), "event_id", F.coalesce("success", F.lit(False)).alias("ok"), F.coalesce("seconds", F.lit(0.0)).alias("seconds"))
    rows = rows.withColumns({"i": F.row_number().over(order), "before": F.lag("now").over(order)})
    rows = rows.withColumn("run", F.sum(F.col("ok").cast("int")).over(Window.partitionBy(key).orderBy("i")))
    # the row that a run of failures follows has its number too
    run = Window.partitionBy(key, "run", "ok").orderBy("i")
    rows = rows.withColumn("nth", F.row_number().over(run)).withColumn("paused", (F.col("nth") > 1) & (F.col("now") - F.col("before") >= RETURN_AFTER))
    short = F.max(F.when(~F.col("paused"), F.col("i"))).over(run)
    rows = rows.withColumns({"short": short, "pauses": F.sum(F.col("paused").cast("int")).over(run)})
    since = F.col("pauses") - F.first("pauses").over(Window.partitionBy(key, "run", "ok", "short").orderBy("i"))
    # the run's first failure is a first one, a later one after a short pause is a further one
    start = F.when(F.first("nth").over(Window.partitionBy(key, "run", "ok", "short").orderBy("i")) == 1, 1).otherwise(2)
    # a pause counts only for what has failed more than once, so a run that begins with one goes to more often first
    rows = rows.withColumn("often", (start + since) % 2 == 0)
    once = F.max(F.when(~F.col("often"), F.col("i"))).over(run)
    rows = rows.withColumn("row", F.when(F.col("ok"), 0).otherwise(F.col("i") - once + 1))
    recent = Window.partitionBy(key).orderBy("i").rowsBetween(-(REMEMBERED - 1), 0)
    good = F.when(F.col("ok") & (F.col("seconds") > 0), F.col("seconds"))
    rows = rows.withColumn("mean", F.when(good.isNotNull(), F.avg(good).over(recent)))
    last = lambda c: F.max_by(c, "i")
    out = rows.groupBy(key).agg(
        F.count("*").alias("total_requests"), F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok")).alias("failure_count"), last("row").alias("row"), last("ok").alias("ok"), F.max("now").alias("end"),
        F.max_by("row", F.when(~F.col("ok"), F.col("i"))).alias("failed_row"), F.max(F.when(~F.col("ok"), F.col("now"))).alias("out_at"), F.max_by("mean", F.when(F.col("mean").isNotNull(), F.col("i"))).alias("mean"),
    )
    out = out.withColumn("out", F.coalesce(F.col("failed_row") >= MOST_FAILURES, F.lit(False)))
    status = F.when(F.col("ok"), F.when(F.col("out") & (F.col("end") - F.col("out_at") < RETURN_AFTER), "deactivated").otherwise("healthy")).otherwise(F.when(F.col("out"), "deactivated").otherwise("degraded"))
    row = F.col("row")
    out = out.withColumn("status", status)
    if now is not None:
        back = (F.col("status") == "deactivated") & (F.lit(now) - F.col("out_at") >= RETURN_AFTER)
        out, row = out.withColumn("back", back), F.when(F.col("back"), 0).otherwise(F.col("row"))
        out = out.withColumn("status", F.when(F.col("back"), "degraded").otherwise(F.col("status")))
    return out.select(key, "status", "total_requests", "success_count", "failure_count", row.cast("long").alias("consecutive_failures"), F.coalesce("mean", F.lit(0.0)).alias("average_response_time"))


def running(rows: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``nth``, their place in their group, and ``sum``, the values up to there added up one after the other.

    The last sum of a group does not hang on how rows are partitioned, as a sum of partial sums does.
    """
    window = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumns({"nth": F.row_number().over(window), "sum": F.sum(value).over(window.rowsBetween(Window.unboundedPreceding, 0))})


def selected(prompts: DataFrame, by: str = "user_id") -> DataFrame:
    """(by, prompt_id): of each user's usable prompts (by, prompt_id, place, user_selected, status, total_requests, success_count) the one to take.

    Those that the user selected, or all if none of these is usable; healthy ones by success rate (1 without requests),
    else degraded ones by successes; the first by place among equals.
    """
    usable = prompts.where(F.col("status").isin("healthy", "degraded"))
    chosen = F.max(F.col("user_selected").cast("int")).over(Window.partitionBy(by))
    rows = usable.withColumn("chosen", chosen).where((F.col("chosen") == 0) | F.col("user_selected"))
    sound = F.col("status") == "healthy"
    rate = F.when(F.col("total_requests") > 0, F.col("success_count") / F.col("total_requests")).otherwise(1.0)
    order = Window.partitionBy(by).orderBy(sound.desc(), F.when(sound, rate).otherwise(F.col("success_count")).desc(), "place")
    return rows.withColumn("n", F.row_number().over(order)).where("n = 1").select(by, "prompt_id")
