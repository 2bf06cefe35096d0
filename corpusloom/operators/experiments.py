"""Experiments: deterministic assignment, results, and comparisons of variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.percentiles import index_percentiles
from corpusloom.functions.stats import erfc, student_two_sided

LOWER_IS_BETTER = ("latency", "latency_ms", "response_time")
FEEDBACK = ("feedback_positive", "feedback_negative")
#: The status changes that are allowed.
TRANSITIONS = (("draft", "running"), ("draft", "completed"), ("running", "paused"), ("running", "completed"), ("paused", "running"), ("paused", "completed"))


def _word(key: Column, i: int) -> Column:
    return F.conv(F.substring(F.md5(key.cast("binary")), 8 * i + 1, 8), 16, 10).cast("long")


def bucket(session: Column, n: int = 100) -> Column:
    """The first four bytes of the MD5, big-endian, modulo n."""
    return _word(session, 0) % n


def bucket128(session: Column, n: int = 100) -> Column:
    """The whole MD5 as a number modulo n, word by word."""
    step, rest = (1 << 32) % n, F.lit(0).cast("long")
    for i in range(4):
        rest = (rest * step + _word(session, i)) % n
    return rest


def pick_variant(split: Column, place: Column, fallback: str = "last") -> Column:
    """The first variant of an ordered array of struct(variant_id, pct) whose running percentage exceeds place."""
    state = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("string").alias("pick"))

    def step(acc: Column, v: Column) -> Column:
        total = acc["sum"] + v["pct"]
        return F.struct(total.alias("sum"), F.coalesce(acc["pick"], F.when(place < total, v["variant_id"])).alias("pick"))

    picked = F.aggregate(split, state, step, lambda acc: acc["pick"])
    rest = F.element_at(split, -1 if fallback == "last" else 1)["variant_id"]
    return F.coalesce(picked, F.when(F.size(split) > 0, rest))


def assign(sessions: DataFrame, experiments: DataFrame, existing: DataFrame, rule: str = "service") -> DataFrame:
    """(experiment_id, session_id, variant_id, is_new) for sessions of running experiments. An existing assignment wins.

    rule: "service" takes the first word of the hash and the last variant if none fits, "api" the whole hash and the first."""
    key = F.col("session_id")
    place, fallback = (bucket(key), "last") if rule == "service" else (bucket128(key), "first")
    live = experiments.filter("status = 'running'").select("experiment_id", "traffic_split")
    old = existing.select("experiment_id", "session_id", F.col("variant_id").alias("_old"))
    return (
        sessions.join(live, "experiment_id")
        .join(old, ["experiment_id", "session_id"], "left")
        .select(
            "experiment_id", "session_id", F.coalesce("_old", pick_variant(F.col("traffic_split"), place, fallback)).alias("variant_id"),
            F.col("_old").isNull().alias("is_new"),
        )
    )


def list_experiments(experiments: DataFrame, status: str | None = None, kind: str | None = None, page: int = 1, page_size: int = 20) -> DataFrame:
    """A page of experiments, newest first."""
    own = experiments if status is None else experiments.filter(F.col("status") == status)
    own = own if kind is None else own.filter(F.col("type") == kind)
    return own.orderBy(F.col("created_at").desc(), "experiment_id").offset((page - 1) * page_size).limit(page_size)


def active_by_type(experiments: DataFrame) -> DataFrame:
    """The oldest running experiment of each type."""
    oldest = Window.partitionBy("type").orderBy("created_at", "experiment_id")
    return experiments.filter("status = 'running'").withColumn("_n", F.row_number().over(oldest)).filter("_n = 1").drop("_n")


def record_results(calls: DataFrame) -> DataFrame:
    """calls (experiment_id, variant, session_id, latency_ms, helpful) to rows (…, metric_name, metric_value): a latency
    row for each latency, and one feedback row of value 1 for each helpful flag."""
    helpful = F.when(F.col("helpful"), FEEDBACK[0]).otherwise(FEEDBACK[1])
    rows = F.array(
        F.when(F.col("latency_ms").isNotNull(), F.struct(F.lit("latency_ms").alias("metric_name"), F.col("latency_ms").cast("double").alias("metric_value"))),
        F.when(F.col("helpful").isNotNull(), F.struct(helpful.alias("metric_name"), F.lit(1.0).alias("metric_value"))),
    )
    return calls.select("experiment_id", "variant", "session_id", F.explode(F.array_compact(rows)).alias("m")).select(
        "experiment_id", "variant", "session_id", "m.*"
    )


def variant_stats(results: DataFrame, metric: str = "latency_ms") -> DataFrame:
    x = F.col("metric_value")
    return results.filter(F.col("metric_name") == metric).groupBy("variant").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")
    )


def variant_report(results: DataFrame, success_metric: str = "latency_ms") -> DataFrame:
    """Per variant: pooled non-feedback values, conversions (values above 0), feedback shares, hours between the first
    and last row; latency columns if the success metric is a latency."""
    plain = ~F.col("metric_name").isin(*FEEDBACK)
    x = F.when(plain, F.col("metric_value"))
    positive, negative = (F.count_if(F.col("metric_name") == f) for f in FEEDBACK)
    report = results.groupBy("variant").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"),
        F.count_if(x > 0).alias("conversions"), positive.alias("positive"), negative.alias("negative"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3.6e9).alias("hours"),
    )
    report = report.withColumn("conversion_rate", F.when(F.col("n") > 0, F.col("conversions") / F.col("n")).otherwise(0.0)).withColumn(
        "positive_rate", F.when(F.col("positive") + F.col("negative") > 0, F.col("positive") / (F.col("positive") + F.col("negative")))
    )
    if success_metric != "latency_ms":
        return report
    tail = index_percentiles(results.filter(plain), "metric_value", {"p50": 0.5, "p95": 0.95}, ["variant"])
    return report.join(tail, "variant", "left")


def moments(results: DataFrame, metric: str = "latency_ms") -> DataFrame:
    x = F.col("metric_value")
    return results.filter(F.col("metric_name") == metric).groupBy("variant").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var")
    )


def against(stats: DataFrame, control: str) -> DataFrame:
    """Each other variant beside the control: columns n, mean, var and n0, mean0, var0."""
    base = stats.filter(F.col("variant") == control).select(F.col("n").alias("n0"), F.col("mean").alias("mean0"), F.col("var").alias("var0"))
    return stats.filter(F.col("variant") != control).join(F.broadcast(base))  # one row


def welch_test(stats: DataFrame, control: str, with_p: bool = True) -> DataFrame:
    """t, Welch-Satterthwaite df and a two-sided p of every variant against the control; nulls if either n is below 2.

    p is erfc(t / sqrt 2) above 100 degrees, 1 at one degree or fewer or without spread, and else a scaled normal tail."""
    a, b = F.col("var0") / F.col("n0"), F.col("var") / F.col("n")
    se = F.sqrt(a + b)
    t = F.when(se > 0, F.abs(F.col("mean0") - F.col("mean")) / se)
    df = F.when(se > 0, (a + b) * (a + b) / (a * a / (F.col("n0") - 1) + b * b / (F.col("n") - 1)))
    enough = (F.col("n") >= 2) & (F.col("n0") >= 2)
    rows = against(stats, control).select(
        "variant", "n", "n0", "mean", "mean0", F.when(enough, t).alias("t"), F.when(enough, df).alias("df"), (enough & (se == 0)).alias("_flat"), enough.alias("_ok")
    )
    if with_p:
        z = F.when(F.col("df") > 100, F.col("t") / 2**0.5).when(F.col("df") > 1, F.col("t") / 2**0.5 / (1 + 1 / (4 * F.col("df"))))
        rows = rows.withColumn("_z", z).withColumn("_tail", erfc("_z"))
        p = F.when(F.col("_flat") | (F.col("df") <= 1), 1.0).otherwise(F.col("_tail"))
        rows = rows.withColumn("p_value", F.when(F.col("_ok"), p)).drop("_z", "_tail")
    return rows.drop("_flat", "_ok")


def student_test(stats: DataFrame, control: str, with_p: bool = True) -> DataFrame:
    """Pooled-variance t and exact p, a 95 % interval from the unpooled error, relative difference, and adequacy (30 each)."""
    n, n0 = F.col("n"), F.col("n0")
    pooled = ((n0 - 1) * F.col("var0") + (n - 1) * F.col("var")) / (n + n0 - 2)
    se = F.sqrt(pooled * (1 / n + 1 / n0))
    diff = F.col("mean") - F.col("mean0")
    margin = F.sqrt(F.col("var") / n + F.col("var0") / n0) * 1.96
    ok = (n >= 2) & (n0 >= 2)
    rows = against(stats, control).select(
        "variant", "n", "n0", diff.alias("difference"), F.when(F.col("mean0") != 0, diff / F.abs("mean0")).alias("relative"),
        F.when(ok & (se > 0), diff / se).alias("t"), (n + n0 - 2).cast("double").alias("df"),
        F.when(ok, diff - margin).alias("ci_low"), F.when(ok, diff + margin).alias("ci_high"), ((n >= 30) & (n0 >= 30)).alias("adequate"),
    )
    return rows.withColumn("p_value", student_two_sided("t", "df")) if with_p else rows


def recommend(tests: DataFrame, metric: str = "latency_ms", alpha: float = 0.05, least: int = 30) -> DataFrame:
    """Rows of welch_test with winner ("control", the variant, or null), improvement in percent, and a text."""
    better = F.col("mean") < F.col("mean0") if metric in LOWER_IS_BETTER else F.col("mean") > F.col("mean0")
    sure = F.col("p_value") < alpha
    few = (F.col("n") < least) | (F.col("n0") < least) | F.col("p_value").isNull()
    change = F.when(F.col("mean0") != 0, F.abs(F.col("mean") - F.col("mean0")) / F.abs("mean0") * 100)
    winner = F.when(~few & sure, F.when(better, F.col("variant")).otherwise("control"))
    text = (
        F.when(few, F.lit("More data needed before a decision."))
        .when(~sure, F.format_string("No significant difference (p = %.3f).", F.col("p_value")))
        .otherwise(F.format_string("%s is better by %.1f%% (p = %.3f).", winner, F.coalesce(change, F.lit(0.0)), F.col("p_value")))
    )
    return tests.withColumn("winner", winner).withColumn("improvement", F.when(winner.isNotNull(), change)).withColumn("recommendation", text)


def normalize_split(split: Column) -> Column:
    """An ordered array of struct(variant_id, weight) as struct(variant_id, pct): percentages; equal shares for a total of 0."""
    total = F.aggregate(split, F.lit(0.0), lambda a, v: a + v["weight"].cast("double"))
    return F.transform(
        split, lambda v: F.struct(v["variant_id"].alias("variant_id"), F.when(total > 0, v["weight"] / total * 100).otherwise(100.0 / F.size(split)).alias("pct"))
    )


def check_transitions(log: DataFrame) -> DataFrame:
    """Rows of a status log (experiment_id, status, ts) whose change from the row before is not allowed; a first row may
    have any status, and a repeated one is no change."""
    before = Window.partitionBy("experiment_id").orderBy("ts", "status")
    allowed = F.lit(False)
    for a, b in TRANSITIONS:
        allowed = allowed | ((F.col("previous") == a) & (F.col("status") == b))
    return log.withColumn("previous", F.lag("status").over(before)).filter(
        F.col("previous").isNotNull() & (F.col("previous") != F.col("status")) & ~allowed
    )


def status_times(log: DataFrame) -> DataFrame:
    """First time running and first time completed of each experiment."""
    return log.groupBy("experiment_id").agg(
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(F.col("status") == "completed", F.col("ts"))).alias("ended_at")
    )


def repeated_names(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
