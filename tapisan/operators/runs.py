"""The run log: aliases, states, roll-ups, checkpoints, telemetry, schedule."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapisan.config import written

TERMINAL = ("SUCCESS", "FAILED_PERMANENT")


def none(c: str) -> Column:
    """A count or duration that isn't there."""
    return F.coalesce(F.col(c), F.lit(0)) == 0


def sync_fields(runs: DataFrame) -> DataFrame:
    """Aliases filled from each other, in an order in which later steps see earlier ones; other nulls become '' or 0."""
    has = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    no_text = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def pair(df: DataFrame, a: str, b: str) -> DataFrame:
        df = df.withColumn(a, F.when(none(a) & has(b), F.col(b)).otherwise(F.coalesce(F.col(a), F.lit(0))))
        return df.withColumn(b, F.when(none(b) & has(a), F.col(a)).otherwise(F.coalesce(F.col(b), F.lit(0))))

    for a, b in (("id", "history_id"), ("source", "trusted_source")):
        runs = runs.withColumn(a, F.when(no_text(a), F.coalesce(F.col(b), F.lit(""))).otherwise(F.col(a)))
        runs = runs.withColumn(b, F.when(no_text(b), F.col(a)).otherwise(F.col(b)))
    runs = pair(pair(runs, "target_articles", "limit_n"), "discovered_articles", "total_crawled")
    runs = runs.withColumn("saved_articles", F.when(none("saved_articles"), F.when(has("total_new"), F.col("total_new")).otherwise(F.coalesce("total_success", F.lit(0)))).otherwise(F.col("saved_articles")))
    for c, source in (("total_success", "saved_articles"), ("total_new", "saved_articles"), ("valid_articles", "total_success")):
        runs = runs.withColumn(c, F.when(none(c), F.greatest(F.col(source), F.lit(0))).otherwise(F.col(c)))
    return pair(pair(pair(runs, "duplicate_articles", "total_duplicate"), "invalid_articles", "total_failed"), "duration", "duration_sec")


def latest_state(runs: DataFrame) -> DataFrame:
    """One row of each run: the one updated last, then the one with more done; a hash aggregate, no sort of whole groups."""
    best = F.max_by(F.struct(*runs.columns), F.struct(F.coalesce(F.col("updated_at"), F.col("created_at")), F.coalesce(F.col("total_crawled"), F.lit(-1)), F.coalesce(F.col("status"), F.lit(""))))
    return runs.filter("id is not null").groupBy(F.col("id").alias("_id")).agg(best.alias("r")).select("r.*")


def run_days(runs: DataFrame) -> DataFrame:
    """Runs of each day of their start: number, items (new ones, else successes), ids from the newest."""
    items = F.when(F.coalesce("total_new", F.lit(0)) > 0, F.col("total_new")).otherwise(F.coalesce("total_success", F.lit(0)))
    newest = F.array_sort(F.collect_list(F.struct("started_at", "run_number", "id")), lambda x, y: F.when(x > y, -1).when(x < y, 1).otherwise(0))
    out = runs.filter("started_at is not null").groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("runs_count"), F.sum(items).alias("total_items"), F.transform(newest, lambda x: x["id"]).alias("run_ids"))
    return out.withColumn("display", F.date_format("day", "dd MMMM yyyy"))


def newest_first(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_number").desc())


def source_status(success: Column, failed: Column, status: Column, target: Column) -> Column:
    return F.when(status == "FAILED", "FAILED").when(success >= target, "SUCCESS").when(success > 0, "PARTIAL").otherwise("NO_NEW_ARTICLES")


def run_status(stats: Column) -> Column:
    """Of a map of source statistics: PARTIAL_SUCCESS if some source failed and some succeeded, FAILED if only failures, else COMPLETED."""
    values = F.map_values(stats)
    failed = F.exists(values, lambda s: (s["status"] == "FAILED") | ((s["failed"] > 0) & (s["success"] == 0)))
    good = F.exists(values, lambda s: (s["status"] == "SUCCESS") | (s["success"] > 0))
    failed, good = F.coalesce(failed, F.lit(False)), F.coalesce(good, F.lit(False))
    return F.when(failed & good, "PARTIAL_SUCCESS").when(failed, "FAILED").otherwise("COMPLETED")


def checkpoint_counts(tasks: DataFrame) -> DataFrame:
    s = F.coalesce(F.col("status"), F.lit("PENDING"))
    return tasks.agg(F.count_if(s == "SUCCESS").alias("completed"), F.count_if(s == "FAILED_PERMANENT").alias("failed"), F.count_if(s == "RUNNING").alias("running"), F.count_if(~s.isin(*TERMINAL, "RUNNING")).alias("pending"), F.coalesce(F.sum("stores_found"), F.lit(0)).alias("stores"))


def remaining(tasks: DataFrame, first: int, last: int) -> DataFrame:
    """Ids of the range (either way round) that aren't done; ids without a task count."""
    low, high = min(first, last), max(first, last)
    ids = tasks.sparkSession.range(low, high + 1)
    return ids.join(tasks.filter(F.col("status").isin(*TERMINAL)).select("id"), "id", "left_anti").agg(F.count("*").alias("remaining"))


def resumed(tasks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Checkpoint merged with a task list (id, query_text): running and cancelled tasks are pending again, new ones are added. A task is cancelled if it failed for good and its `error`, an optional column, tells of a cancelled context."""
    joined = tasks.withColumnRenamed("query_text", "_q").join(wanted.select("id", "query_text"), "id", "full_outer")
    again = (F.col("status") == "RUNNING") | F.col("status").isNull()
    if "error" in tasks.columns:
        again = again | ((F.col("status") == "FAILED_PERMANENT") & F.coalesce(F.lower("error").contains("context cancel"), F.lit(False)))
    return joined.select("id", F.coalesce("_q", "query_text").alias("query_text"), F.when(again, "PENDING").otherwise(F.col("status")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("stores_found", F.lit(0)).alias("stores_found"))


def transitions(history: DataFrame) -> DataFrame:
    """State of each task after a log (id, seq, status, stores_found): the last one; RUNNING adds an attempt."""
    last = F.max_by(F.struct("status", "stores_found"), "seq")
    return history.groupBy("id").agg(last.alias("l"), F.count_if(F.col("status") == "RUNNING").alias("attempts")).select("id", "l.status", "attempts", F.coalesce("l.stores_found", F.lit(0)).alias("stores_found"))


def telemetry(events: DataFrame, worker: str, kind: str, at: str, total_tasks: int) -> DataFrame:
    """Processed, errors, workers, progress (at most 100), items a minute and time passed, as HH:MM:SS."""
    span = (F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6
    done = F.count("*")
    secs = F.floor("_s").cast("bigint")
    out = events.agg(done.alias("processed"), F.count_if(F.col(kind) == "error").alias("errors"), F.countDistinct(worker).alias("workers"), F.least(F.lit(100.0), done / F.lit(float(total_tasks)) * 100).alias("progress"), span.alias("_s"))
    out = out.withColumn("per_minute", F.when(F.col("_s") > 0, F.col("processed") / (F.col("_s") / 60)).otherwise(0.0))
    return out.withColumn("elapsed", F.format_string("%02d:%02d:%02d", F.floor(secs / 3600), F.floor(secs / 60) % 60, secs % 60)).drop("_s")


def next_run(at: Column, hour: int, minute: int, zone: str = "Asia/Jakarta") -> Column:
    """The next instant after `at` of that time of day in the zone."""
    local = F.from_utc_timestamp(at, zone)
    today = F.date_trunc("day", local) + F.expr(f"interval {hour} hours {minute} minutes")
    return F.to_utc_timestamp(F.when(today > local, today).otherwise(today + F.expr("interval 24 hours")), zone)


def next_number(runs: DataFrame) -> DataFrame:
    return runs.agg((F.coalesce(F.max("run_number"), F.lit(0)) + 1).alias("next_number"))


def owners(bridge: DataFrame, runs: DataFrame) -> DataFrame:
    """(article_id, run_id): of an article in several runs, the run that started last, then the higher number and id."""
    r = runs.select(F.col("id").alias("run_id"), "started_at", "run_number")
    rank = F.struct(F.coalesce("started_at", F.lit("1970-01-01").cast("timestamp")), F.coalesce("run_number", F.lit(-1)), F.col("run_id"))
    return bridge.join(r, "run_id").groupBy("article_id").agg(F.max_by("run_id", rank).alias("run_id"))


def numbered(df: DataFrame, by: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place (from 1) in a total order, without a window over all rows.

    A sort by ranges writes the rows with their place in their range; the sizes of the ranges, one number each, give the
    place at which every range begins.
    """
    spark = df.sparkSession
    ranges = written(df.orderBy(*by).withColumn("_m", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("_m", 33)
    sizes = sorted((r[0], r[1]) for r in ranges.groupBy(part.alias("p")).agg(F.count("*")).collect())
    begins = list(zip([p for p, _ in sizes], itertools.accumulate((n for _, n in sizes), initial=0)))
    begin = spark.createDataFrame(begins, "_p long, _b long")
    place = F.col("_b") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return ranges.join(F.broadcast(begin), part == F.col("_p")).withColumn(name, place).drop("_m", "_p", "_b")


def of_source(runs: DataFrame, source: str | None = None, parent: str | None = None) -> DataFrame:
    """Runs of a source, compared in any case, or of a parent run, or both; blank ones are no filter."""
    out = runs
    for column, wanted in (("source", source), ("cron_run_id", parent)):
        if (wanted or "").strip():
            out = out.filter(F.lower(column) == wanted.strip().lower())
    return out


def detail(runs: DataFrame, key: str) -> DataFrame:
    """The run of that id or, if there is none, of that display name in any case."""
    hit = runs.withColumn("_tier", F.when(F.col("id") == key, 0).when(F.lower("display_name") == key.strip().lower(), 1)).filter("_tier is not null")
    return hit.orderBy("_tier", F.col("run_number").desc()).limit(1).drop("_tier")


def latest(runs: DataFrame) -> DataFrame:
    """The run that started last, of equal ones that of the highest number and id."""
    return runs.filter("started_at is not null").orderBy(F.col("started_at").desc(), F.col("run_number").desc(), F.col("id").desc()).limit(1)


def on_day(runs: DataFrame, day: Column) -> DataFrame:
    return runs.filter(F.to_date("started_at") == day)


def created(runs: DataFrame, run_id: str, source: str | None = None, trigger: str | None = None, parent: str | None = None) -> DataFrame:
    """The log with a new queued run of the next number; one of a parent is shown as 'parent — source'."""
    n = F.coalesce(F.max("run_number"), F.lit(0)) + 1
    source = (source or "").strip() or "all"
    name = F.lit(f"{parent} — {source}") if parent else F.format_string("Run #%03d", "run_number")
    new = runs.agg(n.alias("run_number")).select(F.lit(run_id).alias("id"), "run_number", name.alias("display_name"), F.lit(source).alias("source"), F.lit((trigger or "").strip() or "manual").alias("trigger_kind"), F.lit("QUEUED").alias("status"), F.lit(parent).cast("string").alias("cron_run_id"))
    return runs.unionByName(sync_fields(runs.limit(0).unionByName(new, allowMissingColumns=True)), allowMissingColumns=True)


def finished(runs: DataFrame, run_id: str, status: str, at: Column) -> DataFrame:
    """The log with a run ended: its duration is never negative, aliases are filled."""
    mine = F.col("id") == run_id
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(at.cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1e6)
    out = runs.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "finished_at": F.when(mine, at.cast(runs.schema["finished_at"].dataType)).otherwise(F.col("finished_at")), "duration_sec": F.when(mine, seconds).otherwise(F.col("duration_sec")), "duration": F.when(mine, seconds).otherwise(F.col("duration"))})
    return sync_fields(out)
