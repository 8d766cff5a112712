"""Worker events: protocol validation and roll-ups (STR01-STR05, STR07, AG14, SNK02, JN29-JN30)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TYPES = ["started", "stage", "progress", "warning", "artifact", "completed", "failed"]
TERMINAL = ["completed", "failed"]
MAX_LINE, MAX_STREAM, MAX_MESSAGE = 64 * 1024, 4 * 1024 * 1024, 1000
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"


def event_problems(events: DataFrame, run: str = "run_id", line: str = "line_no") -> DataFrame:
    """STR01: every event with the array of the protocol rules it breaks, in order of arrival."""
    w = W.partitionBy(run).orderBy(line)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    kind, has = F.col("type"), set(events.columns)
    rules: list[tuple[str, Column]] = [
        ("unknown_type", ~kind.isin(TYPES)),
        ("sequence_not_positive", F.col("sequence") < 1),
        ("sequence_not_increasing", F.col("sequence") <= F.max("sequence").over(before)),
        ("time_backwards", F.col("time") < F.max("time").over(before)),
        ("after_terminal", F.coalesce(F.max(kind.isin(TERMINAL)).over(before), F.lit(False))),
        ("first_not_started", (F.row_number().over(w) == 1) & (kind != "started")),
        ("started_again", (F.row_number().over(w) > 1) & (kind == "started")),
    ]
    if {"completed", "total"} <= has:
        done, of = F.col("completed"), F.col("total")
        bad = done.isNull() | of.isNull() | (done < 0) | (of <= 0) | (done > of)
        rules.append(("bad_progress", (kind == "progress") & bad))
    if "stage" in has:
        rules.append(("bad_stage", kind.isin("stage", "progress") & ~F.coalesce(F.col("stage").rlike(IDENTIFIER), F.lit(False))))
    if {"code", "message"} <= has:
        m = F.coalesce("message", F.lit(""))
        bad = ~F.coalesce(F.col("code").rlike(IDENTIFIER), F.lit(False)) | (F.trim(m) == "") | (F.length(m) > MAX_MESSAGE) | m.contains("\n")
        rules.append(("bad_message", kind.isin("warning", "failed") & bad))
    found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules]))
    return events.withColumn("problems", found)


def run_validity(events: DataFrame, run: str = "run_id", line: str = "line_no", require_terminal: bool = True) -> DataFrame:
    """STR01: one row a run: events, first problem, valid."""
    rows = event_problems(events, run, line)
    out = rows.groupBy(run).agg(
        F.count("*").alias("n_events"),
        F.min_by(F.get("problems", F.lit(0)), F.when(F.size("problems") > 0, F.col(line))).alias("first_problem"),
        F.max_by("type", line).isin(TERMINAL).alias("__ends"),
    )
    problem = F.coalesce("first_problem", F.when(F.lit(require_terminal) & ~F.col("__ends"), "no_terminal"))
    return out.withColumn("first_problem", problem).withColumn("valid", F.col("first_problem").isNull()).drop("__ends")


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """SRC18: NDJSON lines as typed events; oversized or unreadable lines get a null type."""
    schema = (
        "schemaVersion int, runId string, sequence long, time string, type string, stage string, completed long, total long,"
        " code string, message string, role string, path string, mediaType string, sha256 string, bytes long"
    )
    fits = F.octet_length(F.col(value)) <= MAX_LINE
    e = F.from_json(F.when(fits, F.col(value)), schema, {"mode": "PERMISSIVE"})
    out = lines.withColumn("__e", e)
    return out.select(*[c for c in lines.columns if c != value], "__e.*").withColumn("time", F.try_to_timestamp("time"))


def number_events(events: DataFrame, run: str, order: list[str]) -> DataFrame:
    """STR02: monotone sequence numbers."""
    return events.withColumn("sequence", F.row_number().over(W.partitionBy(run).orderBy(*order)).cast("long"))


def changed_progress(events: DataFrame, run: str, order: str, columns: list[str]) -> DataFrame:
    """STR03: only events whose columns differ from the event before."""
    w = W.partitionBy(run).orderBy(order)
    now = F.struct(*columns)
    return events.withColumn("__p", F.lag(now).over(w)).where(~F.col("__p").eqNullSafe(now)).drop("__p")


def last_progress(events: DataFrame, run: str, order: str, columns: list[str]) -> DataFrame:
    """STR04: the latest progress of each run."""
    return events.where("type = 'progress'").groupBy(run).agg(F.max_by(F.struct(*columns), order).alias("__l")).select(run, "__l.*")


def failure_code(events: DataFrame, run: str, order: str, default: str = "worker_failed") -> DataFrame:
    """STR05: code of the terminal failure, else a generic one."""
    last = events.groupBy(run).agg(F.max_by(F.struct("type", "code"), order).alias("l"))
    return last.select(run, F.when(F.col("l.type") == "failed", F.coalesce("l.code", F.lit(default))).alias("code"))


def tail(text: Column, most: int, notice: str = "[truncated] ") -> Column:
    """STR07: the last characters, with a notice where some are missing."""
    return F.when(F.length(text) > most, F.concat(F.lit(notice), F.substr(text, F.length(text) - most + 1))).otherwise(text)


def stage_rollup(stages: DataFrame, run: str, start: str, end: str) -> DataFrame:
    """AG14, SNK02: first start, last end and seconds to three places (half even)."""
    out = stages.groupBy(run).agg(F.min(start).alias("started_at"), F.max(end).alias("ended_at"), F.count("*").alias("stages"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    seconds = F.bround((micros("ended_at") - micros("started_at")) / 1e6, 3)
    return out.withColumn("seconds", seconds)


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK02: rows of ``new`` replace those with their key."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def artifact_mismatches(announced: DataFrame, staged: DataFrame) -> DataFrame:
    """JN29: roles where the announced and the staged artifact are not equal in every field."""
    fields = ["path", "media_type", "sha256", "bytes"]
    a = announced.select("run_id", "role", F.struct(*fields).alias("__a"))
    b = staged.select("run_id", "role", F.struct(*fields).alias("__b"))
    return a.join(b, ["run_id", "role"], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b"))).select("run_id", "role")


def page_map_problems(pages: DataFrame, source_pages: int) -> DataFrame:
    """JN30: per run and role, whether the map is a bijection onto the output pages (one or two a source page)."""
    flat = pages.select("run_id", "role", "source_page", F.posexplode("output_pages").alias("k", "out"))
    out = flat.groupBy("run_id", "role").agg(
        F.countDistinct("source_page").alias("sources"), F.count("*").alias("n"), F.countDistinct("out").alias("outs"),
        F.min("out").alias("lo"), F.max("out").alias("hi"), F.max("k").alias("most"),
    )
    per = F.when(F.col("role").contains("dual"), 2).otherwise(1)
    sound = (
        (F.col("sources") == source_pages) & (F.col("n") == F.col("outs")) & (F.col("lo") == 1)
        & (F.col("hi") == F.col("n")) & (F.col("n") == source_pages * per)
    )
    return out.select("run_id", "role", (~sound).alias("bad"))
