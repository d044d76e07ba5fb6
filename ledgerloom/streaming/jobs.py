"""Extraction jobs as a state machine over a stream, and inserts that happen once.

A job's state is its status, its attempts and when it began to extract. Only the transitions of TRANSITIONS are made; other
events leave the state and are told as refused. A job that extracts for longer than TIMEOUT fails: when its next event comes
later than that, or, if none comes, when the watermark has passed its end. Both happen at the same time of the event clock,
so what a stream tells doesn't hang on how its files fall into micro-batches. ``told_of`` is the same rule over a sorted
table.

Defined cases: events with a null job or time are left out; an event of an unknown kind is refused; events of one job at the
same time are taken in order of their number; a replayed micro-batch gives the same rows, for state goes back with it; rows
later than the watermark are dropped by the stream.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ledgerloom.sources.views import table
from ledgerloom.streaming.flows import event_stream, upserted

#: Fixed values: (status, event) -> status. Only a failed job is taken up again or dismissed; only a review ends otherwise.
TRANSITIONS = {
    ("PENDING", "start"): "EXTRACTING",
    ("EXTRACTING", "extracted"): "PENDING_REVIEW",
    ("EXTRACTING", "failed"): "FAILED",
    ("PENDING_REVIEW", "confirm"): "CONFIRMED",
    ("PENDING_REVIEW", "reject"): "REJECTED",
    ("FAILED", "retry"): "PENDING",
    ("FAILED", "dismiss"): "REJECTED",
}
TIMEOUT = 20 * 60 * 1_000_000  # microseconds
TOLD = "job long, us long, number long, event string, before string, after string, attempts long"
LATE = "1 day"


def step(state: tuple[str, int, int], us: int, event: str, timeout: int) -> Iterator[tuple[tuple[str, int, int], int, str, str]]:
    """The states that an event leads to: first the end of an extraction that has lasted too long, then the event's own."""
    status, attempts, since = state
    if status == "EXTRACTING" and us - since > timeout:
        state = ("FAILED", attempts, since)
        yield state, since + timeout, "timeout", status
        status = "FAILED"
    to = TRANSITIONS.get((status, event))
    if to:
        state = (to, attempts + (to == "EXTRACTING"), us if to == "EXTRACTING" else since)
    yield state, us, event, status


START = ("PENDING", 0, 0)


def _rows(job: int, state: tuple[str, int, int], events: Iterable[tuple[int, int, str]], timeout: int) -> tuple[tuple[str, int, int], list]:
    out = []
    for us, number, event in events:
        for new, at, name, before in step(state, us, event, timeout):
            out.append((job, at, -1 if name == "timeout" else number, name, before, new[0] if name == "timeout" or (before, name) in TRANSITIONS else "refused", new[1]))
            state = new
    return state, out


def _timed(events: DataFrame) -> DataFrame:
    return events.where("job IS NOT NULL AND ts IS NOT NULL").select("job", F.col("ts").cast("timestamp").alias("ts"), "number", "event")


def transitions(events: DataFrame, timeout: int = TIMEOUT, late: str = LATE) -> DataFrame:
    """A stream of events (job, ts, number, event) -> what became of each, and the timeouts, as rows of TOLD."""

    def scan(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else START
        if state.hasTimedOut:
            out = [(key[0], now[2] + timeout, -1, "timeout", now[0], "FAILED", now[1])]
            now = ("FAILED", *now[1:])
        else:
            got = [(t.value // 1000, n, e) for pdf in batches for t, n, e in zip(pdf["ts"], pdf["number"].tolist(), pdf["event"].tolist(), strict=True)]
            now, out = _rows(key[0], now, sorted(got, key=lambda x: x[:2]), timeout)
        state.update(now)
        if now[0] == "EXTRACTING":
            state.setTimeoutTimestamp(max((now[2] + timeout) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TOLD.split(", ")])

    rows = _timed(events).withWatermark("ts", late)
    return rows.groupBy("job").applyInPandasWithState(scan, TOLD, "status string, attempts long, since long", "append", GroupStateTimeout.EventTimeTimeout)


def told_of(events: DataFrame, timeout: int = TIMEOUT, until: int | None = None) -> DataFrame:
    """The same over a table; ``until`` is the time that the clock has reached, for extractions that nothing ends."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, START
        names = [c.split()[0] for c in TOLD.split(", ")]

        def ended() -> list:
            if last is not None and state[0] == "EXTRACTING" and until is not None and until - state[2] > timeout:
                return [(last, state[2] + timeout, -1, "timeout", state[0], "FAILED", state[1])]
            return []

        for pdf in batches:
            out = []
            for job, us, number, event in zip(pdf["job"].tolist(), pdf["us"].tolist(), pdf["number"].tolist(), pdf["event"].tolist(), strict=True):
                if job != last:
                    out += ended()
                    last, state = job, START
                state, told = _rows(job, state, [(us, number, event)], timeout)
                out += told
            yield pd.DataFrame(out, columns=names)
        if told := ended():
            yield pd.DataFrame(told, columns=names)

    rows = _timed(events).select("job", F.unix_micros("ts").alias("us"), "number", "event")
    return rows.repartition("job").sortWithinPartitions("job", "us", "number").mapInPandas(scan, TOLD)


def first_inserts(rows: DataFrame, keys: list[str], window: str = "90 days") -> DataFrame:
    """Insert-if-absent on a stream: a row whose keys weren't there within the window; a key's state is dropped when the watermark
    passes its end, and rows older than the window are not taken."""
    return rows.withWatermark("ts", window).dropDuplicatesWithinWatermark(keys)


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Upsert on a stream: the latest generation of a key, by a running maximum; in update mode a changed key is written anew."""
    return rows.groupBy(*keys).agg(F.max(order).alias(order), F.count("*").alias("asked"))


def _events(rows: DataFrame) -> DataFrame:
    """Events of users as events of jobs: kinds by type and number."""
    kinds = F.array(*map(F.lit, ("start", "extracted", "confirm", "failed", "retry", "reject", "start", "extracted", "dismiss")))
    return rows.select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("number"), F.element_at(kinds, (F.pmod(F.col("event_id") * 7 + F.floor(F.col("value")).cast("long"), F.lit(9)) + 1).cast("int")).alias("event"))


def job_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every job, extractions of a day and more failing."""
    return told_of(_events(table(spark, sf_dir, "events")), 86_400_000_000)


def stream_job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each step was made, from the stream's output (the timeouts that only the clock tells are left to tests: when the
    last file ends, the clock stops)."""
    told = transitions(_events(event_stream(spark, sf_dir)), 86_400_000_000)
    rows = upserted(told, ["job", "us", "number", "event"], mode="append")
    return rows.where("event <> 'timeout'").groupBy("before", "event", "after").agg(F.count("*").alias("n"))


def stream_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each hashed question, the last generation of it, from a stream of upserts."""
    key = F.sha2(F.concat_ws("|", F.lower(F.trim("event_type")), "props"), 256)
    rows = event_stream(spark, sf_dir).select(key.alias("hash"), "event_id")
    return upserted(newest(rows, ["hash"], "event_id"), ["hash"])


def stream_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as they are first met, by kind of event."""
    rows = first_inserts(event_stream(spark, sf_dir), ["user_id", "event_type"])
    return upserted(rows.select("user_id", "event_type"), ["user_id", "event_type"], mode="append")


QUERIES = {f.__name__: f for f in (job_transitions, stream_job_states, stream_questions, stream_inserts)}

_MOVES = ", ".join(f"('{a}', '{e}', '{b}')" for (a, e), b in TRANSITIONS.items())
_JOBS = f"""WITH RECURSIVE moves(a, e, b) AS (VALUES {_MOVES}), kinds AS (SELECT user_id AS job, epoch_us(ts) AS us, event_id AS number, ['start', 'extracted', 'confirm', 'failed', 'retry', 'reject', 'start', 'extracted', 'dismiss'][(event_id * 7 + CAST(floor(value) AS BIGINT)) % 9 + 1] AS event FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY us, number) AS i FROM kinds),
run AS (SELECT job, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS us, CAST(NULL AS BIGINT) AS number, CAST(NULL AS VARCHAR) AS event, 'PENDING' AS before, 'PENDING' AS status, 'PENDING' AS after, CAST(0 AS BIGINT) AS attempts, CAST(0 AS BIGINT) AS since, false AS out, CAST(0 AS BIGINT) AS was, CAST(0 AS BIGINT) AS old FROM (SELECT DISTINCT job FROM numbered)
UNION ALL SELECT n.job, n.i, n.us, n.number, n.event, s.before, coalesce(m.b, s.before), coalesce(m.b, 'refused'), s.attempts + CAST(coalesce(m.b, '') = 'EXTRACTING' AS BIGINT), CASE WHEN m.b = 'EXTRACTING' THEN n.us ELSE s.since END, s.out, s.since, s.attempts
FROM (SELECT r.job, r.i, r.attempts, r.since, CASE WHEN r.status = 'EXTRACTING' AND x.us - r.since > 86400000000 THEN 'FAILED' ELSE r.status END AS before, r.status = 'EXTRACTING' AND x.us - r.since > 86400000000 AS out FROM run r JOIN numbered x ON x.job = r.job AND x.i = r.i + 1) s
JOIN numbered n ON n.job = s.job AND n.i = s.i + 1 LEFT JOIN moves m ON m.a = s.before AND m.e = n.event) """
ORACLE_SQL = {
    "job_transitions": _JOBS + "SELECT job, us, number, event, before, after, attempts FROM run WHERE i > 0 UNION ALL SELECT job, was + 86400000000, -1, 'timeout', 'EXTRACTING', 'FAILED', old FROM run WHERE out",
    "stream_job_states": _JOBS + "SELECT before, event, after, count(*) AS n FROM run WHERE i > 0 GROUP BY 1, 2, 3",
    "stream_questions": "SELECT sha256(concat_ws('|', lower(trim(event_type)), props)) AS hash, max(event_id) AS event_id, count(*) AS asked FROM events GROUP BY 1",
    "stream_inserts": "SELECT DISTINCT user_id, event_type FROM events",
}
