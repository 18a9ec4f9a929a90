"""Raw records of a stream into two sinks, each micro-batch once: a written ledger says which batches are whole, and readers see no others."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from vigil.operators.incidents import processed
from vigil.operators.ranks import placed

#: Signals in the order in which a capture is replayed.
SIGNALS = ("metrics", "logs", "traces")
Sink = Callable[[DataFrame, int], None]


class Transient(Exception):
    """A failure that another attempt may not meet."""


def delays(first: float, attempts: int) -> list[float]:
    """Seconds to wait after each failed attempt but the last: doubled each time."""
    return [first * 2.0**i for i in range(attempts - 1)]


def attempt(work: Callable[[], object], waits: list[float], sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs `work` until it doesn't fail for a transient reason; the number of attempts. Any other failure is raised at once, a transient one after the last wait."""
    made = 1
    for wait in waits:
        try:
            work()
            return made
        except Transient:
            sleep(wait)
            made += 1
    work()
    return made


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def files(place: str) -> Sink:
    """A sink of one folder for each batch: a repeated batch replaces its own rows."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{place}/batch={batch}")


class Router:
    """For foreachBatch: records are judged once, accepted ones go to one sink, the others to the dead letters, and then the batch enters the ledger.

    Spark repeats a batch with the same number and rows if the query ended before its commit. Such a batch is skipped if the ledger has it, else written
    again over what it left. Each sink is tried again after transient failures only; if accepted rows still can't be written, all of the batch's become dead letters
    with `processing_error`; if dead letters can't, the query fails, and its next start repeats the batch. Sinks must replace what they have of a batch."""

    def __init__(self, place: str, judge: Callable[[DataFrame], DataFrame] = processed, good: Sink | None = None, dead: Sink | None = None, attempts: int = 3, first_wait: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.place, self.judge, self.waits, self.sleep = place, judge, delays(first_wait, attempts), sleep
        self.good, self.dead = good or files(f"{place}/good"), dead or files(f"{place}/dead")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if exists(spark, f"{self.place}/ledger/batch={number}/_SUCCESS"):
            return
        staged = f"{self.place}/staged/batch={number}"
        judged = self.judge(batch)
        judged.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(judged.schema).parquet(staged)
        n = rows.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
        letters, made = rows.where("error IS NOT NULL").withColumn("attempts", F.lit(1)), 1
        try:
            made = attempt(lambda: self.good(rows.where("error IS NULL").drop("error", "payload_base64"), number), self.waits, self.sleep)
            accepted = n.n - n.bad
        except Transient:
            made, accepted = len(self.waits) + 1, 0
            failed = rows.where("error IS NULL").withColumn("error", F.lit("processing_error")).withColumn("payload_base64", F.regexp_replace(F.base64("value"), r"[\r\n]", "")).withColumn("attempts", F.lit(made))
            letters = letters.unionByName(failed)
            attempt(lambda: self.good(rows.where("false").drop("error", "payload_base64"), number), self.waits, self.sleep) if self._left(spark, number) else None
        attempt(lambda: self.dead(letters, number), self.waits, self.sleep)
        entry = Row(records=n.n, accepted=accepted, dead=n.n - accepted, attempts=made)
        spark.createDataFrame([entry], "records long, accepted long, dead long, attempts int").coalesce(1).write.mode("overwrite").parquet(f"{self.place}/ledger/batch={number}")
        remove(spark, staged)

    def _left(self, spark: SparkSession, number: int) -> bool:
        """Whether failed attempts left rows in the sink of files, which an empty batch then replaces."""
        return exists(spark, f"{self.place}/good/batch={number}")


def batches(spark: SparkSession, place: str) -> DataFrame:
    """(batch, records, accepted, dead, attempts) of the whole batches."""
    return spark.read.schema("records long, accepted long, dead long, attempts int, batch long").parquet(f"{place}/ledger")


def delivered(spark: SparkSession, place: str, sink: str, schema: str) -> DataFrame:
    """Rows of a sink of files, of batches that the ledger has."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(f"{place}/{sink}")
    return rows.join(batches(spark, place).select("batch"), "batch", "left_semi")


def capture_faults(lines: DataFrame) -> DataFrame:
    """(signal, line_number, error) of the lines of a capture (signal, line_number, value binary) that can't be replayed. Blank lines don't count."""
    return _judged(lines).where("error IS NOT NULL").select("signal", "line_number", "error")


def _judged(lines: DataFrame) -> DataFrame:
    full = lines.where(~F.coalesce(F.trim(F.regexp_replace(F.try_validate_utf8(F.col("value").cast("string")), r"[\t\x0b\x0c\r]", " ")) == "", F.lit(False)))
    headers = F.map_from_arrays(F.array(*map(F.lit, ("event_type", "schema_version", "signal"))), F.array(F.lit("telemetry.raw"), F.lit("1"), F.col("signal")))
    return processed(full.select("signal", "line_number", "value", headers.alias("headers"), F.lit("").alias("topic"), F.lit(0).alias("partition"), F.col("line_number").alias("offset")))


def replay(lines: DataFrame, run_id: str, scenario: str, label: str, topic: str = "telemetry.raw", limit: int | None = None) -> DataFrame:
    """Raw records (topic, partition, offset, key, headers, value) of a capture, metrics first, then logs and traces, each by line, up to `limit` in all.

    Every line is judged before any is given: a broken one, a signal without lines, or an unknown signal is an error that names the first. Places come from ranges of the
    lines, so no task holds the capture."""
    bad = capture_faults(lines).orderBy(F.array_position(F.array(*map(F.lit, SIGNALS)), F.col("signal")), "line_number").first()
    if bad:
        raise ValueError(f"{bad.signal}, line {bad.line_number}: {bad.error}")
    good = _judged(lines).select("signal", "line_number", "value")
    lost = [s for s in SIGNALS if s not in {r.signal for r in good.select("signal").distinct().collect()}]
    if lost:
        raise ValueError(f"no lines of {', '.join(lost)}")
    named = {"event_type": "telemetry.raw", "schema_version": "1", "content-type": "application/json", "run_id": run_id, "scenario": scenario, "label": label}
    headers = F.create_map(F.lit("signal"), F.col("signal"), *(F.lit(x) for kv in named.items() for x in kv))
    out = placed(good, [F.array_position(F.array(*map(F.lit, SIGNALS)), F.col("signal")), "line_number"], name="_place")
    out = out if limit is None else out.where(F.col("_place") <= limit)
    return out.select(F.lit(topic).alias("topic"), F.lit(0).alias("partition"), (F.col("_place") - 1).alias("offset"), F.lit(run_id).alias("key"), headers.alias("headers"), "value")
