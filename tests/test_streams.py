"""Keyed state, routing and ledgers of streams: any split of the input and any restart give what the whole table gives."""

import base64
import random

import pytest

from vigil.plans import streams
from vigil.streaming import ledger
from vigil.streaming import lifecycle as L

DIR = "/root/testdata/sf0.001"
HOUR = 3_600_000_000
SCHEMA = "incident long, " + L.COMMAND
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def far(at):
    return [(None, at, *[None] * (len(NAMES) - 2))]


def feed(spark, place, slices):
    for rows in slices:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(place)


def outcomes(spark, base, schema=SCHEMA):
    L.with_keyed_state(spark)
    out = L.lifecycle_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), "incident", "1 hour")
    streams.run_available(out, f"{base}/out", f"{base}/state")
    return sorted(map(tuple, spark.read.schema(out.schema).parquet(f"{base}/out").collect()))


@pytest.fixture(scope="module")
def few(spark):
    rows = streams.commands(spark, DIR).where("incident < 4").select(*NAMES).collect()
    assert len(rows) > 100
    return sorted(map(tuple, rows), key=lambda r: r[1:3])


def test_table_equals_a_plain_fold(spark, few):
    got = sorted(map(tuple, L.lifecycle_table(spark.createDataFrame(few, SCHEMA), "incident").collect()))
    state, want = {}, []
    for r in few:
        c = dict(zip(NAMES, r))
        s, k = state.get(c["incident"]), c["command"]
        clean = lambda x: (x.strip() or None) if x is not None else None
        entries, message = [], None
        if k == "CREATE":
            outcome = "ALREADY_EXISTS" if s else "APPLIED"
            if not s:
                state[c["incident"]] = {"status": "OPEN", "version": 0, "resolved_us": None, "closed_us": None, **{f: clean(c[f]) for f in L.FIELDS}}
                entries = ["INCIDENT_CREATED"]
        elif not s:
            outcome = "UNKNOWN_INCIDENT"
        elif c["expected"] is not None and c["expected"] != s["version"]:
            outcome = "STALE_VERSION"
        elif k == "TRANSITION":
            ok = (s["status"], c["target"]) in {("OPEN", "INVESTIGATING"), ("OPEN", "RESOLVED"), ("INVESTIGATING", "MITIGATED"), ("INVESTIGATING", "RESOLVED"), ("MITIGATED", "INVESTIGATING"), ("MITIGATED", "RESOLVED"), ("RESOLVED", "INVESTIGATING"), ("RESOLVED", "CLOSED")}
            outcome = "APPLIED" if ok else "ILLEGAL_TRANSITION"
            if ok:
                message, entries = f"{s['status']} -> {c['target']}", ["STATUS_CHANGED"]
                if c["target"] == "RESOLVED":
                    s["resolved_us"] = c["at_us"]
                if s["status"] == "RESOLVED" and c["target"] == "INVESTIGATING":
                    s["resolved_us"] = None
                if c["target"] == "CLOSED":
                    s["closed_us"] = c["at_us"]
                s["status"], s["version"] = c["target"], s["version"] + 1
        else:
            outcome = "APPLIED"
            if k == "NOTE":
                entries = ["NOTE_ADDED"]
            else:
                if any(c[f] is not None for f in L.DETAILS):
                    entries.append("DETAILS_UPDATED")
                entries += [f"{f.upper()}_UPDATED" for f in L.TRACKED if c[f] is not None and clean(c[f]) != s[f]]
                s.update({f: clean(c[f]) for f in L.FIELDS if c[f] is not None}, version=s["version"] + 1)
        s = state.get(c["incident"], dict.fromkeys(L.Incident._fields))
        want.append((c["incident"], c["seq"], c["at_us"], outcome, ",".join(entries), message, *(s[f] for f in L.Incident._fields)))
    assert got == sorted(want)
    assert {x[3] for x in got} == {"APPLIED", "ALREADY_EXISTS", "UNKNOWN_INCIDENT", "STALE_VERSION", "ILLEGAL_TRANSITION"}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_and_a_restart_equal_the_table(spark, few, tmp_path, seed):
    """Commands come up to 50 minutes late, some twice; the query stops after half of the files and starts again from its checkpoint."""
    r = random.Random(seed)
    late = sorted(few + r.sample(few, 10), key=lambda c: c[1] + r.randrange(50 * HOUR // 60))
    cuts = sorted(r.sample(range(1, len(late)), 5))
    slices = [late[a:b] for a, b in zip([0, *cuts], [*cuts, len(late)])]
    base = f"file://{tmp_path}"
    feed(spark, f"{base}/in", slices[:3])
    part = outcomes(spark, base)
    feed(spark, f"{base}/in", [*slices[3:], far(few[-1][1] + 3 * HOUR)])
    whole = outcomes(spark, base)
    assert whole == sorted(map(tuple, L.lifecycle_table(spark.createDataFrame(few, SCHEMA), "incident").collect()))
    assert 0 < len(part) < len(whole) and set(part) <= set(whole)


def test_what_the_watermark_has_not_passed_waits(spark, tmp_path):
    n = [None] * 7
    base = f"file://{tmp_path}"
    feed(spark, f"{base}/in", [[(1, 5 * HOUR, 2, "NOTE", None, None, *n), (1, 4 * HOUR, 1, "CREATE", None, None, *n), (2, 9 * HOUR, 3, "WHAT", None, None, *n)]])
    assert [(x[0], x[1], x[3]) for x in outcomes(spark, base)] == [(1, 1, "APPLIED"), (1, 2, "APPLIED")]
    feed(spark, f"{base}/in", [far(20 * HOUR)])
    assert [(x[0], x[1], x[3]) for x in outcomes(spark, base)] == [(1, 1, "APPLIED"), (1, 2, "APPLIED"), (2, 3, "UNKNOWN_INCIDENT")]


def test_incidents_of_one_group(spark, tmp_path):
    """All incidents share one group's state, in more than one piece of text; one has no key; texts and numbers stay as they are, also beyond the years that pandas can hold."""
    r, base, n = random.Random(3), f"file://{tmp_path}", [None] * 4
    odd = ['a "b"\n\\', "\u2028 \U0001f600", "\t", "x\u0000y", None]
    rows = [(r.choice([None, 1, 2, 2**60 + 1]), i * HOUR // 100 + 1, 2**60 + i, r.choice(["CREATE", "UPDATE", "UPDATE", "NOTE"]), None, r.choice([None, None, i % 90]), r.choice(odd), r.choice(odd), *n, r.choice(odd)) for i in range(3500)]
    rows += [(1, 330 * 365 * 24 * HOUR, 7, "NOTE", *[None] * 9)]
    L.with_keyed_state(spark)
    feed(spark, f"{base}/in", [rows[:2600], [*rows[2600:], *far(331 * 365 * 24 * HOUR)]])
    out = L.lifecycle_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), "incident", "1 hour", groups=1)
    streams.run_available(out, f"{base}/out", f"{base}/state")
    plain = lambda table: sorted(map(tuple, table.collect()), key=lambda x: x[2])
    got = plain(spark.read.schema(out.schema).parquet(f"{base}/out"))
    assert got == plain(L.lifecycle_table(spark.createDataFrame(rows, SCHEMA), "incident")) and len(got) == 3501


def test_many_files_of_a_slice(spark, tmp_path):
    """Sixty files, each over all times: a slice has more files than three batches once took, and none of its commands comes too late."""
    spark.read.parquet(f"{DIR}/events.parquet").repartition(60).write.parquet(f"{tmp_path}/events.parquet")
    sizes = ("spark.sql.files.maxPartitionBytes", "spark.sql.streaming.noDataMicroBatches.enabled")
    before = [spark.conf.get(x) for x in sizes]
    spark.conf.set(sizes[0], "1k")
    try:
        assert streams.commands(spark, str(tmp_path)).rdd.getNumPartitions() >= 60
        got = streams.incident_stream(spark, str(tmp_path))
        names = got.columns
        got = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set(sizes[0], before[0])
    assert got == sorted(map(tuple, L.lifecycle_table(streams.commands(spark, DIR), "incident").select(*names).collect()))
    assert len(got) == 1000 and spark.conf.get(sizes[1]) == before[1]


def test_empty_tables(spark):
    assert L.lifecycle_table(spark.createDataFrame([], SCHEMA), "incident").count() == 0


def route_all(spark, base, **kwargs):
    stream = spark.readStream.schema(streams.raw_records(spark, DIR).schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/raw")
    q = stream.writeStream.foreachBatch(ledger.Router(base, **kwargs)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()


def offsets(spark, base, sink):
    return sorted(r["offset"] for r in ledger.delivered(spark, base, sink, "offset long").collect())


@pytest.fixture(scope="module")
def raw(spark):
    return streams.raw_records(spark, DIR).where("offset < 300").cache()


@pytest.fixture
def base(raw, tmp_path):
    raw.repartitionByRange(3, "offset").write.parquet(f"file://{tmp_path}/raw")
    return f"file://{tmp_path}"


def judged(raw):
    from vigil.operators.incidents import processed

    rows = processed(raw).select("offset", "error").collect()
    return sorted(r["offset"] for r in rows if not r.error), sorted(r["offset"] for r in rows if r.error)


@pytest.mark.parametrize("where", ["before the good sink", "between the sinks", "before the ledger", "after the ledger"])
def test_a_stop_anywhere_neither_loses_nor_repeats(spark, raw, base, where):
    """The second batch dies once at one place; the next start repeats it from the checkpoint."""
    left = [1]
    good, dead = ledger.files(f"{base}/good"), ledger.files(f"{base}/dead")

    def die(at, number):
        if at == where and number == 1 and left:
            left.pop()
            raise RuntimeError(at)

    def first(rows, number):
        die("before the good sink", number)
        good(rows, number)
        die("between the sinks", number)

    def second(rows, number):
        dead(rows, number)
        die("before the ledger", number)

    class Dying(ledger.Router):
        def __call__(self, batch, number):
            super().__call__(batch, number)
            die("after the ledger", number)

    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/raw")
    start = lambda: stream.writeStream.foreachBatch(Dying(base, good=first, dead=second)).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match=where):
        start().awaitTermination()
    some = len(offsets(spark, base, "good"))
    assert some < len(judged(raw)[0])
    start().awaitTermination()
    assert (offsets(spark, base, "good"), offsets(spark, base, "dead")) == judged(raw)
    entries = ledger.batches(spark, base).collect()
    assert sorted(e.batch for e in entries) == [0, 1, 2] and sum(e.records for e in entries) == raw.count()


def test_transient_failures_are_tried_again_and_others_are_not(spark, raw, base):
    slept, calls = [], []
    good = ledger.files(f"{base}/good")

    def shaky(rows, number):
        calls.append(number)
        if number == 0 and calls.count(0) < 3:
            raise ledger.Transient("busy")
        if number == 1:
            raise ledger.Transient("gone")
        good(rows, number)

    route_all(spark, base, good=shaky, sleep=slept.append)
    assert slept == [0.5, 1.0, 0.5, 1.0] and calls == [0, 0, 0, 1, 1, 1, 2]
    entries = {e.batch: e for e in ledger.batches(spark, base).collect()}
    assert entries[0].attempts == 3 and entries[1].accepted == 0 and entries[1].dead == entries[1].records
    letters = ledger.delivered(spark, base, "dead", "offset long, error string, attempts int, payload_base64 string").collect()
    assert sorted([*offsets(spark, base, "good"), *(r["offset"] for r in letters)]) == sorted(r["offset"] for r in raw.collect())
    failed = [r for r in letters if r.error == "processing_error"]
    values = {r["offset"]: bytes(r.value) for r in raw.collect()}
    assert failed and all(r.attempts == 3 and base64.b64decode(r.payload_base64) == values[r["offset"]] for r in failed)


def test_attempts():
    assert ledger.delays(0.25, 4) == [0.25, 0.5, 1.0] and ledger.delays(1, 1) == []
    slept = []
    with pytest.raises(ledger.Transient):
        ledger.attempt(lambda: (_ for _ in ()).throw(ledger.Transient()), [1, 2], slept.append)
    with pytest.raises(KeyError):
        ledger.attempt(lambda: {}[0], [1, 2], slept.append)
    assert slept == [1, 2] and ledger.attempt(lambda: None, [1, 2]) == 1


def test_a_capture_is_judged_before_it_is_replayed(spark):
    line = lambda s, i, v: (s, i, bytearray(v))
    good = [line("traces", 1, b'{"resourceSpans":[]}'), line("logs", 2, b"{}"), line("logs", 1, b'{"resourceLogs":[{}]}'), line("metrics", 7, b"{}"), line("metrics", 8, b" \t ")]
    schema = "signal string, line_number long, value binary"
    got = ledger.replay(spark.createDataFrame(good, schema), "r", "s", "l", limit=3).orderBy("offset").collect()
    assert [(r["offset"], r.headers["signal"], bytes(r.value)) for r in got] == [(0, "metrics", b"{}"), (1, "logs", b'{"resourceLogs":[{}]}'), (2, "logs", b"{}")]
    assert got[0].headers["run_id"] == "r" and got[0].key == "r"
    for bad, what in ((line("logs", 3, b"{"), "logs, line 3: invalid_json"), (line("metrics", 2, b"\xff"), "metrics, line 2: invalid_utf8"), (line("x", 1, b"{}"), "x, line 1: unsupported_signal"), (line("logs", 4, b'{"resourceLogs":{}}'), "logs, line 4: invalid_structure")):
        with pytest.raises(ValueError, match=what):
            ledger.replay(spark.createDataFrame([*good, bad], schema), "r", "s", "l")
    with pytest.raises(ValueError, match="no lines of metrics, traces"):
        ledger.replay(spark.createDataFrame(good[1:3], schema), "r", "s", "l")
