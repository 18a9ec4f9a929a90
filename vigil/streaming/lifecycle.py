"""Incidents as keyed state of a stream: commands are held back until the watermark has passed them, then applied in their order.

The result doesn't depend on how the input falls into micro-batches or files, as long as no command comes later than the watermark allows."""

from __future__ import annotations

import json
from collections import defaultdict, namedtuple
from collections.abc import Iterator
from itertools import batched
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigil.operators.corpus import TRANSITIONS

#: Fields that an update may set; of the second kind only a change counts.
DETAILS, TRACKED = ("title", "description", "severity", "owner", "services"), ("root_cause", "remediation")
FIELDS = (*DETAILS, *TRACKED)
#: A command's columns besides the incident's: its time in microseconds, its place among those of one time, what it asks for.
COMMAND = "at_us long, seq long, command string, target string, expected long, " + ", ".join(f"{f} string" for f in FIELDS)
STATE = "status string, version long, resolved_us long, closed_us long, " + ", ".join(f"{f} string" for f in FIELDS)
OUTCOME = "seq long, at_us long, outcome string, entries string, message string, " + STATE
#: How many groups the incidents of a stream fall into, and how many commands or outcomes make one piece of text.
GROUPS, PIECE = 4096, 1000
#: Event times travel within 292 years of 1970, which is what pandas can hold; commands from March 2255 on (LATEST) are due as soon as the watermark gets there.
SPAN, LATEST = 9_223_200_000_000_000, 9_000_000_000_000_000

Command = namedtuple("Command", [x.split()[0] for x in COMMAND.split(", ")])


class Incident(NamedTuple):
    status: str
    version: int
    resolved_us: int | None
    closed_us: int | None
    title: str | None
    description: str | None
    severity: str | None
    owner: str | None
    services: str | None
    root_cause: str | None
    remediation: str | None


def _clean(x: str | None) -> str | None:
    return (x.strip() or None) if x is not None else None


def apply_command(was: Incident | None, c: Command, legal: dict[str, tuple[str, ...]] = TRANSITIONS) -> tuple[Incident | None, str, list[str], str | None]:
    """(incident after, outcome, timeline entries, message). A refused command changes nothing and enters nothing.

    CREATE opens an incident that isn't there yet; every other command needs one, and, where it names a version, that very version. TRANSITION
    takes a legal step: resolving dates it, reopening clears that date, closing dates it for good. UPDATE keeps fields that are null and clears blank ones; details enter
    the timeline whenever one is given, a root cause or a remediation if it changes. NOTE enters the timeline only. An unknown command is refused."""
    if c.command == "CREATE":
        if was is not None:
            return was, "ALREADY_EXISTS", [], None
        first = next(iter(legal))
        return Incident(first, 0, None, None, *(_clean(getattr(c, f)) for f in FIELDS)), "APPLIED", ["INCIDENT_CREATED"], None
    if was is None:
        return was, "UNKNOWN_INCIDENT", [], None
    if c.expected is not None and c.expected != was.version:
        return was, "STALE_VERSION", [], None
    if c.command == "TRANSITION":
        if c.target not in legal.get(was.status, ()):
            return was, "ILLEGAL_TRANSITION", [], None
        resolved = c.at_us if c.target == "RESOLVED" else None if was.status == "RESOLVED" and c.target == "INVESTIGATING" else was.resolved_us
        closed = c.at_us if c.target == "CLOSED" else was.closed_us
        return was._replace(status=c.target, version=was.version + 1, resolved_us=resolved, closed_us=closed), "APPLIED", ["STATUS_CHANGED"], f"{was.status} -> {c.target}"
    if c.command == "UPDATE":
        given = {f: _clean(x) for f in FIELDS if (x := getattr(c, f)) is not None}
        entries = ["DETAILS_UPDATED"] if any(f in given for f in DETAILS) else []
        entries += [f"{f.upper()}_UPDATED" for f in TRACKED if f in given and given[f] != getattr(was, f)]
        return was._replace(version=was.version + 1, **given), "APPLIED", entries, None
    if c.command == "NOTE":
        return was, "APPLIED", ["NOTE_ADDED"], None
    return was, "UNKNOWN_COMMAND", [], None


def fold(was: Incident | None, commands: list[Command], legal: dict[str, tuple[str, ...]] = TRANSITIONS) -> tuple[Incident | None, list[tuple]]:
    """Commands of one incident in their order, each of one (at_us, seq) once: the incident, and a row of OUTCOME for each."""
    out, last = [], None
    for c in sorted(commands, key=lambda c: (c.at_us, c.seq)):
        if last != (last := (c.at_us, c.seq)):
            was, outcome, entries, message = apply_command(was, c, legal)
            out.append((c.seq, c.at_us, outcome, ",".join(entries), message, *(was or Incident(*[None] * len(Incident._fields)))))
    return was, out


class Lifecycle(StatefulProcessor):
    """Holds the incidents of a group and the commands that wait for the watermark; a timer stands at the earliest of them. Every call to the state has its price,
    and so has every row in it, so a group's incidents are one value and its commands pieces of many lines, each line one command as JSON with its incident as `_k`."""

    def __init__(self, legal: dict[str, tuple[str, ...]]):
        self.legal, self.names = legal, ["_k", *(x.split()[0] for x in OUTCOME.split(", "))]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.waiting, self.incidents = handle, handle.getListState("waiting", "lines string"), handle.getValueState("incidents", "listed string")

    @staticmethod
    def _due(at_us: int) -> int:
        return at_us // 1000 + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for table in rows:
            table = table[table["line"].notna()]
            if len(table):
                for x in batched(table["line"], PIECE):
                    self.waiting.appendValue(("\n".join(x),))
                least = int(table["due_us"].min())
                first = least if first is None else min(first, least)
        if first is not None:
            due, set_already = self._due(first), list(self.handle.listTimers())
            if not set_already or due < min(set_already):
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest, least = defaultdict(list), [], None
        for (lines,) in self.waiting.get():
            for line in lines.split("\n"):
                x = json.loads(line)
                if (at_us := min(x["at_us"], LATEST)) <= passed:
                    ready[x.get("_k")].append(Command(*map(x.get, Command._fields)))
                else:
                    rest.append(line)
                    least = at_us if least is None else min(least, at_us)
        if not ready:
            return
        known = {k: Incident(*x) for k, *x in json.loads(self.incidents.get()[0])} if self.incidents.exists() else {}
        out = []
        for k, commands in ready.items():
            now, made = fold(known.get(k), commands, self.legal)
            if now is not None:
                known[k] = now
            out += ({n: v for n, v in zip(self.names, (k, *x)) if v is not None} for x in made)
        if known:
            self.incidents.update((json.dumps([(k, *x) for k, x in known.items()]),))
        if rest:
            self.waiting.put([("\n".join(x),) for x in batched(rest, PIECE)])
            self.handle.registerTimer(self._due(least))
        else:
            self.waiting.clear()
        yield pd.DataFrame({"outcomes": [json.dumps(x) for x in batched(out, PIECE)]})

    def close(self) -> None:
        pass


def _outcome_schema(commands: DataFrame, key: str) -> str:
    return f"`{key}` {dict(commands.dtypes)[key]}, {OUTCOME}"


def with_keyed_state(spark) -> None:
    """Keyed state of this kind needs the RocksDB provider, which spills to local disk and checkpoints its changes."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def lifecycle_stream(commands: DataFrame, key: str, late: str, legal: dict[str, tuple[str, ...]] = TRANSITIONS, groups: int = GROUPS) -> DataFrame:
    """A stream of outcomes from a stream of commands (key, COMMAND). A row without a command only moves the watermark on. Commands that come
    later than `late` are dropped by the watermark and counted in the query's progress; a null time makes an error. State is kept for groups of
    incidents by a hash of the key: an incident is its row and what waits, which lateness bounds. A task holds one group at a time, so `groups` should grow with the incidents;
    for one checkpoint it stays as it is. The key travels as text."""
    kind = dict(commands.dtypes)[key]
    line = F.to_json(F.struct(F.col(key).cast("string").alias("_k"), *Command._fields), {"ignoreNullFields": "true"})
    due = F.when(F.col("command").isNull(), F.lit(0)).when(F.col("at_us").isNull(), F.raise_error(F.lit("a command without a time")).cast("long")).otherwise(F.least("at_us", F.lit(LATEST)))
    group, at = F.pmod(F.xxhash64(key), F.lit(groups)), F.timestamp_micros(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("at_us"))))
    packed = commands.select(group.alias("group"), due.alias("due_us"), F.when(F.col("command").isNotNull(), line).alias("line"), F.when(F.col("at_us").isNotNull(), at).alias("_at"))
    found = packed.withWatermark("_at", late).groupBy("group").transformWithStateInPandas(Lifecycle(legal), "outcomes string", "append", "eventtime")
    rows = found.select(F.explode(F.from_json("outcomes", f"array<struct<_k string, {OUTCOME.replace(' ', ': ').replace(',:', ',')}>>")).alias("o")).select("o.*")
    return rows.select(F.col("_k").cast(kind).alias(key), *(x.split()[0] for x in OUTCOME.split(", ")))


def lifecycle_table(commands: DataFrame, key: str, legal: dict[str, tuple[str, ...]] = TRANSITIONS) -> DataFrame:
    """The same outcomes from a table. One incident's commands, which are few, are folded together."""

    def one(key_values, table):
        import pyarrow as pa

        _, out = fold(None, [Command(*map(r.get, Command._fields)) for r in table.to_pylist() if r["command"] is not None], legal)
        columns = list(zip(*out)) if out else [()] * len(OUTCOME.split(", "))
        kinds = {"long": pa.int64(), "string": pa.string()}
        fields = [x.split() for x in OUTCOME.split(", ")]
        return pa.table([pa.array([key_values[0].as_py()] * len(out), table[key].type), *(pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields))], names=[key, *(n for n, _ in fields)])

    return commands.groupBy(key).applyInArrow(one, _outcome_schema(commands, key))
