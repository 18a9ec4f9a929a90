import random

from vigil.operators import versions as V

STORED = "id string, sum string, active boolean, version long"


def test_ingest_once_and_again(spark):
    stored = spark.createDataFrame([("same", "1", True, 3), ("new sum", "1", True, 1), ("back", "1", False, 2), ("back new", "1", False, 2), ("gone", "1", True, 4), ("away", "1", False, 5), (None, None, True, 1)], STORED)
    batch = spark.createDataFrame([("same", "1"), ("new sum", "2"), ("back", "1"), ("back new", "2"), ("first", "1"), ("first", "0"), (None, None)], "id string, sum string")
    done = V.ingest(stored, batch, "id", "sum")
    got = {r.id: (r.sum, r.active, r.version, r.action) for r in done.collect()}
    assert got == {"same": ("1", True, 3, "skipped"), "new sum": ("2", True, 2, "updated"), "back": ("1", True, 3, "reactivated"), "back new": ("2", True, 3, "updated"), "first": ("1", True, 1, "inserted"),
                   "gone": ("1", False, 5, "removed"), "away": ("1", False, 5, "absent"), None: (None, True, 1, "skipped")}
    assert V.ingest_counts(done).first().asDict() == {"inserted": 1, "updated": 2, "skipped": 2, "reactivated": 1, "removed": 1, "absent": 1}
    again = V.ingest(done.drop("action"), batch, "id", "sum")
    assert V.ingest_counts(again).first().asDict() == {"inserted": 0, "updated": 0, "skipped": 6, "reactivated": 0, "removed": 0, "absent": 2}
    assert sorted(map(str, again.drop("action").collect())) == sorted(map(str, done.drop("action").collect()))
    assert {r.action for r in V.ingest(stored, batch.limit(0), "id", "sum").collect()} == {"removed", "absent"}
    assert {r.action for r in V.ingest(stored.limit(0), batch, "id", "sum").collect()} == {"inserted"} and V.ingest(stored.limit(0), batch.limit(0), "id", "sum").count() == 0


def test_two_conflicting_batches(spark):
    writes = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, 0), ("b", 2, 1), ("b", 3, 7), ("b", 4, None), (None, 1, 0), (None, 2, 0)], "k string, batch int, expected long")
    got = sorted((r.k or "", r.batch, r.outcome, r.version) for r in V.compare_and_set(writes, "k", ["batch"], "expected").collect())
    assert got == [("", 1, "APPLIED", 1), ("", 2, "CONFLICT", 1), ("a", 1, "APPLIED", 1), ("a", 2, "CONFLICT", 1), ("b", 1, "APPLIED", 1), ("b", 2, "APPLIED", 2), ("b", 3, "CONFLICT", 2), ("b", 4, "APPLIED", 3)]
    assert V.compare_and_set(writes.limit(0), "k", ["batch"], "expected").count() == 0


def test_registrations(spark):
    rows = [("m", "s", "x", 1), ("m", "s", "y", 2), ("m", "s", "x", 3), ("m", "t", None, 4), ("m", "t", None, 5), ("m", None, "x", 6), (None, "s", "x", 7), (None, "s", "x", 8)]
    r = spark.createDataFrame(rows, "model string, source string, digest string, at int").repartition(3)
    got = sorted((x.at, x.outcome, x.version) for x in V.registrations(r, "model", "source", "digest", ["at"]).collect())
    assert got == [(1, "REGISTERED", 1), (2, "MISMATCH", None), (3, "REUSED", 1), (4, "REGISTERED", 2), (5, "REUSED", 2), (6, "REGISTERED", 3), (7, "REGISTERED", 1), (8, "REUSED", 1)]


def test_aliases_equal_a_fold_of_the_log(spark):
    r = random.Random(3)
    actions = ["candidate", "promote", "rollback", "retire"]
    moves = [(m, i, r.choice(actions), r.choice([1, 2, 3, 4, 9, None])) for m in ("a", "b", "c", None) for i in range(r.randint(1, 40))] + [("d", 0, "promote", 9)]
    known = [(m, v, v != 4) for m in ("a", "b", "c", "d") for v in (1, 2, 3, 4)]
    audit = V.alias_audit(spark.createDataFrame(moves, "model string, at int, action string, version int").repartition(3), spark.createDataFrame(known, "model string, version int, valid boolean"), "model", ["at"])
    state, want = {}, []
    for m, i, action, version in moves:
        s = state.setdefault(m, dict.fromkeys(("candidate", "champion", "previous_champion")) | {"applied": 0, "rejected": 0})
        status = "UNKNOWN_VERSION" if m is None or version in (9, None) else "NOT_VALID" if version == 4 else "UNKNOWN_ACTION" if action == "retire" else "APPLIED"
        want.append((m or "", i, status, s["champion"]))
        s["applied" if status == "APPLIED" else "rejected"] += 1
        if status == "APPLIED" and action == "candidate":
            s["candidate"] = version
        elif status == "APPLIED" and s["champion"] != version:
            s["previous_champion"], s["champion"] = s["champion"], version
    assert sorted(((x.model or "", x.at, x.status, x.champion_before) for x in audit.collect()), key=lambda x: x[:2]) == sorted(want, key=lambda x: x[:2])
    got = {x.model: {k: x[k] for k in state["a"]} for x in V.aliases(audit, "model", ["at"]).collect()}
    assert got == state
