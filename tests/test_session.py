"""Session rules, stream against batch, export and resume."""

import json
import random
import time

import pytest

from plumbline.streaming import session as S

SCHEMA = (
    "session_id string, turn long, entity string, metric string, periods array<string>, ambiguous boolean, anaphoric boolean, "
    "entity_free boolean, actions array<string>"
)
TURNS = [
    ("a", 1, "X", None, ["2025Q4"], False, False, False, ["table"]),
    ("a", 2, None, None, [], False, True, False, []),  # borrows X and the period, inherits the action
    ("a", 3, None, None, ["2025Q3"], False, False, False, []),  # a new topic: nothing borrowed
    ("a", 4, None, None, [], False, True, False, []),  # "that" after an unrelated turn: ask back
    ("a", 5, "Y", None, [], True, False, False, []),  # ambiguous: state untouched
    ("a", 6, "Z", None, [], False, False, False, []),
    ("a", 7, None, None, [], False, True, True, []),  # an entity-free field undoes the borrowing
    ("b", 1, None, None, [], False, True, False, []),  # another session remembers nothing
]


def key(rows):
    return sorted((r.session_id, r.turn, r.used_entity, tuple(r.used_periods), r.borrowed, r.ask_back, tuple(r.inherited)) for r in rows)


WANT = [
    ("a", 1, "X", ("2025Q4",), False, False, ()), ("a", 2, "X", ("2025Q4",), True, False, ("table",)), ("a", 3, None, ("2025Q3",), False, False, ()),
    ("a", 4, None, (), False, True, ()), ("a", 5, None, (), False, True, ()), ("a", 6, "Z", ("2025Q3",), True, False, ("table",)),
    ("a", 7, None, ("2025Q3",), False, False, ("table",)), ("b", 1, None, (), False, False, ()),
]


def test_rules(spark):
    assert key(S.carry(spark.createDataFrame(TURNS, SCHEMA)).collect()) == WANT


def test_resume_equals_one_run(spark):
    first, second = spark.createDataFrame(TURNS[:3], SCHEMA), spark.createDataFrame(TURNS[3:], SCHEMA)
    got = S.carry(first).collect() + S.carry(second, S.final_states(first)).collect()
    assert key(got) == WANT


def test_stream_with_restart_equals_batch(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))

    def run_once():
        stream = S.carry_stream(spark.readStream.schema(SCHEMA).json(src))
        stream.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out).trigger(availableNow=True).start().awaitTermination()

    spark.createDataFrame(TURNS[:4], SCHEMA).coalesce(1).write.mode("append").json(src)
    run_once()
    spark.createDataFrame(TURNS[4:], SCHEMA).coalesce(1).write.mode("append").json(src)
    run_once()  # a new query picks the state up from the checkpoint
    assert key(spark.read.parquet(out).collect()) == WANT


@pytest.mark.parametrize("rows", [3000])
def test_last_seen_on_a_hot_session(spark, rows):
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    df = spark.range(rows).select(F.when(F.col("id") % 10 == 0, "b").otherwise("hot").alias("s"), "id", F.when(F.col("id") % 97 == 5, F.col("id")).alias("v"))
    split = S.last_seen(df, "s", "id", {"last": F.col("v")})
    w = W.partitionBy("s").orderBy("id").rowsBetween(W.unboundedPreceding, 0)
    plain = df.withColumn("last", F.last("v", ignorenulls=True).over(w))
    assert split.select("id", "last").exceptAll(plain.select("id", "last")).count() == 0


def walked(turns, start=None):
    """Every turn of every session by the step function, one after the other, and the last states."""
    states, out = dict(start or {}), []
    for t in sorted(turns, key=lambda t: (t[0], t[1])):
        row = dict(zip(S.FIELDS, t))
        states[t[0]], o = S.step(states.get(t[0], dict(S.START)), row)
        out.append((t[0], t[1], o["used_entity"], o["used_metric"], tuple(o["used_periods"]), o["remembered_entity"], o["borrowed"], o["ask_back"], tuple(o["inherited"])))
    return sorted(out, key=repr), states


def told(df):
    return sorted(((r.session_id, r.turn, r.used_entity, r.used_metric, tuple(r.used_periods), r.remembered_entity, r.borrowed, r.ask_back, tuple(r.inherited)) for r in df.collect()), key=repr)


def some_turns(seed, sessions, turns):
    rng = random.Random(seed)
    one = lambda p, x: x if rng.random() < p else None
    shape = {s: (rng.random() * 0.5, rng.random() * 0.5, rng.random()) for s in range(sessions)}
    rows = []
    for i in range(turns):
        s = 0 if i % 3 else rng.randrange(sessions)  # two thirds of all turns are one session
        named, dated, back = shape[s] if s else (0.05, 0.1, 0.7)
        rows.append((f"s{s}", i, one(named, f"E{rng.randrange(4)}"), one(named / 2, rng.choice(["", "M1", "M2"])), rng.choice([None, []]) if rng.random() > dated else [f"2024Q{rng.randrange(1, 5)}"],
                     one(0.9, rng.random() < 0.1), one(0.95, rng.random() < back), rng.random() < 0.1, [f"act{rng.randrange(3)}"] if rng.random() < 0.2 else []))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_running_values_equal_the_rule_turn_by_turn(spark, seed):
    rows = some_turns(seed, 12, 900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want, states = walked(rows)
    assert told(S.carry(df)) == want
    got = {r.session_id: json.loads(r.state) for r in S.final_states(df).collect()}
    assert got == {k: {**v, "periods": list(v["periods"] or []), "actions": list(v["actions"] or []), "entity": v["entity"] or None, "metric": v["metric"] or None} for k, v in states.items()}


def test_a_session_resumes_any_number_of_times(spark):
    rows = some_turns(9, 5, 400)
    parts = [spark.createDataFrame(rows[a:b], SCHEMA) for a, b in ((0, 100), (100, 250), (250, 400))]
    states, out = None, []
    for part in parts:
        out += told(S.carry(part, states))
        states = S.final_states(part, states)
    assert sorted(out, key=repr) == walked(rows)[0]
    whole = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.state for r in states.collect()) == sorted(r.state for r in S.final_states(whole).collect())
    assert S.final_states(parts[0].filter("false"), states).count() == states.count()  # sessions without new turns keep their state


def test_a_hot_session_is_shared_among_tasks(spark):
    rows = some_turns(3, 3, 2000)
    placed = S._placed(spark.createDataFrame(rows, SCHEMA), "session_id", ["turn"])
    pieces = placed.filter("session_id = 's0'").groupBy("_piece").count().collect()
    assert len(pieces) >= 4 and max(r["count"] for r in pieces) < 1000


def test_no_session_walk_in_python(spark):
    plan = S.carry(spark.createDataFrame(some_turns(1, 3, 50), SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_idle_sessions_leave_the_store(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = SCHEMA + ", at timestamp"

    def write(rows):
        spark.createDataFrame(rows, SCHEMA + ", at string").selectExpr("*").coalesce(1).write.mode("append").json(src)

    def run_once():
        stream = S.carry_stream(spark.readStream.schema(schema).json(src), "at", late="1 minute", idle="30 minutes")
        q = stream.writeStream.format("parquet").option("checkpointLocation", ckpt).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    def turn(session, n, entity, at):
        return (session, n, entity, None, ["2025Q4"] if entity else [], False, True, False, [], at)

    write([turn("a", 1, "X", "2026-01-01T10:00:00Z"), turn("b", 1, "Y", "2026-01-01T10:00:00Z")])
    run_once()
    write([turn("a", 2, None, "2026-01-01T10:20:00Z")])  # soon enough: X is lent
    run_once()
    write([turn("c", 1, "Z", "2026-01-01T13:00:00Z")])  # the watermark passes the others by
    run_once()
    time.sleep(1.1)
    write([turn("b", 2, None, "2026-01-01T13:00:30Z")])  # too late: nothing is known any more
    run_once()
    got = {(r.session_id, r.turn): r.used_entity for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1): "X", ("b", 1): "Y", ("a", 2): "X", ("c", 1): "Z", ("b", 2): None}
