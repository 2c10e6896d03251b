"""What a conversation carries from turn to turn: entity, metric, periods, actions.

One small step function holds the rule; the stream form runs it with the state in the state store. The batch form says the same with running
values over pieces of sessions, so no task and no Python walks along a session. Slots that need no rule ("the last value seen") use :func:`last_seen`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.session import durable

ANAPHORA = "那|它|这个|那个|该|此|这家"  # fixed value
OUT = (
    "session_id string, turn long, used_entity string, used_metric string, used_periods array<string>, remembered_entity string, "
    "borrowed boolean, ask_back boolean, inherited array<string>"
)
FIELDS = ["session_id", "turn", "entity", "metric", "periods", "ambiguous", "anaphoric", "entity_free", "actions"]
STATE = "entity string, metric string, periods array<string>, had boolean, actions array<string>, turn long"
START = {"entity": None, "metric": None, "periods": [], "had": False, "actions": [], "turn": 0}


def _some(x) -> list:
    return [] if x is None else list(x)


def step(state: dict, row: dict) -> tuple[dict, dict]:
    """One turn. Ambiguity and an unclear "that one" ask back and leave the state alone but for the turn number."""
    s = {**state, "turn": row["turn"]}
    own, periods, acts = bool(row["entity"] or row["metric"]), _some(row["periods"]), _some(row["actions"])
    known = bool(s["entity"] or s["metric"])
    unclear = not own and known and row["anaphoric"] and not s["had"]
    if row["ambiguous"] or unclear:
        return s, {"used_entity": None, "used_metric": None, "used_periods": [], "remembered_entity": s["entity"], "borrowed": False, "ask_back": True, "inherited": []}
    lent = not own and known and row["anaphoric"]
    if own:
        s["entity"], s["metric"] = row["entity"] or s["entity"], row["metric"] or s["metric"]
    borrowed = lent or (not periods and bool(s["periods"]))
    s["periods"] = periods or s["periods"]
    s["had"] = own or borrowed
    if row["entity_free"]:
        borrowed = lent = False
    inherited = [] if acts or not (own or borrowed or row["anaphoric"]) else s["actions"]
    s["actions"] = acts or s["actions"]
    out = {
        "used_entity": row["entity"] or (s["entity"] if lent else None), "used_metric": row["metric"] or (s["metric"] if lent else None),
        "used_periods": s["periods"], "remembered_entity": s["entity"], "borrowed": borrowed, "ask_back": False, "inherited": inherited,
    }
    return s, out


def _rows(pdf: pd.DataFrame) -> Iterator[dict]:
    for r in pdf.to_dict("records"):
        yield {k: (None if not isinstance(v, (list, tuple)) and not hasattr(v, "__len__") and pd.isna(v) else v) for k, v in r.items()}


def _placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows in pieces: ranges of (key, order), so a key of any size is spread. Stored by (piece, key) in order; windows over a piece then move nothing."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(rows.repartitionByRange(n, key, *order).withColumn("_piece", F.spark_partition_id()))
    return durable(ranged.repartition(n, "_piece", key).sortWithinPartitions("_piece", key, *order))


def _so_far(placed: DataFrame, key: str, order: list[str], before: dict[str, Column], until: dict[str, Column] | None = None) -> DataFrame:
    """Adds to every row the last value that is not null of each column so far in its key: of ``before`` without the row's own value, of ``until`` with it.

    Each piece is scanned alone. What a key brings into a piece is known from one row per (piece, key); pieces are ranges, so at
    most the first key of a piece brings anything, and there are no more such rows than pieces.
    """
    columns = {**before, **(until or {})}
    marked = placed.withColumns({f"_now_{c}": v for c, v in columns.items()})
    at = F.struct(*order)
    ends = marked.groupBy("_piece", key).agg(*[F.max_by(f"_now_{c}", F.when(F.col(f"_now_{c}").isNotNull(), at)).alias(f"_end_{c}") for c in columns])
    earlier = W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    first = F.min("_piece").over(W.partitionBy(key))
    brought = (ends.select(F.col("_piece").alias("_into"), F.col(key).alias("_key"), first.alias("_first_piece"), *[F.last(f"_end_{c}", ignorenulls=True).over(earlier).alias(f"_in_{c}") for c in columns])
               .filter("_into > _first_piece").drop("_first_piece"))
    here = W.partitionBy("_piece", key).orderBy(*order)
    reach = {c: here.rowsBetween(W.unboundedPreceding, -1 if c in before else 0) for c in columns}
    same = (F.col("_piece") == F.col("_into")) & F.col(key).eqNullSafe(F.col("_key"))
    return (marked.join(F.broadcast(durable(brought)), same, "left")
            .select(*placed.columns, *[F.coalesce(F.last(f"_now_{c}", ignorenulls=True).over(reach[c]), F.col(f"_in_{c}")).alias(c) for c in columns]))


def _resolved(turns: DataFrame, states: DataFrame | None) -> DataFrame:
    """Every turn with what the session held before and after it.

    The rule (:func:`step`) as running values, each found from those before it, without walking along a session:

    * ``known``: a turn that is not ambiguous named an entity or a measure before.
    * The kind of a turn: ``x`` ambiguous, ``s`` an earlier state, ``o`` names something itself, ``a`` points back ("that one") at something known, ``n`` neither.
      Only ``s``, ``o`` and ``n`` decide whether the topic is held (``had``): ``o`` does, ``n`` does if it borrows a period.
    * As long as no period has been taken, ``n`` does not hold the topic; so the first period taken is found with that, and from then on there is one.
    * With it ``had`` is known everywhere, hence which turns are skipped, hence the last value of each slot.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = turns.select(
        "session_id", F.lit(1).alias("_later"), F.col("turn").cast("long").alias("turn"), text("entity").alias("entity"), text("metric").alias("metric"), some("periods").alias("periods"),
        some("actions").alias("actions"), flag("ambiguous").alias("ambiguous"), flag("anaphoric").alias("anaphoric"), flag("entity_free").alias("entity_free"), F.lit(None).cast("boolean").alias("seed"))
    if states is not None:
        s = F.from_json("state", STATE)
        rows = rows.unionByName(states.select("session_id", s.alias("s")).select(
            "session_id", F.lit(0).alias("_later"), F.coalesce("s.turn", F.lit(0)).alias("turn"), text("s.entity").alias("entity"), text("s.metric").alias("metric"),
            some("s.periods").alias("periods"), some("s.actions").alias("actions"), *[F.lit(False).alias(c) for c in ("ambiguous", "anaphoric", "entity_free")],
            F.coalesce("s.had", F.lit(False)).alias("seed")))
    rows = rows.withColumn("_tie", F.xxhash64("entity", "metric", "periods", "actions", "ambiguous", "anaphoric", "entity_free"))
    order = ["_later", "turn", "_tie"]
    own = F.col("entity").isNotNull() | F.col("metric").isNotNull()
    has_period = F.col("periods").isNotNull()
    kind = F.col("kind")

    def so_far(df: DataFrame, before: dict[str, Column], until: dict[str, Column] | None = None) -> DataFrame:
        return _so_far(df, "session_id", order, before, until)

    df = so_far(_placed(rows, "session_id", order), {"known": F.when(own & ~F.col("ambiguous"), True)})
    df = df.withColumn("kind", F.when(F.col("seed").isNotNull(), "s").when(F.col("ambiguous"), "x").when(own, "o").when(F.col("known") & F.col("anaphoric"), "a").otherwise("n"))
    df = so_far(df, {"held": F.when(kind == "s", F.col("seed")).when(kind == "o", True).when(kind == "n", False)})
    taken = has_period & (kind.isin("s", "o", "n") | ((kind == "a") & F.coalesce("held", F.lit(False))))
    df = so_far(df, {"dated": F.when(taken, True)}).withColumn("dated", F.coalesce("dated", F.lit(False)))
    sets = F.when(kind == "s", F.col("seed")).when(kind == "o", True).when(kind == "n", ~has_period & F.col("dated"))
    df = so_far(df, {"had": sets}).withColumn("had", F.coalesce("had", F.lit(False)))
    df = df.withColumn("skipped", (kind == "x") | ((kind == "a") & ~F.col("had")))
    kept = lambda c: F.when(~F.col("skipped") & F.col(c).isNotNull(), F.col(c))
    df = so_far(df, {"b_actions": kept("actions")}, {"s_entity": kept("entity"), "s_metric": kept("metric"), "s_periods": kept("periods"), "s_actions": kept("actions")})
    return df.withColumn("has_now", F.coalesce(sets, F.col("had")))


def carry(turns: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """Batch form: ``turns`` with the columns of ``FIELDS``; ``states(session_id, state)`` resumes earlier sessions.

    JVM windows over pieces of sessions; a session with a third of all turns is shared among all tasks. Turns of one number are taken in the order of a hash.
    """
    df = _resolved(turns, states).filter("kind <> 's'")
    own, skipped, free = F.col("kind") == "o", F.col("skipped"), F.col("entity_free")
    lent = (F.col("kind") == "a") & ~skipped & ~free
    borrowed = (((F.col("kind") == "a") & ~skipped) | (F.col("periods").isNull() & F.col("dated"))) & ~free & ~skipped
    none = F.array().cast("array<string>")
    inherits = ~skipped & F.col("actions").isNull() & (own | borrowed | F.col("anaphoric"))
    return df.select(
        "session_id", "turn", F.when(~skipped, F.coalesce("entity", F.when(lent, F.col("s_entity")))).alias("used_entity"),
        F.when(~skipped, F.coalesce("metric", F.when(lent, F.col("s_metric")))).alias("used_metric"),
        F.when(skipped, none).otherwise(F.coalesce("s_periods", none)).alias("used_periods"), F.col("s_entity").alias("remembered_entity"),
        borrowed.alias("borrowed"), skipped.alias("ask_back"), F.when(inherits, F.coalesce("b_actions", none)).otherwise(none).alias("inherited"))


def final_states(turns: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(session_id, state): the exported state after the last turn, as JSON; with ``states`` it goes on from them, so a session may come in any number of parts."""
    none = F.array().cast("array<string>")
    after = F.struct(F.col("s_entity").alias("entity"), F.col("s_metric").alias("metric"), F.coalesce("s_periods", none).alias("periods"), F.col("has_now").alias("had"),
                     F.coalesce("s_actions", none).alias("actions"), "turn")
    last = _resolved(turns, states).groupBy("session_id").agg(F.max_by(after, F.struct("_later", "turn", "_tie")).alias("s"))
    return durable(last.select("session_id", F.to_json("s", {"ignoreNullFields": "false"}).alias("state")))


def carry_stream(turns: DataFrame, event_time: str | None = None, late: str = "10 minutes", idle: str = "30 minutes") -> DataFrame:
    """Stream form: the state of each session lives in the state store and survives a restart from the checkpoint.

    Turns are ordered inside a batch; across batches they are taken as they arrive. With ``event_time`` a session that the watermark (``late`` behind) has
    left ``idle`` behind is forgotten, so the store holds the sessions that are going on; a turn after that begins the session anew.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key, pdfs, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        s = json.loads(state.get[0]) if state.exists else dict(START)
        rows = pd.concat(list(pdfs)).sort_values("turn")
        out = []
        for r in _rows(rows):
            s, o = step(s, {**r, "turn": int(r["turn"])})
            s = {k: _some(v) if k in ("periods", "actions") else v for k, v in s.items()}
            out.append({"session_id": key[0], "turn": r["turn"], **o})
        state.update((json.dumps(s, ensure_ascii=False),))
        if event_time is not None:
            newest = int(rows["event_time"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    if event_time is None:
        return turns.select(*FIELDS).groupBy("session_id").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)
    timed = turns.withColumn("event_time", F.col(event_time)).select(*FIELDS, "event_time").withWatermark("event_time", late)
    return timed.groupBy("session_id").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def last_seen(df: DataFrame, key: str, order: str, columns: dict[str, Column]) -> DataFrame:
    """For each row the last non-null value of each column so far, itself included.

    Rows are range-partitioned by key and order. Each piece is scanned alone; what the pieces before it ended with is
    found on one row per (key, piece), so a session with a third of all turns is still shared among tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = df.select("*", *[c.alias(f"_{name}") for name, c in columns.items()])
    placed = durable(named.repartitionByRange(n, key, order).withColumn("_piece", F.spark_partition_id()))
    here = W.partitionBy("_piece", key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    ends = placed.groupBy("_piece", key).agg(*[
        F.max(F.when(F.col(f"_{c}").isNotNull(), F.struct(order, f"_{c}")))[f"_{c}"].alias(f"_end_{c}") for c in columns])
    carried = ends.select("_piece", key, *[F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_in_{c}") for c in columns])
    return placed.join(carried, ["_piece", key]).select(
        *df.columns, *[F.coalesce(F.last(f"_{c}", ignorenulls=True).over(here), F.col(f"_in_{c}")).alias(c) for c in columns])


def borrowed_wording(turns: DataFrame, measure: str) -> DataFrame:
    """The wording to use: the turn's own, or the last one that named a measure. ``turns(session_id, turn, text)``."""
    has = F.col("text").rlike(measure)
    seen = last_seen(turns.select("session_id", "turn", "text"), "session_id", "turn", {"wording": F.when(has, F.col("text"))})
    return seen.select("session_id", "turn", F.coalesce("wording", "text").alias("wording"), (~has & F.col("wording").isNotNull()).alias("borrowed"))


def preferences(stated: DataFrame) -> DataFrame:
    """The latest value of each preference of a session with the turn that set it. ``stated(session_id, turn, name, value)``."""
    return stated.groupBy("session_id", "name").agg(F.max(F.struct("turn", "value")).alias("p")).select(
        "session_id", "name", F.col("p.value").alias("value"), F.col("p.turn").alias("turn"))
