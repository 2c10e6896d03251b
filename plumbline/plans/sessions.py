"""Session plans over the conversation table; the stream form is exercised in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.plans.oracle import oracle
from plumbline.plans.registry import plan
from plumbline.streaming import session as S


def turns(t):
    """Turns with what each of them names, spread deterministically over the texts."""
    n = F.length("text")
    word = F.regexp_extract("text", r"^([^\s]+)", 1)
    none = F.array().cast("array<string>")
    return t.conversations.select(
        F.col("conv_id").cast("string").alias("session_id"), F.col("turn").cast("long").alias("turn"), "text",
        F.when(n % 3 == 0, word).alias("entity"), F.when(n % 7 == 0, F.col("role")).alias("metric"),
        F.when(n % 5 == 0, F.array(F.concat(F.lit("2024Q"), (n % 4 + 1).cast("string")))).otherwise(none).alias("periods"),
        (n % 17 == 0).alias("ambiguous"), (n % 2 == 0).alias("anaphoric"), (n % 13 == 0).alias("entity_free"),
        F.when(n % 4 == 0, F.array(F.lit("table"))).otherwise(none).alias("actions"))


# The rule turn by turn: what a session holds after turn n comes from what it held after turn n - 1.
WALK = """
    WITH RECURSIVE t AS (
      SELECT CAST(conv_id AS VARCHAR) AS session_id, CAST(turn AS BIGINT) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
             nullif(CASE WHEN length(text) % 3 = 0 THEN regexp_extract(text, '^([^\\s]+)', 1) END, '') AS e, nullif(CASE WHEN length(text) % 7 = 0 THEN role END, '') AS m,
             CASE WHEN length(text) % 5 = 0 THEN '2024Q' || (length(text) % 4 + 1) END AS p, CASE WHEN length(text) % 4 = 0 THEN 'table' END AS a,
             coalesce(length(text) % 17 = 0, false) AS ambiguous, coalesce(length(text) % 2 = 0, false) AS anaphoric, coalesce(length(text) % 13 = 0, false) AS free
      FROM conversations
    ), s AS (
      SELECT DISTINCT session_id, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS entity, CAST(NULL AS VARCHAR) AS metric, CAST(NULL AS VARCHAR) AS period, false AS had,
             CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS used_entity, CAST(NULL AS VARCHAR) AS used_metric, '' AS used_periods, false AS borrowed, false AS ask_back, '' AS inherited
      FROM t
      UNION ALL
      SELECT session_id, n, turn, CASE WHEN skip THEN entity ELSE coalesce(e, entity) END, CASE WHEN skip THEN metric ELSE coalesce(m, metric) END,
             CASE WHEN skip THEN period ELSE coalesce(p, period) END, CASE WHEN skip THEN had ELSE own OR lent OR dated END, CASE WHEN skip THEN action ELSE coalesce(a, action) END,
             CASE WHEN NOT skip THEN coalesce(e, CASE WHEN lent AND NOT free THEN entity END) END, CASE WHEN NOT skip THEN coalesce(m, CASE WHEN lent AND NOT free THEN metric END) END,
             CASE WHEN skip THEN '' ELSE coalesce(p, period, '') END, NOT skip AND NOT free AND (lent OR dated), skip,
             CASE WHEN NOT skip AND a IS NULL AND (own OR ((lent OR dated) AND NOT free) OR anaphoric) THEN coalesce(action, '') ELSE '' END
      FROM (SELECT *, back AND had AS lent, p IS NULL AND period IS NOT NULL AS dated, ambiguous OR (back AND NOT had) AS skip
            FROM (SELECT t.*, s.entity, s.metric, s.period, s.had, s.action, t.e IS NOT NULL OR t.m IS NOT NULL AS own,
                         NOT t.ambiguous AND t.e IS NULL AND t.m IS NULL AND t.anaphoric AND (s.entity IS NOT NULL OR s.metric IS NOT NULL) AS back
                  FROM s JOIN t ON t.session_id = s.session_id AND t.n = s.n + 1))
    )"""


@plan("sta_carry", oracle("", WALK + """
    SELECT session_id, turn, used_entity, used_metric, used_periods, entity AS remembered_entity, borrowed, ask_back, inherited FROM s WHERE n > 0"""))
def sta_carry(t):
    """STA-1/2: entity, metric, periods and actions carried along each conversation."""
    return S.carry(turns(t)).select(
        "session_id", "turn", "used_entity", "used_metric", F.array_join("used_periods", "/").alias("used_periods"), "remembered_entity",
        "borrowed", "ask_back", F.array_join("inherited", "/").alias("inherited"))


@plan("sta_final_states", oracle("", WALK + """
    SELECT session_id, CAST(to_json({'entity': entity, 'metric': metric, 'periods': CASE WHEN period IS NULL THEN CAST([] AS VARCHAR[]) ELSE [period] END, 'had': had,
                                     'actions': CASE WHEN action IS NULL THEN CAST([] AS VARCHAR[]) ELSE [action] END, 'turn': turn}) AS VARCHAR) AS state
    FROM s WHERE n > 0 QUALIFY n = max(n) OVER (PARTITION BY session_id)"""))
def sta_final_states(t):
    """STA-3: exported state of every conversation."""
    return S.final_states(turns(t))


@plan("sta_last_slots", oracle("", """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN regexp_extract(text, '^([^\\s]+)', 1) END IGNORE NULLS) OVER w AS last_entity,
           last_value(CASE WHEN length(text) % 7 = 0 THEN role END IGNORE NULLS) OVER w AS last_metric
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""))
def sta_last_slots(t):
    """STA-1/4: last named entity and metric per conversation."""
    seen = S.last_seen(turns(t).select("session_id", "turn", "entity", "metric"), "session_id", "turn", {"last_entity": F.col("entity"), "last_metric": F.col("metric")})
    return seen.select("session_id", "turn", "last_entity", "last_metric")


@plan("sta_last_purchase", oracle("", """
    SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_value FROM events"""))
def sta_last_purchase(t):
    """STA-1 over events: the value of the last purchase of each user so far."""
    e = t.events.select("event_id", "user_id", "event_type", "value")
    return S.last_seen(e, "user_id", "event_id", {"last_value": F.when(F.col("event_type") == "purchase", F.col("value"))}).select("event_id", "user_id", "last_value")


@plan("sta_borrowed_wording", oracle("", """
    SELECT session_id, turn, coalesce(w, text) AS wording, NOT has AND w IS NOT NULL AS borrowed FROM (
      SELECT CAST(conv_id AS VARCHAR) AS session_id, turn, text, contains(text, 'tion') AS has, last_value(CASE WHEN contains(text, 'tion') THEN text END IGNORE NULLS)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS w FROM conversations)"""))
def sta_borrowed_wording(t):
    """STA-6: the wording of the last turn that named a measure."""
    return S.borrowed_wording(turns(t), "tion")


@plan("sta_preferences", oracle("", """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, role AS name, arg_max(length(text), turn) AS value, max(turn) AS turn FROM conversations GROUP BY 1, 2"""))
def sta_preferences(t):
    """STA-5: the latest value of each preference with its turn."""
    return S.preferences(t.conversations.select(F.col("conv_id").cast("string").alias("session_id"), "turn", F.col("role").alias("name"), F.length("text").cast("bigint").alias("value")))
