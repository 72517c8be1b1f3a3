"""Study-shaped tables made from the driver's tables, in SQL that both engines read.

Draws are md5 buckets, so the same rows come out on any engine and any partitioning. `@H[x]` stands for the first eight
hex digits of md5(x) as a number.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.session import table

#: name -> (driver tables and adapters it reads, SQL)
ADAPTERS: dict[str, tuple[list[str], str]] = {
    "predictions": (
        ["orders"],
        """
        SELECT claim_id, gold, model, cond, o_custkey, n_sets,
          CASE WHEN p < bar THEN gold WHEN p >= 98 THEN 'cannot tell ' || cast(p AS string)
               WHEN gold = 'Supported' THEN 'Refuted' ELSE 'Supported' END AS model_output
        FROM (
          SELECT o_orderkey AS claim_id, CASE WHEN @H['g' || cast(o_orderkey AS string)] % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS gold,
            model, cond, bar, o_custkey, 1 + @H['s' || cast(o_orderkey AS string)] % 4 AS n_sets,
            @H[cast(o_orderkey AS string) || ':' || model || ':' || cond] % 100 AS p
          FROM orders CROSS JOIN (VALUES ('large', 'claim_only', 88), ('large', 'with_evidence', 95), ('small', 'claim_only', 84), ('small', 'with_evidence', 94)) AS grid(model, cond, bar)
        ) x
        """,
    ),
    "judgments": (
        ["orders"],
        """
        SELECT item_id, stage, judge_no, 'judge_' || cast(judge_no AS string) AS judge_id, gold,
          CASE WHEN d < 72 THEN v0 ELSE CASE d % 3 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Refuted' ELSE 'Ambiguous' END END AS verdict,
          CASE s % 5 WHEN 0 THEN 'clearly_sufficient' WHEN 1 THEN 'probably_sufficient' WHEN 2 THEN 'partial_or_ambiguous' WHEN 3 THEN 'probably_insufficient' ELSE 'clearly_insufficient' END AS sufficiency,
          cast(s % 101 AS int) AS confidence,
          CASE s % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'partial_warrant' WHEN 2 THEN 'partial_warrant;negation_or_scope' WHEN 3 THEN 'multi_sentence_integration' WHEN 4 THEN 'negation_or_scope' WHEN 5 THEN 'other;numerical_or_temporal_reasoning' ELSE 'none' END AS flags
        FROM (
          SELECT o_orderkey AS item_id, stage, judge_no,
            CASE WHEN @H['g' || cast(o_orderkey AS string)] % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS gold,
            CASE WHEN @H['v' || cast(o_orderkey AS string) || stage] % 10 < 4 THEN 'Supported' WHEN @H['v' || cast(o_orderkey AS string) || stage] % 10 < 8 THEN 'Refuted' ELSE 'Ambiguous' END AS v0,
            @H[cast(o_orderkey AS string) || ':' || stage || ':' || cast(judge_no AS string)] % 100 AS d,
            @H['s' || cast(o_orderkey AS string) || ':' || stage || ':' || cast(judge_no AS string)] AS s
          FROM orders CROSS JOIN (VALUES ('A'), ('B'), ('C')) AS st(stage) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS j(judge_no)
        ) x
        """,
    ),
    "judgments_b": (["judgments"], "SELECT item_id, stage, judge_no, judge_id, gold, CASE WHEN @H['b' || cast(item_id AS string) || stage || judge_id] % 10 = 0 THEN 'Ambiguous' ELSE verdict END AS verdict, sufficiency, confidence, flags FROM judgments"),
    "attempts": (
        ["events"],
        """
        SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt, event_id, ts, event_type,
          CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'error' THEN 'error' WHEN 'click' THEN 'invalid' ELSE 'blocked' END AS status,
          @H['a' || cast(event_id AS string)] % 3000 AS agent, value
        FROM events
        """,
    ),
    "records": (
        ["attempts"],
        """
        SELECT job_id, attempt, event_id, status, agent, d, CASE WHEN d % 13 = 0 THEN NULL ELSE 'why' END AS reason, CASE WHEN d % 17 = 0 THEN ' ' ELSE 's' || cast(agent AS string) END AS session_id,
          d % 5 <> 0 AS has_raw, d % 3 = 0 AS explained, d % 31 <> 0 AS raw_intact, d % 37 = 0 AS raw_valid, 'locked' AS requested_model, CASE WHEN d % 19 = 0 THEN 'other' ELSE 'locked' END AS resolved_model,
          d % 23 <> 0 AS fresh_context, d % 67 = 0 AS inherited_context, d % 29 = 0 AS web_browse, d % 71 = 0 AS external_retrieval, CASE WHEN d % 41 = 0 THEN '0.7' ELSE 'provider_default' END AS temperature,
          CASE WHEN d % 43 = 0 THEN '' ELSE 'reviewer' END AS reviewer, d % 47 <> 0 AS reviewed, d % 500 AS started, d % 500 + d % 11 - 1 AS completed, CASE d % 3 WHEN 0 THEN 'available' ELSE 'not_exposed' END AS version_status,
          CASE WHEN d % 3 = 0 AND d % 7 <> 0 THEN 'v1' WHEN d % 59 = 0 THEN 'v2' END AS version, d % 53 <> 0 AS packet_intact, d % 61 <> 0 AS output_intact
        FROM (SELECT *, @H['r' || cast(event_id AS string)] AS d FROM attempts) x
        """,
    ),
    "log_lines": (
        ["attempts"],
        """
        SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS log, event_id * 5 + k AS seq,
          CASE k
            WHEN 0 THEN CASE WHEN status = 'blocked' THEN '  3| pump: archive already contains j' || cast(job_id AS string) ELSE 'START j' || cast(job_id AS string) || ' panel=p1 attempt=' || cast(attempt AS string) END
            WHEN 3 THEN CASE status WHEN 'accepted' THEN '12|ACCEPTED j' || cast(job_id AS string) WHEN 'error' THEN 'ATTEMPT_FAILED j' || cast(job_id AS string) || ' attempt=' || cast(attempt AS string) || ' code=' || cast(agent % 4 - 1 AS string)
              WHEN 'invalid' THEN 'CHECKPOINT_FAILED j' || cast(job_id AS string) || ' attempt=' || cast(attempt AS string) || ' code=1' ELSE 'delivered output already exists ' END
            WHEN 4 THEN CASE agent % 5 WHEN 0 THEN chr(123) || '"status":"pending_human_review","job_id":"j' || cast(job_id AS string) || '","attempt":' || cast(attempt AS string) || ',"agent_id":"a' || cast(agent AS string) || '"' || chr(125) WHEN 1 THEN '' ELSE 'waiting for START' END
            ELSE lpad(cast(agent % 24 AS string), 2, '0') || ':' || lpad(cast(event_id % 60 AS string), 2, '0') || ':00.' || cast(k AS string) || ' INFO node up' END AS line
        FROM attempts CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS n(k)
        """,
    ),
    "job_items": (
        ["orders"],
        """
        SELECT 'p01_j' || cast(judge_no AS string) || '_b' || cast(cast(floor(o_orderkey / 400) AS bigint) AS string) AS job_id, 'p01' AS panel, judge_no, o_orderkey AS item_id,
          CASE WHEN judge_no = 3 AND @H['slot' || cast(o_orderkey AS string)] % 499 = 0 THEN 'judge_2' ELSE 'judge_' || cast(judge_no AS string) END AS judge_id,
          'locked' AS model, 'SA-' || cast(o_orderkey AS string) AS source_id
        FROM orders CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS j(judge_no)
        """,
    ),
    "asked_items": (["job_items"], "SELECT job_id, item_id, item_id AS place, judge_id, @H['d' || job_id] % 8 AS d, row_number() OVER (PARTITION BY job_id ORDER BY item_id) AS r, count(*) OVER (PARTITION BY job_id) AS n FROM job_items"),
    "delivered_items": (
        ["asked_items"],
        """
        SELECT job_id, CASE WHEN d = 2 AND r = 2 THEN place * 10 + 25 ELSE place * 10 + k END AS place, CASE WHEN d = 1 AND k = 1 THEN -7 WHEN d = 5 AND r = 1 THEN -item_id ELSE item_id END AS item_id, 'C' AS stage,
          CASE WHEN d = 6 AND r = n THEN 'judge_9' ELSE judge_id END AS judge_id, CASE WHEN d = 4 AND r = 3 THEN 'Maybe' ELSE 'Supported' END AS verdict, 'clearly_sufficient' AS evidence_sufficiency,
          CASE WHEN d = 4 AND r = 2 THEN 101 ELSE cast(item_id % 101 AS int) END AS confidence, CASE WHEN item_id % 997 = 0 THEN 'none;odd' ELSE 'none;other' END AS flags, CASE WHEN d = 7 AND r = 1 THEN '  ' ELSE 'why' END AS brief_reason
        FROM asked_items CROSS JOIN (VALUES (0), (1)) AS twice(k)
        WHERE NOT (d = 0 AND r = n) AND (k = 0 OR (d = 1 AND r = n) OR (d = 3 AND r = 2)) AND NOT (d = 0 AND n < 3)
        """,
    ),
    "batch_lines": (
        ["judgments"],
        """
        SELECT stage || '_' || judge_id || '_' || cast(cast(floor(item_id / 5000) AS bigint) AS string) AS batch, stage, judge_id, item_id, item_id * 2 + k AS place,
          CASE WHEN k = 1 THEN '' WHEN h % 211 = 0 THEN '[1, 2]' WHEN h % 97 = 0 THEN substring(line, 1, 20) ELSE line END AS line, k = 0 AND h % 211 <> 0 AND h % 97 <> 0 AS good
        FROM (SELECT *, @H['l' || cast(item_id AS string) || stage || judge_id] AS h, chr(123) || '"item_id":' || cast(item_id AS string) || ',"stage":"' || stage || '","judge_id":"' || judge_id || '","verdict":"' || verdict || '"' || chr(125) AS line FROM judgments) x
        CROSS JOIN (VALUES (0), (1)) AS blank(k) WHERE k = 0 OR h % 5 = 0
        """,
    ),
    "run_events": (
        ["attempts"],
        """
        SELECT CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 7 END AS log, event_id * 6 + k AS seq,
          CASE k
            WHEN 0 THEN chr(123) || '"type":"status","status":"RUNNING","agent_id":"a' || cast(agent AS string) || '","run_id":"r' || cast(job_id AS string) || '"' || chr(125)
            WHEN 1 THEN chr(123) || '"type":"tool_call","status":"started","name":"' || tool || '","call_id":"c' || cast(event_id AS string) || '","agent_id":"a' || cast(agent AS string) || '"' || chr(125)
            WHEN 2 THEN CASE WHEN agent % 4 = 0 THEN '' ELSE chr(123) || '"type":"tool_call","status":"completed","name":"' || tool || '","call_id":"' || CASE WHEN agent % 9 = 0 THEN 'x' ELSE 'c' END || cast(event_id AS string) || '"' || chr(125) END
            WHEN 3 THEN CASE WHEN agent % 5 = 0 THEN '  ' ELSE chr(123) || '"agent_id":"","message":"said"' || chr(125) END
            WHEN 4 THEN CASE WHEN status = 'error' THEN chr(123) || '"type":"status","status":"ERROR","message":"m' || cast(event_id AS string) || '"' || chr(125) ELSE chr(123) || '"type":"status","status":"FINISHED"' || chr(125) END
            ELSE chr(123) || '"type":"tool_call","status":"completed","name":"finish"' || chr(125) END AS line
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'search' ELSE 'write' END AS tool FROM attempts) x CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) AS n(k)
        """,
    ),
    "run_records": (["attempts"], "SELECT 'j' || cast(job_id AS string) AS job, attempt, status, CASE WHEN @H['s' || cast(event_id AS string)] % 9 = 0 THEN 'unknown' WHEN @H['s' || cast(event_id AS string)] % 9 = 1 THEN 'a-other' ELSE 'a' || cast(agent AS string) END AS session FROM attempts WHERE @H['q' || cast(event_id AS string)] % 11 <> 0"),
    "run_staging": (
        ["attempts"],
        "SELECT 'j' || cast(job_id AS string) AS job, attempt, name, md5(name || cast(event_id AS string)) AS sha256, CASE WHEN name = 'events' THEN 'a' || cast(agent AS string) END AS agent, CASE WHEN name = 'output' THEN status IN ('accepted', 'error') END AS schema_valid FROM attempts CROSS JOIN (VALUES ('events'), ('output'), ('routing')) AS f(name) WHERE @H['t' || cast(event_id AS string)] % 6 <> 0",
    ),
    "run_inventory": (
        ["attempts"],
        "SELECT 'j' || cast(job_id AS string) AS job, attempt + CASE WHEN @H['u' || cast(event_id AS string)] % 13 = 0 THEN 1000 ELSE 0 END AS attempt, name, md5(name || cast(event_id AS string) || CASE WHEN @H['v' || cast(event_id AS string)] % 10 = 0 THEN 'x' ELSE '' END) AS sha256, CASE WHEN name = 'routing' THEN 'a' || cast(agent + CASE WHEN @H['w' || cast(event_id AS string)] % 12 = 0 THEN 1 ELSE 0 END AS string) END AS agent, CASE WHEN name = 'output' THEN false END AS schema_valid FROM attempts CROSS JOIN (VALUES ('output'), ('routing')) AS f(name) WHERE @H['t' || cast(event_id AS string)] % 5 <> 0",
    ),
    "texts": (
        ["documents", "labels"],
        """
        SELECT d.doc_id AS claim_id, d.lang, d.source, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, d.text,
          split_part(d.text, '.', 1) AS claim, substring(d.text, length(split_part(d.text, '.', 1)) + 2) AS evidence
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        """,
    ),
}

#: Views that only the oracle's SQL uses, on top of the adapters.
VIEWS: dict[str, tuple[list[str], str]] = {
    "judged": (
        ["predictions"],
        r"""
        SELECT *, prediction = gold AS correct,
          CASE WHEN prediction IS NULL THEN 'invalid_model_output' WHEN prediction <> gold THEN lower(gold) || '_to_' || lower(prediction) ELSE '' END AS error_type, CASE WHEN prediction IS NULL THEN 'invalid_model_output:' || model_output ELSE '' END AS notes
        FROM (SELECT *, CASE lower(regexp_extract(model_output, '(?i)\b(supported|refuted)\b', 1)) WHEN 'supported' THEN 'Supported' WHEN 'refuted' THEN 'Refuted' END AS prediction FROM predictions) p
        """,
    ),
    "paired": (
        ["judged"],
        """
        SELECT *, large_transition = small_transition AS agree_transition, large_claim_only IS NOT DISTINCT FROM small_claim_only AS agree_co, large_with_evidence IS NOT DISTINCT FROM small_with_evidence AS agree_ev
        FROM (
          SELECT *,
            CASE WHEN lco AND lev THEN 'robust' WHEN lev THEN 'rescue' WHEN lco THEN 'regression' ELSE 'resistant' END AS large_transition,
            CASE WHEN sco AND sev THEN 'robust' WHEN sev THEN 'rescue' WHEN sco THEN 'regression' ELSE 'resistant' END AS small_transition
          FROM (
            SELECT claim_id, min(gold) AS gold, min(n_sets) AS n_sets,
              min(prediction) FILTER (model = 'large' AND cond = 'claim_only') AS large_claim_only, min(prediction) FILTER (model = 'large' AND cond = 'with_evidence') AS large_with_evidence,
              min(prediction) FILTER (model = 'small' AND cond = 'claim_only') AS small_claim_only, min(prediction) FILTER (model = 'small' AND cond = 'with_evidence') AS small_with_evidence,
              coalesce(bool_or(correct) FILTER (model = 'large' AND cond = 'claim_only'), false) AS lco, coalesce(bool_or(correct) FILTER (model = 'large' AND cond = 'with_evidence'), false) AS lev,
              coalesce(bool_or(correct) FILTER (model = 'small' AND cond = 'claim_only'), false) AS sco, coalesce(bool_or(correct) FILTER (model = 'small' AND cond = 'with_evidence'), false) AS sev
            FROM judged GROUP BY claim_id) w) t
        """,
    ),
    "transitions": (
        ["paired"],
        """
        SELECT claim_id, gold, n_sets, 'large' AS model, large_transition AS transition, lco AS co, lev AS ev, large_with_evidence AS ev_output FROM paired
        UNION ALL SELECT claim_id, gold, n_sets, 'small', small_transition, sco, sev, small_with_evidence FROM paired
        """,
    ),
}

#: Adapters as Spark runs them where that says the same at less cost: a draw that depends on an order, or on an order and a
#: stage, is made before the rows are multiplied. The lines of a batch come together and in their order from a list of its
#: ids (5,000 at most), so lines are neither moved nor sorted.
PLANS: dict[str, str] = {
    "predictions": """
        SELECT claim_id, gold, model, cond, o_custkey, n_sets,
          CASE WHEN p < bar THEN gold WHEN p >= 98 THEN 'cannot tell ' || cast(p AS string)
               WHEN gold = 'Supported' THEN 'Refuted' ELSE 'Supported' END AS model_output
        FROM (
          SELECT claim_id, gold, model, cond, bar, o_custkey, n_sets, @H[cast(claim_id AS string) || ':' || model || ':' || cond] % 100 AS p
          FROM (SELECT o_orderkey AS claim_id, o_custkey, CASE WHEN @H['g' || cast(o_orderkey AS string)] % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS gold, 1 + @H['s' || cast(o_orderkey AS string)] % 4 AS n_sets FROM orders) o
          CROSS JOIN (VALUES ('large', 'claim_only', 88), ('large', 'with_evidence', 95), ('small', 'claim_only', 84), ('small', 'with_evidence', 94)) AS grid(model, cond, bar)
        ) x
        """,
    "judgments": """
        SELECT item_id, stage, judge_no, 'judge_' || cast(judge_no AS string) AS judge_id, gold,
          CASE WHEN d < 72 THEN v0 ELSE CASE d % 3 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Refuted' ELSE 'Ambiguous' END END AS verdict,
          CASE s % 5 WHEN 0 THEN 'clearly_sufficient' WHEN 1 THEN 'probably_sufficient' WHEN 2 THEN 'partial_or_ambiguous' WHEN 3 THEN 'probably_insufficient' ELSE 'clearly_insufficient' END AS sufficiency,
          cast(s % 101 AS int) AS confidence,
          CASE s % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'partial_warrant' WHEN 2 THEN 'partial_warrant;negation_or_scope' WHEN 3 THEN 'multi_sentence_integration' WHEN 4 THEN 'negation_or_scope' WHEN 5 THEN 'other;numerical_or_temporal_reasoning' ELSE 'none' END AS flags
        FROM (
          SELECT item_id, stage, judge_no, gold, CASE WHEN v < 4 THEN 'Supported' WHEN v < 8 THEN 'Refuted' ELSE 'Ambiguous' END AS v0,
            @H[cast(item_id AS string) || ':' || stage || ':' || cast(judge_no AS string)] % 100 AS d,
            @H['s' || cast(item_id AS string) || ':' || stage || ':' || cast(judge_no AS string)] AS s
          FROM (
            SELECT item_id, gold, stage, @H['v' || cast(item_id AS string) || stage] % 10 AS v
            FROM (SELECT o_orderkey AS item_id, CASE WHEN @H['g' || cast(o_orderkey AS string)] % 2 = 0 THEN 'Supported' ELSE 'Refuted' END AS gold FROM orders) o CROSS JOIN (VALUES ('A'), ('B'), ('C')) AS st(stage)
          ) w CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS j(judge_no)
        ) x
        """,
    "batch_lines": """
        SELECT batch, stage, judge_id, item_id, item_id * 2 + k AS place,
          CASE WHEN k = 1 THEN '' WHEN h % 211 = 0 THEN '[1, 2]' WHEN h % 97 = 0 THEN substring(line, 1, 20) ELSE line END AS line, k = 0 AND h % 211 <> 0 AND h % 97 <> 0 AS good
        FROM (
          SELECT batch, stage, judge_id, item_id, @H['l' || cast(item_id AS string) || stage || judge_id] AS h,
            chr(123) || '"item_id":' || cast(item_id AS string) || ',"stage":"' || stage || '","judge_id":"' || judge_id || '","verdict":"' ||
              CASE WHEN d < 72 THEN CASE WHEN v < 4 THEN 'Supported' WHEN v < 8 THEN 'Refuted' ELSE 'Ambiguous' END ELSE CASE d % 3 WHEN 0 THEN 'Supported' WHEN 1 THEN 'Refuted' ELSE 'Ambiguous' END END || '"' || chr(125) AS line
          FROM (
            SELECT batch, stage, judge_id, item_id, CASE stage WHEN 'A' THEN va WHEN 'B' THEN vb ELSE vc END AS v, @H[cast(item_id AS string) || ':' || stage || ':' || cast(judge_no AS string)] % 100 AS d
            FROM (
              SELECT stage || '_judge_' || cast(judge_no AS string) || '_' || cast(chunk AS string) AS batch, stage, judge_no, 'judge_' || cast(judge_no AS string) AS judge_id, inline(held)
              FROM (
                SELECT chunk, sort_array(collect_list(struct(o_orderkey AS item_id, @H['v' || cast(o_orderkey AS string) || 'A'] % 10 AS va, @H['v' || cast(o_orderkey AS string) || 'B'] % 10 AS vb, @H['v' || cast(o_orderkey AS string) || 'C'] % 10 AS vc))) AS held
                FROM order_chunks GROUP BY chunk
              ) c CROSS JOIN (VALUES ('A'), ('B'), ('C')) AS st(stage) CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS j(judge_no)
            ) i
          ) w
        ) x LATERAL VIEW explode(IF(h % 5 = 0, array(0, 1), array(0))) blank AS k
        """,
}

#: What the plan of an adapter reads where that is something else than its SQL does.
PLAN_NEEDS = {"batch_lines": ["order_chunks"]}

#: Tables whose rows an adapter multiplies, with their key.
MULTIPLIED = {"orders": "o_orderkey"}

_DRAW = re.compile(r"@H\[((?:[^\[\]])*)\]")


def _engine(sql: str, engine: str) -> str:
    if engine == "spark":
        return _DRAW.sub(lambda m: f"cast(conv(substr(md5({m[1]}), 1, 8), 16, 10) AS bigint)", sql)
    return _DRAW.sub(lambda m: f"cast(('0x' || substr(md5({m[1]}), 1, 8)) AS bigint)", re.sub(r"\bAS string\b", "AS varchar", sql))


def _dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; one whose rows are multiplied is dealt out by its key first, while its rows are few and short.

    A table of one file is read by few tasks, which would then make all rows; and what is grouped by the key, or by the key
    and more, is in one task already, so the many rows are not moved again.
    """
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), MULTIPLIED[name]) if name in MULTIPLIED else rows


def _order_chunks(orders: DataFrame) -> DataFrame:
    """(o_orderkey, chunk): orders dealt out by chunks of 5,000 keys, those of a batch."""
    rows = orders.select("o_orderkey", F.floor(F.col("o_orderkey") / 5000).cast("bigint").alias("chunk"))
    return rows.repartition(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk")


def judgment_ids(orders: DataFrame) -> DataFrame:
    """(stage, judge_id, item_id) of the judgments of orders, without any draw; those of a batch are in one task."""
    body = _engine(PLANS["judgments"], "spark").replace("FROM orders", "FROM {orders}")
    return orders.sparkSession.sql(body, orders=_order_chunks(orders)).select("stage", "judge_id", "item_id")


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The adapter's rows as a DataFrame over the driver's tables."""
    needs, sql = ADAPTERS[name]
    needs = PLAN_NEEDS.get(name, needs)
    frames = {n: _order_chunks(table(spark, sf_dir, "orders")) if n == "order_chunks" else adapter(spark, sf_dir, n) if n in ADAPTERS else _dealt(spark, sf_dir, n) for n in needs}
    body = _engine(PLANS.get(name, sql), "spark")
    for n in needs:
        body = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", body)
    return spark.sql(body, **frames)


def twin(names: str, sql: str) -> str:
    """sql for the oracle, behind the named adapters; `@H[x]` works in it too."""
    done: list[str] = []

    known = ADAPTERS | VIEWS

    def need(name: str) -> None:
        for n in known[name][0]:
            if n in known:
                need(n)
        if name not in done:
            done.append(name)

    for name in names.split():
        need(name)
    heads = [f"{n} AS ({_engine(known[n][1], 'duckdb')})" for n in done]
    body = _engine(sql, "duckdb").strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return lead + ", ".join(heads + [body[len(lead) :]]) if heads else body
    return ("WITH " + ", ".join(heads) + " " if heads else "") + body
