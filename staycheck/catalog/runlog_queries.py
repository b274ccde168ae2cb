"""Run logs, redaction and document comparison."""

from pyspark.sql import functions as F

from staycheck import values as v
from staycheck.catalog.reconcile_queries import num
from staycheck.catalog.registry import query
from staycheck.functions.text import pseudonym, redact, redaction_counts
from staycheck.operators import documents as dc
from staycheck.operators import runlog as rl
from staycheck.plans import adapters as a
from staycheck.session import shared_dir


def timings(spark, sf):
    return rl.pair_nodes(a.node_log(spark, sf))


@query("wn_07_node_pairs", "SELECT * FROM v_paired")
def _(spark, sf):
    return timings(spark, sf).select(
        "run_id", "node", "seq", F.coalesce("exit_seq", F.lit(-1)).alias("exit_seq"), "outcome",
        "duration_ms", "model_calls")


@query("wn_08_timeline", """
SELECT run_id, node, seq, end_ms - duration_ms AS start_ms, end_ms,
  display_end_ms - greatest(duration_ms, 400) AS display_start_ms, display_end_ms FROM v_line""")
def _(spark, sf):
    return rl.timeline(timings(spark, sf)).select(
        "run_id", "node", "seq", "start_ms", "end_ms", "display_start_ms", "display_end_ms")


@query("wn_08_call_offsets", """
SELECT run_id, seq, node, CAST(start_ms + sum(duration_ms) OVER w - duration_ms AS BIGINT) AS at_ms,
  CAST(display_start_ms + sum(greatest(duration_ms, 250)) OVER w - greatest(duration_ms, 250)
    AS BIGINT) AS display_ms
FROM v_attr WHERE node_seq IS NOT NULL WINDOW w AS (PARTITION BY run_id, node_seq ORDER BY seq)
UNION ALL
SELECT c.run_id, c.seq, c.node, CAST(coalesce(e.ms, 0) + sum(c.duration_ms) OVER w - c.duration_ms AS BIGINT),
  CAST(coalesce(e.display_ms, 0) + sum(greatest(c.duration_ms, 250)) OVER w - greatest(c.duration_ms, 250) AS BIGINT)
FROM v_attr c LEFT JOIN (SELECT run_id, max(end_ms) AS ms, max(display_end_ms) AS display_ms
  FROM v_line GROUP BY ALL) e USING (run_id)
WHERE c.node_seq IS NULL WINDOW w AS (PARTITION BY c.run_id ORDER BY c.seq)""")
def _(spark, sf):
    t = timings(spark, sf)
    return rl.call_offsets(rl.attribute_calls(t, a.call_log(spark, sf)), rl.timeline(t)).select(
        "run_id", "seq", "node", "at_ms", "display_ms")


STATES = """
SELECT r.run_id, n.node, CASE
  WHEN l.outcome IS NOT NULL THEN l.outcome
  WHEN e.run_id IS NOT NULL THEN 'running' WHEN {over} AND CAST(r.run_id[3:] AS BIGINT) % 3 <> 0
  THEN 'skipped' ELSE 'pending' END AS state
FROM (SELECT run_id, max(display_end_ms) AS total FROM v_line GROUP BY ALL) r
CROSS JOIN (SELECT DISTINCT node FROM v_nodes) n
LEFT JOIN (SELECT run_id, node, arg_max(outcome, seq) AS outcome FROM v_line
  WHERE exit_seq >= 0 AND {upto} GROUP BY ALL) l ON l.run_id = r.run_id AND l.node = n.node
LEFT JOIN (SELECT DISTINCT run_id, node FROM v_line WHERE {entered}) e
  ON e.run_id = r.run_id AND e.node = n.node"""


@query("wn_09_stage_states", STATES.format(
    over="r.total <= 3000", upto="display_end_ms <= 3000",
    entered="display_end_ms - greatest(duration_ms, 400) <= 3000"))
def _(spark, sf):
    return rl.stage_states(rl.timeline(timings(spark, sf)), 3000, a.finished_runs(spark, sf))


@query("wn_09_final_states", STATES.format(over="TRUE", upto="TRUE", entered="TRUE"))
def _(spark, sf):
    return rl.stage_states(rl.timeline(timings(spark, sf)), finished=a.finished_runs(spark, sf))


@query("jn_25_attribute_calls", "SELECT run_id, seq, agent, node FROM v_attr")
def _(spark, sf):
    return rl.attribute_calls(timings(spark, sf), a.call_log(spark, sf)).select(
        "run_id", "seq", "agent", "node")


@query("wn_10_budget_audit", """
WITH q AS (SELECT * REPLACE (CASE WHEN seq % 14 = 3 THEN 'ghost' ELSE agent END AS agent) FROM v_route),
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, agent ORDER BY seq) AS an,
    row_number() OVER (PARTITION BY run_id ORDER BY seq) AS rn FROM q WHERE needed AND agent <> 'ghost'),
s AS (SELECT run_id, min(seq) AS stop FROM r WHERE an > 9 OR rn > 24 GROUP BY ALL)
SELECT q.run_id, q.seq, q.agent, CASE WHEN seq > stop THEN 'not_reached' WHEN agent = 'ghost' THEN 'refused_unknown_agent'
  WHEN NOT needed THEN 'skipped' WHEN seq = stop THEN 'refused_budget' ELSE 'granted' END AS disposition
FROM q LEFT JOIN s USING (run_id)""")
def _(spark, sf):
    asked = a.routing_log(spark, sf).withColumn("agent", F.when(F.col("seq") % 14 == 3, "ghost").otherwise(F.col("agent")))
    return rl.budget_audit(asked, per_agent=9, per_run=24, roster=a.AGENTS).select("run_id", "seq", "agent", "disposition")


@query("ag_25_usage", "SELECT * EXCLUDE (user_id) FROM v_usage")
def _(spark, sf):
    return rl.usage_per_agent(a.call_log(spark, sf))


@query("jn_26_cost", """
SELECT run_id, agent, CAST(units AS DOUBLE) / 10000 AS cost FROM v_cost""")
def _(spark, sf):
    return rl.with_cost(rl.usage_per_agent(a.call_log(spark, sf)), a.rate_cards(spark, sf)).select(
        "run_id", "agent", num("cost"))


@query("ag_25_run_cost", """
SELECT run_id, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(units) AS DOUBLE) / 10000 AS cost
FROM v_cost GROUP BY ALL""")
def _(spark, sf):
    costed = rl.with_cost(rl.usage_per_agent(a.call_log(spark, sf)), a.rate_cards(spark, sf))
    return rl.run_cost(costed).select("run_id", "calls", num("cost"))


@query("ag_28_prompt_conflicts", """
SELECT run_id, agent, count(DISTINCT seq % 29 = 0) AS versions, 'v1' AS first_version FROM v_calls
GROUP BY ALL HAVING count(DISTINCT seq % 29 = 0) > 1""")
def _(spark, sf):
    return rl.prompt_conflicts(a.call_log(spark, sf))


@query("ag_32_tool_attempts", """
SELECT run_id, seq, CASE WHEN (seq + i) % 3 = 0 THEN 'list_sheets' ELSE 'peek_headers' END AS name,
  (seq + i) % 7 <> 0 AS allowed, count(*) AS attempts
FROM (SELECT run_id, seq, unnest(generate_series(0, seq % 4)) AS i FROM v_calls) GROUP BY ALL""")
def _(spark, sf):
    return rl.tool_attempts(a.call_log(spark, sf))


@query("ag_33_node_time", """
SELECT run_id, CAST(sum(duration_ms) FILTER (phase = 'exit') AS BIGINT) AS total_ms FROM v_nodes
GROUP BY ALL HAVING count(*) FILTER (phase = 'exit') > 0
UNION ALL SELECT run_id, 0 FROM v_nodes GROUP BY ALL HAVING count(*) FILTER (phase = 'exit') = 0""")
def _(spark, sf):
    return rl.node_time(a.node_log(spark, sf))


@query("ag_33_failures", """
SELECT run_id, agent, count(*) FILTER (failed) AS failures FROM v_calls GROUP BY ALL""")
def _(spark, sf):
    return rl.failures_per_agent(a.call_log(spark, sf))


@query("ag_33_refusals", """
SELECT run_id, seq, node, agent FROM v_route WHERE disposition LIKE 'refused%'""")
def _(spark, sf):
    return rl.refusals(a.routing_log(spark, sf)).select("run_id", "seq", "node", "agent")


@query("fl_05_latest_run", """
SELECT root, arg_max('R-' || event_id, event_id) AS run_id FROM (
  SELECT 'root-' || user_id AS root, event_id, ts FROM events) GROUP BY ALL""")
def _(spark, sf):
    runs = a.table(spark, sf, "events").select(
        F.concat(F.lit("root-"), F.col("user_id").cast("string")).alias("root"),
        F.col("ts").alias("mtime"), F.concat(F.lit("R-"), F.col("event_id").cast("string"))
        .alias("run_id"))
    return rl.latest_run(runs)


@query("src_04_read_logs", """
SELECT run_id, seq, node, phase, duration_ms FROM v_nodes""")
def _(spark, sf):
    from staycheck.sources.readers import read_nodes
    from staycheck.sources.writers import write_json_lines
    path = shared_dir(spark)
    write_json_lines(a.node_log(spark, sf), path, ["run_id", "seq"])
    return read_nodes(spark, path).select("run_id", "seq", "node", "phase", "duration_ms")


@query("snk_01_ordered_logs", """
SELECT run_id, seq, row_number() OVER (ORDER BY run_id, seq) AS line_no FROM v_calls""")
def _(spark, sf):
    """Every line and its place in the files as written."""
    from staycheck.sources.readers import numbered_lines
    from staycheck.sources.writers import write_json_lines
    path = shared_dir(spark)
    write_json_lines(a.call_log(spark, sf).repartition(7), path, ["run_id", "seq"])
    told = F.from_json("value", "run_id string, seq bigint")
    return numbered_lines(spark, path).select(told.alias("x"), "line_no").select("x.run_id", "x.seq", "line_no")


@query("src_04_routing", """
SELECT run_id, seq, node, agent, disposition, needed FROM v_route""")
def _(spark, sf):
    """The routing log through its files."""
    from staycheck.sources.readers import read_routing
    from staycheck.sources.writers import write_json_lines
    path = shared_dir(spark)
    write_json_lines(a.routing_log(spark, sf), path, ["run_id", "seq"])
    return read_routing(spark, path).drop("reason")


@query("sc_14_output_shape", """
SELECT run_id, seq, CASE WHEN seq % 17 = 0 THEN 'nothing'
  WHEN seq % 19 = 0 THEN 'unreadable JSON (7 chars)' WHEN seq % 23 = 0 THEN 'an empty object'
  ELSE 'k ' || seq % 100 || ' · name ' || CASE WHEN (seq % 40) * 2 <= 48
      THEN '"' || repeat('ab', seq % 40) || '"' ELSE '…(' || (seq % 40) * 2 || ' chars)' END
    || ' · ok ' || CASE WHEN seq % 2 = 0 THEN 'yes' ELSE 'no' END || ' · items [' || (2 + seq % 3)
    || '] · none - · o {1}' || CASE WHEN seq % 5 = 0 THEN ' · +2 more field(s)' ELSE '' END
  END AS shape FROM v_calls""")
def _(spark, sf):
    return a.call_log(spark, sf).select("run_id", "seq", dc.shape(F.col("output_json"))
                                        .alias("shape"))


@query("sc_11_json_lines", """
SELECT event_id AS doc_id, CAST(event_id % 50 AS BIGINT) AS k, 'R-' || user_id AS run FROM events""")
def _(spark, sf):
    docs = a.run_documents(spark, sf).withColumn("d", F.from_json(
        "doc", "run string, props struct<k: bigint>"))
    back = docs.withColumn("d", F.from_json(F.to_json("d"), "run string, props struct<k: bigint>"))
    return back.select("doc_id", "d.props.k", "d.run")


@query("jn_24_digest_differences", """
SELECT doc_id, coalesce(first, '') AS first, coalesce(second, '') AS second FROM (
  SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN sha256(text) END AS first,
    CASE WHEN doc_id % 11 <> 0 THEN sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END)
      END AS second FROM documents) WHERE first IS DISTINCT FROM second""")
def _(spark, sf):
    d = a.table(spark, sf, "documents")
    k = F.col("doc_id")
    first = d.filter(k % 13 != 0).select("doc_id", F.sha2("text", 256).alias("digest"))
    second = d.filter(k % 11 != 0).select("doc_id", F.sha2(F.when(
        k % 10 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("digest"))
    return dc.digest_differences(first, second, ["doc_id"]).na.fill("")


@query("jn_27_document_diff", """
SELECT event_id AS doc_id, 'props.k' AS path, 'value' AS why FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, 'items', 'length' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT event_id, 'extra', 'one side only' FROM events WHERE event_id % 13 = 0""")
def _(spark, sf):
    return dc.diff_documents(a.run_documents(spark, sf), a.run_documents(spark, sf, True), "doc_id",
                             "doc", ["nodes.duration_ms"])


@query("jn_27_odd_documents", """
WITH e AS (SELECT event_id AS k FROM events)
SELECT k AS doc_id, '' AS path, 'unreadable' AS why FROM e WHERE k % 10 = 1
UNION ALL SELECT k, '', 'one side only' FROM e WHERE k % 10 IN (2, 3)
UNION ALL SELECT k, repeat('d.', 19) || 'd', 'value' FROM e WHERE k % 10 = 4
UNION ALL SELECT k, 'w.f' || (k % 100), 'value' FROM e WHERE k % 10 = 5
UNION ALL SELECT k, 'w.f' || (k % 100), 'other kind' FROM e WHERE k % 10 = 6
UNION ALL SELECT k, 'x', 'one side only' FROM e WHERE k % 10 = 7""")
def _(spark, sf):
    """Documents that are no JSON, of one side only, deep and wide."""
    first, second = a.odd_documents(spark, sf)
    return dc.diff_documents(first, second, "doc_id", "doc", [])


def _sql_redaction(count: str | None = None) -> str:
    """The same chain for an engine whose word boundary is ASCII only."""
    text = "text"
    for name, pattern in v.REDACTION_PATTERNS:
        sql = pattern.replace("'", "''").replace("(?:", "(")
        if count == name:
            return f"len(regexp_extract_all({text}, '{sql}'))"
        text = f"regexp_replace({text}, '{sql}', '[redacted:{name}]', 'g')"
    return text


@query("prj_26_redact", f"SELECT doc_id, sha256({_sql_redaction()}) AS cleaned FROM documents")
def _(spark, sf):
    return a.table(spark, sf, "documents").select(
        "doc_id", F.sha2(redact(F.col("text")), 256).alias("cleaned"))


@query("ag_26_redaction_counts", "SELECT source, " + ", ".join(
    f"CAST(sum({_sql_redaction(n)}) AS BIGINT) AS {n}" for n, _ in v.REDACTION_PATTERNS)
    + " FROM documents GROUP BY ALL")
def _(spark, sf):
    counts = redaction_counts(F.col("text"))
    return a.table(spark, sf, "documents").groupBy("source").agg(
        *[F.sum(c).alias(n) for n, c in counts.items()])


@query("prj_27_pseudonyms", """
SELECT c_custkey, 'g_' || substring(sha256('salt:' || c_name), 1, 16) AS guest_ref FROM customer""")
def _(spark, sf):
    return a.table(spark, sf, "customer").select(
        "c_custkey", pseudonym("salt", F.col("c_name")).alias("guest_ref"))
