"""Run logs: node timings, calls, budgets, usage and cost."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staycheck import values
from staycheck.operators.ranking import ranked, running_balance, running_sum
from staycheck.session import stage

BLOCK = 100_000


def _blocked(log: DataFrame) -> DataFrame:
    """A coarse step of the sequence number, so a very long run spreads over many tasks."""
    return log.withColumn("_block", F.expr(f"seq div {BLOCK}L"))


def pair_nodes(log: DataFrame) -> DataFrame:
    """One row per node entry, joined with the exit that closes it.

    Repeated entries close last-in first-out. An entry nothing closes stays, as does an exit that
    closes nothing. At one nesting level entries and exits alternate, so the n-th entry of a level
    belongs to its n-th exit. Levels and pairs are each written once: the steps after them read
    them more than once.
    """
    group = ["run_id", "node"]
    step = F.when(F.col("phase") == "enter", 1).otherwise(-1)
    b = running_balance(_blocked(log), group, ["_block"], ["seq"], step).withColumn(
        "_before", F.col("balance") - step - F.col("floor_before"))
    enter = F.col("phase") == "enter"
    b = b.withColumn("level", F.when(enter, F.col("_before") + 1).otherwise(F.col("_before")))
    b = stage(b.withColumn("orphan", ~enter & (F.col("level") == 0)).drop(
        "balance", "floor", "floor_before", "_before"))
    details = ["seq", "outcome", "duration_ms", "model_calls", "input_tokens", "output_tokens"]
    numbered = ranked(b.filter("not orphan"), [*group, "level", "phase"], ["_block"], ["seq"], "n")
    paired = numbered.groupBy(*group, "level", "n").agg(
        F.max(F.when(enter, F.col("seq"))).alias("enter_seq"),
        F.max(F.when(~enter, F.struct(*details))).alias("x"))
    orphans = b.filter("orphan").select(
        *group, F.lit(None).cast("bigint").alias("enter_seq"), F.struct(*details).alias("x"))
    both = paired.select(*group, "enter_seq", "x").unionByName(orphans)
    zero = F.lit(0).cast("bigint")
    return stage(both.select(
        *group, "enter_seq", F.col("x.seq").alias("exit_seq"),
        F.coalesce("x.outcome", F.lit("entered")).alias("outcome"),
        *[F.coalesce(f"x.{c}", zero).alias(c) for c in details[2:]],
        F.col("x").isNull().alias("entered_only"),
        F.coalesce("enter_seq", "x.seq").alias("seq")))


def timeline(timings: DataFrame) -> DataFrame:
    """Start and end of each node on the run's clock, and on a clock where nothing is too short to
    be seen."""
    shown = F.greatest(F.col("duration_ms"), F.lit(values.NODE_MIN_MS))
    out = running_sum(_blocked(timings), ["run_id"], ["_block"], ["seq"], {
        "end_ms": F.col("duration_ms"), "display_end_ms": shown})
    return out.withColumns({
        "start_ms": F.col("end_ms") - F.col("duration_ms"),
        "display_start_ms": F.col("display_end_ms") - shown}).drop("_block")


def stage_states(line: DataFrame, at_ms: int | None = None, finished: DataFrame | None = None) -> DataFrame:
    """pending, running, skipped or the exit outcome of every node of every run at a time. finished: the
    runs (run_id) that have a verdict; a node another run hasn't entered is pending however late it is, as it
    may still come. Without it every run is over."""
    upto = F.lit(True) if at_ms is None else F.col("display_end_ms") <= at_ms
    entered = F.lit(True) if at_ms is None else F.col("display_start_ms") <= at_ms
    seen = line.groupBy("run_id", "node").agg(
        F.max_by(F.when(upto & ~F.col("entered_only"), F.col("outcome")),
                 F.when(upto & ~F.col("entered_only"), F.col("seq"))).alias("left"),
        F.bool_or(entered).alias("entered"))
    ends = line.groupBy("run_id").agg(F.max("display_end_ms").alias("total"))
    over = F.lit(True) if at_ms is None else F.col("total") <= at_ms
    if finished is not None:
        done = finished.select("run_id").distinct().withColumn("_done", F.lit(True))
        ends = ends.join(done, "run_id", "left")
        over = over & F.coalesce("_done", F.lit(False))
    every = ends.withColumn("over", over).withColumn("node", F.explode(F.array(*[F.lit(n) for n in values.NODE_ORDER])))
    state = (
        F.when(F.col("left").isNotNull(), F.col("left"))
        .when(F.col("entered"), "running").when(F.col("over"), "skipped").otherwise("pending"))
    return every.join(seen, ["run_id", "node"], "left").select(
        "run_id", "node", state.alias("state"))


def open_nodes(timings: DataFrame) -> DataFrame:
    """run_id, node, node_seq: of the nodes of a run that were entered and never left, the one entered last
    (by its first entry), at its latest entry."""
    nodes = timings.groupBy("run_id", "node").agg(
        F.min("seq").alias("first"), F.max("seq").alias("latest"), F.bool_or(~F.col("entered_only")).alias("closed"))
    last = nodes.filter("not closed").groupBy("run_id").agg(F.max_by(F.struct("node", "latest"), "first").alias("x"))
    return last.select("run_id", "x.node", F.col("x.latest").alias("node_seq"))


def attribute_calls(timings: DataFrame, calls: DataFrame) -> DataFrame:
    """The node each model call belongs to: nodes take calls in order, as many as they report; the calls
    left over are those of the node that is still open, and of none where no node is.

    Each node's share is expanded to call numbers, so calls meet nodes on an equal key.
    """
    counted = running_sum(_blocked(timings), ["run_id"], ["_block"], ["seq"],
                          {"upto": F.col("model_calls")})
    slots = counted.filter("model_calls > 0").select(
        "run_id", "node", F.col("seq").alias("node_seq"), F.explode(F.sequence(
            F.col("upto") - F.col("model_calls") + 1, F.col("upto"))).alias("call_no"))
    numbered = ranked(_blocked(calls), ["run_id"], ["_block"], ["seq"], "call_no").drop("_block")
    last = open_nodes(timings).select("run_id", F.col("node").alias("_open"), F.col("node_seq").alias("_open_seq"))
    rest = F.when(F.col("agent") == "reviewer_assist", "review").otherwise("unattributed")
    return numbered.join(slots, ["run_id", "call_no"], "left").join(last, "run_id", "left").withColumns({
        "node": F.coalesce("node", "_open", rest), "node_seq": F.coalesce("node_seq", "_open_seq")}).drop("_open", "_open_seq")


def call_offsets(attributed: DataFrame, line: DataFrame) -> DataFrame:
    """When each call starts: its node's start plus the calls before it there. Calls no node made
    (the review's, and others) follow one another after the run's end."""
    starts = line.select("run_id", F.col("seq").alias("node_seq"), "start_ms", "display_start_ms")
    shown = F.greatest(F.col("duration_ms"), F.lit(values.CALL_MIN_MS))
    mine = attributed.filter("node_seq is not null")
    run = running_sum(_blocked(mine), ["run_id", "node_seq"], ["_block"], ["seq"], {
        "_end": F.col("duration_ms"), "_shown": shown}).drop("_block")
    ends = line.groupBy("run_id").agg(F.max("end_ms").alias("start_ms"),
                                      F.max("display_end_ms").alias("display_start_ms"))
    after = running_sum(_blocked(attributed.filter("node_seq is null")), ["run_id"], ["_block"], ["seq"], {
        "_end": F.col("duration_ms"), "_shown": shown}).drop("_block")
    placed = run.join(starts, ["run_id", "node_seq"]).unionByName(
        after.join(ends, "run_id", "left").fillna(0, ["start_ms", "display_start_ms"]))
    return placed.withColumns({
        "at_ms": F.col("start_ms") + F.col("_end") - F.col("duration_ms"),
        "display_ms": F.col("display_start_ms") + F.col("_shown") - shown}).drop("_end", "_shown")


def budget_audit(requests: DataFrame, per_agent: int = values.MAX_CALLS_PER_AGENT,
                 per_run: int = values.MAX_CALLS_PER_RUN, roster: list[str] | None = None) -> DataFrame:
    """What a router decides of each request: refused_unknown_agent (not in the roster; without a roster every
    agent is known), skipped (no work), granted, or refused_budget. Only granted requests spend. The first
    refused_budget ends the run: what comes after it is not_reached."""
    known = F.lit(True) if roster is None else F.coalesce(F.col("agent").isin(*roster), F.lit(False))
    blocked = _blocked(requests).withColumn("_spends", known & F.coalesce("needed", F.lit(False)))
    spending = blocked.filter("_spends")
    by_agent = ranked(spending, ["run_id", "agent"], ["_block"], ["seq"], "agent_no")
    both = ranked(by_agent, ["run_id"], ["_block"], ["seq"], "run_no").drop("_block")
    scope = F.when(F.col("agent_no") > per_agent, "per-agent").when(
        F.col("run_no") > per_run, "per-run")
    both = both.withColumn("scope", scope).unionByName(
        blocked.filter("not _spends").drop("_block"), allowMissingColumns=True)
    first = both.filter("scope is not null").groupBy("run_id").agg(F.min("seq").alias("_stop"))
    return both.join(first, "run_id", "left").withColumn(
        "disposition",
        F.when(F.col("seq") > F.col("_stop"), "not_reached")
        .when(~known, "refused_unknown_agent").when(~F.col("_spends"), "skipped")
        .when(F.col("seq") == F.col("_stop"), "refused_budget").otherwise("granted")).drop("_stop", "_spends")


def usage_per_agent(calls: DataFrame) -> DataFrame:
    sums = ["input_tokens", "output_tokens", "cache_read_tokens", "duration_ms"]
    return calls.groupBy("run_id", "agent").agg(
        F.count("*").alias("calls"), *[F.sum(c).alias(c) for c in sums])


def with_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """Cost per row, half-even to four places; null, not zero, where no rate applies."""
    r = rates.select("run_id", "input_per_mtok", "output_per_mtok", "cache_read_per_mtok")
    tokens = sum((F.col(f"{k}_tokens").cast("decimal(18,0)") * F.col(f"{k}_per_mtok")
                  for k in ("input", "output", "cache_read")), F.lit(0).cast("decimal(1,0)"))
    return usage.join(r, "run_id", "left").withColumn(
        "cost", F.bround((tokens / F.lit(1000000).cast("decimal(7,0)")).cast("decimal(28,12)"), 4)
    ).drop("input_per_mtok", "output_per_mtok", "cache_read_per_mtok")


def run_cost(costed: DataFrame) -> DataFrame:
    """The sum of the rounded rows, so the total equals the column above it."""
    return costed.groupBy("run_id").agg(
        F.sum("calls").alias("calls"),
        F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"))


def prompt_conflicts(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "agent").agg(
        F.count_distinct("prompt_version").alias("versions"),
        F.min("prompt_version").alias("first_version")).filter("versions > 1")


def tool_attempts(calls: DataFrame) -> DataFrame:
    """How often each call reached for each tool, refused attempts apart."""
    return calls.select("run_id", "seq", F.explode("tool_calls").alias("t")).groupBy(
        "run_id", "seq", "t.name", "t.allowed").agg(F.count("*").alias("attempts"))


def node_time(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(
        F.sum(F.when(F.col("phase") == "exit", F.col("duration_ms")).otherwise(0))
        .alias("total_ms"))


def failures_per_agent(calls: DataFrame) -> DataFrame:
    return calls.groupBy("run_id", "agent").agg(F.count("error").alias("failures"))


def refusals(routing: DataFrame) -> DataFrame:
    return routing.filter(F.col("disposition").startswith("refused"))


def latest_run(runs: DataFrame) -> DataFrame:
    return runs.groupBy("root").agg(F.max_by("run_id", F.struct("mtime", "run_id")).alias("run_id"))
