"""Audits of agent, approval and tool-call logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sievework.functions.columns import ratio, reasons
from sievework.functions.scan import running


def audit_trail(events: DataFrame, run: str, order: Sequence[str], state: str, allowed: Sequence[tuple[str, str]], terminal: Sequence[str], block: Column, link: str, prev_link: str) -> DataFrame:
    """Per run: undefined transitions, events after a terminal state, missing
    terminal, broken hash links (first event links to the empty text).

    The state before each event comes from one block scan of the run."""
    at = F.struct(*[F.col(o) for o in order], F.col(state).alias("state"), F.col(link).alias("link"))
    done = F.when(F.col(state).isin(*terminal), 1).otherwise(0)
    s = running(events, [run], list(order), block, inclusive=False, _before=("max", at), _ended=("max", done))
    edge = F.concat_ws(">", F.col("_before.state"), F.col(state))
    known = edge.isin(*[f"{a}>{b}" for a, b in allowed])
    return s.groupBy(run).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("_before").isNotNull() & ~known).alias("undefined_transitions"),
        F.count_if(F.coalesce("_ended", F.lit(0)) == 1).alias("after_terminal"), (F.max(done) == 0).alias("missing_terminal"),
        F.count_if(F.col(prev_link) != F.coalesce(F.col("_before.link"), F.lit(""))).alias("link_breaks"),
    )


def approval_audit(calls: DataFrame, approvals: DataFrame) -> DataFrame:
    """calls(call_id, args_hash, requester, effect_at), approvals(call_id,
    approved_hash, approver, approved_at, expires_at): verdict with reasons."""
    j = calls.join(approvals, "call_id", "left")
    why = reasons(
        [
            ("not_approved", F.col("approver").isNull()), ("arguments_changed", F.col("args_hash") != F.col("approved_hash")),
            ("expired", F.col("effect_at") >= F.col("expires_at")), ("self_approved", F.col("approver") == F.col("requester")),
            ("approved_after_effect", F.col("approved_at") > F.col("effect_at")),
        ]
    )
    return j.withColumn("reasons", why).select("call_id", "reasons", (F.size("reasons") == 0).alias("valid"))


def idempotency_audit(calls: DataFrame, parts: Sequence[str], effect: Column) -> DataFrame:
    """Execution keys whose effects are not exactly one, with their attempts."""
    key = F.md5(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]))
    g = calls.groupBy(key.alias("exec_key")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(effect).alias("effects"))
    return g.where("effects <> 1").withColumn("problem", F.when(F.col("effects") == 0, "no_effect").otherwise("repeated_effect"))


def agent_metrics(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """By label source: success, tool and argument match, length, violations,
    approvals, retries, latency, tokens.

    runs(run_id, label_source, success), steps(run_id, tool, args,
    expected_tool, expected_args, violation, approved, retry, latency_ms, tokens)."""
    b = lambda c: c.cast("int")
    s = steps.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("len"), F.sum(b(F.col("tool") == F.col("expected_tool"))).alias("tool_ok"),
        F.sum(b((F.col("tool") == F.col("expected_tool")) & (F.col("args") == F.col("expected_args")))).alias("args_ok"),
        F.sum(b(F.col("violation"))).alias("violations"), F.sum(b(F.col("approved"))).alias("approvals"), F.sum(b(F.col("retry"))).alias("retries"),
        F.sum("latency_ms").alias("latency"), F.sum("tokens").alias("tokens"),
    )
    j = runs.join(s, "run_id", "left")
    tot = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return j.groupBy("label_source").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"),
        F.round(ratio(F.sum("tool_ok"), F.sum("len")), 6).alias("tool_match"), F.round(ratio(F.sum("args_ok"), F.sum("len")), 6).alias("argument_match"),
        F.round(F.avg(F.coalesce("len", F.lit(0))), 6).alias("mean_length"), tot("violations").alias("violations"), tot("approvals").alias("approvals"),
        tot("retries").alias("retries"), F.round(F.avg("latency"), 6).alias("mean_latency_ms"), tot("tokens").alias("tokens"),
    )
