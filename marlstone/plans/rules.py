"""Rule findings: a rule is a predicate with a severity; all of them are one pass over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def findings(rows: DataFrame, rules: list[tuple[str, str, Column]], *keep: str) -> DataFrame:
    """(kept columns, rule, severity) for each rule that holds of a row."""
    tested = F.array(*[F.when(p, F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, severity, p in rules])
    return rows.select(*keep, F.explode(F.filter(tested, lambda x: x.isNotNull())).alias("f")).select(*keep, "f.rule", "f.severity")


def health_score(cpu: Column, memory: Column, disk: Column, cache: Column) -> Column:
    free = [F.greatest(F.lit(0.0), 100 - x) for x in (cpu, memory, disk, cache)]
    return F.round(sum(w * x for w, x in zip((0.3, 0.3, 0.2, 0.2), free)), 2)


def health_label(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "warning").otherwise("critical")


def relevance(similarity: Column, match: Column, completeness: Column, accuracy: Column) -> tuple[Column, Column]:
    score = 0.4 * similarity + 0.3 * match + 0.2 * completeness + 0.1 * accuracy
    return score, F.when(score > 0.8, "high").when(score > 0.5, "medium").when(score > 0.3, "low").otherwise("none")


# Thresholds and words of the rules for cluster resources.
CPU, MEMORY, RESTARTS = 0.8, 1.5 * 1024**3, 1.0
BAD_PHASES = "pending failed unknown".split()
BAD_REASONS = "CrashLoopBackOff ImagePullBackOff ErrImagePull".split()
PRESSURES = "MemoryPressure DiskPressure PIDPressure".split()
STATUS = """status struct<phase:string,readyReplicas:int,containerStatuses:array<struct<name:string,state:struct<waiting:struct<reason:string>>>>,
conditions:array<struct<type:string,status:string>>>, spec struct<replicas:int>"""


def _finding(rule: Column, severity: str, holds: Column) -> Column:
    return F.when(holds, F.struct(rule.alias("rule"), F.lit(severity).alias("severity")))


def resource_findings(rows: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, rule, severity) of resources (kind, api, cpu, memory, restarts, connections, logs).

    ``api`` is the resource as JSON. Pods are judged by phase, waiting reasons, metrics and logs, nodes by
    conditions and CPU, services by connections, deployments by replicas; what is null is not judged.
    """
    api = rows.withColumn("_a", F.from_json("api", STATUS))
    status, logs = F.col("_a.status"), F.coalesce("logs", F.lit(""))
    one = lambda name, severity, holds: F.array(_finding(F.lit(name), severity, holds))
    waiting = F.transform(F.filter(status["containerStatuses"], lambda c: c["state"]["waiting"]["reason"].isin(BAD_REASONS)), lambda c: F.struct(F.concat(F.lit("POD_"), F.upper(c["state"]["waiting"]["reason"])).alias("rule"), F.lit("critical").alias("severity")))
    high_cpu = F.col("cpu") > CPU
    none = F.array().cast("array<struct<rule:string,severity:string>>")
    pod = F.concat(
        one("POD_UNHEALTHY", "critical", F.lower(status["phase"]).isin(BAD_PHASES)), F.coalesce(waiting, none), one("HIGH_CPU_USAGE", "warning", high_cpu),
        one("HIGH_MEMORY_USAGE", "warning", F.col("memory") > MEMORY), one("RESTART_LOOP", "critical", F.col("restarts") > RESTARTS),
        one("LOG_OOM", "critical", logs.contains("OOMKilled") | logs.contains("OutOfMemory")), one("LOG_CRASH_LOOP", "warning", logs.contains("CrashLoopBackOff")),
    )
    condition = lambda c: F.when(
        (c["type"] == "Ready") & (F.lower(F.coalesce(c["status"], F.lit(""))) != "true"), F.struct(F.lit("NODE_NOT_READY").alias("rule"), F.lit("critical").alias("severity"))
    ).when(c["type"].isin(PRESSURES) & (F.lower(c["status"]) == "true"), F.struct(F.concat(F.lit("NODE_"), F.upper(c["type"])).alias("rule"), F.lit("warning").alias("severity")))
    node = F.concat(F.coalesce(F.transform(status["conditions"], condition), none), one("NODE_HIGH_CPU", "warning", high_cpu))
    service = one("SERVICE_NO_CONNECTIONS", "warning", F.col("connections") == 0)
    short = F.coalesce(status["readyReplicas"], F.lit(0)) < F.coalesce(F.col("_a.spec.replicas"), F.lit(0))
    deployment = one("DEPLOYMENT_REPLICAS_NOT_READY", "warning", short)
    kind = F.lower("kind")
    found = F.when(kind == "pod", pod).when(kind == "node", node).when(kind == "service", service).when(kind == "deployment", deployment)
    return api.select(*keep, F.explode(F.array_compact(found)).alias("f")).select(*keep, "f.rule", "f.severity")


def severity_counts(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, critical, warning, info) of findings."""
    n = lambda s: F.count_if(F.col("severity") == s)
    rest = F.count_if(~F.coalesce(F.col("severity"), F.lit("")).isin("critical", "warning"))
    return found.groupBy(*keys).agg(n("critical").alias("critical"), n("warning").alias("warning"), rest.alias("info"))


def level(value: Column, high: float, raised: float) -> Column:
    """critical above ``high``, warning above ``raised``, else normal; null stays null."""
    return F.when(value.isNull(), F.lit(None)).when(value > high, "critical").when(value > raised, "warning").otherwise("normal")


def knowledge_source(refs: Column, confidence: Column, llm: Column, found: Column, least: float = 0.5) -> Column:
    """Where an answer comes from: kb, llm, rules or null."""
    return F.when(refs & (confidence >= least), "kb").when(llm, "llm").when(found, "rules")
