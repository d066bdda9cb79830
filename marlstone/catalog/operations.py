"""Chunks, rules, metrics, logs, statistics and streams, each as one query over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import chunking as K
from marlstone.operators import observe as O
from marlstone.operators import relational, series
from marlstone.plans import rules
from marlstone.registry import benchmark, customer, docs, events, lineitem, orders, part, query, turns
from marlstone.streaming import events as S
from marlstone.streaming import watch

# -- chunks --


@query("""with recursive w(doc_id, text, n, a, b) as (
select doc_id, text, 0, 0, case when 1000 >= length(text) then length(text) when 1000 - strpos(reverse(substr(text, 1, 1000)), '.') + 1 > 1 and contains(substr(text, 1, 1000), '.') then 1000 - strpos(reverse(substr(text, 1, 1000)), '.') + 1 else 1000 end from documents where length(text) > 0
union all select doc_id, text, n + 1, s, case when s + 1000 >= length(text) then length(text) when contains(substr(text, s + 1, 1000), '.') and 1000 - strpos(reverse(substr(text, s + 1, 1000)), '.') + 1 > 1 then s + 1000 - strpos(reverse(substr(text, s + 1, 1000)), '.') + 1 else s + 1000 end
from (select *, greatest(b - 200, a + 1) as s from w where b < length(text)))
select doc_id, n as chunk_index, a as start_pos, b as end_pos, md5(substr(text, cast(a + 1 as bigint), cast(b - a as bigint))) as digest from w""")
def chunk_sentence(spark, d):
    """Windows of 1000 characters that end after a full stop, 200 in common."""
    return K.snapped_chunks(docs(spark, d)).select("doc_id", "chunk_index", "start_pos", "end_pos", F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(r"select doc_id, cast(i - 1 as integer) as paragraph, chunk from (select doc_id, trim(p) as chunk, i from (select doc_id, unnest(string_split_regex(text, '\n\s*\n')) as p, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) as i from documents)) where chunk <> ''")
def chunk_structure(spark, d):
    """Stretches between blank lines."""
    return K.paragraphs(docs(spark, d))


_N = "(o_orderkey % 6)"


@query(f"""select o_orderkey as doc_id, 0 as chunk_index, 5 as size, 1 as section, true as is_parent, 0 as start, 0 as "end" from orders
union all select doc_id, cast(i as integer), case when 2 * i <= n then 801 else 400 end, 1, false, 2 * i - 1, least(2 * i, n) from (select o_orderkey as doc_id, {_N} as n, unnest(generate_series(1, cast(ceil({_N} / 2.0) as bigint))) as i from orders)
union all select o_orderkey, cast(ceil({_N} / 2.0) as integer) + 1, case when {_N} % 2 = 1 then 9 else 5 end, 2, true, 20, 20 from orders where {_N} % 2 = 0
union all select o_orderkey, cast(ceil({_N} / 2.0) as integer) + 2, 1000, 2, false, 22, 22 from orders where {_N} % 2 = 0 union all select o_orderkey, cast(ceil({_N} / 2.0) as integer) + 3, 300, 2, false, 22, 22 from orders where {_N} % 2 = 0""")
def chunk_packing(spark, d):
    """A title and paragraphs of 400 characters, packed in twos; in every second document a second title, a table and a text longer than a chunk."""
    n = (F.col("o_orderkey") % 6).cast("int")
    one = lambda e, c, t: F.struct(F.lit(e).alias("element") if isinstance(e, int) else e.alias("element"), F.lit(c).alias("category"), t.alias("text"))
    paragraphs = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: one(i, "NarrativeText", F.expr("repeat('p', 400)")))).otherwise(F.array().cast("array<struct<element:int,category:string,text:string>>"))
    more = F.array(one(20, "Title", F.lit("again")), one(21, "Table", F.lit("a | b")), one(22, "NarrativeText", F.expr("repeat('q', 1300)")))
    parts = F.concat(F.array(one(0, "Title", F.lit("title"))), paragraphs, F.when(n % 2 == 0, more).otherwise(F.array().cast("array<struct<element:int,category:string,text:string>>")))
    rows = orders(spark, d).select(F.col("o_orderkey").alias("doc_id"), F.explode(parts).alias("e")).select("doc_id", "e.*")
    return K.structure_chunks(rows).select("doc_id", "chunk_index", F.length("content").alias("size"), "section", "is_parent", "start", "end")


@query("""with n as (select o_custkey, count(*) as n from orders group by 1), c as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as i, o_orderkey from orders), x as (select o_custkey, i as ch from c where o_orderkey % 9 = 0),
r as (select c.o_custkey, c.i, case when n <= 5 or c.o_custkey not in (select o_custkey from x) then 'full' when n <= 20 then 'contextual' else 'incremental' end as strategy from c join n using (o_custkey))
select o_custkey as doc_id, i as chunk_index, strategy from r where strategy = 'full' or exists (select 1 from x where x.o_custkey = r.o_custkey and abs(ch - i) <= case strategy when 'contextual' then 2 else 0 end)""")
def vector_plan(spark, d):
    """Which chunks are embedded again after changes, by the size of their document."""
    i = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    chunks = orders(spark, d).select(F.col("o_custkey").alias("doc_id"), i.alias("chunk_index"), "o_orderkey")
    return K.vector_plan(chunks, chunks.where("o_orderkey % 9 = 0"))


# -- rules --


def _resources(spark, d):
    e, k = F.col("event_id"), F.col("event_id") % 4
    kind = F.when(k == 0, "Pod").when(k == 1, "Node").when(k == 2, "Service").otherwise("Deployment")
    reason = F.when(e % 3 == 0, "CrashLoopBackOff").otherwise("ContainerCreating")
    pod = F.concat(F.lit('{"status":{"phase":"'), F.when(e % 5 == 0, "Pending").otherwise("Running"), F.lit('","containerStatuses":[{"name":"a","state":{"waiting":{"reason":"'), reason, F.lit('"}}},{"name":"b","state":{"running":{}}}]}}'))
    node = F.concat(F.lit('{"status":{"conditions":[{"type":"Ready","status":"'), F.when(e % 3 == 0, "False").otherwise("True"), F.lit('"},{"type":"DiskPressure","status":"'), F.when(e % 5 == 0, "True").otherwise("False"), F.lit('"}]}}'))
    deployment = F.concat(F.lit('{"spec":{"replicas":3},"status":{"readyReplicas":'), (e % 5).cast("string"), F.lit("}}"))
    api = F.when(k == 0, pod).when(k == 1, node).when(k == 3, deployment)
    logs = F.when(e % 7 == 0, "x OOMKilled y").when(e % 7 == 1, "CrashLoopBackOff")
    return events(spark, d).select("event_id", kind.alias("kind"), api.alias("api"), (F.col("value") / 100).alias("cpu"), (F.col("value") * 4e7).alias("memory"), F.when(e % 2 == 0, F.col("value") / 50).alias("restarts"), (e % 5).cast("double").alias("connections"), logs.alias("logs"))


_FINDINGS = " union all ".join(
    f"select event_id, '{rule}' as rule, '{severity}' as severity from events where event_id % 4 = {k} and {holds}"
    for k, rule, severity, holds in [
        (0, "POD_UNHEALTHY", "critical", "event_id % 5 = 0"), (0, "POD_CRASHLOOPBACKOFF", "critical", "event_id % 3 = 0"), (0, "HIGH_CPU_USAGE", "warning", "value / 100 > 0.8"),
        (0, "HIGH_MEMORY_USAGE", "warning", "value * 4e7 > 1610612736"), (0, "RESTART_LOOP", "critical", "event_id % 2 = 0 and value / 50 > 1"), (0, "LOG_OOM", "critical", "event_id % 7 = 0"),
        (0, "LOG_CRASH_LOOP", "warning", "event_id % 7 = 1"), (1, "NODE_NOT_READY", "critical", "event_id % 3 = 0"), (1, "NODE_DISKPRESSURE", "warning", "event_id % 5 = 0"),
        (1, "NODE_HIGH_CPU", "warning", "value / 100 > 0.8"), (2, "SERVICE_NO_CONNECTIONS", "warning", "event_id % 5 = 0"), (3, "DEPLOYMENT_REPLICAS_NOT_READY", "warning", "event_id % 5 < 3"),
    ]
)


@query(_FINDINGS)
def resource_rules(spark, d):
    """Rules for pods, nodes, services and deployments, by their status, metrics and logs."""
    return rules.resource_findings(_resources(spark, d), "event_id")


@query(f"select event_id % 10 as cluster, count(*) filter (severity = 'critical') as critical, count(*) filter (severity = 'warning') as warning, 0 as info from ({_FINDINGS}) group by 1")
def rule_summary(spark, d):
    found = rules.resource_findings(_resources(spark, d), "event_id")
    return rules.severity_counts(found.withColumn("cluster", F.col("event_id") % 10), "cluster")


@query("""select event_id, round(0.3 * greatest(0, 100 - floor(value)) + 0.3 * greatest(0, 100 - (event_id % 120)) + 0.2 * greatest(0, 100 - user_id) + 0.2 * 50, 2) as score,
case when round(0.3 * greatest(0, 100 - floor(value)) + 0.3 * greatest(0, 100 - (event_id % 120)) + 0.2 * greatest(0, 100 - user_id) + 0.2 * 50, 2) >= 80 then 'excellent' when round(0.3 * greatest(0, 100 - floor(value)) + 0.3 * greatest(0, 100 - (event_id % 120)) + 0.2 * greatest(0, 100 - user_id) + 0.2 * 50, 2) >= 60 then 'good'
when round(0.3 * greatest(0, 100 - floor(value)) + 0.3 * greatest(0, 100 - (event_id % 120)) + 0.2 * greatest(0, 100 - user_id) + 0.2 * 50, 2) >= 40 then 'warning' else 'critical' end as label,
case when event_id % 3 = 0 and value >= 50 then 'kb' when event_id % 3 = 1 then 'llm' when event_id % 2 = 0 then 'rules' end as source, case when value > 80 then 'critical' when value > 60 then 'warning' else 'normal' end as level from events""")
def health_scores(spark, d):
    e = F.col("event_id")
    score = rules.health_score(F.floor("value").cast("double"), (e % 120).cast("double"), F.col("user_id").cast("double"), F.lit(50.0))
    return events(spark, d).select("event_id", score.alias("score"), rules.health_label(score).alias("label"), rules.knowledge_source(e % 3 == 0, F.col("value") / 100, e % 3 == 1, e % 2 == 0).alias("source"), rules.level(F.col("value"), 80, 60).alias("level"))


# -- metrics and logs --


@query("select event_type, arg_max(value, ts) as value from events where ts <= timestamp '2024-01-03 12:00:00' and ts > timestamp '2024-01-03 11:55:00' group by 1")
def metric_instant(spark, d):
    return O.instant(events(spark, d), "2024-01-03 12:00:00", "event_type")


_GRID = "(select event_type, unnest(generate_series(timestamp '2024-01-02', timestamp '2024-01-04', interval 30 minute)) as ts from (select distinct event_type from events))"


@query(f"select g.event_type, g.ts, e.value from {_GRID} g asof join (select event_type, ts, max(value) as value from events group by 1, 2) e on g.event_type = e.event_type and e.ts <= g.ts where e.ts > g.ts - interval 20 minute")
def metric_range(spark, d):
    """The last sample of each series on a grid of half-hours, if it is at most twenty minutes old."""
    return O.query_range(events(spark, d), "2024-01-02 00:00:00", "2024-01-04 00:00:00", 1800, "event_type", lookback=1200)


@query("""with l as (select event_type, user_id % 3 as instance, date_trunc('hour', ts) as window_start, value, lag(value) over (partition by event_type, user_id % 3, date_trunc('hour', ts) order by ts, event_id) as b from events)
select event_type, window_start, round(sum(r), 6) as rate from (select event_type, instance, window_start, sum(case when b is null then 0 when value < b then value else value - b end) / 3600 as r from l group by 1, 2, 3) group by 1, 2""")
def promql_rate(spark, d):
    """Rates of counters by instance in windows of an hour, resets counted from 0, summed by kind."""
    rows = events(spark, d).withColumn("instance", F.col("user_id") % 3)
    each = O.rate(rows, "1 hour", 3600, "event_type", "instance", order="event_id")
    return each.groupBy("event_type", "window_start").agg(F.round(F.sum("rate"), 6).alias("rate"))


TEMPLATES = {"highest": "select {column} as name, max(value) as value from template_events where value < :bound group by {column}"}


@query("select event_type as name, max(value) as value from events where value < 90 group by 1")
def metric_template(spark, d):
    """A named template with an identifier and a bound value."""
    events(spark, d).createOrReplaceTempView("template_events")
    return O.run_template(spark, TEMPLATES, "highest", {"column": "event_type", "bound": 90.0})


@query("select event_id, event_id % 3 as same from events")
def cache_keys(spark, d):
    """Keys of equal parameters are equal whatever their order."""
    a = F.create_map(F.lit("x"), F.col("event_type"), F.lit("y"), F.lit("1"))
    b = F.create_map(F.lit("y"), F.lit("1"), F.lit("x"), F.col("event_type"))
    c = F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.col("event_type"))
    k = F.col("event_id") % 3
    own, other = O.cache_key(F.lit("/p"), a), O.cache_key(F.lit("/p"), F.when(k == 2, c).otherwise(b))
    elsewhere = O.cache_key(F.lit("/q"), a)
    same = F.when(k == 0, F.when((own == other) & (own != elsewhere), 0)).when(k == 1, F.when(own == other, 1)).otherwise(F.when(own != other, 2))
    return events(spark, d).select("event_id", same.alias("same"))


@query("select event_id as id, ts, replace('user ' || user_id || ' made ' || event_type, 'click', '<mark>click</mark>') as message from events where event_type = 'click' and ts between timestamp '2024-01-05' and timestamp '2024-01-20' order by ts desc, event_id limit 20 offset 20")
def log_search(spark, d):
    """The second page of messages with a word, the latest first, the word marked."""
    rows = events(spark, d).select(F.col("event_id").alias("id"), "ts", F.concat(F.lit("user "), "user_id", F.lit(" made "), "event_type").alias("message"))
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return O.search_logs(rows, "click", at("2024-01-05 00:00:00"), at("2024-01-20 00:00:00"), 2, 20)


@query("select 'all' as of, coalesce(case when event_type <> 'view' then event_type end, 'unknown') as level, count(*) as n from events group by 2 union all select 'page', coalesce(case when event_type <> 'view' then event_type end, 'unknown'), count(*) from (select * from events order by ts desc, event_id limit 50) group by 2")
def log_levels(spark, d):
    """Levels of all messages and of the last page."""
    rows = events(spark, d).withColumn("level", F.when(F.col("event_type") != "view", F.col("event_type")))
    last = O.listing(rows, {}, ts="ts", key="event_id", most=50)
    return O.level_counts(rows).select(F.lit("all").alias("of"), "level", "n").unionByName(O.level_counts(last).select(F.lit("page").alias("of"), "level", "n"))


@query("select 'user=' || user_id as labels, epoch_us(ts) as at, event_type as message from events")
def log_streams(spark, d):
    """Streams of log lines of a day, by their labels, taken apart into lines."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    pair = F.array(F.concat(micros.cast("string"), F.lit("000")), F.col("event_type"))
    streams = events(spark, d).groupBy(F.concat(F.lit("user="), "user_id").alias("labels"), F.to_date("ts")).agg(F.collect_list(pair).alias("values"))
    return O.flattened(streams).select("labels", F.unix_micros("at").alias("at"), "message")


@query("select event_id, ts from events where event_type = 'purchase' and user_id = 3 and ts >= timestamp '2024-01-03' order by ts desc, event_id limit 15")
def event_listing(spark, d):
    """Events by several optional conditions, the latest first."""
    rows = events(spark, d)
    return O.listing(rows, {"event_type": "purchase", "user_id": 3, "props": None}, "ts", F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"), None, "event_id", 15).select("event_id", "ts")


@query("select case when page_id % 2 = 0 then 't' || page_id else url end as title, url, case when page_id % 3 = 0 then 'c' else 's' end as snippet, case when page_id % 5 = 0 then 'src' else regexp_extract(url, '^https?://([^/]+)', 1) end as source from pages where page_id % 4 > 0 order by page_id limit 100")
def found_pages(spark, d):
    from marlstone.registry import pages

    p = F.col("page_id")
    rows = pages(spark, d).select(p.alias("rank"), F.when(p % 2 == 0, F.concat(F.lit("t"), p)).otherwise("").alias("title"), F.when(p % 4 > 0, F.col("url")).alias("url"), F.when(p % 3 == 0, "c").alias("content"), F.lit("s").alias("summary"), F.when(p % 5 == 0, "src").alias("source"))
    return O.normalized_results(rows, 100)


# -- streams and syncs --


@query("select date_trunc('minute', ts) as window_start, user_id, count(*) as n from events group by 1, 2 having count(*) > 1")
def rate_limit_1m(spark, d):
    """Users with more than one event within a minute."""
    return S.over_limit(events(spark, d), "ts", "user_id", "1 minute", 1)


@query("with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) + interval 3600 second > ts then 0 else 1 end as s from events), h as (select user_id, ts, sum(s) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as session_start, count(*) as n from h group by user_id, k having count(*) > 1")
def rate_limit_renewed(spark, d):
    """A limit whose hour begins anew with every event."""
    return S.renewed_limit(events(spark, d), "ts", "user_id", 3600, 1)


@query("select o_orderkey, case when o_orderkey % 5 <> 0 and o_orderkey % 7 <> 0 and o_orderkey % 400 < 200 then 'incremental' else 'full' end as mode from orders")
def sync_plan(spark, d):
    """Incremental syncs shortly after the last one, full ones else."""
    o = F.col("o_orderkey")
    at = F.lit("2024-01-01 12:00:00").cast("timestamp")
    states = orders(spark, d).select(o, F.when(o % 5 != 0, o.cast("string")).alias("resource_version"), (at - F.make_dt_interval(secs=(o % 400).cast("decimal(18,6)"))).alias("updated_at"), (o % 7 == 0).alias("forced"))
    return S.sync_plan(states, at, 600, F.col("forced")).select("o_orderkey", "mode")


@query("select o_orderkey as uid from orders where o_custkey % 4 < 3 and o_orderkey % 3 = 0 and o_orderkey % 10 <> 0")
def mark_absent(spark, d):
    """Live snapshots of listed scopes that the listing has not."""
    o = orders(spark, d).select((F.col("o_custkey") % 4).alias("scope"), F.col("o_orderkey").alias("uid"), (F.col("o_orderkey") % 10 == 0).alias("is_deleted"))
    return S.absent(o, o.where("scope < 3 and uid % 3 <> 0"), "scope").select("uid")


@query("select o_orderkey, case when o_orderkey % 3 = 0 then 'O>F' end as status, case when o_orderkey % 2 = 0 then '>x' end as label, cast(case when o_orderkey % 3 = 0 then 1 else 0 end + case when o_orderkey % 2 = 0 then 1 else 0 end as integer) as n from orders")
def snapshot_diff(spark, d):
    """What changed between two states of a snapshot, before and after."""
    o = F.col("o_orderkey")
    null = F.lit(None).cast("string")
    change = S.field_changes({"status": F.lit("O"), "label": null, "owner": null}, {"status": F.when(o % 3 == 0, "F").otherwise("O"), "label": F.when(o % 2 == 0, "x"), "owner": null})
    rows = orders(spark, d).select("o_orderkey", change.alias("c"))
    shown = lambda f: F.concat(F.coalesce(F.try_element_at("c", F.lit(f))["before"], F.lit("")), F.lit(">"), F.try_element_at("c", F.lit(f))["after"])
    return rows.select("o_orderkey", shown("status").alias("status"), shown("label").alias("label"), F.size("c").alias("n"))


@query("select user_id, event_type, count(*) as n from (select distinct user_id, event_type, value, ts from events) group by 1, 2")
def dedupe_watermark(spark, d):
    """A stream of all events twice, of which each one passes once."""
    schema = events(spark, d).schema
    stream = S.as_stream(spark, d, schema, "events.parquet")
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = S.first_seen(twice, "user_id", "event_type", "value", "ts", ts="ts", late="60 days")
    table = S.run_to_table(once.select("user_id", "event_type"), "dedupe")
    return table.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


_CDC = "select event_id, user_id, ts, case when event_type = 'error' then 'DELETED' when event_type = 'signup' then 'ADDED' else 'MODIFIED' end as kind, event_type as state from events"


@query(f"with w as ({_CDC}), l as (select *, lag(kind) over o as k, lag(state) over o as s from w window o as (partition by user_id order by ts, event_id)), c as (select user_id, case when kind = 'DELETED' then case when k is not null and k <> 'DELETED' then 'deleted' end when k is null or k = 'DELETED' then 'created' when state is distinct from s then 'updated' end as change from l) select user_id, change, count(*) as n from c where change is not null group by 1, 2")
def stream_cdc(spark, d):
    """Change capture on a stream with kept states; as in the batch query."""
    stream = S.as_stream(spark, d, events(spark, d).schema, "events.parquet")
    kind = F.when(F.col("event_type") == "error", "DELETED").when(F.col("event_type") == "signup", "ADDED").otherwise("MODIFIED")
    changes = S.stream_changes(stream.select("user_id", kind.alias("kind"), F.col("event_type").alias("state"), "ts"), "user_id", "kind", "state", "ts")
    table = S.run_to_table(changes, "cdc")
    return table.groupBy("user_id", "change").agg(F.count("*").alias("n"))


@query("select user_id, ts, value from events where event_type = 'view' and ts >= timestamp '2024-01-30' - interval 7 day and ts <= timestamp '2024-01-30'")
def metric_history(spark, d):
    """Samples of one kind within their seven days, and up to a time."""
    rows = S.retained(events(spark, d), "ts", "2024-01-30 00:00:00", 7)
    kept = rows.where((F.col("event_type") == "view") & (F.col("ts") <= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")))
    return kept.orderBy("ts").select("user_id", "ts", "value")


# -- statistics --


@query("""select c_custkey, count(distinct l_orderkey) as documents, count(l_orderkey) as files, coalesce(sum(l_quantity), 0) as bytes, round(coalesce(sum(l_quantity), 0) * 100 / 10240, 4) as quota, count(*) filter (l_returnflag = 'A') as of_a, count(*) filter (l_orderkey is not null and coalesce(nullif(l_returnflag, 'N'), 'unknown') = 'unknown') as of_unknown, max(l_shipdate) as last_at
from customer left join orders on o_custkey = c_custkey and o_orderdate >= timestamp '1996-06-01' left join lineitem on l_orderkey = o_orderkey group by 1""")
def personal_statistics(spark, d):
    """What each user has: documents, files, bytes and their share of the quota, by kinds, since a date."""
    o = orders(spark, d).where(F.col("o_orderdate") >= F.lit("1996-06-01 00:00:00").cast("timestamp_ntz"))
    rows = customer(spark, d).join(o, F.col("o_custkey") == F.col("c_custkey"), "left").join(lineitem(spark, d), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    size = F.coalesce(F.sum("l_quantity"), F.lit(0.0))
    kind = F.coalesce(F.nullif("l_returnflag", F.lit("N")), F.lit("unknown"))
    return rows.groupBy("c_custkey").agg(
        F.countDistinct("l_orderkey").alias("documents"), F.count("l_orderkey").alias("files"), size.alias("bytes"), F.round(size * 100 / 10240, 4).alias("quota"),
        F.count_if(F.col("l_returnflag") == "A").alias("of_a"), F.count_if(F.col("l_orderkey").isNotNull() & (kind == "unknown")).alias("of_unknown"), F.max("l_shipdate").alias("last_at"),
    )


@query("select c_nationkey, count(*) as total, count(*) filter (c_acctbal > 0) as answered, count(*) filter (c_acctbal <= 0) as unanswered, round(count(*) filter (c_acctbal > 0) * 100.0 / count(*), 2) as share from customer group by 1")
def answered_counts(spark, d):
    ok = F.count_if(F.col("c_acctbal") > 0)
    return customer(spark, d).groupBy("c_nationkey").agg(F.count("*").alias("total"), ok.alias("answered"), F.count_if(F.col("c_acctbal") <= 0).alias("unanswered"), F.round(ok * 100.0 / F.count("*"), 2).alias("share"))


@query("select o_custkey, count(*) as records, max(o_orderdate) as last_activity from orders where o_orderstatus <> 'P' group by 1 order by last_activity desc, o_custkey limit 20 offset 20")
def session_page(spark, d):
    """Sessions by their last activity, the second page."""
    rows = orders(spark, d).where("o_orderstatus <> 'P'").groupBy("o_custkey").agg(F.count("*").alias("records"), F.max("o_orderdate").alias("last_activity"))
    return relational.page(rows, [F.desc("last_activity"), "o_custkey"], 2, 20)


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn desc) as place from conversations qualify place between 3 and 4")
def version_page(spark, d):
    """The third and fourth latest versions of each chunk."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns(spark, d).select("conv_id", "turn", n.alias("place")).where("place between 3 and 4")


@query("select o_orderkey, o_orderdate from orders where o_orderkey % 4 < 3 and o_orderstatus = 'F' and o_orderdate + interval 30 minute <= timestamp '1998-06-01' order by o_orderdate, o_orderkey limit 25")
def retry_batch(spark, d):
    """Failed tasks to try again, the longest waiting first."""
    from marlstone.functions.classify import should_retry

    o = orders(spark, d).where("o_orderstatus = 'F'")
    again = should_retry(F.col("o_orderkey") % 4, F.col("o_orderdate"), F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), 3, 30)
    return o.where(again).orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


@query("select p_partkey, p_name, p_type from part where p_type in ('PROMO', 'ECONOMY') and p_size > 10 and exists (select 1 from lineitem where l_partkey = p_partkey and l_returnflag = 'R')")
def types_in_use(spark, d):
    """Types of some levels that a mapping has."""
    used = lineitem(spark, d).where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct()
    return part(spark, d).where("p_type in ('PROMO', 'ECONOMY') and p_size > 10").join(used, "p_partkey").select("p_partkey", "p_name", "p_type")


@query("select event_type, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.9) as high, count(distinct user_id) as users from events group by 1")
def percentiles(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.9)).alias("high"), F.countDistinct("user_id").alias("users"))


_TOK = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))"


@query(f"with t as (select item_id, {_TOK} as w from benchmark) select a.item_id as a, b.item_id as b, round(len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))), 4) as score from t a join t b on a.item_id < b.item_id where len(list_intersect(a.w, b.w)) * 100 >= 12 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))")
def jaccard_pairs(spark, d):
    """Pairs of a Jaccard similarity of .12 or more, however short; candidates share one of their rarest words."""
    rows = benchmark(spark, d).select("item_id", F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    return relational.jaccard_join(rows, "item_id", "w", 12).withColumn("score", F.round("score", 4))


@query(f"""with t as (select min(doc_id) as id, w, len(w) as n from (select doc_id, list_sort({_TOK}) as w from documents) where len(w) > 0 group by w)
select a.id as a, b.id as b, round(len(list_intersect(a.w, b.w)) / (a.n + b.n - len(list_intersect(a.w, b.w))), 4) as score from t a join t b on a.id < b.id and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90 where len(list_intersect(a.w, b.w)) * 100 >= 90 * (a.n + b.n - len(list_intersect(a.w, b.w)))""")
def near_dups(spark, d):
    """Pairs of documents whose sets of words have a similarity of .9 or more; of equal sets the least id stands for all."""
    rows = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return relational.jaccard_classes(rows, "doc_id", "w", 90)[1].withColumn("score", F.round("score", 4))


@query(f"""with d as (select doc_id, list_sort({_TOK}) as w from documents), t as (select min(doc_id) as class, w, len(w) as n, count(*) as members from d where len(w) > 0 group by w),
p as (select a.class as class, sum(b.members) as beyond from t a join t b on a.class <> b.class and a.n * 100 >= b.n * 90 and b.n * 100 >= a.n * 90 where len(list_intersect(a.w, b.w)) * 100 >= 90 * (a.n + b.n - len(list_intersect(a.w, b.w))) group by 1)
select doc_id, coalesce(t.class, doc_id) as class, coalesce(t.members, 1) as members, cast(coalesce(t.members - 1, 0) + coalesce(p.beyond, 0) as bigint) as links from d left join t on t.w = d.w left join p on p.class = t.class""")
def near_dup_classes(spark, d):
    """Each document's class of equal word sets, its size, and how many documents are alike; copies are not paired."""
    rows = docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("w"))
    return relational.jaccard_classes(rows, "doc_id", "w", 90)[0]


# -- series in pieces --


@query("select e.event_id, p.event_id as purchase_id from (select * from events where event_type = 'error') e asof left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'purchase' group by 1, 2) p on e.user_id = p.user_id and e.ts >= p.ts")
def asof_in_pieces(spark, d):
    """The last purchase before each error of a user; a user's history is as many tasks as it has days."""
    e = events(spark, d)
    right = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    left = e.where("event_type = 'error'").select("user_id", "ts", "event_id")
    return series.asof_join(left, right, "user_id", "ts", "event_id", "purchase_id").select("event_id", "purchase_id")


@query("with l as (select event_id, event_type, case when event_type = 'error' then 'DELETED' else 'MODIFIED' end as kind, lag(event_type) over o as s from events window o as (partition by user_id order by ts, event_id)) select event_id, case when kind = 'DELETED' then 'deleted' when s is null or s = 'error' then 'created' else 'updated' end as change from l where case when kind = 'DELETED' then s is not null and s <> 'error' when s is null or s = 'error' then true else event_type <> s end")
def changes_in_pieces(spark, d):
    rows = events(spark, d).withColumn("kind", F.when(F.col("event_type") == "error", "DELETED").otherwise("MODIFIED"))
    return series.changes(rows, "user_id", "ts", "event_id", "kind", "event_type").select("event_id", "change")


@query("with g as (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) + interval 30 minute > ts then 0 else 1 end as s from events), h as (select user_id, ts, sum(s) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as session_start, max(ts) as session_end, count(*) as n from h group by user_id, k")
def sessions_in_pieces(spark, d):
    return series.sessions(events(spark, d), "ts", 1800, "user_id", seconds=6 * 3600)


_ARRIVED = "(select 'r' || user_id as uid, epoch_us(ts) // 3600000000 as version, case when event_type = 'error' then 'DELETED' when event_type = 'signup' then 'BOOKMARK' else 'MODIFIED' end as kind, event_type as state, event_id as arrived from events)"


@query(f"""with a as (select *, max(version) over (partition by uid order by arrived rows between unbounded preceding and 1 preceding) as seen from {_ARRIVED}), k as (select *, lag(kind) over o as k, lag(state) over o as s from a where (seen is null or version > seen) and kind <> 'BOOKMARK' window o as (partition by uid order by arrived)),
c as (select uid, version, state, case when kind = 'DELETED' then case when k <> 'DELETED' then 'deleted' end when k is null or k = 'DELETED' then 'created' when state <> s then 'updated' end as change from k) select * from c where change is not null""")
def watch_versions(spark, d):
    """Changes of resources whose versions come late and again, in batch."""
    return watch.versions_applied(_arrived(spark, d))


def _arrived(spark, d):
    kind = F.when(F.col("event_type") == "error", "DELETED").when(F.col("event_type") == "signup", "BOOKMARK").otherwise("MODIFIED")
    hours = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return events(spark, d).select(F.concat(F.lit("r"), "user_id").alias("uid"), hours.alias("version"), kind.alias("kind"), F.col("event_type").alias("state"), F.col("event_id").alias("arrived"), "ts")
