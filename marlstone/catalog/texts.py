"""Logs, differences, entities and answers, each as one query over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import diffs, logs
from marlstone.operators import entities as E
from marlstone.registry import benchmark, docs, events, orders, part, query, turns

_LIST = "files lines columns functions classes modules errors".split()


def message(spark, d):
    """Messages of the dialects, made of the events."""
    k = F.col("event_id") % 6
    user, eid, kind = F.col("user_id").cast("string"), F.col("event_id").cast("string"), F.col("event_type")
    m = (
        F.when(k == 0, F.concat(F.lit('2026-01-19 10:30:45 - app - ERROR - Traceback (most recent call last): File "app/Svc'), user, F.lit('.py", line '), eid, F.lit(", in run_"), kind, F.lit(" KeyError: x")))
        .when(k == 1, F.concat(F.lit("2026-01-19 10:30:45.123 WARN [main] org.example.Main - boom at org.example.Service"), user, F.lit("."), kind, F.lit("(Service"), user, F.lit(".java:"), eid, F.lit(")")))
        .when(k == 2, F.concat(F.lit("2026-01-19T10:30:45.123Z error Api: x at Api."), kind, F.lit(" (/srv/a"), user, F.lit(".js:"), eid, F.lit(":15)")))
        .when(k == 3, F.concat(F.lit("failed in src/mod"), user, F.lit(".go line 77 calling load_"), kind, F.lit("(x) with TimeoutError")))
        .when(k == 4, "  ")
    )
    return events(spark, d).select("event_id", m.alias("message"))


_U, _E = "cast(user_id as varchar)", "event_type"
_PARTS = {
    "files": f"case k when 0 then 'app/Svc' || {_U} || '.py' when 1 then 'Service' || {_U} || '.java' when 2 then '/srv/a' || {_U} || '.js' when 3 then 'src/mod' || {_U} || '.go' else '' end",
    "lines": "case when k < 3 then cast(event_id as varchar) when k = 3 then '77' else '' end",
    "columns": "case when k = 2 then '15' else '' end",
    "functions": f"case k when 0 then 'run_' || {_E} when 1 then {_E} when 2 then {_E} when 3 then 'load_' || {_E} else '' end",
    "classes": f"case k when 0 then 'Svc' || {_U} when 1 then 'Service' || {_U} when 2 then 'Api' when 3 then 'TimeoutError' else '' end",
    "modules": f"case k when 0 then 'app.Svc' || {_U} when 1 then 'org.example.Service' || {_U} else '' end",
    "errors": "case k when 0 then 'KeyError' when 3 then 'TimeoutError' else '' end",
}


@query(f"select event_id, case k when 0 then 'python' when 1 then 'java' when 2 then 'node' when 3 then 'generic' end as dialect, case k when 0 then 'ERROR' when 1 then 'WARN' when 2 then 'ERROR' end as level, {', '.join(f'{v} as {c}' for c, v in _PARTS.items())} from (select *, event_id % 6 as k from events)")
def log_parse(spark, d):
    """Dialects of logs; the expected parts are those the messages were made of."""
    rows = message(spark, d).select("event_id", logs.parse_log(F.col("message")).alias("p"))
    return rows.select("event_id", "p.dialect", "p.level", *[F.array_join(F.col(f"p.{c}").cast("array<string>"), ",").alias(c) for c in _LIST])


@query("select case when event_id % 6 in (0, 2, 3) or (event_id % 6 = 1 and event_type = 'error') then 'error' when event_id % 6 = 1 then 'warning' else 'none' end as severity, count(*) as n, min(event_id) as first_id from events group by 1")
def log_summary_by_words(spark, d):
    rows = message(spark, d).select("event_id", F.coalesce(logs.severity(F.col("message")), F.lit("none")).alias("severity"))
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


_N = "(turn % 7 + 1)"


@query(f"select conv_id, turn, 1 as added, case when {_N} >= 2 then 1 else 0 end as removed, 1 as hunks, round((1 + case when {_N} >= 2 then 1 else 0 end) / {_N}, 6) as change_ratio, case when (1 + case when {_N} >= 2 then 1 else 0 end) / {_N} >= 0.5 then 'high' else 'low' end as risk from conversations")
def diff_lines(spark, d):
    """Numbered lines of which the second goes and to which one is added."""
    n = (F.col("turn") % 7 + 1).cast("int")
    lines = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit("\n")))
    new = F.concat(F.array_join(F.filter(lines, lambda x: x != "line 2\n"), ""), F.lit("new\n"))
    rows = turns(spark, d).select("conv_id", "turn", diffs.line_counts(F.array_join(lines, ""), new).alias("c"))
    return rows.select("conv_id", "turn", "c.added", "c.removed", "c.hunks", F.round("c.change_ratio", 6).alias("change_ratio"), diffs.risk(F.col("c")).alias("risk"))


@query(f"""with n as (select conv_id, turn, {_N} as n from conversations), l as (select conv_id, turn, n, unnest(generate_series(1, n)) as i from n)
select conv_id, turn, case when i = 2 then 'delete' else 'equal' end as type, cast(i as integer) as old_line, cast(case when i = 2 then null when i > 2 then i - 1 else i end as integer) as new_line, 'line ' || i as content from l
union all select conv_id, turn, 'insert', null, cast(case when n >= 2 then n else n + 1 end as integer), 'new' from n""")
def diff_rows(spark, d):
    n = (F.col("turn") % 7 + 1).cast("int")
    lines = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("line "), i.cast("string"), F.lit("\n")))
    rows = turns(spark, d).select("conv_id", "turn", F.array_join(lines, "").alias("old"), F.concat(F.array_join(F.filter(lines, lambda x: x != "line 2\n"), ""), F.lit("new\n")).alias("new"))
    return diffs.line_diff(rows, "old", "new", "conv_id", "turn").drop("place")


@query("""select p_partkey, round(2.0 * least(a, b) / (a + b), 6) as ratio, case when s < 60 then cast(floor(s) as bigint) || 's' when s < 3600 then cast(floor(s / 60) as bigint) || 'm' else cast(floor(s / 3600) as bigint) || 'h' end as estimate
from (select *, 10 + a * 1000 / 1000.0 * 9 + (1 - 2.0 * least(a, b) / (a + b)) * 30 as s from (select p_partkey, p_size as a, p_partkey % 40 + 1 as b from part))""")
def similarity_ratio(spark, d):
    """Likeness of two runs of one letter, and the time that a change of such likeness takes."""
    rows = part(spark, d).select("p_partkey", "p_size", F.expr("repeat('x', p_size)").alias("a"), F.expr("repeat('x', cast(p_partkey % 40 + 1 as int))").alias("b"))
    rows = rows.withColumn("ratio", diffs.similarity(F.col("a"), F.col("b")))
    return rows.select("p_partkey", F.round("ratio", 6).alias("ratio"), diffs.processing_time(F.col("p_size") * 9000, F.col("ratio")).alias("estimate"))


_NUMBERS = r"list_distinct(list_concat(regexp_extract_all(text, '[0-9]+[.]?[0-9]*'), regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})*')))"


# letters beyond ASCII are no ends of words, which RE2 takes them for
_PLAIN = r"regexp_replace(text, '[^\x00-\x7F\P{L}]', '_', 'g')"


@query(rf"""select doc_id, 'persons' as kind, unnest(list_distinct(list_concat(regexp_extract_all({_PLAIN}, '\b[A-Z][a-z]+ [A-Z][a-z]+\b'), regexp_extract_all({_PLAIN}, '\b(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]+\b')))) as entity from documents where lang = 'en'
union all select doc_id, 'numbers', unnest({_NUMBERS}) from documents where lang = 'en' union all select doc_id, 'dates', unnest(list_distinct(regexp_extract_all(text, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}'))) from documents where lang = 'en'""")
def pattern_entities(spark, d):
    """Persons, numbers and dates of English documents."""
    rows = docs(spark, d).where("lang = 'en'")
    return E.entities(rows, "doc_id", "text", "en").where("kind in ('persons', 'numbers', 'dates')")


@query(r"select item_id, 'PERSON' as type, unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) as value from benchmark union all select item_id, 'PLACE', unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)*')) from benchmark")
def capitalised_entities(spark, d):
    return benchmark(spark, d).select("item_id", F.explode(E.capitalised(F.col("text"))).alias("e")).select("item_id", "e.type", "e.value")


@query("""select min(p_partkey) as id, arg_min(p_name || p_partkey // 8, p_partkey) as name, 'kind0' as type, cast(count(*) as integer) as n_labels, max(p_size) as longest, round(max(p_size / 100.0), 4) as confidence from part group by p_partkey // 8""".replace("'kind0' as type", "'kind' || min(p_partkey) % 3 as type"))
def alias_merge(spark, d):
    """Eight parts after each other are one entity: each has the one before it as an alias, the first of them none."""
    p = part(spark, d)
    name = F.concat("p_name", F.floor(F.col("p_partkey") / 8).cast("string"))
    rows = p.select(F.col("p_partkey").alias("id"), F.concat(name, F.when(F.col("p_partkey") % 8 == 0, "").otherwise(F.concat(F.lit("."), F.col("p_partkey").cast("string")))).alias("name"), F.concat(F.lit("kind"), F.col("p_partkey") % 3).alias("type"), (F.col("p_partkey") - 1).alias("before"), F.expr("repeat('d', p_size)").alias("description"), (F.col("p_size") / 100.0).alias("confidence"))
    names = rows.select(F.col("id").alias("before"), F.upper("name").alias("alias"))
    rows = rows.join(names, "before", "left").withColumn("aliases", F.when(F.col("id") % 8 != 0, F.array("alias")))
    out = E.merge_aliases(rows)
    low = F.size(F.array_distinct(F.transform(F.concat("aliases", F.array("name")), F.lower)))
    return out.select("id", "name", "type", low.alias("n_labels"), F.length("description").alias("longest"), F.round("confidence", 4).alias("confidence"))


_MENTIONS = "(select distinct o_custkey % 60 as name, o_orderkey // 16 as chunk from orders)"


@query(f"""with m as {_MENTIONS}, o as (select name from m group by name having count(*) > 1), k as (select distinct least(o_custkey % 60, o_orderkey % 60) as a, greatest(o_custkey % 60, o_orderkey % 60) as b from orders where o_orderstatus = 'F')
select distinct x.name as source, y.name as target, 'related_to' as type from m x join m y on x.chunk = y.chunk and x.name < y.name where x.name in (from o) and y.name in (from o) and not exists (select 1 from k where k.a = x.name and k.b = y.name)""")
def cross_chunk(spark, d):
    """Customers that share a run of orders, less those that finished orders relate already."""
    o = orders(spark, d)
    mentions = o.select((F.col("o_custkey") % 60).alias("name"), F.floor(F.col("o_orderkey") / 16).alias("chunk"))
    known = o.where("o_orderstatus = 'F'").select((F.col("o_custkey") % 60).alias("source"), (F.col("o_orderkey") % 60).alias("target"))
    return E.cross_chunk_relations(mentions, known).drop("confidence")


@query("select o_custkey as source, o_orderkey % 7 as target, o_orderstatus as type, min(o_orderkey) as o_orderkey from orders group by 1, 2, 3")
def relations_once(spark, d):
    rows = orders(spark, d).select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 7).alias("target"), F.col("o_orderstatus").alias("type"), "o_orderkey")
    return E.first_relations(rows, "o_orderkey")


@query("""select event_id, case when event_id % 5 < 4 then event_type end as keyword, case when event_id % 5 < 3 then 'about ' || user_id when event_id % 5 = 3 then '' end as summary, case when event_id % 5 < 2 then '{"keywords":["' || event_type || '"],"summary":"about ' || user_id || '"}' end as object from events""")
def model_answers(spark, d):
    """Answers as JSON, JSON within text, labelled lines or neither."""
    k = F.col("event_id") % 5
    about = F.concat(F.lit("about "), F.col("user_id").cast("string"))
    js = F.to_json(F.struct(F.array("event_type").alias("keywords"), about.alias("summary")))
    text = F.when(k == 0, js).when(k == 1, F.concat(F.lit("Sure: "), js, F.lit(" done }")))
    text = text.when(k == 2, F.concat(F.lit("关键词："), "event_type", F.lit("\n摘要: "), about)).when(k == 3, F.concat(F.lit("关键词: "), "event_type")).otherwise("nothing")
    rows = events(spark, d).select("event_id", text.alias("t")).select("event_id", E.parse_answer(F.col("t")).alias("a"), E.balanced_json(F.col("t")).alias("object"))
    return rows.select("event_id", F.get("a.keywords", 0).alias("keyword"), "a.summary", "object")
