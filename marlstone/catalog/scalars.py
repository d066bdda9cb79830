"""Scalar families, each as one query over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import classify as C
from marlstone.functions import convert as V
from marlstone.functions import text as T
from marlstone.registry import TOKENS, benchmark, customer, docs, events, orders, pages, part, query, turns, vectors


def quoted(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_RAW = "case event_id % 6 when 0 then cast(event_id as varchar) when 1 then ' 12 ' when 2 then '12.5' when 3 then 'Yes' when 4 then '' end"


@query(f"""select event_id, case when regexp_full_match(trim(t), '[+-]?[0-9]+') then cast(trim(t) as bigint) else -1 end as as_int,
case when regexp_full_match(trim(t), '[0-9]+([.][0-9]*)?') then cast(trim(t) as double) else -1 end as as_float, coalesce(lower(t) in ('true', '1', 'yes', 'on'), false) as flag,
cast(case when length(t) > 0 then len(string_split(t, '.')) else 0 end as integer) as n_parts, to_base64(encode(event_type)) as b64, printf('%.2f', event_id * 0.25) as fixed
from (select event_id, event_type, {_RAW} as t from events)""")
def safe_conversions(spark, d):
    k = F.col("event_id") % 6
    t = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, " 12 ").when(k == 2, "12.5").when(k == 3, "Yes").when(k == 4, "")
    rows = events(spark, d).select("event_id", "event_type", t.alias("t"))
    return rows.select(
        "event_id", V.to_int(F.col("t"), -1).alias("as_int"), V.to_float(F.col("t"), -1.0).alias("as_float"), V.to_bool(F.col("t")).alias("flag"),
        F.size(V.to_list(F.col("t"), ".")).alias("n_parts"), V.to_base64(F.col("event_type")).alias("b64"), V.fixed(F.col("event_id") * 0.25).alias("fixed"),
    )


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, event_type as unpacked, event_type || ',' || user_id as joined from events""")
def json_and_lists(spark, d):
    """JSON and base64 there and back, lists joined and parted."""
    rows = events(spark, d).withColumn("k", V.from_json(F.col("props"), "k long")["k"])
    back = V.from_json(V.to_json(F.struct("event_type")), "event_type string")["event_type"]
    both = V.from_list(V.to_list(F.concat_ws(";", "event_type", "user_id"), ";"), ",")
    return rows.select("event_id", "k", V.from_base64(V.to_base64(back)).alias("unpacked"), both.alias("joined"))


@query("""select o_orderkey, strftime(o_orderdate, '%Y/%m/%d') as label, o_orderdate + interval 3 day + interval 5 hour + interval 7 minute as later,
(epoch(o_orderdate) - epoch(timestamp '1998-01-01')) as seconds, o_orderdate + interval 48 hour < timestamp '1998-06-01 12:00:00' as expired,
case when o_orderkey % 2 = 0 then o_orderdate end as parsed from orders""")
def date_scalars(spark, d):
    """Times written, parsed, shifted, compared; what can't be parsed is null."""
    ts = F.col("o_orderdate")
    label = V.format_time(ts, "yyyy/MM/dd")
    return orders(spark, d).select(
        "o_orderkey", label.alias("label"), V.shifted(ts, 3, 5, 7).alias("later"), V.seconds_between(F.lit("1998-01-01").cast("timestamp"), ts).alias("seconds"),
        V.expired(ts, 48, F.lit("1998-06-01 12:00:00").cast("timestamp")).alias("expired"),
        V.from_epoch(F.unix_seconds(V.parse_time(F.when(F.col("o_orderkey") % 2 == 0, label).otherwise("no date"), "yyyy/MM/dd"))).cast("timestamp_ntz").alias("parsed"),
    )


@query("""select doc_id, sha1(text) as sha1, md5(text) as md5, doc_id % 3 = 0 as same, 'code_file_' || substr(md5('7:src/' || source || '.py'), 1, 16) as file_vid,
'code_symbol_' || substr(md5('7:' || lang || '.run:src/' || source || '.py:' || n_chars), 1, 16) as symbol_vid, case when doc_id % 2 = 0 then doc_id end as entity from documents""")
def vids_and_digests(spark, d):
    path = F.concat(F.lit("src/"), "source", F.lit(".py"))
    claimed = F.when(F.col("doc_id") % 3 == 0, F.upper(V.digest(F.col("text")))).otherwise("0")
    vid = F.when(F.col("doc_id") % 2 == 0, V.entity_vid(F.col("doc_id"))).otherwise(F.concat(F.lit("node_"), "doc_id"))
    return docs(spark, d).select(
        "doc_id", V.digest(F.col("text"), "sha1").alias("sha1"), V.digest(F.col("text"), "md5").alias("md5"), V.has_digest(F.col("text"), claimed).alias("same"),
        V.file_vid(F.lit(7), path).alias("file_vid"), V.symbol_vid(F.lit(7), F.concat("lang", F.lit(".run")), path, F.col("n_chars")).alias("symbol_vid"),
        V.vid_entity(vid).alias("entity"),
    )


_SPACES = r"'\s+', ' ', 'g'"


@query(rf"""select doc_id, md5(trim(regexp_replace(regexp_replace(text, {_SPACES}), '[^\p{{L}}\p{{N}}_ .,!?;:()\[\]{{}}"''-]', '', 'g'))) as clean,
md5(lower(trim(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), {_SPACES})))) as noise, md5(trim(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}_\s]', '', 'g'), {_SPACES}))) as bare,
lower(rtrim(substr(trim(regexp_replace(text, {_SPACES})), 1, 100))) as query_text, regexp_replace(trim(split_part(text, ' ', 1)), '[^\p{{L}}\p{{N}}_\s.-]', '', 'g') as entity,
replace(substr(text, 1, 40), 'the', '***') as masked from documents""")
def text_cleaning(spark, d):
    """Texts cleaned for display, for header keys, for queries and names; listed words masked."""
    t = F.col("text")
    md5 = lambda x: F.md5(x.cast("binary"))
    return docs(spark, d).select(
        "doc_id", md5(T.clean_text(t)).alias("clean"), md5(T.noise_key(t)).alias("noise"), md5(T.bare_text(t)).alias("bare"), T.search_text(t).alias("query_text"),
        T.entity_name(F.split_part(t, F.lit(" "), F.lit(1))).alias("entity"), T.masked(F.substring(t, 1, 40), ["the"]).alias("masked"),
    )




@query("select doc_id, doc_id % 7 in (0, 1, 2) as decorative, doc_id % 7 in (3, 4, 5) as contents from documents")
def decorative_and_contents(spark, d):
    k = F.col("doc_id") % 7
    t = F.when(k == 0, "  ").when(k == 1, "-=-=-=").when(k == 2, "ab").when(k == 3, "Table of Contents").when(k == 4, "Intro .... 3\nEnd ..... 12").when(k == 5, "see ... 4").otherwise(F.concat("source", F.lit(" and more")))
    return docs(spark, d).select("doc_id", T.is_decorative(t).alias("decorative"), T.is_contents(t).alias("contents"))


_RANKED = """(with t as ({t}), u as (select doc_id, unnest(w) as w, generate_subscripts(w, 1) as i from t), c as (select doc_id, w, count(*) as n, min(i) as f from u where {keep} group by 1, 2),
r as (select *, row_number() over (partition by doc_id order by n desc, f) as k from c where n >= {least})
select d.doc_id, coalesce(string_agg(w, ',' order by k) filter (k <= 10), '') as terms from documents d left join r on r.doc_id = d.doc_id group by 1)"""
_WORDS = f"select doc_id, {TOKENS} as w from documents"


@query(_RANKED.format(t=_WORDS, keep=f"length(w) > 2 and not list_contains({quoted(T.STOP_WORDS)}, w)", least=1))
def document_keywords(spark, d):
    """Most frequent words of each document that are no stop words, ties by first place."""
    rows = docs(spark, d)
    return T.top_terms(rows, "doc_id", T.keyword_tokens(F.col("text"))).select("doc_id", F.array_join("terms", ",").alias("terms"))


@query(_RANKED.format(t=_WORDS, keep=f"regexp_full_match(w, '[a-z]{{2,10}}') and not list_contains({quoted(T.CONTENT_STOP_WORDS)}, w)", least=2))
def content_keywords(spark, d):
    """The same of Latin words that come at least twice."""
    rows = docs(spark, d)
    return T.top_terms(rows, "doc_id", T.content_tokens(F.col("text"), "en"), least_count=2).select("doc_id", F.array_join("terms", ",").alias("terms"))


_FIRST = "list_filter(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda w: length(w) > {n} and not list_contains({stop}, w))"


@query(f"select item_id, array_to_string(({_FIRST.format(n=1, stop=quoted(T.HISTORY_STOP_WORDS))})[1:10], ',') as history, array_to_string(({_FIRST.format(n=2, stop=quoted(T.CODE_STOP_WORDS))})[1:5], ',') as code from benchmark")
def first_keywords(spark, d):
    t = F.col("text")
    return benchmark(spark, d).select("item_id", F.array_join(T.first_words(t, T.HISTORY_STOP_WORDS, 1, 10), ",").alias("history"), F.array_join(T.first_words(t, T.CODE_STOP_WORDS, 2, 5), ",").alias("code"))


_CASES = ["What is this", "how to run", "please compare both", "tell me", "call path of the call chain architecture", "why and how does it optimize", "什么 是 数据", "如何 优化 模块"]


def _of(values: list, cast: str = "") -> str:
    return "case o_orderkey % 8 " + " ".join(f"when {i} then {v!r}{cast}" for i, v in enumerate(values)) + " end"


@query(f"""select o_orderkey, {_of(["factual_qa", "operation_guide", "comparison_analysis", "factual_qa", "factual_qa", "operation_guide", "factual_qa", "operation_guide"])} as intent,
{_of([0.8, 0.8, 0.7, 0.5, 0.5, 0.8, 0.8, 0.8])} as confidence, {_of(["factual_qa", "operation_guide", "comparison_analysis", "image_search", "image_search", "operation_guide", "factual_qa", "operation_guide"])} as fused,
{_of(["general", "general", "general", "general", "general", "understanding", "general", "general"])} as kind, {_of(["en", "en", "en", "en", "en", "en", "zh", "zh"])} as script from orders""")
def question_kinds(spark, d):
    """Intents, their fusion with an image's, categories and scripts of questions; the expected values are written out."""
    k = F.col("o_orderkey") % 8
    q = F.element_at(F.array(*map(F.lit, _CASES)), (k + 1).cast("int"))
    kind, sure = C.intent(q)
    fused, _ = C.fused_intent((kind, sure), (F.lit("image_search"), F.lit(0.6)))
    return orders(spark, d).select("o_orderkey", kind.alias("intent"), sure.alias("confidence"), fused.alias("fused"), C.question_kind(q).alias("kind"), T.dominant_script(q).alias("script"))


@query("""select c_custkey, case c_custkey % 4 when 0 then 'system' when 1 then 'auto' else 'user' end as kind, case c_custkey % 4 when 0 then '#f56c6c' else '#909399' end as colour,
case when c_custkey % 3 = 0 then coalesce(case when c_custkey % 2 = 0 then 'editor' end, 'viewer') when c_custkey % 3 = 1 then 'owner' end as role,
(c_custkey % 3 = 0 and c_custkey % 2 = 0) or c_custkey % 3 = 1 as may_edit, c_custkey % 3 = 1 as may_manage from customer""")
def tags_and_roles(spark, d):
    k = F.col("c_custkey")
    tag = F.when(k % 4 == 0, "API").when(k % 4 == 1, "智能标签").otherwise(F.col("c_mktsegment"))
    role = C.role(F.when(k % 2 == 0, "editor"), k % 3 == 0, k % 3 == 1)
    return customer(spark, d).select("c_custkey", C.tag_kind(tag).alias("kind"), C.tag_colour(tag).alias("colour"), role.alias("role"), C.may(role, "doc:edit").alias("may_edit"), C.may(role, "kb:manage_members").alias("may_manage"))


_PATHS = ["README.md", "src/app.py", "web/dist/x.min.js", "pom.xml", "conf/settings.yaml", "lib/core/a.h", "docs/guide.rst", "tests/run.go", "Dockerfile", "node_modules/x/y.ts", "a/b.unknown", "data/rows.xlsx"]


def _p(values: list) -> str:
    return "case p_partkey % 12 " + " ".join(f"when {i} then {'null' if v is None else repr(v)}" for i, v in enumerate(values)) + " end"


@query(f"""select p_partkey, {_p(["markdown", "python", "javascript", "xml", "yaml", "c", None, "go", "dockerfile", "typescript", None, None])} as language,
{_p(["readme", "entry", None, "build", "config", "core", "doc", "test", "build", None, None, None])} as kind, {_p([10, 9, 1, 8, 7, 6, 6, 3, 8, 1, 1, 1])} as score,
{_p([False, False, True] + [False] * 9)} as minified, {_p([False, False, True] + [False] * 6 + [True, False, False])} as ignored,
{_p(["text/markdown", None, None, "application/xml"] + [None] * 7 + ["application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"])} as media, {_p([None] * 3 + ["xml"] + [None] * 7 + ["csv"])} as structured from part""")
def file_kinds(spark, d):
    """Languages, importance, media types and marks of paths; the expected values are written out."""
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("p_partkey") % 12 + 1).cast("int"))
    kind, score = C.file_importance(path)
    return part(spark, d).select("p_partkey", C.code_language(path).alias("language"), kind.alias("kind"), score.alias("score"), C.is_minified(path).alias("minified"), C.is_ignored(path).alias("ignored"), C.media_type(path).alias("media"), C.structured_kind(path, F.lit("")).alias("structured"))


@query("""select event_id, case event_id % 6 when 0 then 'json' when 2 then 'xml' end as kind from events""")
def structured_kinds(spark, d):
    """Kinds of texts by their first kilobyte."""
    k = F.col("event_id") % 6
    head = F.when(k == 0, F.col("props")).when(k == 1, "{broken").when(k == 2, F.concat(F.lit("<a><b>"), "event_type", F.lit("</b></a>"))).when(k == 3, "<a><b></a>").when(k == 4, "plain")
    return events(spark, d).select("event_id", C.structured_kind(F.lit("x.txt"), head).alias("kind"))


@query(r"""select doc_id, array_to_string(list_filter([case when n < 50 then 'too_short' end, case when n > 10000 then 'too_long' end, case when n > 0 and trim(regexp_replace(text, '\s+', ' ', 'g')) = '' then 'blank' end,
case when len(regexp_extract_all(text, '\n')) > n * 0.02 then 'newlines' end, case when len(regexp_extract_all(text, '[^\p{L}\p{N}_\s.,!?;:()\[\]{}"''-]')) > n * 0.1 then 'special_characters' end], lambda x: x is not null), ',') as issues,
case when text like '%token%' or text like '%password%' then 1 else 0 end as named, array_to_string(list_filter(['eval(', 'drop table', 'system('], lambda w: contains(lower(text), w)), ',') as suspicious from (select *, length(text) as n from documents)""")
def content_validation(spark, d):
    t = F.col("text")
    named = C.has_any(t, ["token", "password"]).cast("int")
    some = F.filter(C.suspicious_words(t), lambda w: w.isin("eval(", "drop table", "system("))
    return docs(spark, d).select("doc_id", F.array_join(C.content_issues(t, 50, 10_000, 0.02), ",").alias("issues"), named.alias("named"), F.array_join(some, ",").alias("suspicious"))


@query("""select p.page_id, p.page_id % 2 = 0 as email, p.page_id % 2 = 1 as phone, p.page_id % 2 = 0 as url, length(p.url) between 5 and 30 as fits, p.page_id between 10 and 99 as in_range,
case when p.page_id % 2 = 1 then 'note' else '' end as missing from pages p""")
def validators(spark, d):
    even = F.col("page_id") % 2 == 0
    rows = pages(spark, d).select("page_id", "url", F.when(even, F.concat(F.lit("a.b"), "page_id", F.lit("@mail.example.org"))).otherwise("a@b").alias("mail"), F.when(even, "2381234567").otherwise("13812345678").alias("phone"), F.when(even, F.lit("https://example.org:80/a/b.html?x=1&y=2#top")).otherwise("ftp://x").alias("u"), F.when(even, "x").alias("note"))
    return rows.select("page_id", C.is_email(F.col("mail")).alias("email"), C.is_phone(F.col("phone")).alias("phone"), C.is_url(F.col("u")).alias("url"), C.has_length(F.col("url"), 5, 30).alias("fits"), C.in_range(F.col("page_id"), 10, 99).alias("in_range"), F.array_join(C.missing_fields(["url", "note"]), ",").alias("missing"))


@query("select vec_id, vec_id % 5 > 1 as valid from embeddings")
def vector_validation(spark, d):
    zero = F.transform("embedding", lambda x: x * 0)
    v = F.when(F.col("vec_id") % 5 == 0, zero).when(F.col("vec_id") % 5 == 1, F.array().cast("array<float>")).otherwise(F.col("embedding"))
    return vectors(spark, d).select("vec_id", C.is_vector(v).alias("valid"))


@query("""select o_orderkey, o_orderkey % 4 < 3 and (o_orderkey % 5 = 0 or timestamp '1998-06-01 00:10:00' >= o_orderdate + interval 30 minute) as again from orders""")
def retry_rule(spark, d):
    last = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp"))
    return orders(spark, d).select("o_orderkey", C.should_retry(F.col("o_orderkey") % 4, last, F.lit("1998-06-01 00:10:00").cast("timestamp"), 3, 30).alias("again"))


@query("""select l_orderkey, l_linenumber, round(case when l_linenumber % 3 = 0 then 0.2 when l_linenumber % 3 = 1 then 50 / 400.0 else 0 end, 6) as x, round(case when l_linenumber % 3 = 0 then 0.3 when l_linenumber % 3 = 1 then 120 / 800.0 else 0 end, 6) as h,
round(case when l_linenumber % 3 = 0 then (0.2 * 0.2) / (0.4 * 0.3 + 0.3 * 0.3 - 0.2 * 0.2) else 0 end, 6) as iou from (select distinct l_orderkey, l_linenumber from lineitem)""")
def boxes(spark, d):
    """Boxes scaled to shares of their page, and the overlap of two as a share of their union."""
    from marlstone.registry import lineitem

    k = F.col("l_linenumber") % 3
    raw = [F.when(k == 0, a).otherwise(b) for a, b in ((0.2, 50.0), (0.1, 80.0), (0.4, 100.0), (0.3, 120.0))]
    box = V.scaled_box(raw, F.when(k == 1, 400.0).otherwise(0.0), F.when(k == 1, 800.0).otherwise(0.0))
    other = [F.lit(x) for x in (0.4, 0.2, 0.3, 0.3)]
    share = F.when(k == 0, T.iou(box, other)).otherwise(0.0)
    return lineitem(spark, d).select("l_orderkey", "l_linenumber").distinct().select("l_orderkey", "l_linenumber", F.round(box[0], 6).alias("x"), F.round(box[3], 6).alias("h"), F.round(share, 6).alias("iou"))


@query("""select p_partkey, case when s < 1024 then s || ' B' when s < 1048576 then printf('%.2f', s / 1024.0) || ' KB' when s < 1073741824 then printf('%.2f', s / 1048576.0) || ' MB' else printf('%.2f', s / 1073741824.0) || ' GB' end as size
from (select p_partkey, cast(case p_partkey % 4 when 0 then p_size when 1 then p_size::bigint * 1280 when 2 then p_size::bigint * 1310720 else p_size::bigint * 1342177280 end as bigint) as s from part)""")
def file_sizes(spark, d):
    n, k = F.col("p_size").cast("long"), F.col("p_partkey") % 4
    size = F.when(k == 0, n).when(k == 1, n * 1280).when(k == 2, n * 1310720).otherwise(n * 1342177280)
    return part(spark, d).select("p_partkey", T.file_size(size).alias("size"))


@query(r"""select conv_id, turn, case when t = '' then 'paragraph' when t like '#%' then 'heading' when regexp_matches(t, '^[=-]{3,}\s*$') then 'divider' when regexp_matches(t, '^[0-9]+(\.[0-9]+)*\s') then 'heading'
when length(t) <= 80 and t = upper(t) and t <> lower(t) then 'heading' when t like '%:' and length(t) <= 60 then 'heading' else 'paragraph' end as hint
from (select conv_id, turn, case turn % 6 when 0 then '# ' || role when 1 then '-----' when 2 then '1.2 ' || role when 3 then upper(role) when 4 then role || ':' else regexp_replace(text, '^\s+|\s+$', '', 'g') end as t from conversations)""")
def section_hints(spark, d):
    k = F.col("turn") % 6
    line = F.when(k == 0, F.concat(F.lit("# "), "role")).when(k == 1, "-----").when(k == 2, F.concat(F.lit("1.2 "), "role")).when(k == 3, F.upper("role")).when(k == 4, F.concat("role", F.lit(":"))).otherwise(F.col("text"))
    return turns(spark, d).select("conv_id", "turn", T.section_hint(line).alias("hint"))
