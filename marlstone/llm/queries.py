"""One query for each operator of this subpackage, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat, fingerprints, htmltext, infill, licenses, mixing, ngram_join, preference, quality, ranking, secrets, toxicity
from marlstone.session import read_table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_on(docs, read_table(spark, sf_dir, "labels")))


def digested(rows: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of packed ids and decoded documents."""
    return rows.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded_text").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(bpe.bpe_encode(read_table(spark, sf_dir, "documents"), tokenizer_path(), decoded=True, packed=True))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select * from values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)")
    rows = chat.format_chats(turns.unionByName(extra.to(turns.schema)))
    rows = rows.select("conv_id", "formatted", "loss_mask", chat.read_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"), "n_runs")
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_runs",
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_samples(spark))
    rows = secrets.scan_secrets(read_table(spark, sf_dir, "documents"), model)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.named_spans(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.named_spans(secrets.all_spans(F.col("base"), F.col("added"))).alias("spans"),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(read_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts_by_labels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_components(read_table(spark, sf_dir, "documents"), n=3, percent=90)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)


def op12_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.score_by_labels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_fingerprints, op2_toxicity, op3_bpe, op4_chat, op5_licenses, op6_secrets, op7_html, op8_quality, op9_mixing, op10_ngram_join,
        op11_ranked_search, op12_quality_ranking, op13_fill_in_middle,
    )
}

_SEARCH_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term"

ORACLES: dict[str, str] = {
    "op11_ranked_search": f"""
with counts as (select doc_id, term, count(*) as tf from (select doc_id, {_SEARCH_TERMS} from documents) group by all),
sizes as (select doc_id, sum(tf)::bigint as n from counts group by all),
total as (select count(*) as docs, sum(n)::bigint as words from sizes),
weights as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint as w from (select term, count(*) as df from counts group by all), total),
asked as (select item_id, {_SEARCH_TERMS} from benchmark),
scores as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // words))))::bigint as score
  from asked join weights using (term) join counts using (term) join sizes using (doc_id), total group by all
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scores where score > 0
qualify rank <= 10""",
    "op13_fill_in_middle": """
with hashed as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as tokens, sha256('1:' || doc_id) as h from documents),
numbers as (
  select *, list_transform([0, 1, 2, 3], lambda i: ('0x' || h[8 * i + 1 : 8 * i + 8])::bigint) as hs, len(tokens) as n from hashed
),
cuts as (
  select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as a, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as b,
    case when text = '' or regexp_matches(text, '<[PSM]>') or hs[3] % 100 >= 90 then 'plain' when hs[4] % 100 < 20 then 'spm' else 'psm' end as form from numbers
),
parts as (select *, array_to_string(tokens[1:a], '') as p, array_to_string(tokens[a + 1 : b], '') as m, array_to_string(tokens[b + 1 : n], '') as s from cuts)
select doc_id, n::bigint as n, form, case when form != 'plain' then length(p) end::bigint as prefix_chars, case when form != 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts""",
}
