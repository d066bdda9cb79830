"""A training corpus from ``documents``: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import bpe, mixing, ngram_join, queries, secrets, toxicity
from marlstone.plans.stash import Stash
from marlstone.session import read_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts have the score of no words and stay, as rows with a null doc_id do; rows that repeat
    are judged alike. An empty table gives an empty result; columns of any names are kept.
    """
    return toxicity.without_toxic(docs, toxicity.fit_on(docs, read_table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at 0.8 or more, the one with the least doc_id stays.

    Texts without words are linked with nothing and stay. Of rows that repeat a doc_id one stays; rows with a
    null doc_id can't be named in a link and all stay. An empty table gives an empty result; columns of any
    names are kept.
    """
    return ngram_join.one_of_each_group(docs, n=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay and n_chars follows the text.

    Null texts stay null. Repeated rows are treated alike; columns of any names are kept.
    """
    return secrets.redacted_documents(docs, secrets.train(secrets.labelled_samples(spark)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, some of them two or three times, so that sources come near their targets.

    Null and blank texts, which add no words, go. Null and repeated doc_ids are mixed like others; a null
    source is a source of its own. An empty table gives an empty result; columns of any names are kept.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts of the mix, one row for each of its rows.

    Null counts as the empty text; a null doc_id stays null.
    """
    return queries.digested(bpe.bpe_encode(docs, queries.tokenizer_path(), decoded=True, packed=True))


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing to target weights", mix),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each one's result written in the shared folder and read again."""
    stash, docs = Stash(spark), read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, stash.put(stage(spark, docs, sf_dir))
        stash.drop(before)
    return docs


#: SQL can't express the trained stages; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None
