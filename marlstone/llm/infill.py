"""Fill-in-middle transformation by DuckDB inside mapInArrow.

Each slice of an Arrow batch is registered with a DuckDB connection that a task opens once, and one
SQL statement cuts its texts: ``regexp_extract_all`` gives the tokens, ``list_slice`` and
``array_to_string`` the three parts, ``sha256`` of the id the places of the cuts and the form. The
result comes back as Arrow; no row is seen by Python. Rows are independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.texts import bound_batches, give_back, sliced

# Tokens, and the marks of the parts.
TOKEN = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 documents, those that are transformed, and of these the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Bytes of text that DuckDB cuts at a time: a token of one character takes 16 bytes in its lists.
SLICE_BYTES = 2_000_000
#: What DuckDB may take in a worker before it spills to the worker's own folder.
MEMORY = "700MB"

_PARTS = f"""
with hashed as (
  select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(doc_id::varchar, '')) as h from batch
), cut as (
  select doc_id, text, regexp_extract_all(text, '{TOKEN}') as tokens,
    ('0x' || substr(h, 1, 8))::ubigint as h1, ('0x' || substr(h, 9, 8))::ubigint as h2,
    ('0x' || substr(h, 17, 8))::ubigint as h3, ('0x' || substr(h, 25, 8))::ubigint as h4
  from hashed
), placed as (
  select *, len(tokens)::bigint as n,
    least(h1 % (len(tokens) + 1)::ubigint, h2 % (len(tokens) + 1)::ubigint)::bigint as a,
    greatest(h1 % (len(tokens) + 1)::ubigint, h2 % (len(tokens) + 1)::ubigint)::bigint as b,
    case when text = '' or contains(text, '{PREFIX}') or contains(text, '{SUFFIX}') or contains(text, '{MIDDLE}') or h3 % 100 >= $transformed then 'plain'
      when h4 % 100 < $suffix_first then 'spm' else 'psm' end as form
  from cut
), parted as (
  select doc_id, text, n, form,
    case when form != 'plain' then array_to_string(list_slice(tokens, 1, a), '') end as prefix,
    case when form != 'plain' then array_to_string(list_slice(tokens, a + 1, b), '') end as middle,
    case when form != 'plain' then array_to_string(list_slice(tokens, b + 1, n), '') end as suffix
  from placed
)
select doc_id, n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars,
  case form when 'plain' then text
    when 'psm' then '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
    else '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle end as output
from parted
"""

#: A part ends where the next mark begins; a text that holds a mark itself is never cut.
_RESTORED = f"""
with told as (
  select *, instr(output, '{PREFIX}') as p, instr(output, '{SUFFIX}') as s, instr(output, '{MIDDLE}') as m from %s
)
select * exclude (p, s, m), case form when 'plain' then output
  when 'psm' then substr(output, p + 3, s - p - 3) || substr(output, m + 3) || substr(output, s + 3, m - s - 3)
  when 'spm' then substr(output, p + 3, m - p - 3) || substr(output, m + 3) || substr(output, s + 3, p - s - 3) end as restored
from told
"""


def by_duckdb(rows: DataFrame, sql: str, schema: str, numbers: dict[str, int] | None = None) -> DataFrame:
    """``sql`` over each slice of the rows, which it reads as ``batch``; it must give the columns of ``schema``."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, connection = to_arrow_schema(fields), duckdb.connect()
        connection.execute(f"set threads = 1; set memory_limit = '{MEMORY}'; set preserve_insertion_order = true")
        for part in sliced(batches, SLICE_BYTES):
            connection.register("batch", pa.Table.from_batches([part]))
            got = connection.sql(sql, params=numbers).to_arrow_table()
            connection.unregister("batch")
            yield from got.select(arrow.names).cast(arrow).to_batches()
        connection.close()
        part = got = None
        give_back()

    bound_batches(rows.sparkSession)
    return rows.mapInArrow(run, fields)


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars and ``output`` of each row.

    Form is plain (the text as it is), psm or spm; a plain row has no prefix_chars and middle_chars.
    Null and empty texts are plain and empty. A null doc_id stays null and is hashed as no digits;
    rows that repeat an id are cut alike. Other columns are not read, whatever their names; an
    empty table gives an empty result. Texts are taken whole.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return by_duckdb(rows, _PARTS, schema, {"transformed": int(transformed), "suffix_first": int(suffix_first)})


def restored(rows: DataFrame, form: str = "form", output: str = "output") -> DataFrame:
    """``rows`` with ``restored``, the text that an output and its form stand for; null if either is null."""
    kept = [c for c in rows.columns if c != "restored"]
    named = rows.select(*[F.col(f"`{c}`") for c in kept if c not in (form, output)], F.col(f"`{form}`").alias("form"), F.col(f"`{output}`").alias("output"))
    schema = ", ".join(f"`{c}` {kind}" for c, kind in named.dtypes) + ", restored string"
    return by_duckdb(named, _RESTORED % "batch", schema).withColumnsRenamed({"form": form, "output": output})


def infill_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """What ``fill_in_middle`` makes and what is rebuilt from it, as digests: one pass, texts don't leave the workers."""
    digests = f"""
    with made as ({_PARTS}), rebuilt as ({_RESTORED % "made"})
    select doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256(restored) as restored_sha256 from rebuilt
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    return by_duckdb(rows, digests, schema, {"transformed": TRANSFORMED, "suffix_first": SUFFIX_FIRST})
