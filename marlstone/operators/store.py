"""Writes of the application as frames: create, change, soft delete, tags, moves, versions, graph upserts, exports.

A write is a function from the rows as they are to the rows as they will be; the caller stores them (see ``sources.files``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.relational import live, numbered


def deleted(rows: DataFrame, where: Column) -> DataFrame:
    """What is left when the rows that ``where`` holds of go; those it is null of stay."""
    return rows.where(~F.coalesce(where, F.lit(False)))


def get(rows: DataFrame, key: str, value, flag: str = "is_deleted") -> DataFrame:
    """The live row of a key, or none."""
    return live(rows, flag).where(F.col(key) == value).limit(1)


def created(rows: DataFrame, news: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` and ``news``, which get the next keys in their order."""
    last = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_last"))  # one row
    fresh = numbered(news.drop(key), *order, name="_n").join(F.broadcast(last)).withColumn(key, (F.col("_last") + F.col("_n")).cast(rows.schema[key].dataType))
    return rows.unionByName(fresh.drop("_n", "_last"), allowMissingColumns=True)


def updated(rows: DataFrame, where: Column, changes: dict) -> DataFrame:
    """Named columns take new values in the rows that ``where`` holds of; nulls of ``where`` don't."""
    hit = F.coalesce(where, F.lit(False))
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns({c: F.when(hit, value(v)).otherwise(F.col(c)) for c, v in changes.items()})


def soft_deleted(rows: DataFrame, where: Column, flag: str = "is_deleted") -> DataFrame:
    return updated(rows, where, {flag: True})


def hard_deleted(rows: DataFrame, flag: str = "is_deleted") -> DataFrame:
    """What is left when rows that were soft-deleted go for good."""
    return live(rows, flag)


def tagged(rows: DataFrame, where: Column, tags: list[str], how: str = "add", column: str = "tags") -> DataFrame:
    """Tags added (a sorted union), removed or replaced in some rows; null tags count as none."""
    old = F.coalesce(column, F.array().cast("array<string>"))
    given = F.array(*map(F.lit, tags)).cast("array<string>")
    new = {"add": F.array_sort(F.array_union(old, given)), "remove": F.array_except(old, given), "replace": given}[how]
    return updated(rows, where, {column: new})


def moved(rows: DataFrame, asked: DataFrame, allowed: DataFrame, key: str, to: dict, *by: str) -> tuple[DataFrame, DataFrame]:
    """(rows after the move, keys that failed): of the asked keys those move that are there and whose ``by`` columns are allowed."""
    wanted = asked.select(key).distinct()
    can = rows.join(wanted, key, "left_semi").join(allowed.select(*by).distinct(), list(by), "left_semi").select(key).withColumn("_can", F.lit(True))
    after = updated(rows.join(can, key, "left"), F.col("_can"), to).drop("_can")
    return after, wanted.join(can, key, "left_anti")


def with_revert(versions: DataFrame, asked: DataFrame, key: str = "chunk_id", version: str = "version", content: str = "content") -> DataFrame:
    """Versions and, for each asked (key, version) that exists, a new latest one with its content and ``reverted_from``."""
    last = versions.groupBy(key).agg(F.max(version).alias("_last"))
    old = versions.join(asked.select(key, version).distinct(), [key, version]).join(last, key)
    n = F.row_number().over(Window.partitionBy(key).orderBy(version))
    new = old.select(key, (F.col("_last") + n).cast(versions.schema[version].dataType).alias(version), content, F.col(version).alias("reverted_from"))
    return versions.withColumn("reverted_from", F.lit(None).cast(versions.schema[version].dataType)).select(*new.columns).unionByName(new)


def with_version(versions: DataFrame, news: DataFrame, key: str = "chunk_id", version: str = "version", content: str = "content") -> DataFrame:
    """Versions and a new latest one of each key of ``news`` (key, content); keys without versions begin at 1."""
    last = versions.groupBy(key).agg(F.max(version).alias("_last"))
    new = news.join(last, key, "left").select(key, (F.coalesce("_last", F.lit(0)) + 1).cast(versions.schema[version].dataType).alias(version), content)
    return versions.select(key, version, content).unionByName(new)


def vertices_upserted(vertices: DataFrame, news: DataFrame, *keys: str) -> DataFrame:
    """Vertices with new ones in place of those of the same keys; of new ones that agree in them the least id stays."""
    one = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    fresh = news.withColumn("_n", one).where("_n = 1").drop("_n")
    return vertices.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def edges_added(edges: DataFrame, news: DataFrame, weight: float = 0.5, confidence: float = 0.8) -> DataFrame:
    """Edges and new ones with default weight and confidence; those without a kind or an end are no edges."""
    fresh = news.where("src is not null and dst is not null and kind is not null and kind != ''")
    fresh = fresh.withColumns({"weight": F.coalesce("weight", F.lit(weight)), "confidence": F.coalesce("confidence", F.lit(confidence))})
    return edges.unionByName(fresh.select(*edges.columns))


def entities_deleted(vertices: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices marked as deleted, and the edges that touch none of them."""
    ids = gone.select(F.col("id")).distinct()
    marked = vertices.join(ids.withColumn("_gone", F.lit(True)), "id", "left")
    marked = updated(marked, F.col("_gone"), {"is_deleted": True}).drop("_gone")
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return marked, left.select(*edges.columns)


def without_orphans(vertices: DataFrame, valid: DataFrame, entity: str = "entity_id", most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices that stay, orphans): an orphan's entity is null, 0 or not valid. ``most`` bounds how many go, the least ids first."""
    known = valid.select(F.col("id").alias(entity)).where(F.col(entity) != 0).distinct()
    orphans = vertices.join(known, entity, "left_anti").select("id")
    if most is not None:
        orphans = orphans.orderBy("id").limit(most)
    return vertices.join(orphans, "id", "left_anti").select(*vertices.columns), orphans


def counted_words(counts: DataFrame, asked: DataFrame, most: int = 200) -> DataFrame:
    """Hot words (keyword, n, last_at) after new searches (keyword, at): trimmed, cut, blank ones left out."""
    new = asked.select(F.substring(F.trim("keyword"), 1, most).alias("keyword"), "at").where("keyword != ''")
    new = new.groupBy("keyword").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return counts.select("keyword", "n", "last_at").unionByName(new).groupBy("keyword").agg(F.sum("n").alias("n"), F.max("last_at").alias("last_at"))


def batch_status(files: DataFrame, batch: str = "batch_id") -> DataFrame:
    """(batch, total, success, failed, progress, status, files) of files (batch, file_id, state: done, failed or other)."""
    done, bad, n = F.count_if(F.col("state") == "done"), F.count_if(F.col("state") == "failed"), F.count("*")
    listed = F.sort_array(F.collect_list(F.struct("file_id", "state")))
    out = files.groupBy(batch).agg(n.alias("total"), done.alias("success"), bad.alias("failed"), listed.alias("files"))
    over = F.col("success") + F.col("failed")
    status = F.when(over == 0, "pending").when(over < F.col("total"), "processing").when(F.col("failed") == 0, "completed").when(F.col("success") == 0, "failed").otherwise("partial")
    return out.select(batch, "total", "success", "failed", F.round(over * 100.0 / F.col("total"), 2).alias("progress"), status.alias("status"), "files")


def page_info(total: Column, page: Column, size: Column) -> list[Column]:
    """pages, has_next, has_prev; page is 1 at least, size 1 to 100 and 20 where not given."""
    size = F.least(F.greatest(F.coalesce(size, F.lit(20)), F.lit(1)), F.lit(100))
    page = F.greatest(F.coalesce(page, F.lit(1)), F.lit(1))
    pages = F.ceil(total / size)
    return [pages.alias("pages"), (page < pages).alias("has_next"), (page > 1).alias("has_prev")]


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two snapshots (path, hash): added, removed or modified."""
    a, b = old.select("path", F.col("hash").alias("_a")), new.select("path", F.col("hash").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return a.join(b, "path", "full").select("path", kind.alias("change")).where("change is not null")


def kb_json(bases: DataFrame, documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """(kb_id, json): each knowledge base (kb_id, name) with its documents (kb_id, doc_id, title) and, if given, their chunks (doc_id, chunk_index, content)."""
    if chunks is not None:
        per = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
        documents = documents.join(per, "doc_id", "left")
        one = F.struct("doc_id", "title", F.coalesce("chunks", F.array().cast("array<struct<chunk_index:int,content:string>>")).alias("chunks"))
    else:
        one = F.struct("doc_id", "title")
    listed = documents.groupBy("kb_id").agg(F.sort_array(F.collect_list(one)).alias("documents"))
    out = bases.join(listed, "kb_id", "left")
    return out.select("kb_id", F.to_json(F.struct("kb_id", "name", F.coalesce(F.size("documents"), F.lit(0)).alias("document_count"), "documents")).alias("json"))


def kb_markdown(bases: DataFrame, documents: DataFrame) -> DataFrame:
    """(kb_id, markdown): a title, the number of documents and a section for each, in order of their ids."""
    lines = documents.groupBy("kb_id").agg(F.sort_array(F.collect_list(F.struct("doc_id", "title", "size"))).alias("d"))
    section = lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n- ID: "), x["doc_id"].cast("string"), F.lit("\n- Size: "), x["size"], F.lit("\n"))
    n = F.when(F.col("d").isNull(), 0).otherwise(F.size("d"))
    body = F.coalesce(F.array_join(F.transform("d", section), "\n"), F.lit(""))
    return bases.join(lines, "kb_id", "left").select("kb_id", F.concat(F.lit("# "), "name", F.lit("\n\nDocuments: "), n.cast("string"), F.lit("\n\n"), body).alias("markdown"))


def document_markdown(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, markdown): a title and the document's chunks in order."""
    text = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("c"))
    body = F.coalesce(F.array_join("c.content", "\n\n"), F.lit(""))
    return documents.join(text, "doc_id", "left").select("doc_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), body).alias("markdown"))


def document_json(documents: DataFrame, chunks: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, json): a document with its chunks (doc_id, chunk_index, content) and images (doc_id, image), each in order."""
    c = chunks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    i = images.groupBy("doc_id").agg(F.sort_array(F.collect_list("image")).alias("images"))
    return documents.join(c, "doc_id", "left").join(i, "doc_id", "left").select("doc_id", F.to_json(F.struct("doc_id", "title", "chunks", "images")).alias("json"))


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header, nulls as empty cells."""
    plain = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])
    plain.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_array(rows: DataFrame, group: list[str], *order: str) -> DataFrame:
    """(group, json): the rows of each group as one JSON array, in order."""
    one = F.struct(*order, F.struct(*[F.col(c) for c in rows.columns]).alias("_row"))
    out = rows.groupBy(*group).agg(F.sort_array(F.collect_list(one)).alias("r"))
    return out.select(*group, F.to_json(F.col("r._row"), {"ignoreNullFields": "false"}).alias("json"))
