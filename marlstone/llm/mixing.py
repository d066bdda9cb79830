"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations.

Targets are shares of all words by weight, none above ``most`` times its source. Words come in
blocks of equal size: each goes to the source with the highest quotient target / (2 k + 1), k the
blocks it has. With m parts, the quotients that are as high as seats - m / 2 of ideal rounding win
in any case and those below seats + m / 2 lose, so some 4 m of them are ranked, whatever the shares. A
source's blocks are shared out in the same way among runs of its shards, and a run's among its
shards, so no group has more than FAN parts. A shard's documents, in a seeded order, are one run
of blocks: it takes whole passes and then a run of blocks from a seeded start, so a document is taken
floor or ceiling of the shard's passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.texts import NOT_SPACE
from marlstone.plans.stash import Stash

BLOCK_WORDS = 16
#: Rows of the whole table for each shard of a source.
ROWS_A_SHARD = 1500
#: Parts among which blocks are shared out at a time.
FAN = 1024
#: Rows of a written table for each of its files.
ROWS_A_FILE = 50_000
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NOT_SPACE)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, source_no, target: shares by weight, capped, the excess shared again.

    ``sizes`` has a row for each source. A source is capped if its cap is below its share of what
    sources with smaller ratios of cap to weight leave; so one sorted pass finds the level at
    which sharing again and again would end.
    """
    everything = Window.partitionBy()
    numbered = sizes.withColumn("source_no", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.lit(list(map(float, weights))), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    rows = numbered.withColumns({"w": weight, "cap": F.col("source_size") * float(most)}).withColumn("ratio", F.col("cap") / F.col("w"))
    order = everything.orderBy("ratio", "source_no")
    rest = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    total = F.sum("source_size").over(everything)
    rows = rows.withColumn("level", (total - capped) / rest)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.coalesce(F.least("cap", level * F.col("w")), F.col("cap"))).select("source", "source_size", "source_no", "target")


def apportion(parts: DataFrame, within: list[str], share: str, seats: str, order: list[str], out: str) -> DataFrame:
    """``parts`` with ``out``: Sainte-Lague seats of each row, of ``seats`` in its group, by ``share``."""
    group = Window.partitionBy(*within)
    total = F.sum(share).over(group)
    half = F.sum(F.when(F.col(share) > 0, 0.5).otherwise(0.0)).over(group)
    rounded = lambda n: F.when(total > 0, F.floor(F.col(share) * n / total + 0.5)).otherwise(0).cast("long")
    rows = parts.withColumns({
        "_sure": F.greatest(rounded(F.greatest(F.col(seats) - half, F.lit(0.0))) - 1, F.lit(0)),  # one off either way, as doubles are
        "_most": rounded(F.col(seats) + half) + 1,
    })
    rows = rows.withColumn("_left", F.col(seats) - F.sum("_sure").over(group))
    ranked = rows.withColumn("_k", F.explode(F.sequence(F.col("_sure"), F.col("_most")))).withColumn("_q", F.col(share) / (2 * F.col("_k") + 1))
    rank = F.row_number().over(group.orderBy(F.col("_q").desc(), *order, "_k"))
    won = (F.col("_q") > 0) & (rank <= F.col("_left"))
    ranked = ranked.withColumn("_won", won.cast("long"))
    kept = [c for c in parts.columns]
    return ranked.groupBy(*kept, "_sure").agg(F.sum("_won").alias("_more")).withColumn(out, F.col("_sure") + F.col("_more")).select(*kept, out)


def shard_blocks(by_shard: DataFrame, goal: DataFrame, shards: int, fan: int | None = None) -> DataFrame:
    """source, shard, shard_size, source_size, target and blocks: a source's blocks go to runs of shards, a run's to its shards.

    Runs hold a power of ``fan`` shards, so a group of parts has ``fan`` rows at most.
    """
    fan = fan or FAN
    level, above = 0, goal.select("source", "source_size", "target", F.lit(0).cast("long").alias("node"), F.col("source_blocks").alias("blocks"))
    while fan ** (level + 1) < shards:
        level += 1
    for power in range(level, -1, -1):
        nodes = by_shard.groupBy(F.col("source").alias("_s"), F.expr(f"shard div {fan**power}L").alias("_n")).agg(F.sum("shard_size").alias("size"))
        nodes = nodes.join(above.drop("size"), F.col("_s").eqNullSafe(F.col("source")) & (F.expr(f"_n div {fan}L" if power < level else "0L") == F.col("node")))
        nodes = nodes.select("source", "source_size", "target", "node", F.col("_n").alias("part"), "size", F.col("blocks").alias("_seats"))
        above = apportion(nodes, ["source", "node"], "size", "_seats", ["part"], "blocks").select("source", "source_size", "target", F.col("part").alias("node"), "size", "blocks")
    return above.select("source", F.col("node").cast("int").alias("shard"), F.col("size").alias("shard_size"), "source_size", "target", "blocks")


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = 3,
    block_words: int = BLOCK_WORDS, seed: int = 17, rows_a_shard: int = ROWS_A_SHARD,
) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row.

    Null and blank texts have size 0 and are taken 0 words. A null source is a source of its own,
    the last; a null doc_id is a document like others. Rows that repeat are taken independently.
    Other columns are not read; an empty table gives an empty result. Reruns agree: shards and
    order are by hashes of the seed, the id and the text, ties by id and size.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text).cast("string")).alias("mark"),
    )
    return _mixed(rows, weights, most, block_words, seed, rows_a_shard).select("doc_id", "size", "source_size", "target", "taken")


def _mixed(rows: DataFrame, weights, most: int, block_words: int, seed: int, rows_a_shard: int) -> DataFrame:
    """``rows`` (doc_id, source, size, mark and others) with source_size, target and taken.

    The mark, a hash of what a row holds, deals out rows whose id is null or repeated.
    """
    stash = Stash(rows.sparkSession)
    n = rows.agg(F.count("*")).first()[0]
    files, shards = 1 + n // ROWS_A_FILE, max(1, -(-n // rows_a_shard))
    thin = stash.put(rows.repartition(files))
    rows = thin.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(shards)).cast("int"))
    by_shard = stash.put(rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).repartition(files))
    goal = targets(by_shard.groupBy("source").agg(F.sum("shard_size").alias("source_size")), weights, most)
    total = F.sum("source_size").over(Window.partitionBy())
    goal = goal.withColumn("_all", F.round(total / block_words).cast("long")).withColumn("_one", F.lit(1))
    goal = apportion(goal, ["_one"], "target", "_all", ["source_no"], "source_blocks").select("source", "source_size", "target", "source_blocks")
    quota = shard_blocks(by_shard, goal, shards)
    quota = quota.withColumn("words", F.least(F.col("blocks") * block_words, F.col("shard_size") * most))
    run = F.ceil(F.col("shard_size") / block_words).cast("long")
    quota = quota.withColumns({
        "passes": F.when(F.col("shard_size") > 0, F.expr("words div shard_size")).otherwise(0).cast("long"),
        "rest": F.when(F.col("shard_size") > 0, F.col("words") % F.col("shard_size")).otherwise(0).cast("long"),
        "start": F.when(run > 0, F.pmod(F.xxhash64(F.lit(seed), "source", "shard"), run) * block_words).otherwise(0).cast("long"),
    }).withColumnsRenamed({"source": "_s", "shard": "_n"}).drop("blocks", "words")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed), "doc_id", "mark", F.lit("order")), "doc_id", "size", "mark")
    rows = rows.withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("at", F.col("to") - F.col("size"))
    rows = rows.join(quota, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_n")))

    def overlap(a: Column, b: Column) -> Column:
        return F.greatest(F.least(F.col("to"), b) - F.greatest(F.col("at"), a), F.lit(0))

    end = F.col("start") + F.col("rest")
    extra = overlap(F.col("start"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0).cast("long"), end - F.col("shard_size"))
    return rows.select(*thin.columns, "source_size", "target", (F.col("passes") * F.col("size") + extra).alias("taken"))


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, most: int = 3,
    block_words: int = BLOCK_WORDS, seed: int = 17, rows_a_shard: int = ROWS_A_SHARD,
) -> DataFrame:
    """Whole documents of the mix: each row as often as what is taken of it, rounded, counts.

    Rows whose rounded number is 0 go, null and blank texts among them; others may come two or
    three times. All columns of ``docs`` are kept, whatever their names. Rows are matched by two
    hashes over all their columns, so a null or repeated doc_id is a row like others; rows equal in
    every column come equally often. An empty table gives an empty result.
    """
    plain = [F.col(f"`{c}`").cast("string") if "map<" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    key = F.struct(F.xxhash64(*plain).alias("a"), F.xxhash64(F.lit(seed), *plain).alias("b"))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"),
        F.xxhash64(F.col(text).cast("string")).alias("mark"), key.alias("key"),
    )
    taken = _mixed(rows, weights, most, block_words, seed, rows_a_shard).where("size > 0")
    taken = taken.groupBy("key").agg(F.floor(F.avg("taken") / F.max("size") + F.lit(0.5)).cast("int").alias("copies")).where("copies > 0")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"))
    out = whole.join(taken.hint("shuffle_hash"), "key").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
