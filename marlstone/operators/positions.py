"""Phrase, wildcard, regular expression, fuzzy and boolean searches from an index, without a scan of the texts.

The index is four tables, each written once: postings with the positions of every token in every row; the
vocabulary; trigrams of its tokens, which name those that a pattern can match; and the three pieces of each token,
one of which stands unchanged, at most two places away, in every word within two edits. Trigrams and pieces are written when a
search first needs them. A search names tokens first and then reads their postings only. Results are those of the scans in ``search`` and ``retrieval``.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import grouped_terms, tokens
from marlstone.operators.retrieval import edits_allowed
from marlstone.plans.stash import Stash

#: Characters of text for each file of postings, tokens for each folder of the vocabulary's tables.
FILE_CHARS, FOLDER_TOKENS = 16_000_000, 500_000
#: Files of a folder at least.
FILES = 4
#: Pieces of a token: one more than there may be edits.
PIECES = 3
#: Characters from whose deletions neighbours are found, and deletions at most.
PREFIX, DELETIONS = 7, 2


def _folder(token: Column, folders: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(folders)).cast("int")


def trigrams(token: Column) -> Column:
    """Runs of three characters of ^token$, each once."""
    whole = F.concat(F.lit("^"), token, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - 2, F.lit(1))), lambda i: whole.substr(i, F.lit(3))))


def deletions(token: Column, most: int = DELETIONS) -> Column:
    """What is left of the first characters of a token when up to ``most`` of them go, each once."""
    start = F.substring(token, 1, PREFIX)
    out = []
    for n in range(most + 1):
        for gone in combinations(range(1, PREFIX + 1), n):
            cuts = [0, *gone, PREFIX + 1]
            parts = [start.substr(a + 1, b - a - 1) for a, b in zip(cuts, cuts[1:]) if b - a > 1]
            out.append(F.concat(*parts) if parts else F.lit(""))
    return F.array_distinct(F.array(*out))


def pieces(token: Column) -> Column:
    """A token's pieces of about equal length, each with the length of the token and its own number."""
    n = F.length(token)
    cut = lambda i: F.floor(n * i / PIECES).cast("int")
    return F.array(*[F.concat_ws(" ", n, F.lit(i), token.substr(cut(i) + 1, cut(i + 1) - cut(i))) for i in range(PIECES)])


def probes(word: str, allowed: int) -> list[str]:
    """Pieces of which every token has one that a word becomes by so many edits, fewer than PIECES."""
    out = set()
    for n in range(max(0, len(word) - allowed), len(word) + allowed + 1):
        for i in range(PIECES):
            start, end = n * i // PIECES, n * (i + 1) // PIECES
            places = range(max(0, start - allowed), min(start + allowed, len(word) - (end - start)) + 1)
            out |= {f"{n} {i} {word[p : p + end - start]}" for p in places}
    return sorted(out)


def wildcard_pattern(pattern: str) -> str:
    return "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern.lower())


_PIECE = re.compile(r"\\(?P<escaped>.)|\[\^?\]?(?:\\.|[^\]])*\]|(?P<plain>[\w])|(?P<other>.)", re.S)
_QUANTIFIER = re.compile(r"[*+?]|\{\d*,?\d*\}")


def required_grams(regex: str) -> list[str]:
    """Trigrams that every token has that a regular expression matches as a whole; none where groups or choices leave it open."""
    if re.search(r"[()|]", regex):
        return []
    runs, run, at = [], "^", 0
    while at < len(regex):
        m = _PIECE.match(regex, at)
        char = m["plain"] or (m["escaped"] if m["escaped"] and not m["escaped"].isalnum() else None)
        q = _QUANTIFIER.match(regex, m.end())
        at = q.end() if q else m.end()
        if char and not q:
            run += char
            continue
        if char and q[0] == "+":
            run += char
        runs, run = [*runs, run], char if char and q[0] == "+" else ""
    runs.append(run + "$")
    return sorted({r[i : i + 3] for r in runs for i in range(len(r) - 2)})


@dataclass
class TextIndex:
    """Where the tables are, and what is needed to read them."""

    path: str
    key: str
    kind: str
    folders: int
    word_folders: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> "TextIndex":
        """An index that was written before."""
        return cls(**json.loads(spark.read.text(f"{path}/about").first().value))

    def _table(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _of_words(self, spark: SparkSession, name: str, column: str) -> DataFrame:
        """A table made of the vocabulary, written when it is first asked for."""
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            values = {"grams": trigrams, "pieces": pieces}[name](F.col("token"))
            rows = self.vocabulary(spark).select(F.explode(values).alias(column), "token").withColumn("folder", _folder(F.col(column), self.word_folders))
            rows = rows.repartition(F.col("folder"), F.pmod(F.xxhash64("token"), F.lit(FILES))).sortWithinPartitions("folder", column)
            rows.write.mode("overwrite").partitionBy("folder").parquet(f"{self.path}/{name}")
        return self._table(spark, name, f"{column} string, token string, folder int")

    def postings(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "postings", f"token string, {self.key} {self.kind}, positions array<int>, folder int")

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        """(token, df, tf)."""
        return self._table(spark, "words", "token string, df long, tf long")

    def of_tokens(self, spark: SparkSession, wanted: list[str]) -> DataFrame:
        """Postings of given tokens, from their folders only."""
        folders = sorted({zlib.crc32(w.encode()) % self.folders for w in wanted})
        return self.postings(spark).where(F.col("folder").isin(folders) & F.col("token").isin(wanted))

    def holding(self, spark: SparkSession, found: DataFrame) -> DataFrame:
        """Keys of the rows that hold any of the found tokens; the folders that are read are pruned as the join runs."""
        wanted = found.select("token").distinct().withColumn("folder", _folder(F.col("token"), self.folders))
        return self.postings(spark).join(wanted, ["folder", "token"], "left_semi").select(self.key).distinct()

    def matching_tokens(self, spark: SparkSession, regex: str) -> DataFrame:
        """Tokens that a regular expression matches as a whole: by trigrams where it has some, else from the vocabulary."""
        grams = required_grams(regex)
        if not grams:
            named = self.vocabulary(spark).select("token")
        else:
            folders = sorted({zlib.crc32(g.encode()) % self.word_folders for g in grams})
            rows = self._of_words(spark, "grams", "gram").where(F.col("folder").isin(folders) & F.col("gram").isin(grams))
            named = rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).select("token")
        return named.where(F.col("token").rlike(f"^(?:{regex})$"))

    def near_tokens(self, spark: SparkSession, word: str) -> DataFrame:
        """(token, distance) of the tokens within the edits that a word of its length may have."""
        word = word.lower()
        allowed = edits_allowed(word)
        asked = probes(word, allowed)
        folders = sorted({zlib.crc32(x.encode()) % self.word_folders for x in asked})
        rows = self._of_words(spark, "pieces", "piece").where(F.col("folder").isin(folders) & F.col("piece").isin(asked))
        named = rows.select("token").distinct().withColumn("distance", F.levenshtein("token", F.lit(word)))
        return named.where(F.col("distance") <= allowed)

    def phrase(self, spark: SparkSession, words: str) -> DataFrame:
        """Keys of the rows in which the tokens of ``words`` follow each other."""
        wanted = [w.lower() for w in re.findall(r"\w+", words)]
        rows = self.of_tokens(spark, sorted(set(wanted)))
        places = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(i).alias("at")) for i, w in enumerate(wanted)]) if wanted else None
        if places is None:
            return rows.select(self.key).where("false")
        if len(wanted) == 1:
            return rows.select(self.key).distinct()
        own = F.filter(places, lambda p: p["token"] == F.col("token"))
        starts = F.flatten(F.transform(own, lambda p: F.transform("positions", lambda x: x - p["at"])))
        starts = rows.select(self.key, F.explode(starts).alias("start"))
        return starts.groupBy(self.key, "start").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(self.key).distinct()

    def wildcard(self, spark: SparkSession, pattern: str) -> DataFrame:
        """Keys of the rows with a token that a pattern with * and ? matches."""
        return self.holding(spark, self.matching_tokens(spark, wildcard_pattern(pattern)))

    def regexp(self, spark: SparkSession, regex: str) -> DataFrame:
        """Keys of the rows with a token that a regular expression matches as a whole."""
        return self.holding(spark, self.matching_tokens(spark, regex))

    def fuzzy(self, spark: SparkSession, word: str) -> DataFrame:
        """Keys of the rows with a token within the edits that the word may have."""
        return self.holding(spark, self.near_tokens(spark, word))

    def boolean(self, spark: SparkSession, query: str) -> DataFrame:
        """Keys of the rows that a query of words, "phrases", AND, OR, NOT and parentheses matches, as ``search.boolean`` reads it."""
        parts = re.findall(r"\(|\)|\"[^\"]*\"|[^\s()]+", query)
        every = self._table(spark, "keys", f"{self.key} {self.kind}")

        def either(at: int):
            out, at = both(at)
            while at < len(parts) and parts[at].upper() == "OR":
                other, at = both(at + 1)
                out = out.unionByName(other).distinct()
            return out, at

        def both(at: int):
            out, at = one(at)
            while at < len(parts) and parts[at].upper() not in ("OR", ")"):
                other, at = one(at + (parts[at].upper() == "AND"))
                out = out.join(other, self.key, "left_semi")
            return out, at

        def one(at: int):
            if parts[at].upper() == "NOT":
                out, at = one(at + 1)
                return every.join(out, self.key, "left_anti"), at
            if parts[at] == "(":
                out, at = either(at + 1)
                return out, at + 1
            return self.phrase(spark, parts[at].strip('"')), at + 1

        return either(0)[0] if parts else every.where("false")


def text_index(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> TextIndex:
    """Write the tables of an index of whole texts; ``TextIndex.open`` reads them again.

    Null texts have no tokens. Keys are taken to be unique: rows with one key have postings of their own, which
    searches read together. Postings are dealt by token to folders and by key to the files of a folder, as many of either,
    so neither all tokens nor one frequent token meets in a task; the number goes by the length of the texts.
    Without a path the index is in the shared folder until the driver ends.
    """
    spark = docs.sparkSession
    path = path or f"{Stash(spark).root}/text"
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    folders = max(1, math.isqrt(chars // FILE_CHARS))
    files = max(FILES, chars // FILE_CHARS // folders)
    # positions are put together within the row, before anything is shuffled
    found = docs.select(key, F.explode(grouped_terms(tokens(F.col(text)))).alias("g")).select(F.col("g.term").alias("token"), key, F.col("g.places").alias("positions"))
    found = found.withColumn("folder", _folder(F.col("token"), folders))
    rows = found.repartition(F.col("folder"), F.pmod(F.xxhash64(key), F.lit(files)))
    rows.sortWithinPartitions("folder", "token", key).write.mode("overwrite").partitionBy("folder").parquet(f"{path}/postings")
    out = TextIndex(path, key, dict(docs.dtypes)[key], folders, 1)
    docs.select(key).write.mode("overwrite").parquet(f"{path}/keys")
    words = out.postings(spark).groupBy("token").agg(F.count("*").alias("df"), F.sum(F.size("positions").cast("long")).alias("tf"))
    words.write.mode("overwrite").parquet(f"{path}/words")
    out.word_folders = 1 + out.vocabulary(spark).count() // FOLDER_TOKENS
    spark.createDataFrame([(json.dumps(asdict(out)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return out
