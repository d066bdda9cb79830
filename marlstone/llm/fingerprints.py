"""Document fingerprints: a Merkle tree over words, paragraphs and sections, in Spark expressions.

A paragraph is a line; its hash covers the hashes of its words (with the white space after them; long
ones in pieces). Paragraphs are gathered into sections, which end at a blank paragraph or where a
paragraph's own hash says so, so an edit moves no boundary but its own. A section's hash covers those
of its paragraphs, the root those of the sections and the SHA-256 of the text: equal roots mean
equal texts, and where roots differ, the sections and paragraphs that differ locate the edits.

Words are too many to keep. Below each paragraph stand the hashes of its pieces: runs of some 4 words
that end where the hash of two neighbouring words says so, after 64 words at the latest (``m``, in every
fingerprint). Texts of up to 300 code points also have pieces of four characters (``f``), by which two
such texts are compared. Likeness goes down from the root and looks only into the branches that differ.

A fingerprint is the string root:levels|section|section..., a section hash;paragraph;paragraph..., a
paragraph hash,pieces,pieces (by level, joined by dots). Hashes are kept whole: 256 bits for the root
(hex), 128 for sections and paragraphs, 64 for pieces (base64).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.texts import constant, let

#: (letter, least and most code points of the texts, neighbouring words that end a piece: one in so many)
LEVELS = (("f", 0, 300, 1), ("m", 0, 2**31 - 1, 4))
#: Words and, in scripts without spaces, pieces of them.
_WORDS = r"\S{1,16}\s*|\s+"
_PIECES = r"(?:[^.|]++\.){0,63}[^.|]++[.|]"
#: A section ends after a paragraph whose hash begins with one of these: one in eight.
_SECTION_ENDS = "ABCDEFGH"
#: Buckets of neighbouring documents for each shuffle partition.
BUCKETS_A_PARTITION = 8
_LEAST = -(2**63)


def _hash64(x: Column) -> Column:
    return F.substring(F.base64(F.unhex(F.lpad(F.hex(F.xxhash64(x)), 16, "0"))), 1, 11)


def _hash128(x: Column) -> Column:
    return F.substring(F.base64(F.unhex(F.md5(x.cast("binary")))), 1, 22)


def _paragraph(paragraph: Column, size: Column) -> Column:
    """hash,pieces,pieces of a paragraph of a text of ``size`` code points; ends in | if it ends its section."""

    def of_words(words: Column) -> Column:
        def of_hashes(hashes: Column) -> Column:
            def pieces(least: int, most: int, one_in: int) -> Column:
                if one_in == 1:
                    found = F.regexp_extract_all(paragraph, F.lit("(?s).{1,4}"), F.lit(0))
                else:
                    before = lambda i: F.when(i > 0, F.element_at(words, i)).otherwise("")
                    end = lambda i: F.when(F.pmod(F.xxhash64(before(i), F.element_at(words, i + 1)), F.lit(one_in)) == 0, "|").otherwise(".")
                    found = F.regexp_extract_all(F.array_join(F.transform(hashes, lambda h, i: F.concat(h, end(i))), ""), F.lit(_PIECES), F.lit(0))
                return F.when((size >= least) & (size <= most), F.array_join(F.transform(found, _hash64), ".")).otherwise("")

            name = _hash128(F.array_join(hashes, "."))
            ends = (F.size(words) == 0) | F.lit(_SECTION_ENDS).contains(F.substring(name, 1, 1))
            return F.concat(F.concat_ws(",", name, *[pieces(*x[1:]) for x in LEVELS]), F.when(ends, "|").otherwise(""))

        return let(F.transform(words, lambda w: F.hex(F.xxhash64(w))), of_hashes)

    return let(F.regexp_extract_all(paragraph, F.lit(_WORDS), F.lit(0)), of_words)


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text; null counts as the empty text."""

    def of_text(x: Column) -> Column:
        size = F.length(x)
        paragraphs = let(size, lambda n: F.transform(F.split(x, "\n", -1), lambda p: _paragraph(p, n)))
        joined = F.filter(F.split(F.array_join(paragraphs, ";"), r"\|;?"), lambda s: s != "")
        sections = F.transform(joined, lambda s: F.concat_ws(";", _hash128(F.regexp_replace(s, ",[^;]*", "")), s))
        names = lambda found: F.array_join(F.transform(found, lambda s: F.substring(s, 1, 22)), ".")
        levels = F.concat(*[F.when((size >= a) & (size <= b), name).otherwise("") for name, a, b, _ in LEVELS])
        return let(
            sections,
            lambda found: F.concat(
                F.sha2(F.concat_ws(":", F.sha2(x.cast("binary"), 256), names(found)).cast("binary"), 256), F.lit(":"), levels, F.lit("|"), F.array_join(found, "|")
            ),
        )

    return let(F.coalesce(text, F.lit("")), of_text)


def _sections(fingerprint: Column) -> Column:
    return F.slice(F.split(fingerprint, r"\|"), 2, F.lit(2**30))


def _paragraphs(section: Column) -> Column:
    return F.slice(F.split(section, ";"), 2, F.lit(2**30))


def _at_level(fingerprint: Column, level: int) -> Column:
    """Sections as hash,pieces;hash,pieces... with the pieces of one level."""
    one = lambda p: F.concat_ws(",", F.split_part(p, F.lit(","), F.lit(1)), F.split_part(p, F.lit(","), F.lit(level + 2)))
    return F.transform(_sections(fingerprint), lambda s: F.array_join(F.transform(_paragraphs(s), one), ";"))


def likeness(a: Column, b: Column) -> Column:
    """Shared pieces of two fingerprints as a share of all (Dice); 1 for equal roots, null if either is null.

    Equal sections count whole, then equal paragraphs of the sections that differ, then equal pieces of
    the paragraphs that differ, each once however often it stands there.
    """

    def apart(s: Column, then) -> Column:
        """``then`` of what is equal in s.x and s.y, and of a struct x, y of the rest."""
        rest = F.struct(F.array_except(s["x"], s["y"]).alias("x"), F.array_except(s["y"], s["x"]).alias("y"))
        return let(F.struct(F.array_intersect(s["x"], s["y"]).alias("same"), rest.alias("rest")), lambda r: then(r["same"], r["rest"]))

    def down(rest: Column, of) -> Column:
        return F.struct(of(rest["x"]).alias("x"), of(rest["y"]).alias("y"))

    def paragraphs(sections: Column) -> Column:
        return F.flatten(F.transform(sections, lambda s: F.split(s, ";")))

    def pieces(found: Column) -> Column:
        return F.flatten(F.transform(found, lambda p: F.filter(F.split(F.split_part(p, F.lit(","), F.lit(2)), r"\."), lambda x: x != "")))

    def share(n: Column, same: Column, rest: Column) -> Column:
        shared = 2.0 * (n + F.size(same))
        return F.when(shared > 0, shared / (shared + F.size(rest["x"]) + F.size(rest["y"]))).otherwise(0.0)

    def at(level: int) -> Column:
        return let(
            F.struct(_at_level(a, level).alias("x"), _at_level(b, level).alias("y")),
            lambda s: apart(s, lambda same1, rest1: let(
                down(rest1, paragraphs),
                lambda p: apart(p, lambda same2, rest2: let(
                    down(rest2, pieces),
                    lambda q: apart(q, lambda same3, rest3: share(F.size(pieces(paragraphs(same1))) + F.size(pieces(same2)), same3, rest3)),
                )),
            )),
        )

    has = lambda x, name: F.substring_index(F.substring(x, 66, len(LEVELS) + 1), "|", 1).contains(name)
    out = F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0))
    for level in range(len(LEVELS)):
        out = out.when(has(a, LEVELS[level][0]) & has(b, LEVELS[level][0]), at(level))
    return F.when(a.isNotNull() & b.isNotNull(), out.otherwise(0.0))


def changed(a: Column, b: Column, level: str = "paragraphs") -> Column:
    """0-based places of the sections or paragraphs of ``b`` that ``a`` doesn't hold."""
    name = {"sections": _sections, "paragraphs": lambda c: F.flatten(F.transform(_sections(c), _paragraphs))}[level]
    x, y = (F.transform(name(c), lambda s: F.substring(s, 1, 22)) for c in (a, b))
    return let(x, lambda held: F.filter(F.transform(y, lambda h, i: F.when(~F.array_contains(held, h), i)), lambda i: i.isNotNull()))


def _firsts(rows: DataFrame, buckets: int) -> list[int]:
    """The least key of each bucket: at most ``buckets`` numbers, near quantiles of the keys."""
    keys = rows.select("_k")
    share = [i / buckets for i in range(buckets)]
    cuts = keys.agg(F.percentile_approx("_k", share, 20 * buckets)).first()[0]
    if not cuts:
        return []
    bounds = sorted(set(cuts))
    return sorted(x[0] for x in keys.groupBy(_place(F.col("_k"), bounds).alias("b")).agg(F.min("_k")).select("min(_k)").collect())


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above the key, by two short scans."""
    step = max(1, math.isqrt(len(bounds)))
    coarse, fine = constant(bounds[::step], "bigint"), constant(bounds, "bigint")
    rough = F.size(F.filter(coarse, lambda x: x <= key))
    near = F.slice(fine, F.greatest(rough - 1, F.lit(0)) * step + 1, step)
    return F.greatest(rough - 1, F.lit(0)) * step + F.size(F.filter(near, lambda x: x <= key))


def with_next(docs: DataFrame, doc_id: str, text: str, carried: dict | None = None) -> DataFrame:
    """doc_id, text and the carried columns of each row, and ``next``: text and columns of the next row.

    The order is by doc_id (null first), then text; the last row's next is the first. Rows are
    dealt once, in buckets of neighbouring ids between quantiles, with a copy of each bucket's
    first rows at the end of the bucket before; so no task holds more than a few buckets.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST)).alias("_k"),
    )
    spark = docs.sparkSession
    buckets = BUCKETS_A_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    firsts = _firsts(rows, buckets) or [_LEAST]
    bucket = (_place(F.col("_k"), firsts) - 1).cast("int")
    rows = rows.withColumn("_b", bucket)
    own = F.struct(F.col("_b").alias("b"), F.lit(False).alias("copy"))
    before = F.struct(((F.col("_b") + len(firsts) - 1) % len(firsts)).alias("b"), F.lit(True).alias("copy"))
    is_first = F.element_at(constant(firsts, "bigint"), F.col("_b") + 1) == F.col("_k")
    rows = rows.select("doc_id", "text", "_k", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("_at"))
    rows = rows.select("doc_id", "text", "_k", "_at.b", "_at.copy").repartition("b")
    for name, column in (carried or {}).items():
        rows = rows.withColumn(name, column)
    order = Window.partitionBy("b").orderBy("copy", "_k", "text")
    rows = rows.withColumn("next", F.lead(F.struct("text", *(carried or {}))).over(order))
    return rows.where(~F.col("copy")).drop("_k", "b", "copy")


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, which ends with the start of the next document.

    Null counts as the empty text, whose edit is itself. A null doc_id stands before all others.
    Rows that repeat a doc_id follow each other by text; repeated rows are each other's next.
    Other columns are not read; an empty table gives an empty result. Texts are taken whole.
    """
    rows = with_next(docs, doc_id, text, {"fingerprint": fingerprint(F.col("text"))})
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.col("n_chars").cast("int") - half), F.col("next.text").substr(F.lit(1), half)))
    rows = rows.select("doc_id", "n_chars", "edited", "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"))
    rows = rows.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
