"""Secret scans: patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order Markov models over one alphabet are trained from labelled samples by counting
pairs of characters, with add-one smoothing. A token whose mean log-likelihood ratio (random over
ordinary, a character) is above a threshold is taken for a secret. All of it is DataFrame
operations; the only thing collected is the table of pairs, whose size is that of the alphabet
squared.

Labelled are strings as keys are made (hex, base64, base32 and other alphabets) and what stands in
ordinary texts at the same lengths: identifiers, paths, dates and numbers, long words of several
languages, rules of repeated marks. The tests give precision and recall on other ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.texts import constant, let, running, running_sums

# The base patterns.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 characters and more: a run holds one such match at most
HEX = "[0-9a-f]{24,}"  # as [0-9a-f]+ of 24 and more
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGNED = 6

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=.-"
#: What is scored: runs of 20 characters, or of 16 with a digit among the first ones; a dot ends none.
TOKEN = "(?:(?=[A-Za-z+/_=.-]{0,63}[0-9])[A-Za-z0-9+/_=.-]{15,}|[A-Za-z0-9+/_=.-]{19,})[A-Za-z0-9+/_=-]"
#: Nats a character by which a token must look random rather than ordinary, and how much more for each character under 20.
THRESHOLD, SHORT, FOR_SHORT = 0.35, 20, 0.1

# Words that identifiers are made of, for the ordinary samples.
IDENTIFIER_WORDS = (
    "account action address agent array audit batch block buffer build cache call channel check class client cluster code column "
    "command config connect content context control count create data date debug default delete device display document domain "
    "download driver element email enable engine entry error event export factory field file filter folder format frame function "
    "group handler header height helper history host image import index input insert instance item job key label language layer "
    "length level library limit line link list load local location logger manager market match member memory menu message method "
    "metric model module monitor name network node notification number object offset option order output owner package page panel "
    "parameter parent parser path pattern payment permission pipeline player plugin point policy port position prefix process "
    "product profile project property protocol provider proxy query queue range record region register report request resource "
    "response result role route rule runtime sample schedule schema scope screen script search section select sender sequence "
    "server service session setting shape share shop signal size snapshot socket source stage start state status storage store "
    "stream string style subject submit summary support switch symbol system table target task team template test text thread "
    "time title total track transaction transfer transport tree trigger type unit update upload user value variable vector version "
    "video view visible volume wallet warehouse weight widget width window worker wrapper writer zone"
).split()


# Syllables of which long ordinary words of several languages are made.
SYLLABLES = (
    "ab al an ar as auf aus ba be bel ber bre ca cal cam car ci con cu da de del der des di do dor du ein el en ent er es eur fa fer fi "
    "for fra ga ge gen ger gra ha heit her ho il in ing ion is ja ka kal keit ko la lan le len li lich ling lo lu ma man me men ment mi "
    "mit mo mus na ne nel ni no nor nu o ob on or ous pa pe per pi po por pre pro qua que ra re ren res ri ro ru sa sche schaft se sen "
    "ser si sion so sol sta ste ster stra su ta te tel ten ter ti tion to tor tra tri tu ul un und ung ur us va ve ver vi vo vor wa we "
    "wer wir wo za ze zen zi zu zung"
).split()


def labelled_samples(spark: SparkSession, rows: int = 3000) -> DataFrame:
    """(token, random): strings of hashes in the alphabets of keys; identifiers, paths, numbers, rules and long words.

    Both kinds are made by rule from row numbers, so they are the same everywhere.
    """
    n = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample "), F.col("id").cast("string")).cast("binary"), 256)
    sixty_four = F.base64(F.unhex(digest))
    kinds = F.array(F.upper(F.substring(digest, 5, 40)), F.translate(F.substring(sixty_four, 1, 43), "+/", "-_"), F.lower(F.substring(F.regexp_replace(sixty_four, "[^A-Za-z0-9]", ""), 1, 32)), F.substring(digest, 1, 40), F.substring(sixty_four, 1, 43), F.substring(F.regexp_replace(sixty_four, "[^A-Za-z0-9]", ""), 1, 36), F.concat(F.lit("AKIA"), F.substring(F.upper(F.regexp_replace(sixty_four, "[^A-Za-z0-9]", "")), 1, 16)), F.concat_ws(".", *[F.substring(F.translate(sixty_four, "+/", "-_"), a, n) for a, n in ((1, 10), (11, 14), (25, 18))]))
    random = n.select(F.explode(kinds).alias("token"), F.lit(True).alias("random"))
    words = constant(IDENTIFIER_WORDS, "string")
    word = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(IDENTIFIER_WORDS))) + 1).cast("int"))
    four = [word(k) for k in range(4)]
    number = F.pmod(F.col("id"), F.lit(100)).cast("string")
    year, day = (F.pmod(F.col("id"), F.lit(60)) + 1970).cast("string"), F.lpad((F.pmod(F.col("id"), F.lit(31)) + 1).cast("string"), 2, "0")
    long_number = F.lpad(F.pmod(F.xxhash64("id"), F.lit(10**15)).cast("string"), 20, "1234567890")
    syllables = constant(SYLLABLES, "string")
    long_word = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.element_at(syllables, (F.pmod(F.xxhash64("id", k), F.lit(len(SYLLABLES))) + 1).cast("int"))), "")
    shapes = F.array(
        F.concat_ws("_", *four), F.concat_ws("-", *four), F.concat(four[0], *[F.initcap(w) for w in four[1:]]), F.concat(*[F.initcap(w) for w in four]),
        F.concat_ws("_", *[F.upper(w) for w in four]), F.concat_ws("/", *four), F.concat(*four), F.concat(F.concat_ws("_", *four[:3]), number), F.upper(F.concat(*four)),
        F.concat(F.lit("/"), F.concat_ws("/", four[0], year, day, F.concat_ws("-", *four[1:]))), F.concat(F.concat_ws("/", *four[:3]), F.lit("_v"), number, F.lit("/")),
        F.concat_ws("-", F.lit("report"), year, day, four[0]), F.concat(F.lit("id="), long_number), long_number, F.concat(four[0], F.repeat(F.lit("="), 24)), F.repeat(F.element_at(F.array(*map(F.lit, "=-_+/axX0")), (F.pmod(F.col("id"), F.lit(9)) + 1).cast("int")), (F.pmod(F.col("id"), F.lit(23)) + 20).cast("int")),
        long_word, F.initcap(long_word), F.upper(long_word),
        F.concat_ws(".", *four), F.concat(four[0], number, F.lit("."), four[1], F.lit(".example.com")), F.concat(F.concat_ws("_", *four[:3]), F.lit(".py")),
        F.concat(F.concat_ws("-", *four[:2]), F.lit("-1."), number, F.lit(".0.tar")), F.concat(F.substring(long_number, 1, 9), F.lit("."), F.substring(long_number, 10, 9)),
        F.concat_ws(".", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(256)).cast("string") for k in range(8)]), F.concat(long_word, F.lit("."), F.initcap(long_word)),
    )
    return random.unionByName(n.select(F.explode(shapes).alias("token"), F.lit(False).alias("random")))


@dataclass(frozen=True)
class PairModel:
    """Log-likelihood ratio (random over ordinary) of each pair of characters, row by first character."""

    ratios: tuple[float, ...]

    def __post_init__(self):
        assert len(self.ratios) == len(ALPHABET) ** 2


def train(samples: DataFrame, token: str = "token", random: str = "random") -> PairModel:
    """Pair counts of both kinds of labelled tokens; rows with nulls and characters beyond the alphabet are left out."""
    t = F.col(token)
    pairs = samples.where(t.isNotNull() & F.col(random).isNotNull() & (F.length(t) > 1))
    at = F.explode(F.sequence(F.lit(1), F.length(t) - 1)).alias("at")
    pairs = pairs.select(t.alias("t"), F.col(random).alias("r"), at).select("r", F.col("t").substr(F.col("at"), F.lit(2)).alias("pair"))
    counts = pairs.groupBy("r", "pair").count().where(F.col("pair").rlike(f"^[{ALPHABET[:-1]}-]{{2}}$")).collect()  # at most 2 * 67 ** 2 rows
    n = len(ALPHABET)
    table = np.ones((2, n, n)) * 0.5
    for r, pair, k in counts:
        table[int(r), ALPHABET.index(pair[0]), ALPHABET.index(pair[1])] += k
    p = table / table.sum(2, keepdims=True)
    return PairModel(tuple(np.round(np.log(p[1]) - np.log(p[0]), 4).ravel().tolist()))


def randomness(token: Column, model: PairModel) -> Column:
    """Mean log-likelihood ratio a pair of a token of characters of the alphabet (0 for shorter ones)."""
    table, n = constant(model.ratios, "double"), len(ALPHABET)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def mean(c: Column) -> Column:
        pairs = F.sequence(F.lit(1), F.size(c) - 1)
        total = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.element_at(table, F.element_at(c, i) * n + F.element_at(c, i + 1) + 1))
        return F.when(F.size(c) > 1, total / F.greatest(F.size(c) - 1, F.lit(1))).otherwise(0.0)

    # instr takes the column's text; characters are looked up one by one
    return let(codes, mean)


def least_randomness(token: Column, threshold: float = THRESHOLD) -> Column:
    """What a token's randomness must be above: more for short ones, whose means vary more."""
    return F.lit(threshold) + FOR_SHORT * F.greatest(F.lit(SHORT) - F.length(token), F.lit(0))


SPAN = "struct<start:int,end:int,kind:string,token:string>"


def spans_of(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost matches that don't overlap, as structs of start, end (code points), kind and token, in order."""
    none = F.array().cast(f"array<{SPAN}>")
    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))

    def place(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda token, i: (F.length(F.element_at(x["gaps"], i + 1)) + F.length(token)).cast("long"))

        def spans(before: Column) -> Column:
            start = lambda i: (F.element_at(before, i + 1) + F.length(F.element_at(x["gaps"], i + 1))).cast("int")
            one = lambda token, i: F.struct(start(i).alias("start"), (start(i) + F.length(token)).alias("end"), F.lit(kind).alias("kind"), token.alias("token"))
            return F.transform(x["found"], one)

        return let(running_sums(lengths), spans)

    return F.when(text.rlike(pattern), let(pair, place)).otherwise(none)


#: From so many spans on, a text is taken apart into its characters to cut it.
MANY_SPANS = 64


def replaced(text: Column, spans: Column, fill) -> Column:
    """The text with ``fill(start, end)`` for each span (in order of start), less what an earlier one took."""

    def cut(x: Column) -> Column:
        def whole(before: Column) -> Column:
            def pieces(piece) -> Column:
                at = lambda i: F.element_at(before, i + 1).cast("int")
                new = lambda s, i: F.when(
                    s["end"] > at(i),
                    F.concat(F.when(s["start"] >= at(i), piece(at(i), s["start"] - at(i))).otherwise(""), fill(F.greatest(s["start"], at(i)), s["end"], s["start"] >= at(i))),
                ).otherwise("")
                last = F.greatest(F.element_at(before, F.size(before)).cast("int"), F.element_at(x, F.size(x))["end"])
                return F.concat(F.array_join(F.transform(x, new), ""), piece(last, F.length(text)))

            by_place = pieces(lambda a, n: text.substr(a + 1, n))
            by_character = let(F.split(text, ""), lambda c: pieces(lambda a, n: F.array_join(F.slice(c, a + 1, n), "")))
            return F.when(F.size(x) < MANY_SPANS, by_place).otherwise(by_character)

        zero = F.lit(0).cast("long")
        return let(running(F.transform(x, lambda s: s["end"].cast("long")), lambda a, e: F.greatest(a, e), zero), whole)

    return F.when(F.size(spans) > 0, let(spans, cut)).otherwise(text)


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each span, overlapping ones together, replaced by a mark."""
    return replaced(text, spans, lambda start, end, first: F.when(first, F.lit(mark)).otherwise(""))


def found_spans(text: Column, model: PairModel, threshold: float = THRESHOLD) -> Column:
    """A struct of ``base`` and ``added``: spans by the patterns, and by the models in the text between."""
    size = lambda s: F.length(F.regexp_extract(s["token"], ASSIGN, 2))
    assign = F.filter(spans_of(text, ASSIGN, "assign"), lambda s: size(s) >= LEAST_ASSIGNED)
    base = by_place(F.concat(assign, spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex")))

    def with_added(plain: Column) -> Column:
        rest = replaced(text, plain, lambda start, end, first: F.repeat(F.lit(" "), end - start))
        added = let(rest, lambda r: F.filter(spans_of(r, TOKEN, "random"), lambda s: randomness(s["token"], model) > least_randomness(s["token"], threshold)))
        return F.struct(plain.alias("base"), added.alias("added"))

    return let(base, with_added)


def scan_secrets(docs: DataFrame, model: PairModel, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, ``base`` and ``added`` of each row: spans by the patterns, and by the models elsewhere.

    A span is (start, end, kind, token), offsets in code points, ends exclusive. Null counts as
    the empty text, without spans. A null doc_id stays null; repeated rows get equal results; an
    empty table gives an empty result. Whole texts are scanned, in time that grows with their
    length; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("scanned"))
    return rows.withColumn("found", found_spans(F.col("scanned"), model, threshold)).select("doc_id", "scanned", "found.base", "found.added")


def redacted_documents(docs: DataFrame, model: PairModel, text: str = "text", n_chars: str = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every secret of the text replaced by a mark, and its code points in n_chars.

    All rows stay, with all their columns, whatever the names. Null texts stay null, as does their
    n_chars; texts without secrets, empty ones among them, stay as they are.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    plain = F.col("row").getField(text)
    rows = docs.select(row.alias("row"))
    rows = rows.withColumn("found", found_spans(F.coalesce(plain, F.lit("")), model, threshold))
    rows = rows.withColumn("clean", redacted(plain, all_spans(F.col("found.base"), F.col("found.added"))))
    new = {text: F.col("clean"), n_chars: F.length("clean").cast("long")}
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def by_place(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    key = lambda s: F.struct(s["start"].alias("start"), F.array_position(constant(KINDS, "string"), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind"), s["token"].alias("token"))
    return F.transform(F.array_sort(F.transform(spans, key)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["token"].alias("token")))


def named_spans(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(base: Column, added: Column) -> Column:
    """Both, by start; they don't overlap, so no ties arise between them."""
    return by_place(F.concat(base, added))
