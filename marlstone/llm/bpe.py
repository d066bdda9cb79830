"""BPE encoding and decoding with a public vocabulary, by a pair occurrence index.

A partition is taken on in slices of bounded size, so that memory is. The distinct words of a
slice that are not remembered from earlier ones are laid out as one array of symbols linked to
their neighbours. An index maps the rank of each mergeable pair to all its positions in it; the active ranks are applied in ascending order, each at all its positions at once,
and the lists of the pairs at either side of a merge are updated. A pair that a merge makes can
only be applied later, so this gives what merging each word on its own by least rank gives.

Which code points are letters and numbers, how they are lowered and which marks are put in order is asked of
the tokenizers library on the driver, as its Unicode tables are of other versions than those of Python and
of the regex module; only where they differ, texts are read another way.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.texts import give_back, map_rows

#: Bytes of text that are encoded at a time: the pair index takes a multiple of them.
SLICE_BYTES = 2_500_000
#: Unicode's White_Space, written out because the regex module's \s has more.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[{_WHITE}]+")


@dataclass(frozen=True)
class Characters:
    """What the library knows of code points; ranges are pairs of the first and the last, flat."""

    letters: tuple[int, ...]
    numbers: tuple[int, ...]
    lower: dict[int, str]  # of those that Python lowers otherwise
    marks: str  # that Python puts in order and the library doesn't


#: Code points that the library is asked about at a time, so that little memory is taken.
_BLOCK = 1 << 13


def _blocks() -> Iterator[list[int]]:
    """All code points but surrogates and the line feed, which parts them when the library is asked."""
    for a in range(0, 0x110000, _BLOCK):
        block = [c for c in range(a, a + _BLOCK) if c != 10 and not 0xD800 <= c <= 0xDFFF]
        if block:
            yield block


def _ranges(found: list[int]) -> tuple[int, ...]:
    """Sorted code points as the first and the last of each run."""
    at = np.array(found, np.int64)
    cuts = np.flatnonzero(np.diff(at) != 1)
    return tuple(np.stack([at[np.append(0, cuts + 1)], at[np.append(cuts, len(at) - 1)]], 1).ravel().tolist()) if len(at) else ()


@lru_cache(1)
def library_characters() -> Characters:
    """Asks the library about every code point, in some seconds and once a process."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    letters, numbers, lower, marks = [], [], {}, []
    kinds = [(pre_tokenizers.Split(Regex(name), "removed", invert=True), found) for name, found in ((r"\p{L}+", letters), (r"\p{N}+", numbers))]
    down, composed = normalizers.Lowercase(), normalizers.NFC()
    contexts = (("a", "\u0301"), ("", "\u0338"), ("a\u0345", ""), ("a", "\u0334\u0345"))  # of marks that go after or before others
    for block in _blocks():
        text = "".join(map(chr, block))
        for split, found in kinds:
            found += [ord(c) for piece, _ in split.pre_tokenize_str(text) for c in piece]
        lowered = down.normalize_str("\n".join(text)).split("\n")
        lower |= {c: x for c, x in zip(block, lowered) if chr(c).lower() != x}
        odd = set()
        for before, after in contexts:
            made = composed.normalize_str("\n".join(f"{before}{c}{after}" for c in text)).split("\n")
            odd |= {c for c, x in zip(text, made) if unicodedata.normalize("NFC", f"{before}{c}{after}") != x}
        marks += sorted(odd)
    out = Characters(_ranges(letters), _ranges(numbers), lower, "".join(marks))
    del letters, numbers, kinds
    give_back()
    return out


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(stand_in)) for b in range(256)]


@dataclass
class Vocabulary:
    """What a tokenizer file of the kind "BPE with word ends" holds, ready to ship to executors."""

    tokens: list[str]
    pairs: np.ndarray  # left id << 32 | right id, ascending
    ranks: np.ndarray  # of ``pairs``
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    inner: np.ndarray  # id of each byte inside a word and at its end
    final: np.ndarray
    words: str  # pattern of a word
    characters: Characters
    special: dict[str, int] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> "Vocabulary":
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: only BPE vocabularies with an end-of-word suffix are read")
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] or spec["post_processor"]:
            raise ValueError(f"{path}: its normalizer or decoder is another")
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
        for token, i in [*vocab.items(), *special.items()]:
            tokens[i] = token
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        pairs = left << 32 | right
        order = np.argsort(pairs, kind="stable")
        letters = byte_alphabet()
        inner, final = (np.array([vocab[c + e] for c in letters], np.int64) for e in ("", end))
        words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace("\\s", _WHITE)
        return cls(tokens, pairs[order], order.astype(np.int64), left, right, made, inner, final, words, library_characters(), special)


class Places(dict):
    """Numbers strings as they are first asked for; ``fresh`` lists these."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self.fresh.append(key)
        value = self[key] = len(self)
        return value


def _pairs(ranges: tuple[int, ...]) -> list[tuple[int, int]]:
    return list(zip(ranges[::2], ranges[1::2]))


def stand_ins(characters: Characters) -> dict[int, int]:
    """One of the library's kind for each code point that the regex module takes for another kind: a letter, a digit or a mark.

    Words are cut in the text with stand-ins, which is as long, and taken from the text itself.
    """
    kind = np.zeros(0x110000, np.int8)
    for block in _blocks():
        text = "".join(map(chr, block))
        for number, name in ((1, r"\p{L}+"), (2, r"\p{N}+")):
            for m in regex.finditer(name, text):
                kind[[ord(c) for c in m[0]]] = number
    known = np.zeros(0x110000, np.int8)
    for number, ranges in ((1, characters.letters), (2, characters.numbers)):
        for a, b in _pairs(ranges):
            known[a : b + 1] = number
    known[0xD800:0xE000] = 0
    return {int(c): ord("!a0"[known[c]]) for c in np.flatnonzero(kind != known)}


class PairIndexEncoder:
    """Encodes words, a partition's at a time, and remembers at most ``most`` of them."""

    def __init__(self, vocabulary: Vocabulary, most: int = 60_000):
        self.v, self.most = vocabulary, most
        self._pattern = regex.compile(vocabulary.words + "|\n")
        self._lower = {c: x for c, x in vocabulary.characters.lower.items()}
        self._lowered_apart = re.compile(f"[{re.escape(''.join(map(chr, self._lower)))}]") if self._lower else None
        marks = vocabulary.characters.marks
        self._marks = re.compile(f"([{re.escape(marks)}])") if marks else None
        self._stand_in = stand_ins(vocabulary.characters)
        self._other = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _pairs(_ranges(sorted(self._stand_in)))) + "]") if self._stand_in else None
        self._special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self._reset()

    def _reset(self) -> None:
        self.place = Places()  # of a piece in starts, and so of its ids
        self.ids, self.starts = np.empty(0, np.int64), np.zeros(1, np.int64)

    # -- text to pieces between white space, these to words --

    def pieces(self, text: str | None) -> list[str]:
        """What stands between white space and special tokens, and these; no word goes beyond it."""
        if not text:
            return []
        if self._special is not None and self._special.search(text):
            return [x for i, part in enumerate(self._special.split(text)) for x in ([part] if i % 2 else self._parted(part))]
        return self._parted(text)

    @staticmethod
    def _parted(text: str) -> list[str]:
        # str.split() takes four separators as white space that Unicode's White_Space has not
        return _SPLIT.split(text) if _SEPARATORS.search(text) else text.split()

    def words(self, pieces: list[str]) -> list[str]:
        """Words of all pieces, with a line feed after each piece.

        NFC, then each character's own lower case (a final sigma has no form of its own); neither
        acts across the line feeds, which no piece has.
        """
        text = "\n".join(pieces) + "\n"
        if text.isascii():
            return self._pattern.findall(text.lower())
        text = self._lowered(self._composed(text).replace("Σ", "σ"))
        if self._other is None or not self._other.search(text):
            return self._pattern.findall(text)
        return [text[m.start() : m.end()] for m in self._pattern.finditer(text.translate(self._stand_in))]

    def _composed(self, text: str) -> str:
        """NFC, in which marks that the library doesn't know stay where they are and part what is around them."""
        if self._marks is None or not self._marks.search(text):
            return unicodedata.normalize("NFC", text)
        return "".join(unicodedata.normalize("NFC", part) for part in self._marks.split(text))

    def _lowered(self, text: str) -> str:
        if self._lowered_apart is None or not self._lowered_apart.search(text):
            return text.lower()
        out, at = [], 0
        for m in self._lowered_apart.finditer(text):
            out += [text[at : m.start()].lower(), self._lower[ord(m[0])]]
            at = m.end()
        return "".join(out) + text[at:].lower()

    # -- words to ids --

    def encode_words(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given distinct words, one after another, and where each word starts."""
        v = self.v
        raw = [w.encode("utf-8", "replace") for w in found]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.frombuffer(b"".join(raw), np.uint8)
        n = len(symbols)
        last = np.cumsum(sizes) - 1
        s = v.inner[symbols]
        s[last] = v.final[symbols[last]]
        # n stands for no neighbour; its own links point to itself
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[last] = n
        after[n] = n
        before = np.append(before[:n], n)
        before[np.append(0, last[:-1] + 1)] = n
        s = np.append(s, -1)
        alive = np.ones(n + 1, bool)
        alive[n] = False
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray) -> None:
            at = at[after[at] < n]
            key = s[at] << 32 | s[after[at]]
            spot = np.searchsorted(v.pairs, key)
            spot[spot == len(v.pairs)] = 0
            hit = v.pairs[spot] == key
            at, rank = at[hit], v.ranks[spot[hit]]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts)):
                if r in index:
                    index[r].append(positions)
                else:
                    index[r] = [positions]
                    heapq.heappush(active, r)

        add(np.arange(n))
        while active:
            rank = heapq.heappop(active)
            at = index.pop(rank)
            at = np.sort(np.concatenate(at))
            at = at[np.diff(at, prepend=-1) > 0]
            a, b = v.left[rank], v.right[rank]
            at = at[alive[at] & (s[at] == a)]
            at = at[s[after[at]] == b]
            if a == b and len(at) > 1:  # of a run of overlapping pairs every other one, from the left
                chained = np.append(False, after[at[:-1]] == at[1:])
                start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - start) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            s[at] = v.made[rank]
            alive[gone] = False
            after[at] = after[gone]
            before[after[at]] = at
            before[n] = n
            left = before[at]
            add(np.concatenate([at, left[left < n]]))
        kept = np.flatnonzero(alive)
        counts = np.add.reduceat(alive[:n].astype(np.int64), np.append(0, last[:-1] + 1)) if n else np.empty(0, np.int64)
        return s[kept], np.append(0, np.cumsum(counts))

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null is the empty text."""
        if len(self.place) > self.most:
            self._reset()
        split = (self.pieces(x) for x in texts)
        places = [np.fromiter(map(self.place.__getitem__, found), np.int64, len(found)) for found in split]
        self._learn(self.place.fresh)
        self.place.fresh = []
        return [_gather(self.ids, self.starts, at)[0] for at in places]

    def _learn(self, fresh: list[str]) -> None:
        """Encode pieces: their distinct words together, by the index."""
        if not fresh:
            return
        special = self.v.special
        named = [x for x in fresh if x in special] if any(x in self.place for x in special) else []
        found = self.words(["" if x in special else x for x in fresh] if named else fresh)
        spot = Places()
        spot["\n"] = -1
        at = np.fromiter(map(spot.__getitem__, found), np.int64, len(found))
        ends_of_pieces = np.flatnonzero(at < 0) - np.arange(len(fresh))
        at = at[at >= 0] - 1  # the line feed took the first number
        ids, starts = self.encode_words(spot.fresh) if spot.fresh else (np.empty(0, np.int64), np.zeros(1, np.int64))
        flat, ends = _gather(ids, starts, at)
        cuts = np.append(0, ends)[ends_of_pieces]
        if named:  # one id each, where they stand
            spots = np.array([i for i, x in enumerate(fresh) if x in special])
            flat = np.insert(flat, cuts[spots], [special[fresh[i]] for i in spots])
            cuts = cuts + np.searchsorted(spots, np.arange(len(fresh)), side="right")
        self.starts = np.append(self.starts, cuts + len(self.ids))
        self.ids = np.append(self.ids, flat)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces: these files name no decoder."""
        return " ".join(map(self.v.tokens.__getitem__, ids.tolist()))


def load(spark: SparkSession, path: str):
    """The vocabulary, read once on the driver and broadcast: a file of fixed size (a few MB)."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))


_ENCODERS: dict = {}


def _encoder(shared, path: str) -> PairIndexEncoder:
    """One encoder for each worker process, so that tasks after the first know most pieces."""
    if path not in _ENCODERS or _ENCODERS[path].v.tokens != shared.value.tokens:
        _ENCODERS.clear()
        _ENCODERS[path] = PairIndexEncoder(shared.value)
    return _ENCODERS[path]


def _gather(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids with the given numbers, one after another, and where each of them ends."""
    sizes = starts[at + 1] - starts[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(starts[at] - (ends - sizes), sizes)], ends


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False, packed: bool = False) -> DataFrame:
    """doc_id and ``ids`` of each row, with ``decoded`` also ``decoded_text``.

    ``ids`` is an array of int or, with ``packed``, the bytes of a token file: unsigned 32-bit
    integers, little-endian.

    Null and empty texts have no ids and decode to the empty text. Texts are taken whole; rows
    are independent, so repeated rows and ties change nothing. A null doc_id stays null. Other
    columns are not read. ``path`` is a tokenizer file on the driver.
    """
    shared = load(docs.sparkSession, path)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def make():
        encoder = _encoder(shared, path)

        def step(batch: pa.RecordBatch) -> dict:
            ids = encoder.encode_batch(batch.column("text").to_pylist())
            if packed:
                out = {"ids": [x.astype("<u4").tobytes() for x in ids]}
            else:
                offsets = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                out = {"ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))}
            return out | {"doc_id": batch.column("doc_id")} | ({"decoded_text": [encoder.decode(x) for x in ids]} if decoded else {})

        return step

    return map_rows(rows, f"doc_id long, ids {'binary' if packed else 'array<int>'}" + ", decoded_text string" * decoded, make, SLICE_BYTES)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded_text``, the tokens of ``ids`` joined by spaces; null ids give null."""
    shared = load(rows.sparkSession, path)

    @F.pandas_udf("string")
    def text_of(column):
        encoder = _encoder(shared, path)
        return column.map(lambda x: None if x is None else encoder.decode(np.asarray(x, np.int64)))

    return rows.withColumn("decoded_text", text_of(F.col(ids)))
