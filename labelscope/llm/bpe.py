"""Byte-pair encoding of whole texts, and decoding of ids, by a vocabulary of words with ends.

The vocabulary file is a parameter (JSON with ``model.vocab``, ``model.merges`` and a
word-end suffix); it is opened in the task, never shipped with the job.

A word is merged in a contiguous rank array: the ids of the parts and the rank of each
adjacent pair, with the id it gives, lie in two flat lists; the least rank is found by a scan,
its second part is deleted and the two neighbouring ranks are looked up anew. Pairs of ids are
numbers, so no string is cut or hashed. That is quadratic in the
word, so words of more than ``SHORT`` symbols take a heap over linked parts, which
merges in the same order (least rank first, leftmost of equals).
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.llm.common import by_slices

SHORT = 128
_NONE = 1 << 60
_CACHED_WORDS = 100_000  # per task; beyond, only words met again since then are kept

# What the vocabulary's pre-tokenizer splits into.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for lower-case ASCII, where Python's own engine takes half the time.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    letters, extra = [], 256
    for byte in range(256):
        letters.append(chr(byte if byte in plain else extra))
        extra += byte not in plain
    return letters


def merged_ids(ids: list[int], merges: dict[int, int], bits: int) -> list[int]:
    """``ids`` after all merges, in place: ``merges`` has rank and new id of each pair, ``bits`` an id."""
    get, mask = merges.get, (1 << bits) - 1
    # adjacent[i]: rank of joining part i and the next, and what they give.
    adjacent = [get(a << bits | b, _NONE) for a, b in zip(ids, ids[1:], strict=False)]
    while adjacent and (least := min(adjacent)) != _NONE:
        at = adjacent.index(least)
        ids[at] = joined = least & mask
        del ids[at + 1], adjacent[at]
        if at < len(adjacent):
            adjacent[at] = get(joined << bits | ids[at + 1], _NONE)
        if at:
            adjacent[at - 1] = get(ids[at - 1] << bits | joined, _NONE)
    return ids


def merge_short(word: str, bounds: list[int], ranks: dict) -> list[str]:
    """Parts of ``word``, first cut at ``bounds``, after all merges, by a rank array."""
    get, bounds = ranks.get, list(bounds)
    parts = [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
    # adjacent[i]: rank of joining part i and the next; the last part has none.
    adjacent = [get(pair, _NONE) for pair in zip(parts, parts[1:], strict=False)]
    adjacent.append(_NONE)
    while (least := min(adjacent)) != _NONE:
        at = adjacent.index(least)
        del bounds[at + 1], adjacent[at + 1]
        start, end = bounds[at], bounds[at + 1]
        joined = word[start:end]
        adjacent[at] = get((joined, word[end:bounds[at + 2]]), _NONE) if at + 2 < len(bounds) else _NONE
        if at:
            adjacent[at - 1] = get((word[bounds[at - 1]:start], joined), _NONE)
    return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def merge_long(word: str, bounds: list[int], ranks: dict) -> list[str]:
    """The same parts in n log n steps."""
    n = len(bounds) - 1
    start, end = list(bounds[:-1]), list(bounds[1:])
    after, before, alive = [*range(1, n), -1], list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j >= 0:
            rank = ranks.get((word[start[i]:end[i]], word[start[j]:end[j]]))
            if rank is not None:
                heapq.heappush(heap, (rank, start[i], i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        _, _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j < 0 or end[j] != stop or ranks.get((word[start[i]:end[i]], word[start[j]:end[j]])) is None:
            continue
        alive[j], end[i], after[i] = False, stop, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [word[start[i]:end[i]] for i in range(n) if alive[i]]


class Codec:
    """Encodes and decodes with one vocabulary file; built once per task."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.path, model = path, spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = byte_letters()
        self.bits, vocab = max(self.vocab.values()).bit_length(), self.vocab
        self.merges = {
            vocab[a] << self.bits | vocab[b]: rank << self.bits | vocab[a + b]
            for (a, b), rank in self.ranks.items() if a in vocab and b in vocab and a + b in vocab
        }
        self.inner = [vocab.get(c) for c in self.letters]
        self.last = [vocab.get(c + self.suffix) for c in self.letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.pieces = regex.compile(_PIECES)
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.known: set[str] = set(map(chr, range(128)))
        self.library = None

    def word_ids(self, piece: str) -> tuple[int, ...]:
        ids = self.words.get(piece)
        if ids is None and (ids := self.older.get(piece)) is not None:
            self.words[piece] = ids
        if ids is None:
            data = piece.encode()
            parts = [*map(self.inner.__getitem__, data[:-1]), self.last[data[-1]]]
            if len(data) > SHORT or None in parts:
                return self._by_strings(data)
            ids = self.words[piece] = tuple(merged_ids(parts, self.merges, self.bits))
        return ids

    def _by_strings(self, data: bytes) -> tuple[int, ...]:
        """Long words, and such with bytes that are no tokens of their own."""
        word = "".join([self.letters[b] for b in data])
        bounds = [*range(len(word)), len(word) + len(self.suffix)]
        merge = merge_short if len(word) <= SHORT else merge_long
        return tuple([self.vocab[p] for p in merge(word + self.suffix, bounds, self.ranks)])

    def split(self, text: str) -> list[str]:
        """Normalised pieces of a text without special tokens."""
        if text.isascii():
            return _ASCII_PIECES.findall(text.lower())
        if not self.known.issuperset(text):
            new = set(text) - self.known
            if any(unicodedata.category(c) == "Cn" for c in new):
                return self._by_library(text)
            self.known |= new
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # no rule for a sigma at the end of a word
            text = text.replace("Σ", "σ")
        return self.pieces.findall(text.lower())

    def _by_library(self, text: str) -> list[str]:
        """Characters newer than this Python's tables: the library's own normaliser and split."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        parts = self.cut.split(text) if "<|" in text else [text]
        ids: list[int] = []
        if len(self.words) >= _CACHED_WORDS:
            self.words, self.older = {}, self.words
        words = self.words
        for part in parts:
            if part in self.special:
                ids.append(self.special[part])
                continue
            pieces = self.split(part)
            for p in set(pieces).difference(words):
                self.word_ids(p)
            try:
                ids.extend(chain.from_iterable(map(words.__getitem__, pieces)))
            except KeyError:  # words too long to keep
                ids.extend(chain.from_iterable(map(self.word_ids, pieces)))
        return ids

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by blanks, special ones included."""
        return " ".join(map(self.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Ids of every whole text, and with ``decoded`` the text that the ids decode to.

    Returns ``id_col``, ``ids`` array<int> and, if asked for, ``decoded`` string, one row per
    input row. A null or empty text has no ids and decodes to an empty text; texts of any
    length are encoded whole; repeated rows are repeated; null ids stay; an empty table
    gives none. Other columns, whatever their names, are left behind. The strings of
    special tokens inside a text become those tokens. Nothing is shuffled.
    """
    kind = docs.schema[id_col].dataType

    def convert(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [codec.encode(t) for t in batch.column(1).to_pylist()]
        columns = [batch.column(0), pa.array(ids, pa.list_(pa.int32()))]
        if decoded:
            columns.append(pa.array(map(codec.decode, ids), pa.string(), size=len(ids)))
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["id", "ids", *["decoded"] * decoded]

    def run(batches):
        codec = Codec(path)
        yield from by_slices(lambda b: convert(codec, b), "text", 4 << 20)(batches)

    schema = f"id {kind.simpleString()}, ids array<int>" + ", decoded string" * decoded
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and ``decoded`` of every row's ids; null ids count as none."""
    kind = encoded.schema[id_col].dataType

    def run(batches):
        codec = Codec(path)

        def convert(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "decoded"])

        yield from by_slices(convert, "ids", 4 << 20)(batches)

    rows = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, f"id {kind.simpleString()}, decoded string").withColumnRenamed("id", id_col)


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the decimal ids joined by blanks."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256)
