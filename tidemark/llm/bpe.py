"""BPE encoding and decoding by merge rank, of texts as a word-end vocabulary defines it.

A word is a doubly linked list of symbols. Every adjacent pair that has a merge rank lies in a priority queue; the
lowest rank (then the leftmost) is merged, the new neighbours' pairs are queued, and entries whose symbols have changed
meanwhile are skipped when they come up. Decoding puts the tokens' vocabulary strings together.

Rows are independent, so encoding is one Arrow pass without a shuffle; the vocabulary is read where Python runs the
task, from a path given as a parameter, or shipped with the task as a broadcast of its fixed size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Words whose tokens a Python worker remembers. It bounds memory only; a forgotten word is encoded again.
REMEMBERED_WORDS = 150_000
#: Rows whose tokens a worker holds at a time.
ROWS = 256
#: Longer words are not remembered, so that the memory has a bound in bytes too.
REMEMBERED_LENGTH = 64

# White space and contractions of the vocabulary's splitting rule.
WHITE_SPACE = "\t-\r \x85\xa0  -     　"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_BEYOND = re.compile("[\U00010000-\U0010ffff]")


@cache
def _classes(last: int) -> tuple[str, str]:
    """Character classes of the letters and the numbers up to code point ``last``, as ranges for ``re``."""
    found: dict[str, list[list[int]]] = {"L": [], "N": []}
    for point in range(last + 1):
        kind = unicodedata.category(chr(point))[0]
        if kind in found:
            ranges = found[kind]
            if ranges and ranges[-1][1] == point - 1:
                ranges[-1][1] = point
            else:
                ranges.append([point, point])
    spell = lambda ranges: "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)
    return spell(found["L"]), spell(found["N"])


@cache
def _splitter(last: int) -> re.Pattern:
    letters, numbers = _classes(last)
    contractions = "|".join(CONTRACTIONS)
    return re.compile(f"{contractions}|[{letters}]+|[{numbers}]|[^{WHITE_SPACE}{letters}{numbers}]+")


@cache
def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    printable = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """A vocabulary: merges by rank, token ids, special tokens."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # By both symbols' ids: a merge's rank; by rank: the id of what it makes.
        self.ranks = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        letters = _byte_letters()
        self.first = [self.ids.get(c) for c in letters]
        self.last = [self.ids.get(c + self.end) for c in letters]
        self.incomplete = None in self.first or None in self.last
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.strings: dict[int, str] = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.remembered: dict[str, tuple[int, ...]] = {}

    def word(self, word: str) -> tuple[str, str, int]:
        """The word's ids and its tokens' strings, each joined by spaces, and their number."""
        known = self.remembered.get(word)
        if known is not None:
            return known
        ids = self._merge(word.encode("utf-8"))
        found = " ".join(map(str, ids)), " ".join([self.strings[i] for i in ids]), len(ids)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self.remembered) >= REMEMBERED_WORDS:
                self.remembered.clear()
            self.remembered[word] = found
        return found

    def _merge(self, word: bytes) -> list[int]:
        first = self.first
        symbols = [first[b] for b in word]
        symbols[-1] = self.last[word[-1]]
        if None in symbols:  # bytes that the vocabulary lacks have no token
            symbols = [s for s in symbols if s is not None]
        size = len(symbols)
        if size < 2:
            return symbols
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        rank_of, merged, push, pop = self.ranks.get, self.merged, heapq.heappush, heapq.heappop
        # The rank of the pair that begins at each place by now; -1 for none.
        pair = [rank_of(a << 32 | b, -1) for a, b in zip(symbols, symbols[1:])]
        pair.append(-1)
        queue = [rank << 32 | i for i, rank in enumerate(pair) if rank >= 0]
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            rank = entry >> 32
            if pair[i] != rank:  # stale: one of its symbols has been merged meanwhile
                continue
            j = after[i]
            k = after[i] = after[j]
            symbol = symbols[i] = merged[rank]
            symbols[j] = pair[j] = -1
            if k < size:
                before[k] = i
                rank = pair[i] = rank_of(symbol << 32 | symbols[k], -1)
                if rank >= 0:
                    push(queue, rank << 32 | i)
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                rank = pair[h] = rank_of(symbols[h] << 32 | symbol, -1)
                if rank >= 0:
                    push(queue, rank << 32 | h)
        return [s for s in symbols if s >= 0]

    def pieces(self, text: str | None) -> list[tuple[str, str, int]]:
        """What ``word`` gives for each word of the whole text in turn, and alike for special tokens standing in it."""
        found: list[tuple[str, str, int]] = []
        if not text:
            return found
        parts = self.special_pattern.split(text) if self.special_pattern else [text]
        known = self.remembered.get
        for n, part in enumerate(parts):
            if n % 2:
                found.append((str(self.special[part]), part, 1))
            elif part:
                found += [known(word) or self.word(word) for word in self.words(part)]
        return [p for p in found if p[2]] if self.incomplete else found

    def encode(self, text: str | None) -> list[int]:
        """Token ids of the whole text; none for null. Special tokens' strings become their ids, nothing is added."""
        return [int(i) for ids, _, _ in self.pieces(text) for i in ids.split(" ")]

    @staticmethod
    def words(part: str) -> list[str]:
        # Letter by letter: a capital sigma becomes the same small letter wherever it stands.
        spelled = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
        # Classes within the basic plane are bit maps for ``re``, wider ones are slow lists.
        return _splitter(sys.maxunicode if _BEYOND.search(spelled) else 0xFFFF).findall(spelled)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' strings, one space between them; special tokens are kept, unknown ids left out."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def definition(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``row`` (every input column), ``ids`` (array of int) and ``decoded`` of each document's whole text.

    ``vocabulary`` is the text of a vocabulary file. Rows are kept one for one: a null or empty text has no ids and
    decodes to the empty string; repeated rows are encoded each; an empty table gives an empty one.
    """
    return _with_tokens(docs, vocabulary, "ids array<int>, decoded string", _whole)


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``encode``, with SHA-256 digests in place of ids and text: ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    return _with_tokens(docs, vocabulary, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", _digest)


def _whole(bpe: WordBpe, text: str | None) -> tuple[list[int], str]:
    ids = bpe.encode(text)
    return ids, bpe.decode(ids)


def _digest(bpe: WordBpe, text: str | None) -> tuple[int, str, str]:
    # A token's string is what its id decodes to, so the joined strings are the decoded text.
    pieces = bpe.pieces(text)
    ids, strings, counts = zip(*pieces) if pieces else ((), (), ())
    return sum(counts), _sha(" ".join(ids)), _sha(" ".join(strings))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def _with_tokens(docs: DataFrame, vocabulary: str, columns: str, result) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.struct("*").alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, {columns}"
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shipped.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = [result(bpe, t.as_py()) for t in part.column("text")]
                kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
                arrays = [
                    pa.array([m[i] for m in made], type=kinds.get(name, pa.string())) for i, name in enumerate(names)
                ]
                yield pa.RecordBatch.from_arrays([part.column("row"), *arrays], names=["row", *names])
        # A worker that waits for other tasks holds no more than the vocabulary.
        bpe.remembered.clear()

    return rows.mapInArrow(run, schema)


_LOADED: dict[str, WordBpe] = {}


def _loaded(vocabulary: str) -> WordBpe:
    """One object for all tasks of a Python worker."""
    if vocabulary not in _LOADED:
        _LOADED.clear()
        _LOADED[vocabulary] = WordBpe(vocabulary)
    return _LOADED[vocabulary]
