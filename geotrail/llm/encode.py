"""Problem 6: token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: a backtracking encoder. An Aho-Corasick automaton over all tokens gives, in one pass, the longest token at every
byte of a piece. Tokens are taken greedily; a token is kept only if it is compatible with the one before it, that is if
BPE itself would leave the boundary between them standing, and positions from which no end can be
reached are remembered and left by backtracking. The result equals that of applying the merges in order, in linear time.
Decoding uses one buffer of all tokens' bytes and an offset table.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the splitting pattern of this vocabulary's family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A vocabulary file is read by the driver and sent once to every executor; larger files are refused.
MOST_VOCABULARY_BYTES = 64 * 1024 * 1024


def default_vocabulary() -> str:
    """The path of the installed vocabulary file."""
    try:
        import public_tokenizers

        return str(public_tokenizers.path("byte_bpe_50k.json"))
    except ImportError:
        return "/opt/tokenizers/byte_bpe_50k.json"


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + n)] = b
    return letters


class Encoder:
    """Token ids of texts; ids are merge ranks, as the pair table needs."""

    #: Pieces kept in memory; the cache starts anew when it is full, which changes no result.
    MOST_CACHED, LONGEST_CACHED = 200_000, 64

    def __init__(self, vocabulary: bytes):
        import ahocorasick
        import regex

        model = json.loads(vocabulary)["model"]
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = {(ids[a], ids[b]): ids[a + b] for a, b in merges}
        size = max(ids.values()) + 1
        # A token falls back into the pair it was merged from; a single byte into itself.
        self.left, self.right = list(range(size)), list(range(size))
        for (a, b), t in reversed(self.pairs.items()):
            self.left[t], self.right[t] = a, b
        in_use = {*self.pairs.values(), *(i for t, i in ids.items() if len(t) == 1)}
        self.bytes = [b""] * size
        for t, i in ids.items():
            if i in in_use:
                self.bytes[i] = raw(t)
        self.length = [len(b) for b in self.bytes]
        by_bytes = {b: i for i, b in enumerate(self.bytes) if b}
        self.shorter = [-1] * size
        for b, i in by_bytes.items():
            for n in range(len(b) - 1, 0, -1):
                if b[:n] in by_bytes:
                    self.shorter[i] = by_bytes[b[:n]]
                    break
        self.automaton = ahocorasick.Automaton()
        for b, i in by_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.whole = {b: [i] for b, i in by_bytes.items()}
        self.split = regex.compile(PATTERN).findall
        self.compatible_cache: dict[tuple[int, int], bool] = {}
        encoder = self

        class Cache(dict):
            def __missing__(self, piece):
                found = encoder.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= encoder.LONGEST_CACHED:
                    self[piece] = found
                return found

        self.cache = Cache()

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE keeps the boundary between tokens a and b."""
        known = self.compatible_cache.get((a, b))
        if known is None:
            known = self._compatible(a, b)
            if len(self.compatible_cache) < 1_000_000:
                self.compatible_cache[a, b] = known
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo merges on both sides of the boundary, the later one first; a pair that merges earlier than what it
        # would break up crosses the boundary.
        bound = float("inf")
        while True:
            if self.pairs.get((a, b), bound) < bound:
                return False
            undo_left = a > b
            for side in (undo_left, not undo_left):
                if side and self.right[a] != a:
                    bound, a = a, self.right[a]
                    break
                if not side and self.left[b] != b:
                    bound, b = b + 0.5, self.left[b]
                    break
            else:
                return True

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if data in self.whole:
            return self.whole[data]
        n = len(data)
        longest, size = [-1] * n, [0] * n
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        tokens: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            while True:
                end = at + self.length[token]
                if not dead[end] and (not tokens or self.compatible(tokens[-1], token)):
                    tokens.append(token)
                    at = end
                    token = longest[at] if at < n else -1
                    break
                token = self.shorter[token]
                if token < 0:
                    dead[at] = 1
                    if not tokens:
                        raise ValueError("the vocabulary lacks a byte of the text")
                    token = tokens.pop()
                    at -= self.length[token]
                    token = self.shorter[token]
                    while token < 0:
                        dead[at] = 1
                        token = tokens.pop()
                        at -= self.length[token]
                        token = self.shorter[token]
        return tokens

    def encode_into(self, text: str, ids: array) -> None:
        """Appends the ids of a text."""
        ids.extend(chain.from_iterable(map(self.cache.__getitem__, self.split(text))))
        if len(self.cache) > self.MOST_CACHED:
            self.cache.clear()

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty and for a null text."""
        ids = array("i")
        if text:
            self.encode_into(text, ids)
        return ids.tolist()


class Decoder:
    """Texts of ids: a buffer of all tokens' bytes and the offset of each token in it."""

    def __init__(self, encoder: Encoder):
        self.buffer = np.frombuffer(b"".join(encoder.bytes), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum(encoder.length)])

    def decode_bytes(self, ids) -> bytes:
        """The bytes that the ids stand for."""
        ids = np.asarray(ids, np.int64)
        start, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.buffer[at].tobytes()

    def decode(self, ids) -> str:
        """The text; bytes that are no text become the replacement sign."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def _encoder(digest: str, content: bytes) -> Encoder:
    if digest not in _LOADED:
        _LOADED.clear()
        _LOADED[digest] = Encoder(content)
    return _LOADED[digest]


@lru_cache(maxsize=2)
def load_encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, for use outside Spark."""
    with open(path, "rb") as f:
        return Encoder(f.read())


def token_ids(df: DataFrame, key: str, text: str, vocabulary: str | None = None, out: str = "ids") -> DataFrame:
    """``key`` and ``ids``, the list of token ids of ``text`` without special tokens.

    An empty list for an empty and for a null text; strings of special tokens are ordinary text. One row for each row, so equal
    rows repeat and null keys stay; very long texts are encoded whole; an empty table gives none; other columns do
    not matter, whatever their names. ``vocabulary`` is the path of a byte-level BPE vocabulary file.
    """
    spark = df.sparkSession
    with open(vocabulary or default_vocabulary(), "rb") as f:
        content = f.read(MOST_VOCABULARY_BYTES + 1)
    if len(content) > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary file is too large to be sent to every executor")
    digest, shared = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _LOADED.get(digest) or _encoder(digest, shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            begin, ids, offsets = 0, array("i"), array("i", [0])
            for n in range(len(texts)):
                value = texts[n].as_py()
                if value:
                    encoder.encode_into(value, ids)
                offsets.append(len(ids))
                if len(ids) > 4_000_000 or n + 1 == len(texts):
                    lists = pa.ListArray.from_arrays(pa.array(np.frombuffer(offsets, np.int32)), pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, n + 1 - begin), lists], names=["key", "ids"])
                    begin, ids, offsets = n + 1, array("i"), array("i", [0])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, ids array<int>").select(F.col("key").alias(key), F.col("ids").alias(out))
