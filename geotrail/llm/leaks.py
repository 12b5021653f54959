"""Problem 7: documents that contain passages of evaluation items.

Method: pigeonhole edit matching. A passage is ``min_words`` consecutive words of an item, joined and surrounded by single spaces. Each
item is cut into pieces of equal length, so short that any of its passages holds one whole piece more than it may have edits.
An edit changes one character of one piece, so a passage within the error budget leaves a piece untouched. Exact hits of all
pieces of all items are found in one pass over a batch of documents, by rolling hashes of whole arrays and a sorted table of the pieces'
hashes; each hit is compared, extended on both sides as far as the budget goes, and a passage that lies within is verified with
Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.words import words

#: Items are a set of held-out texts of fixed size, sent to every executor; a larger set is searched in blocks of this size.
MOST_ITEM_BYTES = 32 * 1024 * 1024
#: A piece has at least so many characters; an item too short for that has a smaller budget. Longer ones have a multiple of it, so that
#: there are few lengths to hash, up to the greatest.
LEAST_PIECE, MOST_PIECE = 4, 32
#: The rolling hash: an odd base and its inverse modulo 2**64, and the characters hashed at once.
_BASE = 0x9E3779B97F4A7C15
_WINDOW = 1 << 19
_CHUNK = 1 << 21


def myers(pattern: str, text: str, most: int) -> int:
    """The least edit distance of ``pattern`` to any part of ``text``, or ``most + 1`` if it is greater than ``most``."""
    m = len(pattern)
    if not m:
        return 0
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        x = e | down
        d = (((e & up) + up) ^ up) | e
        plus, minus = down | ~(d | up), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        # A part may begin anywhere, so nothing is carried into the first row.
        plus, minus = plus << 1, minus << 1
        up = (minus | ~(x | plus)) & mask
        down = plus & x & mask
        if score < best:
            best = score
            if not best:
                return 0
    return best if best <= most else most + 1


def budget_and_piece(shortest: int, max_edits: int) -> tuple[int, int]:
    """(edits that a passage of an item may have, length of the item's pieces) if its shortest passage has ``shortest`` characters.

    Any stretch of ``n`` characters holds at least ``(n + 1) // length - 1`` whole pieces, and that many are one more than the edits.
    """
    for edits in range(max_edits, 0, -1):
        if (size := (shortest + 1) // (edits + 2)) >= LEAST_PIECE:
            return edits, _rounded(size)
    return 0, _rounded(max(1, (shortest + 1) // 2))


def _rounded(size: int) -> int:
    """A length that is no longer; shorter pieces only add to those that a passage holds."""
    return size if size < LEAST_PIECE else min(size // LEAST_PIECE * LEAST_PIECE, MOST_PIECE)


class _Item:
    """One item: its text between single spaces, where its passages begin and end, its budget and the length of its pieces."""

    def __init__(self, key: int, w: list[str], min_words: int, max_edits: int):
        self.key, self.line = key, " " + " ".join(w) + " "
        need, at, p = min(min_words, len(w)), [], 0
        for x in [*w, ""]:
            at.append(p)
            p += len(x) + 1
        self.begin = array("i", at[: len(w) - need + 1])
        self.end = array("i", (at[s + need] + 1 for s in range(len(self.begin))))
        self.edits, self.size = budget_and_piece(min(e - b for b, e in zip(self.begin, self.end)), max_edits)


def _agree(a: str, i: int, b: str, j: int) -> int:
    """How many characters of ``a`` from ``i`` on and of ``b`` from ``j`` on are the same."""
    most = min(len(a) - i, len(b) - j)
    n = 0
    while n < most and a[i + n] == b[j + n]:
        n += 1
        if n & 7 == 0:
            while n + 32 <= most and a[i + n : i + n + 32] == b[j + n : j + n + 32]:
                n += 32
    return n


def _reaches(a: str, i: int, b: str, j: int, most: int) -> list[int]:
    """How far in ``a``, from ``i`` on, 0, 1, .. ``most`` edits lead along ``b`` from ``j`` on."""
    p = i + _agree(a, i, b, j)
    out = [p]
    if not most or p == len(a):
        return out + [p] * most
    q = p + j - i
    if most == 1:
        # A lost character, a changed one, an added one.
        best = p + 1 + _agree(a, p + 1, b, q)
        if q < len(b):
            best = max(best, p + 1 + _agree(a, p + 1, b, q + 1), p + _agree(a, p, b, q + 1))
        out.append(best)
        return out
    front = {0: p}
    for k in range(1, most + 1):
        new: dict[int, int] = {}
        for d in range(-k, k + 1):
            at = min(max(front.get(d, -2) + 1, front.get(d - 1, -1), front.get(d + 1, -2) + 1), len(a))
            if at >= i and 0 <= (q := at + j - i + d) <= len(b):
                new[d] = at + _agree(a, at, b, q)
        front = new
        out.append(max(out[-1], *new.values()) if new else out[-1])
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Hashes:
    """Hashes of every stretch of a length in an array, by prefix sums of weighted codes and the inverse weights."""

    def __init__(self):
        self.weight = np.cumprod(np.full(_WINDOW, _BASE, np.uint64))
        self.back = np.cumprod(np.full(_WINDOW, pow(_BASE, -1, 1 << 64), np.uint64))

    def sums(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * self.weight[: len(codes)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, size: int) -> np.ndarray:
        return (sums[size:] - sums[:-size]) * self.back[: len(sums) - size]


class Matcher:
    """Finds the items that documents hold passages of."""

    def __init__(self, items: list[tuple[int, str]], min_words: int, max_edits: int):
        self.items = [_Item(i, w, min_words, max_edits) for i, t in items if (w := words(t))]
        self.hashes = _Hashes()
        found: dict[int, list] = defaultdict(list)
        for n, x in enumerate(self.items):
            codes = _codes(x.line)
            # Very long items are hashed a window at a time; pieces begin at multiples of their length.
            for start in range(0, len(codes), _WINDOW // x.size * x.size):
                part = codes[start : start + _WINDOW // x.size * x.size]
                if len(part) >= x.size:
                    hashes = self.hashes.of(self.hashes.sums(part), x.size)[:: x.size]
                    found[x.size].append((hashes, np.full(len(hashes), n, np.int32), (start + x.size * np.arange(len(hashes))).astype(np.int32)))
        self.tables = {}
        for size, parts in found.items():
            hashes, owner, at = (np.concatenate(c) for c in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            # A small table of flags rules nearly all stretches of a document out.
            shift = np.uint64(64 - min(25, max(12, int(len(hashes) * 32).bit_length())))
            flags = np.zeros(1 << (64 - int(shift)), bool)
            flags[(hashes >> shift).astype(np.int64)] = True
            self.tables[size] = hashes[order], owner[order], at[order], shift, flags

    def _hits(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(position, length, item, position in it) of every piece in a text, by position within windows."""
        codes, most = _codes(text), max(self.tables)
        step = _WINDOW - most + 1
        for start in range(0, max(1, len(codes) - most + 1), step):
            part = codes[start : start + _WINDOW]
            last = start + step >= len(codes) - most + 1
            sums = self.hashes.sums(part)
            rows = []
            for size, (known, owner, at, shift, flags) in self.tables.items():
                if len(part) < size:
                    continue
                hashes = self.hashes.of(sums, size)
                if not last:
                    hashes = hashes[:step]
                some = np.flatnonzero(flags[(hashes >> shift).astype(np.int64)])
                low = np.searchsorted(known, hashes[some])
                n = np.searchsorted(known, hashes[some], "right") - low
                which = np.repeat(np.arange(len(some)), n)
                use = low[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                rows.append(np.stack([some[which] + start, np.full(len(which), size), owner[use], at[use]], 1))
            found = np.concatenate(rows) if rows else np.zeros((0, 4), np.int64)
            yield from map(tuple, found[np.argsort(found[:, 0], kind="stable")].tolist())

    def find_all(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text the items that leak into it, each with the least number of edits of a passage."""
        out: list[dict[int, int]] = [{} for _ in texts]
        if not self.tables:
            return out
        lines, owners, size = [], [], 0
        for k, text in enumerate(texts):
            if w := words(text):
                lines.append(" " + " ".join(w) + " ")
                owners.append(k)
                size += len(lines[-1])
            if lines and (size > _CHUNK or k == len(texts) - 1):
                self._search(lines, owners, out)
                lines, owners, size = [], [], 0
        if lines:
            self._search(lines, owners, out)
        return out

    def find(self, text: str | None) -> dict[int, int]:
        """The same for one text."""
        return self.find_all([text])[0]

    def _search(self, lines: list[str], owners: list[int], out: list[dict[int, int]]) -> None:
        # No line holds a line break, so no hit reaches over one.
        whole, starts, p = "\n".join(lines), [], 0
        for line in lines:
            starts.append(p)
            p += len(line) + 1
        now, line, turned, seen, best = -1, "", None, {}, {}
        for position, size, n, at in self._hits(whole):
            while now + 1 < len(starts) and starts[now + 1] <= position:
                self._keep(best, out, owners, now)
                now += 1
                line, turned, seen, best = lines[now], None, {}, {}
            hit, x, known = position - starts[now], self.items[n], best.get(n)
            if known == 0 or seen.get((n, hit - at), 0) >= at + size or line[hit : hit + size] != x.line[at : at + size]:
                continue
            if turned is None:
                turned = line[::-1]
            edits, seen[n, hit - at] = self._verify(n, at, hit, line, turned)
            if edits <= x.edits and (known is None or edits < known):
                best[n] = edits
        self._keep(best, out, owners, now)

    def _keep(self, best: dict[int, int], out: list[dict[int, int]], owners: list[int], now: int) -> None:
        if best:
            found = out[owners[now]]
            for n, edits in best.items():
                key = self.items[n].key
                found[key] = min(edits, found.get(key, edits))

    def _verify(self, n: int, at: int, hit: int, line: str, turned: str) -> tuple[int, int]:
        """(least edit distance of a passage around the piece at ``at``, which the document has at ``hit``; where agreement ends).

        Pieces that follow on the same diagonal before that end lead to the same passages.
        """
        x = self.items[n]
        right = _reaches(x.line, at + x.size, line, hit + x.size, x.edits)
        left = [len(x.line) - r for r in _reaches(x.line[::-1], len(x.line) - at, turned, len(line) - hit, x.edits)]
        for total in range(x.edits + 1):
            for before in range(total + 1):
                s = bisect_left(x.begin, left[before])
                if s < len(x.end) and x.end[s] <= right[total - before]:
                    begin, end = x.begin[s], x.end[s]
                    near = line[max(0, hit - (at - begin) - x.edits) : hit + (end - at) + x.edits]
                    return myers(x.line[begin:end], near, x.edits), right[0]
        return x.edits + 1, right[0]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_cols: tuple[str, str] = ("doc_id", "text"),
    item_cols: tuple[str, str] = ("item_id", "item_text"),
    min_words: int = 12,
    max_edits: int = 1,
) -> DataFrame:
    """``doc_id, item_id, edits``: documents with a passage of ``min_words`` consecutive words of an item, all its words if fewer.

    Words are runs of letters and digits in normal form (see ``words``). A passage, its words between single spaces, may differ
    by ``max_edits`` edited characters, a lost or an added space being one; ``edits`` is the least number found, 0 for a passage
    without a difference. An item whose shortest passage is too short for pieces of ``LEAST_PIECE`` characters has the
    greatest smaller budget that allows them. Null and empty texts on either side, and null item ids, give nothing; each
    document row gives each of its items once, so equal rows repeat; ids are integers; texts are read whole; an empty table
    gives none; other columns do not matter.
    """
    spark = documents.sparkSession
    held = items.select(F.col(item_cols[0]).cast("bigint").alias("i"), F.col(item_cols[1]).cast("string").alias("t")).where(F.col("i").isNotNull() & F.col("t").isNotNull())
    total = held.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-int(total) // MOST_ITEM_BYTES))
    docs = documents.select(F.col(doc_cols[0]).cast("bigint").alias("doc_id"), F.col(doc_cols[1]).cast("string").alias("text")).where(F.col("text").isNotNull())
    out = None
    for part in range(parts):
        some = held if parts == 1 else held.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        shared = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in some.collect()])
        found = docs.mapInArrow(_search(shared, min_words, max_edits), "doc_id bigint, item_id bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out


#: Matchers of this worker by what they were made of; a worker runs many tasks with the same items.
_KEPT: OrderedDict[tuple, Matcher] = OrderedDict()


def _matcher(key: tuple, shared, min_words: int, max_edits: int) -> Matcher:
    if key not in _KEPT:
        while len(_KEPT) >= 2:
            _KEPT.popitem(last=False)
        _KEPT[key] = Matcher(shared.value, min_words, max_edits)
    _KEPT.move_to_end(key)
    return _KEPT[key]


def _search(shared, min_words: int, max_edits: int):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32())])
    key = (hashlib.sha256(repr(shared.value).encode()).hexdigest(), min_words, max_edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(key, shared, min_words, max_edits)
        for batch in batches:
            rows = [(key, item, edits) for key, found in zip(batch.column(0).to_pylist(), matcher.find_all(batch.column(1).to_pylist())) for item, edits in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    return run
