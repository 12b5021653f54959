"""Problem 8: the reading band a document is written for.

Method: a familiar-word formula. Words are familiar if they occur in at least ``familiar_share`` of the corpus's documents of
their language; the score of a stretch of prose is linear in its share of unfamiliar words and its average sentence length.
The weights and the cuts between bands come from graded examples, a bounded sample of labelled texts. Document
frequencies cover the whole corpus; only the familiar words, at most (words of a document / share) of them, are sent round.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geotrail.llm.prose import _CJK, _WORD, Sentence, plain_words, sentences

BANDS = ("basic", "intermediate", "advanced")
#: The graded sample is read up to this many rows; it is a fixed set of examples.
MOST_GRADED = 20_000
_KANA = "ja"
_NONE: frozenset[str] = frozenset()


def _pairs(letters: str) -> list[str]:
    return [a + b for a, b in zip(letters, letters[1:])]


def units(s: Sentence) -> list[str]:
    """What counts as words: in Japanese, which has no spaces, pairs of letters."""
    return _pairs(s.letters) if s.cjk else s.words


def length(s: Sentence) -> int:
    """Sentence length in words, in Japanese in letters."""
    return len(s.letters) if s.cjk else len(s.words)


class Languages:
    """Tells the language of words by naive Bayes over the graded examples; writing systems tell Japanese."""

    def __init__(self, graded: list[tuple[str, str, str]]):
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, _, text in graded:
            for s in sentences(text):
                if not s.cjk:
                    counts[lang].update(s.words)
        self.names = sorted(counts)
        size = len({w for c in counts.values() for w in c}) + 1
        self.base = [math.log(0.5 / (sum(counts[n].values()) + 0.5 * size)) for n in self.names]
        self.weights: dict[str, list[float]] = {}
        for w in {w for c in counts.values() for w in c}:
            self.weights[w] = [math.log((counts[n][w] + 0.5) / (sum(counts[n].values()) + 0.5 * size)) - b for n, b in zip(self.names, self.base)]

    def of(self, words: set[str]) -> str | None:
        """The likeliest language of a set of words."""
        if not self.names:
            return None
        weights = self.weights
        known = [weights[w] for w in words if w in weights]
        size = len(words)
        score = [b * size + sum(column) for b, column in zip(self.base, zip(*known))] if known else self.base
        return self.names[max(range(len(score)), key=score.__getitem__)]


class Formula:
    """The weights, cuts and limits of each language, from graded sentences and the familiar words."""

    def __init__(self, graded: list[tuple[str, str, str]], familiar: dict[str, set[str]]):
        self.familiar = familiar
        by_lang: dict[str, list[tuple[float, int, int]]] = defaultdict(list)
        for lang, band, text in graded:
            for s in sentences(text):
                key = _KANA if s.cjk else lang
                by_lang[key].append((self.share(s, key), length(s), BANDS.index(band)))
        self.weights, self.cuts, self.limit = {}, {}, {}
        for lang, rows in by_lang.items():
            share, size, band = (np.array(c, float) for c in zip(*rows))
            if len(set(band)) < 3:
                continue
            # Lengths beyond what the band above has come from sentences that could not be cut.
            size = np.minimum(size, 1.5 * np.median(size[band == 2]))
            a = np.stack([share, size, np.ones(len(size))], 1)
            w, *_ = np.linalg.lstsq(a, band, rcond=None)
            score = a @ w
            middle = [float(np.median(score[band == b])) for b in range(3)]
            self.weights[lang] = tuple(map(float, w))
            self.cuts[lang] = ((middle[0] + middle[1]) / 2, (middle[1] + middle[2]) / 2)
            long = share[size >= 5]
            self.limit[lang] = float(np.quantile(long, 0.995)) + 0.1 if len(long) else 1.0

    def share(self, s: Sentence, lang: str) -> float:
        """Share of unfamiliar words."""
        known, u = self.familiar.get(lang, _NONE), units(s)
        return 1 - sum(map(known.__contains__, u)) / len(u) if u else 0.0

    def band(self, text: str | None, languages: Languages, least_words: int, least_letters: int) -> str | None:
        """The band of a text, or None for too little prose."""
        own = sentences(text)
        letters = sum(length(s) for s in own if s.cjk)
        latin = [w for s in own if not s.cjk for w in s.words]
        cjk = letters > 2 * len(latin)
        lang = _KANA if cjk else languages.of(set(latin))
        if lang not in self.weights:
            return None
        kept = []
        (a, b, c), (low, high) = self.weights[lang], self.cuts[lang]
        for s in own:
            if s.cjk != cjk:
                continue
            share, size = self.share(s, lang), length(s)
            # Prose whose words the corpus hardly uses is not the document's own: a passage from elsewhere.
            if share > self.limit[lang] and share * len(units(s)) >= 3:
                continue
            score = a * share + b * size + c
            kept.append(((score >= low) + (score >= high), size))
        if sum(n for _, n in kept) < (least_letters if cjk else least_words):
            return None
        return BANDS[_most(kept)]


def _most(kept: list[tuple[int, int]]) -> int:
    """The band of most of the prose, from (band, length) of its sentences in order.

    Three quarters of the words decide. Else single sentences of another band, which stand alone or in twos among the
    others, do not count, unless there is nothing else. Equal amounts go to the easier band.
    """
    words = [sum(n for b, n in kept if b == k) for k in range(3)]
    if max(words) >= 0.75 * sum(words):
        return words.index(max(words))
    runs: list[list[int]] = []
    for b, n in kept:
        if runs and runs[-1][0] == b:
            runs[-1][1] += n
            runs[-1][2] += 1
        else:
            runs.append([b, n, 1])
    for least in (3, 2, 1):
        total = [sum(n for b, n, k in runs if b == band and k >= least) for band in range(3)]
        if any(total):
            break
    return total.index(max(total))


def _graded(graded: DataFrame, cols: tuple[str, str, str]) -> list[tuple[str, str, str]]:
    rows = graded.select(*[F.col(c).cast("string") for c in cols]).where(F.col(cols[1]).isin(*BANDS) & F.col(cols[0]).isNotNull() & F.col(cols[2]).isNotNull())
    return sorted(tuple(r) for r in rows.limit(MOST_GRADED).collect())


def _vocabulary(text: str, languages: Languages) -> tuple[str | None, set[str]]:
    low = text.casefold()
    letters = len(_CJK.findall(low)) if not low.isascii() else 0
    words = set(plain_words(low))
    if letters * 3 > len(low):
        pairs: set[str] = set()
        for run in _WORD.findall(low):
            pairs.update(_pairs(run))
        return _KANA, pairs
    return languages.of(words) if words else None, words


def familiar_words(documents: DataFrame, text: str, languages: Languages, share: float) -> dict[str, set[str]]:
    """For each language the words in at least ``share`` of its documents, over the whole corpus.

    Counts are added up within each task before they are shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(languages)
    schema = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def emit() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], schema=schema)
            held.clear()

        for batch in batches:
            for value in batch.column(0).to_pylist():
                lang, words = _vocabulary(value, shared.value)
                if lang:
                    words.add(None)  # counts the document itself
                    held[lang].update(words)
            if sum(map(len, held.values())) > 300_000:
                yield from emit()
        yield from emit()

    rows = documents.select(F.col(text).cast("string").alias("text")).where(F.col("text").isNotNull() & (F.col("text") != ""))
    sums = rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # The rows without a word are the totals, one for each language of the graded texts. Both sides of the join read one exchange,
    # as the totals are picked by an aggregate that no filter can be pushed below.
    totals = sums.groupBy("lang").agg(F.max(F.when(F.col("word").isNull(), F.col("n"))).alias("total"))
    found: dict[str, set[str]] = defaultdict(set)
    for lang, word in sums.join(F.broadcast(totals), "lang").where(F.col("n") >= share * F.col("total")).select("lang", "word").collect():
        if word is not None:
            found[lang].add(word)
    return dict(found)


def reading_bands(
    documents: DataFrame,
    graded: DataFrame,
    *,
    doc_cols: tuple[str, str] = ("doc_id", "text"),
    graded_cols: tuple[str, str, str] = ("lang", "band", "sample_text"),
    familiar_share: float = 0.03,
    least_words: int = 40,
    least_letters: int = 100,
) -> DataFrame:
    """``doc_id, band``: the band in which most of a document's running prose is written.

    Documents with fewer than ``least_words`` words of prose (Japanese: ``least_letters`` letters) have no row; so null, empty,
    blank texts and machine output have none. Lines of machine output, quoted lines, passages of other languages or of words that
    the corpus hardly uses, and single sentences of another band do not count; equal amounts go to the easier band. Each row
    counts, equal rows too; texts are read whole; an empty table, or graded texts without all bands of a language,
    give none; ids are integers; other columns do not matter, whatever their names.
    """
    sample = _graded(graded, graded_cols)
    languages = Languages(sample)
    docs = documents.select(F.col(doc_cols[0]).cast("bigint").alias("doc_id"), F.col(doc_cols[1]).cast("string").alias("text"))
    formula = Formula(sample, familiar_words(docs, "text", languages, familiar_share))
    shared = documents.sparkSession.sparkContext.broadcast((formula, languages))
    schema = pa.schema([("doc_id", pa.int64()), ("band", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, l = shared.value
        for batch in batches:
            bands = [f.band(t, l, least_words, least_letters) for t in batch.column(1).to_pylist()]
            keep = [k for k, b in enumerate(bands) if b]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([bands[k] for k in keep], pa.string())], schema=schema)

    return docs.where(F.col("text").isNotNull()).mapInArrow(run, "doc_id bigint, band string")
