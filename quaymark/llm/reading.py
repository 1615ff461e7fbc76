"""Reading level of each document (problem 10).

A Rasch model of word occurrences with steps between levels (partial credit). Every passage has a
latent level, every word a difficulty for each step from a level to the next: the log-odds, all
else equal, that an occurrence of it stands in text of the lower level. How often a word occurs at
all is conditioned away, as Rasch does with the raw score: what counts is at which levels it does.
Given the difficulties, a passage's level has log-odds between neighbouring levels equal to minus
the summed step difficulties of its words (times SHARPNESS, since passages overlap). Given the
passages' levels, the difficulties are those of largest conditional likelihood under a normal
prior around the difficulties of words of the same length, found by Newton's method.

The two are found in turn: first from the labelled documents, whose passages are taken to have the
label's level, then over the whole corpus, until the words' levels stop changing. Objective and
change are logged after each pass. The passage of a word is the words around it; a document has
the level at which most of its words' passages are.

Words are hashed into a fixed number of slots, so that the difficulties are a table of known
size. Each pass over the corpus sums expected occurrences per task and slot before anything is
shuffled; the Newton steps need only these sums.
"""

from __future__ import annotations

import logging
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.boilerplate import openers
from quaymark.llm.subtitles import spoken
from quaymark.session import materialize
from quaymark.sources.tables import table

SLOT_BITS = 18
SLOTS = 1 << SLOT_BITS
#: Lengths of words that are told apart.
LENGTHS = 16
LEVELS = 3
#: Words on either side that make up a word's passage.
AROUND = 6
#: Variance of the prior around a length's difficulties, weight of the labelled documents against the corpus, weight of a passage's evidence.
VARIANCE, ANCHOR, SHARPNESS = 2.0, 3.0, 0.7
#: Newton steps end when no difficulty moves by more than EXACT; NEWTON is the most.
EXACT, NEWTON = 1e-6, 40
#: Passes over the corpus that estimate difficulties, after that over the labelled documents, end when a
#: word's occurrences change level by less than SETTLED on average; PASSES is the most.
PASSES, SETTLED = 30, 1e-3
MIN_WORDS = 30
_CHUNK = 2000
_LOG = logging.getLogger(__name__)


class _Codes(dict):
    """A word as slot and length in one number."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
        code = (xxhash.xxh3_64_intdigest(bare) & (SLOTS - 1)) | (min(len(bare), LENGTHS) - 1 << SLOT_BITS)
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = code
        return code


_CODES = _Codes()


def coded_words(documents: DataFrame, doc_id: Column, text: Column, adverts: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, words): the spoken words as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = _CODES.__getitem__
            words = [[code(w[0]) for w in spoken(t, adverts)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.int32()))], ["doc_id", "words"])

    return documents.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id is not null").mapInArrow(run, "doc_id bigint, words array<int>")


def _depths(steps: np.ndarray) -> np.ndarray:
    """Minus the summed difficulties up to each level: steps (n, LEVELS - 1) to (n, LEVELS)."""
    return -np.concatenate([np.zeros((len(steps), 1)), np.cumsum(steps, 1)], 1)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def step_difficulties(counts: np.ndarray, exposure: np.ndarray, centre: np.ndarray, variance: float = VARIANCE) -> tuple[np.ndarray, float]:
    """The step difficulties (n, LEVELS - 1) of largest conditional likelihood under the prior, and that objective.

    counts (n, LEVELS): expected occurrences of each word at each level; exposure (LEVELS): those
    of all words; centre (n, LEVELS - 1): the prior's means. The objective is concave, so Newton's
    steps, no longer than 2 in any difficulty, end at its only maximum.
    """
    offset = np.log(np.maximum(exposure, 1e-9))
    n = counts.sum(1)
    above = counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:]  # occurrences past each step
    steps = centre.copy()
    at = np.arange(counts.shape[1] - 1)
    for _ in range(NEWTON):
        past = _softmax(offset + _depths(steps))[:, ::-1].cumsum(1)[:, ::-1][:, 1:]
        slope = n[:, None] * past - above - (steps - centre) / variance
        both = past[:, np.maximum(at[:, None], at)]  # past the later of two steps is past both
        curve = n[:, None, None] * (both - past[:, :, None] * past[:, None, :]) + np.eye(len(at)) / variance
        move = np.clip(np.linalg.solve(curve, slope[:, :, None])[:, :, 0], -2, 2)
        steps = steps + move
        if not len(steps) or np.abs(move).max() < EXACT:
            break
    fit = (counts * np.log(np.maximum(_softmax(offset + _depths(steps)), 1e-300))).sum()
    return steps, float(fit - ((steps - centre) ** 2).sum() / (2 * variance))


class Difficulties:
    """Step difficulties of words and of lengths, from expected occurrences by level (LEVELS x SLOTS and LEVELS x LENGTHS) and the letters of each slot's occurrences (SLOTS)."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> None:
        exposure = words.sum(1)
        none = np.zeros((LENGTHS, LEVELS - 1))
        of_length, _ = step_difficulties(lengths.T, exposure, none, variance=100.0)
        seen = np.flatnonzero(words.any(0))
        counts = words[:, seen].T
        size = np.rint(letters[seen] / np.maximum(counts.sum(1), 1e-9)).astype(int)
        steps, objective = step_difficulties(counts, exposure, of_length[np.clip(size, 1, LENGTHS) - 1])
        self.objective = objective / max(exposure.sum(), 1e-9)
        self.by_length = _depths(of_length).T.astype(np.float32)
        self.by_word = np.full((LEVELS, SLOTS), np.nan, np.float32)
        self.by_word[:, seen] = _depths(steps).T

    def evidence(self, codes: np.ndarray) -> np.ndarray:
        """Minus the summed step difficulties of each word up to each level (LEVELS x words); words never counted have those of their length."""
        mine = self.by_word[:, codes & (SLOTS - 1)]
        return np.where(np.isnan(mine), self.by_length[:, codes >> SLOT_BITS], mine)

    def passages(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """P(level) of the passage of each word; documents end at `ends`."""
        n = len(codes)
        run = np.concatenate([np.zeros((LEVELS, 1)), np.cumsum(self.evidence(codes), 1, dtype=np.float64)], 1)
        sizes = np.diff(np.concatenate([[0], ends]))
        first, last = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        at = np.arange(n)
        e = SHARPNESS * (run[:, np.minimum(at + AROUND + 1, last)] - run[:, np.maximum(at - AROUND, first)])
        p = np.exp(e - e.max(0))
        return p / p.sum(0)


def moved(before: Difficulties, after: Difficulties, words: np.ndarray) -> float:
    """The share of word occurrences (LEVELS x SLOTS) that stand at another level after than before, 0 to 1."""
    old, new = (_softmax(np.nan_to_num(d.by_word).T) for d in (before, after))
    n = words.sum(0)
    return float((np.abs(new - old).sum(1) / 2 * n).sum() / max(n.sum(), 1e-9))


def _chunks(b: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for a in range(0, b.num_rows, _CHUNK):
        part = b.column(column).slice(a, _CHUNK)
        codes = part.flatten().to_numpy(zero_copy_only=False)
        yield a, codes, np.cumsum(part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)


_Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _zeros() -> _Sums:
    return np.zeros((LEVELS, SLOTS)), np.zeros((LEVELS, LENGTHS)), np.zeros(SLOTS)


def _summed(rows: DataFrame) -> _Sums:
    """Sums of all tasks per slot; at most SLOTS + LENGTHS rows come to the driver."""
    words, lengths, letters = _zeros()
    names = [c for c in _COLUMNS if c != "slot"]
    got = rows.groupBy("slot").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    slot = got.column("slot").to_numpy()
    n = np.stack([got.column(c).to_numpy() for c in names]) if len(slot) else np.zeros((LEVELS + 1, 0))
    w = slot < SLOTS
    words[:, slot[w]], letters[slot[w]] = n[:LEVELS, w], n[LEVELS, w]
    lengths[:, slot[~w] - SLOTS] = n[:LEVELS, ~w]
    return words, lengths, letters


_COLUMNS = ["slot", *(f"n{k}" for k in range(LEVELS)), "letters"]
_COUNTS = ", ".join(f"{c} {'int' if c == 'slot' else 'double'}" for c in _COLUMNS)


def _emit(words: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
    both = np.concatenate([np.concatenate([words, lengths], 1), np.concatenate([letters, np.zeros(LENGTHS)])[None]])
    hit = np.flatnonzero(both.any(0))
    return pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32))] + [pa.array(row[hit]) for row in both], _COLUMNS)


def _tally(sums: _Sums, codes: np.ndarray, p: np.ndarray) -> None:
    words, lengths, letters = sums
    slot, size = codes & (SLOTS - 1), codes >> SLOT_BITS
    for k in range(LEVELS):
        words[k] += np.bincount(slot, p[k], SLOTS)
        lengths[k] += np.bincount(size, p[k], LENGTHS)
    letters += np.bincount(slot, (size + 1.0) * p.sum(0), SLOTS)


def reading_levels(documents: DataFrame, labels: DataFrame, *, doc_id: Column, text: Column, label_id: Column, level: Column, passes: int = PASSES, min_words: int = MIN_WORDS, adverts: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, level, words, share): of every document with at least min_words spoken words.

    share is that of the document's words whose passages are of that level. All labelled documents
    are used; several raters of one average (between two levels: half to each); labels out of 1..3
    or null, and of documents that aren't there, count for nothing. Without any usable label, length
    decides nothing either and every level is as likely: level 1 comes out. Ties go to the lower
    level. Null and empty texts have no words. Documents that repeat an id give a row each. adverts:
    openers of lines that aren't speech, besides those that are known.
    """
    spark = documents.sparkSession
    coded = materialize(coded_words(documents, doc_id, text, adverts), "words")
    lab = labels.select(label_id.cast("bigint").alias("doc_id"), level.cast("double").alias("l")).where(f"l between 1 and {LEVELS}").groupBy("doc_id").agg(F.avg("l").alias("l"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _zeros()
        for b in batches:
            if not b.num_rows:
                continue
            l = b.column(1).to_numpy(zero_copy_only=False)
            for a, codes, ends in _chunks(b, 0):
                each = np.repeat(l[a : a + _CHUNK], np.diff(np.concatenate([[0], ends])))
                _tally(sums, codes, np.stack([np.maximum(0.0, 1 - np.abs(each - (k + 1))) for k in range(LEVELS)]))
        yield _emit(*sums)

    seed = _summed(coded.join(lab, "doc_id").select("words", "l").mapInArrow(labelled, _COUNTS))
    now, change = Difficulties(*seed), 1.0
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(now)

        def corpus(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            sums = _zeros()
            for b in batches:
                if b.num_rows:
                    for _, codes, ends in _chunks(b, 0):
                        _tally(sums, codes, sent.value.passages(codes, ends))
            yield _emit(*sums)

        got = _summed(coded.select("words").mapInArrow(corpus, _COUNTS))
        before, now = now, Difficulties(*(g + ANCHOR * s for g, s in zip(got, seed)))
        change = moved(before, now, got[0])
        _LOG.info("difficulties: %.6f of the words changed level, objective %.6f a word", change, now.objective)
        if change < SETTLED:
            break
    if passes and change >= SETTLED:
        _LOG.warning("difficulties still change after %d passes: %.6f of the words changed level in the last", passes, change)
    final = spark.sparkContext.broadcast(now)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            for a, codes, ends in _chunks(b, 1):
                run = np.concatenate([np.zeros((LEVELS, 1)), np.cumsum(final.value.passages(codes, ends), 1)], 1)
                starts = np.concatenate([[0], ends[:-1]])
                n = ends - starts
                share = (run[:, ends] - run[:, starts]) / np.maximum(n, 1)
                best = share.argmax(0)
                keep = np.flatnonzero(n >= min_words)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(a, _CHUNK).take(pa.array(keep)), pa.array((best + 1)[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64)), pa.array(share.max(0)[keep])], ["doc_id", "level", "words", "share"]
                )

    return coded.mapInArrow(judge, "doc_id bigint, level bigint, words bigint, share double")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return reading_levels(docs, table(spark, sf_dir, "reading_label"), doc_id=F.col("doc_id"), text=F.col("text"), label_id=F.col("doc_id"), level=F.col("level"), adverts=openers(docs, F.col("text"), F.col("title_id")))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", "level")


def p10_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the corpus is of each level: documents, words, and the mean share of words at their document's level."""
    return _levels(spark, sf_dir).groupBy("level").agg(F.count(F.lit(1)).alias("documents"), F.sum("words").alias("words"), F.round(F.avg("share"), 3).alias("mean_share"))


def queries() -> dict:
    return {f.__name__: f for f in (p10_found, p10_profile)}


def oracle_sql() -> dict[str, str]:
    return {}
