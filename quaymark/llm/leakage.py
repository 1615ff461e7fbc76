"""Test items that leaked into subtitle files (problem 8).

Of every item each window of the needed number of words becomes a pattern: the letters of its
words that no known damage changes, one after the other, without the words' borders, since
recognition also splits words and runs them together. The files become streams of such letters,
and Wu-Manber's search finds the patterns in them. What it finds is confirmed in the words.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaymark.llm.boilerplate import openers
from quaymark.llm.subtitles import Word, folded, piece, repaired, skeleton, spelled, spoken
from quaymark.llm.wumanber import Patterns, padded
from quaymark.session import materialize
from quaymark.sources.tables import table

#: The share of an item's words that must stand in one unbroken run.
SHARE = 0.6
#: Words of items in a block, and blocks searched for side by side in one pass over the files.
BLOCK_WORDS, SIDE_BY_SIDE = 1_000_000, 2
#: Likeness of letters that passes where damage isn't of a known kind: of a window, and of the words at its ends that have no steady consonants.
ALIKE, ALIKE_END = 0.9, 0.6
#: Parts that a word falls apart in, or words that run together, at most.
PARTS = 3
_EDGE = re.compile(r"^[^\w]+|[^\w]+$")


def item_words(text: str | None) -> list[str]:
    out = []
    for raw in repaired(text or "").split():
        w = _EDGE.sub("", folded(raw)).replace("'", "").replace("’", "")
        if w and any(c.isalnum() for c in w):
            out.append(w)
    return out


class Items:
    """Every window of the needed length of every item, as patterns of letters."""

    def __init__(self, items: list[tuple[int, str]], share: float = SHARE) -> None:
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        self.pieces: list[list[str]] = []
        windows: dict[str, list[tuple[int, int, int]]] = {}
        for item, text in items:
            words = item_words(text)
            need = math.ceil(share * len(words) - 1e-9)
            if not words:
                continue
            i = len(self.ids)
            self.ids.append(item)
            self.words.append(words)
            self.pieces.append([piece(skeleton(w)) for w in words])
            for a in range(len(words) - need + 1):
                windows.setdefault("".join(self.pieces[i][a : a + need]), []).append((i, a, need))
        self.unsearchable = windows.pop("", [])
        by_size: dict[int, list[str]] = {}
        for p in windows:  # patterns of like length share a table, so that short ones don't shorten all shifts
            by_size.setdefault(len(p).bit_length(), []).append(p)
        self.groups = [(Patterns([p.encode() for p in ps]), [windows[p] for p in ps]) for _, ps in sorted(by_size.items())]
        self._alike: dict[tuple[str, str], bool] = {}

    def alike(self, mine: str, theirs: str) -> bool:
        """Whether a document's word can be an item's word, damaged or not."""
        if mine == theirs:
            return True
        key = (mine, theirs)
        got = self._alike.get(key)
        if got is None:
            if len(self._alike) > 500_000:
                self._alike.clear()
            got = self._alike[key] = re.fullmatch(spelled(mine), theirs) is not None
        return got

    def _walk(self, mine: list[str], words: list[Word], j: int, step: int) -> bool:
        """Whether all of mine stands in the words from place j on (backwards: up to it), split and joined words allowed."""
        whole = lambda parts: "".join(parts if step > 0 else reversed(parts))
        mine = mine if step > 0 else mine[::-1]
        i = 0
        while i < len(mine):
            theirs = [words[x][0] for x in range(j, j + step * PARTS, step) if 0 <= x < len(words)]
            if theirs and self.alike(mine[i], theirs[0]):
                i, j = i + 1, j + step
                continue
            n = next((n for n in range(2, len(theirs) + 1) if self.alike(mine[i], whole(theirs[:n]))), 0)
            if n:
                i, j = i + 1, j + step * n
                continue
            n = next((n for n in range(2, min(PARTS, len(mine) - i) + 1) if theirs and self.alike(whole(mine[i : i + n]), theirs[0])), 0)
            if n:
                i, j = i + n, j + step
                continue
            if len(mine[i]) > 1 or mine[i].isascii():
                return False
            i += 1  # a word of one accented letter that got lost altogether
        return True

    def confirmed(self, item: int, a: int, need: int, words: list[Word], starts: list[int], at: int) -> bool:
        """Whether the window stands in the document whose letters from `at` on are the window's; starts: where each word's letters begin."""
        mine, pieces = self.words[item][a : a + need], self.pieces[item][a : a + need]
        filled = [i for i, p in enumerate(pieces) if p]
        lead, trail = filled[0], need - 1 - filled[-1]
        first = bisect_right(starts, at) - 1
        end = at + sum(map(len, pieces))
        last = bisect_right(starts, end - 1) - 1
        if starts[first] != at or starts[last] + len(words[last][2]) != end:
            return False  # it begins or ends amid a word
        if self._walk(mine[lead:], words, first, 1) and self._walk(mine[:lead], words, first - 1, -1):
            return True
        # Otherwise by the letters altogether; words at the ends that have no part in the search must be alike by themselves.
        theirs = [w[0] for w in words[max(first - lead, 0) : last + 1 + trail]]
        near = lambda a, b: SequenceMatcher(None, "".join(a), "".join(b), autojunk=False).ratio()
        ends = [(mine[:lead], theirs[:lead]), (mine[need - trail :], theirs[len(theirs) - trail :])]
        return near(mine, theirs) >= ALIKE and all(near(a, b) >= ALIKE_END for a, b in ends if a)

    def search(self, docs: list[list[Word]]) -> list[tuple[int, int]]:
        """(number of the document, item id) of all that leaked, each once."""
        streams = ["".join([w[2] for w in d]) for d in docs]
        buf = padded("\0".join(streams).encode())
        origin = np.concatenate([[0], np.cumsum([len(s) + 1 for s in streams])])
        starts: dict[int, list[int]] = {}
        found: set[tuple[int, int]] = set()
        for patterns, windows in self.groups:
            start, k = patterns.find(buf)
            which = np.searchsorted(origin, start, "right") - 1
            for f, d, p in zip((start - origin[which]).tolist(), which.tolist(), k.tolist()):
                for item, a, need in windows[p]:
                    if (d, item) in found:
                        continue
                    if d not in starts:
                        starts[d] = [0, *accumulate(len(w[2]) for w in docs[d])][:-1]
                    if self.confirmed(item, a, need, docs[d], starts[d], f):
                        found.add((d, item))
        for item, a, need in self.unsearchable:  # items of words without steady consonants
            for d, words in enumerate(docs):
                mine = self.words[item][a : a + need]
                if (d, item) not in found and any(all(map(self.alike, mine, (w[0] for w in words[j : j + need]))) for j in range(len(words) - need + 1)):
                    found.add((d, item))
        return [(d, self.ids[i]) for d, i in sorted(found)]


def leaks(documents: DataFrame, items: DataFrame, *, doc_id: Column, text: Column, item_id: Column, item_text: Column, share: float = SHARE, block_words: int = BLOCK_WORDS, side_by_side: int = SIDE_BY_SIDE, adverts: frozenset[str] = frozenset()) -> DataFrame:
    """(doc_id, item_id): the document's spoken text holds one unbroken run of at least `share` of the item's words.

    The items are the stated query set. They come through the driver one block of block_words words
    at a time and go to the documents in blocks, side_by_side of them in each pass, so that what a
    task holds of them is bounded; with more blocks than that, the cleaned words are written once
    and read by each pass. Null or empty texts and items without words match nothing; documents
    that repeat an id are searched each and give one row; equal items are each reported. adverts:
    openers of lines that aren't speech, besides those that are known. No other columns are read.
    """
    spark = documents.sparkSession
    blocks, block, held = [], [], 0
    for r in items.select(item_id.alias("i"), item_text.alias("t")).where("i is not null and t is not null").orderBy("i").toLocalIterator():
        n = len(r.t.split())
        if held and held + n > block_words:
            blocks.append(spark.sparkContext.broadcast(block))
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    if block or not blocks:
        blocks.append(spark.sparkContext.broadcast(block))
    passes = [blocks[i : i + side_by_side] for i in range(0, len(blocks), side_by_side)]
    cleaned = documents.select(doc_id.cast("bigint").alias("doc_id"), text.alias("text")).where("doc_id is not null and text is not null")
    raw = len(passes) == 1
    if not raw:
        cleaned = materialize(cleaned.mapInArrow(_spoken_rows(adverts), "doc_id bigint, words array<string>"), "spoken")
    out = None
    for sent in passes:

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            known = None
            for b in batches:
                if not b.num_rows:
                    continue
                known = known or [Items(s.value, share) for s in sent]
                texts = b.column(1).to_pylist()
                docs = [spoken(t, adverts) for t in texts] if raw else [[(w, bones, piece(bones)) for w, bones in ((w, skeleton(w)) for w in ws)] for ws in texts]
                hits = [h for one in known for h in one.search(docs)]
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _ in hits], pa.int64()), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "item_id"])

        part = cleaned.mapInArrow(run, "doc_id bigint, item_id bigint")
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def _spoken_rows(adverts: frozenset[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [[w[0] for w in spoken(t, adverts)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.list_(pa.string()))], ["doc_id", "words"])

    return run


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return leaks(docs, table(spark, sf_dir, "eval_item"), doc_id=F.col("doc_id"), text=F.col("text"), item_id=F.col("item_id"), item_text=F.col("text"), adverts=openers(docs, F.col("text"), F.col("title_id")))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each item leaked into; items that didn't leak with 0."""
    hit = p8_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))
    every = table(spark, sf_dir, "eval_item").select("item_id", "suite")
    return every.join(hit, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p8_found, p8_items)}


def oracle_sql() -> dict[str, str]:
    return {}
