"""Benchmark decontamination: rare word n-grams as seeds, Smith-Waterman alignment as the decision.

A seed is a run of four words of a test item that the corpus would rarely hold by chance: with the words' own
frequencies over the whole corpus, fewer than ``RARE`` times a document. Common runs are no seeds, but the rarer half of
an item's runs always are. Rarity is judged by words and not by the runs themselves, so that a passage stays rare
however often it has leaked. A passage with a seed is joined to the item, and the words around the seeds are aligned
with the item's: two points for a match, minus one for a replaced, missing or added word. The best local score over its
maximum is the item's score; from ``THRESHOLD`` on, and with at least the points of ``POINTS`` words, the document is
contaminated. A copy with three of ten words replaced reaches about 0.55, half of an item 0.5. Items of fewer than
``LEAST`` words can't be told from ordinary phrases by a part of them: they match where all their words follow each
other, and those with fewer words than a seed where these are a whole line.

The items are looked up on the map side in blocks of at most ``BLOCK_WORDS`` words; a larger benchmark takes more passes
over the corpus, not more memory. Texts aren't shuffled.

Defined results: words are lowercase runs of letters, digits and underscores; in scripts without spaces each character is
a word. Null and empty texts and items without words match nothing. A text matches each item once, by its best
alignment, the first of equal ones. Repeated documents or items give repeated rows. Empty tables give no rows. Further
columns are ignored by ``contaminations`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.shared import bounded_batches, slices

SEED = 4
RARE = 1e-3
THRESHOLD = 0.4
LEAST, POINTS = 8, 6
BLOCK_WORDS = 500_000
MATCH, OTHER = 2, -1
MATCHES = "array<struct<item:int,score:double,first_word:int,last_word:int>>"

#: Scripts that are written without spaces. Ranges of code points (Thai, Lao, Myanmar, Khmer, kana, Han).
_SPACELESS = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
words = re.compile(rf"[{_SPACELESS}]|[^\W{_SPACELESS}]+").findall


def split_words(text: str | None) -> list[str]:
    return words(text.lower()) if text else []


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two arrays of word numbers, and the first and last aligned place in ``passage``."""
    n = len(passage)
    place = np.arange(n + 1)
    score, begin = np.zeros(n + 1, np.int64), place.copy()
    best = (0, 0, -1)
    for word in item:
        step = np.where(passage == word, MATCH, OTHER)
        through, up = score[:-1] + step, score[1:] + OTHER
        take = through >= up
        new, start = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], start[0] = 0, 0
        new[1:], start[1:] = np.where(take, through, up), np.where(take, begin[:-1], begin[1:])
        fresh = new <= 0
        new[fresh], start[fresh] = 0, place[fresh]
        # a word added to the passage costs a point each: the running maximum of score plus place
        raised = new - OTHER * place
        reach = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == reach, place, 0))
        new, start = reach + OTHER * place, start[source]
        at = int(new.argmax())
        if new[at] > best[0]:
            best = int(new[at]), int(start[at]), at - 1
        score, begin = new, start
    return best


class Items:
    """One block of test items, with the seeds to find them by."""

    def __init__(self, texts: list[str | None]):
        own = [split_words(t) for t in texts]
        self.number = {w: n for n, w in enumerate(sorted({w for t in own for w in t}), 1)}
        self.items = [np.array([self.number[w] for w in t], np.int64) for t in own]
        self.tiny: dict[tuple, list[int]] = {}
        for k, t in enumerate(own):
            if 0 < len(t) < SEED:
                self.tiny.setdefault(tuple(t), []).append(k)
        self.seeds: np.ndarray = np.empty(0, np.uint64)
        self.where: list[list[tuple[int, int]]] = []

    @staticmethod
    def runs(numbers: np.ndarray) -> np.ndarray:
        """A hash of each run of SEED words; different runs may share one, as the alignment decides."""
        out = np.zeros(max(len(numbers) - SEED + 1, 0), np.uint64)
        for k in range(SEED):
            out = (out ^ numbers[k : k + len(out)].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out

    def numbers(self, text: str) -> np.ndarray:
        """The numbers of a text's words; 0 for one that no item has."""
        own = split_words(text)
        get = self.number.get
        return np.fromiter((get(w, 0) for w in own), np.int64, len(own))

    def choose_seeds(self, counts: np.ndarray, total: int, documents: int) -> None:
        """Keep each item's rare runs. ``counts``: how often the corpus has each word."""
        share = np.maximum(counts, 1) / max(total, 1)
        chosen: dict[int, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            runs = self.runs(item)
            if len(item) < LEAST:
                for run in runs[:1]:
                    chosen.setdefault(int(run), []).append((k, 0))
                continue
            chance = sum(np.log(share[item[j : j + len(runs)]]) for j in range(SEED)) + np.log(max(total, 1) / max(documents, 1))
            for at in np.flatnonzero((chance < np.log(RARE)) | (chance <= np.median(chance))):
                chosen.setdefault(int(runs[at]), []).append((k, int(at)))
        self.seeds = np.array(sorted(chosen), np.uint64)
        self.where = [chosen[int(s)] for s in self.seeds]

    def matches(self, text: str | None) -> list[dict]:
        if not text:
            return []
        found = (self._lines(text) if self.tiny else []) + (self._passages(text) if len(self.seeds) else [])
        return [{"item": k, "score": score, "first_word": first, "last_word": last} for k, score, first, last in sorted(found)]

    def _lines(self, text: str) -> list[tuple[int, float, int, int]]:
        """Items of fewer words than a seed that are the words of a line, the first of equal ones."""
        found, at = {}, 0
        for line in text.split("\n"):
            own = split_words(line)
            for k in self.tiny.get(tuple(own), ()) if len(own) < SEED else ():
                found.setdefault(k, (k, 1.0, at, at + len(own) - 1))
            at += len(own)
        return list(found.values())

    def _passages(self, text: str) -> list[tuple[int, float, int, int]]:
        numbers = self.numbers(text)
        known = numbers != 0
        if len(known) < SEED:
            return []
        full = known[: len(known) - SEED + 1].copy()
        for k in range(1, SEED):
            full &= known[k : k + len(full)]
        places = np.flatnonzero(full)
        if not len(places):
            return []
        runs = self.runs(numbers)[places]
        at = np.minimum(np.searchsorted(self.seeds, runs), len(self.seeds) - 1)
        starts: dict[int, list[int]] = {}
        for place, seed in zip(places[hit := self.seeds[at] == runs], at[hit], strict=True):
            for item, offset in self.where[seed]:
                starts.setdefault(item, []).append(int(place) - offset)
        found = []
        for item, begins in starts.items():
            n = len(self.items[item])
            if n < LEAST:
                whole = [b for b in begins if np.array_equal(numbers[b : b + n], self.items[item])]
                found += [(item, 1.0, min(whole), min(whole) + n - 1)] if whole else []
                continue
            best = self._best(item, sorted(set(begins)), numbers)
            if best[0] >= MATCH * POINTS and (score := best[0] / (MATCH * n)) >= THRESHOLD:
                found.append((item, score, best[1], best[2]))
        return found

    def _best(self, item: int, begins: list[int], numbers: np.ndarray) -> tuple[int, int, int]:
        """The best alignment near any of the places where the item would begin."""
        own = self.items[item]
        slack, best, k = len(own) // 2 + 2, (0, 0, -1), 0
        while k < len(begins) and best[0] < MATCH * len(own):
            first = last = begins[k]
            while k < len(begins) and begins[k] - first <= 2 * len(own):
                last, k = begins[k], k + 1
            low = max(0, first - slack)
            score, begin, end = align(own, numbers[low : last + len(own) + slack])
            if score > best[0]:
                best = score, low + begin, low + end
        return best


def _count_words(docs: DataFrame, text: str, items: Items) -> tuple[np.ndarray, int, int]:
    """How often the whole corpus has each of the items' words, all its words, and its documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, documents = np.zeros(len(items.number) + 1, np.int64), 0
        for batch in batches:
            for part in slices(batch.column(0)):
                for value in part:
                    counts += np.bincount(items.numbers(value or ""), minlength=len(counts))
                documents += len(part)
        seen = np.flatnonzero(counts)
        word, n = np.append(seen, -1), np.append(counts[seen], documents)
        yield pa.RecordBatch.from_arrays([pa.array(word, pa.int64()), pa.array(n, pa.int64())], names=["word", "n"])

    counts, documents = np.zeros(len(items.number) + 1, np.int64), 0
    # one row for each word of a block of items at most, whatever the corpus
    for word, n in docs.select(F.col(text)).mapInArrow(count, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect():
        if word < 0:
            documents = n
        else:
            counts[word] = n
    return counts, int(counts.sum()), documents


def _blocks(benchmark: DataFrame, text: str, item_id: str, block_words: int) -> Iterator[tuple[list, Items]]:
    """The items' ids and the items, in blocks of about ``block_words`` words."""
    rows = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    size = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = 1 + int(size) // block_words
    for k in range(n):
        own = sorted(rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect(), key=lambda r: (r.item_id is None, r.item_id, r.text))
        if own:
            yield [r.item_id for r in own], Items([r.text for r in own])


def matches_column(items: Items, text: Column) -> Column:
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("score", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))
        for column in columns:
            yield pa.array([items.matches(t) for part in slices(column) for t in part], kind)

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, MATCHES)(text)


def _seeded(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, item_id: str, block_words: int) -> Iterator[tuple[list, Items]]:
    bounded_batches(docs)
    for ids, items in _blocks(benchmark, item_text, item_id, block_words):
        items.choose_seeds(*_count_words(docs, text, items))
        yield ids, items


def contaminations(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS
) -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, score, first_word, last_word."""
    kind = benchmark.schema[item_id].dataType.simpleString()
    out = docs.limit(0).select(F.col(doc_id).alias("doc_id"), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("score"), F.lit(0).alias("first_word"), F.lit(0).alias("last_word"))
    for ids, items in _seeded(docs, benchmark, text, item_text, item_id, block_words):
        found = docs.select(F.col(doc_id).alias("doc_id"), F.explode(matches_column(items, F.col(text))).alias("m"))
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        found = found.select("doc_id", "m.*").join(F.broadcast(names), "item").select("doc_id", "item_id", "score", "first_word", "last_word")
        out = out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without the contaminated ones, all columns kept."""
    out = docs
    for _, items in _seeded(docs, benchmark, text, item_text, item_id, block_words):
        out = out.filter(F.size(matches_column(items, F.col(text))) == 0)
    return out
