"""Language identification by rank-order profiles of character n-grams.

A profile lists the most frequent letter n-grams (one to three letters, words padded with a boundary) of a language in
order of frequency. A document's own most frequent n-grams are ranked the same way; its distance to a language is the
sum, over them, of how far each is out of place, or the profile's length where it is missing. The language at the
least distance wins. Equal counts are ordered by the n-gram itself, equal distances by the language's name.

Profiles are learned from at most ``sample`` labelled documents per language, chosen by a hash of the id; everything
else reads whole texts of all rows. Only the text enters a prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0. The score is one minus the distance's
share of its maximum. Rows with a null language, text or id teach nothing; without a row to learn from, every document is
``und``. Of several texts of an id with one language the least teaches. Repeated rows and ties give equal results. Empty
tables give empty results. Further columns are kept by ``keep_identified`` and otherwise ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.shared import bounded_batches, slices, small_or_shuffled, stage

UNKNOWN = "und"
#: Bounds of what is learned: documents per language, and n-grams per profile (also per document).
SAMPLE = 300
RANKS = 400
#: Times as many ids as are sampled are looked at in the last step.
SPARE = 20
#: Code points of a text that are counted at a time.
CHUNK = 1 << 20
PREDICTION = "struct<lang:string,score:double>"

_letters: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """For each code point, whether it is a letter; built once in a process."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text's words, as numbers, and how often each occurs."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_letter_table()[codes], codes, 0)
    codes = np.r_[0, codes, 0]
    codes = codes[np.r_[True, (codes[1:] != 0) | (codes[:-1] != 0)]]
    found, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(0, max(len(codes) - 1, 0), CHUNK):
        c = codes[at : at + CHUNK + 2]
        own = c[:CHUNK]
        one = own[own != 0]
        a, b = c[:-1][:CHUNK], c[1:][:CHUNK]
        two = (a << 21 | b | 1 << 62)[(a != 0) | (b != 0)]
        x, y, z = c[:-2][:CHUNK], c[1:-1][:CHUNK], c[2:][:CHUNK]
        three = (x << 42 | y << 21 | z)[y != 0]
        part, n = np.unique(np.concatenate([one, two, three]), return_counts=True)
        if not len(found):
            found, counts = part, n
        else:
            found, where = np.unique(np.concatenate([found, part]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
    return found, counts


def ranked(found: np.ndarray, counts: np.ndarray, ranks: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; equal counts in the n-grams' order."""
    if len(found) > ranks:
        least = np.partition(counts, len(counts) - ranks)[len(counts) - ranks]
        keep = counts >= least
        found, counts = found[keep], counts[keep]
    return found[np.lexsort((found, -counts))[:ranks]]


class Profiles:
    """Ranks of each language's n-grams, and the prediction for a text."""

    def __init__(self, by_lang: dict[str, np.ndarray], ranks: int = RANKS):
        self.langs, self.ranks = sorted(by_lang), ranks
        self.known = np.unique(np.concatenate([np.empty(0, np.int64), *by_lang.values()])).astype(np.int64)
        self.place = np.full((len(self.langs), len(self.known) + 1), -1, np.int64)
        for row, lang in zip(self.place, self.langs, strict=True):
            row[np.searchsorted(self.known, by_lang[lang])] = np.arange(len(by_lang[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = ranked(*grams(text), self.ranks) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        place = self.place[:, at]
        distances = np.where(place < 0, self.ranks, np.abs(place - np.arange(len(own)))).sum(axis=1)
        best = int(distances.argmin())
        return self.langs[best], float(1 - distances[best] / (len(own) * self.ranks))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE, ranks: int = RANKS) -> Profiles:
    """Profiles from at most ``sample`` documents per language, the first by a hash of their ids."""
    bounded_batches(docs)
    unit = F.shiftrightunsigned(F.xxhash64("id"), 11).cast("double") * F.lit(2.0**-53)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    usable = rows.filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("id", "lang", unit.alias("u"))
    sizes = stage(usable.groupBy(F.col("lang").alias("of")).agg(F.approx_count_distinct("id").alias("size")), "language-sizes")
    # the first by hash lie below a bound that some SPARE times as many ids do, so the last step sees no more of any language
    low = usable.join(small_or_shuffled(sizes), F.col("lang") == F.col("of")).filter(F.col("u") < F.lit(float(SPARE * sample)) / F.col("size"))
    first = Window.partitionBy("lang").orderBy("u", "id")
    chosen = low.dropDuplicates(["id", "lang"]).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= sample).select("id", "lang")
    taught = rows.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text"))
    by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for row in taught.collect():
        by_lang.setdefault(row.lang, []).append(grams(row.text or ""))
    profiles = {}
    for name, parts in by_lang.items():
        found, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        if len(found):
            profiles[name] = ranked(found, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64), ranks)
    return Profiles(profiles, ranks)


def prediction(profiles: Profiles, text: Column) -> Column:
    """A struct of lang and score for each text."""

    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            found = [profiles.predict(t) for part in slices(column) for t in part]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang", "score"])

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, PREDICTION)(text)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether a document belongs to the part that nothing is learned from. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. Learns from the rows not held out."""
    out = held_out(F.col(doc_id), 5, 0)
    found = docs.select(F.col(doc_id).alias("doc_id"), out.alias("held_out"), prediction(learn(docs.filter(~out), text, lang, doc_id), F.col(text)).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without those of unknown language, all columns kept. Learns from all labelled rows."""
    return docs.filter(prediction(learn(docs, text, lang, doc_id), F.col(text))["lang"] != UNKNOWN)
