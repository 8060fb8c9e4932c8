"""Quality scores by compression: which of two zstandard dictionaries, of good or of bad text, helps a text more.

The dictionaries are trained on half of a bounded sample of labelled texts of each class. A text's feature is the size
that it has under the dictionary of bad text, less the size under that of good text, as a share of its own size. Blocks
of ``BLOCK`` bytes are compressed on their own, all of them, so that a long text's history doesn't stand in for the
dictionaries, and their differences are summed. The other half of the sample fits a logistic curve from the feature to the share of good texts, the calibrated score.

The sample holds at most ``sample`` labelled documents of each class, chosen by a hash of the id; every row is scored,
over its whole text, and from its text alone.

Defined results: a null text is an empty one, whose feature is 0. Labels that are null or of a null id teach nothing, a
label other than 0 counts as 1, and a document with both labels teaches both. With no label of one class, or none at
all, the score is the smoothed share of good labels. Of several texts of an id the least teaches. Further columns are
ignored. Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.langid import held_out
from skein.llm.shared import bounded_batches, slices

#: Bounds of what is learned: labelled documents of each class, bytes of a dictionary, bytes of a training sample.
SAMPLE = 3000
DICTIONARY = 112_640
TRAIN_BYTES = 1 << 16
LEVEL = 3
#: Bytes of a text that are compressed together.
BLOCK = 4096


def parts(text: bytes) -> list[bytes]:
    """The whole text in training samples of at most ``TRAIN_BYTES``."""
    return [text[k : k + TRAIN_BYTES] for k in range(0, max(len(text), 1), TRAIN_BYTES)]


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the texts themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[-DICTIONARY:].rjust(8)


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton's method with a little ridge."""
    rows, beta = np.c_[x, np.ones(len(x))], np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        slope = rows.T @ (p - y) + 1e-3 * beta
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + 1e-3 * np.eye(2), slope)
        beta -= np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


@dataclass
class Scorer:
    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0
    scale: float = 1.0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def _compressors(self) -> tuple:
        if "_pair" not in self.__dict__:
            made = []
            for raw in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(raw)
                known.precompute_compress(level=LEVEL)
                made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False))
            self.__dict__["_pair"] = tuple(made)
        return self.__dict__["_pair"]

    def feature(self, text: bytes) -> float:
        if not text or not self.good:
            return 0.0
        good, bad = (sum(len(c.compress(text[k : k + BLOCK])) for k in range(0, len(text), BLOCK)) for c in self._compressors())
        return (bad - good) / len(text)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.feature(text) * self.scale + self.offset, -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Scorer:
    """A scorer from at most ``sample`` labelled documents of each class."""
    marks = labels.select(F.col(doc_id).alias("id"), (F.col(label) != 0).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").distinct()
    some = [marks.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "id")
    taught = sorted(((r.y, r.text.encode()) for r in rows.groupBy("id", "y").agg(F.min("text").alias("text")).collect()), key=lambda r: (r[0], len(r[1]), r[1]))
    by = {y: [t for k, t in taught if k == y] for y in (0, 1)}
    prior = (len(by[1]) + 1) / (len(taught) + 2)
    if len(by[0]) < 2 or len(by[1]) < 2:
        return Scorer(b"", b"", 0.0, float(np.log(prior / (1 - prior))))
    scorer = Scorer(*(dictionary([part for t in by[y][::2] for part in parts(t)]) for y in (1, 0)))
    held = [(scorer.feature(t), y) for y in (0, 1) for t in by[y][1::2]]
    x, y = np.array([h[0] for h in held]), np.array([h[1] for h in held], float)
    scorer.scale = float(1 / (x.std() or 1))
    scorer.slope, scorer.offset = fit_curve(x * scorer.scale, y)
    return scorer


def score_column(scorer: Scorer, text: Column) -> Column:
    def batches(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            yield pa.array([scorer.score(t or b"") for part in slices(column.cast(pa.binary())) for t in part], pa.float64())

    batches.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Learns from the labels not held out."""
    bounded_batches(docs)
    scorer = learn(docs, labels.filter(~held_out(F.col(doc_id), 3, 1)), text, doc_id, label)
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id), 3, 1).alias("held_out"), score_column(scorer, F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
