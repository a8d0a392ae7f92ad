"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Scores cost time linear in the features: the pairwise term is half of the sum, over factors, of the
squared sum of the factor-weighted features less the sum of their squares.

Features: the presence of each lower-cased word (hashed, each 1 / sqrt(number of different words)),
standardised structure statistics of the whole text, and as metadata its length and number of lines.
Labels, language, source and id are never inputs.  The model is fitted on at most `sample` labelled
rows (in the order of a hash of the id), which bounds what reaches the driver; it is then broadcast
(less than 2 MB) and every row is scored beside the scan, without a shuffle.

Null texts count as empty; an empty text has a score like any other.  Without labels of both kinds
every score is the share of label 1 (0.5 without labels).  Labels that are null are left out; of
labels that repeat an id each counts.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import plain_text, ship_package

#: Labelled rows to fit on at most; hashed words; factors; passes over the sample.
SAMPLE, WORDS, FACTORS, EPOCHS = 6000, 1 << 14, 8, 12

_UPPER, _DIGITS, _LETTERS = (bytes(x) for x in (range(65, 91), range(48, 58), [*range(65, 91), *range(97, 123)]))
_MARKS = bytes(x for x in range(33, 127) if not chr(x).isalnum())


def structure(data: bytes, words: list[bytes], different: int) -> list[float]:
    """Statistics of a whole text, each of bounded size."""
    n, m = max(1, len(data)), max(1, len(words))
    marks = n - len(data.translate(None, _MARKS)) if data else 0
    lines = data.count(b"\n") + 1
    return [
        (len(data) - len(data.translate(None, _UPPER))) / n,
        (len(data) - len(data.translate(None, _DIGITS))) / n,
        (len(data) - len(data.translate(None, _LETTERS))) / n,
        marks / n,
        (data.count(b".") + data.count(b",")) / m,
        data.count(b"|") / m,
        (data.count(b"!") + data.count(b"#") + data.count(b"$") + data.count(b"%") + data.count(b"&") + data.count(b"*")) / m,
        different / m,
        sum(map(bytes.__eq__, words, words[1:])) / m,
        min(50.0, n / m),
        min(8.0, float(np.log1p(m / lines))),
        float(np.log1p(len(data))),
        float(np.log1p(lines)),
        1.0 if not words else 0.0,
    ]


def features(text: str) -> tuple[np.ndarray, list[float]]:
    """Hashed words that occur, and the statistics."""
    data = text.encode()
    words = data.split()
    there = {x.lower() for x in words}
    hashed = np.fromiter(map(zlib.crc32, there), np.int64, len(there)) & (WORDS - 1)
    return hashed, structure(data, words, len(set(words)))


@dataclass
class Machine:
    """Weights of the machine; statistics come after the words."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def parts(self, hashed: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        places = np.concatenate((hashed, WORDS + np.arange(len(stats))))
        x = np.concatenate((np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.clip((stats - self.mean) / self.scale, -5, 5)))
        return places, x

    def margin(self, places: np.ndarray, x: np.ndarray) -> tuple[float, np.ndarray]:
        """The value before the link, and the factor-weighted sums; linear in the number of features."""
        weighted = self.factors[places] * x[:, None]
        sums = weighted.sum(axis=0)
        pairs = 0.5 * float((sums * sums).sum() - (weighted * weighted).sum())
        return self.bias + float(self.weights[places] @ x) + pairs, sums

    def score(self, text: str) -> float:
        hashed, stats = features(text)
        margin, _ = self.margin(*self.parts(hashed, np.array(stats)))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def fitted(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Machine:
    """By adaptive gradient steps on the logistic loss, the kinds weighted alike."""
    width = len(structure(b"", [], 0))
    kinds = [y for _, _, y in rows]
    share = sum(kinds) / len(kinds) if kinds else 0.5
    stats = np.array([s for _, s, _ in rows]) if rows else np.zeros((1, width))
    scale = stats.std(axis=0)
    rng = np.random.default_rng(7)
    machine = Machine(
        0.0,
        np.zeros(WORDS + width, np.float32),
        rng.normal(0, 0.02, (WORDS + width, FACTORS)).astype(np.float32),
        stats.mean(axis=0),
        np.where(scale > 1e-9, scale, 1.0),
    )
    if not rows or not 0 < share < 1:
        machine.bias = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
        machine.factors[:] = 0
        return machine
    ready = [(*machine.parts(h, s), y) for h, s, y in rows]
    seen_w, seen_v, seen_b = np.full(WORDS + width, 1e-6), np.full((WORDS + width, FACTORS), 1e-6), 1e-6
    weight = {1: 0.5 / share, 0: 0.5 / (1 - share)}
    for _ in range(EPOCHS):
        for k in rng.permutation(len(ready)):
            places, x, y = ready[k]
            margin, sums = machine.margin(places, x)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y) * weight[y]
            seen_b += g * g
            machine.bias -= 0.1 * g / seen_b**0.5
            step = g * x + 1e-5 * machine.weights[places]
            seen_w[places] += step * step
            machine.weights[places] -= 0.1 * step / np.sqrt(seen_w[places])
            v = machine.factors[places]
            step = g * (x[:, None] * sums - v * (x * x)[:, None]) + 1e-4 * v
            seen_v[places] += step * step
            machine.factors[places] -= 0.03 * step / np.sqrt(seen_v[places])
    return machine


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most: int, learn: Column, id_col: str, text_col: str
) -> DataFrame:
    """At most `most` rows (text, y) of `docs` with a label, in the order of a hash of the id."""
    some = labels.where(F.col(label).isin(0, 1) & learn & F.col(id_col).isNotNull())
    some = some.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("y"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "y").limit(most)
    return docs.join(F.broadcast(some), F.col(id_col) == F.col("__id")).select(plain_text(docs, text_col).alias("text"), "y")


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; -1 for a null id, which no fold holds out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(-1))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", sample: int = SAMPLE) -> Machine:
    """The machine, fitted on a bounded sample; only hashed features reach the driver."""
    ship_package(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h.astype("<u2").tobytes() for h, _ in found], pa.binary()),
                    pa.array([np.array(s, "<f8").tobytes() for _, s in found], pa.binary()),
                    batch.column(1),
                ],
                names=["words", "stats", "y"],
            )

    rows = labelled_sample(docs, labels, label, sample, learn, id_col, text_col)
    rows = rows.mapInArrow(work, "words binary, stats binary, y int").collect()
    rows.sort(key=lambda r: (bytes(r[1]), bytes(r[0]), r[2]))  # the order of tasks must not matter
    return fitted([(np.frombuffer(r[0], "<u2").astype(np.int64), np.frombuffer(r[1], "<f8"), r[2]) for r in rows])


def scores(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score and predicted of every row."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())],
                names=["__id", "score", "predicted"],
            )

    rows = docs.select(F.col(id_col).alias("__id"), plain_text(docs, text_col).alias("text"))
    schema = T.StructType(
        [
            T.StructField("__id", rows.schema[0].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("predicted", T.IntegerType()),
        ]
    )
    return rows.mapInArrow(work, schema).withColumnRenamed("__id", id_col)
