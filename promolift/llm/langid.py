"""Language identification with error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit, over hashed byte n-grams, tells the languages
whose bit is 1 from those whose bit is 0: its weights are log ratios of the two groups' mean n-gram frequencies, every
language counting the same. A text goes to the language whose codeword has the smallest loss over all bits, each bit
weighted by how far it holds its two groups apart; a text whose two nearest codewords are almost as near is ambiguous.

Counts are taken over all training texts, summed per language by Spark; the model that goes to the tasks has
``BUCKETS`` numbers per bit, whatever the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import map_batches, slices

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 13
AMBIGUITY = 0.1
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_PLAIN = bytes(
    byte + 32 if 65 <= byte <= 90 else byte if 97 <= byte <= 122 or byte >= 128 else 32 for byte in range(256)
)
# Odd multipliers of a multiplicative hash, one per n-gram order.
_FACTORS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))
_SHIFT = np.uint32(32 - 13)


def buckets(data: bytes) -> Iterator[np.ndarray]:
    """Per order, the bucket of every n-gram of the normalised bytes."""
    codes = np.frombuffer(data.translate(_PLAIN), np.uint8).astype(np.uint32)
    grams = np.zeros(len(codes), np.uint32)
    for order, factor in zip(ORDERS, _FACTORS):
        if len(codes) < order:
            return
        grams = (grams[: len(codes) - order + 1] << np.uint32(8)) | codes[order - 1 :]
        yield ((grams * factor) >> _SHIFT).astype(np.int32)


def counts_of(text: str | None) -> np.ndarray:
    """Times each bucket occurs in the whole text."""
    data = (text or "").encode()
    total = np.zeros(BUCKETS, np.int64)
    for start in range(0, len(data), 1 << 20):  # n-grams across a cut are counted in the piece they begin in
        for order, found in zip(ORDERS, buckets(data[start : start + (1 << 20) + ORDERS[-1] - 1])):
            total += np.bincount(found[: 1 << 20], minlength=BUCKETS)
    return total


def codewords(languages: int) -> np.ndarray:
    """A row of +1 / -1 per language: all splits of up to 7 languages in two, else random rows far apart."""
    if languages <= 1:
        return np.ones((languages, 1), np.int8)
    if languages <= 7:
        splits = [(1, *rest) for rest in product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(splits, np.int8).T
    random = np.random.default_rng(languages)
    length = 10 * int(np.ceil(np.log2(languages)))
    best, apart = None, -1
    for _ in range(200):
        rows = random.choice(np.array([-1, 1], np.int8), (languages, length))
        distance = ((length - rows.astype(int) @ rows.T.astype(int)) // 2 + length * np.eye(languages, dtype=int)).min()
        if distance > apart and (np.abs(rows.sum(0)) < languages).all():
            best, apart = rows, distance
    return best


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def losses(self, counts: np.ndarray) -> np.ndarray:
        """Weighted loss of every codeword (columns) for every row of bucket counts."""
        total = np.maximum(counts.sum(1, keepdims=True), 1)
        margins = (counts @ self.weights.T) / total / self.scale
        loss = np.logaddexp(0, -4 * margins[:, None, :] * self.codes[None])
        return (loss * self.trust).sum(2)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, ambiguous); the unknown language for texts without a letter."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        losses = self.losses(counts_of(text)[None])[0]
        shares = np.exp(2 * (losses.min() - losses))
        shares /= shares.sum()
        order = np.argsort(losses, kind="stable")
        near = len(order) > 1 and losses[order[1]] - losses[order[0]] < AMBIGUITY
        return self.languages[order[0]], float(shares[order[0]]), bool(near)


def fitted(languages: list[str], counts: np.ndarray) -> Model:
    """The classifiers of all bits from one row of bucket counts per language."""
    codes = codewords(len(languages)).astype(np.float64)
    frequency = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True) if len(languages) else np.ones((0, BUCKETS))
    weights = []
    for bit in codes.T if len(languages) > 1 else ():
        weights.append(np.log(frequency[bit > 0].mean(0)) - np.log(frequency[bit < 0].mean(0)))
    weights = np.array(weights) if weights else np.zeros((codes.shape[1], BUCKETS))
    expected = frequency @ weights.T * codes  # how clearly each language's own text says its bit
    scale = np.maximum(np.abs(expected).mean(0) if len(languages) else np.ones(codes.shape[1]), 1e-9)
    trust = np.maximum(expected.min(0) / scale if len(languages) else 1.0, 0.05) * np.ones(codes.shape[1])
    return Model(languages, codes, weights, scale, trust / trust.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            totals[language] = totals.get(language, 0) + counts_of(text)
    for language, total in totals.items():
        seen = np.flatnonzero(total)
        columns = [pa.array([language] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(total[seen])]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])


def train(rows: DataFrame, learn: Column, text_column: str = "text", language_column: str = "lang") -> Model:
    """A model from all rows for which ``learn`` holds and text and language are not null.

    At most BUCKETS numbers per language reach the driver. Without such rows the model knows no language and answers
    ``und``; with one language it always answers that one.
    """
    chosen = rows.where(learn & F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(language_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text")
    )
    counted = map_batches(chosen, _count, "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), BUCKETS))
    at = {language: place for place, language in enumerate(languages)}
    counts[sums["lang"].map(at).to_numpy(int), sums["bucket"].to_numpy(int)] = sums["n"].to_numpy()
    return fitted(languages, counts)


class _Predict:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.float64(), pa.bool_()]
        for batch in slices(batches):
            found = [self.model.predict(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "lang_pred", "score", "ambiguous"])


def identify(model: Model, frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``frame``: id, lang_pred, score and ambiguous.

    Null texts and texts without a letter are ``und`` with score 0 and count as ambiguous. Other columns, whatever
    their names, are not read; an empty table gives an empty result.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_batches(rows, _Predict(model), "id long, lang_pred string, score double, ambiguous boolean")
