"""Toxicity by compression distance: which of two zstandard dictionaries makes a window of text shorter.

Both dictionaries hold the byte runs that most ordinary training texts share. The toxic one also holds the runs that
mark toxic training texts: runs that are frequent in them and nearly absent from ordinary ones, chosen one by one so
that every toxic text is covered several times. A run is common if many different texts have it, so copies add nothing.
Whole texts are cut at spaces into windows of about ``WINDOW`` bytes; the gain of a window is its compressed length with
the ordinary dictionary less that with the toxic one. Counts of windows by gain go through a logistic function that is
calibrated on labelled texts the dictionaries have not seen.

The classifier is fitted on a sample of at most ``TOXIC_SAMPLE`` + ``ORDINARY_SAMPLE`` labelled texts, whole ones as in
scoring. Scores are for the mix of all labelled training rows, which are counted, not for that of the sample. Everything
else covers all rows and whole texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promolift.llm.common import drop_paths, map_batches, slices, written

WINDOW = 64
RUN = 5
TOXIC_SAMPLE = 2000
ORDINARY_SAMPLE = 5000
COMMON_RUNS = 6000
COVER = 4
LEAST_TEXTS = 5
FOLDS = 4
THRESHOLD = 0.7

#: In front of every window and at the end of both dictionaries. It makes every window worth compressing: zstandard
#: stores a block as it is unless that saves some bytes, which would hide a single match.
_PREAMBLE = bytes(range(1, 25)) * 2
_PLAIN = bytes(byte + 32 if 65 <= byte <= 90 else max(byte, 32) for byte in range(256))
_WORD = re.compile(rb" [^ \n]+")


def windows(text: str | None) -> list[bytes]:
    """The whole text, A-Z lower-cased and control characters as spaces, cut before spaces where there are any."""
    data = b" " + (text or "").encode().translate(_PLAIN)
    out, start = [], 0
    while start < len(data):
        stop = start + WINDOW
        if stop < len(data):
            space = data.rfind(b" ", start + 1, stop + 1)
            stop = space if space > start else stop
        out.append(data[start:stop])
        start = stop
    return out


def _runs(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The different byte runs of one text's windows (joined by line feeds, which windows never hold), as numbers, and
    the share of the windows that have each.

    A run lies within a word, or begins with the space before it.
    """
    codes = np.frombuffer(joined, np.uint8).astype(np.uint64)
    if len(codes) < RUN:
        return codes[:0], np.zeros(0)
    window = np.cumsum(codes == 10).astype(np.uint64)
    parts = [codes[at : len(codes) - RUN + 1 + at] for at in range(RUN)]
    number, kept = np.zeros(len(parts[0]), np.uint64), parts[0] != 10
    for at, part in enumerate(parts):
        number = number << np.uint64(8) | part
        kept &= (part != 10) & ((part != 32) | (at == 0))
    bits = np.uint64(64 - 8 * RUN)  # left for the window's number
    in_windows = np.unique(number[kept] << bits | window[: len(number)][kept] & ((np.uint64(1) << bits) - np.uint64(1)))
    runs, counts = np.unique(in_windows >> bits, return_counts=True)
    return runs, counts / (float(window[-1]) + 1)


def _bytes(run: int) -> bytes:
    return int(run).to_bytes(RUN, "big")


def _parts(word: bytes) -> list[bytes]:
    return [word[at : at + RUN] for at in range(len(word) - RUN + 1)]


#: Runs, ascending, the number of texts that have each, and the sum of those texts' shares.
Counts = tuple[np.ndarray, np.ndarray, np.ndarray]


def _summed(tables: list[Counts]) -> Counts:
    runs, place = np.unique(np.concatenate([table[0] for table in tables]), return_inverse=True)
    counts, shares = (np.bincount(place, np.concatenate([table[k] for table in tables]), len(runs)) for k in (1, 2))
    return runs, counts.astype(np.int64), shares


def _counted(runs: Iterable[tuple[np.ndarray, np.ndarray]]) -> Counts:
    """The sums over texts, some texts at a time."""
    total = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0)
    for some in batched(runs, 256):
        total = _summed([total, *((own, np.ones(len(own), np.int64), shares) for own, shares in some)])
    return total


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_LAZY2,
        min_match=RUN,
        window_log=17,
        chain_log=14,
        hash_log=14,
        search_log=4,
        target_length=16,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content + _PREAMBLE, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


@lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
    return _compressor(ordinary), _compressor(toxic)


@dataclass(frozen=True)
class Model:
    """``center``, ``spread`` and ``weights`` are of the logistic function; None where there was nothing to learn."""

    ordinary: bytes
    toxic: bytes
    center: tuple[float, ...] | None = None
    spread: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()

    def features(self, own: list[bytes]) -> list[float]:
        ordinary, toxic = (one.compress for one in _compressors(self.ordinary, self.toxic))
        gains = np.array([len(ordinary(window)) - len(toxic(window)) for window in map(_PREAMBLE.__add__, own)])
        return [
            float(min(gains.max(), 6)),
            *(float(np.log1p((gains >= least).sum())) for least in (1, 2, 3)),
            float(np.log1p(len(gains))),
            float((gains >= 2).mean()),
        ]

    def score(self, text: str | None) -> float:
        if self.center is None:
            return 0.0
        own = (np.array(self.features(windows(text))) - self.center) / self.spread
        return float(1 / (1 + np.exp(-np.clip(own @ self.weights[:-1] + self.weights[-1], -500, 500))))


def common_runs(runs: np.ndarray, counts: np.ndarray) -> bytes:
    """The most widespread runs, the most frequent last, where they are nearest to a window."""
    order = np.lexsort((runs, -counts))[:COMMON_RUNS]
    return b"".join(_bytes(run) for run in runs[order[::-1]])


def telling_runs(
    toxic: list[bytes],
    toxic_runs: list[tuple[np.ndarray, np.ndarray]],
    ordinary: Counts,
    n_ordinary: int,
    half_text: float,
) -> list[bytes]:
    """Byte strings that mark toxic texts, by greedy cover.

    Frequencies are mean shares of a text's windows, so that a mark or two in a long ordinary text weigh little.
    ``half_text``, the share of half a text with one window of the mean number, is added to those in ordinary texts.
    """
    runs, counts, shares = _counted(toxic_runs)
    least = max(LEAST_TEXTS, 0.01 * len(toxic))
    runs, shares = runs[counts >= least], shares[counts >= least]
    at = np.minimum(np.searchsorted(ordinary[0], runs), len(ordinary[0]) - 1)
    seen = np.where(ordinary[0][at] == runs, ordinary[2][at], 0)
    ratios = shares / len(toxic) / ((seen + half_text) / n_ordinary)
    odds = {_bytes(run): ratio for run, ratio in zip(runs, ratios) if ratio >= 20}
    known = runs[ratios >= 20]
    texts, words = defaultdict(list), Counter()
    for place, (joined, (own, _)) in enumerate(zip(toxic, toxic_runs)):
        found = own[np.isin(own, known)]
        for run in found:
            texts[_bytes(run)].append(place)
        if len(found):
            words.update({word for word in set(_WORD.findall(joined)) if any(part in odds for part in _parts(word))})
    texts = {run: np.array(places) for run, places in texts.items()}
    word_of: dict[bytes, bytes] = {}
    for word, _ in sorted(words.items(), key=lambda pair: (-pair[1], pair[0])):
        for part in _parts(word):
            if part in odds:
                word_of.setdefault(part, word)
    missing, left, chosen = np.full(len(toxic), COVER), set(odds), []
    while left:
        gain = {run: int((missing[texts[run]] > 0).sum()) for run in left}
        left = {run for run in left if gain[run] >= least}
        if not left:
            break
        best = max(left, key=lambda run: (gain[run] * np.log(odds[run]), run))
        word = word_of.get(best, best)
        start = word.index(best)
        stop = start + RUN
        while start and word[start - 1 : start - 1 + RUN] in odds:
            start -= 1
        while stop < len(word) and word[stop + 1 - RUN : stop + 1] in odds:
            stop += 1
        whole = word[start:stop]
        chosen.append(whole)
        own = {whole[at : at + RUN] for at in range(len(whole) - RUN + 1)}
        missing[np.unique(np.concatenate([texts[run] for run in own]))] -= 1
        left -= own
    return chosen


def _calibrated(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps."""
    center, spread = features.mean(0), features.std(0) + 1e-9
    design = np.column_stack(((features - center) / spread, np.ones(len(features))))
    weights = np.zeros(design.shape[1])
    for _ in range(40):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + 0.01 * np.eye(len(weights))
        weights -= np.linalg.solve(curve, design.T @ (chance - labels) + 0.01 * weights)
    return center, spread, weights


class _Sides:
    """The training texts as windows joined by line feeds, dealt into FOLDS folds. Of ordinary texts only the counts of
    their runs are kept, by fold."""

    def __init__(self, ordinary: list[bytes], toxic: list[bytes]):
        self.n_ordinary = len(ordinary)
        self.half_text = 0.5 * len(ordinary) / sum(text.count(b"\n") + 1 for text in ordinary)
        self.counts = [_counted(map(_runs, ordinary[fold::FOLDS])) for fold in range(FOLDS)]
        self.toxic = toxic
        self.toxic_runs = [_runs(text) for text in toxic]

    def dictionaries(self, without: int | None = None) -> Model:
        """Both dictionaries, from all texts or from those outside a fold."""
        inside = lambda values: [one for at, one in enumerate(values) if at % FOLDS != without]
        common = _summed([table for fold, table in enumerate(self.counts) if fold != without])
        n_ordinary = len(inside(range(self.n_ordinary)))
        base = common_runs(*common[:2])
        telling = telling_runs(inside(self.toxic), inside(self.toxic_runs), common, n_ordinary, self.half_text)
        return Model(base, base + b"\0".join(reversed(telling)))


def _key(joined: bytes) -> bytes:
    return hashlib.blake2b(joined, digest_size=16).digest()


def _sampled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        chosen = [b"\n".join(windows(text)) for text in batch.column("text").to_pylist()]
        columns = [pa.array(chosen, pa.binary()), batch.column("label")]
        yield pa.RecordBatch.from_arrays(columns, ["windows", "label"])


class _Features:
    """Features of all windows of the sampled texts, as the dictionaries without the text's fold see them."""

    def __init__(self, models: list[Model], folds: dict[bytes, int]):
        self.models, self.folds = models, folds

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, features = [], []
            for text in batch.column("text").to_pylist():
                own = windows(text)
                keys.append(_key(b"\n".join(own)))
                features.append(self.models[self.folds[keys[-1]]].features(own))
            columns = [pa.array(keys, pa.binary()), pa.array(features, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "features"])


def fit(texts: list[tuple[bytes, int]], sample: DataFrame, favour: float) -> Model:
    """A model from the sampled texts, as whole texts of windows joined by line feeds, and their labels.

    ``favour`` is the logarithm of how much more often a toxic text was drawn than an ordinary one; it is taken off the
    log-odds, so that scores mean the same for any sample. Texts with equal windows count once. The calibration sees
    each text as dictionaries without its fold do.
    """
    unique = sorted({text: label for text, label in sorted(texts)}.items())
    ordinary, toxic = ([text for text, found in unique if found == label] for label in (0, 1))
    if min(len(ordinary), len(toxic)) < FOLDS:
        return Model(b"", b"")
    labels = {_key(text): label for text, label in unique}
    folds = {_key(text): at % FOLDS for side in (ordinary, toxic) for at, text in enumerate(side)}
    sides = _Sides(ordinary, toxic)
    models = [sides.dictionaries(without=fold) for fold in range(FOLDS)]
    seen = map_batches(sample, _Features(models, folds), "key binary, features array<double>").toArrow()
    features = dict(sorted(zip(seen["key"].to_pylist(), seen["features"].to_pylist()), reverse=True))
    fitted = _calibrated(np.array(list(features.values())), np.array([labels[key] for key in features], float))
    fitted[2][-1] -= favour
    whole = sides.dictionaries()
    return Model(whole.ordinary, whole.toxic, *(tuple(values.tolist()) for values in fitted))


def train(
    documents: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text"
) -> Model:
    """A model from labelled rows for whose id ``learn`` holds, drawn by a hash of the id.

    Null ids and labels are left out; of several labels of an id the toxic one counts. Without toxic or without
    ordinary texts every score is 0.
    """
    known = labels.where(learn & F.col(id_column).isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy(F.col(id_column).alias("id")).agg(F.max("toxic").alias("label"))
    most_of = ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE))
    counts = dict(known.groupBy("label").count().where(F.col("label").isin(0, 1)).collect())
    shares = {label: min(1.0, most / counts[label]) for label, most in most_of if label in counts}
    drawn = None
    for label, most in most_of:
        part = known.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(most)
        drawn = part if drawn is None else drawn.union(part)
    texts = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    found = texts.join(F.broadcast(drawn), "id").dropDuplicates(["id"]).select("text", "label")
    sample, path = written(found, "toxicity-sample")
    rows = map_batches(sample, _sampled_windows, "windows binary, label int").toArrow()
    favour = math.log(shares.get(1, 1.0) / shares.get(0, 1.0))
    model = fit(list(zip(rows["windows"].to_pylist(), rows["label"].to_pylist())), sample, favour)
    drop_paths(documents.sparkSession, [path])
    return model


class _Score:
    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            scores = [self.model.score(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], ["id", "score"])


class _Keep:
    def __init__(self, model: Model, text_column: str):
        self.model, self.text_column = model, text_column

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(self.text_column).to_pylist()
            yield batch.filter(pa.array([self.model.score(text) < THRESHOLD for text in texts], pa.bool_()))


def score(model: Model, frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``frame``: id, score in 0 to 1, and predicted (1 from THRESHOLD on).

    A null text counts as empty and is scored as such. Other columns, whatever their names, are not read; an empty
    table gives an empty result.
    """
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    scored = map_batches(rows, _Score(model), "id long, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(model: Model, frame: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``frame`` with a score under THRESHOLD, with all their columns.

    Null and empty texts are scored as empty; null ids and repeated rows stay or go by their text; an empty table stays
    empty.
    """
    return map_batches(frame, _Keep(model, text_column), frame.schema)
