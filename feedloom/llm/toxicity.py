"""Toxicity by compression distance: two zstandard dictionaries, window by window.

One dictionary is trained on windows of ordinary texts, one on windows of toxic texts, from which the words are
left out that ordinary texts use about as often, so that the trainer spends its bytes on what sets them apart. A window is compressed with the ordinary dictionary alone and with both, and costs the same
unless it holds what the toxic one holds. The differences of a text's windows are calibrated by logistic
regression, for which each labelled text is measured under dictionaries that were trained without it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import batch, utf8

WINDOW = 12
#: The bounded sample of labelled rows: so many documents of each class.
SAMPLE = {1: 1500, 0: 4500}
FOLDS = 5
ORDINARY_BYTES = 65536
#: Bytes of a word's beginning that count as a unit too.
STEM = 6


@dataclass(frozen=True)
class Settings:
    """What the toxic dictionary is made of."""

    #: A word stays in the toxic windows if chance explains its share of toxic texts so badly (log-likelihood ratio); 0 keeps all.
    evidence: float
    #: Its size, and the segments and matches of its trainer, in bytes.
    size: int
    segment: int
    match: int
    #: Whether windows are compressed with the toxic dictionary alone, or with it behind the ordinary one.
    alone: bool = False


PUNCTUATION = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
THRESHOLD = 0.7
#: What training chooses from, by cross-validation on its own rows. Others were compared the same way, on training rows of sf0.1 and check_s: whole windows
#: (evidence 0) with 16 or 64 KB gave areas of 0.66 to 0.67 on sf0.1, alone or behind the ordinary dictionary, and other segments and sizes no lower loss.
SETTINGS = (Settings(30, 512, 20, 8), Settings(30, 1024, 20, 8), Settings(60, 1024, 20, 8))
SCORES = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def words(text: bytes) -> list[bytes]:
    return text.decode().lower().encode().translate(PUNCTUATION).split()


def windows(text: bytes) -> list[bytes]:
    parts = words(text)
    return [b" " + b" ".join(parts[i : i + WINDOW]) for i in range(0, len(parts), WINDOW)] or [b""]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    alone: bool = False

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        how = zstandard.ZstdCompressionParameters(min_match=5, strategy=zstandard.STRATEGY_FAST, window_log=17, hash_log=20, chain_log=20, search_log=4, target_length=0, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.plain, self.toxic = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how).compress for x in (model.ordinary, model.toxic if model.alone else model.ordinary + model.toxic))

    def features(self, text: bytes) -> list[float]:
        """Of the bytes that each window saves under the toxic dictionary."""
        plain, toxic = self.plain, self.toxic
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)
        top = np.sort(saved)[::-1][:3]
        gain = np.maximum(saved, 0)
        n = len(saved)
        return [top[0], top.mean(), np.log1p(gain.sum()), gain.mean(), (saved >= 3).sum() / n, np.log1p((saved >= 4).sum()), np.log(n), saved.mean()]

    def scores(self, features: np.ndarray) -> np.ndarray:
        m = self.model
        z = np.clip((features - m.mean) / m.scale, -4, 4)
        return 1 / (1 + np.exp(-(expand(z) @ m.weights)))


def expand(z: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(z), 1)), z])


def units(word: bytes) -> tuple[bytes, ...]:
    """What a word counts as: itself, and its beginning, which inflected and compound words share."""
    return (word, word[:STEM] + b"*") if len(word) > STEM else (word,)


def trained(samples: list[bytes], sizes: tuple[int, ...], **how) -> bytes:
    for want in sizes:
        try:
            return zstandard.train_dictionary(want, samples, level=3, **how).as_bytes()
        except zstandard.ZstdError:  # too few samples for a dictionary of that size
            continue
    return b"".join(samples)[-sizes[0] :]


def ordinary_dictionary(texts: list[bytes], size: int = ORDINARY_BYTES) -> bytes:
    return trained([w for t in texts for w in windows(t)], (size, size // 8, size // 64)) or b" the"


def evidence(here: int, here_of: int, there: int, there_of: int) -> float:
    """Twice the log-likelihood ratio of two shares against one, 0 unless the first is larger."""
    if here * there_of <= there * here_of:
        return 0.0

    def fit(k: int, n: int, p: float) -> float:
        return sum(x * math.log(q) for x, q in ((k, p), (n - k, 1 - p)) if x)

    both = (here + there) / (here_of + there_of)
    return 2 * (fit(here, here_of, here / here_of) + fit(there, there_of, there / max(1, there_of)) - fit(here, here_of, both) - fit(there, there_of, both))


def toxic_dictionary(texts: list[list[bytes]], toxic: Counter, ordinary: Counter, ordinary_texts: int, settings: Settings) -> bytes:
    """Trained on the windows of toxic texts (as words); ``toxic`` and ``ordinary`` count the texts that hold a unit of a word."""
    telling = {w for w, n in toxic.items() if not settings.evidence or evidence(n, len(texts), ordinary[w], ordinary_texts) >= settings.evidence}
    samples = []
    for text in texts:
        left = [w for w in text if any(u in telling for u in units(w))]
        samples += [b" " + b" ".join(left[i : i + WINDOW]) for i in range(0, len(left), WINDOW)]
    return trained(samples, (settings.size, settings.size // 4, settings.size // 16), k=settings.segment, d=settings.match, steps=4)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Measured:
    """Labelled rows with what their windows save under dictionaries that were trained without them, and the dictionaries of all."""

    final: Model
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray


def measured(rows: list[tuple[bytes, int]], settings: Settings) -> Measured:
    """The ordinary dictionary is trained on a third of the ordinary texts, which take no further part. The toxic one is trained
    for each fold without its texts, to measure them, and once with all.
    """
    apart = np.random.default_rng(1).random(len(rows)) < 1 / 3
    plain = ordinary_dictionary([t for (t, y), k in zip(rows, apart, strict=True) if k and not y])
    rows = [r for r, k in zip(rows, apart, strict=True) if r[1] or not k]
    y = np.array([y for _, y in rows], float)
    fold = np.random.default_rng(2).integers(0, FOLDS, len(rows))
    counts: dict[tuple[int, int], Counter] = {(label, k): Counter() for label in (0, 1) for k in range(FOLDS)}
    for (t, label), k in zip(rows, fold.tolist(), strict=True):
        counts[label, k].update({u for w in set(words(t)) for u in units(w)})

    def model(left_out: int) -> Model:
        used = [k for k in range(FOLDS) if k != left_out]
        toxic, ordinary = (sum((counts[label, k] for k in used), Counter()) for label in (1, 0))
        texts = [words(t) for (t, label), k in zip(rows, fold, strict=True) if label and k != left_out]
        dictionary = toxic_dictionary(texts, toxic, ordinary, int(((y == 0) & (fold != left_out)).sum()), settings)
        return Model(plain, dictionary, np.zeros(8), np.ones(8), np.zeros(9), settings.alone)

    x = np.zeros((len(rows), 8))
    for k in range(FOLDS) if len(rows) else ():
        scorer = model(k).scorer()
        for i in np.flatnonzero(fold == k).tolist():
            x[i] = scorer.features(rows[i][0])
    return Measured(model(-1), x, y, fold)


def calibrated(model: Model, x: np.ndarray, y: np.ndarray, share: float) -> Model:
    """The model with weights from measured rows; ``share`` is the share of label 1 among all labelled rows."""
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return replace(model, mean=mean, scale=scale, weights=logistic(expand(np.clip((x - mean) / scale, -4, 4)), y, weight))


def cross_validated(got: Measured, share: float) -> dict[str, float]:
    """Of each fold scored by dictionaries and weights from the others: the area under the curve, recall and false alarms at THRESHOLD, log loss with classes weighed by ``share``."""
    score = np.zeros(len(got.y))
    for k in range(FOLDS):
        own = got.fold == k
        score[own] = calibrated(got.final, got.x[~own], got.y[~own], share).scorer().scores(got.x[own])
    rank, toxic = np.argsort(np.argsort(score)) + 1, got.y == 1
    n = toxic.sum()
    loss = -share * np.log(score[toxic] + 1e-12).mean() - (1 - share) * np.log(1 - score[~toxic] + 1e-12).mean()
    return {"auc": float((rank[toxic].sum() - n * (n + 1) / 2) / (n * (len(rank) - n))), "recall": float((score[toxic] >= THRESHOLD).mean()), "alarms": float((score[~toxic] >= THRESHOLD).mean()), "loss": float(loss)}


def fit(rows: list[tuple[bytes, int]], share: float, choices: tuple[Settings, ...] = SETTINGS) -> Model:
    """From (text, label), by the settings of least cross-validated loss; ``share`` is the share of label 1 among all labelled rows."""
    found = [measured(rows, s) for s in choices]
    y = found[0].y
    if not len(y):
        return found[0].final
    both = len(set(y.tolist())) == 2
    best = min(found, key=lambda got: cross_validated(got, share)["loss"]) if both and len(found) > 1 else found[0]
    return calibrated(best.final, best.x, best.y, share)


def labelled(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> tuple[list[tuple[bytes, int]], float]:
    """A bounded sample of (text, label): ``sample`` documents of each label (SAMPLE by default), chosen by a hash of doc_id. And the share of label 1 among all."""
    sample = SAMPLE if sample is None else sample
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = known.agg(F.avg("toxic")).first()[0]
    picked = None
    for label in (1, 0):
        order = F.xxhash64("doc_id", F.lit(17))
        some = known.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(sample[label])
        picked = some if picked is None else picked.unionByName(some)
    chosen = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")  # a bounded number of rows
    got = chosen.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).orderBy("doc_id", "toxic").toPandas()
    rows = [(t.encode(), int(y)) for t, y in zip(got.text, got.toxic, strict=True)]
    return rows, float(share or 0)


def train(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None) -> Model:
    """Fits on a bounded sample (``sample`` documents of each label, SAMPLE by default, chosen by a hash of doc_id) of labelled documents.

    Labels other than 0 and 1, null ids and documents without a text are not used. A document labelled twice counts twice;
    of rows that repeat a doc_id only one text does. Without labelled rows every text gets one score. No column of ``docs`` but
    doc_id and text is read.
    """
    return fit(*labelled(docs, labels, sample))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row's whole text, repeated rows too; null and empty texts get the score of no evidence.

    Texts of any length are scored window by window, no rows give none, and further columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for rows in batches:
            found = [scorer.features(t) for t in utf8(rows.column(1))]
            yield batch(SCORES, doc_id=rows.column(0), score=scorer.scores(np.array(found).reshape(-1, 8)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below ``threshold``, unchanged with all their columns; null, empty and very long texts as in ``score``, no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        place = None
        for rows in batches:
            place = rows.schema.get_field_index("text") if place is None else place
            found = [scorer.features(t) for t in utf8(rows.column(place))]
            if found:
                yield rows.filter(pa.array(scorer.scores(np.array(found)) < threshold))

    return docs.mapInArrow(run, docs.schema)
