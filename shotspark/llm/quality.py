"""Quality of text records, learnt from preference pairs (Bradley and Terry)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.llm.texts import small_batches
from shotspark.session import durable

#: Signs counted one by one: marks that prose uses rarely.
SIGNS = "!#$%&*|=_<>{}[]@/\\~^+"
FEATURES = (
    "log_chars", "log_words", "word_chars", "distinct_words", "repeats_previous", "signed_words",
    "upper_words", "upper", "digits", "blanks", "line_ends", "points", "commas", "quotes",
    "wide", "top_sign", "signs",
)


def text_features(text: str) -> list[float]:
    """Shares and lengths of one whole text; an empty text gives zeros."""
    raw = text.encode()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = text.split()
    m = max(1, len(words))
    share = lambda chars: float(sum(int(counts[ord(c)]) for c in chars)) / n
    each = [int(counts[ord(c)]) for c in SIGNS]
    return [
        math.log1p(len(raw)), math.log1p(len(words)), sum(map(len, words)) / m,
        len(set(words)) / math.sqrt(m), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        sum(1 for w in words if not w[-1].isalnum() and not w[-2:-1].isalnum()) / m,
        sum(1 for w in words if w.isupper()) / m, float(counts[65:91].sum()) / n, float(counts[48:58].sum()) / n,
        share(" "), share("\n"), share("."), share(","), share("\"'"), float(counts[128:].sum()) / n,
        max(each) / m, sum(each) / m,
    ]


def payload_features(records: DataFrame, key: str = "source_event_id", text: str = "payload") -> DataFrame:
    """``key, features ARRAY<DOUBLE>`` of every record; a null text counts as empty."""
    names = ["key", "features"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            rows = [text_features(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=names)

    kind = records.schema[key].dataType.simpleString()
    found = records.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        measure, f"key {kind}, features array<double>"
    )
    return found.withColumnRenamed("key", key)


@dataclass(frozen=True)
class Preference:
    """Weights of standardised features; ``threshold`` is the score quantile that splits the classes."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float

    def score(self, features: Column) -> Column:
        """0 to 1; from 0.5 on the record lies above the threshold."""
        slope = [w / s for w, s in zip(self.weights, self.scale, strict=True)]
        base = -self.threshold - sum(a * c for a, c in zip(slope, self.centre, strict=True))
        total = F.lit(base)
        for i, a in enumerate(slope):
            total = total + F.lit(a) * features[i]
        return 1 / (1 + F.exp(-total))


def fit_preferences(
    features: DataFrame, ranked: str = "quality", sample_rows: int = 20_000, opponents: int = 4,
    rounds: int = 40, penalty: float = 1e-2,
) -> Preference:
    """Learn scores so that preferred records (``ranked`` 1) beat the others (0).

    ``features`` has ``features ARRAY<DOUBLE>`` and the label.  Every sampled record of a class
    meets ``opponents`` drawn records of the other; each pair says that the first is
    preferred, and logistic loss on the difference of their features is minimised by Newton
    steps.  The threshold is the quantile of the scores of all labelled rows at the share of
    unpreferred ones.  The fit reads at most ``sample_rows`` labelled rows, those with the
    smallest hash of key, features and label, so that copies of a text are drawn one by one; rows with another label or none are left out.  Without both
    classes all weights are zero and every score is 0.5.
    """
    labelled = features.filter(F.col(ranked).isin(0, 1))
    rows = (
        labelled.select("features", F.col(ranked).cast("int").alias("label"), F.xxhash64(*features.columns).alias("drawn"))
        .orderBy("drawn", "label")
        .limit(sample_rows)
        .collect()
    )
    y = np.array([r.label for r in rows], dtype=np.int64)
    if not (y == 1).any() or not (y == 0).any():
        zero = (0.0,) * len(FEATURES)
        return Preference(zero, (1.0,) * len(FEATURES), zero, 0.0)
    x = np.array([r.features for r in rows], dtype=np.float64)
    centre, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.clip((x - centre) / scale, -50, 50)
    draw = np.random.default_rng(7)
    good, bad = z[y == 1], z[y == 0]
    gaps = np.concatenate(
        [np.repeat(good, opponents, axis=0) - bad[draw.integers(0, len(bad), len(good) * opponents)],
         good[draw.integers(0, len(good), len(bad) * opponents)] - np.repeat(bad, opponents, axis=0)]
    )
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(gaps @ w, -50, 50)))
        slope = gaps.T @ p / len(gaps) - penalty * w
        bend = (gaps * (p * (1 - p))[:, None]).T @ gaps / len(gaps) + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    slope = w / scale
    total = F.lit(-float(slope @ centre))
    for i, a in enumerate(slope.tolist()):
        total = total + F.lit(a) * F.col("features")[i]
    share = labelled.agg(F.avg((F.col(ranked) == 0).cast("double"))).first()[0]
    low, high = labelled.agg(
        F.percentile_approx(total, [share, min(1.0, share + 1e-5)], 100_000)
    ).first()[0]
    threshold = (low + high) / 2
    return Preference(tuple(centre.tolist()), tuple(scale.tolist()), tuple(w.tolist()), threshold)


def score_payloads(
    records: DataFrame, labels: DataFrame, key: str = "source_event_id", text: str = "payload",
    ranked: str = "quality", sample_rows: int = 20_000,
) -> DataFrame:
    """``key, score DOUBLE, predicted INT`` for every record, as ``labels`` (key, ranked) teach it.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other key and text column can be named.  Every text is read whole, null
    as empty; labels of unknown keys, null labels and labels other than 0 and 1 teach
    nothing, repeated rows count as often as they occur, and further columns are ignored.
    Only the features see the text, and only the label of a row in ``labels`` is ever used.
    """
    features = durable(payload_features(records, key, text))
    model = fit_preferences(durable(features.join(labels.select(key, ranked), key)), ranked, sample_rows)
    score = model.score(F.col("features"))
    return features.select(key, score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_preferred(
    records: DataFrame, labels: DataFrame, key: str = "source_event_id", text: str = "payload",
    ranked: str = "quality", sample_rows: int = 20_000,
) -> DataFrame:
    """The records, with all their columns, that :func:`score_payloads` would predict as 1.

    Texts are measured again where they lie instead of being sent through a join.
    """
    labelled = durable(payload_features(records, key, text).join(labels.select(key, ranked), key))
    model = fit_preferences(labelled, ranked, sample_rows)
    slope = np.array(model.weights) / np.array(model.scale)
    base = -model.threshold - float(slope @ np.array(model.centre))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            rows = [text_features(t or "") for t in batch.column(text).to_pylist()]
            good = np.array(rows, dtype=np.float64).reshape(len(rows), -1) @ slope + base >= 0
            yield batch.filter(pa.array(good))

    return records.mapInArrow(keep, records.schema)
