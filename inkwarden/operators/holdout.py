"""Every source held out in turn: statistics by subtraction, and all fits side by side over one table of features.

Terms are counted once by ``(source, term)``; the vocabulary without a source is the total minus that source.  The
features of all rows, term numbers with their counts, are written once in chunks (``packed.py``).  Each round of the optimiser is
one job that reads them and returns the gradients of all fits, whatever their number; a source more costs arithmetic, no scan.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import term_words
from . import packed

#: Sources held out together: bounds the coefficients on the driver and in the tasks.
BLOCK = 32

#: Tasks a core in a round: each returns a gradient for each fit, so there are not as many as splits.
TASKS = 3


@dataclass
class Fits:
    """``views``: the fits that read each view's cells.  By fit ``idf`` of its view's terms, 0 outside its vocabulary, ``coefs`` and ``intercepts``."""

    views: list[list[int]]
    idf: list[np.ndarray]
    coefs: list[np.ndarray]
    intercepts: np.ndarray

    def values(self, k: int) -> np.ndarray:
        """What a cell is multiplied with, but for the length of its row."""
        return self.idf[k] * self.coefs[k]


def _gradients(sent, views: list[list[int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, tuple[np.ndarray, float]] = sent.value
        out = {k: np.zeros(len(values) + 2) for k, (values, _) in fits.items()}
        for kept, trained, weights, inverse, cells in packed.unpacked(batches):
            label = kept.field("label").to_numpy(zero_copy_only=False)[:trained].astype(float)
            for own, all_cells in zip(views, cells, strict=True):
                active = [k for k in own if k in fits]
                if not active or not trained:
                    continue
                found = all_cells.first(trained)
                for k in active:
                    values, intercept = fits[k]
                    w, scale = weights[k, :trained], inverse[k, :trained]
                    margin = found.times(values) * scale + intercept
                    rest = w * (1 / (1 + np.exp(-margin)) - label)
                    out[k][:-2] += found.turned(rest * scale, len(values))
                    out[k][-2] += rest.sum()
                    out[k][-1] += (w * (np.logaddexp(0, margin) - label * margin)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([v.tobytes() for v in out.values()], pa.binary())], ["fit", "sums"])

    return rows


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, data in zip(batch.column("fit").to_pylist(), batch.column("sums"), strict=True):
            values = np.frombuffer(data.as_buffer())
            if k in found:
                found[k] += values
            else:
                found[k] = values.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([v.tobytes() for v in found.values()], pa.binary())], ["fit", "sums"])


def gradients(table: DataFrame, fits: Fits, active: list[int]) -> dict[int, np.ndarray]:
    """For each active fit its gradient by term, by the intercept, and its loss, over all rows of ``table``; one job.

    Tasks add up what falls to a fit; the driver gets one array for each fit.
    """
    shape, spark = "fit int, sums binary", table.sparkSession
    sent = spark.sparkContext.broadcast({k: (fits.values(k), fits.intercepts[k]) for k in active})
    parts = table.coalesce(TASKS * spark.sparkContext.defaultParallelism).mapInArrow(_gradients(sent, fits.views), shape)
    out = {row["fit"]: np.frombuffer(row["sums"]).copy() for row in parts.repartition("fit").mapInArrow(_added, shape).toArrow().to_pylist()}
    for k, values in out.items():
        values[:-2] *= fits.idf[k]
    sent.destroy()
    return out


def descent(start: np.ndarray, rounds: int, memory: int = 8, least: float = 1e-6) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory BFGS as a generator: yields points, is sent (loss, gradient), returns the best point.

    Steps are halved until the loss falls enough; so many fits can be driven by one job each round.
    """
    at = start
    loss, slope = yield at
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        direction, kept = -slope, []
        for s, y in reversed(steps):
            a = (s @ direction) / (s @ y)
            direction = direction - a * y
            kept.append(a)
        if steps:
            s, y = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            direction = direction + (a - (y @ direction) / (s @ y)) * s
        fall = slope @ direction
        if not fall < 0:
            direction, fall, steps = -slope, -(slope @ slope), []
        size = 1.0 if steps else min(1.0, 1 / max(1e-12, float(np.abs(slope).sum())))
        for _ in range(20):
            new_loss, new_slope = yield at + size * direction
            if new_loss <= loss + 1e-4 * size * fall:
                break
            size /= 2
        else:
            return at
        s, y = size * direction, new_slope - slope
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-memory:]
        done = loss - new_loss <= least * max(1.0, abs(loss))
        at, loss, slope = at + s, new_loss, new_slope
        if done:
            break
    return at


def fit_many(table: DataFrame, views: list[list[int]], idf: list[np.ndarray], totals: np.ndarray, rounds: int = 20,
             inverse: float = fixed.INVERSE_REGULARISATION) -> Fits:
    """Logistic fits side by side over ``table``, chunks of ``packed.features`` whose kept columns have ``label``.

    ``views`` are the fits of each view, ``totals`` the sums of the weights.  The penalty is that of the single fit: half the
    squared coefficients over ``inverse`` times the total weight, none on the intercept.
    """
    fits = Fits(views, idf, [np.zeros(len(own)) for own in idf], np.zeros(len(idf)))
    running = {k: descent(np.zeros(len(idf[k]) + 1), rounds) for k in range(len(idf)) if totals[k] > 0}
    points = {k: next(g) for k, g in running.items()}
    while points:
        for k, point in points.items():
            fits.coefs[k], fits.intercepts[k] = point[:-1], point[-1]
        found, following = gradients(table, fits, sorted(points)), {}
        for k, point in points.items():
            penalty = 1 / (inverse * totals[k])
            slope = found[k][:-1] / totals[k]
            slope[:-1] += penalty * point[:-1]
            loss = found[k][-1] / totals[k] + penalty / 2 * float(point[:-1] @ point[:-1])
            try:
                following[k] = running[k].send((loss, slope))
            except StopIteration as end:
                fits.coefs[k], fits.intercepts[k] = end.value[:-1], end.value[-1]
        points = following
    return fits


def scores_of(sent, kept: list[str]):
    """``scores``, the probability of each row by each fit, beside the columns ``kept``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: Fits = sent.value
        for own, _, _, inverse, cells in packed.unpacked(batches):
            margins = np.zeros(inverse.shape)
            for view, found in zip(fits.views, cells, strict=True):
                for k in view:
                    margins[k] = found.times(fits.values(k)) * inverse[k] + fits.intercepts[k]
            scores = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(margins)),
                                              pa.array((1 / (1 + np.exp(-margins.T))).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(own.field(c) for c in kept), scores], [*kept, "scores"])

    return rows


def _without(held: list[str]):
    """Of some sources, those that each fit without one of ``held`` is trained on."""
    return lambda sources: np.array([[s != h for s in sources] for h in held], bool).reshape(len(held), -1)


def _weigh(held: list[str], by_class: dict[int, dict[int, float]]):
    """Weights of rows (source, label, trained) in the fits without each of ``held``."""
    inside = _without(held)

    def weights(kept: pa.StructArray) -> np.ndarray:
        coded = kept.field("source").dictionary_encode(null_encoding="encode")
        outside = inside(coded.dictionary.to_pylist())[:, coded.indices.to_numpy(zero_copy_only=False)]
        label, trained = kept.field("label").to_numpy(zero_copy_only=False), kept.field("trained").to_numpy(zero_copy_only=False).astype(bool)
        out = np.zeros((len(held), len(kept)))
        for k, each in by_class.items():
            out[k] = np.where(outside[k] & trained, np.where(label == 1, each[1], each[0]), 0.0)
        return out

    return weights


def _block(spark, chunks: DataFrame, statistics: DataFrame, counts: pd.DataFrame, held: list[str], stop_words: list[str],
           rounds: int) -> DataFrame:
    """Rates of the fits without each of ``held``."""
    train = counts[counts["split"] == "train"]
    n, by_source = int(train["n"].sum()), train.groupby("source")["n"].sum()
    sizes = np.array([n - int(by_source.get(h, 0)) for h in held])
    row = {h: i for i, h in enumerate(held)}
    words, df = packed.vocabularies(statistics, {0: _without(held)}, {0: sizes})[0]
    idf = np.where(df > 0, np.log((1 + sizes[:, None]) / (1 + df)) + 1, 0.0)
    # Balanced class weights of each fit: its rows over twice those of the class.
    by_class, totals = {}, np.zeros(len(held))
    for k, h in enumerate(held):
        classes = train[train["source"] != h].groupby("label")["n"].sum()
        if len(classes) == 2:
            by_class[k] = {label: classes.sum() / (2 * c) for label, c in classes.items()}
            totals[k] = classes.sum()
    fits_of = [list(range(len(held)))]
    table = packed.features(chunks, [(0, tuple(stop_words))], [words], list(idf), fits_of, _weigh(held, by_class), ["source", "label", "split"])
    fits = fit_many(table, fits_of, list(idf), totals, rounds)
    scored = table.mapInArrow(
        scores_of(spark.sparkContext.broadcast(fits), ["source", "label", "split"]), "source string, label int, split string, scores array<double>")
    own, caught = (F.col("source") == F.col("held_out")) & (F.col("label") == 0), (F.col("label") == 1) & (F.col("split") == "test")
    names = F.array(*[F.lit(h) for h in held])
    each = scored.where(caught | (F.col("source").isin(held) & (F.col("label") == 0))).select(
        "source", "label", "split", F.posexplode("scores").alias("_k", "score")).withColumn("held_out", F.get(names, F.col("_k")))
    share = lambda rows, hit: F.round(F.avg(F.when(rows, hit.cast("double"))), 4)
    rates = each.groupBy("held_out").agg(
        F.count(F.when(own, 1)).alias("n_unseen_legit"), share(own, F.col("score") >= 0.5).alias("fpr_05"),
        share(own, F.col("score") >= fixed.QUARANTINE_THRESHOLD).alias("fpr_q"), share(caught, F.col("score") >= 0.5).alias("recall_05"))
    facts = spark.createDataFrame([(h, int(totals[row[h]]), int((df[row[h]] > 0).sum())) for h in held if totals[row[h]] > 0],
                                  "held_out string, n_train bigint, n_terms bigint")
    return rates.where("n_unseen_legit > 0").join(F.broadcast(facts), "held_out").select(
        "held_out", "n_train", "n_terms", "n_unseen_legit", "fpr_05", "fpr_q", "recall_05")


def holdout_rates(corpus: DataFrame, stop_words: list[str] | None = None, rounds: int = 20) -> DataFrame:
    """Every source of ``corpus`` (source, text, label, split) held out: rows and terms it is trained on, its false alarms
    at 0.5 and at the quarantine threshold, and the recall on the positive rows of the test part.

    Trained are the train rows of the other sources (and those without one).  A source is left out if it has no
    negative row or one class would remain.  The texts are read once and their words written in chunks; those are read for the
    statistics, and once for each block of ``BLOCK`` sources for the features.
    """
    spark = corpus.sparkSession
    stop = fixed.CORPUS_STOP_WORDS if stop_words is None else stop_words
    trained = F.coalesce(F.col("split") == "train", F.lit(False))
    rows = corpus.select(F.col("source").cast("string").alias("source"), term_words(F.col("text")).alias("words"), F.col("label").cast("int").alias("label"),
                         F.col("split").cast("string").alias("split"), trained.alias("trained"), F.col("source").cast("string").alias("group"))
    chunks = packed.pack(rows.where(F.col("label").isin(0, 1)), ["words"])
    counts = chunks.select(F.inline("kept")).groupBy("source", "split", "label").agg(F.count("*").alias("n")).toPandas()
    held = sorted(counts[(counts["label"] == 0) & counts["source"].notna()]["source"].unique())
    if not held:
        raise ValueError("no source can be held out")
    statistics = packed.statistics(chunks, [(0, tuple(stop))])
    blocks = [_block(spark, chunks, statistics, counts, held[i:i + BLOCK], stop, rounds) for i in range(0, len(held), BLOCK)]
    out = blocks[0]
    for part in blocks[1:]:
        out = out.unionAll(part)
    return out
