"""Toxicity scores from averaged subword embeddings and a linear softmax.

The model is fitted on the driver in numpy from a bounded sample of labelled
documents: at most ``TRAIN_PER_LABEL`` of each label, chosen by a hash of
doc_id, and at most ``TRAIN_WINDOWS`` word windows of them; texts of more than
``TRAIN_CHARS`` letters are not learned from.  Of rows that repeat a doc_id one is learned from (the
smallest text).  Calibration weighs each label by its share of all training
labels, so scores do not depend on what the bound cuts off.  A window of words
takes its document's label, embeddings and softmax are trained jointly, and a
document's score is the calibrated score of its highest window, so a few insults
in a very long text count as much as in a short one.  Scoring covers every word
of every text and reads nothing but the text.

Null and empty texts and texts without a word score the share of label 1 among
the training labels (0.1 if there are none), at most ``THRESHOLD`` less 0.05 and
at least 0.001.  With no label, or labels of one kind only, every text scores
that constant.  Repeated rows are scored row by row.  Extra columns of the input
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword
from .lineage import bounded_batches
from .textbuf import TextBlock, frugal, raw_texts, text_slices

TRAIN_PER_LABEL = 2048
TRAIN_WINDOWS = 40_000
TRAIN_CHARS = 100_000
WINDOW, STEP = 16, 8
MIN_DOCS = 4
THRESHOLD = 0.3


def training_rows(documents: DataFrame, labels: DataFrame, per_label: int = TRAIN_PER_LABEL) -> DataFrame:
    """At most per_label labelled texts of each label, outside the held-out part (doc_id, text, toxic, weight: labels that a row stands for).

    One row for each doc_id, of bounded length, however often it repeats and however long it is.
    """
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    count = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}  # two rows
    stands_for = [F.lit(max(1.0, count.get(y, 0) / per_label)).alias("weight") for y in (0, 1)]
    picks = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).select("*", stands_for[y]) for y in (0, 1)]
    picked = picks[0].unionByName(picks[1])
    # per_label bounds this side, so it can be broadcast
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select("doc_id", text.alias("text")).where(F.length("text") <= TRAIN_CHARS).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic", "weight").agg(F.min("text").alias("text"))


def fit(rows: list[tuple[bytes, int]], seed: int = 7, weight: np.ndarray | None = None) -> subword.Model:
    """A model from (text, 0 or 1) pairs; weight says how many labels each stands for."""
    y = np.array([r[1] for r in rows], np.int64)
    w = np.ones(len(y)) if weight is None else weight / weight.mean()
    prior = float(np.average(y, weights=w)) if len(y) else 0.1
    if not (y == 0).any() or not (y == 1).any():
        return subword.Model([0, 1], np.zeros((1 << subword.BITS, 2), np.float32), np.zeros(2, np.float32), 0.0, _logit(prior), prior=prior)
    texts = [r[0] for r in rows]
    fold = np.random.default_rng(seed).random(len(rows)) < 0.8
    rng = np.random.default_rng(seed)
    # documents of either label get the same room; long ones don't crowd out others
    quota = {v: TRAIN_WINDOWS // 2 // max(1, int((y == v).sum())) + 4 for v in (0, 1)}
    flat, size, label = [], [], []
    spread = np.zeros(1 << subword.BITS, np.int64)
    for first, block in blocks_of(texts):
        row, start, stop = subword.windows(block, WINDOW, STEP)
        doc = first + row
        keep = (_rank(row, rng.random(len(row))) < np.where(y[doc] == 1, quota[1] * 3, quota[0])) & fold[doc]
        f, o = subword.bags(block, start[keep], stop[keep])
        owner = np.repeat(doc[keep], np.diff(o))
        spread += np.bincount(np.unique(owner * len(spread) + f) % len(spread), minlength=len(spread))
        flat.append(f)
        size.append(np.diff(o))
        label.append(y[doc][keep])
    # n-grams of very few documents would be known by heart
    known = spread >= MIN_DOCS
    for k, (f, n) in enumerate(zip(flat, size)):
        ok = known[f]
        size[k] = np.diff(np.concatenate(([0], np.cumsum(ok)))[np.concatenate(([0], np.cumsum(n)))])
        flat[k] = f[ok]
    label = np.concatenate(label)
    offset = np.concatenate(([0], np.cumsum(np.concatenate(size))))
    ones = max(1, int(label.sum()))
    whole = np.concatenate(flat)
    del flat
    model = subword.train(whole, offset, label, [0, 1], weight=np.where(label == 1, min(4.0, (len(label) - ones) / ones), 1.0), dim=8, epochs=3)
    del whole
    model.known, model.prior = known, prior
    best = np.concatenate([_highest(model, b, subword.windows(b, WINDOW, STEP)) for _, b in blocks_of(texts)])
    have = np.isfinite(best)
    share = have & ~fold
    if len(np.unique(y[share])) == 2:
        model.scale, model.shift = subword.fit_line(best[share], y[share], w[share])
        if model.scale > 0:
            return model
    # too few texts to calibrate on: as many pass the threshold as are labelled 1
    cut = _quantile(best[have], 1 - np.average(y[have], weights=w[have]), w[have]) if have.any() else 0.0
    model.scale, model.shift = 1.0, float(np.log(THRESHOLD / (1 - THRESHOLD))) - cut
    return model


def blocks_of(texts: list[bytes], room: int = 1 << 19):
    """Texts in small runs, so that little is held at a time: (first text, block)."""
    at = 0
    while at < len(texts):
        stop, used = at, 0
        while stop < len(texts) and (stop == at or used + len(texts[stop]) < room):
            used += len(texts[stop])
            stop += 1
        yield at, TextBlock(texts[at:stop])
        at = stop


def _rank(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its row, by value; rows come in order."""
    order = np.lexsort((value, row))
    rank = np.empty(len(row), np.int64)
    rank[order] = np.arange(len(row)) - np.searchsorted(row[order], row[order])
    return rank


def _quantile(x: np.ndarray, q: float, w: np.ndarray) -> float:
    """np.quantile with weights."""
    order = np.argsort(x, kind="stable")
    x, w = x[order], w[order]
    return float(np.interp(q, (np.cumsum(w) - w) / max(w.sum() - w[-1], 1e-9), x))


def _logit(p: float) -> float:
    p = min(max(p, 1e-3), THRESHOLD - 0.05)
    return float(np.log(p / (1 - p)))


def _highest(model: subword.Model, block: TextBlock, spans) -> np.ndarray:
    row, start, stop = spans
    out = np.full(len(block.start), -np.inf)
    if len(row):
        logit = subword.range_logits(model, block, start, stop, WINDOW - 1)
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[first]] = np.maximum.reduceat(logit, first)
    return out


def score_texts(model: subword.Model, texts: list[bytes]) -> np.ndarray:
    """Scores in 0..1 of some texts."""
    block = TextBlock(texts)
    best = _highest(model, block, subword.windows(block, WINDOW, STEP))
    value = np.where(np.isfinite(best), model.scale * np.where(np.isfinite(best), best, 0) + model.shift, _logit(model.prior))
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def train_model(documents: DataFrame, labels: DataFrame) -> subword.Model:
    got = training_rows(documents, labels).orderBy("doc_id").toArrow().combine_chunks()
    texts = raw_texts(pa.chunked_array(got["text"]).combine_chunks()) if got.num_rows else []
    return fit(list(zip(texts, got["toxic"].to_pylist())), weight=got["weight"].to_numpy() if got.num_rows else None)


def score(documents: DataFrame, model: subword.Model) -> DataFrame:
    """doc_id and score of every row."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(batches):
        m = shared.value
        for batch in batches:
            parts = [score_texts(m, raw_texts(batch.column(1)[a:z])) for a, z in text_slices(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, score double")


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(documents, train_model(documents, labels))
    return scored.select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that score below the threshold."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(train_model(documents, labels))
    at = documents.columns.index("text")

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, z in text_slices(batch.column(at)):
                keep = score_texts(m, raw_texts(batch.column(at)[a:z])) < threshold
                yield batch.slice(a, z - a).filter(pa.array(keep))

    return documents.mapInArrow(frugal(run), documents.schema)
