"""Language identification: averaged hashed subword embeddings, linear softmax.

Trained by stochastic gradient descent in numpy on the driver, from a bounded
sample: at most ``TRAIN_PER_LANG`` documents of each language outside the
held-out part, chosen by a hash of doc_id, so a rare language is learned as
well; cut into windows of words, at most ``TRAIN_WINDOWS`` of them.  Texts of
more than ``TRAIN_CHARS`` letters are not learned from.  Of rows that repeat a doc_id one is learned
from.  A temperature and a rejection level are fitted on the windows of
documents kept from training, at most ``TEST_WINDOWS`` drawn by chance: the level
is the score below which predictions are right less often than ``TRUST``.
Every text is scored whole.  The number of languages must be moderate: the
sample grows with it.

Null texts and texts without a letter are ``und`` with score 0.  With no labelled
row everything is ``und``.  Repeated rows are scored row by row, and extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import subword
from .lineage import bounded_batches
from .textbuf import TextBlock, frugal, raw_texts, text_slices
from .toxicity import _rank, blocks_of

TRAIN_PER_LANG = 1024
TRAIN_CHARS = 100_000
TEST_WINDOWS = 8192
TRAIN_WINDOWS = 30_000
WINDOW = 24
TRUST = 0.5
_LETTER = regex.compile(r"\p{L}")


def training_rows(documents: DataFrame, per_lang: int = TRAIN_PER_LANG) -> DataFrame:
    """At most per_lang texts of each language, outside the held-out part; one row for each doc_id, of bounded length."""
    known = documents.where(F.col("lang").isNotNull() & (F.length("text") <= TRAIN_CHARS) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    hashed, space = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), 1 << 30
    # a share of every language that holds the per_lang smallest hashes and little more, so no language gathers in one task
    count = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row a language
    share = [(lang, min(space, int(space * (1.25 * per_lang + 200) / n) + 1)) for lang, n in count.items()]
    share = known.sparkSession.createDataFrame(share, "lang string, most long")
    few = known.select("doc_id", F.col("lang").cast("string").alias("lang")).join(F.broadcast(share), "lang").where(hashed < F.col("most"))
    order = Window.partitionBy("lang").orderBy(hashed, "doc_id")
    picked = few.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("k", F.row_number().over(order)).where(F.col("k") <= per_lang).select("doc_id", F.col("lang").alias("own"))
    rows = known.select("doc_id", F.col("text").cast("string").alias("text"), "lang").join(F.broadcast(picked), "doc_id").where("lang = own")  # per_lang bounds this side
    return rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def fit(rows: list[tuple[bytes, str]], seed: int = 11) -> subword.Model:
    classes = sorted({r[1] for r in rows})
    if not classes:
        return subword.Model([], np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    if len(classes) == 1:
        return subword.Model(classes, np.zeros((1 << subword.BITS, 1), np.float32), np.zeros(1, np.float32))
    code = {c: i for i, c in enumerate(classes)}
    rng = np.random.default_rng(seed)
    per = max(4, -(-5 * TRAIN_WINDOWS // (4 * max(1, len(rows)))))
    flat, size, label, doc = [], [], [], []
    codes = np.array([code[r[1]] for r in rows])
    for first, block in blocks_of([r[0] for r in rows]):
        row, start, stop = subword.windows(block, WINDOW, WINDOW)
        keep = _rank(row, rng.random(len(row))) < per
        f, o = subword.bags(block, start[keep], stop[keep])
        flat.append(f)
        size.append(np.diff(o))
        label.append(codes[first + row[keep]])
        doc.append(first + row[keep])
    label = np.concatenate(label)
    flat = np.concatenate(flat)
    offset = np.concatenate(([0], np.cumsum(np.concatenate(size))))
    # whole documents are kept from training, so that calibration sees none of their words
    held = (rng.random(len(rows)) < 0.15)[np.concatenate(doc)]
    use = rng.permutation(np.flatnonzero(~held))[:TRAIN_WINDOWS]
    if not len(use):
        use = np.arange(len(label))
    n = np.diff(offset)[use]
    own = np.repeat(np.arange(len(use)), n)
    some = flat[np.arange(int(n.sum()), dtype=np.int32) - np.concatenate(([0], np.cumsum(n)))[own] + offset[use][own]]
    model = subword.train(some, np.concatenate(([0], np.cumsum(n))), label[use], classes, dim=10, epochs=3)
    test = rng.permutation(np.flatnonzero(held))[:TEST_WINDOWS]
    if len(test):
        logit = np.stack([model.table[flat[offset[i] : offset[i + 1]]].mean(0) if offset[i + 1] > offset[i] else np.zeros(len(classes)) for i in test]) + model.bias
        grid = np.geomspace(0.2, 5, 25)
        loss = [-np.log(np.maximum(subword.softmax(logit * s)[np.arange(len(test)), label[test]], 1e-9)).mean() for s in grid]
        model.scale = float(grid[int(np.argmin(loss))])
        p = subword.softmax(logit * model.scale)
        top, right = p.max(1), p.argmax(1) == label[test]
        order = np.argsort(top)
        share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        low = np.flatnonzero(share < TRUST)
        model.floor = float(top[order[low[-1]]]) if len(low) else 0.0
    return model


def train_model(documents: DataFrame) -> subword.Model:
    got = training_rows(documents).orderBy("doc_id").toArrow().combine_chunks()
    texts = raw_texts(got["text"].combine_chunks()) if got.num_rows else []
    return fit(list(zip(texts, got["lang"].to_pylist())))


def predict_texts(model: subword.Model, column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Class and calibrated score of each text."""
    strings = column.to_pylist()
    letters = np.array([s is not None and _LETTER.search(s) is not None for s in strings], bool)
    if not model.classes:
        return ["und"] * len(strings), np.zeros(len(strings))
    p = subword.softmax(subword.row_logits(model, TextBlock(raw_texts(column))) * model.scale)
    top = p.argmax(1)
    return [model.classes[k] if ok else "und" for k, ok in zip(top.tolist(), letters.tolist())], np.where(letters, p.max(1), 0.0)


def identify(documents: DataFrame, model: subword.Model) -> DataFrame:
    """doc_id, lang_pred, score, accepted (false where the calibrated score is not to be trusted)."""
    bounded_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(batches):
        m = shared.value
        for batch in batches:
            names, scores = [], [np.zeros(0)]
            for a, z in text_slices(batch.column(1)):
                got = predict_texts(m, batch.column(1)[a:z])
                names += got[0]
                scores.append(got[1])
            value = np.concatenate(scores)
            accepted = [n != "und" and s >= m.floor for n, s in zip(names, value.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(value), pa.array(accepted, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double, accepted boolean")


def language(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, accepted."""
    got = identify(documents, train_model(documents))
    return got.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")
