"""Operator 3: language identification by a bidirectional gated recurrent network.

The network reads bytes and gives every position of a text language
probabilities, white space and marks included; a document's are the mean over
its characters (of a character's bytes the first counts). A text is read in windows of up to ``BODY`` bytes. Each window is
read together with the ``MARGIN`` bytes before and after it, so that both
directions know the words around a position; beyond the ends of the text stand
zero bytes. Where windows begin depends on the text alone, so equal texts get
equal results.

It is trained in numpy, on a bounded sample: per language the ``TRAIN_DOCUMENTS``
labelled documents of smallest hash (fewer if there are many languages, so that
``TRAIN_ROWS`` bounds them all), of each ``TRAIN_WINDOWS`` windows spread evenly over
the whole text. Prediction covers every document and whole texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0,
as is every text if nothing could be learned; ties go to the first language in
order; a null key is not held out and not learned from; rows without a label
aren't learned from; repeated rows give a row each; an empty table gives an
empty result; label columns and others are ignored when predicting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from signalmill.llm.common import table, text_or_empty, tune
from signalmill.llm.gru import ByteNetwork

UNDETERMINED = "und"
#: Bounds of the training sample: documents of a language, documents of all
#: languages together (at least one of each), windows of a document and their bytes.
TRAIN_DOCUMENTS, TRAIN_ROWS, TRAIN_WINDOWS, TRAIN_BYTES = 250, 20_000, 6, 128
#: Bytes that a window labels at most, bytes read before and after it, the step of
#: window sizes, and windows read at once.
BODY, MARGIN, STEP, READ_AT_ONCE = 224, 16, 32, 2048


def remainder(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 4


def training_sample(df: DataFrame, key: str = "doc_id", text_column: str = "text", label: str = "lang", documents: int = TRAIN_DOCUMENTS, rows: int = TRAIN_ROWS, windows: int = TRAIN_WINDOWS, size: int = TRAIN_BYTES) -> pd.DataFrame:
    """(label, window) from at most ``documents`` rows per label and ``rows`` in
    all, brought to the driver: ``windows`` pieces of bytes of each, evenly spread
    from the text's start to its end. Keys are chosen first, without texts, by a
    rank that Spark limits before it shuffles."""
    learned = df.where(F.col(label).isNotNull() & (remainder(key) != 2))
    rank = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("key"), "key"))
    keys = learned.select(F.col(key).cast("long").alias("key"), F.col(label).cast("string").alias("label"))
    labels = keys.select("label").distinct().count()
    few = min(documents, max(1, rows // max(1, labels)))
    chosen = sorted({r.key for r in keys.withColumn("rank", rank).where(F.col("rank") <= few).select("key").collect()})
    if not chosen:
        return pd.DataFrame({"label": [], "window": []})
    data = F.encode(text_or_empty(text_column), "UTF-8")
    spare = F.greatest(F.octet_length(data) - size, F.lit(0))
    places = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda k: F.floor(spare * k / max(1, windows - 1)).cast("int"))
    cut = F.transform(F.array_distinct(places), lambda at: F.substring(data, at + 1, F.lit(size)))
    found = learned.where(F.col(key).isin(chosen)).select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), cut.alias("cut")).dropDuplicates()
    return found.orderBy("key", "label", "cut").limit(len(chosen) * 4).select("label", F.explode("cut").alias("window")).where(F.octet_length("window") > 0).toPandas()


def train(sample: pd.DataFrame, hidden: int = 8) -> ByteNetwork | None:
    """A network fitted to the sample's windows, each with its document's label;
    None if there is nothing to learn."""
    labels = sorted(set(sample["label"]))
    if not labels:
        return None
    place = {label: k for k, label in enumerate(labels)}
    rows = [(bytes(w).decode("utf-8", "replace"), bytes(w), place[label]) for label, w in zip(sample["label"], sample["window"], strict=True)]
    rows = [(w, k) for text, w, k in rows if any(map(str.isalpha, text))]
    if not rows:
        return None
    return ByteNetwork(labels, hidden).fit([w for w, _ in rows], np.array([k for _, k in rows]))


def cuts(length: int) -> tuple[int, int]:
    """(windows of a text of so many bytes, bytes that each labels)."""
    count = max(1, -(-length // BODY))
    return count, -(-(-(-length // count)) // STEP) * STEP


def probabilities(network: ByteNetwork, texts: list[str]) -> list[np.ndarray | None]:
    """Label probabilities of each text, the mean over its characters; None for a
    text without a letter. Memory is bounded by the texts and a block of windows."""
    sums = np.zeros((len(texts), len(network.labels)))
    lengths = np.ones(len(texts), np.int64)
    jobs: dict[int, list[tuple[int, int, int, np.ndarray]]] = {}
    lettered = [any(map(str.isalpha, t)) for t in texts]
    for i, text in enumerate(texts):
        if not lettered[i]:
            continue
        data = text.encode()
        lengths[i] = len(text)
        count, body = cuts(len(data))
        padded = np.zeros(count * body + 2 * MARGIN, np.uint8)
        padded[MARGIN : MARGIN + len(data)] = np.frombuffer(data, np.uint8)
        windows = np.lib.stride_tricks.sliding_window_view(padded, body + 2 * MARGIN)[::body]
        jobs.setdefault(body, []).append((i, count, len(data), windows))
    for body, own in sorted(jobs.items()):
        owner = np.repeat([i for i, *_ in own], [count for _, count, *_ in own])
        filled = np.concatenate([np.clip(length - np.arange(count) * body, 0, body) for _, count, length, _ in own])
        at, held = 0, []

        def label(rows: np.ndarray, start: int, body=body, owner=owner, filled=filled) -> None:
            p = network.positions(rows)[MARGIN : MARGIN + body]
            first = (rows[:, MARGIN : MARGIN + body].T & 0xC0) != 0x80
            there = first & (np.arange(body)[:, None] < filled[start : start + len(rows)])
            np.add.at(sums, owner[start : start + len(rows)], np.einsum("tnk,tn->nk", p, there.astype(np.float32)))

        for *_, windows in own:
            for k in range(0, len(windows), READ_AT_ONCE):
                held.append(windows[k : k + READ_AT_ONCE])
                if sum(map(len, held)) >= READ_AT_ONCE:
                    rows = np.concatenate(held)
                    label(rows, at)
                    at, held = at + len(rows), []
        if held:
            label(np.concatenate(held), at)
    return [s / n if there else None for s, n, there in zip(sums, lengths, lettered, strict=True)]


def predict(df: DataFrame, network: ByteNetwork | None, key: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(key, lang_pred, score): one row for each row, without a shuffle. The
    network (some 100 kB) goes with the task."""

    def of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = [], []
            for p in probabilities(network, texts) if network else [None] * len(texts):
                rounded = None if p is None else np.round(p, 5)
                names.append(UNDETERMINED if p is None else network.labels[int(rounded.argmax())])
                scores.append(0.0 if p is None else min(1.0, float(rounded.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["key", "lang_pred", "score"])

    rows = df.select(F.col(key).cast("long").alias("key"), text_or_empty(text_column).alias("text"))
    return rows.mapInArrow(of_batch, "key long, lang_pred string, score double").withColumnRenamed("key", key)


def fitted(df: DataFrame) -> ByteNetwork | None:
    return train(training_sample(df))


#: A document is kept by :func:`confident` from this mean probability on.
LEAST_SCORE = 0.4


def confident(df: DataFrame, network: ByteNetwork | None, text_column: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text has a language with at least ``least_score``; their
    columns stay. A filter within the task, no shuffle."""

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            listed = [t or "" for t in texts]
            p = probabilities(network, listed) if network else [None] * len(listed)
            yield pd.Series([x is not None and float(x.max()) >= least_score for x in p], dtype=bool)

    return df.where(known(F.col(text_column)))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    tune(spark)
    documents = table(spark, sf_dir, "documents")
    held = F.coalesce(remainder() == 2, F.lit(False)).alias("held_out")
    return predict(documents, fitted(documents)).select("doc_id", held, "lang_pred", "score")
