"""Quality classifier: zstandard dictionaries of good and of bad text, and a calibrated score."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pcframe.llm.common import as_bytes, cut, small_batches

#: Bounds of the sample that the model is fitted on, for each label.
SAMPLE_CHUNKS = 2_000
SAMPLE_DOCS = 2_000
CHUNK_CHARS = 2_000
DICT_BYTES = 64 * 1024
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]


def _features(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> tuple[float, float, float]:
    """Normalised difference of compressed sizes over the whole text in chunks of bounded size
    (so that a long text can't outgrow the dictionaries), the better ratio, and the length."""
    g = b = 0
    step = 4 * CHUNK_CHARS
    for at in range(0, len(text), step):
        part = text[at : at + step]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    n = max(len(text), 1)
    return (b - g) / max(b, g, 1), min(b, g) / n, float(np.log1p(len(text)))


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    return [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (good, bad)]


def _dictionary(chunks: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too little text, that text itself."""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, chunks)) // 4)), chunks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(chunks)[-size:] or b"\0" * 8


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method, each label weighing the same, lightly regularised."""
    share = y.mean()
    weight = np.where(y == 1, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
    x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = 1e-3 * len(x) * np.diag([*[1.0] * (x.shape[1] - 1), 1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train=None) -> Model:
    """Fit on a bounded sample of the labelled rows where train (a condition on the id) holds.

    Of each label the SAMPLE_DOCS documents with the smallest hashes of their ids are read. From
    those of even hash, cut whole into chunks of CHUNK_CHARS characters, the SAMPLE_CHUNKS
    with the smallest hashes make the dictionaries; the sample's other half calibrates the
    score. Labels other than 0 and 1 and null ids are left out; if a label has no rows, every
    score is 0.5.
    """
    wanted = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    if train is not None:
        wanted = wanted.where(train)
    spark = docs.sparkSession
    small_batches(spark)
    wanted = wanted.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__y")).withColumn("__h", F.xxhash64("__id"))
    chosen = [r for y in (0, 1) for r in wanted.where(F.col("__y") == y).orderBy("__h").limit(SAMPLE_DOCS).collect()]
    if len({r["__y"] for r in chosen}) < 2:
        return Model(b"\0" * 8, b"\0" * 8, (0.0,) * 4, (0.0,) * 3, (1.0,) * 3)
    side = F.broadcast(spark.createDataFrame(chosen, wanted.schema))  # 2 * SAMPLE_DOCS rows at most
    both = cut(docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__t")).where(F.length("__t") > 0).join(side, "__id"), "sample")
    chunks = both.where("__h % 2 = 0").select("__y", F.explode(F.expr(f"transform(sequence(1, length(__t), {CHUNK_CHARS}), i -> substring(__t, i, {CHUNK_CHARS}))")).alias("__c"))
    chunks = chunks.withColumn("__k", F.xxhash64("__c"))
    got = {y: [r[0].encode() for r in chunks.where(F.col("__y") == y).orderBy("__k", "__c").select("__c").limit(SAMPLE_CHUNKS).collect()] for y in (0, 1)}
    good, bad = (_dictionary(got[y], DICT_BYTES) for y in (1, 0))

    # the features of whole texts, not the texts, come to the driver
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = _compressors(good, bad)
        for batch in batches:
            f = [_features(t, g, b) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[i] for x in f], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    table = both.where("__h % 2 <> 0").select("__y", "__t").mapInArrow(measured, "y int, a double, b double, c double")
    rest = sorted(table.collect())
    y = np.array([r["y"] for r in rest], float)
    if len(set(y)) < 2:
        return Model(good, bad, (0.0, 0.0, 0.0, 0.0), (0.0,) * 3, (1.0,) * 3)
    x = np.array([[r["a"], r["b"], r["c"]] for r in rest])
    center, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - center) / scale, y)
    return Model(good, bad, tuple(map(float, w)), tuple(map(float, center)), tuple(map(float, scale)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score in [0, 1] (higher: label 1 likelier), predicted (1 if score >= 0.5).

    One pass, no shuffle; the model's two dictionaries (DICT_BYTES each) go with the task.
    A null text is empty and is scored as such; repeated rows and null ids are kept; an empty
    table gives no rows; other columns are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col))
    out = rows.schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, b = _compressors(model.good, model.bad)
        w, c, s = (np.array(v) for v in (model.weights, model.center, model.scale))
        for batch in batches:
            texts = as_bytes(batch.column(1))
            x = (np.array([_features(t, g, b) for t in texts]).reshape(-1, 3) - c) / s
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [out.name, "score", "predicted"])

    return rows.mapInArrow(run, f"`{out.name}` {out.dataType.simpleString()}, score double, predicted int")
