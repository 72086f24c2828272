"""A quality classifier by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed twice, in blocks of BLOCK bytes, with a dictionary trained on good text and with one trained on bad
text. Blocks keep the dictionaries' influence alike in short and in very long texts. The difference of the compressed
sizes for each byte of text says which kind the text resembles; a logistic curve, fitted on labelled rows that did not
train the dictionaries and weighted to the share of each label, turns it into a score. Texts are scored whole.

Bounds of the fit, the only thing held on the driver: TRAIN_ROWS labelled rows per label and purpose (dictionary,
calibration), those of the smallest hash, of at most TRAIN_CHARS characters each. They do not grow with the corpus.

Defined results: a null text counts as empty; an empty text has a difference of 0 and scores what the curve gives
there; repeated rows score alike. Without labelled rows of both kinds every score is the prior, 0.5 if there are none.
Labels that are null or neither 0 nor 1, and labels of a document that has several different ones, are not learned from.
Columns named like the added ones are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Scratch, table, without

TRAIN_ROWS, TRAIN_CHARS = 1000, 10_000
DICT_BYTES, LEVEL, BLOCK = 32_000, 3, 512
THRESHOLD = 0.7


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Scorer:
    """Scores whole texts; the compressors are made once for each process that scores."""

    def __init__(self, model: Model):
        self.model, self.kits = model, []
        for data in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_AUTO) if data else None
            if d is not None:
                d.precompute_compress(level=LEVEL)
            self.kits.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False) if d else None)

    def difference(self, data: bytes) -> float:
        """(bad - good) / length, of the compressed sizes: positive where the good dictionary helps more."""
        if not data or None in self.kits:
            return 0.0
        blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)]
        good, bad = (sum(map(len, map(k.compress, blocks))) for k in self.kits)
        return (bad - good) / len(data)

    def score(self, data: bytes) -> float:
        z = self.model.slope * self.difference(data) + self.model.offset
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, z))))


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document is kept for evaluation."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset by Newton's method with a slight pull to zero."""
    scale = float(np.abs(x).mean()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w, pull = np.zeros(2), np.array([1e-4, 1e-6]) * weight.sum()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        grad = a.T @ (weight * (p - y)) + pull * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learns from labelled rows that are not held out."""
    spark = docs.sparkSession
    h = F.xxhash64(F.col(id_col).cast("string"))
    wanted = labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col(id_col)))
    wanted = wanted.groupBy(id_col).agg(F.min(label).alias("label_low"), F.max(label).alias("label_high"))
    wanted = wanted.filter("label_low = label_high").select(id_col, F.col("label_low").alias("label_is"), h.alias("label_hash"))
    counts = {r["label_is"]: r["count"] for r in wanted.groupBy("label_is").count().collect()}
    n = [counts.get(0, 0), counts.get(1, 0)]
    prior = (n[1] + 1) / (sum(n) + 2)
    flat = Model(b"", b"", 0.0, math.log(prior / (1 - prior)))
    if not all(n):
        return flat
    # as many ids as may be needed, and as many again for those whose texts are missing, empty or long
    below = [min(1.0, 8 * TRAIN_ROWS / k) * 2**62 for k in n]
    near = F.shiftrightunsigned("label_hash", 2) < F.when(F.col("label_is") == 1, F.lit(below[1])).otherwise(F.lit(below[0]))
    picked = Scratch(spark, "quality-ids").put(wanted.filter(near))
    texts = docs.select(id_col, F.col(text).alias("label_text")).filter(F.length("label_text").between(1, TRAIN_CHARS))
    rows = Scratch(spark, "quality-texts").put(texts.join(picked, id_col).select("label_is", "label_hash", "label_text"))
    groups = {}
    for kind in (1, 0):
        for purpose in (0, 1):
            part = rows.filter((F.col("label_is") == kind) & (F.pmod("label_hash", F.lit(2)) == purpose))
            part = part.orderBy("label_hash", "label_text").limit(TRAIN_ROWS)
            groups[kind, purpose] = [r["label_text"].encode() for r in part.select("label_text").collect()]
    if not groups[1, 0] or not groups[0, 0]:
        return flat
    share = min(sum(map(len, groups[k, 0])) for k in (0, 1))
    good, bad = (_dictionary(groups[k, 0], share) for k in (1, 0))
    scorer = Scorer(Model(good, bad, 1.0, 0.0))
    held = {k: groups[k, 1] or groups[k, 0] for k in (0, 1)}
    x = np.array([scorer.difference(t) for k in (0, 1) for t in held[k]])
    y = np.array([float(k) for k in (0, 1) for _ in held[k]])
    weight = np.array([n[k] / sum(n) / len(held[k]) for k in (0, 1) for _ in held[k]])
    return Model(good, bad, *_logistic(x, y, weight))


def _dictionary(texts: list[bytes], share: int) -> bytes:
    """A dictionary of at most DICT_BYTES from about as much text of either kind; small samples serve as raw content."""
    used, kept = 0, []
    for x in texts:
        if kept and used + len(x) > share:
            break
        kept += [x[at : at + BLOCK] for at in range(0, len(x), BLOCK)]
        used += len(x)
    size = min(DICT_BYTES, max(256, used // 4))
    try:
        return zstandard.train_dictionary(size, kept).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(kept)[-size:]


def score_quality(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (double) and predicted (int)."""
    df = without(df, *[n for n in ("score", "predicted") if n != text.lower()])
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = [scorer.score((x.as_py() or "").encode()) for x in batch.column(batch.schema.get_field_index(text))]
            columns = [pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "score", "predicted"])

    return df.mapInArrow(run, schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents scored by a model of the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
