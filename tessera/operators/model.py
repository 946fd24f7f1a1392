"""Prediction tables: sample selection and splits, batch scoring, and a stand-in classifier.

The convolutional classifier itself needs a deep-learning library; its predictions enter as a table (entity, date,
p_up). ``convolutional_scores`` runs such a model's forward pass in numpy over packed charts, given its weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .raster import image_size, unpack

#: Blocks of the network by window; block k has 64 * 2^k filters of 5 x 3, LeakyReLU 0.01 and 2 x 1 pooling (fixed values).
BLOCKS = {5: 2, 20: 3, 60: 4}


def time_split(samples: DataFrame, last_train: str, first_test: str) -> tuple[DataFrame, DataFrame]:
    return samples.where(F.col("date") <= F.lit(last_train).cast("date")), samples.where(F.col("date") >= F.lit(first_test).cast("date"))


def md5_split(samples: DataFrame, share: float = 0.7, seed: int = 42) -> DataFrame:
    """Adds ``part`` (train or valid) by a digest of key and seed: the same on every run, partitioning and engine."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("entity").cast("string"), F.col("date").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return samples.withColumn("part", F.when(u < share, "train").otherwise("valid"))


def _conv(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Same-size convolution, images x channels x rows x columns."""
    kh, kw = w.shape[2:]
    p = np.pad(x, ((0, 0), (0, 0), (kh // 2, kh // 2), (kw // 2, kw // 2)))
    v = np.lib.stride_tricks.sliding_window_view(p, (kh, kw), axis=(2, 3))
    return np.einsum("nchwij,fcij->nfhw", v, w, optimize=True) + b[None, :, None, None]


def forward(images: np.ndarray, weights: dict[str, np.ndarray], blocks: int, mean: float, std: float) -> np.ndarray:
    """Probability of the second class."""
    x = (images[:, None].astype(np.float32) * 255 - mean) / std
    for k in range(blocks):
        x = _conv(x, weights[f"conv{k}.w"], weights[f"conv{k}.b"])
        x = (x - weights[f"bn{k}.mean"][None, :, None, None]) / np.sqrt(weights[f"bn{k}.var"] + 1e-5)[None, :, None, None]
        x = x * weights[f"bn{k}.w"][None, :, None, None] + weights[f"bn{k}.b"][None, :, None, None]
        x = np.where(x > 0, x, 0.01 * x)
        if x.shape[2] % 2:
            x = np.concatenate([x, np.full_like(x[:, :, :1], -np.inf)], axis=2)
        x = x.reshape(x.shape[0], x.shape[1], x.shape[2] // 2, 2, x.shape[3]).max(axis=3)
    z = x.reshape(len(x), -1) @ weights["fc.w"].T + weights["fc.b"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return (e / e.sum(axis=1, keepdims=True))[:, 1]


def random_weights(window: int, seed: int = 0, filters: int = 64) -> dict[str, np.ndarray]:
    rng, (h, w), channels, out = np.random.default_rng(seed), image_size(window), 1, {}
    for k in range(BLOCKS[window]):
        f = filters << k
        out |= {f"conv{k}.w": rng.normal(0, (channels * 15) ** -0.5, (f, channels, 5, 3)).astype(np.float32), f"conv{k}.b": np.zeros(f, np.float32)}
        out |= {f"bn{k}.mean": np.zeros(f, np.float32), f"bn{k}.var": np.ones(f, np.float32), f"bn{k}.w": np.ones(f, np.float32), f"bn{k}.b": np.zeros(f, np.float32)}
        channels, h = f, -(-h // 2)
    return out | {"fc.w": rng.normal(0, 0.01, (2, channels * h * w)).astype(np.float32), "fc.b": np.zeros(2, np.float32)}


def convolutional_scores(images: DataFrame, weights: dict[str, np.ndarray], window: int, mean: float, std: float, batch: int = 64) -> DataFrame:
    """entity, date, p_up from packed charts; weights travel once per executor."""
    spark = images.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(weights)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts:
            for at in range(0, whole.num_rows, batch):
                b = whole.slice(at, batch)
                x = np.stack([unpack(i.as_py(), window) for i in b.column(2)])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(forward(x, shared.value, BLOCKS[window], mean, std).astype(float))], ["entity", "date", "p_up"])

    return images.select("entity", "date", "image").mapInArrow(run, f"entity {images.schema['entity'].dataType.simpleString()}, date date, p_up double")


def fit_stand_in(train: DataFrame, features: list[str], label: str):
    """A logistic regression on image-scaled lags in place of the network."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    steps = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol=label, maxIter=50)]
    return Pipeline(stages=steps).fit(train)


def stand_in_scores(model, rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select("entity", "date", F.element_at(vector_to_array("probability"), 2).alias("p_up"))
