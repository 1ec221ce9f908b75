"""Quality classifier by nearest-neighbour voting over latent-semantic vectors.

Hashed words, word pairs and shape terms of a bounded sample of labelled rows are weighed by
inverse document frequency and reduced by a truncated SVD. The labelled vectors are broadcast; every document
gets the exact cosine against all of them, block by block as one matrix product, and its
nearest neighbours vote with their similarity.

Defined results: a null text counts as empty; an empty text is scored like any other by its
measures; repeated rows each give a row; rows with a null id are never labelled; without
labelled rows of both classes every score is the share of label 1, or 1 without any; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common
from pacegrid.llm.features import shape_matrix, word_matrix

#: Most labelled rows of each class that a fit takes: those with the smallest hash of the id.
SAMPLE_PER_CLASS = 1500
SHAPES, WORDS, RANK, NEIGHBOURS, POWER = 1024, 1024, 64, 25, 4
#: Factor of words and word pairs against shapes.
WORD_WEIGHT = 1.0
#: Labels of rows of this remainder of crc32(id) by FOLDS are held out.
FOLDS, HELD_OUT = 3, 1


@dataclass
class Model:
    weights: np.ndarray  # (terms,) inverse document frequencies
    basis: np.ndarray  # (terms, RANK)
    vectors: np.ndarray  # (RANK, labelled) of unit length
    labels: np.ndarray
    prior: float
    balance: tuple[float, float]  # rows that one labelled row of class 0, 1 stands for


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(id, text, label) of at most ``per_class`` labelled rows of each class outside the held-out
    fold, and all labelled rows' counts by class. The id list is bounded by that and broadcast; of
    rows that share an id the one of the greatest text counts, so the sample is bounded too."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (common.crc32_bucket("doc_id", folds) != held_out))
    usable = usable.groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    order = F.xxhash64("doc_id", F.lit(17))
    picked = [usable.filter(F.col("label") == k).orderBy(order, "doc_id").limit(per_class) for k in (0, 1)]
    ids = F.broadcast(picked[0].unionByName(picked[1]).select(F.col("doc_id").alias("__id"), "label"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = rows.join(ids, rows.id == F.col("__id")).groupBy("id").agg(F.max("text").alias("text"), F.max("label").alias("label"))
    return sample, counts


def term_matrix(column: pa.Array) -> np.ndarray:
    """(texts, terms) float32 of a text column."""
    data, offsets = common.text_buffer(column)
    return np.concatenate([shape_matrix(data, offsets, SHAPES), WORD_WEIGHT * word_matrix(data, offsets, WORDS)], axis=1)


def _unit(found: np.ndarray) -> np.ndarray:
    return found / np.maximum(1e-9, np.linalg.norm(found, axis=1, keepdims=True))


def _vectors(raw: np.ndarray, model: Model) -> np.ndarray:
    return _unit((raw * model.weights) @ model.basis)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, **columns) -> Model | None:
    """The model, or None without labelled rows. Features are computed by the executors; the
    driver gets ``2 * per_class`` rows of shares at most."""
    sample, counts = labelled_sample(docs, labels, "quality", FOLDS, HELD_OUT, per_class, **columns)

    def shapes(batches):
        for batch in common.text_slices(batches, "text"):
            raw = term_matrix(batch.column(1)).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary())], ["id", "label", "raw"])

    rows = sample.mapInArrow(shapes, f"id {sample.schema['id'].dataType.simpleString()}, label int, raw binary").toArrow()
    return model_of(rows, counts) if rows.num_rows else None


def model_of(rows: pa.Table, counts: dict[int, int]) -> Model:
    """The model of labelled rows (id, label, raw). The driver holds their shares once, as sent; wider copies
    live for one product each, and none while the basis is computed."""
    order = pc.sort_indices(rows, [("id", "ascending")])
    raw = np.empty((rows.num_rows, SHAPES + WORDS), np.float16)
    column = rows["raw"].combine_chunks()
    for at, row in enumerate(order.to_numpy()):
        raw[at] = np.frombuffer(column[row].as_buffer(), np.float16)
    y = rows["label"].take(order).to_numpy().astype(np.float32)
    del rows, column
    pa.default_memory_pool().release_unused()
    weights = np.log((1 + len(raw)) / (1 + np.array([np.count_nonzero(c > 0) for c in raw.T]))).astype(np.float32) + 0.2

    def weighted():
        wide = raw.astype(np.float32)
        wide *= weights
        return wide

    basis = _basis(weighted)
    model = Model(weights, basis, np.zeros((0, 0)), y, 0.0, (1.0, 1.0))
    total = max(1, sum(counts.values()))
    model.prior = counts.get(1, 0) / total
    model.balance = tuple(counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1))
    model.vectors = np.ascontiguousarray(_unit(weighted() @ basis).T)
    return model


def _basis(weighted) -> np.ndarray:
    """(terms, RANK): the leading eigenvectors of the rows' products."""
    wide = weighted()
    products = wide.T @ wide
    del wide
    return np.ascontiguousarray(np.linalg.eigh(products)[1][:, ::-1][:, :RANK])


def vote(raw: np.ndarray, model: Model) -> np.ndarray:
    """Scores of a block of feature rows: similarity-weighted votes of the nearest labelled
    vectors, each standing for its class's share of the labelled rows."""
    if len(set(model.labels.tolist())) < 2:
        return np.full(len(raw), model.prior)
    cosines = _vectors(raw, model).astype(np.float32) @ model.vectors
    k = min(NEIGHBOURS, cosines.shape[1])
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    votes = np.maximum(1e-6, np.take_along_axis(cosines, near, axis=1).astype(np.float64)) ** POWER
    label = model.labels[near]
    votes *= np.where(label == 1, model.balance[1], model.balance[0])
    return np.clip((votes * label).sum(axis=1) / votes.sum(axis=1), 0.0, 1.0)


def scores_of(model: Model | None, column: pa.Array) -> np.ndarray:
    if model is None:
        return np.ones(len(column))
    return vote(term_matrix(column), model)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(shared.value, batch.column(1)), pa.float64())], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double")
    held = F.coalesce(common.crc32_bucket("id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.text_slices(batches, text_col):
            yield batch.filter(pa.array(scores_of(shared.value, batch.column(batch.schema.get_field_index(text_col))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_knn(spark, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
