"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed. A fit takes a bounded sample of labelled rows and
their terms. Terms that differ between the labels beyond chance count alone; besides, every pair
of terms of ``PAIR_DOCS`` rows is tested on the errors of an additive model over those, and pairs
beyond chance give their terms however balanced each is alone. No number of terms is fixed. Over
these terms the factorization machine learns a bias, a weight per term and a short vector per
term whose products weigh every pair: pairs that are toxic only together are learnt where
additive weights miss them.

Defined results: a null text counts as empty; a text without any kept term gets the bias
alone; repeated rows each give a row; rows with a null id are never labelled; without labelled
rows of both classes every score is the share of label 1, or 0 without any; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common
from pacegrid.llm.features import word_terms
from pacegrid.llm.quality import labelled_sample

#: Most labelled rows of each class that a fit takes: those with the smallest hash of the id.
SAMPLE_PER_CLASS = 4000
#: Rows of the sample that a term is in at least, and a term of a tested pair.
LEAST_DOCS, PAIR_DOCS = 3, 32
#: Standard deviations of chance beyond which a term alone, and a pair, counts.
ALONE, TOGETHER = 3.0, 6.0
#: Terms of one block of pairs, and steps and first rate of the additive model.
BLOCK, ADDITIVE_STEPS, ADDITIVE_RATE = 1024, 200, 0.2
BITS, FACTORS = 18, 8
STEPS, RATE, DECAY = 400, 0.05, 1e-3
FOLDS, HELD_OUT = 5, 0


@dataclass
class Model:
    place: np.ndarray  # (2 ** BITS,) place of a slot's term, or -1
    bias: float
    linear: np.ndarray  # (terms,)
    factors: np.ndarray  # (terms, FACTORS)


def present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, slot) pairs."""
    doc, slot = word_terms(data, offsets, BITS)
    pairs = np.unique((doc.astype(np.int64) << BITS) | slot)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def lone_terms(doc: np.ndarray, term: np.ndarray, terms: int, y: np.ndarray) -> np.ndarray:
    """Terms whose two-proportion z statistic is beyond ``ALONE``."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    one, zero = (np.bincount(term[y[doc] == k], minlength=terms) for k in (1, 0))
    pooled = (one + zero) / (n1 + n0)
    z = np.abs(one / n1 - zero / n0) / np.sqrt(np.maximum(1e-9, pooled * (1 - pooled)) * (1 / n1 + 1 / n0))
    return np.flatnonzero(z > ALONE)


def additive_errors(doc: np.ndarray, term: np.ndarray, terms: int, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What a logistic model over sparse (row, term) pairs leaves of each row's label."""
    scale = weight / weight.sum()
    share = float((scale * y).sum())
    now = np.concatenate([np.zeros(terms), [np.log(share / (1 - share))]])
    first, second = np.zeros_like(now), np.zeros_like(now)
    guess = lambda: 1 / (1 + np.exp(-np.clip(now[-1] + np.bincount(doc, now[term], minlength=len(y)), -30, 30)))
    for step in range(1, ADDITIVE_STEPS + 1):
        error = scale * (guess() - y)
        g = np.concatenate([np.bincount(term, error[doc], minlength=terms), [error.sum()]])
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        rate = ADDITIVE_RATE * (1 - (step - 1) / ADDITIVE_STEPS)
        now = now - rate * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return y - guess()


def paired_terms(spark, doc: np.ndarray, term: np.ndarray, terms: int, errors: np.ndarray) -> np.ndarray:
    """Terms of the pairs whose common rows' errors add up to ``TOGETHER`` standard deviations of
    chance. All pairs of terms of ``PAIR_DOCS`` rows are tested, a block of pairs in a task."""
    often = np.flatnonzero(np.bincount(term, minlength=terms) >= PAIR_DOCS)
    at = np.full(terms, -1, np.int64)
    at[often] = np.arange(len(often))
    kept = at[term] >= 0
    shared = spark.sparkContext.broadcast((doc[kept].astype(np.int32), at[term[kept]].astype(np.int32), errors.astype(np.float32)))
    blocks = -(-len(often) // BLOCK)

    def test(batches):
        rows, places, r = shared.value

        def columns(k: int) -> np.ndarray:
            mine = places // BLOCK == k
            out = np.zeros((len(r), BLOCK), np.float32)
            out[rows[mine], places[mine] % BLOCK] = 1
            return out

        for batch in batches:
            for pair in batch.column(0).to_pylist():
                i, j = divmod(pair, blocks)
                if i > j:
                    continue
                left, right = columns(i), columns(j)
                total, chance = (left * r[:, None]).T @ right, (left * (r * r)[:, None]).T @ right
                beyond = np.abs(total) > TOGETHER * np.sqrt(np.maximum(chance, 1.0))
                found = [np.unique(np.concatenate([k * BLOCK + np.flatnonzero(beyond.any(axis=axis)) for k, axis in ((i, 1), (j, 0))]))]
                if i == j and len(found[0]):
                    np.fill_diagonal(beyond, False)
                    found = [i * BLOCK + np.flatnonzero(beyond.any(axis=0) | beyond.any(axis=1))]
                yield pa.RecordBatch.from_arrays([pa.array(found[0].astype(np.int32))], ["place"])

    if not blocks:
        return often
    found = spark.range(0, blocks * blocks, 1, blocks * blocks).mapInArrow(test, "place int").distinct().toArrow()
    return often[np.sort(found["place"].to_numpy())]


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted logistic loss with L2 decay by Adam over the whole sample at each step."""
    rng = np.random.default_rng(7)
    params = [np.array([np.log((weight * y).sum() / max(1e-9, (weight * (1 - y)).sum()))]), np.zeros(x.shape[1]), rng.normal(0, 0.01, (x.shape[1], FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    scale = weight / weight.sum()
    for step in range(1, STEPS + 1):
        bias, linear, factors = params
        sums = x @ factors.astype(np.float32)
        logit = bias + x @ linear.astype(np.float32) + 0.5 * ((sums**2).sum(axis=1) - x @ (factors**2).sum(axis=1).astype(np.float32))
        error = (scale * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y)).astype(np.float32)
        per_term = error @ x
        grads = [np.array([error.sum()]), per_term + DECAY * linear / len(y) ** 0.5, x.T @ (error[:, None] * sums) - per_term[:, None] * factors + DECAY * factors]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, **columns) -> Model | float:
    """The model, or the share of label 1 where both classes aren't there. The executors compute
    terms; the driver gets the distinct slots of ``2 * per_class`` rows at most."""
    sample, counts = labelled_sample(docs, labels, "toxic", FOLDS, HELD_OUT, per_class, **columns)

    def terms(batches):
        for batch in common.text_slices(batches, "text"):
            doc, slot = present(*common.text_buffer(batch.column(1)))
            cut = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(slot.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2).cast(pa.int32()), lists], ["id", "label", "slots"])

    rows = sample.mapInArrow(terms, f"id {sample.schema['id'].dataType.simpleString()}, label int, slots array<int>").toArrow().sort_by("id")
    y = rows["label"].to_numpy().astype(np.int64)
    if len(set(y.tolist())) < 2:
        return counts.get(1, 0) / max(1, sum(counts.values()))
    lists = rows["slots"].combine_chunks()
    slot = lists.flatten().to_numpy()
    doc = np.repeat(np.arange(len(y)), np.diff(lists.offsets.to_numpy()))
    share = [counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)]
    weight = np.where(y == 1, share[1], share[0])
    known = np.flatnonzero(np.bincount(slot, minlength=1 << BITS) >= LEAST_DOCS)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    doc, term = doc[place[slot] >= 0], place[slot[place[slot] >= 0]]
    alone = lone_terms(doc, term, len(known), y)
    column = np.full(len(known), -1, np.int64)
    column[alone] = np.arange(len(alone))
    mine = column[term] >= 0
    errors = additive_errors(doc[mine], column[term[mine]], len(alone), y, weight)
    kept = np.union1d(alone, paired_terms(docs.sparkSession, doc, term, len(known), errors)).astype(np.int64)
    place = np.full(1 << BITS, -1, np.int32)
    place[known[kept]] = np.arange(len(kept))
    column = np.full(len(known), -1, np.int64)
    column[kept] = np.arange(len(kept))
    x = np.zeros((len(y), len(kept)), np.float32)
    x[doc[column[term] >= 0], column[term[column[term] >= 0]]] = 1
    return Model(place, *train(x, y.astype(np.float64), weight))


def scores_of(model: Model | float, column: pa.Array) -> np.ndarray:
    n = len(column)
    if isinstance(model, float):
        return np.full(n, model)
    doc, slot = present(*common.text_buffer(column))
    term = model.place[slot]
    doc, term = doc[term >= 0], term[term >= 0]
    per_text = lambda values: np.bincount(doc, values, minlength=n)
    logit = model.bias + per_text(model.linear[term])
    for f in range(FACTORS):
        v = model.factors[term, f]
        logit += 0.5 * (per_text(v) ** 2 - per_text(v * v))
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in common.text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores_of(shared.value, batch.column(1)), pa.float64())], ["id", "score"])

    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, score double")
    held = F.coalesce(common.crc32_bucket("id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity_fm(spark, sf_dir: str) -> DataFrame:
    docs, labels = (common.read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return score(docs, fit(docs, labels))
