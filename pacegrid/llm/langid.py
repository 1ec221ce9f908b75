"""Language identification by segmentation-marginalised unigrams.

Per language every piece of a fixed public vocabulary has a probability. A word's probability
is the sum over all its segmentations into pieces, which a forward algorithm computes; a text's
is the product over its words. The piece probabilities are learnt by expectation maximisation
over word counts: expected piece counts come from forward and backward sums.

Words are runs of Unicode letters and marks of the lower-cased text with a blank before them, of
any length: a passage of a script without blanks is one word between two marks of punctuation.
Pieces are those of the vocabulary that can occur in such a word, that is with a blank at most
at their start and no other ASCII byte than a-z; single bytes are always pieces, so every word
has a segmentation. Work is linear in a word's bytes.

Defined results: a text that is null or has no letter gets ``und`` and score 0; so does every
text where no language could be learnt; ties go to the first language by code point; repeated
rows each give a row; columns besides id, text and language are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common
from pacegrid.llm.textkernel import P, mix

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Documents of each language that a fit takes on average: those of small hash of the id.
SAMPLE_PER_LANGUAGE = 1000
ROUNDS, SMOOTH = 3, 1e-7
SLOTS = 1 << 20
#: Bytes of text whose distinct words are scored together.
PREDICT_BYTES = 1 << 22
#: Bytes from which on a word is worked on by itself, by its pieces' places.
LONG_WORD = 200
#: Most languages of a fit: their table is broadcast and kept by the driver. More are an error.
MOST_LANGUAGES = 1000
FOLDS, HELD_OUT = 5, 0


@dataclass
class Pieces:
    names: list[bytes]
    slots: np.ndarray  # (SLOTS,) candidates' number + 1 by the hash's top bits, 0 for none
    hashes: np.ndarray  # of the pieces in slot order
    starts: np.ndarray
    longest: int  # bytes of the longest piece


def _hash(columns: np.ndarray) -> np.ndarray:
    """Hashes of byte strings, one per row."""
    h = np.zeros(len(columns), np.uint64)
    for j in range(columns.shape[1]):
        h = (h + columns[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(P)
    return mix(h + np.uint64(columns.shape[1]))


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    with open(path, "rb") as f:
        names = {base64.b64decode(line.split()[0]) for line in f} | {bytes([b]) for b in range(256)}
    inside = lambda b: b > 127 or 97 <= b <= 122
    names = sorted(n for n in names if len(n) == 1 or all(map(inside, n[1:])) and (inside(n[0]) or n[0] == 32))
    hashes = np.concatenate([_hash(np.frombuffer(n, np.uint8)[None, :]) for n in names])
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    starts = np.searchsorted(hashes >> np.uint64(44), np.arange(SLOTS + 1, dtype=np.uint64)).astype(np.int32)
    return Pieces([names[i] for i in order], np.diff(starts).astype(np.int8), hashes, starts, max(map(len, names)))


def lookup(known: Pieces, hashes: np.ndarray) -> np.ndarray:
    """Number of the piece of each hash, or -1."""
    slot = (hashes >> np.uint64(44)).astype(np.int64)
    out = np.full(len(hashes), -1, np.int32)
    left = np.flatnonzero(known.slots[slot] > 0)
    step = 0
    while len(left):
        at = known.starts[slot[left]] + step
        hit = known.hashes[np.minimum(at, len(known.hashes) - 1)] == hashes[left]
        out[left[hit]] = at[hit]
        step += 1
        left = left[~hit & (known.slots[slot[left]] > step)]
    return out


def word_pieces(known: Pieces, words: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """For each end j the numbers of the pieces words[:, j - size : j], (sizes from 1, words)."""
    rolling = np.zeros((0, len(words)), np.uint64)
    for j in range(1, length + 1):
        # The hashes of all pieces that may end here, the shortest first, each a byte longer than before.
        rolling = np.concatenate([np.zeros((1, len(words)), np.uint64), rolling[: known.longest - 1]])
        rolling = (rolling + words[:, j - 1].astype(np.uint64) + np.uint64(1)) * np.uint64(P)
        sizes = np.arange(1, len(rolling) + 1, dtype=np.uint64)[:, None]
        yield lookup(known, mix(rolling + sizes).ravel()).reshape(rolling.shape)


def forward(table: np.ndarray, found: Iterable[np.ndarray], count: int, longest: int) -> np.ndarray:
    """Logarithm of the sum over all segmentations, (words, languages). ``table`` has a zero row
    last, for no piece."""
    alphas, logs = [np.ones((count, table.shape[1]))], np.zeros((count, table.shape[1]))
    for j, ends in enumerate(found, 1):
        alpha = sum(alphas[-size] * table[ids] for size, ids in enumerate(ends, 1) if size == 1 or ids.max() >= 0)
        if j % 8 == 0:  # the sums that are still needed shrink alike
            scale = np.maximum(alpha, 1e-300)
            logs += np.log(scale)
            alphas = [a / scale for a in alphas]
            alpha = alpha / scale
        alphas = [*alphas[-longest + 1 :], alpha]
    return logs + np.log(np.maximum(alphas[-1], 1e-300))


def placed_pieces(known: Pieces, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, pieces, cuts) of all pieces in one word's bytes by their ends: those that end at j
    stand in cuts[j] to cuts[j + 1]."""
    found, h, bytes_ = [], np.zeros(len(word), np.uint64), word.astype(np.uint64) + np.uint64(1)
    for size in range(1, min(known.longest, len(word)) + 1):
        h = (h[: len(word) - size + 1] + bytes_[size - 1 :]) * np.uint64(P)
        ids = lookup(known, mix(h + np.uint64(size)))
        at = np.flatnonzero(ids >= 0)
        found.append(np.stack([at + size, at, ids[at]]))
    ends, starts, ids = np.concatenate(found, axis=1)
    order = np.argsort(ends, kind="stable")
    return starts[order], ids[order], np.searchsorted(ends[order], np.arange(len(word) + 2))


def long_forward(logs_of: np.ndarray, starts: np.ndarray, ids: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """(bytes + 1, languages) logarithms of the sums over all segmentations up to each place."""
    sums = np.zeros((len(cuts) - 1, logs_of.shape[1]))
    for j in range(1, len(sums)):
        terms = sums[starts[cuts[j] : cuts[j + 1]]] + logs_of[ids[cuts[j] : cuts[j + 1]]]
        top = terms.max(axis=0)
        sums[j] = top + np.log(np.exp(terms - top).sum(axis=0))
    return sums


def long_counts(known: Pieces, logs_of: np.ndarray, word: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, expected counts) of one word, a row for each place of a piece."""
    starts, ids, cuts = placed_pieces(known, word)
    sums = long_forward(logs_of, starts, ids, cuts)
    passes, shares = np.zeros_like(sums), np.zeros((len(ids), sums.shape[1]))
    passes[-1] = weights
    for j in range(len(sums) - 1, 0, -1):
        mine = slice(cuts[j], cuts[j + 1])
        shares[mine] = np.exp(sums[starts[mine]] + logs_of[ids[mine]] - sums[j]) * passes[j]
        passes[starts[mine]] += shares[mine]
    return ids, shares


def by_length(lengths: np.ndarray):
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        if len(group):
            yield int(lengths[group[0]]), group


def log_sums(known: Pieces, table: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros((len(start), table.shape[1]))
    logs_of = np.log(np.maximum(table, 1e-300))
    for length, group in by_length(end - start):
        if length > LONG_WORD:
            for i in group:
                out[i] = long_forward(logs_of, *placed_pieces(known, spaced(data, start[i : i + 1], length)[0]))[-1]
            continue
        step = max(1, 400_000 // (length + 1))
        for k in range(0, len(group), step):
            rows = group[k : k + step]
            words = spaced(data, start[rows], length)
            out[rows] = forward(table, word_pieces(known, words, length + 1), len(rows), known.longest)
    return out


def spaced(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    words = np.full((len(start), length + 1), 0x20, np.uint8)
    words[:, 1:] = data[start[:, None] + np.arange(length)]
    return words


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter or a mark, which stands with a letter."""
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bool]]:
    """(bytes, start, end, text) of the words of the lower-cased texts, and whether a text has a
    letter."""
    texts = [(t or "").lower() for t in column.to_pylist()]
    data, offsets = common.text_buffer(pa.array(texts, pa.string()))
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
    inside = letters()[points]
    before, after = np.ones(len(points), bool), np.ones(len(points), bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    cut = np.searchsorted(at, offsets[(offsets > 0) & (offsets < len(data))])
    before[cut], after[cut - 1] = True, True
    start, end = at[:-1][inside & before], at[1:][inside & after]
    return data, start, end, np.searchsorted(offsets, start, side="right") - 1, [any(map(str.isalpha, t)) for t in texts]


def unique_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, number of its word) of the words, compared as bytes by length groups."""
    first, number, seen = [], np.zeros(len(start), np.int64), 0
    for length, group in by_length(end - start):
        rows = np.ascontiguousarray(data[start[group][:, None] + np.arange(length)])
        if length <= 8:
            wide = np.zeros((len(rows), 8), np.uint8)
            wide[:, :length] = rows
            keys = wide.view(np.uint64).ravel()
        else:
            keys = rows.view(np.dtype((np.void, length))).ravel()
        _, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        first.append(group[at])
        number[group] = inverse.ravel() + seen
        seen += len(at)
    return np.concatenate(first) if first else np.zeros(0, np.int64), number


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # (pieces + 1, languages); the last row is zero
    path: str


def expected_counts(known: Pieces, table: np.ndarray, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """(pieces, languages) expected piece counts of words with (words, languages) counts."""
    out = np.zeros((len(known.names) + 1, table.shape[1]))
    logs_of = np.log(np.maximum(table, 1e-300))

    def add(ids: np.ndarray, shares: np.ndarray) -> None:
        for k in range(out.shape[1]):
            out[:, k] += np.bincount(np.where(ids < 0, len(out) - 1, ids), shares[:, k], minlength=len(out))

    lengths = np.array([len(w) for w in words])
    for length, group in by_length(lengths):
        if length > LONG_WORD:
            for i in group:
                add(*long_counts(known, logs_of, np.frombuffer(b" " + words[i], np.uint8), weights[i]))
            continue
        for k in range(0, len(group), max(1, 50_000 // (length + 1))):
            rows = group[k : k + max(1, 50_000 // (length + 1))]
            flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
            grid = spaced(flat, np.arange(len(rows)) * length, length)
            found = list(word_pieces(known, grid, length + 1))
            # Logarithms of the forward sums; no word is too long for them.
            logs = [np.zeros((len(rows), table.shape[1]))]
            for ends in found:
                near = sum(np.exp(logs[-s] - logs[-1]) * table[ids] for s, ids in enumerate(ends, 1) if s == 1 or ids.max() >= 0)
                logs.append(logs[-1] + np.log(np.maximum(near, 1e-300)))
            # Expected times that a segmentation has a boundary at each place.
            cuts, places, shares = [np.zeros((len(rows), table.shape[1])) for _ in logs], [], []
            cuts[-1][:] = weights[rows]
            for j in range(len(found), 0, -1):
                for s, ids in enumerate(found[j - 1], 1):
                    if s > 1 and ids.max() < 0:
                        continue
                    share = np.exp(logs[j - s] - logs[j]) * table[ids] * cuts[j]
                    cuts[j - s] += share
                    places.append(ids), shares.append(share)
            add(np.concatenate(places), np.concatenate(shares))
    return out[:-1]


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Word counts of a bounded sample are summed by Spark; each round of expectation
    maximisation computes expected piece counts on the executors and sums them by piece."""
    path = path or public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.crc32_bucket("id", FOLDS) != HELD_OUT))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()}
    languages = sorted(counts)
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not languages:
        return None
    share = F.create_map(*(x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / counts[lang])))))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches):
        for batch in common.text_slices(batches, "text"):
            data, start, end, doc, _ = words_of(batch.column(1))
            first, number = unique_words(data, start, end)
            lang = np.array([languages.index(x) for x in batch.column(2).to_pylist()])
            pairs, n = np.unique(number * len(languages) + lang[doc], return_counts=True)
            at = first[pairs // len(languages)]
            words = [data[a:b].tobytes() for a, b in zip(start[at], end[at], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array((pairs % len(languages)).astype(np.int32)), pa.array(n)], ["word", "lang", "n"])

    counted = sample.mapInArrow(count, "word binary, lang int, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    lists = counted.groupBy("word").agg(F.collect_list(F.struct("lang", F.col("n").cast("double").alias("n"))).alias("by_lang"))
    lists = common.written(lists, "langid-words").repartition(4 * spark.sparkContext.defaultParallelism)

    known = pieces(path)
    table = np.ones((len(known.names) + 1, len(languages))) / len(known.names)
    table[-1] = 0
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(table)

        def expect(batches, shared=shared):
            own, total = pieces(path), np.zeros((len(known_names), len(languages)))
            for batch in batches:
                weights = np.zeros((batch.num_rows, len(languages)))
                for i, found in enumerate(batch.column(1).to_pylist()):
                    for x in found:
                        weights[i, x["lang"]] = x["n"]
                total += expected_counts(own, shared.value, batch.column(0).to_pylist(), weights)
            at, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(total[at, lang])], ["piece", "lang", "n"])

        known_names = range(len(known.names))
        summed = lists.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toArrow().sort_by([("piece", "ascending"), ("lang", "ascending")])
        new = np.zeros((len(known.names), len(languages)))
        new[summed["piece"].to_numpy(), summed["lang"].to_numpy()] = summed["n"].to_numpy()
        new = new / np.maximum(1e-9, new.sum(axis=0)) + SMOOTH
        table[:-1] = new / new.sum(axis=0)
    return Model(languages, table, path)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score); the score is the language's posterior probability
    under equal priors, each text's log-likelihood taken per 100 bytes at most."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        model = shared.value
        for batch in common.text_slices(batches, "text", PREDICT_BYTES):
            n = batch.num_rows
            names, scores = ["und"] * n, np.zeros(n)
            if model is not None:
                data, start, end, doc, has = words_of(batch.column(1))
                first, number = unique_words(data, start, end)
                logs = log_sums(pieces(model.path), model.table, data, start[first], end[first])
                total = np.stack([np.bincount(doc, logs[number, k], minlength=n) for k in range(len(model.languages))], axis=1)
                best = total.argmax(axis=1)
                long = np.maximum(1.0, np.bincount(doc, end - start, minlength=n) / 100)[:, None]
                share = np.exp((total - total.max(axis=1, keepdims=True)) / long)
                share = share.max(axis=1) / share.sum(axis=1)
                names = [model.languages[b] if h else "und" for b, h in zip(best, has, strict=True)]
                scores = np.where(has, share, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {id_type}, lang_pred string, score double")
    held = F.coalesce(common.crc32_bucket("id", FOLDS) == HELD_OUT, F.lit(False))
    return found.select(F.col("id").alias(id_col), held.alias("held_out"), "lang_pred", "score")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
