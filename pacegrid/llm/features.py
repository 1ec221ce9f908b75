"""Hashed features of texts for the classifiers: shape n-grams with repetition measures, words and
word pairs, and word terms. All work on the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from pacegrid.llm.textkernel import M1, P, Words, letter_words, mix, spaced_words

#: Share and length buckets that stand behind the hashed shape n-grams.
EXTRA = 48

#: Told apart by n-gram or prefix length.
M = [np.uint64(k * int(M1) % 2**64) for k in range(8)]


def _shape_table() -> np.ndarray:
    """Byte classes: 1 lower-case letter or byte above 127, 2 capital, 3 digit, 4 blank, 5 line
    break; other ASCII bytes are classes of their own."""
    table = np.arange(256, dtype=np.uint64) + 8
    table[ord("a") : ord("z") + 1] = 1
    table[128:] = 1
    table[ord("A") : ord("Z") + 1] = 2
    table[ord("0") : ord("9") + 1] = 3
    table[[0x20, 0x09]] = 4
    table[[0x0A, 0x0B, 0x0C, 0x0D]] = 5
    return table


SHAPES = _shape_table()


def shape_matrix(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """(texts, width) float32: shares of hashed n-grams (1 to 4) of the shape string, in which
    runs of one class count once, and buckets of repetition, length and capitals."""
    docs = len(offsets) - 1
    grams = width - EXTRA
    out = np.zeros((docs, width), np.float32)
    shapes = SHAPES[data]
    new = np.ones(len(shapes), bool)
    new[1:] = shapes[1:] != shapes[:-1]
    starts = offsets[:-1][offsets[:-1] < len(shapes)]
    new[starts] = True
    kept = np.flatnonzero(new)
    run = shapes[kept]
    doc = np.searchsorted(offsets, kept, side="right") - 1
    total = np.bincount(doc, minlength=docs).astype(np.float32)
    h = np.zeros(len(run), np.uint64)
    for n in range(1, 5):
        h = h[: len(run) - n + 1] * np.uint64(P) + run[n - 1 :] + np.uint64(1)
        if not len(h):
            break
        same = doc[: len(h)] == doc[n - 1 :]
        slot = (mix(h[same] + M[n]) % np.uint64(grams)).astype(np.int64)
        counts = np.bincount(doc[: len(h)][same] * grams + slot, minlength=docs * grams)
        out[:, :grams] += counts.reshape(docs, grams)
    out[:, :grams] = np.sqrt(out[:, :grams] / np.maximum(1, 4 * total)[:, None])
    out[:, grams:] = _measures(data, offsets)
    return out


def _measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    docs = len(offsets) - 1
    words = Words(data, offsets, spaced_words())
    n = np.bincount(words.doc, minlength=docs)
    pairs = np.unique(np.stack([words.doc.astype(np.uint64), words.hash]), axis=1) if len(words.doc) else np.zeros((2, 0), np.uint64)
    distinct = np.bincount(pairs[0].astype(np.int64), minlength=docs)
    repeated = np.zeros(docs)
    if len(words.doc) > 1:
        again = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
        repeated = np.bincount(words.doc[1:][again], minlength=docs)
    out = np.zeros((docs, EXTRA), np.float32)
    rows = np.arange(docs)
    # Herdan's ratio doesn't fall with length as the plain ratio does.
    variety = np.where(n > 1, np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)), 1.0)
    out[rows, np.minimum(15, (variety * 15.999).astype(int))] = 0.3
    out[rows, 16 + np.minimum(15, (repeated / np.maximum(1, n) * 15.999).astype(int))] = 0.3
    out[rows, 32 + np.minimum(15, np.log2(n + 1).astype(int))] = 0.1
    return out


def word_matrix(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """(texts, width) float32: roots of the shares of hashed words and pairs of neighbouring words
    (A-Z lower-cased)."""
    docs = len(offsets) - 1
    words = Words(data, offsets, letter_words())
    doc, h = words.doc, words.hash
    near = doc[1:] == doc[:-1]
    pairs = mix(h[:-1][near] * np.uint64(P) + h[1:][near] + M[2])
    doc, h = np.concatenate([doc, doc[1:][near]]), np.concatenate([h, pairs])
    counts = np.bincount(doc * width + (h % np.uint64(width)).astype(np.int64), minlength=docs * width).reshape(docs, width)
    return np.sqrt(counts / np.maximum(1, np.bincount(doc, minlength=docs))[:, None]).astype(np.float32)


def word_terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of all hashed terms, repeats included: words (A-Z lower-cased) and their
    first 4, 5 and 6 bytes where longer."""
    words = Words(data, offsets, letter_words())
    doc, slots = [words.doc], [words.hash]
    length = words.end - words.start
    for k in (4, 5, 6):
        long = length > k
        start = words.start[long]
        doc.append(words.doc[long])
        slots.append(mix(words.part(start, start + k) + M[k]))
    return np.concatenate(doc), (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64)
