"""Token counts of whole texts with a local tokenizer file.

Arrow functions take runs of texts of about equal bytes, cut them at safe boundaries and encode
their parts in batches of about equal bytes; only lengths come back. Where a tokenizer drops
white space, every run of it is a safe boundary, so that texts fall into words and a word is
encoded once for all its occurrences that a task remembers. Longer parts are cut in front of
digits and of marks that end a word. A tokenizer that doesn't work part by part (see ``parted``)
gets whole texts.

Defined results: a null text counts as empty, with 0 bytes and tokens; repeated rows each give a
row; columns besides the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common

TOKENIZER = "word_bpe_49k.json"

#: Tokens from which on a document is over the limit of a model's context.
LIMIT = 2048

#: Bytes of one call of the tokenizer; characters of a part that gets cut further; bytes of the
#: words whose lengths a task remembers, and of a word that it remembers at most.
BATCH_BYTES, PART_CHARS, KEPT_BYTES, WORD_BYTES = 1 << 18, 1 << 15, 1 << 24, 256

#: No token goes over the start of a digit, or from a letter or digit to a mark that ends a word.
SAFE = regex.compile(r"(?=[0-9])|(?<=[\p{L}\p{N}])(?=[,.;:!?()])")

Lengths = Callable[[list[str]], list[int]]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Lengths:
    """Token counts of a batch of texts: the tokenizers library for .json, sentencepiece for .model;
    without begin, end or other added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in pieces.encode(texts, num_threads=1)]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(e) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=2)
def parted(path: str) -> bool:
    """Whether the tokenizer drops ASCII white space and counts parts between safe boundaries on
    their own, as probes of each kind of boundary tell."""
    length = counter(path)
    wholes = [" ab", "ab ", *(f"ab{space}cd" for space in (" ", "  ", "\t", "\n", "\r", "\x0b", "\x0c")), "ab1", "12", *(f"ab{mark}" for mark in ",.;:!?()")]
    parts = [["ab"], ["ab"], *([["ab", "cd"]] * 7), ["ab", "1"], ["1", "2"], *(["ab", mark] for mark in ",.;:!?()")]
    return all(length([w])[0] == sum(length(p)) for w, p in zip(wholes, parts, strict=True))


def safe_parts(word: str, size: int = PART_CHARS) -> Iterator[str]:
    """``word`` in parts of about ``size`` characters; a run without boundary stays whole."""
    at = 0
    while len(word) - at > 2 * size and (cut := SAFE.search(word, at + size)):
        yield word[at : cut.start()]
        at = cut.start()
    yield word[at:]


def batches(parts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of parts of about ``limit`` bytes, one part at least."""
    held, room = [], limit
    for part in parts:
        size = len(part.encode())
        if held and size > room:
            yield held
            held, room = [], limit
        held.append(part)
        room -= size
    if held:
        yield held


class Counter:
    """Lengths of texts, as UTF-8 bytes, by the words they fall into."""

    def __init__(self, path: str, kept_bytes: int = KEPT_BYTES):
        self.lengths, self.parted, self.kept_bytes = counter(path), parted(path), kept_bytes
        self.known: dict[bytes, int] = {}
        self.held = 0

    def words(self, words: list[bytes]) -> dict[bytes, int]:
        """Lengths of distinct words, each cut at safe boundaries and summed over its parts."""
        owners, parts = [], []
        for place, word in enumerate(words):
            for part in safe_parts(word.decode()):
                owners.append(place), parts.append(part)
        out = [0] * len(words)
        at = 0
        for batch in batches(parts):
            for n in self.lengths(batch):
                out[owners[at]] += n
                at += 1
        return dict(zip(words, out, strict=True))

    def __call__(self, texts: list[bytes]) -> list[int]:
        if not self.parted:
            return [n for batch in batches(t.decode() for t in texts) for n in self.lengths(batch)]
        split = [t.split() for t in texts]
        new = set().union(*split) - self.known.keys()
        if self.held > self.kept_bytes:
            self.known, self.held, new = {}, 0, set().union(*split)
        found = self.words(list(new))
        self.known |= found
        out = [sum(map(self.known.__getitem__, words)) for words in split]
        for word in found:
            if len(word) > WORD_BYTES:
                del self.known[word]
            else:
                self.held += len(word) + 64
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every document by the tokenizer at ``path`` (a file that
    every node has)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(rows):
        count = Counter(path)
        for batch in common.text_slices(rows, "text"):
            data, offsets = common.text_buffer(batch.column(1))
            raw = data.tobytes()
            n = count([raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            sizes = pa.array(offsets[1:] - offsets[:-1], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counted = two.mapInArrow(run, f"id {id_type}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(common.read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
