"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are pre-split at safe boundaries: places that no match of the split pattern can
span, so that encoding the parts one by one gives the ids of the whole text.

Defined results: a null text counts as empty and gives no ids; repeated rows each give a row;
columns besides the id and the text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, functions as F

from pacegrid.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"

#: Characters that tiktoken's pattern engine gets at once.
PART_CHARS = 1 << 15

#: No match of the pattern goes on after a letter or digit run's end, or from a character
#: that isn't white space to one that is.
SAFE = regex.compile(r"(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})|(?<=\P{White_Space})(?=\p{White_Space})")
PATTERN = regex.compile(public_tokenizers.PATTERN)


@functools.lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, size: int = PART_CHARS) -> Iterator[tuple[str, bool]]:
    """(part, whole match): parts of about ``size`` characters cut at safe boundaries. A run
    without any boundary for ``2 * size`` characters comes as single matches of the pattern."""
    at = 0
    while len(text) - at > 2 * size:
        # The search stops at an end that may be no boundary, so one character more is shown.
        if (cut := SAFE.search(text, at + size, at + 2 * size + 1)) and cut.start() <= at + 2 * size:
            yield text[at : cut.start()], False
            at = cut.start()
        else:
            end = PATTERN.match(text, at).end()
            yield text[at:end], True
            at = end
    if at < len(text):
        yield text[at:], False


def encode_text(enc: tiktoken.Encoding, text: str, size: int = PART_CHARS) -> list[int]:
    if len(text) <= 2 * size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part, match in safe_parts(text, size):
        ids += enc._core_bpe.encode_single_piece(part.encode()) if match else enc.encode_ordinary(part)
    return ids


def decode_ids(enc: tiktoken.Encoding, ids: list[int]) -> bytes:
    """The raw bytes of the ids; any id sequence decodes, also one that cuts a character."""
    return enc.decode_bytes(ids)


FIELDS = {
    "n_tokens": "long",
    "token_ids": "array<int>",
    "ids_sha256": "string",
    "decoded": "binary",
    "decoded_sha256": "string",
}


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = ("n_tokens", "token_ids")) -> DataFrame:
    """Ids of every text by the ranks at ``path`` (a file that every node has), without special
    tokens. ``fields`` names what to return of: n_tokens, token_ids, ids_sha256 (of the decimal
    ids joined by commas), decoded (raw bytes of the ids decoded again), decoded_sha256."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def one(enc, text: str) -> dict:
        ids = encode_text(enc, text)
        out = {"n_tokens": len(ids), "token_ids": ids}
        if "ids_sha256" in fields:
            out["ids_sha256"] = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        if "decoded" in fields or "decoded_sha256" in fields:
            out["decoded"] = decode_ids(enc, ids)
            out["decoded_sha256"] = hashlib.sha256(out["decoded"]).hexdigest()
        return out

    types = {"n_tokens": pa.int64(), "token_ids": pa.list_(pa.int32()), "decoded": pa.binary()}

    def run(batches):
        enc = encoding(path)
        for batch in common.text_slices(batches, "text"):
            rows = [one(enc, t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[f] for r in rows], types.get(f, pa.string())) for f in fields)], ["id", *fields]
            )

    schema = ", ".join(["id " + id_type, *(f"{f} {FIELDS[f]}" for f in fields)])
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, decoded): the raw bytes of each id list; a null list gives no bytes."""
    id_type = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoding(path)
        for batch in batches:
            rows = [decode_ids(enc, ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["id", "decoded"])

    two = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return two.mapInArrow(run, f"id {id_type}, decoded binary").withColumnRenamed("id", id_col)


def op1_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    return encode(docs, public_tokenizers.path(RANKS), fields=("n_tokens", "ids_sha256", "decoded_sha256"))
