"""Token counts of fields or sections by offset-mapped attribution.

A document is encoded once, as a whole. Its tokens cut its UTF-8 bytes into consecutive spans, which are joined as
intervals to the spans of its sections. A token that crosses a boundary is allocated by RULE: `start` gives it to
the section of its first byte, `end` to that of its last, `most` to the section with most of its bytes (the earlier
one of equals). Each token is counted once, so sections add up to the document.

The join is a search of the sections' ends for each token, within the batch at hand: no shuffle, memory of a block.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .._ship import ship
from . import _shingles as S
from ._common import free_name

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RULES = ("start", "end", "most")
#: The pre-tokenizer's pattern of the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Whole texts to token ids; the byte length of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
        self.encoding = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ends(self, text: str) -> np.ndarray:
        """The end of each token, in bytes."""
        return np.cumsum(self.lengths[np.asarray(self.encoding.encode_ordinary(text), np.int64)])


def attributed(token_ends: np.ndarray, section_ends: np.ndarray, rule: str = "start") -> np.ndarray:
    """Tokens of each section, for sections that follow one another and cover the text (empty ones get none)."""
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(section_ends, starts, "right")
    last = np.searchsorted(section_ends, token_ends - 1, "right")
    if rule == "start":
        to = first
    elif rule == "end":
        to = last
    else:
        to = first.copy()
        for i in np.flatnonzero(first != last):
            bounds = np.clip(np.concatenate([[starts[i]], section_ends[first[i] : last[i] + 1]]), starts[i], token_ends[i])
            to[i] = first[i] + int(np.argmax(np.diff(bounds)))
    return np.bincount(to, minlength=len(section_ends))[: len(section_ends)]


def section_ends(text: bytes) -> np.ndarray:
    """The byte ends of a text's sections: its lines, each with its line feed. An empty text has none."""
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return at if len(at) and at[-1] == len(text) or not text else np.append(at, len(text))


def count_sections(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """(doc_id, n_tokens, sections): sections is an array of the tokens of each line of the text, in order.

    docs has doc_id and text. A null or empty text has no tokens and no sections. Rows stay as many as they are.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            column = batch.column(1)
            for a, b in S.blocks(column):
                out = []
                for text in column.slice(a, b - a).to_pylist():
                    text = text or ""
                    out.append(attributed(encoder.ends(text), section_ends(text.encode()), rule) if text else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([int(x.sum()) for x in out], pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "n_tokens", "sections"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, sections array<long>")


def count_fields(rows: DataFrame, fields: list[str], separator: str = "\n", vocabulary: str = VOCABULARY, rule: str = "start") -> DataFrame:
    """rows with `<field>_tokens` for each field: the fields are joined by the separator and encoded once as a whole.

    A separator belongs to the field before it. A null field is empty: it has no tokens but perhaps its separator's.
    Every row and column stays; a new column whose name rows has already gets underscores.
    """
    ship(rows.sparkSession)
    gap = separator.encode()

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(vocabulary)
        for column in batches:
            out = []
            for values in column.to_pylist():
                parts = [(v or "").encode() for v in values]
                parts = [p + gap for p in parts[:-1]] + parts[-1:]
                whole = b"".join(parts)
                out.append(attributed(encoder.ends(whole.decode()), np.cumsum([len(p) for p in parts]), rule) if whole else np.zeros(len(parts), np.int64))
            yield pa.array(out, pa.list_(pa.int64()))

    counted = F.arrow_udf(run, "array<long>")(F.array(*[F.col(f).cast("string") for f in fields]))
    name = free_name(rows, "token_counts")
    told = rows.withColumn(name, counted)
    return told.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(name)[i].alias(free_name(rows, f"{f}_tokens")) for i, f in enumerate(fields)])
