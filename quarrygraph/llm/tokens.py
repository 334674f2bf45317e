"""Token counts by batch encoding (operator 4).

Texts are encoded in Arrow functions that return lengths only. A batch is cut into slices of
about a megabyte, so work is balanced by bytes and not by rows, and each text is split at safe
boundaries: a single space with a character other than white space on both sides. The byte-level
pattern never joins the two sides there, so lengths add up exactly; it also means that a
text of any length is encoded in small pieces, and that a piece seen before is not encoded
again. A text with white space in any other place is encoded whole between its safe boundaries.

Defined results: null text counts as empty (0 bytes, 0 tokens). Special strings inside texts
are handled as the library does by default. Rows are kept one by one; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, kept, text_bytes

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Pieces remembered by a worker: those of its first texts stay, later ones come and go.
KEEP, MOST = 200_000, 400_000
_UNSAFE = -1 << 40


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has one worker a core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Lengths:
    """Numbers of tokens of texts under a byte-level tokenizer file."""

    def __init__(self, path: str):
        self.encoder = tokenizer(path)
        self.known: dict[str, int] = {}
        self.hot: dict[str, int] | None = None

    def encode(self, pieces: list[str]) -> list[int]:
        return [len(e) for e in self.encoder.encode_batch_fast(pieces, add_special_tokens=False)]

    def whole(self, text: str, size: int = 1 << 16) -> int:
        """Tokens of a text, encoded between safe boundaries about size characters apart."""
        at, pieces = 0, []
        while len(text) - at > size:
            cut = _SAFE.search(text, at + size)
            if not cut:
                break
            pieces.append(text[at : cut.start()])
            at = cut.start()
        return sum(self.encode([*pieces, text[at:]]))

    def __call__(self, texts: list[str]) -> list[int]:
        known = self.known
        if len(known) > MOST:
            self.known = known = dict(self.hot)
        parts = [t.split(" ") for t in texts]
        heads = [p.pop(0) for p in parts]
        new = [w for w in set().union(*parts) if w not in known]
        safe = [w for w in new if w and not w[0].isspace() and not w[-1].isspace()]
        known.update(dict.fromkeys(new, _UNSAFE))
        known.update(zip(safe, self.encode([" " + w for w in safe])))
        if self.hot is None and len(known) > KEEP:
            self.hot = dict(known)
        get, out = known.__getitem__, self.encode(heads)
        for i, (head, part) in enumerate(zip(heads, parts)):
            out[i] += sum(map(get, part))
            if part and (out[i] < 0 or head[-1:].isspace()):
                out[i] = self.whole(texts[i])
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every document, without a shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, keep=tokenizer_path):
            lengths = kept(tokenizer_path, lambda: Lengths(tokenizer_path))
            n_bytes = np.diff(text_bytes(b.column("text"))[1])
            n = np.array(lengths([t or "" for t in b.column("text").to_pylist()]), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
