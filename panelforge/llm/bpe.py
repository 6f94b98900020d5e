"""Byte-level BPE encoding and decoding with a local rank file.

Method: the tiktoken library over ranks read from a file, a regex split of long texts at positions where a
match of the pre-token pattern must end, and decoding to raw bytes. A match ends wherever white space follows what is
none, wherever a letter is followed by ASCII that is none, and before the last character of a run of white space that
something follows. Long runs of white space, on which the library's own splitter overflows its stack, are thus
pre-tokens known beforehand and go to its merges directly.

Defined results: a null or empty text has no ids and decodes to no bytes; a null doc_id stays null; repeated
rows give repeated rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.common import slices

#: Texts longer than this many characters are encoded in parts; runs of white space longer than RUN are parts of their own.
PART, RUN = 50_000, 300
#: Unicode's white space, as the pattern's \s has it.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{BLANK}]{{{RUN},}}")
#: The character before a cut: what is no white space before white space, or a letter of a common script before other ASCII or CJK signs.
CUT = re.compile(rf"[^{BLANK}](?=[{BLANK}])|[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3](?=[!-@\[-`{{-~\u3001\u3002\uff01\uff0c\uff1f])")


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cuts(text: str, at: int, end: int, longest: int) -> Iterator[tuple[int, int]]:
    """text[at:end] in ranges whose ids, one after another, are its ids."""
    while end - at > longest:
        found = CUT.search(text, at + longest - 1, end)
        if found is None or found.end() >= end:
            break
        yield at, found.end()
        at = found.end()
    if at < end:
        yield at, end


def parts(text: str, longest: int = PART) -> Iterator[tuple[str, bool]]:
    """Parts of a text, and whether a part is one pre-token of white space."""
    at = 0
    for run in RUNS.finditer(text) if len(text) > RUN else ():
        for a, b in cuts(text, at, run.start(), longest):
            yield text[a:b], False
        # the last character of a run belongs to what follows it
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    for a, b in cuts(text, at, len(text), longest):
        yield text[a:b], False


def packed_ids(text: str | None, encoder) -> bytes:
    import numpy as np

    return b"".join(np.asarray(encoder._encode_single_piece(part) if blank else encoder.encode_ordinary(part), dtype="<u4").tobytes() for part, blank in parts(text or ""))


def unpacked_bytes(ids: bytes, encoder) -> bytes:
    import numpy as np

    return encoder.decode_bytes(np.frombuffer(ids, dtype="<u4").tolist())


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        encoder = encoding(ranks_path, pattern)
        for batch in slices(batches):
            packed = [packed_ids(x.as_py(), encoder) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Adds decoded (binary): the bytes of the ids, which need not be valid UTF-8 where a sequence of ids was cut."""

    def run(batches):
        encoder = encoding(ranks_path, pattern)
        for batch in slices(batches):
            raw = [unpacked_bytes(x.as_py(), encoder) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """decode(encode(docs)) in one pass: one Python process for a task, and ids cross to it once."""

    def run(batches):
        encoder = encoding(ranks_path, pattern)
        for batch in slices(batches):
            packed = [packed_ids(x.as_py(), encoder) for x in batch.column(1)]
            raw = [unpacked_bytes(x, encoder) for x in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary()), pa.array(raw, pa.binary())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
