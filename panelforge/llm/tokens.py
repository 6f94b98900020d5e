"""Token counts of whole texts, without keeping ids.

Method: a text falls into pre-tokens at places that no piece of the vocabulary spans; pieces are counted once
per distinct pre-token, joined to the frequencies of pre-tokens per document, and summed. The table of distinct
pre-tokens belongs to one task (a memo that is emptied when it holds MEMO entries), so that nothing is shuffled:
exchanging every (document, pre-token) pair would move more bytes than the texts have.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows give
repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Distinct pre-tokens that a task keeps; only a matter of speed.
MEMO = 300_000
#: Pre-tokens of one call of the library.
CALL = 4_000
MARK = "▁"


class Vocabulary(NamedTuple):
    model: object
    pattern: re.Pattern
    breaks: bool  # no piece holds a line break
    begins: np.ndarray  # by id: the piece begins with the mark of a blank
    newline: np.ndarray  # by id: the piece is a line break


@functools.lru_cache(maxsize=2)
def vocabulary_of(model_path: str) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in piece.lstrip(MARK) for piece in pieces):
        raise ValueError("a piece of this vocabulary spans a word boundary: its pre-tokens can't be counted apart")
    newline = np.zeros(len(pieces), bool)
    newline[model.encode("\n")[1:]] = True
    breaks = newline.sum() == 1 and not any("\n" in piece for piece in pieces)
    pattern = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n" if breaks else f"{MARK}*[^{MARK}]+|{MARK}+")
    return Vocabulary(model, pattern, breaks, np.array([piece.startswith(MARK) for piece in pieces]), newline)


def flat_counts(model, pretokens: list[str], before: str, first: np.ndarray) -> np.ndarray:
    """Pieces of pretokens by few calls: joined texts, in which the ids in first, and no others, begin a pre-token."""
    counts = []
    for at in range(0, len(pretokens), CALL):
        some = pretokens[at : at + CALL]
        ids = np.asarray(model.encode(before + before.join(some), num_threads=1))
        starts = np.flatnonzero(first[ids])[-len(some) :]  # without the mark that the library puts before a text
        counts.append(np.diff(starts, append=len(ids)))
    return np.concatenate(counts) if counts else np.empty(0, int)


def piece_counts(vocabulary: Vocabulary, pretokens: list[str]) -> dict[str, int]:
    """Pieces of each pre-token alone."""
    model = vocabulary.model
    marked = [x for x in pretokens if x[0] == MARK and len(x) > 1 and x[1] != MARK]
    found = dict(zip(marked, flat_counts(model, [x[1:] for x in marked], " ", vocabulary.begins).tolist(), strict=True))
    if vocabulary.breaks:
        bare = [x for x in pretokens if x[0] != MARK and x != "\n"]
        found.update(zip(bare, (flat_counts(model, bare, "\n", vocabulary.newline) - 1).tolist(), strict=True))
    for x in pretokens:
        if x not in found:  # line breaks, runs of blanks and what follows them
            found[x] = len(model.encode(x[1:])) if x[0] == MARK and len(x) > 1 else 1
    return found


def slices(batch: pa.RecordBatch, most: int = 2_000_000):
    """Consecutive rows of a batch with about most bytes of text."""
    sizes = np.cumsum([0 if x is None else x for x in pc.binary_length(batch.column(1)).to_pylist()])
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right"))
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens."""

    def run(batches):
        vocabulary = vocabulary_of(model_path)
        memo: dict[str, int] = {}
        for batch in batches:
            for docs_of_call in slices(batch):
                texts = docs_of_call.column(1).to_pylist()
                frequencies = [Counter(vocabulary.pattern.findall(MARK + text.replace(" ", MARK))) if text else Counter() for text in texts]
                if len(memo) > MEMO:
                    memo.clear()
                new = {x for frequency in frequencies for x in frequency if x not in memo}
                if new:
                    memo.update(piece_counts(vocabulary, list(new)))
                n_tokens = [sum(n * memo[x] for x, n in frequency.items()) for frequency in frequencies]
                n_bytes = [len(text.encode()) if text else 0 for text in texts]
                yield pa.RecordBatch.from_arrays([docs_of_call.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
