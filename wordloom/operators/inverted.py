"""The inverted rows of chapters' words. A chapter's are sorted where it is, in Arrow batches, so nothing is exploded, grouped or shuffled."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wordloom.operators.grams import _array, _batches, _pieces

_KEYS = {"run": pa.string(), "book": pa.string(), "chapter_id": pa.int64()}
_POSTING = pa.schema([*_KEYS.items(), ("word", pa.string()), ("n", pa.int64()), ("positions", pa.list_(pa.int32()))])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in _pieces(batch, pc.list_value_length(batch.column("words"))):
            lists = piece.column("words")
            coded = _array(lists.flatten()).dictionary_encode()
            if not len(coded):
                continue
            chapter = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.arange(len(chapter)) - np.searchsorted(chapter, chapter) + 1
            word = chapter * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.diff(word[order], prepend=-1))
            ends = np.append(first, len(order))
            positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at[order], pa.int32()))
            own = order[first]
            keys = (_array(piece.column(k), kind).take(pa.array(chapter[own])) for k, kind in _KEYS.items())
            yield from _batches(_POSTING, *keys, coded.dictionary.take(coded.indices.take(pa.array(own))), pa.array(np.diff(ends)), positions)


def inverted(chapters: DataFrame) -> DataFrame:
    """run, book, chapter_id, word, n, positions (from 1, rising) of each word of chapters (run, book, chapter_id, words), whose keys are unique."""
    schema = "run string, book string, chapter_id bigint, word string, n bigint, positions array<int>"
    return chapters.select(*_KEYS, "words").mapInArrow(_inverted, schema)
