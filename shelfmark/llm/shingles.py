"""Word shingles of many texts at once: each row's set of 64-bit shingle hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from shelfmark.llm.common import buffer_of, lowered, mix, slices, word_hashes, word_spans

_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles, A-Z in lower case.

    Fewer words give their whole sequence as one shingle; null, empty and blank texts give none.
    """
    for _, part in slices(column):
        yield from _sets(part, width)


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    data, offsets = buffer_of(column)
    data = lowered(data)
    starts, ends, bounds = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(words), np.uint64)
        for k in range(width):
            rolled[: len(words) - k] = mix(rolled[: len(words) - k] * _STEP + words[k:] + np.uint64(k))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:
                whole = np.zeros(1, np.uint64)
                for k in range(b - a):
                    whole = mix(whole * _STEP + words[a + k] + np.uint64(k))
                yield mix(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
