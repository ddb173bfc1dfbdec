"""Words of many texts as one stream of numbers, cut into slices of bounded size.

Hashing and comparing words one by one is dear in Python; as numbers they are handled by whole arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20  # bytes of text whose words are held at once; a longer text is a slice of its own


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text, one at a time; null is empty."""
    for text in column.cast(pa.binary()):
        yield text.as_py() or b""


def numbered(words: list[bytes], table: dict[bytes, int]) -> np.ndarray:
    """The words' numbers in ``table``, which grows by those it does not have."""
    for word in dict.fromkeys(words):
        if word not in table:
            table[word] = len(table)
    return np.fromiter(map(table.__getitem__, words), np.int64, len(words))
