"""Words of many texts at once, as Arrow and numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(lengths: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together, or of one longer text, so that the arrays made
    of a batch stay small."""
    part = np.cumsum(lengths.astype(np.int64)) // most
    starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(starts[:-1], starts[1:]) if b > a]


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    for a, b in runs(lengths, most):
        yield batch.slice(a, b - a)


def coded_words(texts: pa.Array, lower: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as numbers of these, and where each text begins.

    Words are parted by ASCII white space; lower-casing changes A-Z only. Null texts have no words.
    """
    if len(texts) == 0:
        return [], np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
    # Copied first: slices of texts come out of the kernels below with wrong offsets.
    texts = pa.array(texts.to_pylist(), pa.string())
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64) - lists.offsets[0].as_py()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    if "" in words:  # white space at either end
        keep = codes != words.index("")
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return words, codes, offsets
