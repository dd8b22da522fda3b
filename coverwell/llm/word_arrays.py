"""Words of whole Arrow columns as numpy arrays: split in one call, hashed once for each distinct word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text in a slice.
SLICE = 4 << 20
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[pa.Array]:
    """``texts`` in order, in slices of about ``most`` bytes; a longer text is one by itself."""
    size = np.cumsum(pc.binary_length(texts).to_numpy())
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def word_hashes(texts: pa.Array) -> Iterator[np.ndarray]:
    """The 64-bit hashes of the words of each text, none of them null."""
    split = pc.ascii_split_whitespace(texts)  # at the six white space characters, which leaves empty ends
    pieces = split.flatten().dictionary_encode()
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in pieces.dictionary.to_pylist()], np.uint64)
    full = pc.not_equal(pieces.dictionary, "").to_numpy(zero_copy_only=False)
    at = pieces.indices.to_numpy()
    real = full[at] if len(at) else np.zeros(0, bool)
    upto = np.concatenate([[0], np.cumsum(real)])
    ends = upto[np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])]
    flat = hashed[at[real]] if len(at) else np.zeros(0, np.uint64)
    for i in range(len(texts)):
        yield flat[ends[i] : ends[i + 1]]


def word_spans(text: str) -> np.ndarray:
    """(start, end) of every word in code points, the end exclusive."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    white = np.concatenate([[True], WHITE[raw], [True]])
    place = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    edges = np.nonzero(white[1:] != white[:-1])[0]
    return place[edges].reshape(-1, 2)
