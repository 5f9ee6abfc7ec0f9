"""64-bit SimHash fingerprints of word shingles, computed over Arrow batches.

The text is taken as UTF-8 bytes throughout: ``bytes.lower`` folds A-Z only and ``bytes.split``
cuts at exactly U+0020 and U+0009..U+000D, so no Unicode rule of Python's ``str`` gets in.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42
_BLOCK = 1 << 16  # shingles whose bits are counted at once


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every ``size``-word shingle, repeats included; one of the whole if there are fewer words."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashes as a signed 64-bit number. Bit k is set if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def simhash(text: bytes, size: int) -> int:
    """The fingerprint of a text's shingles."""
    return majority(shingle_hashes(text, size))


def fingerprint_batches(size: int):
    """For ``mapInArrow``: replaces the column ``text`` of a batch by ``fp``."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = [simhash(t.as_py() or b"", size) for t in texts]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(fps, pa.int64())], [*rest, "fp"])

    return run
