"""Minimal perfect hashing by hash and displace, with a fingerprint per key (after Belazzougui et al., 2009)."""

from __future__ import annotations

import numpy as np

#: Keys per bucket on average.
LOAD = 4
_TRIES = 64


def mix(keys: np.ndarray, seed) -> np.ndarray:
    """A 64-bit finaliser of keys and seed (multiply and xor-shift rounds)."""
    with np.errstate(over="ignore"):
        x = keys.view(np.uint64) + (np.asarray(seed).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 1 << 40) >> np.uint64(32)).astype(np.uint32)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 1 << 41) % np.uint64(buckets)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each key) for distinct int64 keys; the slots are 0 to n - 1, each once.

    A bucket of several keys has the seed that sends all of them to free slots, tried in order of bucket size;
    a bucket of one key names its slot outright, as the negative number -1 - slot.
    """
    n = len(keys)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    buckets = -(-n // LOAD)
    home = _bucket(keys, buckets)
    order = np.argsort(home, kind="stable")
    sizes = np.bincount(home, minlength=buckets)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    displace, slots, used = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable").tolist():
        if sizes[b] < 2:
            break
        members = order[begins[b] : begins[b + 1]]
        seed = 0
        while True:
            seeds = np.arange(seed, seed + _TRIES)
            places = (mix(keys[members][None, :], seeds[:, None]) % np.uint64(n)).astype(np.int64)
            sorted_places = np.sort(places, axis=1)
            fits = ~used[places].any(axis=1) & (sorted_places[:, 1:] != sorted_places[:, :-1]).all(axis=1)
            if fits.any():
                at = int(np.argmax(fits))
                displace[b], slots[members] = seed + at, places[at]
                used[places[at]] = True
                break
            seed += _TRIES
    free = np.flatnonzero(~used)
    single = np.flatnonzero(sizes == 1)
    displace[single] = -1 - free
    slots[order[begins[single]]] = free
    return displace, slots


def slots_of(keys: np.ndarray, displace: np.ndarray, n: int) -> np.ndarray:
    """The slot of each key, in constant time per key. A key that was not built in gets some slot: compare fingerprints."""
    if not n:
        return np.zeros(len(keys), np.int64)
    d = displace[_bucket(keys, len(displace))].astype(np.int64)
    seeded = (mix(keys, np.maximum(d, 0)) % np.uint64(n)).astype(np.int64)
    return np.where(d < 0, -1 - d, seeded)
