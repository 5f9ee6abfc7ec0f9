"""Tokenizing whole texts with the tokenizers library, with the ids of words kept between texts.

Encoding is exact, not approximate: texts are only cut where pre-tokenizers of the two supported kinds always end a match,
so the ids of the parts, one after the other, are the ids of the whole. Those places are before the first and before
the last character of a run of white space, and between a letter and a following character that is neither a letter nor
white space. A text that holds the string of a special token is encoded as one part, by the library alone.

Cutting, looking parts up and putting ids together is done over arrays of bytes, for millions of characters at once.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts whose ids a worker keeps; beyond that the half that was used last stays. Others are encoded again, with the same result.
CACHE_PARTS = 250_000
#: Longer parts, in bytes, are encoded each time.
CACHE_BYTES = 64
#: Bytes of text that are cut and looked up at once; a longer text is taken by itself.
STEP_BYTES = 3_000_000
#: Unknown parts that are encoded in one call.
CALL_PARTS = 20_000
#: One part of letters that never combine with what follows (U+0130 lower-cases to a letter and a combining mark).
_LETTERS = r"^[\t-\r ]?[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
#: White space, then no other: such parts can stand one after the other in one text.
_JOINABLE = r"^[\t-\r ][^\s\x1c-\x1f\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$"

_byte = np.arange(256)
_SPACE = ((_byte >= 9) & (_byte <= 13)) | (_byte == 32)
_VAGUE = _SPACE | ((_byte >= 0x1C) & (_byte <= 0x1F))
_ALPHA = ((_byte | 32) >= 97) & ((_byte | 32) <= 122) & (_byte < 128)
_PLAIN = (_byte < 128) & ~_VAGUE & ~_ALPHA & (_byte > 31) & (_byte < 127)


def _wide_space(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes, last bytes) of white space characters beyond ASCII, as places."""
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[np.isin(data[two + 1], [0x85, 0xA0])]
    lead = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else two[:0]
    code = (data[lead].astype(np.int64) << 12 & 0xF000) | (data[lead + 1].astype(np.int64) & 0x3F) << 6 | (data[lead + 2].astype(np.int64) & 0x3F)
    wide = (code >= 0x2000) & (code <= 0x200F)
    wide |= np.isin(code, [0x1680, 0x180E, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
    three = lead[wide]
    return np.concatenate([two, three]), np.concatenate([two + 1, three + 2])


def cut_places(data: np.ndarray, text_ends: np.ndarray) -> np.ndarray:
    """Whether a part may begin at each byte of UTF-8 texts, one after the other; text_ends: where each ends."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n < 2:
        return cut
    vague = _VAGUE[data]
    begins, ends = vague.copy(), vague
    first, last = _wide_space(data)
    if len(first):
        ends = vague.copy()
        begins[first], ends[last] = True, True
    space = _SPACE[data]
    cut[1:] = space[1:] & ~ends[:-1]  # the first of a run
    begins[text_ends[text_ends < n]] = True
    cut[:-1] |= space[:-1] & ~begins[1:]  # the last of a run, unless the text ends with it
    letter = _ALPHA[data]
    high = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    pair = data[high].astype(np.int64) << 8 | data[high + 1]
    letter[high[~np.isin(pair, [0xC397, 0xC3B7, 0xC4B0])] + 1] = True
    cut[1:] |= _PLAIN[data[1:]] & letter[:-1]
    return cut


class Encoder:
    """``spaced``: white space is part of tokens (byte-level); else it only separates words and each word's last token is marked."""

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced = spaced
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        #: Bytes of text that each id stands for (a byte-level vocabulary writes a byte as one character), or whether a word ends with it.
        self.widths = np.zeros(size, np.int64)
        for token, number in self.tokenizer.get_vocab().items():
            self.widths[number] = len(token) if spaced else token.endswith("</w>")
        self.parts = pa.array([], pa.binary())
        self.ids = np.zeros(0, self.dtype)
        self.begin, self.count, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.step = 0

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian, `dtype` each. Null counts as empty."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        data, ends = ids.tobytes(), np.cumsum(counts) * self.dtype.itemsize
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after the other, how many each text has)."""
        sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
        steps, at = [], 0
        ends = np.cumsum(sizes)
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP_BYTES, "right")))
            steps.append(self._encode_step(texts.slice(at, end - at), sizes[at:end]))
            at = end
        if not steps:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        return np.concatenate([s[0] for s in steps]), np.concatenate([s[1] for s in steps])

    def _encode_step(self, texts: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_binary())])  # a copy that begins at offset 0
        if not sizes.any():
            return np.zeros(0, self.dtype), np.zeros(len(sizes), np.int64)
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        if not self.spaced:
            data = self._fold(data)
        cut = cut_places(data, bounds[1:])
        for special in self.special:
            for n in np.flatnonzero(np.asarray(pc.match_substring(texts, special))).tolist():
                cut[bounds[n] : bounds[n + 1]] = False
        cut[bounds[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut)
        index = self._numbers(data, starts)
        count = self.count[index]
        total = np.concatenate([[0], np.cumsum(count)])
        out = self.ids[np.repeat(self.begin[index] - total[:-1], count) + np.arange(total[-1])]
        return out, np.diff(total[np.searchsorted(starts, bounds)])

    @staticmethod
    def _fold(data: np.ndarray) -> np.ndarray:
        """A-Z lowered and line feeds as spaces, as the normalizer would do, but before characters that might combine with a letter."""
        followed = np.append(data[1:] >= 0x80, False)
        upper = (data >= 65) & (data <= 90) & ~followed
        data = data + (upper.astype(np.uint8) << 5)
        data[data == 10] = 32
        return data

    def _numbers(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each part's place among the known ones; unknown ones are encoded and become known."""
        self._forget()
        self.step += 1
        offsets = np.append(starts, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        distinct = coded.dictionary
        place = pc.index_in(distinct, self.parts)
        unknown = pc.is_null(place)
        new = distinct.filter(unknown)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        mask = unknown.to_numpy(zero_copy_only=False)
        known = len(self.count)
        place[mask] = known + np.arange(len(new))
        if len(new):
            ids, counts = self._encode_parts(new)
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(counts) - counts])
            self.ids, self.count = np.concatenate([self.ids, ids]), np.concatenate([self.count, counts])
            self.parts = pa.concat_arrays([self.parts, new])
            self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[place] = self.step
        return place[coded.indices.to_numpy(zero_copy_only=False)]

    def _forget(self) -> None:
        """Long parts go, and beyond `CACHE_PARTS` those not used for longest."""
        keep = np.asarray(pc.binary_length(self.parts)) <= CACHE_BYTES
        if len(keep) > CACHE_PARTS:
            keep &= self.used > np.partition(self.used, len(keep) - CACHE_PARTS // 2)[len(keep) - CACHE_PARTS // 2] - 1
            if keep.sum() > CACHE_PARTS:  # all from one step
                keep[np.flatnonzero(keep)[CACHE_PARTS // 2 :]] = False
        if keep.all():
            return
        count = self.count[keep]
        ends = np.cumsum(count)
        self.ids = self.ids[np.repeat(self.begin[keep] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        self.begin, self.count, self.used, self.parts = ends - count, count, self.used[keep], self.parts.filter(pa.array(keep))

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each part has): many parts as one text where their ids can be told apart, the others one by one."""
        texts = parts.cast(pa.string())
        short = np.asarray(pc.binary_length(parts)) <= CACHE_BYTES
        joined = short & np.asarray(pc.match_substring_regex(texts, _JOINABLE if self.spaced else _LETTERS))
        chunks: list[np.ndarray | None] = [None] * len(parts)
        found, counts = [], np.zeros(len(parts), np.int64)
        places = np.flatnonzero(joined)
        for at in range(0, len(places), CALL_PARTS):
            some = places[at : at + CALL_PARTS]
            ids, n = self._encode_joined(texts.take(pa.array(some)))
            counts[some] = n
            found.append((some, ids))
        others = np.flatnonzero(~joined)
        for at in range(0, len(others), CALL_PARTS):
            some = others[at : at + CALL_PARTS].tolist()
            for n, e in zip(some, self.tokenizer.encode_batch_fast(texts.take(pa.array(some)).to_pylist(), add_special_tokens=False), strict=True):
                chunks[n] = np.array(e.ids, self.dtype)
                counts[n] = len(chunks[n])
        begin = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), self.dtype)
        for some, ids in found:
            n = counts[some]
            out[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        for n in others.tolist():
            out[begin[n] : begin[n] + counts[n]] = chunks[n]
        return out, counts

    def _encode_joined(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            text = "".join(texts.to_pylist())
        else:
            text = " ".join(pc.utf8_trim_whitespace(texts).to_pylist())
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        if self.spaced:
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(np.asarray(pc.binary_length(texts), np.int64)), "left") + 1
        else:
            ends = np.flatnonzero(self.widths[ids]) + 1
        return ids, np.diff(ends, prepend=0)


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> Encoder:
    """One per worker process and tokenizer file."""
    return Encoder(path, spaced)
