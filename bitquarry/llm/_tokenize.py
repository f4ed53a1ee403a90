"""Whole-text encoding with the tokenizers library, by repeated chunks.

Neither tokenizer joins what stands on both sides of a single space between
two other characters, so a text is the sequence of its space-delimited chunks
and each distinct chunk goes through the library once per worker (up to a
cache bounded in bytes). A chunk of letters alone is one piece of the
pre-tokenizer, so it goes to the library's merge model directly. Texts where
that does not hold, with other spacing or the strings of special tokens, go
through the library whole.

Cutting, finding a batch's distinct chunks and laying their ids out again are
Arrow kernels over whole batches.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE_BYTES = 24 << 20
#: in bytes
LONGEST_CACHED = 48
#: first in a text; first after a line feed; the end id
_FIRST, _LINE, _END = "\x01", "\x03", "\x02"
#: how byte-level models write the bytes that have no printable Latin-1 character
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: white space beside single spaces and line feeds between other characters, and the marks of chunks
_ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\x01-\x03\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _bytes(strings: pa.Array) -> list[bytes]:
    """The strings' bytes; slices of the buffer, as to_pylist is slow."""
    if not len(strings):
        return []
    _, offsets, data = strings.buffers()
    at = np.frombuffer(offsets, np.int32)[strings.offset : strings.offset + len(strings) + 1].tolist()
    raw = data.to_pybytes() if data else b""
    return [raw[a:b] for a, b in zip(at, at[1:])]


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 16-bit integers."""

    dtype = np.dtype("<u2")

    def __init__(self, path: str, keeps_space: bool, cache_bytes: int = CACHE_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("vocabularies of up to 65,536 ids only")
        self.keeps_space = keeps_space
        self.limit = cache_bytes
        self.forget()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.model = self.tokenizer.model
        self.two = [k.to_bytes(2, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.mark = dict(zip(b".,;", self._library([".", ",", ";"])))
        self.line = next(iter(self._library(["\n"]))) if keeps_space else b""

    def forget(self) -> None:
        self.cache: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}  # the cache before it was last full
        self.held = 0

    def _library(self, chunks: list[str]) -> Iterable[bytes]:
        """Ids of each chunk. Chunks go through the library many at a time, parted by a special token, which is cut out again."""
        if not self.special or any(s in c for c in chunks for s in self.special if "<" in c):
            for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
                yield np.array(e.ids, self.dtype).tobytes()
            return
        mark = self.special[0]
        sign = self.tokenizer.token_to_id(mark)
        groups = [chunks[k : k + 500] for k in range(0, len(chunks), 500)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            cuts = np.flatnonzero(ids == sign)
            raw, size = ids.tobytes(), self.dtype.itemsize
            starts = [0, *((cuts + 1) * size).tolist()]
            ends = [*(cuts * size).tolist(), len(raw)]
            if len(starts) != len(group):
                raise ValueError("the tokenizer doesn't keep its special token apart")
            for x, y in zip(starts, ends):
                yield raw[x:y]

    def _letters(self, word: str, space: bool) -> bytes | None:
        """Ids of a word of letters alone, with the space before it; None for other chunks."""
        if not self.keeps_space:
            if not word.isascii():
                if max(word) > "\u024f":  # below, characters are as normal as can be
                    return None
                word = word.lower()
            space = False
        if not word.isalpha():
            return None
        if word.isascii():
            raw = "\u0120" + word if space else word
        else:
            raw = (" " + word if space else word).encode().decode("latin-1").translate(_BYTES)
        return b"".join([self.two[t.id] for t in self.model.tokenize(raw)])

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each of these distinct chunks; new ones go into the cache, unless they are too long for it."""
        if self.held > self.limit:
            self.cache, self.old, self.held = {b"": b""}, self.cache, 0
        cache, old = self.cache, self.old
        out = list(map(cache.get, chunks))
        asked, held = [], 0
        for k in [k for k, x in enumerate(out) if x is None]:
            c = chunks[k]
            ids = old.get(c)
            if ids is None:
                first, line, tail, word = c[0], b"", b"", c
                space = self.keeps_space
                if first < 4:  # first in a text or line
                    space, word = False, c[1:]
                    if first == 3:
                        line = self.line
                if len(word) > 2 and word[-1] in b".,;" and 97 <= word[-2] <= 122:  # the mark after a letter is a piece of its own
                    word, tail = word[:-1], self.mark[word[-1]]
                    ids = cache.get(word) if first > 3 else None
                if ids is None:
                    text = word.decode()
                    ids = self._letters(text, space) if word else b""
                if ids is None:
                    asked.append((k, (" " + text if space else text), line, tail))
                    continue
                if line or tail:
                    ids = line + ids + tail
            out[k] = ids
            if len(c) <= LONGEST_CACHED:
                cache[c] = ids
                held += 220 + len(c) + len(ids)  # both objects and the entry
        for a in range(0, len(asked), 20_000):
            part = asked[a : a + 20_000]
            for (k, _, line, tail), ids in zip(part, self._library([x[1] for x in part])):
                out[k] = ids = line + ids + tail
                if len(chunks[k]) <= LONGEST_CACHED:
                    cache[chunks[k]] = ids
                    held += 220 + len(chunks[k]) + len(ids)
        self.held += held
        return out

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts go through the library whole."""
        odd = np.zeros(len(texts), bool)
        held = texts.buffers()[2].to_pybytes() if texts.buffers()[2] else b""
        for s in self.special:
            if s.encode() in held:
                odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        if self.keeps_space:
            odd |= pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        elif any(m.encode() in held for m in (_FIRST, _LINE, _END)):
            odd |= pc.match_substring_regex(texts, "[\x01-\x03]").to_numpy(zero_copy_only=False)
        return odd

    def encode_batch(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text's with the end id after them, and where each text begins (one more than texts). Null is empty."""
        end = np.array([end_id], self.dtype).tobytes()
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = self._whole(texts)
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        if self.keeps_space:
            cut = pc.binary_join_element_wise(_FIRST, pc.replace_substring(plain, "\n", f" {_LINE}"), f" {_END}", "")
        else:  # ASCII letters may be lower-cased here, as the tokenizer does it anyway
            cut = pc.binary_join_element_wise(pc.replace_substring(pc.ascii_lower(plain), "\n", " "), f" {_END}", "")
        lists = pc.split_pattern(cut, " ")
        chunks = lists.flatten().dictionary_encode()
        names = _bytes(chunks.dictionary)
        stop = names.index(_END.encode()) if len(texts) else -1
        names[stop:stop + 1] = [b""] if len(texts) else []
        ids = self._ids(names)
        ids[stop:stop + 1] = [end] if len(texts) else []
        laid = pa.array(ids, pa.binary()).take(chunks.indices)
        _, offsets, data = laid.buffers()
        ends = np.frombuffer(offsets, np.int32)[laid.offset : laid.offset + len(laid) + 1]
        starts = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].astype(np.int64) // 2
        flat = np.frombuffer(data or b"", self.dtype)
        if odd.any():
            own = {k: np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids + [end_id], self.dtype) for k in np.flatnonzero(odd).tolist()}
            rows = [own[k] if k in own else flat[starts[k] : starts[k + 1]] for k in range(len(texts))]
            flat, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return flat[starts[0] : starts[-1]], starts - starts[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without an end id. Null is empty."""
        flat, starts = self.encode_batch(pa.array(texts, pa.string()), 0)
        return [flat[a : b - 1].tobytes() for a, b in zip(starts.tolist(), starts[1:].tolist())]


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, keeps_space: bool) -> ChunkEncoder:
    """One per worker process; another tokenizer takes its place."""
    key = (path, keeps_space)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ChunkEncoder(path, keeps_space)
    return _ENCODERS[key]


def drop_encoder() -> None:
    """Gives this worker's encoder back: workers live on, and more of them than there are cores."""
    _ENCODERS.clear()
