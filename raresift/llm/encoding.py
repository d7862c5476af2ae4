"""Tokenizers of the ``tokenizers`` library inside tasks, with every distinct word encoded once per worker.

Natural text repeats its words. Where a tokenizer splits at white space before it merges, encoding word by word gives
the same ids as encoding the whole text. Words are cut and looked up in numpy, a slice of texts at a time: a word seen
before costs a place in a sorted array of 64-bit hashes, and its ids are gathered from one packed array. Caches are
bounded: a full one is started anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from raresift.llm.text import LOWER, Texts, hashes, slices, words

MOST_WORDS = 1_500_000
#: Ids that a cache holds at most.
MOST_IDS = 12_000_000
LONGEST_KEPT = 48
#: Bytes of unknown words that are encoded in one call; short calls keep to the processor's cache.
CALL_BYTES = 2_500
_LOADED: dict[str, object] = {}
_CACHES: dict[str, "WordIds"] = {}


def load(path: str):
    """The tokenizer as its file has it, loaded once per process."""
    if path not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[path] = Tokenizer.from_file(path)
    return _LOADED[path]


def added_strings(path: str) -> list[str]:
    """Strings that the tokenizer takes as units of their own before it looks at words."""
    return [token.content for token in load(path).get_added_tokens_decoder().values()]


def id_width(path: str) -> int:
    """Bytes per id: two where every id fits."""
    return 2 if load(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


class WordIds:
    """Ids of known words: hashes in ascending order, and where each word's ids lie in one packed array."""

    def __init__(self, kind: str):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.hashes, self.starts, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def find(self, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each hash, and whether it is known."""
        place = np.searchsorted(self.hashes, hashed)
        if not len(self.hashes):
            return place, np.zeros(len(hashed), bool)
        return place, self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashed

    def add(self, hashed: np.ndarray, ids: list[np.ndarray], sizes: np.ndarray) -> None:
        """New words, by ascending hash."""
        flat = np.concatenate(ids) if ids else np.zeros(0, self.kind)
        if self.used + len(flat) > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + len(flat)), self.kind)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + len(flat)] = flat
        starts = self.used + np.cumsum(sizes) - sizes
        self.used += len(flat)
        place = np.searchsorted(self.hashes, hashed)
        self.hashes = np.insert(self.hashes, place, hashed)
        self.starts = np.insert(self.starts, place, starts)
        self.sizes = np.insert(self.sizes, place, sizes)


def _encode_words(tokenizer, fresh: list[bytes], kind: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of some words, end to end, and how many each has. Words are encoded as one text with spaces and told apart by offsets."""
    found: list[np.ndarray] = []
    counts = np.zeros(len(fresh), np.int64)
    at = 0
    while at < len(fresh):
        size, end = 0, at
        while end < len(fresh) and size < CALL_BYTES:
            size += len(fresh[end])
            end += 1
        part = [word.decode() for word in fresh[at:end]]
        coded = tokenizer.encode(" ".join(part), add_special_tokens=False)
        ids = np.array(coded.ids, kind)
        starts = np.fromiter((start for start, _ in coded.offsets), np.int64, len(ids))
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
        counts[at:end] = np.diff(np.searchsorted(starts, np.append(np.cumsum(sizes) - sizes, sizes.sum())))
        found.append(ids)
        at = end
    return found, counts


def _texts(given: list[bytes]) -> Texts:
    """Some texts as one slice."""
    return next(slices(pa.array(given, pa.large_binary()), 1 << 62), Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64), 0))


def word_encoder(path: str) -> Callable[[], Callable[[list[bytes] | Texts], list[bytes]]]:
    """For a task: a function from UTF-8 texts to packed ids (unsigned, little-endian, ``id_width`` bytes each).

    For tokenizers that drop white space and case. Texts are cut at ASCII white space, which such a tokenizer never
    joins over, and A-Z are lowered first, so that fewer words differ. A text with an added token in any case is
    encoded whole, by the library.
    """

    def make() -> Callable[[list[bytes] | Texts], list[bytes]]:
        tokenizer = load(path)
        kind = f"<u{id_width(path)}"
        cache = _CACHES.setdefault(path, WordIds(kind))
        added = [string.lower().encode() for string in added_strings(path)]

        def encode(given: list[bytes] | Texts) -> list[bytes]:
            texts = given if isinstance(given, Texts) else _texts(given)
            count = len(texts)
            if not count:
                return []
            data = LOWER[texts.data]
            found = words(texts)
            hashed, first, which = np.unique(hashes(data, found.start, found.end), return_index=True, return_inverse=True)
            _, known = cache.find(hashed)
            if len(cache.hashes) + int((~known).sum()) > MOST_WORDS or cache.used > MOST_IDS:
                cache.clear()
                known[:] = False
            fresh = np.flatnonzero(~known)
            if len(fresh):
                new = [data[found.start[place] : found.end[place]].tobytes() for place in first[fresh]]
                cache.add(hashed[fresh], *_encode_words(tokenizer, new, kind))
            place, _ = cache.find(hashed)
            sizes = cache.sizes[place][which]
            ends = np.cumsum(sizes)
            before = np.append(0, ends)
            total = int(before[-1])
            ids = cache.ids[np.repeat(cache.starts[place][which] - before[:-1], sizes) + np.arange(total)] if total else cache.ids[:0]
            edges = before[np.searchsorted(found.doc, np.arange(count + 1))].tolist()
            packed, width = ids.tobytes(), cache.ids.itemsize
            coded = [packed[a * width : b * width] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            content = data.tobytes()
            if any(string in content for string in added):
                for doc in range(count):
                    a, b = texts.offsets[doc], texts.offsets[doc + 1]
                    if any(string in content[a:b] for string in added):
                        whole = tokenizer.encode(texts.data[a:b].tobytes().decode(), add_special_tokens=False)
                        coded[doc] = np.array(whole.ids, kind).tobytes()
            return coded

        return encode

    return make
