"""Subword ids of texts by a public tokenizer, with a memory of the words met.

White space always separates tokens of this vocabulary, so a text's ids are its words' ids in a row; words repeat, so
each Python worker keeps the ids of the words that it has met (at most ``CACHE``; then it starts anew). Words new to a
batch that are one run of letters (with signs after it) are merged together in numpy, by the tokenizer's own table of merges; all others
(signs, digits, other scripts, very long runs) go through the tokenizer one by one.
"""

from __future__ import annotations

import json
import os
import struct
from functools import lru_cache
from itertools import chain

import numpy as np

CACHE = 500_000
LONGEST_RUN = 48
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies write a byte as itself where it is visible in Latin-1, the others from U+0100 on.
BYTES = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _OWN)}
END_OF_WORD = "</w>"
SIGNS = ".,!?;:#*$%&|<>=()\"-+"
LETTER, SIGN, OTHER = range(3)
_KIND, _LOWER = np.full(256, OTHER, np.int8), np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[list(SIGNS.encode())] = SIGN


class Merges:
    """The merge table of a byte-level vocabulary with word ends, for many runs of letters at a time."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, pairs = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.inner, self.last = (np.array([vocab[chr(BYTES.get(b, b)) + end] for b in range(256)], np.int64) for end in ("", END_OF_WORD))
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.into, self.never = np.array([vocab[a + b] for a, b in pairs], np.int64), len(pairs)
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.never, np.int64)  # a pair stands at its slot or at the next free one
        slot, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            own = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[own]], self.rank[slot[own]] = keys[own], own
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
        self.first = np.stack([self._ranks(self.inner[:, None], second[None]) for second in (self.inner, self.last)]).astype(np.int32).ravel()  # of every two bytes

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Place of each pair in the table of merges, or ``never``."""
        key = a << 32 | b
        shape, key = key.shape, key.ravel()
        slot = self._slots(key)
        met, rank = self.keys.take(slot), self.rank.take(slot)
        left = np.flatnonzero((met != key) & (met >= 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            met = self.keys.take(slot[left])
            rank[left] = self.rank.take(slot[left])
            left = left[(met != key[left]) & (met >= 0)]
        return rank.reshape(shape)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.intp)

    def __call__(self, runs: list[bytes]) -> list[bytes]:
        """Ids (little-endian, 32 bits) of each run."""
        if not runs:
            return []
        found, counts = self.merged(np.frombuffer(b"".join(runs), np.uint8), np.fromiter(map(len, runs), np.int64, len(runs)))
        ids, stops = found.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        return [ids[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)]

    def merged(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of runs in a row and the runs' sizes -> ids in a row, and how many each run has: the pair that comes first in
        the table is merged until none is left."""
        symbol, owner = self.inner[raw], np.repeat(np.arange(len(size)), size)
        stop = np.cumsum(size) - 1
        symbol[stop] = self.last[raw[stop]]
        pair = (raw[:-1].astype(np.int32) << 8) + raw[1:]
        pair[stop[size > 1] - 1] += 1 << 16  # its second byte ends the run
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.append(self.first[pair], np.int32(self.never))[: len(raw)]
        rank[stop] = self.never
        while len(symbol):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            length = np.diff(np.append(first, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, first), length)
            going = best < self.never
            if not going.all():
                done.append((owner[~going], symbol[~going]))
                owner, symbol, rank, best = owner[going], symbol[going], rank[going], best[going]
                continue
            at = np.flatnonzero(rank == best)
            at = at[np.concatenate(([True], owner[at][1:] != owner[at][:-1]))]  # the leftmost of each run
            symbol[at] = self.into[rank[at]]
            stays = np.ones(len(symbol), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))
            owner, symbol, rank = owner[stays], symbol[stays], rank[stays]
            for i in (at, at[at > 0] - 1):
                same = (i + 1 < len(owner)) & (owner[i] == owner[np.minimum(i + 1, len(owner) - 1)])
                rank[i] = self.never
                rank[i[same]] = self._ranks(symbol[i[same]], symbol[i[same] + 1])
        owner, symbol = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        return symbol[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(size))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.merges = Tokenizer.from_file(path), Merges(path)
        self.encode = self.tokenizer.encode
        self.single: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        self[word] = ids = self.ids_of([word])[0]
        return ids

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of words, without remembering the words."""
        if len(self.single) + len(words) > CACHE:
            self.single.clear()
        bodies, single, out = [w.rstrip(SIGNS) for w in words], self.single, []
        plain = [b.isalpha() and (b.isascii() or max(b) <= "\xff") and len(b) <= LONGEST_RUN for b in bodies]  # one run of letters, all composed
        new = list({b.lower() for b, p in zip(bodies, plain, strict=True) if p}.difference(single))
        single.update(zip(new, self.merges([r.encode() for r in new]), strict=True))
        for word, body, run in zip(words, bodies, plain, strict=True):
            if not run:
                out.append(pack_ids(self.encode(word, add_special_tokens=False).ids))
            elif len(body) == len(word):
                out.append(single[body.lower()])
            else:
                sign = word[len(body) :]
                if sign not in single:
                    single[sign] = pack_ids(self.encode(sign, add_special_tokens=False).ids)
                out.append(single[body.lower()] + single[sign])
        return out

    def flat_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and how many each word has, without remembering anything: all words' bytes are judged at a time."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        kind, low = _KIND[raw], _LOWER[raw]
        after = np.flatnonzero(raw == 0xC3) + 1  # letters of two bytes; these are 0xD7 and 0xF7, signs, but for 0x97 and 0xB7
        after = after[(raw[after] != 0x97) & (raw[after] != 0xB7)]
        kind[after] = kind[after - 1] = LETTER
        low[after] += 32 * (raw[after] < 0x9F).astype(np.uint8)
        owner = np.repeat(np.arange(len(words)), size)
        new_word = np.concatenate(([True], owner[1:] != owner[:-1]))
        odd = kind == OTHER
        odd[1:] |= ~new_word[1:] & (kind[1:] < kind[:-1])  # a letter after a sign
        plain = np.bincount(owner[odd], minlength=len(words)) == 0
        plain &= (size > 0) & (size <= LONGEST_RUN)
        inside = plain[owner]
        runs = np.flatnonzero((new_word | np.concatenate(([True], kind[1:] != kind[:-1])))[inside])
        ids, counts = self.merges.merged(low[inside], np.diff(np.append(runs, np.count_nonzero(inside))))
        sizes = np.bincount(owner[inside][runs], counts, len(words)).astype(np.int64)
        others = np.flatnonzero(~plain)
        if not len(others):
            return ids, sizes
        found = [self.encode(words[i].decode(), add_special_tokens=False).ids for i in others.tolist()]
        sizes[others] = list(map(len, found))
        out, own = np.empty(int(sizes.sum()), np.int64), np.repeat(plain, sizes)
        out[own], out[~own] = ids, np.fromiter(chain.from_iterable(found), np.int64)
        return out, sizes

    def vocabulary(self) -> dict[str, int]:
        return self.tokenizer.get_vocab(with_added_tokens=True)

    def ends(self) -> np.ndarray:
        """By id, whether a run of the text ends with it."""
        vocab = self.vocabulary()
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for piece, i in vocab.items() if piece.endswith(END_OF_WORD)]] = True
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts."""
        if len(self) > CACHE:
            self.clear()
        split = [None if _separators(t) else t.split() for t in texts]
        words = [w for w in set().union(*filter(None, split)) if w not in self]
        if words:
            self.update(zip(words, self.ids_of(words), strict=True))
        return [pack_ids(self.encode(t, add_special_tokens=False).ids) if s is None else b"".join(map(self.__getitem__, s)) for t, s in zip(texts, split, strict=True)]

    def text(self, text: str) -> bytes:
        """The ids of a whole text."""
        return self.texts([text])[0]


def _separators(text: str) -> bool:
    """str.split cuts at these, the tokenizer doesn't."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each worker process, so later tasks find what earlier ones met."""
    return WordIds(path)


def id_kind(path: str) -> str:
    """Numpy type of stored ids: 2 bytes where the vocabulary allows it, else 4."""
    return "<u2" if max(word_ids(path).vocabulary().values(), default=0) < 1 << 16 else "<u4"
