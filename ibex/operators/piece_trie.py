"""Greedy longest-match pieces of many words at once.

The piece table becomes one trie with two roots (first pieces, continuation
pieces).  A node's children are entries of one sorted array of keys ``node *
alphabet + character``, so a step of all words is one search in it, whatever
their number; nothing is done word by word in Python.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

CONTINUATION = "##"  # fixed value: prefix of continuation pieces
MAX_CHARS_PER_WORD = 100  # fixed value: longer words are unknown


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)


def _classes() -> np.ndarray:
    """For each code point: 1 if it is punctuation, 2 if a combining mark."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))
        if kind == "Mn":
            out[cp] = 2
        elif kind[0] == "P":
            out[cp] = 1
    # fixed values: the ASCII ranges that count as punctuation
    for a, z in ((33, 47), (58, 64), (91, 96), (123, 126)):
        out[a:z + 1] = 1
    return out


_CLASSES: list[np.ndarray] = []  # made once in each worker


def classes() -> np.ndarray:
    if not _CLASSES:
        _CLASSES.append(_classes())
    return _CLASSES[0]


class PieceTrie:
    """The trie of a table piece -> id."""

    def __init__(self, pieces: dict[str, int], unknown: int):
        self.unknown = unknown
        firsts = [(p, i) for p, i in pieces.items()]
        more = [(p[len(CONTINUATION):], i) for p, i in pieces.items() if p.startswith(CONTINUATION)]
        texts = [p for p, _ in firsts + more]
        chars = code_points("".join(texts))
        self.alphabet = np.unique(chars)
        size = np.array([len(p) for p in texts], dtype=np.int64)
        begin = np.cumsum(size) - size
        letter = np.searchsorted(self.alphabet, chars) + 1
        self.width = len(self.alphabet) + 1
        state = np.where(np.arange(len(texts)) < len(firsts), 0, 1)  # the two roots
        nodes, keys, to = 2, [], []
        alive, depth = np.flatnonzero(size > 0), 0
        while len(alive):  # a level of all pieces at once
            key, which = np.unique(state[alive] * self.width + letter[begin[alive] + depth], return_inverse=True)
            keys.append(key)
            to.append(nodes + np.arange(len(key)))
            state[alive] = to[-1][which]
            nodes += len(key)
            depth += 1
            alive = alive[size[alive] > depth]
        self.keys = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        order = np.argsort(self.keys)
        self.keys, self.to = self.keys[order], (np.concatenate(to) if to else np.empty(0, dtype=np.int64))[order]
        self.accepts = np.full(nodes, -1, dtype=np.int64)
        some = size > 0
        self.accepts[state[some]] = np.array([i for _, i in firsts + more], dtype=np.int64)[some]

    def _step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next node of each, -1 where there is none."""
        at = np.minimum(np.searchsorted(self.alphabet, char), len(self.alphabet) - 1)
        key = state * self.width + at + 1
        found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.alphabet[at] == char) & (self.keys[found] == key), self.to[found], -1)

    def match(self, chars: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, first)``: the pieces of every word ``chars[begin:end]``, one
        word after the other (``first`` has one entry more than there are
        words).  A word that pieces can't cover, or that is too long, is one
        unknown id."""
        n = len(begin)
        owner, place, ids = [], [], []
        bad = end - begin > MAX_CHARS_PER_WORD
        if len(self.keys):
            word = np.flatnonzero((end > begin) & ~bad)
            start, at = begin[word], begin[word].copy()
            state = np.zeros(len(word), dtype=np.int64)
            best_end, best = start.copy(), np.full(len(word), -1, dtype=np.int64)
            while len(word):
                inside = at < end[word]
                to = np.full(len(word), -1, dtype=np.int64)
                to[inside] = self._step(state[inside], chars[at[inside]])
                on = to >= 0
                at = at + on
                hit = on & (self.accepts[np.maximum(to, 0)] >= 0)
                best_end, best = np.where(hit, at, best_end), np.where(hit, self.accepts[np.maximum(to, 0)], best)
                state = np.where(on, to, state)
                # where the walk ends, the longest piece so far is taken
                ends = ~on
                bad[word[ends & (best < 0)]] = True
                take = np.flatnonzero(ends & (best >= 0))
                owner.append(word[take])
                place.append(start[take])
                ids.append(best[take])
                start = np.where(ends, best_end, start)
                at = np.where(ends, best_end, at)
                state = np.where(ends, 1, state)
                best = np.where(ends, -1, best)
                go = on | ((best_end < end[word]) & ~bad[word])
                word, start, at, state, best_end, best = (v[go] for v in (word, start, at, state, best_end, best))
        else:
            bad |= end > begin
        owner, place, ids = (np.concatenate(v) if v else np.empty(0, dtype=np.int64) for v in (owner, place, ids))
        good = ~bad[owner]
        lost = np.flatnonzero(bad)
        owner, place = np.concatenate([owner[good], lost]), np.concatenate([place[good], begin[lost]])
        ids = np.concatenate([ids[good], np.full(len(lost), self.unknown, dtype=np.int64)])
        order = np.lexsort((place, owner))
        return ids[order], np.append(0, np.cumsum(np.bincount(owner, minlength=n)))

    def encode(self, words: list[str], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, first)`` of the basic tokens of every word (without white
        space): lower case, accents stripped, punctuation cut off."""
        text = "\n".join(words)
        if lower:
            text = text.lower()
            if not text.isascii():
                text = unicodedata.normalize("NFD", text)
        chars = code_points(text)
        kind = classes()[chars]
        if lower:
            chars, kind = chars[kind != 2], kind[kind != 2]
        line = chars == 10
        alone = kind == 1
        solid = ~line & ~alone
        begins = alone | (solid & np.append(True, ~solid[:-1]))
        ends = alone | (solid & np.append(~solid[1:], True))
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        ids, first = self.match(chars, begin, end)
        # the words' first basic tokens, by the lines before them
        of = np.append(0, np.cumsum(line))[begin]
        per = np.bincount(of, weights=np.diff(first), minlength=len(words)).astype(np.int64) if len(words) else np.empty(0, dtype=np.int64)
        return ids, np.append(0, np.cumsum(per))


def encode_lists(trie: PieceTrie, words: pa.Array, lower: bool = True) -> pa.Array:
    """A list column of words as a list column of ids; each distinct word of
    the batch is matched once."""
    import pyarrow.compute as pc

    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    flat = pc.list_flatten(words)
    coded = flat.dictionary_encode()
    ids, first = trie.encode(coded.dictionary.to_pylist(), lower)
    where = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(first)[where] if len(where) else np.empty(0, dtype=np.int64)
    upto = np.append(0, np.cumsum(size))
    values = ids[np.repeat(first[where] - upto[:-1], size) + np.arange(upto[-1])].astype(np.int32) if len(where) else np.empty(0, np.int32)
    counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    rows = upto[np.append(0, np.cumsum(counts))].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(rows), pa.array(values, pa.int32()), mask=words.is_null())
