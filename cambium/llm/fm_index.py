"""A full-text index in minute space over a list of distinct words, and the search for words one error away in it.

The words stand behind one another, each between delimiters. `Index` keeps the Burrows-Wheeler transform of that text; an interval
of suffix ranks stands for all places of a string, and one step extends the string by a symbol on its left. The same over the words
read backwards extends to the right, so that the two indexes together extend either way.
"""

from __future__ import annotations

import numpy as np

#: Symbols of the text besides those of the words: what ends it, and what stands around each word.
END, AROUND = 0, 1
#: Intervals up to this size are read symbol by symbol; of larger ones every symbol of the alphabet is looked up.
SMALL = 24
#: Patterns that are searched together.
TOGETHER = 8192


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words behind one another, and the length of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), lengths


def delimited(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of words with a delimiter before each, and where those delimiters stand."""
    begin = np.cumsum(lengths + 1) - lengths - 1
    text = np.full(len(symbols) + len(lengths), AROUND, np.int64)
    inside = np.ones(len(text), bool)
    inside[begin] = False
    text[inside] = symbols
    return text, begin


def suffix_ranks(text: np.ndarray, symbols: int) -> np.ndarray:
    """The starts of all suffixes in their order: several symbols at once to begin with, then prefix doubling."""
    n, bits = len(text), max(1, int(symbols - 1).bit_length())
    width = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key <<= bits
        key[: max(0, n - i)] |= text[i:]
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = True
        np.not_equal(key[order[1:]], key[order[:-1]], out=fresh[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n:
            return order
        key = rank * (n + 1)
        key[: max(0, n - width)] += rank[width:]
        width *= 2


class Index:
    """Intervals of suffix ranks over the delimited text of distinct words (read backwards where ``backwards``)."""

    def __init__(self, words: list[str], backwards: bool = False):
        points, lengths = code_points([w[::-1] for w in words] if backwards else words)
        self.backwards = backwards
        self.alphabet, symbols = np.unique(points, return_inverse=True)
        text, self.begin = delimited(symbols + 2, lengths)
        text = np.concatenate([text, [AROUND, END]])
        self.symbols = len(self.alphabet) + 2
        self.suffixes = suffix_ranks(text, self.symbols)
        self.size = len(text)
        self.before = text[self.suffixes - 1]
        places = np.argsort(self.before, kind="stable")
        #: (symbol, place in the transform), sorted: where a pair would stand is the rank of the first suffix that it extends to
        self.pairs = self.before[places] * (self.size + 1) + places

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Symbols of code points; one that no word has becomes a symbol that nothing extends by."""
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at + 2, self.symbols) if len(self.alphabet) else np.full(len(points), self.symbols)

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the strings with one more symbol before them."""
        key = symbol * (self.size + 1)
        return np.searchsorted(self.pairs, key + lo), np.searchsorted(self.pairs, key + hi)

    def letters(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """All extensions by a letter that are not empty: (number of the interval, symbol, lo, hi), by interval."""
        size = hi - lo
        small, large = np.flatnonzero(size <= SMALL), np.flatnonzero(size > SMALL)
        which = np.repeat(small, size[small])
        place = np.repeat(lo[small] - (np.cumsum(size[small]) - size[small]), size[small]) + np.arange(len(which))
        pair = np.unique(which * self.symbols + self.before[place])
        which = np.concatenate([pair // self.symbols, np.repeat(large, self.symbols)])
        symbol = np.concatenate([pair % self.symbols, np.tile(np.arange(self.symbols), len(large))])
        letter = symbol > AROUND
        which, symbol = which[letter], symbol[letter]
        first, last = self.extend(symbol, lo[which], hi[which])
        held = np.flatnonzero(last > first)
        held = held[np.argsort(which[held], kind="stable")]
        return which[held], symbol[held], first[held], last[held]

    def one_error(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (number of the pattern, number of an indexed word), each once: words that are one error away from a pattern.

        The error lies beyond the last ``exact`` letters of a pattern (the first, in an index read backwards), which match as they
        are. Of equal results of an inserted or deleted letter within a run of one letter, only that furthest from there is taken.
        """
        found = [self._one_error(words[i : i + TOGETHER], exact[i : i + TOGETHER], i) for i in range(0, len(words), TOGETHER)]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))

    def _one_error(self, words: list[str], exact: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
        points, lengths = code_points(words if self.backwards else [w[::-1] for w in words])
        text, begin = delimited(self.codes(points), lengths)
        text = np.append(text, AROUND)
        end = begin + lengths + 1
        # the delimiter and the exact part
        at = begin.copy()
        lo, hi = np.zeros(len(words), np.int64), np.full(len(words), self.size)
        for step in range(int(exact.max(initial=0)) + 1):
            going = np.flatnonzero((step <= exact) & (hi > lo))
            lo[going], hi[going] = self.extend(text[at[going]], lo[going], hi[going])
            at[going] += 1
        clean = np.flatnonzero(hi > lo)
        at, lo, hi = at[clean], lo[clean], hi[clean]
        erring = tuple(np.zeros(0, np.int64) for _ in range(4))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(clean) or len(erring[0]):
            # a pattern that has its error must go on as it is
            who, spot, first, last = erring
            first, last = self.extend(text[spot], first, last)
            alive = last > first
            who, spot, first, last = who[alive], spot[alive], first[alive], last[alive]
            done = spot == end[who]
            found.append((who[done], first[done]))
            stay = ~done
            erring = who[stay], spot[stay] + 1, first[stay], last[stay]
            if not len(clean):
                continue
            wanted = text[at]
            more = at < end[clean]  # a letter is still to come
            interval, of = np.unique(lo * (self.size + 1) + hi, return_inverse=True)
            which, symbol, first, last = self.letters(interval // (self.size + 1), interval % (self.size + 1))
            start = np.searchsorted(which, of)
            count = np.searchsorted(which, of, "right") - start
            state = np.repeat(np.arange(len(clean)), count)
            child = np.arange(len(state)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
            other = symbol[child] != wanted[state]
            by, letter = state[other], child[other]
            changed = more[by]
            dropped = np.flatnonzero(more & (wanted != text[np.minimum(at + 1, len(text) - 1)]))
            new = (
                (clean[by], at[by], first[letter], last[letter]),  # inserted
                (clean[by[changed]], at[by[changed]] + 1, first[letter[changed]], last[letter[changed]]),  # replaced
                (clean[dropped], at[dropped] + 1, lo[dropped], hi[dropped]),  # deleted
            )
            erring = tuple(np.concatenate([erring[k], *[n[k] for n in new]]) for k in range(4))
            same = ~other
            clean, at, lo, hi = clean[state[same]], at[state[same]] + 1, first[child[same]], last[child[same]]
        who, rank = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return who + number, np.searchsorted(self.begin, self.suffixes[rank])
