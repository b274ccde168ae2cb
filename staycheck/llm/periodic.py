"""Periodic runs: stretches of words that repeat with a period, found by a suffix automaton with link-cut access.

Words of a stretch are appended to a suffix automaton one by one. Every state carries the place where its
strings last ended, held once for each path of states in the tree of suffix links that one append has
coloured. Appending word r visits the states on the way from the new state to the root, path by path (the
access of a link-cut tree: splay the state, cut what hangs below it, join what came before), and colours them
all with r. A path whose longest string has m words and that last ended at p gives a distance d = r - p; if
d <= m the two occurrences meet, so the last m + d words have period d, a square and more. That stretch can't
be extended to the left, as m is the longest of its path, and is a run once the next word breaks it. At the
last word of a run of smallest period q and three or more periods, the path of its last length - q words has
last ended exactly q words before (a nearer end would give a smaller period), so every such run is found, and
found once.

Where no run can be, no automaton is built: in a run of at least SHORTEST words and REPEATS periods every
window of so many words (9) occurs again, a period before or after, in the same run. Stretches of
consecutive windows that repeat within the stretch are kept, by hash, until none falls away or ROUNDS times;
chance collisions only keep more. Rows are independent: nothing is shuffled, memory grows with a slice of texts or
one text, and work with n log n of the words in such stretches.

Cases: a null or empty text has no words and no run. One row in gives one row out, repeated rows and null
doc_ids included. Equal exponents: the smallest start, then the smallest period, is the greatest. Words are
compared byte by byte. An empty table gives an empty result. Extra columns are left behind.
"""

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staycheck.llm.common import doc_rows
from staycheck.llm.substring_dedup import BASES, NO_ID, Roller, _buffers, mixed, window_hashes

SHORTEST, REPEATS = 24, 3
ROUNDS = 16
WORD = r"[^\x20\x09-\x0D]+"
RUNS = "array<struct<start: long, length: long, period: long>>"


def window_of(shortest: int, repeats: int) -> int:
    """The longest window of which every place in a run occurs again in it, a period q before or after: at
    most the run's length less 2 * q - 1."""
    return max(1, min(max(shortest, repeats * q) - 2 * q + 1 for q in range(1, shortest + 1)))


class Automaton:
    """Suffix automaton over numbered words, with the last end of every state's strings.

    States are numbers from 1, 0 being none; state 1 holds the empty string. A state's only transition is in
    two arrays, further ones in a dictionary. left, right and up are the splay trees: within one, states of one
    path by length; the root's up is the state its path hangs on. colour is that of a path, at its splay root."""

    def __init__(self, words: int):
        size = 2 * words + 3
        self.length, self.link, self.colour = array("i", bytes(4 * size)), array("i", bytes(4 * size)), array("i", bytes(4 * size))
        self.left, self.right, self.up = array("i", bytes(4 * size)), array("i", bytes(4 * size)), array("i", bytes(4 * size))
        self.word, self.to = array("i", b"\xff" * (4 * size)), array("i", bytes(4 * size))
        self.more: dict[int, dict[int, int]] = {}
        self.states, self.last = 1, 1

    def step(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, 0) if more else 0

    def _set(self, state: int, word: int, to: int):
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def append(self, word: int) -> int:
        """The state of the longer text."""
        length, link = self.length, self.link
        new = self.states = self.states + 1
        length[new] = length[self.last] + 1
        at, self.last = self.last, new
        while at and not (next_ := self.step(at, word)):
            self._set(at, word, new)
            at = link[at]
        if not at:
            parent = 1
        elif length[next_] == length[at] + 1:
            parent = next_
        else:
            parent = self._split(at, next_, word)
        link[new] = parent
        self.up[new] = parent
        return new

    def _split(self, at: int, old: int, word: int) -> int:
        """The shorter strings of a state get one of their own, above it on the same path."""
        length, link = self.length, self.link
        clone = self.states = self.states + 1
        length[clone], link[clone] = length[at] + 1, link[old]
        self.word[clone], self.to[clone] = self.word[old], self.to[old]
        if old in self.more:
            self.more[clone] = dict(self.more[old])
        link[old] = clone
        while at and self.step(at, word) == old:
            self._set(at, word, clone)
            at = link[at]
        self._splay(old)
        above = self.left[old]
        self.left[clone], self.left[old], self.up[clone] = above, clone, old
        if above:
            self.up[above] = clone
        return clone

    def _splay(self, x: int):
        left, right, up, colour = self.left, self.right, self.up, self.colour
        y = up[x]
        if not y or (left[y] != x and right[y] != x):
            return
        while True:
            y = up[x]
            if not y:
                break
            x_left = left[y] == x
            if not x_left and right[y] != x:
                break
            z = up[y]
            y_left = z and left[z] == y
            y_inner = y_left or (z and right[z] == y)
            if y_inner and x_left == y_left:  # the same side twice: the upper one turns first
                if x_left:
                    b = left[z] = right[y]
                    right[y] = z
                else:
                    b = right[z] = left[y]
                    left[y] = z
                if b:
                    up[b] = z
                top = up[z]
                up[z] = y
                up[y] = top
                if top:
                    if left[top] == z:
                        left[top] = y
                    elif right[top] == z:
                        right[top] = y
                colour[y] = colour[z]
                z = top
                y_inner = False
            if x_left:
                b = left[y] = right[x]
                right[x] = y
            else:
                b = right[y] = left[x]
                left[x] = y
            if b:
                up[b] = y
            z = up[y]
            up[y] = x
            up[x] = z
            if z:
                if left[z] == y:
                    left[z] = x
                elif right[z] == y:
                    right[z] = x
            colour[x] = colour[y]

    def access(self, state: int, r: int) -> list[tuple[int, int]]:
        """(longest string, last end) of each path from a state to the root; all of it now ends at r (from 1)."""
        right, up, colour, length = self.right, self.up, self.colour, self.length
        found, below = [], 0
        while state:
            self._splay(state)
            if colour[state]:
                found.append((length[state], colour[state]))
            cut = right[state]
            if cut:
                colour[cut] = colour[state]
            right[state] = below
            if below:
                up[below] = state
            below = state
            state = up[state]
        colour[below] = r
        return found


def runs(words: list, shortest: int = SHORTEST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a list of words, in order."""
    numbers: dict = {}
    codes = [numbers.setdefault(w, len(numbers)) for w in words]
    grown, n, out = Automaton(len(codes)), len(codes), []
    for r, code in enumerate(codes):
        for longest, end in grown.access(grown.append(code), r + 1):
            period = r + 1 - end
            whole = longest + period
            if whole >= shortest and whole >= repeats * period and (r + 1 == n or codes[r + 1] != codes[r + 1 - period]):
                out.append((r + 1 - whole, whole, period))
    return sorted(out, key=lambda x: (x[0], x[2]))


def stretches(hashes: np.ndarray, owner: np.ndarray, start: np.ndarray, window: int, shortest: int) -> list[tuple[int, int, int]]:
    """(text, first word, last word exclusive) of stretches of windows that occur again in their stretch."""
    least = shortest - window + 1
    group = mixed(owner.astype(np.uint64) + np.uint64(1))
    for _ in range(ROUNDS):  # keeping more than needed loses nothing
        key = hashes ^ group
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        again = np.zeros(len(key), bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        chosen = np.flatnonzero(again)
        if not len(chosen):
            return []
        new = (np.diff(start[chosen], prepend=-2) != 1) | (np.diff(owner[chosen], prepend=-1) != 0)
        number = np.cumsum(new) - 1
        kept = np.bincount(number)[number] >= least
        chosen, number = chosen[kept], number[kept]
        if len(chosen) == len(hashes):
            break
        hashes, owner, start = hashes[chosen], owner[chosen], start[chosen]
        group = mixed(number.astype(np.uint64) + np.uint64(1))
    first = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
    last = np.append(first[1:], len(start)) - 1
    return list(zip(owner[first].tolist(), start[first].tolist(), (start[last] + window).tolist()))


def _find(shortest: int, repeats: int):
    window = window_of(shortest, repeats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rollers = Roller(BASES[0]), Roller(BASES[1])
        for ids, keys, data, bounds in _buffers(batches):
            found: dict[int, list] = {}
            hashes, owner, start = window_hashes(data, bounds, rollers, window)
            raw = data.tobytes()
            words: list = []
            at = -1
            for text, first, last in stretches(hashes, owner, start, window, shortest):
                if text != at:
                    at, words = text, raw[bounds[text]:bounds[text + 1]].split()
                mine = runs(words[first:last], shortest, repeats)
                found.setdefault(text, []).extend((first + s, length, period) for s, length, period in mine)
            columns: list[list] = [[], [], []]
            for text in range(len(ids)):
                words = raw[bounds[text]:bounds[text + 1]].split()
                own = sorted(found.get(text, []), key=lambda x: (x[0], x[2]))
                columns[0].append(len(words))
                columns[1].append([{"start": s, "length": n, "period": p} for s, n, p in own])
                columns[2].append(b" ".join(collapsed(words, own)).decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(keys, pa.int64()), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], RUN_LIST), pa.array(columns[2], pa.string())],
                ["doc_id", "row_key", "n_words", "runs", "kept_text"])

    return run


RUN_LIST = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run contains beyond its first period."""
    if not found:
        return words
    change = [0] * (len(words) + 1)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    out, inside = [], 0
    for word, by in zip(words, change):
        inside += by
        if not inside:
            out.append(word)
    return out


def find_runs(docs: DataFrame, shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """doc_id, row_key, n_words, runs (by start, then period), kept_text (words joined by one blank, without
    what repeats), one row per row of docs. shortest and repeats: words and periods a run has at least; repeats
    is 3 or more, as runs of fewer periods can hide behind a nearer end."""
    if repeats < 3:
        raise ValueError("repeats is 3 or more")
    return doc_rows(docs).mapInArrow(_find(shortest, repeats),
                                     f"doc_id long, row_key long, n_words long, runs {RUNS}, kept_text string")


def greatest(found: str = "runs") -> Column:
    """The run with the greatest length / period, or null. Shares are compared as whole numbers."""
    return F.expr(f"aggregate({found}, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (best, x) -> "
                  "CASE WHEN best IS NULL OR cast(x.length AS decimal(19, 0)) * best.period > "
                  "cast(best.length AS decimal(19, 0)) * x.period THEN x ELSE best END)")
