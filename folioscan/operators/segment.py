"""Dictionary segmentation of unspaced text: most probable, hidden-Markov, mixed, full and search modes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = " \t\n，。"
#: States of a character in a word (begin, end, middle, single), and the log of an impossible event.
STATES, IMPOSSIBLE = "BEMS", -3.14e100


@dataclass
class Hmm:
    start: Sequence[float]
    step: Sequence[Sequence[float]]
    emit: Sequence[dict[str, float]]


@dataclass
class Dictionary:
    """Words with log weights and tags. A user word has the weight of its frequency if it has one, else the least, median
    or greatest weight of the rest. limit bounds the length of the words that are found."""

    frequency: dict[str, float]
    tags: dict[str, str] = field(default_factory=dict)
    user: dict[str, str] = field(default_factory=dict)
    policy: str = "median"
    hmm: Hmm | None = None
    user_frequency: dict[str, float] = field(default_factory=dict)
    limit: int | None = None

    def __post_init__(self):
        total = sum(self.frequency.values()) or 1.0
        self.weight = {w: math.log(f / total) for w, f in self.frequency.items() if f > 0}
        ordered = sorted(self.weight.values()) or [0.0]
        self.least = ordered[0]
        default = {"min": ordered[0], "median": ordered[len(ordered) // 2], "max": ordered[-1]}[self.policy]
        self.weight |= {w: math.log(f / total) if (f := self.user_frequency.get(w, 0)) > 0 else default for w in self.user}
        self.tags |= self.user
        self.longest = min(max(map(len, self.weight), default=1), self.limit or 1 << 30)

    def insert(self, word: str, tag: str = "", frequency: float = 0) -> Dictionary:
        return replace(self, tags=dict(self.tags), user=self.user | {word: tag}, user_frequency=self.user_frequency | {word: frequency})

    def limited(self, longest: int | None) -> Dictionary:
        """Finds no word of more code points than that, in any mode."""
        return self if longest is None else replace(self, tags=dict(self.tags), limit=longest)

    def delete(self, word: str) -> Dictionary:
        """Without this one word; others with the same beginning stay."""
        drop = lambda d: {k: v for k, v in d.items() if k != word}
        return replace(self, frequency=drop(self.frequency), tags=drop(self.tags), user=drop(self.user), user_frequency=drop(self.user_frequency))

    @cached_property
    def trie(self) -> dict:
        """Characters to nodes; an empty string in a node says that a word ends there. Made where it is first used, in a
        task, and not sent there."""
        root: dict = {}
        for word in self.weight:
            node = root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = None
        return root

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "trie"}

    def words_at(self, text: str, i: int) -> list[int]:
        """Ends of dictionary words that start at i; the single character always counts. The walk ends where no word
        goes on."""
        out, node = [i + 1], self.trie
        for j in range(i, min(len(text), i + self.longest)):
            node = node.get(text[j])
            if node is None:
                break
            if "" in node and j > i:
                out.append(j + 1)
        return out


def pieces(text: str, separators: str = SEPARATORS) -> list[str]:
    """Runs between separators, and the separators."""
    out, run = [], ""
    for c in text:
        if c in separators:
            out += [run, c] if run else [c]
            run = ""
        else:
            run += c
    return [*out, run] if run else out


def most_probable(text: str, d: Dictionary, longest: int | None = None) -> list[str]:
    """The words of the likeliest path, found from the right; unknown characters weigh as the rarest word."""
    n = len(text)
    best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
    weight, least = d.weight, d.least
    for i in range(n - 1, -1, -1):
        score, end = weight.get(text[i], least) + best[i + 1][0], i + 1
        for j in d.words_at(text, i)[1:]:
            if longest is not None and j - i > longest:
                break
            if (x := weight[text[i:j]] + best[j][0]) > score:
                score, end = x, j
        best[i] = score, end
    out, i = [], 0
    while i < n:
        out.append(text[i : best[i][1]])
        i = best[i][1]
    return out


def _ascii_run(text: str, i: int) -> int:
    """End of a run of letters then letters or digits, or of digits with points, that starts at i; i if none does."""
    c, j = text[i], i
    if c.isascii() and c.isalpha():
        while j < len(text) and text[j].isascii() and text[j].isalnum():
            j += 1
    elif c.isascii() and c.isdigit():
        while j < len(text) and text[j].isascii() and (text[j].isdigit() or text[j] == "."):
            j += 1
    return j


def hidden_markov(text: str, hmm: Hmm | None) -> list[str]:
    """ASCII runs by rule, the rest by the likeliest states; without a model each character is a word."""
    out, i, run = [], 0, ""
    while i <= len(text):
        if i == len(text) or ord(text[i]) < 0x80:
            out += _by_states(run, hmm)
            run = ""
            if i == len(text):
                break
            j = max(_ascii_run(text, i), i + 1)
            out.append(text[i:j])
            i = j
        else:
            run += text[i]
            i += 1
    return out


def _by_states(run: str, hmm: Hmm | None) -> list[str]:
    if hmm is None or not run:
        return list(run)
    emit = lambda s, c: hmm.emit[s].get(c, IMPOSSIBLE)
    score, back = [hmm.start[s] + emit(s, run[0]) for s in range(4)], []
    for c in run[1:]:
        came = [max(range(4), key=lambda p: score[p] + hmm.step[p][s]) for s in range(4)]
        score = [score[p] + hmm.step[p][s] + emit(s, c) for s, p in enumerate(came)]
        back.append(came)
    s = 1 if score[1] >= score[3] else 3  # a word ends, or is single
    states = [s]
    for came in reversed(back):
        s = came[s]
        states.append(s)
    out, word = [], ""
    for c, s in zip(run, reversed(states)):
        word += c
        if STATES[s] in "ES":
            out.append(word)
            word = ""
    return [*out, word] if word else out


def mixed(text: str, d: Dictionary) -> list[str]:
    """Most probable words; runs of single characters that the user dictionary lacks are cut again by the model."""
    out, run = [], ""
    for w in [*most_probable(text, d), None]:
        if w is not None and len(w) == 1 and w not in d.user:
            run += w
            continue
        if run:
            out += hidden_markov(run, d.hmm)
            run = ""
        if w is not None:
            out.append(w)
    return out


def full(text: str, d: Dictionary) -> list[str]:
    """All dictionary words, and single characters that no word covers."""
    out, reach = [], 0
    for i in range(len(text)):
        ends = [j for j in d.words_at(text, i)[1:]]
        if not ends and i >= reach:
            out.append(text[i])
        out += [text[i:j] for j in ends]
        reach = max([reach, *ends, i + 1])
    return out


def for_search(text: str, d: Dictionary) -> list[str]:
    """Mixed words, each after its dictionary pairs (if longer than two) and triples (if longer than three)."""
    out = []
    for w in mixed(text, d):
        for n in (2, 3):
            if len(w) > n:
                out += [w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] in d.weight]
        out.append(w)
    return out


MODES = {"mix": mixed, "mp": most_probable, "full": full, "search": for_search, "hmm": lambda t, d: hidden_markov(t, d.hmm)}


def segment(text: str, d: Dictionary, mode: str = "mix", separators: str = SEPARATORS, longest: int | None = None) -> list[str]:
    d = d.limited(longest)
    return [w for p in pieces(text, separators) for w in (MODES[mode](p, d) if p not in separators else [p])]


def segmented(text: Column, d: Dictionary, mode: str = "mix", separators: str = SEPARATORS, longest: int | None = None) -> Column:
    """Words of a text column over Arrow batches; the dictionary travels with the function."""
    d = d.limited(longest)

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield part.map(lambda t: None if t is None else segment(t, d, mode, separators))

    return run(text)


#: Pieces whose numbers of words a task keeps, and the longest of them.
KEPT_PIECES, KEPT_LENGTH = 100_000, 64


def counted(text: Column, d: Dictionary, modes: Mapping[str, tuple[str, int | None]], separators: str = SEPARATORS) -> Column:
    """Numbers of words that each mode finds, by name: (mode, longest word). One pass over Arrow batches, in which no
    document's words stay; pieces that come again are looked up."""
    ways = [(MODES[mode], d.limited(longest)) for mode, longest in modes.values()]

    @F.pandas_udf(", ".join(f"{name} int" for name in modes))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        plain = lambda piece: [1 if piece in separators else len(cut(piece, own)) for cut, own in ways]
        known = lru_cache(KEPT_PIECES)(plain)

        def numbers(text: str | None) -> list[int | None]:
            total: list[int | None] = [None] * len(ways) if text is None else [0] * len(ways)
            for piece in pieces(text, separators) if text else ():
                total = [a + b for a, b in zip(total, known(piece) if len(piece) <= KEPT_LENGTH else plain(piece))]
            return total

        for part in parts:
            yield pd.DataFrame([numbers(t) for t in part], columns=list(modes), dtype="Int32")

    return run(text)


def words_by(d: Dictionary, mode: str = "mix", separators: str = SEPARATORS) -> Callable[[Column], Column]:
    """How an index and its queries cut text into words, for `index.build`, `index.search` and the search service: so
    that a word of unspaced text is found. Separators, blanks and ASCII punctuation are no words."""
    return lambda text: F.filter(segmented(text, d, mode, separators), lambda w: ~F.rlike(w, F.lit(r"^[\p{P}\p{S}\p{Z}\p{C}]*$")))


def read_dictionary(lines: Iterable[str], user_lines: Iterable[str] = (), policy: str = "median", hmm: Hmm | None = None) -> Dictionary:
    """Lines of word, frequency, tag; user lines of word, [frequency,] [tag]."""
    frequency, tags, user, own = {}, {}, {}, {}
    for parts in (x.split() for x in lines):
        if len(parts) == 3:
            frequency[parts[0]], tags[parts[0]] = float(parts[1]), parts[2]
    for parts in (x.split() for x in user_lines):
        if parts:
            user[parts[0]] = parts[-1] if len(parts) > 1 and not parts[-1].isdigit() else ""
            own |= {parts[0]: float(x) for x in parts[1:2] if x.isdigit()}
    return Dictionary(frequency, tags, user, policy, hmm, own)
