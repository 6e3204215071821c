"""Many keywords in one pass: an automaton with goto and failure links.

All words form one trie. A state's failure link is its longest proper suffix
that is a state too; taken into the table, every symbol has one next state, so
a text is read once however many words there are. A state knows the highest
score of the words that end there, its suffixes included.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

# Table cells of one automaton (4 bytes each); larger word lists take several.
MOST_CELLS = 1 << 24
# Characters read at once.
SLICE_CHARS = 4_000_000


class Automaton:
    """Best score of the words in a text, for each of several tables of words."""

    def __init__(self, words: dict[str, list]):
        """``words`` has, for each word, its score by table (0 where absent)."""
        self.symbols = {c: i + 1 for i, c in enumerate(sorted({c for w in words for c in w}))}
        children: list[dict[int, int]] = [{}]
        ends = {}
        for word in words:
            state = 0
            for c in map(self.symbols.get, word):
                if c not in children[state]:
                    children[state][c] = len(children)
                    children.append({})
                state = children[state][c]
            ends[state] = word
        tables = len(next(iter(words.values())))
        self.best = np.zeros((len(children), tables), dtype=np.int32)
        for state, word in ends.items():
            self.best[state] = np.maximum(words[word], 0)
        self.next = np.zeros((len(children), len(self.symbols) + 1), dtype=np.int32)
        fail = [0] * len(children)
        level = [0]
        while level:
            deeper = []
            for state in level:
                if state:
                    # What the suffix does, unless the word goes on.
                    self.next[state] = self.next[fail[state]]
                    self.best[state] = np.maximum(self.best[state], self.best[fail[state]])
                for c, child in children[state].items():
                    fail[child] = int(self.next[state, c]) if state else 0
                    self.next[state, c] = child
                    deeper.append(child)
            level = deeper
        points = np.array([ord(c) for c in self.symbols], dtype=np.uint32)
        self._points = points[np.argsort(points)]

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        joined = "".join(texts).encode("utf-32-le", "surrogatepass")
        codes = np.frombuffer(joined, dtype=np.uint32)
        place = np.searchsorted(self._points, codes)
        place = np.minimum(place, len(self._points) - 1)
        symbols = np.where(self._points[place] == codes, place + 1, 0)
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        return symbols, np.cumsum(sizes) - sizes, sizes

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row a text, one column a table; 0 where no word occurs."""
        symbols, begins, sizes = self._read(texts)
        order = np.argsort(-sizes, kind="stable")
        begins, sizes = begins[order], sizes[order]
        found = np.zeros((len(texts), self.best.shape[1]), dtype=np.int32)
        state = np.zeros(len(texts), dtype=np.int32)
        # All texts step at once; the shorter ones drop out at the end.
        left = np.searchsorted(-sizes, -np.arange(1, sizes.max(initial=0) + 1), side="right")
        for t, n in enumerate(left.tolist()):
            state[:n] = self.next[state[:n], symbols[begins[:n] + t]]
            np.maximum(found[:n], self.best[state[:n]], out=found[:n])
        out = np.empty_like(found)
        out[order] = found
        return out


def automata(tables: list[dict[str, int]]) -> list[Automaton]:
    """All words of all tables, in as many automata as the bound asks for."""
    words: dict[str, list] = {}
    for i, table in enumerate(tables):
        for word, score in table.items():
            if word:
                words.setdefault(word, [0] * len(tables))[i] = score
    parts, held, letters, states = [], {}, set(), 1
    for word, scores in words.items():
        letters |= set(word)
        states += len(word)
        if held and states * (len(letters) + 1) > MOST_CELLS:
            parts.append(Automaton(held))
            held, letters, states = {}, set(word), 1 + len(word)
        held[word] = scores
    return [*parts, Automaton(held)] if held else parts


def table_scores(text: Column, base: dict[str, int], named: dict[str, dict], name: Column) -> Column:
    """Highest score of the words of ``base`` and of the table called ``name``.

    0 where none occurs; a NULL text has no words and an unknown name no table.
    Scores below 0 count as 0.
    """
    names = {n: i + 1 for i, n in enumerate(named)}
    built = automata([base, *named.values()])

    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        out, part, which, held = [], [], [], 0

        def flush():
            best = np.zeros((len(part), len(names) + 1), dtype=np.int32)
            for automaton in built:
                np.maximum(best, automaton.scores(part), out=best)
            own = best[np.arange(len(part)), which] if part else best[:, 0]
            out.append(np.maximum(best[:, 0], own))

        for one, kind in zip(texts, kinds):
            part.append(one.as_py() or "")
            which.append(names.get(kind.as_py(), 0))
            held += len(part[-1])
            if held >= SLICE_CHARS:
                flush()
                part, which, held = [], [], 0
        flush()
        return pa.array(np.concatenate(out), pa.int32())

    return F.arrow_udf(run, "int")(text, name)
