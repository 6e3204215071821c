"""Language of whole texts by cross-parsing entropy.

A suffix automaton is built over a bounded sample of labelled text of each
language. A text is parsed greedily into the longest phrases that occur in the
language's sample; the number of phrases times the cost of pointing into the
sample, per letter, estimates the cross entropy. The language with the least
wins.

The sample: per language the labelled rows with the least hash of their text,
until ``SAMPLE_CHARS`` characters or ``SAMPLE_ROWS`` rows are reached (documented
bounds of the training set; the last row is cut there). A row gives a twentieth
of the sample at most, from a place that its hash tells, so that a beginning
shared by many rows does not fill it. Equal texts count once.

A text longer than ``LANE`` symbols is parsed in lanes side by side. Each lane is
then joined to the one before: the phrase that comes in goes on until both
parses begin a phrase at one place, from where they agree. The phrases are those
of one greedy parse of the whole text.

Defined results: NULL text or text without a letter gives ``und`` and score 0;
ties go to the language whose name sorts first; repeated rows are each given
their result; an empty table gives no rows; with no labelled text every row is
``und``; extra columns are kept. ``score`` is one minus the best language's
rate over the next best's (or, with one language, over one phrase a letter).
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pagelens.llm.worker import document_batches, hold

SAMPLE_CHARS = 30_000
# Rows considered for the sample of one language.
SAMPLE_ROWS = 1000
LANE = 2048
# Cells of a dense table of all transitions (4 bytes each); where states times
# letters are more, as in scripts of thousands of letters, they are hashed.
DENSE_CELLS = 1 << 25
# Symbols parsed at once; bounds a task's memory.
STEP_SYMBOLS = 1_000_000
UNKNOWN = "und"


class SuffixAutomaton:
    """Transitions of all substrings of a sequence of small integers."""

    def __init__(self, symbols, alphabet: int):
        link, length = [-1], [0]
        moves: list[dict[int, int]] = [{}]
        last = 0
        for c in symbols:
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            at = last
            while at >= 0 and c not in moves[at]:
                moves[at][c] = new
                at = link[at]
            if at >= 0:
                to = moves[at][c]
                if length[to] == length[at] + 1:
                    link[new] = to
                else:
                    copy = len(moves)
                    moves.append(dict(moves[to]))
                    length.append(length[at] + 1)
                    link.append(link[to])
                    while at >= 0 and moves[at].get(c) == to:
                        moves[at][c] = copy
                        at = link[at]
                    link[to] = link[new] = copy
            last = new
        # Transitions as ``state, symbol, target`` in order of state.
        self.states = len(moves)
        self.moves = np.array(
            [(state, c, to) for state, out in enumerate(moves) for c, to in out.items()],
            dtype=np.int64,
        ).reshape(-1, 3)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (spread >> np.uint64(64 - bits)).astype(np.int64)


class HashedMoves:
    """Targets by 64-bit key in a table with linear probing, half empty."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray):
        self.bits = max(1, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, dtype=np.int64)
        self.targets = np.zeros(size, dtype=np.int32)
        slot = _slots(keys, self.bits)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] < 0
            # Of those that want one free slot the first in order gets it.
            _, first = np.unique(slot[left], return_index=True)
            first = first[free[first]]
            self.keys[slot[left[first]]] = keys[left[first]]
            self.targets[slot[left[first]]] = targets[left[first]]
            left = np.delete(left, first)
            slot[left] = (slot[left] + 1) & (size - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Targets, -1 where there is none."""
        out = np.full(len(keys), -1, dtype=np.int32)
        slot = _slots(keys, self.bits)
        left = np.arange(len(keys))
        while len(left):
            held = self.keys[slot[left]]
            hit = held == keys[left]
            out[left[hit]] = self.targets[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
        return out


class CrossParser:
    """Parses texts against the samples of all languages at once."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        folded = {k: samples[k].lower() for k in self.languages}
        letters = sorted({c for text in folded.values() for c in text if c.isalpha()})
        # Symbol 0 is any run of other characters, the last any other letter.
        self.other = len(letters) + 1
        self.alphabet = self.other + 1
        # Characters of the samples get their symbol here, others by isalpha.
        self.symbol_of = {c: i + 1 for i, c in enumerate(letters)}
        self._table = np.full(1 << 16, -1, dtype=np.int32)
        for c, i in self.symbol_of.items():
            if ord(c) < 1 << 16:
                self._table[ord(c)] = i
        self.costs, self.starts, found = [], [], []
        base = 0
        for language in self.languages:
            symbols, _ = self.symbols([folded[language]])
            automaton = SuffixAutomaton(symbols.tolist(), self.alphabet)
            found.append(automaton.moves + np.array([base, 0, base]))
            # One more state stands before a phrase: at the start, and after a
            # symbol that the sample does not have, which is one by itself.
            self.starts.append(base + automaton.states)
            base += automaton.states + 1
            self.costs.append(math.log2(max(len(symbols), 2)))
        self._build(base, found)

    def _build(self, states: int, found: list[np.ndarray]) -> None:
        """``restart``: where a phrase that begins with a symbol leads, by language."""
        self.restart = np.repeat(
            np.array(self.starts, dtype=np.int32)[:, None], self.alphabet, axis=1
        )
        roots = [0, *[start + 1 for start in self.starts[:-1]]]
        for k, (root, moves) in enumerate(zip(roots, found)):
            first = moves[moves[:, 0] == root]
            self.restart[k, first[:, 1]] = first[:, 2]
        moves = np.concatenate([np.empty((0, 3), np.int64), *found])
        self.dense = self.hashed = None
        if states * self.alphabet > DENSE_CELLS:
            self.hashed = HashedMoves(moves[:, 0] * self.alphabet + moves[:, 1], moves[:, 2])
            return
        # Target and, in the lowest bit, whether the symbol begins a phrase.
        owner = np.searchsorted(self.starts, np.arange(states))
        dense = (self.restart << 1 | 1)[owner] if states else self.restart
        dense[moves[:, 0], moves[:, 1]] = moves[:, 2] << 1
        self.dense = np.ascontiguousarray(dense, dtype=np.int32).ravel()

    def move(self, state: np.ndarray, symbol: np.ndarray, language: np.ndarray):
        """Next state, and 1 where the symbol begins a phrase."""
        key = state.astype(np.int64) * self.alphabet + symbol
        if self.dense is not None:
            entry = self.dense[key]
            return entry >> 1, entry & 1
        to = self.hashed.find(key.ravel()).reshape(key.shape)
        new = to < 0
        to = np.where(new, self.restart[np.broadcast_to(language, key.shape), symbol], to)
        return to, new.astype(np.int32)

    def _symbols_of_codes(self, codes: np.ndarray) -> np.ndarray:
        """Symbol of each code point; characters not seen yet are learnt."""
        out = self._table[np.minimum(codes, 0xFFFF)].copy()
        out[codes > 0xFFFF] = -1
        fresh = np.unique(codes[out < 0])
        if len(fresh):
            values = np.array(
                [
                    self.symbol_of.get(chr(c), self.other) if chr(c).isalpha() else 0
                    for c in fresh.tolist()
                ],
                dtype=np.int32,
            )
            low = fresh < 0xFFFF
            self._table[fresh[low]] = values[low]
            todo = np.flatnonzero(out < 0)
            out[todo] = values[np.searchsorted(fresh, codes[todo])]
        return out

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts and where each text's begin (one more)."""
        codes = np.frombuffer(
            "".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4"
        )
        bounds = np.cumsum([0] + [len(t) for t in texts])
        out = self._symbols_of_codes(codes)
        # A run of non-letters is one symbol; a text's own first is kept.
        keep = np.ones(len(out), dtype=bool)
        keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
        keep[bounds[:-1][bounds[:-1] < len(out)]] = True
        before = np.concatenate([[0], np.cumsum(keep)])
        return out[keep], before[bounds]

    def phrases(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        texts, languages = len(bounds) - 1, len(self.languages)
        sizes = np.diff(bounds)
        lanes_of = -(-sizes // LANE)
        owner = np.repeat(np.arange(texts), lanes_of)
        number = np.arange(len(owner)) - np.repeat(
            np.cumsum(lanes_of) - lanes_of, lanes_of
        )
        begin = bounds[:-1][owner] + number * LANE
        length = np.minimum(sizes[owner] - number * LANE, LANE)
        order = np.argsort(-length, kind="stable")
        starts, sizes_down = begin[order], length[order]
        alive = np.searchsorted(-sizes_down, -np.arange(1, LANE + 1), side="right")
        state = np.tile(np.array(self.starts, dtype=np.int32), (len(owner), 1))
        found = np.zeros((len(owner), languages), dtype=np.int64)
        column = np.arange(languages)[None, :]
        for t in range(int(sizes_down[0]) if len(sizes_down) else 0):
            n = alive[t]
            moved, new = self.move(state[:n], symbols[starts[:n] + t][:, None], column)
            found[:n] += new
            state[:n] = moved
        by_lane = np.empty_like(found)
        by_lane[order] = found
        ends = np.empty_like(state)
        ends[order] = state
        by_lane += self._joined(symbols, number, begin, length, ends)
        out = np.zeros((texts, languages), dtype=np.int64)
        np.add.at(out, owner, by_lane)
        return out

    def _joined(self, symbols, number, begin, length, ends) -> np.ndarray:
        """What the phrases of each lane change by as the lane before comes in.

        ``ends`` has the state behind each lane. Where a lane ends before the
        two parses agree, it gets another one and the next lane is joined anew.
        """
        languages = len(self.languages)
        change = np.zeros((len(number), languages), dtype=np.int64)
        fresh, own_ends = np.array(self.starts, dtype=np.int32), ends.copy()
        lane, language = np.nonzero(np.repeat((number > 0)[:, None], languages, axis=1))
        while len(lane):
            change[lane, language] = 0
            going = np.arange(len(lane))
            came, alone = ends[lane - 1, language], fresh[language]
            again = []
            for t in range(LANE):
                # A lane that is over before the parses agree has a new end.
                over = length[lane[going]] <= t
                if over.any():
                    again.append(going[over])
                    going = going[~over]
                if not len(going):
                    break
                symbol = symbols[begin[lane[going]] + t]
                came[going], one = self.move(came[going], symbol, language[going])
                alone[going], two = self.move(alone[going], symbol, language[going])
                np.add.at(change, (lane[going], language[going]), one - two)
                going = going[came[going] != alone[going]]
            again = np.concatenate([np.empty(0, np.int64), *again, going])
            now = own_ends[lane, language]
            now[again] = came[again]
            other = now != ends[lane, language]
            ends[lane, language] = now
            # The lane behind, if it is of the same text.
            behind, language = lane[other] + 1, language[other]
            inside = behind < len(number)
            inside[inside] = number[behind[inside]] > 0
            lane, language = behind[inside], language[inside]
        return change

    def rates(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bits per letter by language, and the letters of each text."""
        folded = [(t or "").lower() for t in texts]
        symbols, bounds = self.symbols(folded)
        is_letter = np.concatenate([[0], np.cumsum(symbols > 0)])
        letters = is_letter[bounds[1:]] - is_letter[bounds[:-1]]
        phrases = self.phrases(symbols, bounds)
        bits = phrases * np.array(self.costs)
        return bits / np.maximum(letters, 1)[:, None], letters

    def predict(self, texts: list) -> tuple[list, list]:
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        rates, letters = self.rates(texts)
        best = np.argmin(rates, axis=1)
        ranked = np.sort(rates, axis=1)
        ceiling = ranked[:, 1] if len(self.languages) > 1 else np.full(
            len(rates), self.costs[0]
        )
        score = 1 - ranked[:, 0] / np.maximum(ceiling, 1e-12)
        score = np.clip(np.where(letters > 0, score, 0.0), 0.0, 1.0)
        names = [
            self.languages[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters)
        ]
        return names, score.tolist()


def held_out(doc_id="doc_id"):
    """Rows that nothing is learned from; one without an id is not among them."""
    rest = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def training_samples(labelled: DataFrame, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Sample text per language; at most ``SAMPLE_ROWS`` rows of each are read.

    Rows are chosen by a hash of their text: per language the least hashes are
    found with a cut on the map side, so a hot language is never sorted whole.
    Of those only the rows that the sample has room for are read.
    """
    share = max(1, chars // 20)
    usable = labelled.filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    ).select(
        "lang",
        "text",
        F.xxhash64("text").alias("h"),
        F.least(F.char_length("text"), F.lit(share)).alias("gives"),
    )
    # The hash is split over salts first; each keeps its own least rows.
    salted = usable.withColumn("salt", F.pmod(F.hash("text"), F.lit(64)))
    in_salt = Window.partitionBy("lang", "salt").orderBy("h")
    by_hash = Window.partitionBy("lang").orderBy("h")
    before = by_hash.rowsBetween(Window.unboundedPreceding, -1)
    chosen = (
        salted.select("lang", "salt", "h", "gives")
        .distinct()
        .withColumn("r", F.row_number().over(in_salt))
        .filter(F.col("r") <= SAMPLE_ROWS)
        .withColumn("rank", F.row_number().over(by_hash))
        .filter(F.col("rank") <= SAMPLE_ROWS)
        .withColumn("held", F.coalesce(F.sum("gives").over(before), F.lit(0)))
        .filter(F.col("held") < chars)
        .select("lang", "h", "rank")
    )
    place = F.pmod("h", F.char_length("text") - F.col("gives") + 1).cast("int") + 1
    rows = (
        usable.withColumn("piece", F.substr("text", place, F.lit(share)))
        .join(F.broadcast(chosen), ["lang", "h"])
        .groupBy("lang", "h", "rank")
        .agg(F.min("piece").alias("text"))
        .collect()
    )
    samples: dict[str, str] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        text = samples.get(row["lang"], "")
        if len(text) < chars:
            samples[row["lang"]] = (text + "\n" + row["text"])[:chars]
    return samples


def identify(
    docs: DataFrame, samples: dict[str, str], into=("lang_pred", "score")
) -> DataFrame:
    """Adds language and score, replacing columns of those names.

    Only ``text`` is looked at.

    The broadcast holds the automata of the samples, whatever the size of
    ``docs``: at most two states and three transitions a sample character for
    each language. Transitions take ``4 * DENSE_CELLS`` bytes in a dense table;
    where that is too small, 24 to 48 bytes each, and 4 bytes for each letter
    and language.
    """
    spark = docs.sparkSession
    document_batches(spark)
    parser = spark.sparkContext.broadcast(CrossParser(samples))

    def predict(texts: pa.Array) -> pa.Array:
        # Values are decoded a slice at a time.
        hold("language")
        names, scores, part, held = [], [], [], 0
        for text in texts:
            part.append(text.as_py())
            held += len(part[-1] or "")
            if held >= STEP_SYMBOLS:
                found = parser.value.predict(part)
                names += found[0]
                scores += found[1]
                part, held = [], 0
        if part:
            found = parser.value.predict(part)
            names += found[0]
            scores += found[1]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
            ["lang_pred", "score"],
        )

    udf = F.arrow_udf(predict, "struct<lang_pred: string, score: double>")
    found = docs.withColumn("__found", udf.asNondeterministic()("text"))
    return found.select(
        *[c for c in docs.columns if c not in into],
        F.col("__found.lang_pred").alias(into[0]),
        F.col("__found.score").alias(into[1]),
    )
