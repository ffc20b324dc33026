"""Runs of words that repeat with a period: candidates on a harmonic grid, exact extensions by a recompression grammar."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuesmith.llm.common import SPACE, U64, mix, small_batches, steps, text_buffers, words_of

#: A run has this many words and holds its period this many times, at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Candidate cells that are held before they are thinned out.
HELD = 1 << 20
#: Parts of a cell where both sides are compared before the grammar is asked.
PROBES = ((1, 1), (1, 2), (1, 4), (3, 4), (1, 8), (5, 8), (3, 8), (7, 8))
#: Divisions into left and right symbols that each round of pair compression chooses from.
DIVISIONS = 4

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
REPORT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")]
    + [T.StructField(n, T.StringType()) for n in ("runs_sha256", "collapsed_sha256")]
    + [T.StructField("runs", T.ArrayType(RUN))]
)

Rewrite = Callable[[int | None, int], tuple[int, int] | None]


# ---------------------------------------------------------------- the grammar


class Grammar:
    """A run-length grammar of a sequence of symbols by recompression, and the longest common extensions of two places in it.

    Each round first names every block of one repeated symbol, then every pair of a left and a right symbol; which symbols are left
    and which right is the division of DIVISIONS that joins most pairs. Equal stretches are cut alike but for their edges, so a
    comparison climbs from words to long symbols and down again, in steps that grow with the logarithm of the agreement. A level keeps
    the place and the name of its symbols and how many equal symbols stand before and after each, so levels together take room in
    proportion to the sequence. Negative symbols are barriers: each must be unique, nothing is joined with them, and the sequence
    begins and ends with one.
    """

    def __init__(self, symbols: np.ndarray):
        symbol, at = symbols.astype(np.int64), np.arange(len(symbols), dtype=np.int64)
        self.size, self.levels = len(symbols), []
        name = int(symbol.max(initial=0)) + 1
        while True:
            first = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
            count = np.diff(np.append(first, len(symbol)))
            within = np.arange(len(symbol)) - np.repeat(first, count)
            self.levels.append((np.append(at, self.size), symbol, within + 1, np.repeat(count, count) - within))
            blocks, name = self._named(symbol[first], count, count > 1, name)
            left = self._division(blocks)
            joined = np.append(left[:-1] & self._right(left, blocks)[1:], False) if len(blocks) else left
            if not joined.any() and len(blocks) == len(symbol):
                return
            pairs, name = self._named(blocks, np.append(blocks[1:], 0), joined, name)
            stays = np.append(True, ~joined[:-1])
            symbol, at = pairs[stays], at[first][stays]

    @staticmethod
    def _named(a: np.ndarray, b: np.ndarray, which: np.ndarray, name: int) -> tuple[np.ndarray, int]:
        """a, where each different (a, b) marked in `which` gets a name of its own, from `name` on."""
        out = a.copy()
        if which.any():
            found, inverse = np.unique(a[which] * np.int64(int(b[which].max()) + 1) + b[which], return_inverse=True)
            out[which] = name + inverse
            name += len(found)
        return out, name

    @staticmethod
    def _right(left: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return ~left & (symbol >= 0)

    def _division(self, symbol: np.ndarray) -> np.ndarray:
        """Which symbols are left ones."""
        best, most = np.zeros(len(symbol), bool), 0
        for seed in range(DIVISIONS):
            bit = (mix(symbol.astype(U64) + U64((len(self.levels) * DIVISIONS + seed) << 40)) & U64(1)).astype(bool)
            for left in (bit & (symbol >= 0), ~bit & (symbol >= 0)):
                n = int((left[:-1] & self._right(left, symbol)[1:]).sum())
                if n > most:
                    best, most = left, n
        return best

    def _try(self, level: int, i: np.ndarray, j: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where the symbols of a level that begin (back: end) at i and j are equal, and how many places they and their repeats take."""
        at, symbol, before, after = self.levels[level]
        x, y = np.searchsorted(at, i), np.searchsorted(at, j)
        whole = (at[x] == i) & (at[y] == j)
        same = before if back else after
        a, b = (x - 1, y - 1) if back else (x, y)
        a, b = np.clip(a, 0, len(symbol) - 1), np.clip(b, 0, len(symbol) - 1)
        equal = whole & (symbol[a] == symbol[b])
        n = np.where(equal, np.minimum(same[a], same[b]), 0)
        return equal, np.where(equal, at[x] - at[x - n] if back else at[np.minimum(x + n, len(symbol))] - at[np.minimum(x, len(symbol))], 0)

    def extend(self, i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from the places i and j on (back: before them), i < j, up to a barrier at most."""
        sign, start, top = (-1 if back else 1), i.copy(), np.zeros(len(i), np.int64)
        i, j = i.copy(), j.copy()
        climbing = np.arange(len(i))
        for level in range(len(self.levels)):  # upwards, as soon as both places are bounds of the next level
            turn, climbing = climbing, []
            above = self.levels[min(level + 1, len(self.levels) - 1)][0]
            while len(turn):
                equal, n = self._try(level, i[turn], j[turn], back)
                top[turn[~equal]] = level
                turn, n = turn[equal], n[equal]
                i[turn] += sign * n
                j[turn] += sign * n
                if level + 1 < len(self.levels):
                    up = (above[np.searchsorted(above, i[turn])] == i[turn]) & (above[np.searchsorted(above, j[turn])] == j[turn])
                    climbing.append(turn[up])
                    turn = turn[~up]
            climbing = np.concatenate(climbing) if climbing else turn
        for level in reversed(range(len(self.levels))):
            turn = np.flatnonzero(top >= level)
            while len(turn):
                equal, n = self._try(level, i[turn], j[turn], back)
                turn, n = turn[equal], n[equal]
                i[turn] += sign * n
                j[turn] += sign * n
        return sign * (i - start)


# ---------------------------------------------------------------- candidates and runs


def _cells(words: np.ndarray, longest: np.ndarray, least: int, times: int) -> np.ndarray:
    """Chains (period, cell size, first cell, last cell) of neighbouring cells that may agree with the words one period on.

    A run's agreement is so long that it covers a whole cell [k * size, (k + 1) * size), size the period or least // 3. words begins
    with the longest text; longest[k] is the length of the k-th text.
    """
    bounds = np.cumsum(longest + 1) + 1
    found, held, chains = [], 0, []
    last = int(longest[0]) // times if len(longest) else 0
    for q in range(1, last + 1):
        size = max(q, least // 3)
        texts = int(np.searchsorted(-longest, -max(least, times * q), side="right"))
        end = int(bounds[texts - 1]) if texts else 0
        if end > q + size:
            at = np.flatnonzero(words[: end - q - size + 1 : size] == words[q : end - size + 1 : size])
            if len(at):
                found.append((q, size, at))
                held += len(at)
        if found and (held > HELD or q == last):
            chains.append(_thin(words, found))
            found, held = [], 0
    return np.concatenate(chains) if chains else np.zeros((0, 4), np.int64)


def _thin(words: np.ndarray, found: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    n = [len(x) for _, _, x in found]
    period, size, cell = np.repeat([q for q, _, _ in found], n), np.repeat([s for _, s, _ in found], n), np.concatenate([x for _, _, x in found])
    for a, b in PROBES:
        at = cell * size + np.maximum(size * a // b - 1, 0)
        good = words[at] == words[at + period]
        period, size, cell = period[good], size[good], cell[good]
    first = np.append(True, (period[1:] != period[:-1]) | (cell[1:] != cell[:-1] + 1)) if len(cell) else np.zeros(0, bool)
    last = np.append(first[1:], True) if len(cell) else first
    return np.stack([period[first], size[first], cell[first], cell[last]], axis=1).astype(np.int64)


def find_runs(ids: np.ndarray, cut: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs of the texts ids[cut[t]:cut[t + 1]], by text, start and period.

    A run is a stretch with smallest period q and at least max(least, times * q) words that no neighbouring word extends keeping q;
    times is 3 or more. Found for a multiple of its smallest period, a stretch is the same one, so the smallest period stays.
    """
    if times < 3:
        raise ValueError("runs hold their period three times at least")
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] >= least]
    words, begins = _joined(ids, cut, order)
    chains = _cells(words, size[order], least, times)
    if not len(chains):
        return np.zeros((0, 4), np.int64)
    # the grammar holds the texts with candidates only
    text = np.searchsorted(begins, chains[:, 2] * chains[:, 1], side="right") - 1
    ends = np.searchsorted(begins, (chains[:, 3] + 1) * chains[:, 1] + chains[:, 0], side="right") - 1
    held = np.zeros(len(order) + 1, bool)
    held[np.maximum(text, 0)] = held[np.minimum(ends, len(order) - 1)] = True
    for a, b in zip(text[ends > text], ends[ends > text], strict=True):
        held[max(a, 0) : b + 1] = True
    kept = np.flatnonzero(held[:-1])
    short, short_begins = _joined(ids, cut, order[kept])
    shift = np.zeros(len(order), np.int64)
    shift[kept] = begins[kept] - short_begins
    grammar = Grammar(short)
    out = []
    period, cell_size, cell, last = chains.T
    while len(period):
        at = cell * cell_size
        where = np.searchsorted(begins, at, side="right") - 1
        inside = (where >= 0) & (at < begins[where] + size[order[np.maximum(where, 0)]])
        forth = np.zeros(len(at), np.int64)
        i = (at - shift[np.maximum(where, 0)])[inside]
        j = i + period[inside]
        # a place in the next text is another text's word: a barrier lies between, so no cell across it can agree
        same = at[inside] + period[inside] <= begins[where[inside]] + size[order[where[inside]]]
        i, j, q, w = i[same], j[same], period[inside][same], where[inside][same]
        ahead, behind = grammar.extend(i, j), grammar.extend(i, j, back=True)
        forth[np.flatnonzero(inside)[same]] = ahead
        length = ahead + behind + q
        good = length >= np.maximum(least, times * q)
        out.append(np.stack([order[w], i - behind - short_begins[np.searchsorted(kept, w)], length, q], axis=1)[good])
        cell = (at + forth) // cell_size + 1
        more = cell <= last
        period, cell_size, cell, last = period[more], cell_size[more], cell[more], last[more]
    runs = np.concatenate(out)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (runs[1:, :3] != runs[:-1, :3]).any(axis=1))] if len(runs) else runs
    return runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]


def _joined(ids: np.ndarray, cut: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another in the given order, a barrier before, between and after them; and where each begins."""
    size = np.diff(cut)[order]
    begins = np.cumsum(np.append(1, size + 1))
    out = np.empty(int(size.sum()) + len(order) + 1, np.int64)
    out[begins - 1] = -1 - np.arange(len(order) + 1)
    place = np.repeat(begins[:-1] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
    source = np.repeat(cut[:-1][order] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(int(size.sum()))
    out[place] = ids[source]
    return out, begins[:-1]


def word_ids(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words and no others."""
    offsets = np.append(0, np.cumsum(ends - starts))
    letters = np.ascontiguousarray(data[~SPACE[data]])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


# ---------------------------------------------------------------- the table job


def _collapsed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray, source: np.ndarray | None) -> bytes:
    """The kept words of one text, joined by a blank; source: which word stands at each place, None for its own."""
    at = np.flatnonzero(kept)
    if not len(at):
        return b""
    if source is not None:
        raw, at = data.tobytes(), source[at]
        return b" ".join([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
    edge = np.zeros(len(data) + 1, np.int8)
    edge[starts[at]] += 1
    edge[ends[at]] -= 1
    taken = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = data.copy()
    out[ends[at[:-1]]] = 0x20
    taken[ends[at[:-1]]] = True
    return out[taken].tobytes()


def _report(ids: list, column: pa.Array, rewrite: Rewrite | None) -> dict[str, list]:
    out = {f.name: [] for f in REPORT}
    data, offsets = text_buffers(column)
    for a, b in steps(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, cut = words_of(part, at)
        number, n_words = word_ids(part, starts, ends), np.diff(cut)
        sources = {}
        for t, n in enumerate(n_words.tolist()):
            if rewrite is not None and n and (found := rewrite(ids[a + t], n)) is not None:
                source = np.arange(n)
                source[found[0] :] = found[0] + (source[found[0] :] - found[0]) % found[1]
                sources[t] = source
        plain = number
        if sources:
            plain = number.copy()
            for t, source in sources.items():
                plain[cut[t] : cut[t + 1]] = number[cut[t] + source]
        runs = find_runs(plain, cut)
        edge = np.zeros(len(number) + 1, np.int32)
        begin = cut[runs[:, 0]] + runs[:, 1]
        np.add.at(edge, begin + runs[:, 3], 1)
        np.add.at(edge, begin + runs[:, 2], -1)
        kept = np.cumsum(edge[:-1]) == 0
        of = np.searchsorted(runs[:, 0], np.arange(b - a + 1))
        for t in range(b - a):
            mine = [tuple(r) for r in runs[of[t] : of[t + 1], 1:].tolist()]
            best = max(mine, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
            lo, hi = cut[t], cut[t + 1]
            text = _collapsed(part[at[t] : at[t + 1]], starts[lo:hi] - at[t], ends[lo:hi] - at[t], kept[lo:hi], sources.get(t))
            row = (len(mine), *best, 1000 * best[1] // best[2] if mine else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest(), hashlib.sha256(text).hexdigest(), [dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rewrite: Rewrite | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs (its columns in `carry`, all if None) with the struct `periodic`: every run of the whole text, the number of runs, the run of
    greatest length by period (ties: smallest start, then period; null without runs), and checksums of the list of runs and of the
    text's words without what each run repeats, joined by single blanks.

    rewrite(id, number of words) may give (a, p): from word a on, the text counts as its words a to a + p - 1 over and over. Each row is
    looked at by itself: no shuffle, repeated rows and ids give their rows each, and an executor's loss repeats its tasks alone. Null and
    empty texts and those without words have no runs and the checksum of no bytes; null ids are passed on. An empty table gives no rows; a
    column named `periodic` is replaced. Words are compared by their bytes, with no hash. A task holds an Arrow batch and works on 2 MB of
    text at a time, on a longer text by itself.
    """
    carried = [c for c in (docs.columns if carry is None else carry) if c != "periodic"]
    schema = T.StructType([docs.schema[c] for c in carried] + [T.StructField("periodic", REPORT)])
    names = [f"c{i}" for i in range(len(carried))]
    slim = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in zip(carried, names, strict=True)], docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("text"))
    arrow = pa.struct([pa.field(f.name, pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names])) if f.name == "runs" else pa.string() if f.name.endswith("sha256") else pa.int64()) for f in REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _report(batch.column("id").to_pylist(), batch.column("text"), rewrite)
            report = pa.StructArray.from_arrays([pa.array(found[f.name], f.type) for f in arrow], fields=list(arrow))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), report], names=[*names, "periodic"])

    out = T.StructType([T.StructField(n, f.dataType) for n, f in zip([*names, "periodic"], schema, strict=True)])
    return small_batches(slim).mapInArrow(run, out).toDF(*schema.names)
