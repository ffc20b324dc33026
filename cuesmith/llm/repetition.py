"""Quality rules from repetition coverage: rolling n-gram hashes in numpy, and the characters that repeated n-grams and lines cover."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuesmith.llm.common import BYTE, SPACE, U64, mix, small_batches, span_hashes, steps, text_buffers, window_hashes, words_of

#: n-gram length in words: the largest share of the word characters that repeated n-grams (first ones not counted) may cover.
NGRAM_LIMITS: Mapping[int, float] = {5: 0.30, 6: 0.28, 8: 0.25, 10: 0.22}
#: The largest share of lines, and of their characters, that may equal earlier lines; short texts of three or four lines repeat one harmlessly.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.50, 0.25
MIN_WORDS, BASE_WINDOW, BASE_PERCENT = 20, 8, 30

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True

REPORT = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    + [T.StructField(n, T.DoubleType()) for n in ("dup_ngram_chars", "dup_lines", "dup_line_chars")]
)


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more; is it found earlier."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice, later = np.zeros(len(k), bool), np.zeros(len(k), bool)
    twice[order] = same[:-1] | same[1:]
    later[order] = same[:-1]
    return twice, later


def _covered(at: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size positions lie in [i, i + n) for an i in at."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + n, size), -1)
    return np.cumsum(edge[:-1]) > 0


def _per_row(flags: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[cut[1:]] - total[cut[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, ngrams: Mapping[int, float] = NGRAM_LIMITS) -> dict[str, np.ndarray]:
    """The report's columns for the texts data[offsets[i]:offsets[i + 1]], in UTF-8."""
    n = len(offsets) - 1
    points = (data & 0xC0) != 0x80
    starts, ends, cut = words_of(data, offsets)
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum(points, out=chars[1:])
    length = chars[ends] - chars[starts]
    out = {"n_words": np.diff(cut), "n_symbols": _per_row(SYMBOL[data], offsets)}
    total = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=total[1:])
    out["word_chars"] = total[cut[1:]] - total[cut[:-1]]

    row = np.repeat(np.arange(n), np.diff(cut))
    salt = mix(np.arange(1, n + 1, dtype=np.int64).astype(U64))
    h = span_hashes(data, starts, ends, BYTE)
    over = np.zeros(n, bool)
    worst = np.zeros(n)
    some = np.maximum(out["word_chars"], 1)
    for size in sorted({BASE_WINDOW, *ngrams}):
        w = window_hashes(h, size)
        at = np.flatnonzero(row[: len(w)] == row[size - 1 :]) if len(w) else np.zeros(0, np.int64)
        twice, later = _repeats(w[at] ^ salt[row[at]])
        if size == BASE_WINDOW:
            out["n_repeat_words"] = _per_row(_covered(at[twice], size, len(h)), cut)
        if size in ngrams:
            inside = np.where(_covered(at[later], size, len(h)), length, 0)
            share = _per_row(inside, cut) / some
            worst = np.maximum(worst, share)
            over |= share > ngrams[size]
    out["dup_ngram_chars"] = worst

    stops = data == 0x0A
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first[1:][stops] = True
    first = np.flatnonzero(first[:-1]) if len(data) else np.zeros(0, np.int64)
    line_row = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(data)), offsets[line_row + 1]) if len(first) else first
    last = last - ((last > first) & stops[np.maximum(last - 1, 0)]) if len(first) else first
    word_bytes = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~SPACE[data], out=word_bytes[1:])
    has = word_bytes[last] > word_bytes[first]
    first, last, line_row = first[has], last[has], line_row[has]
    _, again = _repeats(span_hashes(data, first, last, BYTE) ^ salt[line_row])
    lines = np.bincount(line_row, minlength=n)
    width = chars[last] - chars[first]
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n).astype(np.int64)
    out["dup_lines"] = out["n_dup_lines"] / np.maximum(lines, 1)
    out["dup_line_chars"] = np.bincount(line_row[again], weights=width[again], minlength=n) / np.maximum(np.bincount(line_row, weights=width, minlength=n), 1)

    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * out["n_words"])
    out["kept"] = ~(out["base_failed"] | over | (out["dup_lines"] > LINE_LIMIT) | (out["dup_line_chars"] > LINE_CHAR_LIMIT))
    return out


def repetition_report(docs: DataFrame, text: str = "text", out: str = "repetition", ngrams: Mapping[int, float] = NGRAM_LIMITS, carry: list[str] | None = None) -> DataFrame:
    """docs (or its columns `carry` only) with a struct column `out`: the word, symbol, line and repetition counts of each whole text, and `kept`.

    One pass without a shuffle. Null and empty texts have zero counts and fail the base rule (fewer than 20 words). Rows are judged one
    by one, so repeated rows get equal reports. A column of docs that is named like `out` is replaced; all others pass through.
    Memory: texts are measured in steps of about 2 MB, a longer one by itself, which takes about 25 times its bytes.
    """
    if out in docs.columns:
        docs = docs.drop(out)
    carry = [c for c in carry if c != out] if carry is not None else docs.columns
    docs = docs.select(*dict.fromkeys([*carry, text]))
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(out, REPORT)])
    names = REPORT.names

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(batch.schema.get_field_index(text)))
            for a, b in steps(offsets):
                at = offsets[a : b + 1]
                found = measure(data[at[0] : at[-1]], at - at[0], ngrams)
                struct = pa.StructArray.from_arrays([pa.array(found[k]) for k in names], names)
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(carry)], struct], schema.names)

    return small_batches(docs).mapInArrow(report, schema)


def keep_unrepetitive(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    name = "repetition"
    while name in docs.columns:
        name += "_"
    return repetition_report(docs, text, name).where(f"`{name}`.kept").drop(name)
