"""Packing by minimum bin slack: a bitset subset-sum picks the pieces that fill each window closest to its capacity."""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cuesmith.llm.common import BYTE, STEP, small_batches, span_hashes, steps, text_buffers, words_of

#: Pieces that wait for a window; the pool is packed down to half of it when it is full.
POOL = 4096
#: Ids in one batch of the result.
BATCH_IDS = 1 << 19
#: Words whose ids a worker remembers before it starts anew.
REMEMBERED = 1_500_000
#: New words that are encoded in one call.
CHUNK = 2_000

#: Marks that end a word and that the vocabulary's splitter always parts from an ASCII letter before them.
TAIL = np.zeros(256, bool)
TAIL[list(b".,;:!?")] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = True
LOWER_CODES = BYTE[[c + 32 if ord("A") <= c <= ord("Z") else c for c in range(256)]]


class WordEncoder:
    """Ids of many texts by a tokenizers file whose words never join over white space: each different word is encoded once.

    Words are looked up by a 64-bit hash of their bytes (ASCII letters lower-cased where the file does so); the ids of a word are
    those that the file gives for it alone. A word that ends in marks after an ASCII letter counts as two.
    """

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.first, self.pool, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.uint32), 0

    def _learn(self, hashes: list[int], words: list[str]) -> None:
        size = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.cumsum(size + 1) - size - 1  # of each word in all of them joined by blanks
        encoded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        ids = np.array(encoded.ids, np.uint32)
        owner = np.searchsorted(begins, np.fromiter((a for a, _ in encoded.offsets), np.int64, len(ids)), side="right") - 1
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first = np.append(self.first, self.used + np.cumsum(np.bincount(owner, minlength=len(words))))
        self.used += len(ids)
        n = len(self.place)
        self.place.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and the offset of each text among them."""
        starts, ends, cut = words_of(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        core = ends.copy()
        for _ in range(3):
            core -= (core - starts > 1) & TAIL[data[core - 1]]
        core = np.where(LETTER[data[core - 1]], core, ends)
        split = core < ends
        # a word with a tail becomes two units
        slot = np.arange(len(starts)) + np.cumsum(split) - split
        n = len(starts) + int(split.sum())
        s, e = np.empty(n, np.int64), np.empty(n, np.int64)
        s[slot], e[slot] = starts, core
        s[slot[split] + 1], e[slot[split] + 1] = core[split], ends[split]
        units, one, back = np.unique(span_hashes(data, s, e, LOWER_CODES), return_index=True, return_inverse=True)
        keys = units.tolist()
        if len(self.place) + len(keys) > REMEMBERED:
            self.forget()
        at = list(map(self.place.get, keys))
        new = [i for i, p in enumerate(at) if p is None]
        if new:
            known = len(self.place)
            raw = data.tobytes()
            words = [raw[a:b].decode() for a, b in zip(s[one[new]].tolist(), e[one[new]].tolist(), strict=True)]
            for i in range(0, len(new), CHUNK):
                self._learn([keys[j] for j in new[i : i + CHUNK]], words[i : i + CHUNK])
            for place, i in enumerate(new, known):
                at[i] = place
        at = np.array(at, np.int64)[back]
        first = self.first[at]
        size = self.first[at + 1] - first
        stop = np.cumsum(size)
        ids = self.pool[np.repeat(first - (stop - size), size) + np.arange(stop[-1])]
        total = np.append(0, stop)
        unit_cut = np.append(slot, n)[cut]
        return ids, total[unit_cut]


def fullest(counts: Counter, room: int) -> list[tuple[int, int]]:
    """Lengths and how many of each (at most counts[length]) whose sum is as close to room as any choice comes without passing it.

    One bit for each sum that can be reached; a length's copies join in runs of 1, 2, 4, ... The walk back over the kept bitsets
    gives the counts. It stops early once room itself can be reached.
    """
    mask, reached, layers = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, run = min(counts[length], room // length), 1
        while left:
            take = min(run, left)
            layers.append((reached, length, take))
            reached |= (reached << (length * take)) & mask
            left, run = left - take, run * 2
        if reached >> room & 1:
            break
    total, out = reached.bit_length() - 1, Counter()
    for before, length, take in reversed(layers):
        if not before >> total & 1:
            total -= length * take
            out[length] += take
    return list(out.items())


class Packer:
    """Windows of `capacity` from a bounded pool of pieces; the largest waiting piece opens each window."""

    def __init__(self, capacity: int, pool: int = POOL):
        self.capacity, self.most = capacity, pool
        self.waiting: dict[int, list] = {}
        self.counts: Counter = Counter()
        self.largest: list[int] = []
        self.n = 0

    def add(self, length: int, piece) -> None:
        if not self.counts[length]:
            heapq.heappush(self.largest, -length)
        self.waiting.setdefault(length, []).append(piece)
        self.counts[length] += 1
        self.n += 1

    def _take(self, length: int):
        self.counts[length] -= 1
        if not self.counts[length]:
            del self.counts[length]
        self.n -= 1
        return self.waiting[length].pop()

    def windows(self, down_to: int) -> Iterator[list]:
        while self.n > down_to:
            while -self.largest[0] not in self.counts:
                heapq.heappop(self.largest)
            opener = -self.largest[0]
            found = [self._take(opener)]
            for length, n in fullest(self.counts, self.capacity - opener):
                found += [self._take(length) for _ in range(n)]
            yield found


PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text: str = "text", with_ids: bool = True, pool: int = POOL) -> DataFrame:
    """One row per piece of a document's ids (text's ids, then end_id): where it lies in which sequence; with_ids adds the ids.

    One pass without a shuffle: each split of the input fills windows from its own pool of at most `pool` pieces, so memory is bounded
    by pool * capacity ids. Documents longer than a window give whole windows first and their rest to the pool. A split leaves at most
    its last windows short. sequence_id is the split's number * 2**33 plus a count, so reruns over the same splits agree.
    Null and empty texts are end_id alone; a null doc_id stays null; repeated rows are packed as often as they come; other columns of
    docs aren't read. An empty table gives no rows.
    """
    schema = T.StructType([*PIECE.fields, *[T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder(tokenizer), Packer(capacity, pool)
        sequence, rows, held = TaskContext.get().partitionId() << 33, [], 0

        def put(window: list) -> None:
            nonlocal sequence, held
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset, *[ids] * with_ids))
                offset += len(ids)
            sequence, held = sequence + 1, held + offset

        def full() -> bool:
            return held >= BATCH_IDS or len(rows) >= POOL

        def out() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*rows, strict=True))
            rows.clear()
            held = 0
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                cut = np.append(0, np.cumsum(columns[2])).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(columns[7]).astype(np.int32))))
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            names = batch.column(0).to_pylist()
            data, offsets = text_buffers(batch.column(1))
            for a, b in steps(offsets, 3 * STEP // 2):
                at = offsets[a : b + 1]
                ids, cut = encoder.encode(data[at[0] : at[-1]], at - at[0])
                for i in range(b - a):
                    own = np.append(ids[cut[i] : cut[i + 1]], np.uint32(end_id)).astype("<u4")
                    whole = len(own) - len(own) % capacity
                    for start in range(0, whole, capacity):
                        put([(names[a + i], start, own[start : start + capacity], len(own))])
                        if full():
                            yield out()
                    if whole < len(own):
                        # a copy: a view would keep all of a long document's ids
                        packer.add(len(own) - whole, (names[a + i], whole, own[whole:].copy(), len(own)))
                    if packer.n >= packer.most:
                        for window in packer.windows(packer.most // 2):
                            put(window)
                            if full():
                                yield out()
        for window in packer.windows(0):
            put(window)
            if full():
                yield out()
        if rows:
            yield out()

    return small_batches(docs).select(id_col, text).mapInArrow(run, schema)
