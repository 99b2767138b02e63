"""Packing of documents into sequences of at most ``window`` tokens by Karmarkar-Karp differencing.

Each document's ids, closed by an end id, are cut into full windows and a remainder, the remainder into
pieces of at most an eighth of a window. A full window is a sequence by itself. Pieces are dealt, group
by group, to k windows by multiway differencing: every piece starts as a partial partition with one
filled part; the two partitions of the largest
imbalance merge, the fuller parts of one onto the emptier parts of the other, until one is left. Its
parts are near equal. k starts at the smallest count that can hold the group, and rises while the
fullest part exceeds the window.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from embertrace.llm.common import slices, texts_of
from embertrace.llm.tokens import encoder

WINDOW = 2048
END_ID = 1
PIECE_PARTS = 8  # a remainder is cut into pieces of window / 8: small pieces balance to under 1 % of padding
GROUP_WINDOWS = 256  # windows' worth of pieces that are differenced together
GROUP_ENTRIES = 1 << 20  # pieces times windows: what differencing holds at its start, 16 bytes each
PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


def difference(sizes: list[int], k: int) -> list[int]:
    """The part of each item, for ``k`` parts, by multiway differencing."""
    # A partition: (-imbalance, tie, loads in descending order, for each load the root of its items)
    parent = list(range(len(sizes)))  # items of one part form a tree; merged parts join their roots

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    heap = []
    for i, size in enumerate(sizes):
        loads, roots = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        loads[0], roots[0] = size, i
        heap.append((-size, i, loads, roots))
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, la, ra = heapq.heappop(heap)
        _, _, lb, rb = heapq.heappop(heap)
        lb, rb = lb[::-1], rb[::-1]  # opposing imbalances meet
        for j in np.flatnonzero((ra >= 0) & (rb >= 0)):
            parent[find(int(rb[j]))] = find(int(ra[j]))
        loads, roots = la + lb, np.where(ra >= 0, ra, rb)
        order = np.argsort(-loads, kind="stable")
        loads, roots = loads[order], roots[order]
        base = loads[-1]
        heapq.heappush(heap, (int(base - loads[0]), tie, loads, roots))
        tie += 1
    number: dict[int, int] = {}
    return [number.setdefault(find(i), len(number)) for i in range(len(sizes))]


def assign(sizes: list[int], window: int = WINDOW) -> list[int]:
    """The window of each piece, none above ``window`` tokens; no window holds more than ``window`` tokens."""
    if not sizes:
        return []
    k = -(-sum(sizes) // window)
    while True:
        part = difference(sizes, k)
        if max(np.bincount(part, weights=sizes)) <= window:
            return part
        k += max(1, k // 256)


def closes(pieces: int, held: int, window: int = WINDOW) -> bool:
    """Whether a group of so many pieces and tokens is to be differenced: very small pieces fill few
    windows, but each is a partial partition."""
    return held >= GROUP_WINDOWS * window or pieces * held >= GROUP_ENTRIES * window


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text), whole texts, other columns ignored.

    A null text is empty and consists of the end id alone; repeated rows are packed each by itself;
    an empty table gives no rows. ``sequence_id`` is unique over the table: the number of the task's
    slice of the table above, the number within it below. Memory is bounded by one slice of texts and
    one group of pieces (five numbers each, and GROUP_ENTRIES while it is differenced); the work of a lost task is repeated with equal results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        small = max(1, window // PIECE_PARTS)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        def close(group: list[tuple]) -> list[tuple]:
            nonlocal sequence
            part = assign([p[2] for p in group], window)
            filled = [0] * (max(part, default=-1) + 1)
            out = []
            for piece, w in zip(group, part):
                out.append((*piece, sequence + w, filled[w]))
                filled[w] += piece[2]
            sequence += len(filled)
            return out

        for part in slices(batches):
            full = []
            for doc, ids in zip(part.column(0).to_pylist(), coder.encode(texts_of(part))):
                ids += end
                n = len(ids) // 4
                whole = n // window * window
                for start in range(0, whole, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    full.append((doc, start, window, zlib.crc32(piece), n, sequence, 0))
                    sequence += 1
                for start in range(whole, n, small):
                    piece = ids[4 * start : 4 * (start + small)]
                    waiting.append((doc, start, len(piece) // 4, zlib.crc32(piece), n))
                    held += len(piece) // 4
                    if closes(len(waiting), held, window):
                        full += close(waiting)
                        waiting, held = [], 0
            yield rows(full)
        yield rows(close(waiting))

    names = [c.split()[0] for c in PIECES.split(", ")]
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
