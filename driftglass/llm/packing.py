"""Packing documents into fixed windows: shallow combinations, non-negative least squares, greedy residuals.

Every document becomes whole windows plus one remainder shorter than a window. Remainders are packed run by run
(a run: documents of one task until ``run_tokens`` ids are gathered, which bounds memory and needs no shuffle):

1. the remainders' lengths form a histogram over ``BINS`` classes of length;
2. all combinations of up to three classes whose sum fills a window are enumerated, and a non-negative least squares
   fit finds how often to repeat each so that the histogram is used up;
3. the counts are rounded down and the combinations filled with remainders; classes round lengths up, so a small gap
   stays in each window;
4. the rest is packed greedily, longest first: it fills those gaps and then new windows, cutting a document where a
   window is full. Where the rest is smaller than the gaps, the loosest windows are taken apart again to fill the
   others. What doesn't fill a window waits for the next run; at the end of a task it is cut into powers of two, so
   that no padding remains.

Defined cases: null and empty texts consist of the end id alone; a null doc_id is carried as null; repeated rows are
packed each on its own; very long texts are encoded one at a time and fill whole windows, of remainders of equal length any may come first; an empty table gives no rows; other columns are not read. Sequence ids are unique: the
partition's number in the upper bits, a counter in the lower 33.
"""

from __future__ import annotations

import zlib
from functools import cache
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from driftglass.llm.tokens import DEFAULT, broadcast_vocabulary, worker_encoder

BINS = 64
DEPTH = 3


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Non-negative least squares min |ax - b| by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, target = a.T @ a, a.T @ b
    tolerance = 1e-9 * max(1.0, np.abs(target).max(initial=0.0))
    for _ in range(rounds):
        gradient = target - gram @ x
        gradient[active] = -np.inf
        enter = int(gradient.argmax())
        if gradient[enter] <= tolerance:
            break
        active[enter] = True
        while True:
            own = np.flatnonzero(active)
            trial = np.linalg.lstsq(gram[np.ix_(own, own)], target[own], rcond=None)[0]
            if trial.min() > 0:
                x[:] = 0
                x[own] = trial
                break
            down = trial <= 0
            step = np.min(x[own][down] / np.maximum(x[own][down] - trial[down], 1e-300))
            x[own] += step * (trial - x[own])
            gone = own[(x[own] <= 1e-12) & down]
            x[gone] = 0
            active[gone] = False
            if not len(gone):
                break
    return x


@cache
def combinations(bins: int = BINS, depth: int = DEPTH) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """All multisets of 2..depth classes (1..bins) that sum to ``bins``, as columns of a count matrix."""
    found = [c for k in range(2, depth + 1) for c in combinations_with_replacement(range(1, bins), k) if sum(c) == bins]
    matrix = np.zeros((bins + 1, len(found)))
    for j, c in enumerate(found):
        for k in c:
            matrix[k, j] += 1
    return matrix, found


def pack_run(pieces: list[tuple[int, int, int]], window: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Steps 1 to 4 on pieces (document, start, length) shorter than a window: full windows, and less than one window left."""
    width = window / BINS
    piles: list[list[tuple[int, int, int]]] = [[] for _ in range(BINS + 1)]
    for p in sorted(pieces, key=lambda p: p[2]):
        piles[min(BINS, int(np.ceil(p[2] / width)))].append(p)
    matrix, found = combinations()
    repeats = np.floor(nnls(matrix, np.array([len(p) for p in piles], float)) + 1e-6).astype(int)
    windows = [[piles[k].pop() for k in found[j]] for j in np.flatnonzero(repeats) for _ in range(repeats[j]) if all(len(piles[k]) >= found[j].count(k) for k in found[j])]
    rest = [p for pile in piles for p in pile]
    gap = lambda w: window - sum(p[2] for p in w)
    windows.sort(key=gap)
    short = sum(map(gap, windows)) - sum(p[2] for p in rest)
    while short > 0 and windows:
        loose = windows.pop()
        short -= window
        rest += loose
    rest.sort(key=lambda p: p[2])
    for w in windows:
        room = gap(w)
        while room and rest:
            doc, start, n = rest.pop()
            take = min(n, room)
            w.append((doc, start, take))
            room -= take
            if take < n:
                rest.append((doc, start + take, n - take))
    while sum(p[2] for p in rest) >= window:
        own, room = [], window
        while room:
            doc, start, n = rest.pop()
            take = min(n, room)
            own.append((doc, start, take))
            room -= take
            if take < n:
                rest.append((doc, start + take, n - take))
        windows.append(own)
    return windows, rest


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Sequences whose sizes are powers of two, largest first, that hold the pieces without padding."""
    todo, out = list(reversed(pieces)), []
    total = sum(p[2] for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            doc, start, n = todo.pop()
            take = min(n, room)
            own.append((doc, start, take))
            room -= take
            if take < n:
                todo.append((doc, start + take, n - take))
        out.append(own)
    return out


def pack(docs: DataFrame, window: int = 1024, vocabulary: str = DEFAULT, end_id: int = 0, run_tokens: int = 3_000_000) -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``, ``offset``."""
    content = broadcast_vocabulary(docs.sparkSession, vocabulary)
    names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([(n, pa.binary() if n == "ids" else pa.int64()) for n in names])
    end = np.array([end_id], "<u4")

    def run(batches):
        encode = worker_encoder(content.value)
        base, sequence = TaskContext.get().partitionId() << 33, 0
        ids: dict[int, np.ndarray] = {}
        names_of: dict[int, int | None] = {}
        pieces, rows, gathered, number = [], [], 0, 0

        def place(w):
            nonlocal sequence
            offset = 0
            for doc, start, n in w:
                own = ids[doc]
                rows.append((names_of[doc], start, n, own[start : start + n].tobytes(), len(own), base + sequence, offset))
                offset += n
            sequence += 1

        def flush(last):
            nonlocal pieces, rows, gathered, ids, names_of
            windows, pieces = pack_run(pieces, window)
            for w in windows + (powers_of_two(pieces) if last else []):
                place(w)
            if last:
                pieces = []
            waiting = {p[0] for p in pieces}
            ids, names_of = {d: ids[d] for d in waiting}, {d: names_of[d] for d in waiting}
            gathered = 0
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 4096], strict=True), schema.types, strict=True)], schema=schema)
            rows = []

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.concatenate([encode(text.as_py()).astype("<u4", copy=False), end])
                ids[number], names_of[number] = own, doc_id
                n = len(own)
                for start in range(0, n - window + 1, window):
                    place([(number, start, window)])
                if n % window:
                    pieces.append((number, n - n % window, n % window))
                gathered += n
                number += 1
                if gathered >= run_tokens:
                    yield from flush(False)
        yield from flush(True)

    ddl = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
