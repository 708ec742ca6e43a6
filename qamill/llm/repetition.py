"""Periodic runs of words, found by block convolution.

A run has a smallest period q and at least 4 q words. At scale L (1, 2, 4, …) periods from L to
2 L - 1 are sought: any run with such a period holds whole aligned blocks of L words, and each is
repeated q words on. The sums of squared differences of every block with the window that follows it,
at L offsets, come from one exact number-theoretic convolution; offsets of sum 0 are the block's
repeats. Blocks in a row with the same distance are a seed; fewer than L words are left to compare on
each side of it. Words are compared by number; the convolution sees them folded into a small range,
so that its sums stay below the prime, and a seed is checked on the real numbers before it counts.
Texts are worked on a batch at a time, one after the other in one array, so short texts cost no more
than long ones; the array shrinks to the texts long enough as the scale grows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qamill.llm import transform

LEAST = 6            # words of the shortest run
TIMES = 4            # and periods
ROWS_AT_ONCE = 1 << 20   # numbers in a piece of the convolution
BATCH_WORDS = 1 << 18    # words of texts that are worked on together (one text may have more)

Runs = list[tuple[int, int, int]]  # start, length, period


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _seeds(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(block number, distance) of the blocks of ``size`` words that occur again ``size`` to 2 ``size`` - 1 words on."""
    count = len(ids) // size - 2
    span = max(2, isqrt((transform.prime_for(2 * size) - 1) // size))
    folded = ((ids * 0x9E3779B1 & 0xFFFFFFFF) * span >> 32).astype(np.float64)
    blocks = folded[:(count + 2) * size].reshape(count + 2, size)
    step = max(1, ROWS_AT_ONCE // (2 * size))
    at, far = [], []
    for i in range(0, count, step):
        n = min(step, count - i)
        windows = np.concatenate([blocks[i + 1:i + 1 + n], blocks[i + 2:i + 2 + n]], axis=1)
        row, offset = np.nonzero(transform.distances(blocks[i:i + n], windows) == 0)
        at.append(row + i)
        far.append(offset + size)
    return np.concatenate(at), np.concatenate(far)


def _checked(ids: np.ndarray, at: np.ndarray, far: np.ndarray, size: int) -> np.ndarray:
    """Which seeds are real."""
    fine = np.zeros(len(at), dtype=bool)
    step = max(1, ROWS_AT_ONCE // size)
    for i in range(0, len(at), step):
        where = at[i:i + step, None] * size + np.arange(size)
        fine[i:i + step] = (ids[where] == ids[where + far[i:i + step, None]]).all(axis=1)
    return fine


def _reach(ids: np.ndarray, start: np.ndarray, far: np.ndarray, size: int, step: int) -> np.ndarray:
    """How many words from ``start`` on, going by ``step`` (1 or -1), equal those ``far`` on; ``size`` at most."""
    out = np.zeros(len(start), dtype=np.int64)
    rows = max(1, ROWS_AT_ONCE // size)
    walk = np.arange(size) * step
    last = len(ids) - 1
    for i in range(0, len(start), rows):
        here = start[i:i + rows, None] + walk
        there = here + far[i:i + rows, None]
        same = (here >= 0) & (there <= last)
        same &= ids[np.clip(here, 0, last)] == ids[np.clip(there, 0, last)]
        out[i:i + rows] = np.where(same.all(axis=1), size, same.argmin(axis=1))
    return out


def _outside(at: np.ndarray, far: np.ndarray, size: int, known: Runs) -> np.ndarray:
    """Seeds not explained by a known run, whose period divides their distance.

    At small scales, where runs may be many and seeds are cheap, only long runs are asked.
    """
    keep = np.ones(len(at), dtype=bool)
    for start, length, period in known:
        if length >= (16 if size < 64 else 2) * size:
            low, high = np.searchsorted(at, [-(-start // size), (start + length) // size])
            inside = (at[low:high] * size + far[low:high] + size <= start + length) & (far[low:high] % period == 0)
            keep[low:high] &= ~inside
    return keep


def runs_in(ids: np.ndarray, longest: Callable[[int], int]) -> Runs:
    """All runs of an array of word numbers, by start, then period.

    ``longest(n)`` is how many leading words belong to texts of n words or more (texts come longest
    first and have a number of their own between them).
    """
    found: dict[tuple[int, int], int] = {}
    size = 1
    while (n := longest(TIMES * size)) >= TIMES * size:
        # what follows is the next text's separator or numbers of the padding: none equals another
        part = np.concatenate([ids[:n], -(1 << 40) - np.arange(3 * size + (-n) % size)])
        at, far = _seeds(part, size)
        known = [(s, e - s, q) for (s, e), q in found.items()]
        keep = _outside(at, far, size, known)
        at, far = at[keep], far[keep]
        keep = _checked(part, at, far, size)
        at, far = at[keep], far[keep]
        order = np.lexsort((at, far))
        at, far = at[order], far[order]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (far[1:] != far[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[:len(first)] - 1
        head, tail, gap = at[first] * size, (at[last] + 1) * size, far[first]
        head = head - _reach(part, head - 1, gap, size, -1)
        tail = tail + _reach(part, tail, gap, size, 1) + gap
        good = tail - head >= np.maximum(LEAST, TIMES * gap)
        for s, e, q in zip(head[good].tolist(), tail[good].tolist(), gap[good].tolist()):
            if q < found.get((s, e), q + 1):  # the smallest period of a stretch counts
                found[s, e] = q
        size *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(texts: list[list[bytes]]) -> list[Runs]:
    """The runs of each text (a list of words), by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: dict[bytes, int] = {}
    sizes = [len(texts[i]) for i in order]
    starts = np.cumsum([0] + [n + 1 for n in sizes])
    ids = np.empty(int(starts[-1]), dtype=np.int64)
    for k, i in enumerate(order):
        ids[starts[k]:starts[k] + sizes[k]] = [numbers.setdefault(w, len(numbers)) for w in texts[i]]
        ids[starts[k + 1] - 1] = -1 - k
    falling = -np.array(sizes, dtype=np.int64)
    found = runs_in(ids, lambda n: int(starts[np.searchsorted(falling, -n, side="right")]))
    out: list[Runs] = [[] for _ in texts]
    owner = np.searchsorted(starts, [r[0] for r in found], side="right") - 1
    for k, (start, length, period) in zip(owner.tolist(), found):
        out[order[k]].append((start - int(starts[k]), length, period))
    return out


def strongest(runs: Runs) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, compared exactly; then smallest start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words without those that some run has after its first period."""
    out, done = [], 0
    for low, high in sorted((s + q, s + n) for s, n, q in runs):
        if high > done:
            out += words[done:max(low, done)]
            done = high
    return out + words[done:]


Words = Callable[[object, str | None], list[bytes]]


def _groups(rows: Iterator[tuple], words: Words) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Rows with their words, as many together as BATCH_WORDS allows."""
    held, size = [], 0
    for key, text in rows:
        mine = words(key, text)
        if held and size + len(mine) > BATCH_WORDS:
            yield held
            held, size = [], 0
        held.append((key, mine))
        size += len(mine)
    if held:
        yield held


def _per_text(docs: DataFrame, id_col: str, words: Words, schema: str, fields: pa.Schema, describe) -> DataFrame:
    """One row per document from its words and their runs; partitions are read a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            rows = ((keys[i].as_py(), texts[i].as_py()) for i in range(len(texts)))
            kind = pa.schema([pa.field(id_col, keys.type), *fields])
            for group in _groups(rows, words):
                found = runs_of([w for _, w in group])
                out = [{id_col: key, **describe(mine, runs)} for (key, mine), runs in zip(group, found)]
                yield pa.RecordBatch.from_pylist(out, schema=kind)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, {schema}")


def plain(key: object, text: str | None) -> list[bytes]:
    return words_of(text)


def find_runs(docs: DataFrame, id_col: str = "doc_id", words: Words = plain) -> DataFrame:
    """(id, runs, collapsed): every periodic run of each whole text, and the text with each run cut to one period.

    A run is a stretch of words with smallest period q, of at least max(6, 4 q) words, that no
    neighbour extends. Runs come by start, then period, as (start, length, period) in words. Null,
    empty and blank texts have no run and an empty collapsed text; repeated rows and ids come out as
    often as they go in; other columns are ignored.
    """
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def describe(mine: list[bytes], runs: Runs) -> dict:
        rows = [dict(zip(("start", "length", "period"), r)) for r in runs]
        return {"runs": rows, "collapsed": b" ".join(collapsed(mine, runs)).decode("utf-8", "surrogatepass")}

    return _per_text(docs, id_col, words, "runs array<struct<start:long,length:long,period:long>>, collapsed string",
                     pa.schema([("runs", pa.list_(item)), ("collapsed", pa.string())]), describe)


def planted(doc_id: int | None, text: str | None) -> list[bytes]:
    """The words of a text; for one id in ten a tail of them repeats with a period that the id gives.

    A null id plants nothing.
    """
    words = words_of(text)
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 over ``planted`` words.

    The four numbers are those of the strongest run, null without runs; see ``find_runs`` for the rest.
    """
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    texts = ("runs_sha256", "collapsed_sha256")

    def describe(mine: list[bytes], runs: Runs) -> dict:
        best = strongest(runs)
        start, length, period = best or (None, None, None)
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return {"n_runs": len(runs), "start": start, "length": length, "period": period,
                "exponent_milli": 1000 * length // period if best else None,
                "runs_sha256": hashlib.sha256(listed.encode()).hexdigest(),
                "collapsed_sha256": hashlib.sha256(b" ".join(collapsed(mine, runs))).hexdigest()}

    schema = ", ".join([f"{c} long" for c in longs] + [f"{c} string" for c in texts])
    fields = pa.schema([(c, pa.int64()) for c in longs] + [(c, pa.string()) for c in texts])
    return _per_text(docs, "doc_id", planted, schema, fields, describe)
