"""Exact Jaccard join of word-shingle sets in the metric 1 - J.

Documents with equal sets are one class. Distances between unlike texts are all (nearly) one, so
pivots drawn from the whole table would leave every document at the border of every region. The
outer regions are therefore cells that hold all classes with a shingle in common: by the prefix
principle two sets with J >= 0.8 share one of the first 0.2 n + 1 shingles of both, in any order
of all shingles. Shingles that are frequent over the whole table come last in that order; this
only decides how large the cells are, not which links are found.

Every cell has a pivot, and the exact distance to it is computed of each member that sizes, places
of the shingle and a contracted sketch (whose distance never exceeds that of the sets) leave near
it. Members within 0.2 are linked to the pivot; linked members of one component need no more comparison among
themselves, and a cell all of whose members are in one component is done. The others are joined
again with another pivot, that of a frequent shingle with its most central member: the one with the
fewest rarer shingles before the common one, since what makes a near copy unlike others is rare. What then is left is joined pair by pair within windows: sizes within
0.8, enough shingles behind the common one, and distances to the same pivots that differ by at
most 0.2 (triangle inequality). An exact comparison of the whole sets decides every link.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from qamill.llm.common import text_batches
from qamill.llm.components import components
from qamill.session import materialise

WORDS = 5
HOT = 24              # count from which a shingle is put last in the order
HOT_SHINGLES = 1 << 19  # the most frequent ones, of which the order knows (8 bytes each)
PER_TASK = 200_000    # shingles that a block of a task proposes as frequent
CELLS = 64            # parts into which the cell of a frequent shingle is split for its first pivots
STEP = 100_000        # words hashed at a time

_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``size`` of each."""
    if len(_POWERS.get("up", ())) < size:
        size = max(1 << 16, 1 << (size - 1).bit_length())
        for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def normal(text: str | None) -> bytes:
    """A-Z lower-cased, words joined by single spaces."""
    return b" ".join(text.encode("utf-8").lower().split()) if text else b""


def shingle_set(content: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the different shingles of a normal text; with few words, of the whole."""
    if not content:
        return np.zeros(0, dtype=np.uint64)
    gaps = content.count(b" ")
    if gaps < WORDS - 1:
        pieces = [(content, None)]
    elif gaps <= STEP:
        pieces = [(content, WORDS)]
    else:
        listed = content.split()
        pieces = [(b" ".join(listed[s:s + STEP + WORDS - 1]), WORDS)
                  for s in range(0, len(listed) - WORDS + 1, STEP)]
    out = []
    for piece, words in pieces:
        letters = np.frombuffer(piece, dtype=np.uint8)
        up, down = _powers(len(letters) + 1)
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[letters] * up[:len(letters)], out=sums[1:])
        if words is None:
            starts, ends = np.array([0]), np.array([len(letters)])
        else:
            spaces = np.flatnonzero(letters == 32)
            starts = np.concatenate([[0], spaces + 1])[:len(spaces) + 2 - words]
            ends = np.concatenate([spaces, [len(letters)]])[words - 1:]
        out.append((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    tokens = _mix(np.concatenate(out) if len(out) > 1 else out[0])
    tokens.sort()
    fresh = np.ones(len(tokens), dtype=bool)
    np.not_equal(tokens[1:], tokens[:-1], out=fresh[1:])
    return tokens[fresh]


SKETCH, FINE = 64, 1024  # parts of a sketch: counts of the shingles by the last bits of their hash


def sketch(tokens: np.ndarray, parts: int = SKETCH) -> np.ndarray:
    """A contraction: two sketches differ by at most as much as their sets do, in the sum of absolute
    differences against the size of the symmetric difference. Counts stop at 255."""
    counts = np.bincount((tokens & np.uint64(parts - 1)).astype(np.int64), minlength=parts)
    return np.minimum(counts, 255).astype(np.uint8)


def set_key(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, dtype=np.uint64).view(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch["text"].to_pylist():
        yield shingle_set(normal(text))


def survey(docs: DataFrame) -> DataFrame:
    """One scan that hashes every text, with two kinds of rows.

    For every document (doc_id, h, k, n, fine, sk): hash of the raw text, key and size of its set (n = 0
    without words), a fine sketch (compressed) and a short one. And (t, c): shingles that are frequent in a block of a task, to be summed
    up. A block leaves out what it met once, or what is not among its PER_TASK most frequent (lossy
    counting): this only orders shingles.
    """

    def run(batches):
        held, size = [], 0

        def tally():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            found, n = found[n > 1], n[n > 1]
            if len(found) > PER_TASK:
                top = np.argpartition(-n, PER_TASK)[:PER_TASK]
                found, n = found[top], n[top]
            none = lambda kind: pa.nulls(len(found), kind)
            return pa.RecordBatch.from_arrays(
                [none(pa.int64()), none(pa.int64()), none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.binary()),
                 _signed(found), pa.array(n.astype(np.int64))], names=names)

        names = ["doc_id", "h", "k", "n", "fine", "sk", "t", "c"]
        for batch in text_batches(batches):
            sets = list(_texts(batch))
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["h"], pa.array([set_key(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int32()),
                 pa.array([zlib.compress(sketch(s, FINE).tobytes(), 1) for s in sets], pa.binary()),
                 pa.array([sketch(s).tobytes() for s in sets], pa.binary()), none, none], names=names)
            held += sets
            size += sum(map(len, sets))
            if size > 4_000_000:
                yield tally()
                held, size = [], 0
        if held:
            yield tally()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(
        run, "doc_id long, h long, k long, n int, fine binary, sk binary, t long, c long")


def frequent_shingles(counts: DataFrame) -> np.ndarray:
    """The most frequent shingles of (t, c), rarest first."""
    top = counts.groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT)
    rows = top.orderBy(F.desc("c"), "t").limit(HOT_SHINGLES).toArrow()
    return np.ascontiguousarray(rows["t"].to_numpy()[::-1], dtype=np.int64).view(np.uint64)


def prefixes(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(t, hot, k, n, i): the shingles, with places, by which a set can meet a linked one."""
    order = np.argsort(hot)
    shared = docs.sparkSession.sparkContext.broadcast((hot[order], order))

    def run(batches):
        names, ranks = shared.value
        seen: set[int] = set()
        for batch in text_batches(batches):
            columns = [[], [], [], [], []]
            for tokens in _texts(batch):
                n = len(tokens)
                if not n:
                    continue
                key = set_key(tokens)
                if key in seen:
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(key)
                take = n - (4 * n + 4) // 5 + 1
                if len(names):
                    at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
                    frequent = names[at] == tokens
                    last = np.nonzero(frequent)[0]
                    last = last[np.argsort(ranks[at[last]])]
                    tokens = np.concatenate([tokens[~frequent], tokens[last]])
                    is_hot = np.arange(n) >= n - len(last)
                else:
                    is_hot = np.zeros(n, dtype=bool)
                for column, values in zip(columns, (
                        tokens[:take], is_hot[:take], np.full(take, key, dtype=np.int64),
                        np.full(take, n, dtype=np.int32), np.arange(take, dtype=np.int32))):
                    column.append(values)
            if columns[0]:
                t, h, k, n, i = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [_signed(t), pa.array(h), pa.array(k), pa.array(n), pa.array(i)], names=["t", "hot", "k", "n", "i"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(
        run, "t long, hot boolean, k long, n int, i int")


def near_enough(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow J >= 0.8, with the hashes of one text of either side.

    With J >= 0.8 the symmetric difference is at most a ninth of the sizes' sum, and sketches
    differ by no more than it. Short sketches go first, then fine ones, which leave little but
    pairs that are linked. ``kinds`` has one row per class.
    """

    def close(column: str, parts: int, unpack, keep: list[str]):
        def run(batches):
            for whole in batches:
                for batch in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                    one, two = (np.frombuffer(b"".join(map(unpack, batch[column + x].to_pylist())), dtype=np.uint8).reshape(
                        -1, parts).astype(np.int16) for x in "ab")
                    apart = np.abs(one - two).sum(axis=1, dtype=np.int64)
                    both = batch["na"].to_numpy().astype(np.int64) + batch["nb"].to_numpy()
                    yield batch.select(keep).filter(pa.array(9 * apart <= both))
        return run

    def wide(rows: DataFrame, column: str, more: list[str]) -> DataFrame:
        for x, end in (("a", "a"), ("b", "b")):
            side = kinds.select(F.col("k").alias(end), *[F.col(c).alias(c + x) for c in (column, *more)])
            rows = rows.join(side, end)
        return rows

    rough = wide(pairs, "sk", ["n", "h"]).where("5L * na >= 4L * nb AND 5L * nb >= 4L * na").select(
        "a", "b", "ha", "hb", "na", "nb", "ska", "skb").mapInArrow(
        close("sk", SKETCH, bytes, ["a", "b", "ha", "hb", "na", "nb"]), "a long, b long, ha long, hb long, na int, nb int")
    return wide(rough, "fine", []).select("a", "b", "ha", "hb", "na", "nb", "finea", "fineb").mapInArrow(
        close("fine", FINE, zlib.decompress, ["a", "b", "ha", "hb"]), "a long, b long, ha long, hb long")


FILTER_BITS = 24


def _bit_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bit per residue of the keys, made in Spark: 2 MB whatever the data; it only saves work."""
    place = F.pmod(column, F.lit(1 << FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32)).cast("int"))
    words = keys.select(F.floor(place / 32).cast("int").alias("w"), bit.alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << FILTER_BITS - 5, dtype=np.uint32)
    bits[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return bits


def distances(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b, ha, hb) -> (a, b, inter, total): sizes of the intersection and the union of the whole sets.

    Only texts that a pair needs are moved, once and compressed, and once more per pair.
    """
    needed = pairs.select(F.explode(F.array("ha", "hb")).alias("h")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(_bit_filter(needed, "h"))

    def pack(batches):
        squeeze, bits = zstandard.ZstdCompressor(level=3), shared.value
        seen: set[int] = set()
        for batch in text_batches(batches):
            place = batch["h"].to_numpy() % (1 << FILTER_BITS)
            wanted = (bits[place >> 5] >> (place & 31).astype(np.uint32)) & 1
            keys, bodies = [], []
            for i in np.flatnonzero(wanted):
                key = batch["h"][i].as_py()
                if key not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    bodies.append(squeeze.compress(normal(batch["text"][i].as_py())))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bodies, pa.binary())], names=["h", "z"])

    def compare(batches):
        open_ = zstandard.ZstdDecompressor()
        last = (None, None)
        for batch in text_batches(batches):
            inter, total = [], []
            for b, x, y in zip(batch["b"].to_pylist(), batch["za"].to_pylist(), batch["zb"].to_pylist()):
                if last[0] != b:
                    last = (b, shingle_set(open_.decompress(y)))
                one, two = shingle_set(open_.decompress(x)), last[1]
                both = len(np.intersect1d(one, two, assume_unique=True))
                inter.append(both)
                total.append(len(one) + len(two) - both)
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], pa.array(inter, pa.int32()), pa.array(total, pa.int32())],
                names=["a", "b", "inter", "total"])

    texts = docs.select(F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    bodies = texts.where("text IS NOT NULL").mapInArrow(pack, "h long, z binary")
    bodies = materialise(bodies.join(needed, "h", "left_semi").groupBy("h").agg(F.min("z").alias("z")), "bodies")
    left = pairs.select("a", "b", "ha", "hb").join(bodies.select(F.col("h").alias("ha"), F.col("z").alias("za")), "ha")
    both = left.join(bodies.select(F.col("h").alias("hb"), F.col("z").alias("zb")), "hb")
    return both.select("a", "b", "za", "zb").mapInArrow(compare, "a long, b long, inter int, total int")


LINKED = "100 * CAST(inter AS BIGINT) >= 80 * CAST(total AS BIGINT)"


def _places_allow(nx: Column, ix: Column, ny: Column, iy: Column) -> Column:
    """Sizes and places of a common shingle that allow J >= 0.8 if it is the first common one."""
    nx, ix, ny, iy = (c.cast("long") for c in (nx, ix, ny, iy))
    return (5 * nx >= 4 * ny) & (5 * ny >= 4 * nx) & (9 * F.least(nx - ix, ny - iy) >= 4 * (nx + ny))


def _cells(rows: DataFrame) -> DataFrame:
    """Rows of cells with at least two classes, with the pivot of their part of the cell: ``p``, and
    its size and place ``pn``, ``pi``."""
    part = F.when(F.col("hot"), F.pmod("k", F.lit(CELLS))).otherwise(0).cast("int")
    cell = W.partitionBy("t", "s")
    marked = rows.withColumn("s", part).withColumn("_p", F.min(F.struct("k", "n", "i")).over(cell)).withColumn(
        "m", F.max("k").over(cell))
    return marked.where("_p.k <> m OR hot").select(
        *rows.columns, F.col("_p.k").alias("p"), F.col("_p.n").alias("pn"), F.col("_p.i").alias("pi"))


def _pivots_of_hot(cells: DataFrame) -> DataFrame:
    """(a, b): the pivots of the parts of one cell, each with the least of them."""
    parts = cells.where("hot").select("t", F.col("p").alias("a")).distinct()
    return parts.withColumn("b", F.min("a").over(W.partitionBy("t"))).where("a <> b").select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``.

    component_id is the smallest doc_id that links reach. A null or empty text, or one without
    words, has no shingles and is its own component. Equal sets are one class, however many rows
    it has; copies are never expanded into pairs. Rows without an id keep a null component unless
    a row of their component has one. An empty table gives no rows; other columns are ignored.
    """
    seen = materialise(survey(docs), "survey")
    sets = seen.where("t IS NULL").select("doc_id", "k", "n")
    kinds = materialise(seen.where("t IS NULL AND n > 0").groupBy("k").agg(
        F.min(F.struct("h", "n", "sk", "fine")).alias("r")).select("k", "r.n", "r.h", "r.sk", "r.fine"), "kinds")
    hot = frequent_shingles(seen.where("t IS NOT NULL").select("t", "c"))
    cells = materialise(_cells(prefixes(docs, hot)), "cells")
    allowed = _places_allow(F.col("n"), F.col("i"), F.col("pn"), F.col("pi"))
    pairs = cells.where((F.col("k") != F.col("p")) & allowed).select(F.col("k").alias("a"), F.col("p").alias("b"))
    pairs = materialise(near_enough(pairs.unionByName(_pivots_of_hot(cells)).distinct(), kinds), "pairs")
    known = materialise(distances(pairs, docs), "distances")
    links = known.where(LINKED).select("a", "b")
    labels = components(links)
    # distance of each member to the pivots of its cell, where it is known
    far = lambda df, name: df.select(F.col("a").alias("k"), F.col("b").alias("p"),
                                     (1 - F.col("inter") / F.col("total")).alias(name))
    own = lambda p, d: F.when(F.col("k") == F.col(p), 0.0).otherwise(F.col(d))
    active = _active(cells.drop("pn", "pi"), labels).join(far(known, "d1"), ["k", "p"], "left")
    active = active.withColumnRenamed("p", "p1").withColumn("d1", own("p1", "d1"))
    active = materialise(_second_pivots(active), "open-cells")
    if active.limit(1).count():
        more = active.where((F.col("k") != F.col("p2")) & allowed).select(F.col("k").alias("a"), F.col("p2").alias("b"))
        more = more.distinct().join(known.select("a", "b"), ["a", "b"], "left_anti")
        second = materialise(distances(materialise(near_enough(more, kinds), "pairs"), docs), "distances").unionByName(known)
        links = second.where(LINKED).select("a", "b")
        labels = components(links)
        both = _active(active.drop("label", "pn", "pi"), labels).join(
            far(second, "d2").withColumnRenamed("p", "p2"), ["k", "p2"], "left").withColumn("d2", own("p2", "d2"))
        rest = _window_pairs(both).join(second.select("a", "b"), ["a", "b"], "left_anti")
        rest = materialise(near_enough(rest, kinds), "pairs")
        if rest.limit(1).count():
            third = materialise(distances(rest, docs), "distances")
            labels = components(links.unionByName(third.where(LINKED).select("a", "b")))
    labels = labels.select(F.col("k").alias("_k"), "label")
    named = sets.join(labels, F.col("k") == F.col("_k"), "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("label", "k")).alias("c"))
    least = named.where("c IS NOT NULL").groupBy(F.col("c").alias("_c")).agg(F.min("doc_id").alias("component"))
    # documents meet their component by its key; equal texts make that key hot, so it is salted. Spark
    # sizes the components as they were before their copies, so the join must not be left to it
    salted = named.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(CELLS)).cast("int"))
    spread = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))))
    return salted.join(spread.hint("merge"), (F.col("c") == F.col("_c")) & (salted["_s"] == spread["_s"]), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _second_pivots(rows: DataFrame) -> DataFrame:
    """Rows of open cells with the second pivot ``p2``, and its size and place ``pn``, ``pi``.

    The cell of a frequent shingle, whose parts had a pivot each, gets its most central member for
    all parts; any other its largest class.
    """
    of = lambda q: F.struct(q["k"].alias("k"), q["n"].alias("n"), q["i"].alias("i"))
    best = rows.groupBy(F.col("t").alias("_t")).agg(
        F.when(F.max("hot"), of(F.min(F.struct("i", "k", "n")))).otherwise(of(F.max(F.struct("k", "n", "i")))).alias("q"))
    return rows.join(best, F.col("t") == F.col("_t")).select(
        *rows.columns, F.col("q.k").alias("p2"), F.col("q.n").alias("pn"), F.col("q.i").alias("pi"))


def _active(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows, with labels, of the cells that still hold two components."""
    named = rows.join(labels, "k", "left").withColumn("label", F.coalesce("label", "k"))
    ends = named.groupBy(F.col("t").alias("_t")).agg(F.min("label").alias("_x"), F.max("label").alias("_y")).where("_x <> _y")
    return named.join(ends.select("_t"), F.col("t") == F.col("_t"), "left_semi")


def _window_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of different components in one cell that no window rules out.

    Cells are cut by size (in steps of 5/4, with each row also standing in the next step), so a
    cell is not one task, and only sizes that may link meet.
    """
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    rows = rows.withColumn("g", step)
    low = rows.withColumn("at", F.explode(F.array("g", F.col("g") + 1))).alias("x")
    high = rows.withColumn("at", F.col("g")).alias("y")
    same_step = (F.col("x.g") < F.col("y.g")) | (F.col("x.k") < F.col("y.k"))
    near = F.lit(True)
    for p, d in (("p1", "d1"), ("p2", "d2")):
        known = (F.col(f"x.{p}") == F.col(f"y.{p}")) & F.col(f"x.{d}").isNotNull() & F.col(f"y.{d}").isNotNull()
        near = near & (~F.coalesce(known, F.lit(False)) | (F.abs(F.col(f"x.{d}") - F.col(f"y.{d}")) <= 0.2 + 1e-9))
    pairs = low.join(high, (F.col("x.t") == F.col("y.t")) & (F.col("x.at") == F.col("y.at")) & same_step
                     & (F.col("x.label") != F.col("y.label")) & near
                     & _places_allow(F.col("x.n"), F.col("x.i"), F.col("y.n"), F.col("y.i")))
    return pairs.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct()


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
rows_ AS (SELECT doc_id, unnest(sh) AS g FROM s),
sizes AS (SELECT doc_id, len(sh) AS n FROM s),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM rows_ a JOIN rows_ b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 80 * (p.n + q.n - i)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM sizes UNION SELECT e.y, r.c FROM reach r JOIN edges e ON e.x = r.doc_id WHERE r.c < e.y)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM sizes s JOIN reach r USING (doc_id) GROUP BY 1, 2
"""
