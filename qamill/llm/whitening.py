"""Whitening of embeddings by exact second moments and the characteristic polynomial.

Three passes over the table: sums and products of the quantised vectors, exact, added up in tasks
and then in groups of tasks; the covariance of the whitened vectors, as a measured check; the
whitened vectors themselves. Only a matrix of dimension x dimension ever reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qamill.llm import charpoly

STEP = 64.0           # parts of a unit that a component is cut into
SHIFT = 1_000_000     # what is added to the number of parts
COMPONENTS = 32
GROUPS = 64           # partial sums are added up in so many groups before the driver sees them
LIMB = 1 << 20        # products of two limbs, 4096 of them, are exact as doubles
ROWS = 4096


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): rows whose vector is not null and holds finite numbers only; a null id stays."""
    v = F.col(vector_col).cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    return rows.where(F.col("v").isNotNull() & F.forall("v", fine))


def quantised(lists: pa.Array, width: int) -> np.ndarray:
    """floor(64 c) of a column of vectors, rows x width: longs, or Python integers where these are too small.

    The shift is left out: it changes no difference of two entries.
    """
    x = np.floor(STEP * np.asarray(lists.flatten(), dtype=np.float64)).reshape(-1, width)
    if x.size and np.abs(x).max() >= 2.0**62:
        return np.array([[int(c) for c in row] for row in x], dtype=object).reshape(-1, width)
    return x.astype(np.int64)


def products(x: np.ndarray) -> np.ndarray:
    """x'x in whole numbers of any size, by doubles that stay below 2^53."""
    width = x.shape[1]
    out = np.zeros((width, width), dtype=object)
    for start in range(0, len(x), ROWS):
        rest, limbs = x[start:start + ROWS], []
        while True:
            low = rest if not rest.size or np.abs(rest).max() < LIMB else rest % LIMB
            limbs.append(low.astype(np.float64))
            if low is rest:
                break
            rest = (rest - low) // LIMB
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                out += (a.T @ b).astype(np.int64).astype(object) * LIMB ** (i + j)
    return out


def _text(n: int, sums: np.ndarray, pairs: np.ndarray) -> str:
    return " ".join(map(str, [n, *sums.tolist(), *pairs[np.triu_indices(len(sums))].tolist()]))


@dataclass
class Moments:
    """Number of rows, sums and products (upper triangle as a full matrix) of the quantised vectors."""

    n: int
    sums: list[int]
    pairs: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n^2 times the covariance, in whole numbers."""
        d = range(len(self.sums))
        return [[self.n * self.pairs[i][j] - self.sums[i] * self.sums[j] for j in d] for i in d]


def dimension(rows: DataFrame) -> int:
    """The commonest length of the vectors, the longer one on ties; 0 without rows."""
    counts = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.agg(F.max_by("d", F.struct("n", "d")).alias("d")).first()["d"]
    return best or 0


def moments(rows: DataFrame, width: int) -> Moments:
    """Exact sums over rows (id, v) of vectors of ``width`` entries."""
    upper = width * (width + 1) // 2

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, sums, pairs = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for batch in batches:
            x = quantised(batch.column(0), width)
            n, sums, pairs = n + len(x), sums + x.astype(object).sum(axis=0), pairs + products(x)
        if n:
            yield pa.RecordBatch.from_pydict({"g": [TaskContext.get().partitionId() % GROUPS], "m": [_text(n, sums, pairs)]})

    def add(texts) -> str:
        total = np.zeros(1 + width + upper, dtype=object)
        for text in texts:
            total += np.array([int(x) for x in text.split(" ")], dtype=object)
        return " ".join(map(str, total))

    def per_group(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"m": [add(t for b in batches for t in b.column(1).to_pylist())]})

    partial = rows.select("v").mapInArrow(per_task, "g long, m string")
    found = partial.groupBy("g").applyInArrow(per_group, "m string").toArrow()["m"].to_pylist()
    total = [int(x) for x in add(found).split(" ")]
    pairs = np.zeros((width, width), dtype=object)
    pairs[np.triu_indices(width)] = total[1 + width:]
    pairs = pairs + np.triu(pairs, 1).T
    return Moments(total[0], total[1:1 + width], pairs.tolist())


class Whitener:
    """What an executor needs: sums, and the components over the square roots of their eigenvalues."""

    def __init__(self, fit: Moments, found: list[tuple[float, list[float]]], trace: int):
        self.n, self.sums = fit.n, fit.sums
        self.whole = [(2 * s + self.n) // (2 * self.n) if self.n else 0 for s in fit.sums]
        self.rest = np.array([(s - self.n * w) / self.n for s, w in zip(fit.sums, self.whole)])
        # trace is n^2 times that of the covariance, share * trace / n^2 the eigenvalue
        scale = [math.sqrt(share) * math.sqrt(trace) / self.n for share, _ in found]
        self.explained = [share for share, _ in found]
        self.matrix = np.array([v for _, v in found]).reshape(len(found), len(fit.sums)).T / np.array(scale)

    def white(self, x: np.ndarray) -> np.ndarray:
        centred = (x - np.array(self.whole, dtype=x.dtype if max(map(abs, self.whole), default=0) < 2**62 else object)).astype(np.float64)
        return (centred - self.rest) @ self.matrix

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n x - sum)^2, exact."""
        far = int(np.abs(x).max()) if x.size else 0
        bound = self.n * far + max(map(abs, self.sums), default=0)
        kind = np.int64 if x.shape[1] * bound * bound < 2**63 else object
        apart = self.n * x.astype(kind) - np.array(self.sums, dtype=kind)
        return (apart * apart).sum(axis=1).tolist()


def _measured(rows: DataFrame, width: int, shared, k: int) -> float:
    """Largest entry of the covariance of the whitened rows less the identity."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, pairs = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            z = shared.value.white(quantised(batch.column(0), width))
            n, sums, pairs = n + len(z), sums + z.sum(axis=0), pairs + z.T @ z
        if n:
            yield pa.RecordBatch.from_pydict({"i": list(range(k + 1)), "m": [np.append(sums, n), *np.column_stack([pairs, np.zeros(k)])]})

    partial = rows.select("v").mapInArrow(per_task, "i long, m array<double>")
    flat = partial.select("i", F.posexplode("m").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    total = np.zeros((k + 1, k + 1))
    total[flat["i"].to_numpy(), flat["j"].to_numpy()] = flat["x"].to_numpy()
    n, mean = total[0, k], total[0, :k] / total[0, k]
    return float(np.abs(total[1:, :k] / n - np.outer(mean, mean) - np.eye(k)).max())


OUT = T.StructType([T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error), one row per usable vector.

    ``whitened`` and ``explained`` are arrays, one entry per component by falling eigenvalue,
    min(``components``, dimension) of them; ``deviation`` is a whole number as a string, so that none
    is too long. Null vectors and those with null or non-finite entries are dropped; so are vectors of
    another length than the commonest (the longer on ties), which have no covariance with the others.
    Repeated rows and ids each count and come out; a null id stays null; other columns are ignored.
    Components of eigenvalue 0 (constant columns, fewer rows than dimensions) have null ``whitened``
    and ``explained`` 0 (null if all are 0), and are left out of ``identity_error``, which is null if no component is left. The
    vectors of an eigenvalue that occurs more than once are any orthonormal ones. An empty table gives
    no rows. Entries of any size are exact; the polynomial's cost grows with the fourth power of the dimension.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    width = dimension(rows)
    rows = rows.where(F.size("v") == width)
    columns = ["id", F.lit(0).cast("long").alias("n"), F.lit("").alias("deviation"), F.array().cast("array<double>").alias("whitened"),
               F.array().cast("array<double>").alias("explained"), F.lit(None).cast("double").alias("identity_error")]
    if not width:  # no vectors, or none with an entry
        return rows.select(*columns).where(F.lit(False))
    fit = moments(rows, width)
    scatter = fit.scatter()
    trace = sum(scatter[i][i] for i in range(width))
    found = charpoly.leading(spark, _primitive(scatter), components)
    blank = min(components, width) - len(found)
    shared = spark.sparkContext.broadcast(Whitener(fit, found, trace))
    error = _measured(rows, width, shared, len(found)) if found else None

    def run(lists: pd.Series) -> pd.DataFrame:
        x = quantised(pa.array(lists, type=pa.list_(pa.float64())), width)
        tool = shared.value
        white = list(tool.white(x)) if len(found) else [[]] * len(x)
        return pd.DataFrame({"deviation": [str(d) for d in tool.deviation(x)], "whitened": white})

    out = rows.select("id", F.pandas_udf(run, OUT)("v").alias("w"))
    explained = [F.lit(share) for share, _ in found] + [F.lit(0.0 if trace else None).cast("double")] * blank
    nulls = F.array(*[F.lit(None).cast("double")] * blank) if blank else F.array().cast("array<double>")
    return out.select(
        "id", F.lit(fit.n).cast("long").alias("n"), "w.deviation", F.concat("w.whitened", nulls).alias("whitened"),
        F.array(*explained).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def _primitive(matrix: list[list[int]]) -> list[list[int]]:
    """The matrix over the greatest common divisor of its entries: same vectors, same shares."""
    g = math.gcd(*(x for row in matrix for x in row)) or 1
    return [[x // g for x in row] for row in matrix]


def digest_columns(white: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    ``deviation`` is null where the exact number needs more than 64 bits.
    """
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    rows = white.select("id", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "identity_error", each)
    return rows.select(
        F.col("id").alias(id_col), (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
        F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
