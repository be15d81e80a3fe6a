"""Whitening of embeddings from an exact scatter matrix that is counted bit by bit.

Vectors become integers. Each dimension's values, less the least one of a block of rows, are written as bit planes, a plane being packed
over the rows into machine words. The inner product of two dimensions is then the sum over pairs of planes of 2^(a+b) times the
number of ones in the AND of the two planes: a whole number, as are the sums. They are added as such over all tasks and centred
as integers (n * products - sum * sum), so that no digit is lost before the eigenvectors are computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import written
from .vectors import finite, matrix, of_one_length

#: Entries of a vector are counted in steps of 1 / SCALE; so many rows make a block of planes.
SCALE, BLOCK_ROWS = 256, 65_536
#: Whole numbers go through Spark in so many limbs of so many bits; the last has the sign.
LIMBS, LIMB_BITS = 6, 30
WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
            "deviation_digits string")


def _planes(shifted: np.ndarray) -> np.ndarray:
    """Bit planes (bit, dimension, word) of unsigned numbers, rows packed into 64-bit words."""
    rows, wide = shifted.shape
    bits = max(1, int(shifted.max(initial=0)).bit_length())
    out = np.zeros((bits, wide, -(-rows // 64)), np.uint64)
    columns = np.ascontiguousarray(shifted.T)
    for b in range(bits):
        packed = np.packbits((columns >> np.uint64(b)).astype(np.uint8) & 1, axis=1, bitorder="little")
        out[b].view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def scatter(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and inner products of the columns of a block of 64-bit integers, as Python integers."""
    rows, wide = block.shape
    least = block.min(axis=0)
    with np.errstate(over="ignore"):  # the difference as an unsigned number is right whatever the signs
        planes = _planes(block.astype(np.uint64) - least.astype(np.uint64))
    bits = len(planes)
    kind = np.int64 if 2 * bits + rows.bit_length() < 63 else object
    weight = np.array([1 << b for b in range(bits)], dtype=kind)
    sums = (np.bitwise_count(planes).sum(axis=2).astype(kind) * weight[:, None]).sum(axis=0).astype(object)
    products = np.zeros((wide, wide), kind)
    for i in range(wide):
        for a in range(bits):
            if planes[a, i].any():
                ones = np.bitwise_count(planes[:, i:] & planes[a, i]).sum(axis=2).astype(kind)
                products[i, i:] += (ones * (weight * (1 << a))[:, None]).sum(axis=0)
    products = products.astype(object)
    products += np.triu(products, 1).T
    least = least.astype(object)
    products += least[:, None] * sums[None] + least[None] * sums[:, None] + rows * least[:, None] * least[None]
    return sums + rows * least, products


def _limbs(at: tuple[int, int], value: int) -> Iterator[tuple[int, int, int, int]]:
    for k in range(LIMBS):
        last = k == LIMBS - 1
        part = value >> (LIMB_BITS * k) if last else (value >> (LIMB_BITS * k)) & ((1 << LIMB_BITS) - 1)
        if part:
            yield (*at, k, part)


def scatter_of(fit: DataFrame, wide: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows of ``fit`` (x), and sums and inner products of its ``wide`` dimensions.

    A task reports its totals once; they are added by Spark, and only one row per pair of dimensions and limb reaches the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(wide, object), np.zeros((wide, wide), object)
        held, size = [], 0

        def add() -> None:
            nonlocal count, sums, products
            block = np.concatenate(held)
            for at in range(0, len(block), BLOCK_ROWS):
                part = scatter(block[at : at + BLOCK_ROWS])
                sums, products = sums + part[0], products + part[1]
            count += len(block)

        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch.column("x"), wide, np.int64))
                size += batch.num_rows
                if size >= BLOCK_ROWS:
                    add()
                    held, size = [], 0
        if held:
            add()
        if count:
            out = [(-1, -1, 0, count)]
            for i in range(wide):
                out.extend(_limbs((-1, i), sums[i]))
                for j in range(i, wide):
                    out.extend(_limbs((i, j), products[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["i", "j", "k", "part"])

    parts = fit.mapInArrow(run, "i long, j long, k long, part long").groupBy("i", "j", "k").agg(F.sum("part").alias("part")).collect()
    count, sums, products = 0, np.zeros(wide, object), np.zeros((wide, wide), object)
    for r in parts:
        value = r["part"] << (LIMB_BITS * r["k"])
        if r["j"] < 0:
            count += value
        elif r["i"] < 0:
            sums[r["j"]] += value
        else:
            products[r["i"], r["j"]] += value
            if r["i"] != r["j"]:
                products[r["j"], r["i"]] += value
    return count, sums, products


def _wide_or_object(x: np.ndarray, count: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S exactly: as 64-bit integers where they fit, else as Python integers."""
    most = max((abs(int(s)) for s in sums), default=0) + count * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    if most < 1 << 62:
        return count * x - sums.astype(np.int64)
    return count * x.astype(object) - sums


class Whitening:
    """Mean and leading components of integer vectors, given by their exact count, sums and inner products."""

    def __init__(self, count: int, sums: np.ndarray, products: np.ndarray, components: int):
        self.count, self.sums, self.wide = count, sums, len(sums)
        scaled = count * products - sums[:, None] * sums[None]
        square = count * count
        self.covariance = np.array([[float(Fraction(v, square)) for v in row] for row in scaled.tolist()]).reshape(self.wide, self.wide)
        trace = float(Fraction(sum(scaled.diagonal().tolist()), square)) if self.wide else 0.0
        large = float(np.abs(self.covariance).max(initial=0.0)) or 1.0
        value, vector = np.linalg.eigh(self.covariance / large)
        order = np.argsort(-value, kind="stable")[:components]
        self.value, vector = value[order] * large, vector[:, order]
        sign = np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(order))]) if self.wide else 1.0
        self.vector = vector * sign
        self.whole = self.value > trace * self.wide * np.finfo(np.float64).eps
        self.explained = self.value / trace if trace > 0 else np.full(len(order), np.nan)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _wide_or_object(x, self.count, self.sums)

    def projected(self, centred: np.ndarray) -> np.ndarray:
        """Whitened values; NaN for a component without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred.astype(np.float64) / self.count) @ self.vector / np.sqrt(np.where(self.whole, self.value, np.nan))
        return out


def identity_error(fit: DataFrame, whitening: Whitening) -> float | None:
    """Largest absolute entry of the whitened rows' covariance, less the identity, over ``fit``; centred in each task, then joined."""
    own = np.flatnonzero(whitening.whole)
    if not len(own):
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, moment = 0, np.zeros(len(own)), np.zeros((len(own), len(own)))
        for batch in batches:
            if batch.num_rows:
                z = whitening.projected(whitening.centred(matrix(batch.column("x"), whitening.wide, np.int64)))[:, own]
                m, k = z.mean(axis=0), len(z)
                moment += (z - m).T @ (z - m) + np.outer(mean - m, mean - m) * (n * k / (n + k))
                mean, n = (n * mean + k * m) / (n + k), n + k
        if n:
            i, j = np.divmod(np.arange(len(own) ** 2), len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(i), pa.array(j), pa.array(np.full(len(i), float(n))), pa.array(mean[i]), pa.array(mean[j]), pa.array(moment[i, j])],
                names=["i", "j", "n", "a", "b", "moment"])

    joined = F.sum("moment") + F.sum(F.expr("n * a * b")) - F.sum(F.expr("n * a")) * F.sum(F.expr("n * b")) / F.sum("n")
    parts = fit.mapInArrow(run, "i long, j long, n double, a double, b double, moment double").groupBy("i", "j").agg((joined / F.sum("n")).alias("v")).collect()
    return max(abs(r["v"] - (r["i"] == r["j"])) for r in parts)


def whitened_vectors(rows: DataFrame, components: int = 4) -> DataFrame:
    """Per row of ``rows`` (vec_id, embedding) that takes part and component up to ``components``: its whitened coordinate, and figures.

    A row takes part if its vector is there, has entries and none is null or not finite; where vectors have several lengths, those of the
    commonest length (of several the smallest) take part. Entries become floor(SCALE * entry), held within 64 bits. Means and
    covariance are those of the distinct integer vectors. Components are numbered by falling eigenvalue, the largest entry of
    each being positive; a vector of fewer entries has fewer components. A component without variance has whitened null and
    explained 0 (null if no component has any), and does not count in identity_error (null if there is no other).
    ``deviation`` is exact; beyond 64 bits it is null and ``deviation_digits``, else null, has its decimal digits. Null ids and
    repeated rows have rows of their own; an empty table gives an empty result; other columns are ignored.
    """
    spark = rows.sparkSession
    kept, wide = of_one_length(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(finite("embedding")), "embedding")
    if not wide:
        return spark.createDataFrame([], WHITENED)
    own = kept.select("vec_id", F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))
    fit = written(own.select("x").distinct(), "whitening")
    whitening = Whitening(*scatter_of(fit, wide), components)
    error = identity_error(fit, whitening)
    number = len(whitening.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = (1 << 63) - 1
        explained = [None if v != v else max(0.0, v) for v in whitening.explained.tolist()]
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = whitening.centred(matrix(batch.column("x"), whitening.wide, np.int64))
            most = int(max(abs(centred.max()), abs(centred.min())))
            exact = centred if most * most * whitening.wide <= limit else centred.astype(object)
            deviation = (exact * exact).sum(axis=1).tolist()
            z = whitening.projected(centred)
            times, size = number, batch.num_rows
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(np.repeat(np.arange(size), times))),
                pa.array(np.tile(np.arange(1, times + 1, dtype=np.int32), size)),
                pa.array(np.full(size * times, whitening.count, np.int64)),
                pa.array([d if d <= limit else None for d in deviation for _ in range(times)], pa.int64()),
                pa.array(z.ravel(), pa.float64(), mask=np.isnan(z.ravel())),
                pa.array(explained * size, pa.float64()),
                pa.array([error] * (size * times), pa.float64()),
                pa.array([None if d <= limit else str(d) for d in deviation for _ in range(times)], pa.string()),
            ], names=[f.split()[0] for f in WHITENED.split(", ")])

    return own.mapInArrow(run, WHITENED)
