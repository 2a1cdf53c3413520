"""Embedding whitening: weighted covariance over distinct vectors, each whitened once, joined back to its rows.

Entries become whole numbers ``x = floor(256 * c)``, so copies and near copies of an embedding share one x vector.

1. Rows become an exact binary key of x; equal keys are folded to one row with a count (copies combine before the
   shuffle). ``weights`` says how a distinct vector counts in the fit: ``one`` (once) or ``count`` (as often as it occurs).
2. Sums per dimension are exact integers. The covariance is a weighted centred GEMM: each task centres its vectors,
   multiplies them batch by batch into one matrix and sends the upper triangle, so what meets in a reducer does not
   grow with the rows. The driver gets one number per pair of dimensions and solves the eigenproblem.
3. Each distinct vector is projected once; the covariance of what comes out is compared with the identity.
4. Results go back to the rows by key, vectors with very many copies spread over tasks.

Defined cases: rows whose vector is null, or holds a null, a non-finite entry or one whose x is no 64-bit integer, are
dropped. Vectors of different lengths are different spaces, each fitted on its own; an empty vector has no component. A
component without variance (its eigenvalue is not above rounding, as in a fit list of one vector) has no whitened value
(null) and takes no part in the identity error, which is null if no component is left; ``explained`` is null if the
trace is 0. A deviation that needs more than 64 bits is null. Null and repeated ids are rows like others; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from cairnflow.llm.common import Stages, batch_of, map_batches
from cairnflow.operators.skew import join_by_weight

COMPONENTS = 4
SCALE = 256
WIDTHS = (np.int8, np.int16, np.int32, np.int64)
#: Vectors that are centred and multiplied together.
BLOCK = 2048
PARTIAL_SUMS = "dims int, i int, s decimal(38,0)"
PARTIAL_PRODUCTS = "dims int, i int, j int, v double"
POINTS = "key binary, copies long, dims int, deviation long, " + ", ".join(f"z{c} double" for c in range(1, COMPONENTS + 1))


class Space(NamedTuple):
    """What the fit learns about the vectors of one length."""

    vectors: int
    sums: list[int]
    weight: int
    weighted_sums: list[int]
    vectors_of: np.ndarray
    values: np.ndarray
    trace: float
    spread: np.ndarray


# --- keys -------------------------------------------------------------------------------------


def encode(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """id and key of the rows whose entries all become 64-bit integers."""
    column = batch.column("embedding")
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    lengths = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten()
    nulls = flat.is_null().to_numpy(zero_copy_only=False)
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * SCALE)
    usable = ~nulls & np.isfinite(values) & (scaled >= -(2.0**63)) & (scaled < 2.0**63)
    x = np.where(usable, scaled, 0).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.zeros(len(x) + 1, np.int64)
    np.cumsum(~usable, out=bad[1:])
    keep = np.flatnonzero(valid & (bad[ends] == bad[ends - lengths]))
    keys = [to_key(x[ends[r] - lengths[r] : ends[r]]) for r in keep]
    yield batch_of(vec_id=batch.column("vec_id").take(pa.array(keep)), key=pa.array(keys, pa.binary()))


def to_key(x: np.ndarray) -> bytes:
    """The narrowest integers that hold the vector, after a byte that names their width: one key per vector."""
    low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
    for code, width in enumerate(WIDTHS):
        if np.iinfo(width).min <= low and high <= np.iinfo(width).max:
            break
    return bytes([code]) + x.astype(np.dtype(width).newbyteorder("<")).tobytes()


def from_key(key: bytes) -> np.ndarray:
    return np.frombuffer(key, np.dtype(WIDTHS[key[0]]).newbyteorder("<"), offset=1).astype(np.int64)


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the batch, their x vectors) for each length and at most BLOCK vectors."""
    keys = batch.column("key").to_pylist()
    sizes = np.array([(len(k) - 1) // np.dtype(WIDTHS[k[0]]).itemsize for k in keys])
    for dims in np.unique(sizes):
        at = np.flatnonzero(sizes == dims)
        for first in range(0, len(at), BLOCK):
            rows = at[first : first + BLOCK]
            yield rows, np.stack([from_key(keys[r]) for r in rows])


# --- fit --------------------------------------------------------------------------------------


def partial_sums(batches) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task per vector length: their number, sum per dimension, total weight, weighted sum per dimension."""
    found: dict[int, tuple[int, int, list[int], list[int]]] = {}
    for batch in batches:
        weights = batch.column("weight").to_numpy()
        for rows, x in matrices(batch):
            w = weights[rows]
            n, total, plain, weighted = found.get(x.shape[1], (0, 0, [0] * x.shape[1], [0] * x.shape[1]))
            found[x.shape[1]] = (n + len(x), total + int(w.sum()), add(plain, x, None), add(weighted, x, w))
    for dims, (n, total, plain, weighted) in found.items():
        sums = [Decimal(s) for s in (n, *plain, total, *weighted)]
        yield batch_of(dims=pa.array([dims] * len(sums), pa.int32()), i=pa.array(range(len(sums)), pa.int32()), s=pa.array(sums, pa.decimal128(38, 0)))


def add(sums: list[int], x: np.ndarray, weights: np.ndarray | None) -> list[int]:
    largest = int(np.abs(x).max(initial=0)) * (1 if weights is None else int(weights.max(initial=0))) * len(x)
    wide = x.astype(object) if not 0 <= largest < 1 << 62 else x
    part = (wide if weights is None else wide * weights[:, None]).sum(0)
    return [a + int(b) for a, b in zip(sums, part)]


def fit(points: DataFrame, weight: str) -> dict[int, Space]:
    """Means and covariance eigenvectors of each vector length in ``points`` (key, copies)."""
    weighted = points.select("key", (F.col("copies") if weight == "count" else F.lit(1)).cast("long").alias("weight"))
    sums = weighted.mapInArrow(partial_sums, PARTIAL_SUMS).groupBy("dims", "i").agg(F.sum("s").alias("s"))
    # Two numbers per dimension of each length.
    exact: dict[int, dict[int, int]] = {}
    for r in sums.collect():
        exact.setdefault(r.dims, {})[r.i] = int(r.s)
    means = {d: np.array([s[d + 2 + k] / s[d + 1] for k in range(d)]) for d, s in exact.items()}
    shared = points.sparkSession.sparkContext.broadcast(means)

    def products(batches) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            weights = batch.column("weight").to_numpy()
            for rows, x in matrices(batch):
                dims = x.shape[1]
                centred = x - shared.value[dims]
                part = (centred * weights[rows][:, None]).T @ centred
                found[dims] = found[dims] + part if dims in found else part
        for dims, matrix in found.items():
            i, j = np.triu_indices(dims)
            yield batch_of(dims=pa.array(np.full(len(i), dims), pa.int32()), i=pa.array(i, pa.int32()), j=pa.array(j, pa.int32()), v=matrix[i, j])

    moments = weighted.mapInArrow(products, PARTIAL_PRODUCTS).groupBy("dims", "i", "j").agg(F.sum("v").alias("v"))
    # One number per pair of dimensions.
    covariance = {d: np.zeros((d, d)) for d in exact}
    for r in moments.collect():
        covariance[r.dims][r.i, r.j] = covariance[r.dims][r.j, r.i] = r.v / exact[r.dims][r.dims + 1]
    spaces = {}
    for d, s in exact.items():
        values, vectors = np.linalg.eigh(covariance[d])
        values, vectors = values[::-1][:COMPONENTS], vectors[:, ::-1][:, :COMPONENTS]
        trace = float(np.trace(covariance[d]))
        spread = np.where(values > max(trace, 0) * d * np.finfo(float).eps * 8, values, 0.0)
        spaces[d] = Space(s[0], [s[1 + k] for k in range(d)], s[d + 1], [s[d + 2 + k] for k in range(d)], vectors, values, trace, spread)
    return spaces


# --- whitening --------------------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact sums of (n x - S)^2 as Python integers or longs."""
    reach = n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if reach**2 * x.shape[1] < 1 << 62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)


def whiten(points: DataFrame, spaces: dict[int, Space]) -> DataFrame:
    """The distinct vectors with their deviation and whitened components."""
    shared = points.sparkSession.sparkContext.broadcast(spaces)

    def kernel(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, x in matrices(batch):
            dims = x.shape[1]
            space = shared.value[dims]
            exact = deviations(x, space.vectors, space.sums)
            centred = x - np.array([s / space.weight for s in space.weighted_sums])
            columns = {}
            for c in range(COMPONENTS):
                if c < dims and space.spread[c] > 0:
                    columns[f"z{c + 1}"] = pa.array(centred @ space.vectors_of[:, c] / np.sqrt(space.spread[c]), pa.float64())
                else:
                    columns[f"z{c + 1}"] = pa.nulls(len(rows), pa.float64())
            taken = pa.array(rows)
            yield batch_of(
                key=batch.column("key").take(taken), copies=batch.column("copies").take(taken), dims=pa.array(np.full(len(rows), dims), pa.int32()),
                deviation=pa.array([int(d) if d < 1 << 63 else None for d in exact.tolist()], pa.int64()), **columns,
            )

    return map_batches(points, kernel, POINTS)


def identity_errors(white: DataFrame, weight: str) -> DataFrame:
    """Per vector length the largest absolute entry of the whitened fit list's covariance minus the identity."""
    names = [f"z{c}" for c in range(1, COMPONENTS + 1)]
    weighted = white.withColumn("w", (F.col("copies") if weight == "count" else F.lit(1)).cast("double"))
    mean = weighted.groupBy("dims").agg(F.sum("w").alias("all"), *[(F.sum(F.col(z) * F.col("w")) / F.sum("w")).alias(f"m{z}") for z in names])
    centred = weighted.join(F.broadcast(mean), "dims")
    entries = [
        F.abs(F.sum(F.col("w") * (F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))) / F.max("all") - (1.0 if a == b else 0.0))
        for k, a in enumerate(names)
        for b in names[k:]
    ]
    return centred.groupBy("dims").agg(F.greatest(*entries).alias("identity_error"))


def inspect(embeddings: DataFrame, weight: str = "one") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every row that is not dropped."""
    if weight not in ("one", "count"):
        raise ValueError("weight must be 'one' or 'count'")
    stages = Stages()
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema = StructType([rows.schema["vec_id"], StructField("key", BinaryType())])
    keyed = stages(map_batches(rows, encode, schema), "white-keys")
    points = stages(keyed.groupBy("key").agg(F.count("*").alias("copies")), "white-points")
    spaces = fit(points, weight)
    white = stages(whiten(points, spaces), "white-vectors")
    # A row per vector length.
    errors = {r.dims: r.identity_error for r in identity_errors(white, weight).collect()}
    facts = [
        (d, c + 1, s.vectors, float(s.values[c]) / s.trace if s.trace > 0 else None, errors.get(d))
        for d, s in spaces.items()
        for c in range(min(COMPONENTS, d))
    ]
    table = embeddings.sparkSession.createDataFrame(facts, "dims int, component int, n long, explained double, identity_error double")
    joined = join_by_weight(keyed, white, ["key"], "copies", "vec_id").drop("key", "copies")
    long = joined.select("vec_id", "dims", "deviation", F.posexplode(F.array(*[f"z{c}" for c in range(1, COMPONENTS + 1)])).alias("at", "whitened"))
    named = long.withColumn("component", (F.col("at") + 1).cast("int")).join(F.broadcast(table), ["dims", "component"])
    return stages.result(named.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"), "whitened")
