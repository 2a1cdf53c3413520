"""Suffix-array dedup of byte strings by column-wise construction over many strings at once.

``column_wise`` builds the Burrows-Wheeler transform of a collection and its common-prefix array: round j inserts,
for every string, the suffix of length j, whose rank follows from the rank of the suffix of length j - 1 by counting
symbols before it; the common prefix with its neighbours follows from a range minimum. A round is sequential passes
over arrays. These arrays stand in for the external files of the original method, because an executor has no local
folder to rely on: a collection is a group of at most some hundred kilobytes that Spark deals out (``windows``), so
they are bounded, and what exceeds memory is spilled by Spark's own sort.

Two windows are equal where neighbours share a prefix of at least the window size.

Defined cases: null or empty texts have no bytes and nothing removed; repeated rows count as other places, so both
lose what they share; a text shorter than a window is kept; without rows the result is empty. A text is cut between
bytes, so its remainder need not be valid UTF-8: only its hash is returned, and ``remainders`` returns it as binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import NO_ID, batch_of, map_batches
from cairnflow.llm.text import row_sums, slices
from cairnflow.llm.windows import CROWD, Spec, covered, keyed, repeated, with_ranges

BYTES = 200
GRAM = 48


def column_wise(sequences: list[np.ndarray], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bwt, lcp, lf) of sequences of small non-negative numbers. In the transform a symbol is its number + 1, and 0
    before the start of a sequence; common prefixes stop counting at ``cap``. Row i < len(sequences) is the empty
    suffix of sequence i."""
    total = len(sequences)
    lengths = np.array([len(s) for s in sequences], np.int64)
    longest = int(lengths.max()) if total else 0
    most = max((int(s.max()) for s in sequences if len(s)), default=0)
    # Column j holds the symbol in front of the suffix of length j.
    columns = np.zeros((longest + 1, total), np.uint8 if most < 255 else np.uint16)
    for i, s in enumerate(sequences):
        columns[: len(s), i] = s[::-1] + 1
    bwt = columns[0].copy()
    lcp = np.zeros(total, np.uint16)
    who, rank = np.arange(total), np.arange(total)  # sequences in the order of their last suffix, and its row
    for j in range(1, longest + 1):
        live = columns[j - 1, who] > 0
        who, rank = who[live], rank[live]
        symbol = bwt[rank]
        size = len(bwt)
        order = np.argsort(bwt, kind="stable")
        ended = size - int(np.count_nonzero(bwt))
        flags = np.zeros(size, bool)
        flags[rank] = True
        sorted_at = np.flatnonzero(flags[order])
        turn = np.argsort(symbol, kind="stable")
        who, old, symbol = who[turn], rank[turn], symbol[turn]
        rank = total + sorted_at - ended
        # Range minima up to the row before and after with the same symbol.
        before, after = order[sorted_at - 1], order[np.minimum(sorted_at + 1, size - 1)]
        has_before = (sorted_at > 0) & (bwt[before] == symbol)
        has_after = (sorted_at + 1 < size) & (bwt[after] == symbol)
        fresh = np.ones(size + len(rank), bool)
        fresh[rank] = False
        wider = np.empty(size + len(rank), bwt.dtype)
        wider[fresh] = bwt
        wider[rank] = columns[j, who]
        common = np.empty(size + len(rank), np.uint16)
        common[fresh] = lcp
        common[rank] = 0
        common[rank[has_before]] = np.minimum(range_minima(lcp, before[has_before] + 1, old[has_before] + 1) + 1, cap)
        at = rank[has_after] + 1
        common[at] = np.minimum(range_minima(lcp, old[has_after] + 1, after[has_after] + 1) + 1, cap)
        bwt, lcp = wider, common
    order = np.argsort(bwt, kind="stable")
    lf = np.empty(len(bwt), np.int64)
    lf[order] = np.arange(len(bwt)) + total - (len(bwt) - int(np.count_nonzero(bwt)))
    return bwt, lcp, lf


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minimum of every non-empty range [lo, hi)."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    order = np.argsort(-lo)
    pairs = np.column_stack([lo[order], hi[order]]).ravel()
    padded = np.append(values, values.dtype.type(0))
    found = np.empty(len(lo), values.dtype)
    found[order] = np.minimum.reduceat(padded, pairs)[::2]
    return found


def phases(contents: list[bytes], width: int) -> list[np.ndarray]:
    """Each content as ``width`` sequences of dense symbols of ``width`` bytes, one from each of its first bytes on."""
    data = np.frombuffer(b"".join(contents), np.uint8).astype(np.uint32)
    codes = data.copy()
    for k in range(1, width):
        codes[:-k] |= data[k:] << np.uint32(8 * k)
    edges = np.concatenate([[0], np.cumsum([len(c) for c in contents])])
    dense = np.unique(codes, return_inverse=True)[1]
    return [dense[a + p : max(a + p, b - width + 1) : width] for a, b in zip(edges[:-1], edges[1:]) for p in range(width)]


def repeated_ranges(contents: list[bytes], weights: np.ndarray, first: np.ndarray, size: int):
    """Windows of ``size`` bytes that are found twice or more among the contents, as ranges of each.

    A symbol is four bytes where the window is a multiple of that (and the group has not too many of them; else two or
    one): a window is then a quarter as many symbols, from one of four sequences of its content, and the construction
    takes a quarter of the rounds.
    """
    for width in (4, 2, 1):
        sequences = phases(contents, width)
        if size % width == 0 and max((int(s.max()) for s in sequences if len(s)), default=0) < 65535:
            break
    cap = size // width
    _, lcp, lf = column_wise(sequences, cap)
    near = lcp >= cap
    twice = near.copy()
    twice[:-1] |= near[1:]
    lengths = np.array([len(s) for s in sequences], np.int64)
    sizes = np.array([len(c) for c in contents], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # one place between contents
    flag = np.zeros(starts[-1] + 1, bool)
    row, who = np.arange(len(sequences)), np.arange(len(sequences))
    for j in range(1, int(lengths.max()) + 1):
        live = lengths[who] >= j
        who, row = who[live], lf[row[live]]
        if j >= cap:
            flag[starts[who // width] + (lengths[who] - j) * width + who % width] = twice[row]
    for i in np.flatnonzero(weights > 1):
        flag[starts[i] : starts[i] + sizes[i] - size + 1] = True
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8)]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    at = np.searchsorted(starts, begin, "right") - 1
    return at, begin - starts[at], end - starts[at], first[at]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def marked(docs: DataFrame, size: int = BYTES, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, h, text, cuts of every row: the byte ranges to remove."""
    spec = Spec(size, gram, words=False, ordered=False, crowd=crowd)
    rows = keyed(docs)
    return with_ranges(rows, repeated(rows, spec, lambda c, w, f: repeated_ranges(c, w, f, size)))


def digest(batch: pa.RecordBatch):
    ids, cuts = batch.column("doc_id"), batch.column("cuts")
    for first, stop, data, bounds in slices(batch.column("text")):
        gone = covered(cuts.slice(first, stop - first), bounds)
        begins = np.diff(np.append(False, gone).astype(np.int8)) == 1
        inner = bounds[1:-1][bounds[1:-1] < len(data)]
        begins[inner] = gone[inner]
        kept = [hashlib.sha256(data[a:b][~gone[a:b]].tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]
        yield batch_of(
            doc_id=ids.slice(first, stop - first), n_bytes=np.diff(bounds), n_removed=row_sums(gone, bounds),
            n_spans=row_sums(begins, bounds), kept_sha256=pa.array(kept, pa.string()),
        )


def inspect(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = map_batches(marked(docs, **limits).select("doc_id", "text", "cuts"), digest, DIGEST)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def remainders(docs: DataFrame, **limits) -> DataFrame:
    """doc_id and the remaining bytes of every row."""

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            gone = covered(batch.column("cuts").slice(first, stop - first), bounds)
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield batch_of(doc_id=batch.column("doc_id").slice(first, stop - first), kept=pa.array(kept, pa.binary()))

    found = map_batches(marked(docs, **limits).select("doc_id", "text", "cuts"), kernel, "doc_id long, kept binary")
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
