"""Substring dedup of word sequences by prefix-partitioned suffix trees.

The suffixes of a group of contents are split by prefixes of variable length: a prefix is lengthened, word by word,
only while more than ``TREE_SUFFIXES`` suffixes share it. Each part is a subtree of bounded size that is prepared on
its own: its suffixes are read some words at a time (the more, the fewer are still undecided), sorted, and cut where
they branch. The branch depths between neighbours are the inner nodes of the subtree; a node at least ``WORDS`` deep
is a repeat of the window, and the first document among its leaves keeps it.

Groups and the split of crowded anchors come from ``windows``; hot groups are re-dealt there, so no tree is unbounded.

Defined cases: null or empty texts have no words; a text shorter than a window is kept; rows that repeat an id do not
count as smaller ids of each other; a row without id counts as the last; without rows the result is empty.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import NO_ID, batch_of, map_batches
from cairnflow.llm.text import Words, buffers, row_sums, slices
from cairnflow.llm.windows import CROWD, Spec, covered, keyed, repeated, with_ranges

WORDS = 50
GRAM = 12
TREE_SUFFIXES = 4096
READ_SYMBOLS = 1 << 16


def prefix_parts(symbols: np.ndarray, starts: np.ndarray, depth: int, most: int = TREE_SUFFIXES) -> list[tuple[int, np.ndarray]]:
    """(prefix length, suffixes) of each part: prefixes grow until at most ``most`` suffixes share one, or to ``depth``."""
    parts, open_parts = [], [(0, starts)]
    while open_parts:
        length, members = open_parts.pop()
        if len(members) <= most or length >= depth:
            parts.append((length, members))
            continue
        _, group = np.unique(symbols[members + length], return_inverse=True)
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order])) + 1
        open_parts.extend((length + 1, x) for x in np.split(members[order], edges))
    return parts


def subtree(symbols: np.ndarray, length: int, members: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaves in order, branch depth before each) of the suffixes, which share ``length`` words; read up to ``depth``."""
    leaves = members.copy()
    branch = np.full(len(leaves), depth, np.int64)
    branch[0] = 0
    while length < depth:
        # Blocks of leaves that no branch separates yet; leaves alone in their block are decided.
        apart = branch < depth
        block = np.cumsum(apart) - 1
        sizes = np.bincount(block)
        live = np.flatnonzero(sizes[block] > 1)
        if not len(live):
            break
        reach = min(depth - length, max(1, READ_SYMBOLS // len(live)))
        read = symbols[leaves[live][:, None] + np.arange(length, length + reach)]
        order = np.lexsort((*read.T[::-1], block[live]))
        leaves[live], read, blocks = leaves[live][order], read[order], block[live][order]
        differs = read[1:] != read[:-1]
        split = np.flatnonzero(differs.any(1) & (blocks[1:] == blocks[:-1]))
        branch[live[split + 1]] = length + differs[split].argmax(1)
        length += reach
    return leaves, branch


def repeated_ranges(contents: list[bytes], weights: np.ndarray, first: np.ndarray, size: int):
    """Windows of ``size`` words found in a content of another document, as ranges with the first document."""
    data, bounds = buffers(pa.array(contents, pa.binary()))
    words = Words(data, bounds)
    _, symbols = np.unique(words.hashes(data), return_inverse=True)
    rows = words.rows
    counts = np.maximum(words.counts - size + 1, 0)
    owner = np.repeat(np.arange(len(contents)), counts)
    starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + rows[owner]
    owner_at = np.repeat(np.arange(len(contents)), words.counts)
    # A window that only its own content has is repeated by the other places of the content.
    least = np.zeros(len(symbols), np.int64)
    least[starts] = first[owner]
    for length, members in prefix_parts(symbols, starts, size):
        leaves, branch = subtree(symbols, length, members, size)
        node = np.flatnonzero(branch < size)
        low = np.minimum.reduceat(first[owner_at[leaves]], node)
        least[leaves] = np.repeat(low, np.diff(np.append(node, len(leaves))))
    value = least[starts]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))[: len(value)]
    begin = np.flatnonzero(fresh)
    end = np.append(begin[1:], len(value))
    at = owner[begin]
    lo = starts[begin] - rows[at]
    return at, lo, lo + (end - begin), value[begin]


DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def marked(docs: DataFrame, *columns, size: int = WORDS, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, h, text, cuts (word ranges to remove) and ``columns`` of every row."""
    spec = Spec(size, gram, words=True, ordered=True, crowd=crowd)
    found = repeated(keyed(docs), spec, lambda c, w, f: repeated_ranges(c, w, f, size))
    return with_ranges(keyed(docs, *columns), found)


def kept_words(batch: pa.RecordBatch):
    """(first, stop, words, removed flags, kept bytes of each row) of every slice."""
    for first, stop, data, bounds in slices(batch.column("text")):
        words = Words(data, bounds)
        gone = covered(batch.column("cuts").slice(first, stop - first), words.rows)
        # Each kept word and one space after it, gathered in one pass.
        begin, length = words.begin[~gone], (words.end - words.begin)[~gone]
        upto = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(upto[-1], 0x20, np.uint8)
        place = np.repeat(upto[:-1] - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
        out[place] = data[np.repeat(begin - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())]
        ends = upto[np.concatenate([[0], np.cumsum(row_sums(~gone, words.rows))])]
        yield first, stop, words, gone, [out[a : max(a, b - 1)].tobytes() for a, b in zip(ends[:-1], ends[1:])]


def digest(batch: pa.RecordBatch):
    for first, stop, words, gone, kept in kept_words(batch):
        yield batch_of(
            doc_id=batch.column("doc_id").slice(first, stop - first), n_words=words.counts.astype(np.int64),
            n_removed=row_sums(gone, words.rows), kept_sha256=pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        )


def inspect(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    found = map_batches(marked(docs, **limits).select("doc_id", "text", "cuts"), digest, DIGEST)
    return found.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def remove_repeats(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with repeated words removed from ``text`` and ``n_chars`` (if there is one) to match.

    Texts that lose nothing stay as they are, byte for byte; rows that lose all their words go.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    found = marked(docs, row, **limits).select("row", "text", "cuts")
    names = docs.columns

    def kernel(batch: pa.RecordBatch):
        whole = batch.column("text")
        for first, stop, words, gone, kept in kept_words(batch):
            lost = row_sums(gone, words.rows)
            alive = (lost == 0) | (lost < words.counts)
            old = whole.slice(first, stop - first).to_pylist()
            text = [k.decode() if n else o for k, n, o in zip(kept, lost, old)]
            row = batch.column("row").slice(first, stop - first)
            columns = dict(zip(row.type.names, row.flatten()))
            columns["text"] = pa.array(text, whole.type)
            if "n_chars" in columns:
                sizes = [len(t) if n else c for t, n, c in zip(text, lost, columns["n_chars"].to_pylist())]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_pydict({c: columns[c] for c in names}).filter(pa.array(alive))

    return map_batches(found, kernel, docs.schema)
