"""MinHash near-dedup with BagMinHash signatures of word-shingle multisets.

Each shingle runs Poisson processes over time, one per dyadic interval of the weight axis ([0,1), [1,2), [2,4) ...).
A point carries a register and a place on the weight axis; it counts for a text that holds the shingle more often than
that place. A register keeps the earliest counting point, so two texts agree in a register with exactly their weighted
Jaccard similarity. Processes are followed only up to a time by which all registers are filled, so the work per text
hardly depends on its weights; texts with an open register are followed further.

Candidates come from bands of registers, without pairs inside a bucket: copies (equal multisets) are folded first, and
every member of a bucket is checked against its leader, the member that meets most others over all its buckets. Members
that are still in different classes are compared in blocks of ``BLOCK`` members, by one matrix product over the elements
they share, so that no link is lost when a leader is not similar to all; a block hands on only links that join classes.
Every link is verified on the exact multisets. Classes are connected components.

Defined cases: a text of one to four words is one shingle; a text without words (null, empty, blank) is alone in its
class; repeated ids are separate rows; a missing id counts as the last; without rows the result is empty.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnflow.llm.common import NO_ID, Stages, batch_of, map_batches
from cairnflow.llm.text import RangeHash, Words, mix, slices
from cairnflow.llm.windows import keyed

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 32
ROWS = 4
REGISTERS = BANDS * ROWS
BLOCK = 512
COLUMNS = 2048


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle code) of all shingles, repeats included."""
    words = Words(data, bounds)
    row_of = words.row_of()
    hashes = RangeHash(words.hashes(data))
    grams = hashes.grams(width)
    inside = np.flatnonzero(row_of[: len(grams)] == row_of[len(row_of) - len(grams) :])
    short = np.flatnonzero((words.counts > 0) & (words.counts < width))
    whole = hashes.ranges(words.rows[short], words.rows[short + 1], 11)
    return np.concatenate([row_of[inside], short]), np.concatenate([grams[inside], whole])


def weighted(row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, weight) of the distinct shingles of each row."""
    order = np.lexsort((code, row))
    row, code = row[order], code[order]
    fresh = np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1]))[: len(row)]
    at = np.flatnonzero(fresh)
    return row[at], code[at], np.diff(np.append(at, len(row)))


def uniform(bits: np.ndarray) -> np.ndarray:
    """Values in (0, 1] from 64 random bits."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, code: np.ndarray, weight: np.ndarray, rows: int, registers: int = REGISTERS) -> np.ndarray:
    """Earliest counting point (its time) per row and register; infinite for rows without shingles."""
    total = np.bincount(row, weight, rows)
    earliest = np.full(rows * registers, np.inf)
    horizon = (math.log(registers) + 6.0) / np.maximum(total, 1)
    pending = total > 0
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(row)), levels)
    level = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    length = np.where(level > 0, 2.0 ** np.maximum(level - 1, 0), 1.0)
    origin = np.where(level > 0, length, 0.0)
    seed = mix(code[element] + level.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 21)
    owner, limit, rate = row[element], weight[element], registers * length
    while pending.any():
        at = np.flatnonzero(pending[owner])
        time, step, many = np.zeros(len(at)), 0, 1
        while len(at):
            # The next ``many`` points of every process that is not yet beyond the horizon.
            bits = mix(seed[at][:, None] + np.arange(step + 1, step + many + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95), 22)
            times = time[:, None] + np.cumsum(-np.log(uniform(bits)) / rate[at][:, None], axis=1)
            marks = mix(bits, 23)
            place = origin[at][:, None] + length[at][:, None] * uniform(mix(bits, 24))
            near = times <= horizon[owner[at]][:, None]
            i, j = np.nonzero(near & (place <= limit[at][:, None]))
            register = (marks[i, j] % np.uint64(registers)).astype(np.int64)
            np.minimum.at(earliest, owner[at[i]] * registers + register, times[i, j])
            alive = near[:, -1]
            at, time = at[alive], times[alive, -1]
            step, many = step + many, min(many * 2, 32)
        pending &= np.isinf(earliest.reshape(rows, registers)).any(1)
        horizon = horizon * 2.0
    return earliest.reshape(rows, registers)


def elements(row: np.ndarray, code: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, element): the t-th occurrence of a shingle as an element of its own, so that multisets become sets."""
    nth = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    return np.repeat(row, weight), mix(np.repeat(code, weight) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 25)


def signature_kernel(batch: pa.RecordBatch):
    ids, marks = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
    for first, stop, data, bounds in slices(batch.column("text")):
        rows = stop - first
        row, code, weight = weighted(*shingles(data, bounds))
        found = signatures(row, code, weight, rows)
        # A multiset is known by two sums over its elements; a row without shingles by its own key.
        at, parts = elements(row, code, weight)
        sums = np.zeros((rows, 2), np.uint64)
        np.add.at(sums[:, 0], at, parts)
        np.add.at(sums[:, 1], at, mix(parts, 26))
        count = np.bincount(at, minlength=rows)
        alone = count == 0
        sums[alone, 0], sums[alone, 1] = mix(ids[first:stop][alone].view(np.uint64), 27), mix(marks[first:stop][alone].view(np.uint64), 28)
        yield batch_of(
            doc_id=ids[first:stop], h=marks[first:stop], n=count,
            node=pa.array([s.tobytes() for s in sums], pa.binary()),
            sig=pa.array([s.tobytes() for s in mix(found.view(np.uint64), 29).astype(np.uint32)], pa.binary()),
        )


def signed_rows(rows: DataFrame) -> DataFrame:
    """doc_id, h, n (shingles), node (the multiset) and sig (32 bits per register) of every row."""
    return map_batches(rows, signature_kernel, "doc_id long, h long, n long, node binary, sig binary")


def memberships(nodes: DataFrame) -> DataFrame:
    """bucket, node for every band of every node with shingles."""

    def kernel(batch: pa.RecordBatch):
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
        key = np.full((batch.num_rows, BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key, 30) ^ sig[:, :, r]
        node = batch.column("node").take(pa.array(np.repeat(np.arange(batch.num_rows), BANDS)))
        yield batch_of(bucket=mix(key, 31).ravel().view(np.int64), node=node)

    return map_batches(nodes.where("n > 0").select("node", "sig"), kernel, "bucket long, node binary")


def bags(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node and bag, the sorted elements of the multiset, of the nodes of ``wanted``: the one time that texts move."""
    reps = wanted.select("node").distinct().join(nodes.select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h")), "node")
    texts = rows.join(reps, ["doc_id", "h"]).select("node", "text")

    def kernel(batch: pa.RecordBatch):
        for first, stop, data, bounds in slices(batch.column("text")):
            at, parts = elements(*weighted(*shingles(data, bounds)))
            order = np.lexsort((parts, at))
            cuts = np.searchsorted(at[order], np.arange(stop - first + 1))
            ordered = parts[order]
            kept = pa.array([ordered[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())
            yield batch_of(node=batch.column("node").slice(first, stop - first), bag=kept)

    return map_batches(texts, kernel, "node binary, bag binary")


def short_bags(bag: DataFrame) -> DataFrame:
    """The same with 32 bits an element, enough to compare the few members of a block."""

    def kernel(batch: pa.RecordBatch):
        halves = [(np.frombuffer(b.as_buffer(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes() for b in batch.column("bag")]
        yield batch_of(node=batch.column("node"), bag=pa.array(halves, pa.binary()))

    return map_batches(bag, kernel, "node binary, bag binary")


def verified(pairs: DataFrame, nodes: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """The pairs (x, y) of nodes whose multisets are similar enough."""
    sizes = nodes.select("node", "n")
    near = (
        pairs.join(sizes.select(F.col("node").alias("x"), F.col("n").alias("nx")), "x")
        .join(sizes.select(F.col("node").alias("y"), F.col("n").alias("ny")), "y")
        .where(F.least("nx", "ny") >= similarity * F.greatest("nx", "ny"))
        .select("x", "y")
    )

    def similar(batch: pa.RecordBatch):
        keep = np.zeros(batch.num_rows, bool)
        left, right = batch.column("bx"), batch.column("by")
        for i in range(batch.num_rows):
            a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int(np.count_nonzero(b[at] == a))
            keep[i] = both >= similarity * (len(a) + len(b) - both) - 1e-9
        yield batch_of(x=batch.column("x"), y=batch.column("y")).filter(pa.array(keep))

    joined = near.join(bag.select(F.col("node").alias("x"), F.col("bag").alias("bx")), "x").join(
        bag.select(F.col("node").alias("y"), F.col("bag").alias("by")), "y"
    )
    return map_batches(joined.select("x", "y", "bx", "by"), similar, "x binary, y binary").distinct()


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as matrix products over the elements that two sets or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(counts > 1)
    number = np.full(len(counts), -1)
    number[shared] = np.arange(len(shared))
    column = number[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    found = np.zeros((len(sets), len(sets)), np.float32)
    edges = np.searchsorted(column, np.arange(0, len(shared) + COLUMNS, COLUMNS))
    for nth, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - nth * COLUMNS] = 1.0
        found += part @ part.T
    return found


def components(edges: DataFrame, stage: Stages) -> DataFrame:
    """node, class (the least node) of every node that has an edge: least labels of neighbours, with pointer jumping."""
    both = stage(edges.select("x", "y").union(edges.select("y", "x")), "edges")
    labels = both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("class"))
    labels, moving = stage(labels, "labels"), 1
    while moving:
        near = both.join(labels.select(F.col("node").alias("y"), "class"), "y").groupBy(F.col("x").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node").select("node", F.col("class").alias("was"), F.least("class", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("class").alias("beyond"))
        moved = step.join(jump, "to").select("node", "was", F.least("to", "beyond").alias("class"))
        moved = stage(moved, "labels")
        moving = moved.where("was <> class").count()
        labels = moved.select("node", "class")
    return labels


def open_links(shared: DataFrame, labels: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Links (x, y) that join members of one bucket that are in different classes."""
    known = shared.join(labels, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    mixed = known.groupBy("bucket").agg(F.count("*").alias("members"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    members = known.join(mixed.select("bucket", blocks.alias("blocks")), "bucket").withColumn("mine", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    other = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = other.select("bucket", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "class")

    def joining(batch):
        node, group = batch.column("node").to_pylist(), batch.column("class").to_pylist()
        mine = batch.column("mine").to_numpy()
        crossing = batch.column("i")[0].as_py() != batch.column("j")[0].as_py()
        sets = [np.frombuffer(b, np.uint32) for b in batch.column("bag").to_pylist()]
        sizes = np.array([len(b) for b in sets], np.float32)
        both = overlaps(sets)
        close = np.triu(both >= similarity * (sizes[:, None] + sizes - both) - 1e-4, 1)
        if crossing:
            close &= mine[:, None] != mine
        root = {g: g for g in group}

        def find(g):
            while root[g] != g:
                root[g] = root[root[g]]
                g = root[g]
            return g

        x, y = [], []
        for a, b in np.argwhere(close):
            p, q = find(group[a]), find(group[b])
            if p != q:
                root[p] = q
                x.append(min(node[a], node[b]))
                y.append(max(node[a], node[b]))
        return pa.table({"x": pa.array(x, pa.binary()), "y": pa.array(y, pa.binary())})

    with_bags = cells.join(short_bags(bag), "node")
    return with_bags.groupBy("bucket", "i", "j").applyInArrow(joining, "x binary, y binary").distinct()


def classes(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h and root (doc_id, h of the first row of the class) of every row of ``rows`` (doc_id, h, text)."""
    stage = Stages()
    signed = stage(signed_rows(rows), "signatures")
    nodes = stage(signed.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "nodes")
    members = memberships(nodes)
    sizes = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    shared = stage(members.join(sizes, "bucket"), "shared")
    meets = shared.groupBy("node").agg(F.sum("members").alias("meets"))
    ranked = shared.join(meets, "node")
    leaders = ranked.groupBy("bucket").agg(F.max(F.struct("meets", "node")).getField("node").alias("y"))
    stars = shared.join(leaders, "bucket").where("node <> y").select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y")).distinct()
    bag = stage(bags(shared, nodes, rows), "bags")
    links = stage(verified(stars, nodes, bag, similarity), "links")
    labels = components(links, stage)
    missed = open_links(shared, labels, bag, similarity)
    more = stage(verified(missed, nodes, bag, similarity), "more-links")
    labels = components(links.union(more), stage)
    placed = signed.select("doc_id", "h", "node").join(labels, "node", "left").select("doc_id", "h", F.coalesce("class", "node").alias("class"))
    placed = stage(placed, "placed")
    # Written before they are joined, so that the rows of a large class can be split.
    roots = stage(placed.groupBy("class").agg(F.min(F.struct("doc_id", "h")).alias("root"), F.count("*").alias("class_size")), "roots")
    return stage.result(placed.join(roots, "class").select("doc_id", "h", "root", "class_size"), "classes")


def inspect(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of the class) and class_size of every row."""
    known = lambda c: F.nullif(c, F.lit(NO_ID))
    found = classes(keyed(docs), similarity)
    return found.select(known(F.col("doc_id")).alias("doc_id"), known(F.col("root.doc_id")).alias("class_id"), "class_size")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first row of every class, with the columns of ``docs``."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    roots = classes(keyed(docs), similarity).select("root.*").distinct()
    found = keyed(docs, row).select("doc_id", "h", "row").join(roots, ["doc_id", "h"])
    one = Window.partitionBy("doc_id", "h").orderBy("h")
    return found.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("row.*")
