"""Windows of a fixed number of tokens that start more than once in a collection.

No window is compared with all others. Equal windows have the same *anchor*, the least hash of their ``gram``-token
grams, so consecutive windows of one anchor form a *run*, the unit that is shuffled:

1. ``scan`` turns every text into runs (anchor, content hash, place); no text moves.
2. Runs whose anchor is found once cannot repeat and go. What is left is folded to distinct contents with a weight
   (how many places have it) and the first document that has it.
3. Distinct contents of an anchor are fetched from one place each and compared as *groups* of bounded size by the
   kernel of the operator, which reports the windows that some other content of the group has too.
4. An anchor with more than ``crowd`` distinct contents is cut into pieces of ``PIECE`` windows, keyed by what all
   windows of a piece share; pieces still crowded are cut into single windows, which aggregation resolves. Nothing
   is dropped, and no group grows with the data.
5. The reported ranges go back to all places of a content, and per document to its text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnflow.llm.common import NO_ID, Stages, batch_of, map_batches
from cairnflow.llm.text import BYTE_CODES, RangeHash, Words, buffers, signed, slices, sliding_min

RUN = 200
PIECE = 16
CROWD = 2000
GROUP_BYTES = 1 << 18


@dataclass(frozen=True)
class Spec:
    """What a window is: ``size`` bytes or words; ``ordered`` asks for an earlier document, not any other place."""

    size: int
    gram: int
    words: bool
    ordered: bool
    crowd: int = CROWD

    def tokens(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words | None]:
        """Token codes, token bounds of the rows, and the words if tokens are words."""
        if not self.words:
            return BYTE_CODES[data], bounds, None
        found = Words(data, bounds)
        return found.hashes(data), found.rows, found


def runs(codes: np.ndarray, bounds: np.ndarray, size: int, gram: int, longest: int = RUN):
    """(anchor, content hash, row, first window, windows, loops) of the runs of all rows.

    A run loops if it goes on behind a place of its anchor: only then can it hold equal windows itself.
    """
    hashes = RangeHash(codes)
    grams = hashes.grams(gram)
    low = sliding_min(grams, size - gram + 1)
    stops = np.maximum(bounds[1:] - size + 1, bounds[:-1])
    some = np.flatnonzero(stops > bounds[:-1])
    if not len(some):
        empty = np.zeros(0, np.int64)
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty, empty.astype(bool)
    valid = np.zeros(len(low), bool)
    for a, b in zip(bounds[some], stops[some]):
        valid[a:b] = True
    first = np.empty(len(low), bool)
    first[0] = True
    np.not_equal(low[1:], low[:-1], out=first[1:])
    first[bounds[some]] = True
    start = np.flatnonzero(first & valid)
    row = np.searchsorted(bounds, start, "right") - 1
    stop = np.minimum(np.append(start[1:], len(low)), stops[row])
    parts = -(-(stop - start) // longest)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(start, parts) + nth * longest
    count = np.minimum(np.repeat(stop, parts) - begin, longest)
    places = np.concatenate([[0], np.cumsum(grams[: len(low)] == low)])
    loops = places[begin + count - 1] > places[begin]
    return low[begin], hashes.ranges(begin, begin + count + size - 1, 1), np.repeat(row, parts), begin, count, loops


def scan(docs: DataFrame, spec: Spec) -> DataFrame:
    """m (anchor), c (content hash), doc_id, h, start, n (windows) and loops of every run of ``docs`` (doc_id, h, text)."""

    def kernel(batch: pa.RecordBatch):
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("h").to_numpy()
        for first, stop, data, bounds in slices(batch.column("text")):
            codes, rows, _ = spec.tokens(data, bounds)
            if len(codes) < spec.size:
                continue
            low, content, row, begin, count, loops = runs(codes, rows, spec.size, spec.gram)
            yield batch_of(
                m=signed(low), c=signed(content), doc_id=ids[first:stop][row], h=marks[first:stop][row],
                start=begin - rows[row], n=count.astype(np.int32), loops=loops,
            )

    return map_batches(docs, kernel, "m long, c long, doc_id long, h long, start long, n int, loops boolean")


def keyed(docs: DataFrame, *columns) -> DataFrame:
    """doc_id (null: after all others), a hash of the text, and the text: the key of a row, whatever ids repeat."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"), *columns)


def fetch(docs: DataFrame, wanted: DataFrame, spec: Spec) -> DataFrame:
    """The contents of ``wanted`` (one place each), cut from their texts."""
    listed = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("m", "c", "a", "b", "off", "weight", "first", "start", "n", "crowded")).alias("cuts"))
    joined = docs.join(listed, ["doc_id", "h"]).select("text", "cuts")

    def kernel(batch: pa.RecordBatch):
        cuts = batch.column("cuts")
        for first, stop, data, bounds in slices(batch.column("text")):
            part = cuts.slice(first, stop - first)
            fields = part.flatten()
            row = np.repeat(np.arange(stop - first), part.value_lengths().to_numpy())
            begin, count = fields.field("start").to_numpy(), fields.field("n").to_numpy()
            if spec.words:
                found = Words(data, bounds)
                at = found.rows[row] + begin
                low, high = found.begin[at], found.end[at + count + spec.size - 2]
            else:
                low = bounds[row] + begin
                high = low + count + spec.size - 1
            content = pa.array([data[x:y].tobytes() for x, y in zip(low, high)], pa.binary())
            names = ("m", "c", "a", "b", "off", "weight", "first", "n", "crowded")
            yield batch_of(**{k: fields.field(k) for k in names}, content=content)

    return map_batches(joined, kernel, CONTENT)


CONTENT = "m long, c long, a long, b long, off int, weight long, first long, n int, crowded boolean, content binary"
FOUND = "m long, c long, lo int, hi int, first long"
#: contents, weights, first documents -> (content, first window, window after the last, first document) arrays
Kernel = Callable[[list[bytes], np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def group_batches(batches: Iterator[pa.RecordBatch], kernel: Kernel) -> Iterator[pa.RecordBatch]:
    """Feed whole groups (rows of one a, b; they arrive sorted) to the kernel, several at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def flush():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        at, lo, hi, first = kernel(whole.column("content").to_pylist(), whole.column("weight").to_numpy(), whole.column("first").to_numpy())
        off = whole.column("off").to_numpy()[at]
        ids = [whole.column(k).to_numpy()[at] for k in ("m", "c")]
        return batch_of(m=ids[0], c=ids[1], lo=(off + lo).astype(np.int32), hi=(off + hi).astype(np.int32), first=first.astype(np.int64))

    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        bytes_upto = np.cumsum(np.diff(buffers(batch.column("content"))[1]))
        fresh = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        at = 0
        goes_on = bool(held) and (held[-1].column("a")[-1].as_py(), held[-1].column("b")[-1].as_py()) == (a[0], b[0])
        for edge in fresh:
            upto = int(bytes_upto[edge - 1]) if edge else 0
            pending = size + upto - (int(bytes_upto[at - 1]) if at else 0)
            if pending >= GROUP_BYTES and not (edge == 0 and goes_on):
                if edge > at:
                    held.append(batch.slice(at, edge - at))
                if held:
                    yield flush()
                held, size, at = [], 0, int(edge)
        if at < batch.num_rows:
            held.append(batch.slice(at))
            size += int(bytes_upto[-1]) - (int(bytes_upto[at - 1]) if at else 0)
    if held:
        yield flush()


def compare(contents: DataFrame, kernel: Kernel) -> DataFrame:
    dealt = contents.repartition("a", "b").sortWithinPartitions("a", "b")
    return dealt.mapInArrow(lambda batches: group_batches(batches, kernel), FOUND)


def cut(contents: DataFrame, spec: Spec, piece: int) -> DataFrame:
    """Pieces of at most ``piece`` windows; windows that are equal are in pieces of equal key (a, b) and place."""

    def kernel(batch: pa.RecordBatch):
        out: dict[str, list] = {k: [] for k in ("row", "a", "b", "q", "off", "n", "lo", "hi")}
        data, bounds = buffers(batch.column("content"))
        codes, rows, words = spec.tokens(data, bounds)
        hashes = RangeHash(codes)
        grams = hashes.grams(spec.gram)
        anchors = batch.column("m").to_numpy().view(np.uint64)
        for i in range(batch.num_rows):
            a, b = rows[i], rows[i + 1] - spec.size + 1
            places = a + np.flatnonzero(grams[a : rows[i + 1] - spec.gram + 1] == anchors[i])
            start = np.arange(a, b)
            place = places[np.searchsorted(places, start)]
            # Windows with the anchor at one place and at a near distance from it.
            key = place * (spec.size + 1) + (place - start) // piece
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            out["row"].append(np.full(len(first), i))
            out["lo"].append(start[first])
            out["hi"].append(np.append(start[first[1:]], b))
            out["off"].append(first)
            # The reach of the widest piece with this distance, so that equal windows see the same key.
            far = (place - start)[first] // piece * piece
            out["a"].append(place[first] - far)
        row, lo, hi, off = (np.concatenate(out[k]).astype(np.int64) for k in ("row", "lo", "hi", "off"))
        core_lo = np.concatenate(out["a"]).astype(np.int64)
        core_hi = core_lo - (piece - 1) + spec.size
        token_hi = hi + spec.size - 1
        if words is None:
            content = [data[x:y].tobytes() for x, y in zip(lo, token_hi)]
        else:
            content = [data[words.begin[x] : words.end[y - 1]].tobytes() for x, y in zip(lo, token_hi)]
        names = ("m", "c", "weight", "first")
        yield batch_of(
            **{k: batch.column(k).to_numpy()[row] for k in names},
            a=signed(hashes.ranges(core_lo, core_hi, 3)), b=signed(hashes.ranges(core_lo, core_hi, 4)),
            q=signed(hashes.ranges(lo, token_hi, 5)), off=(off + batch.column("off").to_numpy()[row]).astype(np.int32),
            n=(hi - lo).astype(np.int32), content=pa.array(content, pa.binary()),
        )

    schema = "m long, c long, weight long, first long, a long, b long, q long, off int, n int, content binary"
    return map_batches(contents, kernel, schema)


def crowded_windows(contents: DataFrame, spec: Spec, kernel: Kernel, stage: Stages) -> DataFrame:
    """The windows of crowded anchors that repeat (step 4)."""
    pieces = stage(cut(contents, spec, min(PIECE, spec.size // 3)), "pieces")
    sizes = pieces.groupBy("a", "b").agg(
        F.count("*").alias("rows"), F.sum("weight").alias("places"), F.min("first").alias("least"), F.min("q").alias("q0"), F.max("q").alias("q1")
    )
    sized = pieces.join(sizes.where("places > 1"), ["a", "b"])
    live = stage(sized.withColumn("crowded", F.col("rows") > spec.crowd).withColumn("equal", F.expr("q0 = q1")), "live-pieces")
    whole = live.where("equal").select("m", "c", F.col("off").alias("lo"), (F.col("off") + F.col("n")).alias("hi"), F.col("least").alias("first"))
    live = live.where("NOT equal")
    few = compare(live.where("NOT crowded").select("m", "c", "a", "b", "off", "weight", "first", "n", "crowded", "content"), kernel)
    single = cut(live.where("crowded").select("m", "c", "weight", "first", "off", "content"), spec, 1).drop("content")
    equal = single.groupBy("a", "b").agg(F.sum("weight").alias("places"), F.min("first").alias("least")).where("places > 1")
    many = single.join(equal, ["a", "b"]).select("m", "c", F.col("off").alias("lo"), (F.col("off") + 1).alias("hi"), F.col("least").alias("first"))
    return whole.unionByName(few).unionByName(many)


def repeated(docs: DataFrame, spec: Spec, kernel: Kernel) -> DataFrame:
    """doc_id, h, cuts (lo, hi): token ranges of the windows of ``docs`` (doc_id, h, text) to remove, a row per text."""
    stage = Stages()
    places = stage(scan(docs, spec), "runs")
    counts = (F.min("doc_id").alias("first"), F.max("doc_id").alias("last")) if spec.ordered else (F.count("*").alias("places"), F.max("loops").alias("loops"))
    often = places.groupBy("m").agg(*counts).where("first < last" if spec.ordered else "places > 1 OR loops").select("m")
    live = stage(places.join(often, "m", "left_semi"), "live-runs")
    stage.release(places)
    one = F.min(F.struct("doc_id", "h", "start", "n")).alias("one")
    contents = stage(live.groupBy("m", "c").agg(F.count("*").alias("weight"), one), "folded")
    # Written before they are joined: both sides are then dealt for the join alone, and a hot anchor can be split.
    sizes = stage(contents.groupBy("m").agg(F.count("*").alias("contents")), "sizes")
    known = contents.join(sizes, "m").select(
        "m", "c", "weight", F.col("one.doc_id").alias("doc_id"), F.col("one.h").alias("h"), F.col("one.start").alias("start"), F.col("one.n").alias("n"),
        F.col("one.doc_id").alias("first"), F.col("m").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).alias("off"), "contents",
        (F.col("contents") > spec.crowd).alias("crowded"),
    )
    known = stage(known, "contents")
    alone = known.where("contents = 1 AND weight > 1").select("m", "c", F.lit(0).alias("lo"), F.col("n").alias("hi"), "first")
    fetched = stage(fetch(docs, known.where("contents > 1 OR weight = 1"), spec), "fetched")
    few = compare(fetched.where("NOT crowded"), kernel)
    many = crowded_windows(fetched.where("crowded"), spec, kernel, stage)
    found = alone.unionByName(few).unionByName(many).groupBy("m", "c").agg(F.collect_list(F.struct("lo", "hi", "first")).alias("found"))
    placed = live.join(found, ["m", "c"])
    if spec.ordered:
        placed = placed.withColumn("found", F.expr("filter(found, x -> x.first < doc_id)")).where("size(found) > 0")
    moved = F.expr(f"transform(found, x -> struct(start + x.lo AS lo, start + x.hi + {spec.size - 1} AS hi))").alias("cuts")
    listed = placed.select("doc_id", "h", moved).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("cuts")).alias("cuts"))
    return stage.result(listed, "cuts")


def with_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Every row of ``docs`` (which has doc_id and h) with ``cuts``, the list of its token ranges (null: none)."""
    return docs.join(ranges, ["doc_id", "h"], "left")


def covered(part: pa.Array, rows: np.ndarray) -> np.ndarray:
    """Which tokens the ranges of their rows cover; ``rows`` are the token bounds of the rows."""
    lengths = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    fields = part.flatten()
    row = np.repeat(np.arange(len(part)), lengths)
    change = np.zeros(int(rows[-1]) + 1, np.int64)
    np.add.at(change, rows[row] + fields.field("lo").to_numpy(), 1)
    np.subtract.at(change, rows[row] + fields.field("hi").to_numpy(), 1)
    return np.cumsum(change[:-1]) > 0
