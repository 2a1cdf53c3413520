"""URL filter lists: a blocked Bloom filter of the listed canonical URLs, then an exact hash join.

A rule is a canonical host and path with a verdict. It fits a URL whose host is the rule's or one of its subdomains and
whose path starts with the rule's; the longest fitting rule decides, and a URL that no rule fits is allowed.

1. The listed keys, the host alone and host plus path, are hashed in tasks and folded by block into the filter: one
   block of 512 bits (a cache line) per key, one bit in each of its eight words. The filter grows with the list up to
   ``MOST_BLOCKS`` blocks (4 MB), which bounds what is collected and broadcast; beyond that more URLs pass, nothing else.
2. One pass over the pages asks the filter for every ending of the host at a dot, and for those that may be listed for
   every beginning of the path that is as long as some listed path. Pages without a possible hit are done: they are
   never shuffled.
3. Possible hits, distinct by URL, meet the list in an exact hash join, which removes the false positives. The list is
   broadcast up to ``SMALL_LIST`` rules (their number is counted), else joined by key with hot rules spread.
4. The longest rule of each distinct URL goes back to its pages; URLs that many pages share are spread.

Defined cases: a null URL or one without ``://`` has an empty host and path, fits no rule and is allowed; a URL without
a path has the empty path, which starts with no rule's path but the empty one. Rules without a host or verdict are
ignored, a rule without a path has the empty one; of rules with one host and path ``block`` wins; of equally long
fitting rules the one with the longer host wins. Rows are judged one by one: null and repeated page ids stay. An
empty list allows all, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairnflow.llm.common import Stages, batch_of, map_batches
from cairnflow.llm.text import BYTE_CODES, U64, RangeHash, buffers, mix, signed
from cairnflow.operators.skew import join_by_weight

WORDS = 8
#: Blocks of 64 bytes that the filter has at most, and bits it spends per key until then.
MOST_BLOCKS = 1 << 16
KEY_BITS = 16
#: Rules up to which the exact join broadcasts the list.
SMALL_LIST = 100_000
#: Bytes of URLs that are looked at together.
SLICE_BYTES = 1 << 18
HOST_SEED, KEY_SEED = 1, 2
DOT = 0x2E
HITS = "array<struct<host:string,path:string>>"
HIT_TYPE = pa.list_(pa.struct([("host", pa.string()), ("path", pa.string())]))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The canonical host and the path; both empty if the URL is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return lower_ascii(host), path


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def canonical_rules(rules: DataFrame) -> DataFrame:
    """host, path, verdict, one row each."""
    known = rules.select(
        lower_ascii(F.col("host").cast("string")).alias("host"),
        F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"),
        F.lower(F.col("verdict").cast("string")).alias("verdict"),
    ).where("host <> '' AND verdict IN ('allow', 'block')")
    return known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))


# --- the filter -------------------------------------------------------------------------------


def key_hash(host: np.ndarray, path: np.ndarray) -> np.ndarray:
    return mix(host * U64(3) + path, KEY_SEED)


def rule_keys(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    host, host_at = buffers(batch.column("host"))
    path, path_at = buffers(batch.column("path"))
    hosts = RangeHash(BYTE_CODES[host]).ranges(host_at[:-1], host_at[1:], HOST_SEED)
    paths = RangeHash(BYTE_CODES[path]).ranges(path_at[:-1], path_at[1:])
    yield batch_of(h=signed(np.concatenate([mix(hosts), key_hash(hosts, paths)])))


def masks(keys: np.ndarray) -> np.ndarray:
    """One bit in each of the eight words of the key's block."""
    spread = mix(keys, 7)
    places = np.stack([(spread >> U64(6 * i)) & U64(63) for i in range(WORDS)], 1)
    return U64(1) << places


class BlockedFilter:
    """Bits of the listed keys; ``may_hold`` never misses one."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        block = self.bits[(keys & U64(len(self.bits) - 1)).astype(np.int64)]
        mask = masks(keys)
        return ((block & mask) == mask).all(1)


def build_filter(rules: DataFrame, count: int, most_blocks: int = MOST_BLOCKS) -> BlockedFilter:
    """Fold the keys into blocks by task, then by block; at most ``most_blocks`` rows reach the driver."""
    wanted = max(1, 2 * count * KEY_BITS // (64 * WORDS))
    blocks = min(most_blocks, 1 << (wanted - 1).bit_length())

    def fold(batches):
        bits = np.zeros((blocks, WORDS), U64)
        for batch in batches:
            keys = batch.column("h").to_numpy().view(U64)
            np.bitwise_or.at(bits, (keys & U64(blocks - 1)).astype(np.int64), masks(keys))
        used = np.flatnonzero(bits.any(1))
        yield batch_of(block=used, **{f"w{i}": signed(np.ascontiguousarray(bits[used, i])) for i in range(WORDS)})

    words = [f"w{i}" for i in range(WORDS)]
    schema = "block long, " + ", ".join(f"{w} long" for w in words)
    parts = map_batches(rules, rule_keys, "h long").mapInArrow(fold, schema)
    rows = parts.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in words]).collect()
    bits = np.zeros((blocks, WORDS), np.int64)
    for r in rows:
        bits[r.block] = [r[w] for w in words]
    return BlockedFilter(bits.view(U64))


def possible_hits(filter_bits: BlockedFilter, lengths: np.ndarray, host: pa.Array, path: pa.Array) -> pa.Array:
    """For every row the host endings and path beginnings that may be listed."""
    found: list[list[dict]] = []
    rows, step = len(host), max(1, int(len(host) * SLICE_BYTES / max(host.nbytes + path.nbytes, 1)))
    for first in range(0, rows, step):
        found += slice_hits(filter_bits, lengths, host.slice(first, step), path.slice(first, step))
    return pa.array(found, HIT_TYPE)


def slice_hits(filter_bits: BlockedFilter, lengths: np.ndarray, host: pa.Array, path: pa.Array) -> list[list[dict]]:
    names, name_at = buffers(host)
    paths, path_at = buffers(path)
    found: list[list[dict]] = [[] for _ in range(len(host))]
    # Endings: the whole host, and what follows each dot. After a final dot nothing follows: that place starts the next
    # row's host, or is dropped as empty.
    begin = np.unique(np.concatenate([name_at[:-1], np.flatnonzero(names == DOT) + 1]))
    row = np.minimum(np.searchsorted(name_at, begin, "right") - 1, len(host) - 1)
    end = name_at[row + 1]
    whole = RangeHash(BYTE_CODES[names]).ranges(begin, end, HOST_SEED)
    keep = (end > begin) & filter_bits.may_hold(mix(whole))
    begin, row, whole = begin[keep], row[keep], whole[keep]
    path_hash = RangeHash(BYTE_CODES[paths])
    size = np.diff(path_at)[row]
    for length in lengths:
        fits = np.flatnonzero(size >= length)
        if len(fits):
            start = path_at[row[fits]]
            keys = key_hash(whole[fits], path_hash.ranges(start, start + length))
            for i in fits[filter_bits.may_hold(keys)].tolist():
                r = int(row[i])
                head = paths[path_at[r] : path_at[r] + length].tobytes().decode(errors="ignore")
                found[r].append({"host": names[begin[i] : name_at[r + 1]].tobytes().decode(), "path": head})
    return found


# --- the operator -----------------------------------------------------------------------------


def judge(pages: DataFrame, rules: DataFrame, small_list: int = SMALL_LIST, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages`` (page_id, url)."""
    stages = Stages()
    listed = stages(canonical_rules(rules), "url-rules")
    count = listed.count()
    # As many rows as listed paths have different lengths: bounded by the longest path.
    lengths = np.array(sorted(r.n for r in listed.select(F.octet_length("path").alias("n")).distinct().collect()), np.int64)
    filter_bits = build_filter(listed, count, most_blocks)
    shared = pages.sparkSession.sparkContext.broadcast((filter_bits.bits, lengths))
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id"), host.alias("host"), path.alias("path"))
    schema = StructType([rows.schema["page_id"], StructField("host", StringType()), StructField("path", StringType())])

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bits, sizes = shared.value
        hits = possible_hits(BlockedFilter(bits), sizes, batch.column("host"), batch.column("path"))
        yield batch_of(page_id=batch.column("page_id"), host=batch.column("host"), path=batch.column("path"), hits=hits)

    asked_schema = StructType([*schema.fields, StructField("hits", rows.select(F.lit(None).cast(HITS)).schema[0].dataType)])
    asked = stages(map_batches(rows, ask, asked_schema), "url-asked")
    possible = asked.where(F.size("hits") > 0)
    # One row per distinct URL and possible rule; copies of a URL combine before the shuffle.
    urls = possible.select("host", "path", F.explode("hits").alias("hit")).groupBy("host", "path", "hit").agg(F.count("*").alias("pages"))
    wanted = stages(urls.select("host", "path", F.col("hit.host").alias("rule_host"), F.col("hit.path").alias("rule_path"), "pages"), "url-possible")
    exact = listed.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    if count <= small_list:
        met = wanted.join(F.broadcast(exact), ["rule_host", "rule_path"])
    else:
        weights = wanted.groupBy("rule_host", "rule_path").agg(F.count("*").alias("urls"))
        met = join_by_weight(wanted, exact.join(weights, ["rule_host", "rule_path"]), ["rule_host", "rule_path"], "urls", "path").drop("urls")
    # Without a rule, as after a false positive, the URL is allowed.
    none = wanted.select("host", "path", "pages", F.lit(None).cast("string").alias("rule_host"), F.lit(None).cast("string").alias("rule_path"), F.lit("allow").alias("verdict"))
    length = F.coalesce(F.length("rule_host") + F.length("rule_path"), F.lit(-1))
    order = F.struct(length.alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("rule"), "verdict", "pages")
    decided = met.unionByName(none).groupBy("host", "path").agg(F.max(order).alias("best"))
    decided = stages(decided.select("host", "path", "best.rule", "best.verdict", "best.pages"), "url-decided")
    # ``page_id`` may be null or repeated: rows of one URL are spread by it only if it is hot.
    ruled = join_by_weight(possible.select("page_id", "host", "path"), decided, ["host", "path"], "pages", "page_id").drop("pages")
    free = asked.where(F.size("hits") == 0)
    allowed = free.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    return stages.result(ruled.unionByName(allowed), "url-verdicts")
