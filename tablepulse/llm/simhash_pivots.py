"""Near-duplicate groups by 64-bit SimHash, candidates from a table of distances to pivots.

A fingerprint x is laid out in five blocks. For sixteen fixed reference fingerprints (pivots) the table holds the
Hamming distance of every block of x to that block of the pivot; their sums over the blocks are the distances to
the whole pivots. Two fingerprints that differ in at most three bits leave two blocks or more untouched, so their
partial distances to all pivots are the same there: rows that agree on the partial distances of two blocks (ten
pairs of blocks) are the only candidates, and no such pair is missed. Of those, pairs whose distances to a
whole pivot differ by more than three are discarded (the triangle inequality), and the rest are compared bit by bit.

Fingerprints are grouped first, so copies count once. A group of candidates over GROUP_LIMIT is dealt again: its free
bits are cut in four, of which at least one part is equal in any linked pair, until the groups are small enough.
Twelve free bits allow only 4,096 fingerprints, so this ends. A group gives the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepulse.llm.common import Forest, components, cut, map_texts, table, worker_state

SHINGLE, RADIUS, GROUP_LIMIT = 3, 3, 4096
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: XXH64 of the pivot's number: fixed, evenly spread references.
PIVOTS = tuple(xxhash.xxh64_intdigest(b"pivot %d" % i, 42) for i in range(16))
_PIVOTS = np.array(PIVOTS, dtype=np.uint64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = SHINGLE) -> tuple[int, int]:
    """(fingerprint as a signed long, number of shingles) of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0, 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    total, n = np.zeros(64, dtype=np.int64), len(grams)
    for at in range(0, n, 65536):
        part = grams[at : at + 65536]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(42)), dtype=np.uint64, count=len(part))
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return signed(sum(1 << i for i in np.flatnonzero(2 * total > n).tolist())), n


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint long, n_shingles) of every document; a null or blank text has fingerprint zero."""

    def run(keys: list, texts: list[bytes]) -> dict[str, list]:
        worker_state("fingerprints", dict)  # none, but what another operator has left goes
        found = [fingerprint(x) for x in texts]
        return {"doc_id": keys, "fp": [x[0] for x in found], "n_shingles": [x[1] for x in found]}

    return map_texts(docs, run, "doc_id long, fp long, n_shingles long")


def _partial(fp: Column, block: int) -> Column:
    """Distances of a block to the sixteen pivots, four bits each."""
    start, width = BLOCKS[block]
    mask = (1 << width) - 1
    out = F.lit(0).cast("long")
    for i, pivot in enumerate(PIVOTS):
        d = F.bit_count(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(pivot >> start & mask))).cast("long")
        out = out.bitwiseOR(F.shiftleft(d, 4 * i))
    return out


def _spread(mask: int, parts: int = 4) -> list[int]:
    """The free bits outside mask in parts, each added to mask."""
    free = [i for i in range(64) if not mask >> i & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[cuts[i] : cuts[i + 1]]) for i in range(parts)]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each group of candidates."""
    out_a: list[int] = []
    out_b: list[int] = []
    for batch in batches:
        for group in batch.column(0):
            x = np.unique(np.asarray(group.values, dtype=np.int64)).view(np.uint64)
            distances = np.bitwise_count(x[:, None] ^ _PIVOTS[None, :]).astype(np.int8)
            order = np.argsort(distances[:, 0], kind="stable")
            x, distances = x[order], distances[order]
            upto = np.searchsorted(distances[:, 0], distances[:, 0] + RADIUS, side="right")
            forest = Forest()
            for i in range(len(x) - 1):
                stop = int(upto[i])
                if stop <= i + 1:
                    continue
                near = np.flatnonzero(np.abs(distances[i + 1 : stop] - distances[i]).max(axis=1) <= RADIUS) + i + 1
                if len(near):
                    near = near[np.bitwise_count(x[near] ^ x[i]) <= RADIUS]
                for j in near.tolist():
                    a, b = signed(int(x[i])), signed(int(x[j]))
                    if forest.join(a, b):
                        out_a.append(a)
                        out_b.append(b)
        if len(out_a) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])
            out_a, out_b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def links(distinct: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) within RADIUS bits, enough of them to keep every group together."""
    tables = list(combinations(range(len(BLOCKS)), 2))
    masks = [sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in pair) for pair in tables]
    with_parts = distinct.select("fp", *(_partial(F.col("fp"), b).alias(f"d{b}") for b in range(len(BLOCKS))))
    rows = with_parts.select("fp", F.explode(F.array(*(F.struct(F.lit(signed(m)).alias("mask"), F.col(f"d{i}").alias("k1"), F.col(f"d{j}").alias("k2")) for m, (i, j) in zip(masks, tables, strict=True)))).alias("t")).select("fp", "t.*")
    key, found = ["mask", "k1", "k2"], []
    while masks:
        large = rows.groupBy(*key).count().where(F.col("count") > group_limit).drop("count")
        any_large = large.count() > 0
        if any_large:
            large = cut(large)
        small = rows.join(large, key, "left_anti") if any_large else rows
        groups = small.groupBy(*key).agg(F.collect_list("fp").alias("group")).where(F.size("group") > 1).select("group")
        found.append(groups.mapInArrow(_links, "a long, b long"))
        if not any_large:
            break
        finer = {m: _spread(m) for m in dict.fromkeys(masks)}
        step = distinct.sparkSession.createDataFrame([(signed(m), [signed(x) for x in parts]) for m, parts in finer.items()], "mask long, finer array<long>")
        rows = cut(rows.join(large, key, "left_semi").join(step, "mask").select("fp", F.explode("finer").alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("k1"), F.lit(0).cast("long").alias("k2")).distinct())
        masks = [x for parts in finer.values() for x in parts]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable), n_shingles.

    Text null, empty or blank: fingerprint zero, linked like any other. Repeated doc_ids: each row stays, with one
    component. A null doc_id stays a row; its component is that of the group's smallest id, or null. Empty table: no rows."""
    prints = cut(fingerprints(docs))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), prints.count())
    tied = components(links(distinct), distinct.count())
    nodes = distinct.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    # written out, so that both sides of the join are dealt anew and a frequent component's rows can be split
    of = cut(nodes.groupBy("component").agg(F.min("least").alias("component_id")))
    by_print = nodes.join(of, "component").select("fp", "component_id")
    joined = prints.join(by_print, "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_shingles")


def op3_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
