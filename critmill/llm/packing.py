"""Best-fit packing by minimum bin slack over the histogram of piece lengths."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, save, small_batches
from .tokens import WordEncoder


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Encoded documents cut at `capacity`: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (little-endian 32-bit)."""

    def cut(batches):
        encoder, end = WordEncoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows = {name: [] for name in schema.names}
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encoder.encode(text or "") + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    values = (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)
                    for name, v in zip(schema.names, values):
                        rows[name].append(v)
            yield pa.RecordBatch.from_pydict(rows, schema)

    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(available: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to `room`: bit s of `reach` says that sum s is feasible."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in order:
        if length > room or not available[length]:
            continue
        steps.append((length, reach))
        left, block = min(available[length], room // length), 1
        while left:
            take = min(block, left)
            reach |= reach << (length * take) & mask
            left, block = left - take, block * 2
        if reach >> room & 1:
            break
    best, used = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> best & 1:
            best, n = best - length, n + 1
        if n:
            used[length] = n
    return used


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bins as (how many of them, {length: pieces of it in each}).

    Each bin starts from the largest length left; subset sums over the other lengths find the fullest
    feasible combination, which is removed as often as the counts allow, since the same search would find it
    again. Every removal uses up a length or leaves it too few, so there are few thousand kinds of bins however many pieces there are.
    """
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        largest = max(left)
        left[largest] -= 1
        used = fullest(left, sorted(left, reverse=True), capacity - largest)
        left[largest] += 1
        used[largest] = used.get(largest, 0) + 1
        times = min(left[n] // k for n, k in used.items())
        plan.append((times, used))
        for n, k in used.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
    return plan


def pack(parts: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to pieces of 1 to `capacity` tokens; columns of these names are replaced.

    The plan needs the histogram of lengths only (`capacity` counts reach the driver, whatever the
    data's size). Pieces are then numbered in order of length by one distributed rank, and the
    n-th piece of a length takes the n-th place that the plan has for it. Rows that are equal are pieces of their own; an empty table gives
    an empty result.
    """
    parts = save(parts.drop("sequence_id", "offset"))  # else the range exchange's sampling would encode all texts once more
    t = ranked(parts, [F.col("length"), F.xxhash64("doc_id", "piece"), F.col("doc_id"), F.col("piece")], "__rank")
    counts = {r["length"]: r["count"] for r in t.groupBy("length").count().collect()}
    base, at = {}, 0
    for n in sorted(counts):
        base[n], at = at, at + counts[n]
    rows, first = [], 0
    for times, used in minimum_bin_slack(counts, capacity):
        offset = 0
        for n in sorted(used, reverse=True):
            rows.append((base[n], used[n], first, offset, n))
            base[n] += times * used[n]
            offset += n * used[n]
        first += times
    # Start of a run of ranks, pieces of it in a bin, first bin, offset in the bin, length.
    start, per, bins, offset, size = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    @F.pandas_udf("sequence_id long, offset long")
    def place(rank: pd.Series) -> pd.DataFrame:
        r = rank.to_numpy()
        k = np.searchsorted(start, r, "right") - 1
        i = r - start[k]
        return pd.DataFrame({"sequence_id": bins[k] + i // per[k], "offset": offset[k] + i % per[k] * size[k]})

    return t.withColumn("__p", place("__rank")).select(*parts.columns, "__p.sequence_id", "__p.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences from pieces with ids: sequence_id and its ids; at most `capacity` of them meet in a row."""
    whole = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.array_join(F.transform(whole, lambda x: F.hex(x["ids"])), "").alias("__ids")).select("sequence_id", F.unhex("__ids").alias("ids"))
