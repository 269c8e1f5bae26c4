"""Sharding by histogram sort: exact bytes below candidate boundaries, refined until splitters fit, one exchange."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, save, worker_state

TOP = 1 << 128


def _keys(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Two unsigned 64-bit columns as 16-byte strings in the order of the pair."""
    out = np.empty((len(high), 2), ">u8")
    out[:, 0], out[:, 1] = high.view(np.uint64), low.view(np.uint64)
    return out.reshape(-1).view("S16")


def _histogram(table: DataFrame, probes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each probe: partial sums in every partition, one row a probe and partition."""
    edges = np.array([p.to_bytes(16, "big") for p in probes], "S16")

    def count(batches):
        size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(edges, _keys(b["__h"].to_numpy(), b["__d"].to_numpy()), "right")
            size += np.bincount(at, b["size"], len(size)).astype(np.int64)
            rows += np.bincount(at, minlength=len(rows))
        at = np.flatnonzero(rows)
        yield pd.DataFrame({"at": at, "size": size[at], "rows": rows[at]})

    got = table.mapInPandas(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size").alias("size"), F.sum("rows").alias("rows")).collect()
    size, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
    for r in got:  # one row a probe
        size[r["at"]], rows[r["at"]] = r["size"], r["rows"]
    return np.cumsum(size)[:-1], np.cumsum(rows)[:-1]


def splitters(table: DataFrame, wanted: list[int], total: int, rows: int, tolerance: int, probes: int = 48, rounds: int = 24) -> dict[int, tuple[int, int]]:
    """Counted boundaries around the `wanted` byte positions: key -> (bytes below, rows below).

    Each round samples keys from the intervals that are still open, by hash, and counts them as
    probes together with the first key of their group of equal texts and the first key after it. An interval closes when an end is within `tolerance` of its aim or it
    holds one row. All that reaches the driver is a few dozen probes for each boundary and round.
    """
    known = {0: (0, 0), TOP - 1: (total, rows)}
    for step in range(rounds):
        keys = sorted(known)
        below = [known[k][0] for k in keys]
        spans = set()
        for aim in wanted:
            i = max(1, min(bisect.bisect_left(below, aim), len(keys) - 1))
            lo, hi = keys[i - 1], keys[i]
            if min(abs(known[lo][0] - aim), abs(known[hi][0] - aim)) > tolerance and known[hi][1] - known[lo][1] > 1 and hi - lo > 1:
                spans.add((lo, hi))
        if not spans:
            break
        inside = sum(known[hi][1] - known[lo][1] for lo, hi in spans)
        share = min(1.0, probes * len(spans) / inside)
        lows = np.array([lo.to_bytes(16, "big") for lo, _ in sorted(spans)], "S16")
        highs = np.array([hi.to_bytes(16, "big") for _, hi in sorted(spans)], "S16")
        limit = int(share * (1 << 63))

        def pick(batches, lows=lows, highs=highs, limit=limit):
            for b in batches:
                k = _keys(b["__h"].to_numpy(), b["__d"].to_numpy())
                at = np.searchsorted(lows, k, "right") - 1
                yield b[(at >= 0) & (k < highs[np.maximum(at, 0)]) & (b["__r"].to_numpy() <= limit)][["__h", "__d"]]

        chance = F.xxhash64("__h", "__d", F.lit(step)).bitwiseAND(F.lit((1 << 63) - 1))
        got = table.withColumn("__r", chance).mapInPandas(pick, "__h long, __d long").distinct().limit(8 * probes * len(spans) + 64).collect()
        new = set()
        for r in got:
            h, d = r["__h"] % (1 << 64), r["__d"] % (1 << 64)
            new |= {(h << 64) + d, (h << 64) + d + 1, h << 64, (h + 1) << 64}
        # A midpoint each keeps the rounds going where a sample finds nothing.
        new |= {(lo + hi) // 2 for lo, hi in spans}
        new = sorted(k for k in new if k < TOP and k not in known)
        if not new:
            break
        size, count = _histogram(table, new)
        known |= {k: (int(s), int(c)) for k, s, c in zip(new, size, count)}
    return known


def _unsigned(*names: str) -> list[Column]:
    """Columns whose signed order is the unsigned one of the keys."""
    return [F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in names]


def _chunks(narrow: DataFrame, bounds: list[int], chunk_bytes: int) -> DataFrame:
    """shard, chunk (numbers inside the shard), first key and the shard's rows before it.

    Keys stand in ranges, each in one task, which starts a chunk with its first key, with each
    shard and after each `chunk_bytes`. Only their rows are added up over the shard.
    """
    edges = np.array([b.to_bytes(16, "big") for b in bounds], "S16")
    schema = pa.schema([("shard", pa.int32()), ("__h", pa.int64()), ("__d", pa.int64()), ("rows", pa.int64())])

    def cut(batches):
        now, used = None, 0  # the open chunk and its bytes
        for b in batches:
            h, d = np.array(b.column("__h")), np.array(b.column("__d"))
            shard = np.searchsorted(edges, _keys(h, d), "right") - 1
            size, rows = (np.concatenate(([0], np.cumsum(np.array(b.column(c))))) for c in ("size", "rows"))
            done, i = [], 0
            while i < len(h):
                if now is None or now[0] != shard[i] or used >= chunk_bytes:
                    done += [now] if now else []
                    now, used = [int(shard[i]), int(h[i]), int(d[i]), 0], 0
                j = min(np.searchsorted(shard, now[0], "right"), np.searchsorted(size, size[i] + chunk_bytes - used))
                now[3] += int(rows[j] - rows[i])
                used += int(size[j] - size[i])
                i = j
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(now, schema)], schema=schema)

    # A row a key, so that equal keys stay together.
    t = narrow.groupBy("__h", "__d").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"))
    t = t.repartitionByRange(partitions(narrow.sparkSession), *_unsigned("__h", "__d")).sortWithinPartitions(*_unsigned("__h", "__d"))
    t = t.mapInArrow(cut, "shard int, __h long, __d long, rows long")
    before = Window.partitionBy("shard").orderBy(*_unsigned("__h", "__d"))
    base = F.coalesce(F.sum("rows").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return save(t.select("shard", (F.row_number().over(before) - 1).alias("chunk"), "__h", "__d", base.alias("base")))


def _edges(uris: list[str]) -> tuple[np.ndarray, ...]:
    """Written chunks in the order of their keys: key, shard, chunk, base. Read once a worker."""
    held = worker_state().__dict__.setdefault("chunks", {})
    name = tuple(uris)
    if name not in held:
        held.clear()
        parts = []
        for uri in uris:
            fs, path = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(path) as f:
                parts.append(pq.ParquetFile(f).read())
        t = pa.concat_tables(parts)
        keys = _keys(t.column("__h").to_numpy(), t.column("__d").to_numpy())
        order = np.argsort(keys)
        held[name] = (keys[order], *(t.column(c).to_numpy()[order] for c in ("shard", "chunk", "base")))
    return held[name]


def shard(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.002, group_tolerance: float = 0.01, chunk_bytes: int = 64 << 20) -> DataFrame:
    """Adds size (UTF-8 bytes of the text, null: none, plus 16), shard, slot and the exchange's chunk (a number inside the shard).

    Rows are sorted by (hash of text, hash of doc_id): shards hold near equal bytes, equal texts
    stand together, and a group of equal texts is only cut where it is larger than the slack
    (`group_tolerance` of a shard). The shards' boundaries are found before any row moves, by counts that reach the driver: a few dozen for each of
    n_shards, whatever the size of the data. Pieces of a shard of about `chunk_bytes` are cut by tasks, from keys alone, and written; then one exchange
    sends each row to its chunk, where the row number plus the
    counted rows before the chunk is the slot, gapless in each shard. Larger data has more chunks in a shard, not larger tasks.

    A null text has size 16 and counts as a text of its own; repeated rows get slots of their own; an empty table gives an empty result.
    Input columns named as the added ones are replaced.
    """
    docs = docs.drop("size", "shard", "slot", "chunk")
    # The copy hash breaks ties of one doc_id and text that stand more than once; equal keys may share a boundary.
    t = docs.select("*", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.xxhash64("text").alias("__h"), F.xxhash64("doc_id", *[c for c in ("lang", "source", "n_chars") if c in docs.columns]).alias("__d"))
    narrow = save(t.select("__h", "__d", "size"))
    sums = narrow.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count(F.lit(1)).alias("rows")).first()
    total, rows = sums["size"], sums["rows"]
    aims = [total * i // n_shards for i in range(1, n_shards)]
    known = splitters(narrow, aims, total, rows, int(tolerance * total / n_shards)) if rows else {0: (0, 0)}
    whole = {k: v for k, v in known.items() if k % (1 << 64) == 0}

    def closest(among: dict[int, tuple[int, int]], aim: int) -> int:
        return min(among, key=lambda k: (abs(among[k][0] - aim), k))

    bounds = [0]
    for aim in aims:
        # One that cuts no group of equal texts, where that is near enough.
        k = closest(whole, aim)
        near = abs(whole[k][0] - aim) <= group_tolerance * total / n_shards
        bounds.append(max(bounds[-1], k if near else closest(known, aim)))
    uris = sorted(_chunks(narrow, bounds, chunk_bytes).inputFiles())

    @F.pandas_udf("chunk int, shard int, base long")
    def place(h: pd.Series, d: pd.Series) -> pd.DataFrame:
        keys, shard, chunk, base = _edges(uris)
        at = np.searchsorted(keys, _keys(h.to_numpy(), d.to_numpy()), "right") - 1
        return pd.DataFrame({"chunk": chunk[at], "shard": shard[at], "base": base[at]})

    t = t.withColumn("__p", place("__h", "__d")).select("*", "__p.chunk", "__p.shard", "__p.base")
    order = Window.partitionBy("shard", "chunk").orderBy(*_unsigned("__h", "__d"), "doc_id")
    t = t.withColumn("slot", F.col("base") + F.row_number().over(order) - 1)
    return t.select(*docs.columns, "size", "shard", "slot", "chunk")


def write_shards(sharded: DataFrame, path: str) -> None:
    """Parquet folders by shard; files inside one follow the chunks, rows the slots."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
