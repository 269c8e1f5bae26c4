"""Removal of byte strings that repeat across documents, by suffix arrays of content-routed shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import files
from .common import Powers, U64, mix64, partitions, save, scratch, small_batches, text_chunks

#: Bytes of the anchors that route windows.
ANCHOR = 16
#: Bytes that a suffix array takes at once; what is larger is cut into several, merged by binary search.
SHARD_BYTES = 512 << 10
LAST = (1 << 63) - 1
#: Bytes of text in a shard of documents, at least and at most, and of runs in a bucket.
SHARD_TEXT, BUCKET, MOST = 8 << 20, 4 << 20, 64 << 20
#: Bytes that a shard sends to a bucket, about: both grow with the root of the data until then.
BLOB_BYTES = 4096
#: Bytes of different runs from which an anchor's windows are dealt out one by one.
HOT_BYTES = 8 << 20
ID = "__doc"


def _words(data: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes at every position as one integer; the text is followed by zero bytes."""
    return np.ndarray((len(data),), order, data.tobytes() + bytes(8), 0, (1,)).astype(U64)


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and its inverse, by Larsson-Sadakane refinement.

    Suffixes are sorted by their first eight bytes; then only groups that are still tied are sorted,
    by the rank of what stands h bytes on, and h doubles.
    """
    n = len(data)
    key = _words(data, ">u8")
    order = np.argsort(key)
    fresh = np.concatenate(([True], key[order][1:] != key[order][:-1])) if n else np.zeros(0, bool)
    # The padding ties with zero bytes of the text; ends are told apart by the rank after them.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    h, todo = 8, np.flatnonzero(~(fresh & np.concatenate((fresh[1:], [True]))))
    while len(todo):
        part = order[todo]
        after = part + h
        k2 = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, n - after)  # a shorter suffix comes first
        k1 = rank[part]
        k2 = k2 - k2.min()
        by = np.argsort(k1 * (int(k2.max()) + 1) + k2)
        part, k1, k2 = part[by], k1[by], k2[by]
        order[todo] = part
        new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
        rank[part] = np.maximum.accumulate(np.where(new, todo, 0))
        todo = todo[~(new & np.concatenate((new[1:], [True])))]
        h *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, most: int, lanes: int = 2048) -> np.ndarray:
    """Common prefix of each suffix in the order with the one before it, up to `most`, by Kasai's rule.

    In text order a prefix shrinks by one byte a step at most. The text is cut into `lanes` stretches that
    step together, and a comparison takes eight bytes.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if not n:
        return out
    words = _words(np.concatenate((data, np.zeros(most + 16, np.uint8))))
    step = -(-n // lanes)
    at = np.arange(0, n, step)
    known = np.zeros(len(at), np.int64)
    for j in range(step):
        p = at + j
        if p[-1] >= n:
            p, at, known = p[p < n], at[p < n], known[p < n]
        r = rank[p]
        before = order[np.maximum(r - 1, 0)]
        room = np.minimum(np.minimum(n - p, n - before), most)
        known = np.minimum(np.maximum(known - 1, 0), room)
        open_ = np.flatnonzero((r > 0) & (known < room))
        while len(open_):
            x = words[p[open_] + known[open_]] ^ words[before[open_] + known[open_]]
            low = x & (~x + U64(1))
            same = np.where(x == 0, 8, np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64) // 8)
            known[open_] = np.minimum(known[open_] + same, room[open_])
            open_ = open_[(same == 8) & (known[open_] < room[open_])]
        known[r == 0] = 0
        out[r] = known
    return out


def window_groups(data: np.ndarray, first: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct windows of `length` bytes in their order: for each byte position its window's number (-1 where no window fits its string), and
    for each number a position of the window and the least owner of any string that holds it.

    `data` holds strings one after another, `first` their starts (n + 1), `owner` a number for each.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, rank = suffix_array(data)
    start = np.flatnonzero(common_prefixes(data, order, rank, length) < length)
    del rank
    size = np.diff(first)
    fits = np.arange(n) + length <= np.repeat(first[1:], size)
    least = np.minimum.reduceat(np.where(fits, np.repeat(owner, size), LAST)[order], start)
    head = np.maximum.reduceat(np.where(fits[order], order, -1), start)
    some = head >= 0
    number = np.where(some, np.cumsum(some) - 1, -1).astype(np.int32)
    group = np.empty(n, np.int32)
    group[order] = np.repeat(number, np.diff(np.concatenate((start, [n]))))
    return np.where(fits, group, np.int32(-1)), head[some], least[some]


def window_owners(data: np.ndarray, first: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each byte position: the least owner of any string that holds the window starting there; LAST where no window fits its string."""
    group, _, least = window_groups(data, first, owner, length)
    return np.append(least, LAST)[group]


def _places(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of b's windows in a's, both (bytes, positions in the windows' order): the first of a's that isn't smaller, and whether it is equal."""
    (x, at), (y, want) = ((np.ndarray((len(d),), ">u8", d.tobytes() + bytes(8), 0, (1,)), p) for d, p in (a, b))
    # The last eight bytes overlap those before.
    steps = [*range(0, length - 8, 8), length - 8]
    lo, hi = np.zeros(len(want), np.int64), np.full(len(want), len(at))
    equal = np.zeros(len(want), bool)
    todo = np.flatnonzero(lo < hi)
    while len(todo):
        mid = (lo[todo] + hi[todo]) >> 1
        p, q = at[mid], want[todo]
        smaller, open_ = np.zeros(len(todo), bool), np.arange(len(todo))
        for k in steps:
            u, v = x[p[open_] + k], y[q[open_] + k]
            smaller[open_] = u < v
            open_ = open_[u == v]
            if not len(open_):
                break
        equal[todo[open_]] = True
        lo[todo] = np.where(smaller, mid + 1, lo[todo])
        hi[todo] = np.where(smaller, hi[todo], mid)
        todo = todo[lo[todo] < hi[todo]]
    return lo, equal


def merge_owners(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], length: int) -> list[np.ndarray]:
    """Least owners of several shards' distinct windows over all shards.

    A shard is (bytes, a position of each distinct window in the windows' order, their least owners). Shards merge two by two: binary search
    finds the place of one's windows among the other's, so that only numbers are held besides the bytes.
    """
    nodes = [(*p, [np.arange(len(p[1]))]) for p in parts]
    while len(nodes) > 1:
        merged = [_merge(a, b, length) for a, b in zip(nodes[::2], nodes[1::2])]
        nodes = merged + nodes[2 * len(merged) :]
    _, _, least, where = nodes[0]
    return [least[w] for w in where]


def _merge(a: tuple, b: tuple, length: int) -> tuple:
    """Two shards as one; the last of each tuple tells where the windows of the shards that it was made of stand in it."""
    (x, at, own, where), (y, want, other, elsewhere) = a, b
    place, equal = _places((x, at), (y, want), length)
    own = own.copy()
    own[place[equal]] = np.minimum(own[place[equal]], other[equal])
    fresh = place[~equal]
    mine = np.arange(len(at)) + np.searchsorted(fresh, np.arange(len(at)), "right")
    theirs = np.empty(len(want), np.int64)
    theirs[~equal] = fresh + np.arange(len(fresh))
    theirs[equal] = mine[place[equal]]
    head, least = np.empty(len(at) + len(fresh), np.int64), np.empty(len(at) + len(fresh), np.int64)
    head[theirs], least[theirs] = want + len(x), other
    head[mine], least[mine] = at, own
    return np.concatenate((x, y)), head, least, [mine[w] for w in where] + [theirs[w] for w in elsewhere]


def anchored_runs(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: text, first byte, end byte (all windows' bytes), anchor.

    A window's anchor is the least hash of the ANCHOR-byte strings in it, so equal windows have equal
    anchors wherever they stand.
    """
    n, size = len(data), np.diff(offsets)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none.astype(U64)
    w = _words(data)
    h = mix64(w[: n - ANCHOR + 1] * U64(0x9E3779B97F4A7C15) + mix64(w[8 : n - ANCHOR + 9]))
    width, have = length - ANCHOR + 1, 1
    while have < width:
        by = min(have, width - have)
        h, have = np.minimum(h[:-by], h[by:]), have + by
    text = np.repeat(np.arange(len(size)), size)
    ok = np.arange(n - length + 1) + length <= offsets[1:][text[: n - length + 1]]
    change = h[1:] != h[:-1]
    start = np.flatnonzero(ok & np.concatenate(([True], ~ok[:-1] | change)))
    end = np.flatnonzero(ok & np.concatenate((~ok[1:] | change, [True]))) + length
    # Least hashes crowd near 0; mixed once more, their leading bits spread them over buckets.
    return text[start], start, end, mix64(h[start])


def _pieces(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of a byte array, one after another."""
    first = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(first[-1], np.uint8)
    for lo, hi in _blocks(first):
        n = size[lo:hi]
        out[first[lo] : first[hi]] = data[np.repeat(start[lo:hi] - first[lo:hi], n) + np.arange(first[lo], first[hi])]
    return out


def _blocks(first: np.ndarray, most: int = 1 << 18):
    """Ranges of stretches of about `most` bytes together; `first` has their starts (n + 1)."""
    lo, n = 0, len(first) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def _equal_runs(data: np.ndarray, start: np.ndarray, size: np.ndarray, h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each run: the place of the one that stands for it, of least doc among the runs of its bytes.

    The hash only proposes; runs are compared byte by byte, and one that differs stands for itself.
    """
    if not len(h):
        return np.zeros(0, np.int64)
    by = np.lexsort((doc, h))
    new = np.concatenate(([True], h[by][1:] != h[by][:-1]))
    head = np.empty(len(h), np.int64)
    head[by] = by[new][np.cumsum(new) - 1]
    same = size == size[head]
    at = np.flatnonzero(same & (head != np.arange(len(h))))
    first = np.concatenate(([0], np.cumsum(size[at])))
    for lo, hi in _blocks(first):
        r = at[lo:hi]
        differ = _pieces(data, start[r], size[r]) != _pieces(data, start[head[r]], size[r])
        same[r] = np.add.reduceat(differ, first[lo:hi] - first[lo], dtype=np.int64) == 0
    return np.where(same, head, np.arange(len(h)))


def pack_shards(docs: DataFrame, most: int = SHARD_TEXT) -> DataFrame:
    """shard and blob: documents in runs of about `most` bytes, each one compressed row, written once.

    Later steps come back to the same shard by its number, and keep what they know of it in a file of that
    name in the shared folder, so that texts never move.
    """

    def pack(batches):
        number = TaskContext.get().partitionId() << 24

        def row(parts):
            nonlocal number
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, parts[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for p in parts:
                    out.write_batch(p)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["shard", "blob"])

        held, size = [], 0
        for batch in batches:
            for lo, hi, data, _ in text_chunks(batch.column("text"), min(most, 1 << 18)):
                if held and size + len(data) > most:
                    yield row(held)
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
        if held:
            yield row(held)

    return save(docs.mapInArrow(pack, "shard long, blob binary"))


def _open(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_all().combine_chunks().to_batches()[0]


def _runs(batch: pa.RecordBatch, length: int, powers: Powers):
    """Runs of a shard: row, doc_id, first byte in the text, bytes, anchor, hash, and the bytes of each run one after another."""
    ids, runs = batch.column(ID).to_numpy(), []
    for lo, _, data, offsets in text_chunks(batch.column("text")):
        text, start, end, anchor = anchored_runs(data, offsets, length)
        if len(start):
            h = powers.spans(powers.prefix(data), start, end)
            runs.append((lo + text, ids[lo + text], start - offsets[text], end - start, anchor, h, data, start))
    return runs


def _anchors(shards: DataFrame, length: int, bits: int, folder: str, hot: int) -> None:
    """Writes for each shard which of its distinct anchors (cut to 32 + bits bits, in order) other shards have too: a byte each, 2 for a hot one.

    Only distinct cut anchors move, five bytes each (the fifth tells the magnitude of their different runs' bytes), in one blob for a shard and
    bucket; a false match of cut anchors only costs work. An anchor of more than `hot` bytes of runs in all is hot.
    """

    def send(batches):
        powers = Powers()
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist()):
                runs = _runs(_open(blob), length, powers)
                every, size, h = (np.concatenate([np.zeros(0, t), *(r[k] for r in runs)]) for k, t in ((4, U64), (3, np.int64), (5, U64)))
                a, at = np.unique(every >> U64(32 - bits), return_inverse=True)
                one = np.unique(h, return_index=True)[1]
                magnitude = np.ceil(np.log2(np.bincount(at[one], size[one], len(a)) + 1)).astype(np.uint8)
                bucket = (a >> U64(32)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(a) else np.zeros(0, np.int64)
                parts = [x.astype(np.uint32).tobytes() + m.tobytes() for x, m in zip(np.split(a, cut[1:]), np.split(magnitude, cut[1:]))] if len(a) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut]), pa.array(np.full(len(cut), shard)), pa.array(parts, pa.binary())], names=["bucket", "shard", "anchors"])

    def shared(table: pa.Table) -> pa.Table:
        blobs = table.column("anchors").to_pylist()
        parts = [np.frombuffer(x, np.uint32, len(x) // 5) for x in blobs]
        value, at, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        total = np.bincount(at, np.concatenate([2.0 ** np.frombuffer(x, np.uint8, offset=4 * (len(x) // 5)) for x in blobs]), len(value))
        kind = ((count > 1) + ((count > 1) & (total > hot))).astype(np.uint8)
        masks = [kind[np.searchsorted(value, p)].tobytes() for p in parts]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "mask": pa.array(masks, pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        files.write(f"{folder}/{table.column('shard')[0].as_py()}.mask", table.column("mask").to_pylist())
        return table.select(["shard"]).slice(0, 1)

    sent = shards.mapInArrow(send, "bucket long, shard long, anchors binary").repartition(1 << bits, "bucket")
    masks = sent.groupBy("bucket").applyInArrow(shared, "shard long, bucket long, mask binary")
    masks.repartition(partitions(shards.sparkSession), "shard").groupBy("shard").applyInArrow(keep, "shard long").count()


BLOB = pa.schema([("bucket", pa.int64()), ("runs", pa.bool_()), ("shard", pa.int64()), ("blob", pa.binary())])


def _local(batches, length: int, bits: int, folder: str):
    """Runs whose anchor is shared: spans that a smaller document of the same shard covers by an equal run, and the other runs by bucket.

    Both go as compressed blobs of arrays, so that the exchange moves few rows.
    """
    powers, zip_ = Powers(), zstandard.ZstdCompressor(level=3)
    for b in batches:
        for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist()):
            runs = _runs(_open(blob), length, powers)
            if not runs:
                continue
            row, doc, start, size, anchor, h = (np.concatenate([r[k] for r in runs]) for k in range(6))
            cut, at = np.unique(anchor >> U64(32 - bits), return_inverse=True)
            mask = np.array(files.mapped(f"{folder}/{shard}.mask", "u1"))
            if len(mask) != len(cut):
                raise ValueError("a shard's anchors differ from those that were counted")
            # Anchors that several documents of this shard have.
            low, high = np.full(len(cut), LAST), np.full(len(cut), -LAST)
            np.minimum.at(low, at, doc)
            np.maximum.at(high, at, doc)
            ok = ((mask > 0) | (low < high))[at]
            hot = mask[at[ok]] == 2
            data = np.concatenate([_pieces(r[6], r[7][k], r[3][k]) for r, k in zip(runs, np.split(ok, np.cumsum([len(r[0]) for r in runs])[:-1]))])
            del runs, at, low, high
            row, doc, start, size, anchor, h = (x[ok] for x in (row, doc, start, size, anchor, h))
            first = np.concatenate(([0], np.cumsum(size)))
            head = _equal_runs(data, first[:-1], size, h, doc)
            least = doc[head]
            covered = np.flatnonzero(doc > least)
            rows = []
            if len(covered):
                rows.append((shard % (1 << bits), False, _span_blob(row[covered], start[covered], (start + size)[covered])))
            rest = np.flatnonzero((doc == least) & ~hot)
            # A hot anchor's windows become runs of their own, whose anchor is their content's hash, so that they spread over all buckets.
            wide = np.flatnonzero((doc == least) & hot)
            if len(wide):
                n = size[wide] - length + 1
                run, add = np.repeat(wide, n), np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)[:-1])), n)
                at, own = first[run] + add, np.empty(len(run), U64)
                for lo in range(0, len(at), 1 << 16):
                    piece = _pieces(data, at[lo : lo + (1 << 16)], np.full(len(at[lo : lo + (1 << 16)]), length))
                    edge = np.arange(0, len(piece) + 1, length)
                    own[lo : lo + (1 << 16)] = powers.spans(powers.prefix(piece), edge[:-1], edge[1:])
                row, doc, start, first, size, anchor = (np.concatenate(x) for x in ((row, row[run]), (doc, doc[run]), (start, start[run] + add), (first[:-1], at), (size, np.full(len(run), length)), (anchor, mix64(own))))
                rest = np.concatenate((rest, np.arange(len(h), len(row))))
            bucket = (anchor[rest] >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(rest), np.int64)
            by = np.argsort(bucket, kind="stable")
            rest, bucket = rest[by], bucket[by]
            edge = np.concatenate((np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))), [len(rest)])) if len(rest) else [0]
            for lo, hi in zip(edge[:-1], edge[1:]):
                r = rest[lo:hi]
                head = np.array([len(r)], "<i8").tobytes() + doc[r].astype("<i8").tobytes() + b"".join(x[r].astype("<i4").tobytes() for x in (row, start, size)) + (anchor[r] >> U64(max(0, 32 - bits))).astype("<u4").tobytes()
                rows.append((int(bucket[lo]), True, zip_.compress(head + _pieces(data, first[r], size[r]).tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([shard] * len(rows), pa.int64()), pa.array([r[2] for r in rows], pa.binary())], schema=BLOB)


def _span_blob(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    by = np.lexsort((start, row))
    return zstandard.ZstdCompressor(level=3).compress(np.concatenate((row[by], start[by], end[by])).astype("<i4").tobytes())


def _bucket_spans(blobs: list[tuple[int, bytes]], length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (shard, row, start, end) of one bucket's runs that hold windows of a smaller document, a range of anchors after another."""
    parts, unzip = [], zstandard.ZstdDecompressor()
    for shard, blob in blobs:
        raw = unzip.decompress(blob)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        doc, row, start, size, anchor = (np.frombuffer(raw, t, n, 8 + o * n) for t, o in (("<i8", 0), ("<i4", 8), ("<i4", 12), ("<i4", 16), ("<u4", 20)))
        parts.append((doc, start.astype(np.int64), size.astype(np.int64), anchor, np.full(n, shard), row, np.frombuffer(raw, np.uint8, offset=8 + 24 * n)))
    doc, start, size, anchor, shard, row, data = (np.concatenate([p[k] for p in parts]) for k in range(7))
    del parts
    first = np.concatenate(([0], np.cumsum(size)))[:-1]
    by = np.lexsort((doc, anchor))
    new = np.flatnonzero(np.concatenate(([True], anchor[by][1:] != anchor[by][:-1])))
    count = np.diff(np.concatenate((new, [len(by)])))
    # Anchors of one document need nothing.
    by = by[np.repeat(doc[by][new] != doc[by][new + count - 1], count)]
    spans = [(np.zeros(0, np.int64),) * 4]
    a = anchor[by]
    edge = np.concatenate((np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))), [len(by)])) if len(by) else np.zeros(1, np.int64)
    upto = np.concatenate(([0], np.cumsum(size[by])))[edge]
    for lo, hi in _blocks(upto, piece):
        r = by[edge[lo] : edge[hi]]
        spans.append(_spans(doc[r], start[r], size[r], anchor[r], shard[r], row[r], _pieces(data, first[r], size[r]), length, piece))
    return tuple(np.concatenate(x) for x in zip(*spans))


def _spans(doc: np.ndarray, start: np.ndarray, size: np.ndarray, anchor: np.ndarray, shard: np.ndarray, row: np.ndarray, data: np.ndarray, length: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the runs of a range of anchors. Equal runs count once, with their least document; the others of them are covered whole."""
    first, powers, h = np.concatenate(([0], np.cumsum(size))), Powers(), np.empty(len(doc), U64)
    for lo, hi in _blocks(first, 1 << 20):
        h[lo:hi] = powers.spans(powers.prefix(data[first[lo] : first[hi]]), first[lo:hi] - first[lo], first[lo + 1 : hi + 1] - first[lo])
    head = _equal_runs(data, first[:-1], size, h, doc)
    least = doc[head]
    whole = doc > least
    spans = [(shard[whole], row[whole], start[whole], (start + size)[whole])]
    one = np.unique(head)  # an entry for each distinct run
    # An anchor whose runs are all equal is done: nothing else holds their windows.
    a = anchor[one]
    by = np.argsort(a, kind="stable")
    single = np.concatenate(([True], a[by][1:] != a[by][:-1])) & np.concatenate((a[by][1:] != a[by][:-1], [True]))
    open_ = np.sort(one[by[~single]])
    found = []
    for lo, hi in _blocks(np.concatenate(([0], np.cumsum(size[open_]))), piece):
        r = open_[lo:hi]
        text = _pieces(data, first[r], size[r])
        begin = np.concatenate(([0], np.cumsum(size[r])))
        found.append((text, *window_groups(text, begin, least[r], length), begin, r))
    owners = merge_owners([(f[0], f[2], f[3]) for f in found], length) if len(found) > 1 else [f[3] for f in found]
    mine = np.flatnonzero(~whole)
    mine = mine[np.argsort(head[mine], kind="stable")]
    for (_, group, _, _, begin, r), own in zip(found, owners):
        # Windows of a run that a smaller document holds, for every entry of the run's least document.
        windows = np.flatnonzero(group >= 0)
        run = np.searchsorted(begin, windows, "right") - 1
        hit = own[group[windows]] < least[r][run]
        run, offset = run[hit], (windows - begin[run])[hit]
        if not len(run):
            continue
        new = np.concatenate(([True], (run[1:] != run[:-1]) | (offset[1:] > offset[:-1] + 1)))
        s, e = offset[new], offset[np.concatenate((new[1:], [True]))] + length
        g = r[run[new]]
        lo, hi = np.searchsorted(head[mine], g, "left"), np.searchsorted(head[mine], g, "right")
        many = hi - lo
        which = mine[np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
        spans.append((shard[which], row[which], start[which] + np.repeat(s, many), start[which] + np.repeat(e, many)))
    return tuple(np.concatenate(x) for x in zip(*spans))


def _write_spans(shards: DataFrame, length: int, bits: int, folder: str, piece: int) -> None:
    """Writes for each shard the spans (row, start, end) of windows that a document of a smaller doc_id holds; they may overlap."""
    spark = shards.sparkSession

    def merge(table: pa.Table) -> pa.Table:
        runs, shard_of, blobs = [], [], []
        for is_run, shard, blob in zip(*(table.column(c).to_pylist() for c in ("runs", "shard", "blob"))):
            if is_run:
                runs.append((shard, blob))
            else:
                shard_of.append(shard)
                blobs.append(blob)
        if runs:
            shard, row, s, e = _bucket_spans(runs, length, piece)
            by = np.argsort(shard, kind="stable")
            shard, row, s, e = shard[by], row[by], s[by], e[by]
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(shard) else []
            for lo, hi in zip(cut, [*cut[1:], len(shard)]):
                shard_of.append(int(shard[lo]))
                blobs.append(_span_blob(row[lo:hi], s[lo:hi], e[lo:hi]))
        return pa.table({"shard": pa.array(shard_of, pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def keep(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        parts = [np.frombuffer(unzip.decompress(x), "<i4").reshape(3, -1) for x in table.column("blob").to_pylist() if x is not None]
        both = np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), "<i4")
        files.write(f"{folder}/{table.column('shard')[0].as_py()}.spans", [np.ascontiguousarray(both[:, np.lexsort((both[1], both[0]))]).tobytes()])
        return table.select(["shard"]).slice(0, 1)

    sent = shards.mapInArrow(lambda it: _local(it, length, bits, folder), "bucket long, runs boolean, shard long, blob binary").repartition(1 << bits, "bucket")
    spans = sent.groupBy("bucket").applyInArrow(merge, "shard long, blob binary")
    # Every shard gets a file, so that a missing one is an error.
    spans = spans.union(shards.select("shard", F.lit(None).cast("binary")))
    spans.repartition(partitions(spark), "shard").groupBy("shard").applyInArrow(keep, "shard long").count()


def remove_repeats(docs: DataFrame, length: int = 50, piece: int = SHARD_BYTES, hot: int = HOT_BYTES, characters: bool = False) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and kept (the bytes left, in order) to every row.

    A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller
    doc_id; all strings are judged on the input; with `characters`, a character that loses a byte goes whole. Documents are packed into shards that stay where they are. Windows are routed by an
    anchor in their own content, so equal windows of any documents meet in one bucket; anchors that stand in one document only are
    found first and send nothing. A bucket takes a range of anchors after another: equal runs (compared byte by byte) count once, the distinct ones are sorted by a
    suffix array, Kasai prefixes of at least `length` bytes join equal windows, and what is beyond `piece` bytes is cut into shards whose windows are found in
    each other by binary search. An anchor with more than `hot` bytes of different surroundings is dealt out by its windows' content. Shards and buckets grow with the
    root of the data up to MOST bytes, so that what a shard sends to a bucket stays a few kilobytes up to about 1 TB.

    Null and empty texts have no bytes and stay. A null doc_id counts as larger than all others. Rows of one doc_id never cover
    each other. Texts shorter than `length` are untouched; a length outside 17 to 2^16 is refused; an empty
    table gives an empty result. Input columns named as the added ones are replaced.
    """
    if not ANCHOR < length <= 1 << 16:
        raise ValueError("length must be 17 to 65536 bytes")
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    root = min(MOST, int((total * BLOB_BYTES) ** 0.5))
    bits = int(max(partitions(spark), total // max(BUCKET, root)) - 1).bit_length()
    shards, folder = pack_shards(docs.withColumn(ID, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))), max(SHARD_TEXT, root)), scratch(spark)
    _anchors(shards, length, bits, folder, hot)
    _write_spans(shards, length, bits, folder, piece)
    names = docs.columns
    schema = StructType(list(docs.schema.fields)).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def cut(batches):
        for b in batches:
            for shard, blob in zip(b.column("shard").to_pylist(), b.column("blob").to_pylist()):
                batch = _open(blob)
                row, s, e = np.array(files.mapped(f"{folder}/{shard}.spans", "<i4")).reshape(3, -1)
                at, out = np.searchsorted(row, np.arange(batch.num_rows + 1)), []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    edge = np.zeros(len(data) + 1, np.int64)
                    np.add.at(edge, s[at[i] : at[i + 1]], 1)
                    np.subtract.at(edge, e[at[i] : at[i + 1]], 1)
                    gone = np.cumsum(edge)[:-1] > 0
                    if characters and gone.any():
                        number = np.cumsum((data & 0xC0) != 0x80)
                        cut_up = np.zeros(number[-1] + 1, bool)
                        cut_up[number[gone]] = True
                        gone = cut_up[number]
                    begins = gone & ~np.concatenate(([False], gone[:-1])) if len(data) else gone
                    out.append((len(data), int(gone.sum()), int(begins.sum()), data[~gone].tobytes()))
                new = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new], names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    return shards.mapInArrow(cut, schema)
