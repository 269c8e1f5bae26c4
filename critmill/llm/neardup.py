"""Near-duplicates by a chosen-path set similarity join over minwise tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Powers, U64, drop_saved, lower_ascii, save, shingle_hashes, small_batches, text_chunks, word_hashes
from .graph import components

#: Minwise values of a document; the first TREES * BRANCHES choose its root branches, the others those of large nodes.
VALUES, TREES, BRANCHES = 64, 5, 2
#: Bands of so many of the other values; sets that share one are held against one of them before the trees are walked.
BANDS, WIDTH = 6, 6
#: Minwise values of which a byte each is compared inside nodes.
BYTES = 256
#: Nodes of at most so many sets are compared exhaustively, in one task.
SMALL = 2048
#: Larger nodes branch, so many times at most; what is still large is cut into tiles.
DEPTH = 3
#: Nearest partners of a component in a node that are confirmed before all others.
NEAREST = 3
#: Bytes of whole texts that meet in one task.
SLICE = 64 << 20


def _sets(column: pa.Array, size: int, powers: Powers):
    """The distinct shingle hashes of each text in turn, sorted."""
    for lo, hi, data, offsets in text_chunks(column):
        words, first = word_hashes(lower_ascii(data), offsets, powers)
        h, at = shingle_hashes(words, first, size)
        for i in range(hi - lo):
            yield np.unique(h[at[i] : at[i + 1]])


def _node(s: np.ndarray) -> int | None:
    """A signed 64-bit name for a set; none for an empty one."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (distinct shingles), node (name of the set; null where empty), sig (VALUES minwise values), low (a byte of each of BYTES values) and bytes of the text."""
    rnd = np.random.default_rng(20240229)
    c, d = (rnd.integers(0, 1 << 32, BYTES, dtype=np.uint32) for _ in range(2))
    c |= np.uint32(1)
    a, b = rnd.integers(0, 1 << 63, VALUES, dtype=U64) * U64(2) + U64(1), rnd.integers(0, 1 << 63, VALUES, dtype=U64)

    def sign(batches):
        powers = Powers()
        for batch in batches:
            n, nodes, sigs, lows, held, held_n = [], [], [], [], [], 0

            def flush():
                if not held:
                    return
                x = np.concatenate(held)
                at = np.concatenate(([0], np.cumsum([len(s) for s in held])[:-1]))
                out = np.empty((len(held), VALUES), np.uint32)
                for j in range(VALUES):
                    out[:, j] = np.minimum.reduceat((x * a[j] + b[j]) >> U64(32), at)
                sigs.append(out.view(np.int32))
                low, x = np.empty((len(held), BYTES), np.uint8), (x >> U64(20)).astype(np.uint32)
                for j in range(BYTES):
                    low[:, j] = np.minimum.reduceat(x * c[j] + d[j], at) & np.uint32(255)
                lows.extend(r.tobytes() for r in low)

            for s in _sets(batch.column("text"), size, powers):
                n.append(len(s))
                nodes.append(_node(s))
                if len(s):
                    held.append(s)
                    held_n += len(s)
                if held_n > 200_000:
                    flush()
                    held, held_n = [], 0
            flush()
            n = np.array(n, np.int64)
            flat = np.concatenate(sigs) if sigs else np.zeros((0, VALUES), np.int32)
            offsets = np.concatenate(([0], np.cumsum((n > 0) * VALUES))).astype(np.int32)
            low = iter(lows)
            low = pa.array([next(low) if k else None for k in n], pa.binary())
            size_ = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(offsets, flat.reshape(-1)), low, size_], names=["doc_id", "n", "node", "sig", "low", "bytes"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n long, node long, sig array<int>, low binary, bytes long")


def _texts(docs: DataFrame, sets: DataFrame, names: DataFrame) -> DataFrame:
    """node and text of the named sets: names are broadcast where few, joined by shuffle beyond."""
    wanted = save(names.distinct().join(sets.select("node", "doc_id").hint("merge"), "node"))
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted.hint("merge")
    return save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(side, "doc_id").select("node", "text"))


def _verify(docs: DataFrame, sets: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) of set names that pass on their full sets, made anew from whole texts."""
    texts = _texts(docs, sets, pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
    t = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")).hint("merge"), "a")
    t = t.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")).hint("merge"), "b")

    def confirm(batches):
        powers = Powers()
        for batch in batches:
            left, right = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out = []
            for x, y, s, u in zip(left, right, _sets(batch.column("ta"), size, powers), _sets(batch.column("tb"), size, powers)):
                if _node(s) == x and _node(u) == y:  # not another text under a repeated doc_id
                    both = len(np.intersect1d(s, u, assume_unique=True))
                    if 100 * both >= percent * (len(s) + len(u) - both):
                        out.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    links = save(t.select("a", "b", "ta", "tb").mapInArrow(confirm, "a long, b long").distinct())
    drop_saved(texts)
    return links


def _grouped(members: DataFrame, *more: str) -> DataFrame:
    return members.groupBy("key").agg(F.collect_list(F.struct("node", "root", "n", "low", "first", "tree", *more)).alias("m"))


def _candidates(m: pa.ListArray, least: int, percent: int):
    """Pairs (x, y, agreeing bytes) of places in the list's values, node by node: sets of one node that aren't in one component and may pass.

    Sizes must allow it and `least` minwise bytes agree; a pair is told by the first of its nodes only (`first` holds
    the values that name the earlier ones).
    """
    off = m.offsets.to_numpy()
    get = lambda name: m.values.field(name).to_numpy(zero_copy_only=False)
    root, n, tree = get("root"), get("n").astype(np.int64), get("tree")
    low = np.frombuffer(b"".join(m.values.field("low").to_pylist()), np.uint8).reshape(-1, BYTES)
    first = np.frombuffer(b"".join(m.values.field("first").to_pylist()), np.uint8).reshape(-1, 4 * TREES * BRANCHES).view(np.int32)

    def keep(x, y):
        ok = (root[x] != root[y]) & (100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        # Nodes of earlier root branches that both sets are in have the pair.
        earlier = np.arange(TREES * BRANCHES)[None, :] < tree[x][:, None]
        ok = ~((first[x] == first[y]) & earlier).any(axis=1)
        x, y = x[ok], y[ok]
        agree = (low[x] == low[y]).sum(axis=1)
        ok = agree >= least
        return x[ok], y[ok], agree[ok]

    sizes = np.diff(off)
    for k in np.unique(sizes[sizes <= 64]):
        i, j = np.triu_indices(int(k), 1)
        step = max(1, 100_000 // max(1, len(i)))
        at = off[:-1][sizes == k]
        for lo in range(0, len(at), step):
            yield keep((at[lo : lo + step, None] + i).ravel(), (at[lo : lo + step, None] + j).ravel())
    for lo, k in zip(off[:-1][sizes > 64], sizes[sizes > 64]):
        # In order of size, a set's partners stand in a window after it.
        by = lo + np.argsort(n[lo : lo + k], kind="stable")
        ends = np.searchsorted(n[by], 100 * n[by] // percent, "right")
        found = [keep(np.full(e - i - 1, by[i]), by[i + 1 : e]) for i, e in enumerate(ends) if e > i + 1]
        if found:
            yield tuple(np.concatenate(x) for x in zip(*found))


def _band_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): every set with the least of those that share a band of its values, a pair a set and band at most."""
    at = lambda i: TREES * BRANCHES + i * WIDTH
    keys = F.array(*(F.xxhash64(F.lit(i), F.slice("sig", at(i) + 1, WIDTH)) for i in range(BANDS)))
    banded = save(sets.select("node", F.explode(keys).alias("band")))
    heads = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("band", "a")
    pairs = banded.join(heads.hint("merge"), "band").filter("a <> node").select("a", F.col("node").alias("b")).distinct()
    pairs = save(pairs)
    drop_saved(banded)
    return pairs


def _nearest_pairs(members: DataFrame, least: int, percent: int, nearest: int) -> DataFrame:
    """Of what may link a component's sets in a node to others, the `nearest` pairs: a, b."""

    def compare(batches):
        for batch in batches:
            m, out = batch.column("m"), []
            root = m.values.field("root").to_numpy(zero_copy_only=False)
            for x, y, agree in _candidates(m, least, percent):
                a, b, s = np.concatenate((x, y)), np.concatenate((y, x)), np.concatenate((agree, agree))
                by = np.lexsort((b, a, -s, root[a]))
                r = root[a][by]
                first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(a) else np.zeros(0, np.int64)
                at = np.arange(len(by)) - np.repeat(first, np.diff(np.concatenate((first, [len(by)]))))
                out.append((a[by[at < nearest]], b[by[at < nearest]]))
            node = m.values.field("node").to_numpy(zero_copy_only=False)
            x, y = (np.concatenate([p[i] for p in out]) if out else np.zeros(0, np.int64) for i in (0, 1))
            pairs = np.unique(np.stack((np.minimum(node[x], node[y]), np.maximum(node[x], node[y])), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, c]) for c in (0, 1)], names=["a", "b"])

    return _grouped(members).select("m").mapInArrow(compare, "a long, b long").distinct()


def _open_members(members: DataFrame, least: int, percent: int) -> DataFrame:
    """key and node of members that may still pass with one of their node in another component."""

    def mark(batches):
        for batch in batches:
            m = batch.column("m")
            hit = np.unique(np.concatenate([np.zeros(0, np.int64), *(z for x, y, _ in _candidates(m, least, percent) for z in (x, y))]))
            key = np.repeat(batch.column("key").to_numpy(), np.diff(m.offsets.to_numpy()))
            node = m.values.field("node").to_numpy(zero_copy_only=False)
            at = hit - m.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[hit])], names=["key", "node"])

    return _grouped(members).mapInArrow(mark, "key long, node long")


def _links_in_nodes(members: DataFrame, size: int, least: int, percent: int) -> DataFrame:
    """Pairs of each node that pass on their full sets; pairs that earlier ones have connected aren't looked at. members carry text."""

    def confirm(batches):
        powers = Powers()
        for batch in batches:
            m = batch.column("m")
            node = m.values.field("node").to_numpy(zero_copy_only=False)
            sets = list(_sets(m.values.field("text"), size, powers))
            ok = [len(s) > 0 and _node(s) == v for s, v in zip(sets, node)]  # not another text under a repeated doc_id
            above: dict[int, int] = {}

            def find(v):
                while v in above:
                    v = above[v]
                return v

            out, root = [], m.values.field("root").to_numpy(zero_copy_only=False)
            for x, y, agree in _candidates(m, least, percent):
                for i in np.argsort(-agree, kind="stable"):
                    p, q = x[i], y[i]
                    r, t = find(root[p]), find(root[q])
                    if r != t and ok[p] and ok[q]:
                        both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                        if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                            out.append((node[p], node[q]))
                            above[max(r, t)] = min(r, t)
            yield pa.RecordBatch.from_arrays([pa.array([p[c] for p in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return _grouped(members, "text").select("m").mapInArrow(confirm, "a long, b long")


def _tiles(members: DataFrame, n: Column) -> DataFrame:
    """Members of nodes cut into n parts, in every pair of parts; a pair of members meets in one task at least."""
    t = members.withColumn("i", F.pmod(F.xxhash64("node"), n)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return t.withColumn("key", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))).drop("i", "j")


def _nodes(sets: DataFrame, small: int = SMALL, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """key, node, tree (root branch), root: every member of every node that is compared; and node, wide: root branches of a member that had to branch further.

    sets carry the root of their component: a node inside one component has nothing to compare. A node beyond `small` with few members outside
    its largest component is cut along that one, its rows at most doubling; any other branches.
    """
    branches = [F.struct(F.xxhash64(F.lit(j), F.col("sig")[j]).alias("key"), F.lit(j).alias("tree")) for j in range(TREES * BRANCHES)]
    front, done, wide, names = sets.select(F.inline(F.array(*branches)), "node", "root"), None, None, ["key", "node", "tree", "root"]
    for level in range(depth + 1):
        by_root = save(front.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")))
        kept = by_root.groupBy("key").agg(F.sum("n").alias("cnt"), F.count(F.lit(1)).alias("roots"), F.max(F.struct("n", "root")).alias("main")).filter("roots > 1")
        kept = save(kept.select("key", "cnt", F.col("main.root").alias("main"), F.col("main.n").alias("main_n")))
        front = save(front.join(kept.hint("merge"), "key"))
        drop_saved(by_root)
        mine = front.filter(F.col("cnt") <= small).select(*names)
        done = mine if done is None else done.union(mine)
        large = front.filter(F.col("cnt") > small)
        most = kept.agg(F.max("cnt")).first()[0] or 0
        if most > small:
            few = 2 * (F.col("cnt") - F.col("main_n")) <= small
            # The few meet every part of the largest component.
            parts = F.ceil(2 * F.col("main_n") / small)
            part = F.pmod(F.xxhash64("node"), parts)
            whole = F.when(F.col("root") == F.col("main"), F.array(part)).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))
            along = large.filter(few).withColumn("part", F.explode(whole)).withColumn("key", F.xxhash64("key", "part"))
            done, large = done.union(along.select(*names)), large.filter(~few)
        if wide is None:
            wide = save(large.groupBy("node").agg(F.collect_set("tree").alias("wide")))
        if most <= small:
            break
        if level == depth:
            # Half a node in each tile; a member meets every tile of its node.
            done = done.union(_tiles(large, F.ceil(2 * F.col("cnt") / small)).select(*names))
            break
        rest = VALUES - TREES * BRANCHES
        chosen = [F.pmod(F.xxhash64("key", F.lit(k)), F.lit(rest)).cast("int") + TREES * BRANCHES for k in range(BRANCHES)]
        full = large.join(sets.select("node", "sig").hint("merge"), "node")
        front = full.select(F.explode(F.array(*(F.xxhash64("key", c, F.get("sig", c)) for c in chosen))).alias("key"), "node", "tree", "root").distinct()
    return done, wide


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, small: int = SMALL, depth: int = DEPTH, slice_bytes: int = SLICE) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links, itself included), kept.

    Texts are lower-cased (A-Z); words stand between ASCII white space; a document's set holds its distinct
    `size`-word shingles (of fewer words: the whole sequence). Sets link where 100 * intersection >=
    percent * union, confirmed on full sets.

    Equal sets become one member. Sets that share a band of minwise values are first held against one of them: that makes a
    large group of near copies one component, nearly, at linear cost. Then every member goes down TREES independent trees, BRANCHES minwise values
    at the root of each; a node holds the members that agree on all values chosen on its path. A node beyond
    `small` members branches on two further values of its own choice; at a Jaccard similarity of 0.8 a pair is then lost in a
    tree with probability 0.0625 at most (the root of q = (0.2 + 0.8 q)^2), so five trees lose fewer than 1 pair in 10^6. Small
    nodes are compared exhaustively, what is large after `depth` branchings in tiles, by a byte of each of BYTES minwise values (a pair at the threshold
    misses the least agreement, 4.8 standard deviations below its mean, once in 10^6), and what may pass goes to full sets, in two steps: first the nearest
    pairs between each component and others in a node; then all pairs that are not yet inside one component, inside the node's task (cut into tiles
    beyond `slice_bytes` of text), so that only links leave it. Nothing is capped: pairs inside a component can't change it.

    Null and blank texts have no set, link with nothing and stay. Rows with a null doc_id link only by equal sets
    and give no component_id unless all are null. Repeated rows are one document; of rows that share a doc_id but not a
    text, either may be confirmed. Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    p = percent / 100
    least = int(BYTES * (p - 4.8 * (p * (1 - p) / BYTES) ** 0.5))
    signed = save(signatures(docs, size))
    by_set = signed.filter("node IS NOT NULL").groupBy("node")
    sets = save(by_set.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("low").alias("low"), F.first("bytes").alias("bytes")))
    with_root = lambda t, roots: t.join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    pairs = _band_pairs(sets)
    links = _verify(docs, sets, pairs, size, percent)
    roots = components(links)
    nodes, wide = _nodes(with_root(sets.select("node", "sig"), roots), small, depth)
    # Where a root branch had to branch further, a pair isn't sure to meet, so its value there is the member's own.
    value = lambda j: F.when(F.array_contains("wide", j), F.xxhash64("node", F.lit(j)).bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.col("sig")[j].cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    first = F.concat(*(F.unhex(F.lpad(F.hex(value(j)), 8, "0")) for j in range(TREES * BRANCHES)))
    known = save(sets.join(wide.hint("merge"), "node", "left").select("node", "n", "low", "bytes", first.alias("first")))
    drop_saved(pairs)
    pairs = save(_nearest_pairs(nodes.join(known.hint("merge"), "node"), least, percent, NEAREST))
    links = links.union(_verify(docs, sets, pairs, size, percent))
    roots = components(links)
    # Nodes inside one component need nothing more.
    named = save(with_root(nodes.drop("root"), roots))
    mixed = save(named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key"))
    full = named.join(mixed.hint("merge"), "key", "left_semi").join(known.hint("merge"), "node")
    left = save(_open_members(full, least, percent))
    if not left.isEmpty():
        texts = _texts(docs, sets, left.select("node"))
        full = named.join(left.hint("merge"), ["key", "node"], "left_semi").join(known.hint("merge"), "node")
        weight = save(full.groupBy("key").agg(F.sum("bytes").alias("all")))
        full = full.join(weight.hint("merge"), "key")
        heavy = _tiles(full.filter(F.col("all") > slice_bytes), F.ceil(2 * F.col("all") / slice_bytes))
        full = full.filter(F.col("all") <= slice_bytes).unionByName(heavy).join(texts.hint("merge"), "node")
        more = save(_links_in_nodes(full, size, least, percent))
        for t in (texts, weight):
            drop_saved(t)
        roots = components(links.union(more))
    # A component's name is its smallest doc_id.
    named_sets = save(with_root(sets.select("node", "doc_id"), roots))
    least_id = save(named_sets.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    names = save(named_sets.join(least_id.hint("merge"), "root").select("node", "component_id"))
    for t in (sets, known, pairs, named, mixed, left, named_sets, least_id):
        drop_saved(t)
    out = signed.select("doc_id", "n", "node").join(names.hint("merge"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
