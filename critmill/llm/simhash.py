"""SimHash fingerprints of whole texts, and search by permuted block tables."""

from __future__ import annotations

import hashlib
import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Powers, U64, lower_ascii, mix64, partitions, save, shingle_hashes, text_chunks, word_hashes

BITS = 128
#: Fewest blocks of a search (a block has to fit 56 bits), and most probes of a query.
LEAST_BLOCKS, MOST_PROBES = 3, 10_000
LANES = U64(0x0101010101010101)


def _votes(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each text's 64-bit hashes have each bit: eight bits at a time in the byte lanes of sums of up to 255 hashes."""
    n = np.diff(first)
    blocks = -(-n // 255)
    block_first = np.concatenate(([0], np.cumsum(blocks)))
    start = np.repeat(first[:-1] - 255 * block_first[:-1], blocks) + 255 * np.arange(block_first[-1])
    out = np.zeros((len(n), 64), np.int64)
    some = np.flatnonzero(blocks)
    if not len(some):
        return out
    for k in range(8):
        lanes = np.add.reduceat((h >> U64(k)) & LANES, start)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_first[some], axis=0)
        out[some, k::8] = sums
    return out


def fingerprints(column: pa.Array, size: int = 2) -> np.ndarray:
    """A row of BITS / 8 bytes for each text: terms are word shingles of the lower-cased text (of fewer words: all of them).

    Each occurrence of a term votes on every bit, so a term weighs as often as it stands in the text; a bit is set where more than half agree. Texts without words have no bit set.
    """
    powers, rows = Powers(), []
    for _, _, data, offsets in text_chunks(column):
        h, first = shingle_hashes(*word_hashes(lower_ascii(data), offsets, powers), size)
        votes = np.concatenate([_votes(mix64(h + U64(0x632BE59BD9B4E019) * U64(k + 1)), first) for k in range(BITS // 64)], axis=1)
        rows.append(np.packbits(2 * votes > np.diff(first)[:, None], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, BITS // 8), np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits."""
    return 1 - np.unpackbits(a ^ b, axis=1).sum(axis=1) / BITS


def _hex(f: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in f]


def _bytes(column: pa.Array) -> np.ndarray:
    return np.array([list(bytes.fromhex(x)) for x in column.to_pylist()], np.uint8).reshape(-1, BITS // 8)


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(ids, texts, prints, next_texts, next_prints) -> list[pa.Array]:
    """The columns of FIELDS."""
    edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, next_texts)]
    own = fingerprints(pa.array(edited, pa.large_string()))
    sha = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
    values = (ids, [len(t) for t in texts], sha, _hex(prints), _hex(own), likeness(prints, own), likeness(prints, next_prints))
    return [pa.array(v, kind) for v, (_, kind) in zip(values, FIELDS)]


def edit_probe(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited one (see FIELDS).

    The edited text has its last third (code points, rounded down) replaced by the first as many of the next
    document, in descending doc_id order, null ids last; after the last comes the first. One range
    exchange puts documents in that order; the last row of a partition gets its neighbour from the first row of the next
    partition that has rows (two rows a partition, joined on its number). Null texts count as empty; documents of one doc_id
    stand in order of their texts' hash; an empty table gives an empty result. Only doc_id and text are read.
    """
    spark = docs.sparkSession
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("__h")]
    t = t.withColumn("__h", F.xxhash64("text"))
    t = t.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("__h")
    names = [n for n, _ in FIELDS]
    schema = pa.schema([*FIELDS, ("part", pa.int32()), ("first_text", pa.large_string()), ("last_text", pa.large_string())])

    def run(batches):
        part, held, begun = TaskContext.get().partitionId(), None, False
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            if not ids:
                continue
            prints = fingerprints(b.column("text"))
            if held is not None:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate((held[2], prints))
            columns = _edited(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
            n = len(ids) - 1
            firsts = [texts[0] if i == 0 and not begun else None for i in range(n)]
            begun = begun or n > 0
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * n, pa.int32()), pa.array(firsts, pa.large_string()), pa.nulls(n, pa.large_string())], schema=schema)
            held = (ids[-1], texts[-1], prints[-1:])
        if held is not None:
            # The last row waits for the next partition: its text and fingerprint go along.
            row = [[held[0]], [len(held[1])], [None], _hex(held[2]), [None], [None], [None], [part], [None if begun else held[1]], [held[1]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)

    t = save(t.mapInArrow(run, f"{DDL}, part int, first_text string, last_text string"))
    firsts = t.filter("first_text IS NOT NULL").select("part", F.col("first_text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    parts = firsts.select("part")
    # One row a partition.
    following = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy()))
    parts = parts.withColumn("next", following)
    last = t.filter("last_text IS NOT NULL").select("doc_id", "last_text", "fingerprint", "part").join(parts.hint("merge"), "part")
    last = last.join(firsts.withColumnRenamed("part", "next").hint("merge"), "next")

    def close(batches):
        for b in batches:
            columns = _edited(b.column("doc_id"), b.column("last_text").to_pylist(), _bytes(b.column("fingerprint")), b.column("next_text").to_pylist(), _bytes(b.column("next_print")))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    last = last.select("doc_id", "last_text", "fingerprint", "next_text", "next_print").mapInArrow(close, DDL)
    return t.filter("last_text IS NULL").select(*names).union(last)


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hexadecimal) of every text, null as empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(_hex(fingerprints(b.column("text"))), pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def _masks(width: int, flips: int) -> list[int]:
    """Every word of `width` bits with at most so many set."""
    return [sum(1 << b for b in bits) for k in range(flips + 1) for bits in combinations(range(width), k)]


def block_tables(radius: int, blocks: int) -> list[tuple[int, int, int]]:
    """First bit, end bit and flips of each table: two fingerprints within `radius` bits differ by at most so many in one of these blocks.

    Were it more in each, the differences would add up to sum(flips + 1) = radius + 1. Blocks beyond radius + 1 need no table.
    """
    each, more = divmod(radius + 1, blocks)
    return [(i * BITS // blocks, (i + 1) * BITS // blocks, each - (i >= more)) for i in range(blocks) if each + (i < more)]


def _probes(tables: list[tuple[int, int, int]]) -> list[int]:
    return [sum(math.comb(hi - lo, k) for k in range(t + 1)) for lo, hi, t in tables]


def choose_blocks(radius: int, queries: int, prints: int) -> int:
    """The number of blocks with the fewest rows: the index's, the probes', and the pairs that meet by chance."""

    def rows(blocks: int) -> float:
        tables = block_tables(radius, blocks)
        chance = sum(n / 2 ** (hi - lo) for n, (lo, hi, _) in zip(_probes(tables), tables))
        return len(tables) * prints + sum(_probes(tables)) * queries + chance * queries * prints

    fit = [b for b in range(LEAST_BLOCKS, max(LEAST_BLOCKS, radius + 1) + 1) if sum(_probes(block_tables(radius, b))) <= MOST_PROBES]
    return min(fit or [max(LEAST_BLOCKS, radius + 1)], key=rows)


def _words(t: DataFrame, first: str, second: str) -> DataFrame:
    """Distinct fingerprints as two 64-bit words."""
    part = lambda i: F.conv(F.substring("fingerprint", 1 + 8 * i, 8), 16, 10).cast("long")
    word = lambda i: F.shiftleft(part(i), 32).bitwiseOR(part(i + 1))
    return t.select("fingerprint").filter("fingerprint IS NOT NULL").distinct().select(word(0).alias(first), word(2).alias(second))


def _block(lo: int, hi: int, first: Column, second: Column) -> Column:
    """Bits lo to hi as a number."""
    low = F.lit((1 << (hi - lo)) - 1)
    if hi <= 64:
        return F.shiftrightunsigned(first, 64 - hi).bitwiseAND(low)
    end = F.shiftrightunsigned(second, 128 - hi)
    return end.bitwiseAND(low) if lo >= 64 else F.shiftleft(first, hi - 64).bitwiseOR(end).bitwiseAND(low)


def search(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """All pairs of distinct fingerprints within `radius` bits: fingerprint (a query's), found, distance.

    A fingerprint is cut into blocks; each is a table, keyed by the block's bits, in which every fingerprint stands once. Two
    within the radius differ in some block by no more bits than `block_tables` states, so a query looks up
    its block with every choice of so many bits flipped: one equi-join on (table, bits) finds every pair. The number of blocks
    follows from the counted tables, unless given: the more fingerprints, the wider the blocks, so that few meet by chance.

    Inputs hold `fingerprint`; equal ones count once, so large groups of copies and repeated rows cost one row. Null fingerprints take
    no part, other columns don't matter, an empty side gives no pairs.
    """
    q, p = save(_words(queries, "a", "b")), save(_words(prints, "c", "d"))
    tables = block_tables(radius, blocks or choose_blocks(radius, q.count(), p.count()))
    key = lambda i, x: x + F.lit(i << 56)  # noqa: E731  blocks have fewer bits than that
    flips = lambda hi, lo, t: F.split(F.lit(",".join(map(str, _masks(hi - lo, t)))), ",").cast("array<long>")  # noqa: E731  one folded literal
    index = p.withColumn("key", F.explode(F.array(*(key(i, _block(lo, hi, F.col("c"), F.col("d"))) for i, (lo, hi, _) in enumerate(tables)))))
    probes = None
    for i, (lo, hi, t) in enumerate(tables):
        x = q.withColumn("flip", F.explode(flips(hi, lo, t))).select("a", "b", key(i, _block(lo, hi, F.col("a"), F.col("b")).bitwiseXOR(F.col("flip"))).alias("key"))
        probes = x if probes is None else probes.unionByName(x)
    pairs = probes.join(index.hint("merge"), "key").select(F.shiftright("key", 56).alias("table"), "a", "b", "c", "d", F.col("a").bitwiseXOR(F.col("c")).alias("x"), F.col("b").bitwiseXOR(F.col("d")).alias("y"))
    distance = (F.bit_count("x") + F.bit_count("y")).cast("int")
    pairs = pairs.filter((distance > 0) & (distance <= radius))
    # A pair comes from the first table only that it meets in.
    meets = [F.bit_count(_block(lo, hi, F.col("x"), F.col("y"))) <= t for lo, hi, t in tables]
    first = reduce(lambda rest, i: F.when(meets[i], F.lit(i)).otherwise(rest), reversed(range(len(tables))), F.lit(len(tables)))
    text = lambda x, y: F.lower(F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(y), 16, "0")))
    return pairs.filter(first == F.col("table")).select(text("a", "b").alias("fingerprint"), text("c", "d").alias("found"), distance.alias("distance"))


def near(queries: DataFrame, prints: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint, and n_near: other documents within `radius` bits of each query, equal fingerprints included.

    Inputs hold doc_id and fingerprint; queries are rows of prints. Documents of a fingerprint are counted once for all, not listed. Every query gives a row, a
    repeated one as often as it stands there; a null fingerprint is near to none. Other columns don't matter; empty tables give an empty result.
    """
    many = save(prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("docs")))
    found = search(queries, many, radius).join(many.withColumnRenamed("fingerprint", "found").hint("merge"), "found")
    around = save(found.groupBy("fingerprint").agg(F.sum("docs").alias("around")))
    t = queries.select("doc_id", "fingerprint").join(many.hint("merge"), "fingerprint", "left").join(around.hint("merge"), "fingerprint", "left")
    return t.select("doc_id", "fingerprint", (F.coalesce(F.col("docs") - 1, F.lit(0)) + F.coalesce("around", F.lit(0))).alias("n_near"))
