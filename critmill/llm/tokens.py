"""Token ids of whole texts, and flat binary files of them."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import partitions, save, scratch, worker_state

#: Words that a worker remembers, in each of two generations: about 40 MB each.
CACHE_WORDS = 200_000
#: A full stop or comma that ends an ASCII word is a pre-token of its own.
WORD_END = re.compile(rb"(?<=[a-z])([.,])(?=\s|$)")


class WordEncoder:
    """Encodes whole texts with a lower-casing tokenizer whose pre-tokens never hold white space.

    Such a tokenizer gives a text the ids of its white-space separated words, one after another
    (tests compare with whole texts), so each worker encodes a word once and keeps its ids. ASCII letters alone are
    one pre-token and go to the tokenizer's model; other words go through all of it. The cache has
    two generations, so that frequent words stay while its size is bounded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept = worker_state().__dict__.setdefault("encoders", {})
        if path not in kept:
            kept[path] = [Tokenizer.from_file(path), {}, {}]
        self.kept = kept[path]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        data = text.encode()
        if b"<|" not in data:  # else special tokens may stand there, in one case only
            data = WORD_END.sub(rb" \1", data.lower())
        words = data.split()
        try:
            return b"".join(map(self.kept[1].__getitem__, words))
        except KeyError:
            self._learn(set(words))
        return b"".join(map(self.kept[1].__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        tokenizer, young, old = self.kept
        new = [w for w in words if w not in young]
        if len(young) + len(new) > CACHE_WORDS:
            young, old, new = {}, young, list(words)
            self.kept[1:] = [young, old]
        model, other = tokenizer.model, []
        for w in new:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            elif w.isalpha() and w.islower():
                young[w] = b"".join(t.id.to_bytes(4, "little") for t in model.tokenize(w.decode()))
            else:
                other.append(w)
        for w, e in zip(other, tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            young[w] = np.array(e.ids, "<u4").tobytes()


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, folder: str, dtype: str = "<u2") -> DataFrame:
    """Writes the ids of every document, `end_id` after each, in ascending doc_id order; returns the manifest.

    Files of part k: k.ids (flat unsigned integers of `dtype`), k.doc (doc_ids, 64-bit; a null one is the
    smallest integer and comes first) and k.off (64-bit offsets into the ids of all parts: one more
    than documents). A range exchange orders the documents; every part is encoded and
    written once by its own task; part bases are prefix sums over the manifest (a row a part); then
    offsets are written from the kept lengths. Null and empty texts have the end id only; documents of one doc_id
    stand together in any order; an empty table gives no part.
    """
    spark = docs.sparkSession
    null_id = -(1 << 63)
    t = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id")

    def encode(batches):
        encoder, ids, lengths, part = WordEncoder(tokenizer), [], [], TaskContext.get().partitionId()
        end, most, name = np.array([end_id], "<u4").tobytes(), np.iinfo(dtype).max, f"{folder}/{part:06d}"

        def blocks():
            for b in batches:
                out = []
                for text in b.column("text").to_pylist():
                    out.append(encoder.encode(text) + end)
                    lengths.append(len(out[-1]) // 4)
                ids.append(b.column("doc_id").to_numpy().astype("<i8"))
                flat = np.frombuffer(b"".join(out), "<u4")
                if len(flat) and flat.max() > most:
                    raise ValueError(f"an id is above what {dtype} can hold")
                yield flat.astype(dtype).tobytes()

        first = next(batches, None)
        if first is None:
            return
        rest, batches = batches, None
        batches = (b for run in ((first,), rest) for b in run)
        files.write(f"{name}.ids", blocks())
        files.write(f"{name}.doc", [np.concatenate(ids).tobytes()])
        files.write(f"{name}.len", [np.array(lengths, "<i8").tobytes()])
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "docs": [len(lengths)], "tokens": [int(sum(lengths))]}, schema)

    schema = pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])
    manifest = save(t.mapInArrow(encode, "part int, name string, docs long, tokens long"))
    based = spark.sql("SELECT *, sum(tokens) OVER (ORDER BY part) - tokens AS base FROM {m}", m=manifest)

    def offsets(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                n = np.array(files.mapped(f"{name}.len", "<i8"))
                files.write(f"{name}.off", [(base + np.concatenate(([0], np.cumsum(n)))).astype("<i8").tobytes()])
            yield b

    spread = based.repartition(partitions(spark), "part")
    return save(spread.mapInArrow(offsets, "part int, name string, docs long, tokens long, base long"))


def read_tokens(manifest: DataFrame, dtype: str = "<u2", with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids."""

    def read(batches):
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist()):
                flat, off, doc = files.mapped(f"{name}.ids", dtype), files.mapped(f"{name}.off", "<i8"), files.mapped(f"{name}.doc", "<i8")
                for lo in range(0, len(doc), 2000):
                    at = np.array(off[lo : lo + 2001])
                    ids = [np.asarray(flat[s - base : e - base]).astype("<u4") for s, e in zip(at[:-1], at[1:])]
                    docs = np.array(doc[lo : lo + 2000])
                    out = {"doc_id": pa.array(docs, mask=docs == -(1 << 63)), "start": at[:-1], "n_tokens": np.diff(at), "ids_crc32": [zlib.crc32(x.tobytes()) for x in ids]}
                    out |= {"ids": [x.tolist() for x in ids]} if with_ids else {}
                    yield pa.RecordBatch.from_pydict(out, schema)

    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    spread = manifest.repartition(partitions(manifest.sparkSession), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def token_folder(docs: DataFrame) -> str:
    return scratch(docs.sparkSession)
