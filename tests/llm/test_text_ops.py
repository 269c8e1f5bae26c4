"""Licence scans, classifier, fingerprints and suffix-array removal against brute force and held-out labels."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from critmill.llm import licenses, quality, queries, simhash, suffix
from critmill.llm.common import BATCH_BYTES, small_batches


def brute_words(text):
    return [w for w in re.sub(r"[^\w.]+|\.(?!\w)|(?<!\w)\.|_", " ", text.lower()).split(" ") if w]


def brute_grams(text):
    w = brute_words(text)
    return set(zip(w, w[1:]))


def test_licenses(spark, sf, messy, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(messy, allowMissingColumns=True)
    extra = [(901, "x\nreleased under the mit license!"), (902, "LICENSED under the Apache License, Version 2.0.\n" * 2), (903, "The MIT License")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            a = brute_grams(line)
            for k, (name, t) in enumerate(licenses.TEMPLATES):
                b = brute_grams(t)
                if a and (d := 2 * len(a & b) / (len(a) + len(b))) >= 0.8:
                    want[r.doc_id, i + 1, name, k, d] += 1
    got = Counter((r.doc_id, r.line, r.license, r.template, r.dice) for r in licenses.scan(docs).collect())
    assert got == want and sum(n for k, n in got.items() if k[0] == 902) >= 2
    assert licenses.scan(empty).count() == 0


def test_licenses_in_running_text(spark):
    """Wrapped notices, notices among other words and whole licences; each once, none that a line has."""
    apache = "Licensed under the Apache License, Version 2.0"
    header = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in\n# compliance with the License.\n'
    gpl = "some words\n" + licenses.TEMPLATES[8][1].replace(" General", "\n * General").replace(" Software", "\n * Software").replace(" version", "\n * version") + "\nother words"
    whole = {name: text for _, name, text in licenses.full_texts()}
    rows = [(1, f"a b c\nCopyright 2020 The Authors of this. {apache}. All rights reserved, and so on and on."), (2, f"x\n\n{header}"), (3, gpl), (4, f"{apache}.\n" * 3)]
    rows += [(5, f"words before it {apache} words {apache} after them and many more words"), (6, "the license of version 2.0 is the gnu general public license " * 5), (7, None), (8, "")]
    rows += [(100 + i, f"first line\nCopyright (c) 2020 Someone\n\n{x}\nlast line") for i, x in enumerate(whole.values())]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    of = lambda d: sorted((r.line, r.license, r.template) for r in got if r.doc_id == d)
    assert of(1) == [(2, "Apache-2.0", 0)]
    assert {(3, "Apache-2.0", 0), (3, "Apache-2.0", 1)} >= set(of(2)) and (3, "Apache-2.0", 1) in of(2)
    assert of(3) == [(2, "GPL-3.0", 8)]
    assert of(4) == [(i, "Apache-2.0", 0) for i in (1, 2, 3)]
    assert of(5) == [(1, "Apache-2.0", 0)] * 2
    assert not of(6) and not of(7) and not of(8)
    for i, name in enumerate(whole):
        assert any(r.license == name and r.template == len(licenses.TEMPLATES) + i and r.dice > 0.99 for r in got if r.doc_id == 100 + i), name


def test_windows():
    """Against every window of random words."""
    rnd = random.Random(6)
    for _ in range(200):
        t = set(zip("abcdefgh", "bcdefghi"))
        w = [rnd.choice("abcdefghixy") if rnd.random() < 0.2 else "abcdefghi"[i % 9] for i in range(rnd.randrange(2, 40))]
        grams = list(zip(w, w[1:]))
        every = {(i, j): 2 * len(a & t) / (len(a) + len(t)) for i in range(len(grams)) for j in range(i, min(len(grams), i + 12)) for a in [set(grams[i : j + 1])]}
        got = licenses._windows(grams, t, len(t), 0.8)
        taken = set()
        for d, i, j in got:
            assert every[i, j] == d >= 0.8 and not taken & set(range(i, j + 1))
            taken |= set(range(i, j + 1))
        assert all(d < 0.8 or taken & set(range(i, j + 1)) for (i, j), d in every.items())


def test_quality(spark, messy, empty):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.fit(docs, labels)
    out = quality.score(docs, model).select("doc_id", "score", "predicted", quality.held_out(F.col("doc_id")).alias("h")).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.h and r.doc_id in truth]
    assert np.mean([a == b for a, b in held]) > 0.85
    again = quality.fit(docs.repartition(3), labels.repartition(2))
    assert again == model
    # Scores against a plain computation; what is no label, or two, teaches nothing.
    for r in docs.filter("doc_id % 97 = 0").join(quality.score(docs, model).select("doc_id", "score"), "doc_id").collect():
        data, sizes = (r.text or "").encode(), []
        for d in (model.good, model.bad):
            c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(data[i : i + model.piece])) for i in range(0, len(data), model.piece)))
        x = (sizes[1] - sizes[0]) / len(data) if data else 0.0
        assert abs(r.score - 1 / (1 + math.exp(-(model.intercept + model.slope * x)))) < 1e-9
    more = spark.createDataFrame([(d, q) for d in range(3) for q in (0, 1)] + [(None, 1), (5, None)], "doc_id long, quality int")
    ids = [r.doc_id for r in labels.limit(3).collect()]
    twice = more.replace({0: ids[0], 1: ids[1], 2: ids[2]}, subset=["doc_id"])
    assert quality.fit(docs, labels.select("doc_id", "quality").union(twice)) == quality.fit(docs, labels.filter(~F.col("doc_id").isin(ids)))
    assert quality.score(messy, model).filter("score IS NULL").count() == 0
    assert quality.score(empty, model).count() == 0
    assert quality.fit(docs, labels.limit(0)).slope == 0
    assert quality.fit(empty, labels).slope == 0


def brute_fingerprint(text, size=2):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def test_fingerprints():
    """Votes against a plain sum over unpacked bits, in chunks of any cut."""
    rnd = np.random.default_rng(2)
    first = np.array([0, 3, 3, 700, 1000])
    h = rnd.integers(0, 1 << 63, 1000, dtype=np.uint64) * np.uint64(2)
    votes = simhash._votes(h, first)
    for i in range(4):
        for b in range(64):
            assert votes[i, b] == int(((h[first[i] : first[i + 1]] >> np.uint64(b)) & np.uint64(1)).sum())
    texts = ["", "one", "a b", "A  B", "a b c " * 500, None, "word " * 3]
    f = simhash.fingerprints(pa.array(texts))
    g = np.concatenate([simhash.fingerprints(pa.array([t], pa.string())) for t in texts])
    assert (f == g).all() and (f[2] == f[3]).all() and not f[0].any() and not f[5].any()


@pytest.mark.parametrize("which", ["documents", "messy"])
def test_edit_probe(spark, sf, messy, which):
    docs = messy.dropDuplicates(["doc_id"]) if which == "messy" else spark.read.parquet(f"{sf}/documents.parquet")
    out = {r.doc_id: r for r in simhash.edit_probe(docs).collect()}
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), reverse=True)
    assert len(out) == len(rows)
    texts = [t for _, t in rows]
    prints = dict(zip([d for d, _ in rows], simhash.fingerprints(pa.array(texts))))
    far = near = 0
    for i, (d, t) in enumerate(rows):
        nd, nt = rows[(i + 1) % len(rows)]
        m = len(t) // 3
        edited = t[: len(t) - m] + nt[:m]
        r, e = out[d], simhash.fingerprints(pa.array([edited]))
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == prints[d].tobytes().hex() and r.edited_fingerprint == e[0].tobytes().hex()
        assert r.near_edited == simhash.likeness(prints[d][None], e)[0] and r.near_next == simhash.likeness(prints[d][None], prints[nd][None])[0]
        near, far = near + r.near_edited, far + r.near_next
    assert which == "messy" or near - far > 0.15 * len(rows)


def test_edit_probe_small(spark, empty):
    assert simhash.edit_probe(empty).count() == 0
    one = simhash.edit_probe(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    assert simhash.edit_probe(spark.createDataFrame([(None, "x"), (None, None), (1, "y y")], "doc_id long, text string")).count() == 3


@pytest.fixture(scope="module")
def near_values():
    """Random fingerprints and copies with up to 14 bits flipped, far and close together."""
    rnd = random.Random(4)
    base = [rnd.getrandbits(128) for _ in range(40)]
    values = [0, (1 << 128) - 1, 1 << 127, *base]
    for b in base:
        for k in (1, 2, 3, 4, 5, 12, 13, 14):
            start = rnd.randrange(100)
            for bits in (rnd.sample(range(128), k), range(start, start + k)):
                values.append(b ^ sum(1 << x for x in bits))
    return values


@pytest.mark.parametrize("radius, blocks", [(0, None), (1, None), (3, None), (3, 4), (12, None), (12, 4), (12, 5), (12, 6), (12, 13)])
def test_search(spark, near_values, radius, blocks):
    """Every pair within the radius once, whatever the blocks; equal fingerprints and repeated rows count once."""
    prints = spark.createDataFrame([(f"{v:032x}", 1) for v in near_values * 2] + [(None, 1)], "fingerprint string, found int")
    got = [tuple(r) for r in simhash.search(prints, prints, radius, blocks).collect()]
    some = sorted(set(near_values))
    want = {(f"{v:032x}", f"{u:032x}", bin(v ^ u).count("1")) for v in some for u in some if 0 < bin(v ^ u).count("1") <= radius}
    assert len(got) == len(set(got)) and set(got) == want
    assert radius < 3 or len(want) > 100
    assert simhash.search(prints.limit(0), prints, radius, blocks).count() == simhash.search(prints, prints.limit(0), radius, blocks).count() == 0


def test_near(spark, near_values):
    """Copies, repeated rows, null fingerprints, clashing columns, empty tables."""
    rows = [(i, f"{v:032x}", "x") for i, v in enumerate(near_values)] + [(9000, None, "x"), (9005, None, None), (5, f"{near_values[5]:032x}", "x"), (8001, f"{near_values[10]:032x}", None)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string, docs string")
    got = Counter(tuple(r) for r in simhash.near(df.filter("doc_id % 5 = 0"), df).collect())
    apart = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
    want = Counter((d, f, sum(g is not None and apart(f, g) <= 3 for _, g, _ in rows) - 1 if f else 0) for d, f, _ in rows if d % 5 == 0)
    assert got == want and got[9005, None, 0] == 1 and max(n for _, _, n in got) > 3
    assert simhash.near(df.limit(0), df).count() == simhash.near(df.limit(0), df.limit(0)).count() == 0


def test_blocks_follow_the_tables():
    """Blocks widen with the tables, so that chance pairs don't grow with the square."""
    small, large = simhash.choose_blocks(12, 20, 1000), simhash.choose_blocks(12, 2 * 10**7, 10**9)
    assert small > large
    for n in (10**3, 10**6, 10**9):
        tables = simhash.block_tables(12, simhash.choose_blocks(12, n // 50, n))
        assert sum(t + 1 for _, _, t in tables) == 13
        assert sum(p * n / 2 ** (hi - lo) for p, (lo, hi, _) in zip(simhash._probes(tables), tables)) < 10_000


def test_fingerprint_of_plain_shingles():
    """Signs of a plain sum over the text's own shingles: each occurrence votes, more than half sets a bit."""
    texts = ["", "one", "a b", "The cat the CAT the cat sat", "x y " * 300 + "z", "É é\tz  q", None]
    f = simhash.fingerprints(pa.array(texts))
    for text, got in zip(texts, f):
        grams = brute_fingerprint(text or "")
        votes = np.zeros(simhash.BITS, np.int64)
        for g in grams:
            # A text of one shingle has its hash's bits as fingerprint.
            votes += np.unpackbits(simhash.fingerprints(pa.array([b" ".join(g).decode()]))[0])
        assert (np.unpackbits(got) == (2 * votes > len(grams))).all()


def test_search_finds_edited_copies(spark, tmp_path):
    """Copies with one word in a hundred replaced are found, by the registered query, and others aren't."""
    rnd = random.Random(9)
    rows = []
    for i in range(60):
        w = [f"w{rnd.randrange(5000)}" for _ in range(500)]
        rows.append((50 * i, " ".join(w)))
        for at in rnd.sample(range(500), 5):
            w[at] = f"new{at}"
        rows.append((50 * i + 1, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_near for r in queries.fingerprint_search(spark, str(tmp_path)).collect()}
    f = np.unpackbits(simhash.fingerprints(pa.array([t for _, t in rows])), axis=1)
    assert got == {d: int(((f != f[i]).sum(axis=1) <= queries.NEAR_BITS).sum()) - 1 for i, (d, _) in enumerate(rows) if d % 50 == 0}
    assert sum(n == 1 for n in got.values()) >= 0.9 * len(got) and max(got.values()) <= 1


def brute_removed(rows, length):
    """Per document: removed flags of its bytes."""
    least = {}
    for d, b in rows:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        out.append((d, bytes(gone), b))
    return out


def check_removal(df, length, **more):
    rows = [(r.doc_id, (r.text or "").encode()) for r in df.collect()]
    want = Counter()
    for d, gone, b in brute_removed(rows, length):
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[d, len(b), sum(gone), len(re.findall(b"\1+", gone)), kept] += 1
    out = suffix.remove_repeats(df, length, **more).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == want


@pytest.mark.parametrize("length", [50, 150])
def test_removal_documents(spark, sf, length):
    check_removal(spark.read.parquet(f"{sf}/documents.parquet"), length)


def test_removal_messy(messy):
    check_removal(messy.withColumn("kept", F.lit(1)), 50)


@pytest.mark.parametrize("hot", [1 << 30, 1000])
def test_removal_in_many_shards(spark, hot):
    """Buckets cut into several suffix arrays, long repeats of one byte, overlaps, shifted copies."""
    rnd = random.Random(8)
    word = lambda: rnd.choice(["ab", "cd", "efg", "hij", "klmn"])
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(120):
        t = " ".join(word() for _ in range(rnd.randrange(5, 60)))
        at = rnd.randrange(0, 120)
        t += passage[at : at + rnd.randrange(30, 120)] if i % 2 else ""
        rows.append(t + " ".join(word() for _ in range(rnd.randrange(5, 20))))
    rows += ["a" * 70, "b" + "a" * 300, "a" * 49, passage, passage[10:], "", passage + passage]
    check_removal(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(6), 50, piece=300, hot=hot)


def test_removal_of_one_line_in_every_document(spark):
    """A frequent line among neighbours that differ everywhere: hot anchors are dealt out by their windows."""
    rnd = random.Random(12)
    noise = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    line = "this line stands in every document of the corpus, word for word, always"
    rows = [(i, noise(rnd.randrange(20, 90)) + line + noise(rnd.randrange(20, 90))) for i in range(300)]
    check_removal(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), 50, hot=2000)


def test_removal_of_whole_characters(spark):
    """A character that loses a byte goes; replacement characters that an author wrote stay."""
    shared = "\u00e9" * 30 + " a passage of words that stands in two documents and is long enough"
    rows = [(1, "keep \ufffd mark. " + shared), (2, "\u4f60\u597d \ufffd \u0269" + shared[1:] + " \ufffd end")]
    out = {r.doc_id: bytes(r.kept).decode() for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, characters=True).collect()}
    # The last byte of the character before the passage is that of its first one.
    assert out == {1: rows[0][1], 2: "\u4f60\u597d \ufffd  \ufffd end"}


def test_equal_hashes_are_compared():
    data = np.frombuffer(b"abcdefabcdexabcdefabc", np.uint8)
    start, size = np.array([0, 6, 12, 18]), np.array([6, 6, 6, 3])
    head = suffix._equal_runs(data, start, size, np.zeros(4, np.uint64), np.array([5, 4, 9, 7]))
    assert head.tolist() == [0, 1, 2, 3]  # only the least document's run is compared with, and it differs
    assert suffix._equal_runs(data, start, size, np.array([1, 2, 1, 3], np.uint64), np.array([5, 4, 9, 7])).tolist() == [0, 1, 0, 3]


def test_refused_lengths(empty):
    for n in (16, (1 << 16) + 1):
        with pytest.raises(ValueError):
            suffix.remove_repeats(empty, n)


def test_removal_empty_and_null_ids(spark, empty):
    assert suffix.remove_repeats(empty).count() == 0
    t = "some text that is long enough to be a repeated string of fifty bytes"
    out = {r.doc_id: (r.n_removed, bytes(r.kept)) for r in suffix.remove_repeats(spark.createDataFrame([(None, t), (3, t), (4, None)], "doc_id long, text string")).collect()}
    assert out == {None: (len(t), b""), 3: (0, t.encode()), 4: (0, b"")}


def test_suffix_array():
    rnd = np.random.default_rng(6)
    for n, k in ((0, 2), (1, 2), (300, 2), (500, 4), (200, 1), (400, 256)):
        data = rnd.integers(0, k, n).astype(np.uint8)
        order, rank = suffix.suffix_array(data)
        b = data.tobytes()
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        lcp = suffix.common_prefixes(data, order, rank, 20, lanes=7)
        for i in range(1, n):
            x, y = b[order[i - 1] :], b[order[i] :]
            same = next((j for j, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[i] == min(same, 20)


def test_merge_of_shards():
    """Owners over all shards are those of one array of all strings, ties at the last bytes and windows of one shard only included."""
    rnd, length = np.random.default_rng(11), 21
    for shards in (2, 3, 5):
        texts = [rnd.integers(97, 99, rnd.integers(1, 60), dtype=np.uint8) for _ in range(40)] + [np.full(50, 97, np.uint8)] * 3
        common = rnd.integers(0, 256, 70, dtype=np.uint8)
        texts += [np.concatenate((common[k:], rnd.integers(0, 256, 9, dtype=np.uint8))) for k in range(30)]
        texts = [texts[i] for i in rnd.permutation(len(texts))]
        owner = rnd.permutation(len(texts))
        whole = {}
        for t, o in zip(texts, owner):
            for k in range(len(t) - length + 1):
                w = t[k : k + length].tobytes()
                whole[w] = min(whole.get(w, o), o)
        parts = []
        for k in range(shards):
            data, first = np.concatenate(texts[k::shards]), np.concatenate(([0], np.cumsum([len(t) for t in texts[k::shards]])))
            group, head, least = suffix.window_groups(data, first, owner[k::shards], length)
            windows = [data[p : p + length].tobytes() for p in head]
            assert windows == sorted(set(windows))
            parts.append((data, head, least))
        for (data, head, _), got in zip(parts, suffix.merge_owners(parts, length)):
            assert [whole[data[p : p + length].tobytes()] for p in head] == got.tolist()


def test_batches_are_bounded_unless_set(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    mine = spark.newSession()
    mine.conf.unset(name)
    small_batches(mine)
    assert mine.conf.get(name) == str(BATCH_BYTES)
    mine.conf.set(name, "1m")
    small_batches(mine)
    assert mine.conf.get(name) == "1m"


def test_shards_of_several_batches(spark):
    """A shard takes whole texts of more than one Arrow batch; one text above the size is a shard of its own."""
    mine = spark.newSession()
    mine.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2000")
    texts = ["a" * 700, None, "", "b" * 9000, *("c" * 400 for _ in range(20))]
    docs = mine.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blobs = [suffix._open(r.blob) for r in suffix.pack_shards(docs, most=4000).orderBy("shard").collect()]
    assert [x for b in blobs for x in b.column("text").to_pylist()] == texts
    assert [b.num_rows for b in blobs] == [3, 1, 10, 10]


def test_long_licence_texts_are_looked_at_in_few_places(monkeypatch):
    """Bounds hold for every end, and inside a copy that stands no end is tried: five copies take few times the trials of one."""
    k, name, gpl = next(x for x in licenses.full_texts() if x[1] == "GPL-3.0")
    w = licenses.WORD.findall(gpl.lower())
    grams = list(zip(w, w[1:]))
    t, pushed = set(grams), []
    push = licenses.heappush
    monkeypatch.setattr(licenses, "heappush", lambda h, x: pushed.append(x) or push(h, x))
    trials = []
    for n in (1, 5):
        pushed.clear()
        many = list(zip(w * n, (w * n)[1:]))
        found = licenses._windows(many, t, len(grams), 0.8)
        assert len(found) == n and all(d > 0.9999 for d, _, _ in found)
        trials.append(len(pushed))
    assert trials[1] <= 6 * max(trials[0], 10), trials
    rnd = random.Random(6)
    for _ in range(200):
        w = [rnd.choice("abcdef") for _ in range(40)]
        t = set(zip(w[5:12], w[6:13]))
        grams = list(zip(w, w[1:]))
        bounds = licenses._bounds(grams, t, 12)
        for end in range(len(grams)):
            for first in range(max(0, end - 11), end + 1):
                part = set(grams[first : end + 1])
                if grams[end] in t:
                    assert 2 * len(part & t) / (len(part) + len(t)) <= bounds[end] + 1e-12
