"""The operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, licenses, mixing, neardup, negatives, packing, quality, rules, sharding, simhash, suffix, tokens, topk

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

#: Holds 95 % of texts with one word in a hundred replaced (of 200 or 500 words), and all of one in 200.
NEAR_BITS = 12


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(docs, carry=["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    t = sharding.shard(docs)
    return t.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "chunk")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = packing.pieces(read(spark, sf_dir, "documents"), TOKENIZER, end_id=0)
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), size=2)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return tokens.read_tokens(tokens.write_tokens(docs, TOKENIZER, end_id=1, folder=tokens.token_folder(docs)))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(read(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter(F.col("vec_id") % 20 == 0), vectors)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edit_probe(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = suffix.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"), length=50)
    return t.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filter_quality(read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", "embedding", label.alias("label"))
    return negatives.mine(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def fingerprint_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th document against all, by permuted block tables, within the bits that light edits change."""
    prints = simhash.save(simhash.fingerprint(read(spark, sf_dir, "documents")))
    return simhash.near(prints.filter(F.col("doc_id") % 50 == 0), prints, NEAR_BITS)


QUERIES = {
    f.__name__: f
    for f in (op1_mixing, op2_license_scan, op3_sharding, op4_packing, op5_near_duplicates, op6_token_files, op7_top_k, op8_quality, op9_simhash, op10_suffix_dedup, op11_centroid_clustering, op12_quality_rules, op13_hard_negatives, fingerprint_search)
}

#: Normalised words as in licenses.words; the dots are cut at both ends of a word here.
_WORDS = r"list_filter(list_transform(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}.]+', ' ', 'g'), ' +'), lambda w: trim(w, '.')), lambda w: w <> '')"
_GRAMS = "list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_TEMPLATES = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))

_KEPT = """
    v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v{more} FROM embeddings
        WHERE embedding IS NOT NULL AND {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0{where})"""


def _cluster_sql(k: int = 16, rounds: int = 3) -> str:
    """Rounds unrolled: every vector against every centroid, then floors of means, component by component."""
    parts = [_KEPT.format(scale=64, more="", size="len(embedding) = 64", where="")]
    parts.append(f"c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS INTEGER) AS c, v FROM v ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) LIMIT {k})")
    for r in range(rounds + 1):
        parts.append(f"""d{r} AS (SELECT vec_id, a.v, c, CAST(list_sum(list_transform(range(1, 65), lambda i: (a.v[i] - b.v[i]) * (a.v[i] - b.v[i]))) AS BIGINT) AS d FROM v a, c{r} b),
        a{r} AS (SELECT vec_id, v, c, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, c) AS i FROM d{r}) WHERE i = 1)""")
        if r < rounds:
            parts.append(f"""u{r} AS (SELECT c, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{r}),
        s{r} AS (SELECT c, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM u{r} GROUP BY ALL),
        m{r} AS (SELECT c, list(x ORDER BY i) AS v FROM s{r} GROUP BY c),
        c{r + 1} AS (SELECT c, coalesce(m{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN m{r} USING (c))""")
    return f"""WITH {", ".join(parts)}, t AS (SELECT c, CAST(sum(d) AS BIGINT) AS d FROM a{rounds} GROUP BY c)
        SELECT a.vec_id, a.c AS cluster, a.d AS distance, t.d AS cluster_inertia, CAST((SELECT sum(d) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(b.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN t USING (c) JOIN c{rounds} b USING (c)"""


def _rules_sql(window: int = 8, least: int = 200, reach: int = 3) -> str:
    space = r"[\x20\x09-\x0D]+"
    unit = {"symbols": "n_symbols * 10000 // nullif(n_words, 0)", "length": "word_chars * 100 // nullif(n_words, 0)", "capitals": "n_capitals * 10000 // nullif(word_chars, 0)", "marks": "n_marks * 10000 // nullif(word_chars, 0)", "dup_lines": "n_dup_lines * 10000 // nullif(n_lines, 0)", "repeats": "n_repeat_words * 10000 // nullif(n_words, 0)", "stutter": "n_again * 10000 // nullif(n_words, 0)"}
    spread = "greatest(q3 - q1, CASE measure " + " ".join(f"WHEN '{m}' THEN {x}" for m, (x, _) in rules.MEASURES.items()) + f" END) * {reach}"
    low = "CASE WHEN measure IN (" + ", ".join(f"'{m}'" for m, (_, both) in rules.MEASURES.items() if both) + f") THEN q1 - {spread} ELSE 0 END"

    def fence(keys: str, name: str) -> str:
        more = f"{keys}, " if keys else ""
        return f"""{name}s AS (SELECT {more}measure, value, sum(n) AS n FROM sk GROUP BY {more}measure, value),
        {name}c AS (SELECT *, sum(n) OVER (PARTITION BY {more}measure ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {more}measure) AS total FROM {name}s),
        {name}q AS (SELECT {more}measure, min(value) FILTER (upto * 4 >= total) AS q1, min(value) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS total FROM {name}c GROUP BY {more}measure),
        {name} AS (SELECT {more}measure, total, {low} AS low, q3 + {spread} AS high FROM {name}q)"""

    pick = lambda c: f"CASE WHEN o.total >= {least} THEN o.{c} WHEN l.total >= {least} THEN l.{c} ELSE e.{c} END"
    order = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(rules.MEASURES))
    each = " UNION ALL ".join(f"SELECT row_id, lang, source, '{m}' AS measure, {m} AS value FROM g WHERE NOT base_failed" for m in rules.MEASURES)
    return f"""WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '{space}', '', 'g') AS bare,
            list_filter(string_split_regex(coalesce(text, ''), '{space}'), lambda w: w <> '') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
        p AS (SELECT row_id, i, array_to_string(w[i:i + {window - 1}], ' ') AS x FROM (SELECT row_id, w, unnest(range(1, len(w) - {window - 2})) AS i FROM d WHERE len(w) >= {window})),
        r AS (SELECT row_id, i FROM p WHERE (row_id, x) IN (SELECT row_id, x FROM p GROUP BY row_id, x HAVING count(*) > 1)),
        n AS (SELECT row_id, count(DISTINCT j) AS n FROM (SELECT row_id, unnest(range(i, i + {window})) AS j FROM r) GROUP BY row_id),
        b AS (SELECT row_id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(bare) AS BIGINT) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
            len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_again,
            length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_capitals, length(text) - length(regexp_replace(text, '[\\p{{P}}\\p{{S}}]', '', 'g')) AS n_marks FROM d LEFT JOIN n USING (row_id)),
        g AS (SELECT *, {", ".join(f"{x} AS {m}" for m, x in unit.items())}, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
        m AS ({each}),
        sk AS (SELECT lang, source, measure, value - value % (CAST(1 AS BIGINT) << greatest(0, length(bin(value)) - 7)) AS value, count(*) AS n FROM m GROUP BY ALL),
        {fence("lang, source", "own")}, {fence("lang", "bylang")}, {fence("", "every")},
        f AS (SELECT row_id, string_agg(m.measure, ',' ORDER BY CASE m.measure {order} END) AS reasons FROM m JOIN own o ON o.lang IS NOT DISTINCT FROM m.lang AND o.source IS NOT DISTINCT FROM m.source AND o.measure = m.measure
            JOIN bylang l ON l.lang IS NOT DISTINCT FROM m.lang AND l.measure = m.measure JOIN every e ON e.measure = m.measure
            WHERE m.value > {pick("high")} OR m.value < {pick("low")} GROUP BY row_id)
        SELECT doc_id, n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
            NOT base_failed AND reasons IS NULL AS kept, coalesce(reasons, '') AS reasons FROM g LEFT JOIN f USING (row_id)"""


_NEGATIVES = f"""WITH {_KEPT.format(scale=256, more=", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", size="len(embedding) > 0", where=" AND vec_id IS NOT NULL AND label IS NOT NULL")},
    s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
        FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS i FROM s WHERE same) WHERE i <= 5),
    n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""


ORACLES = {
    "op11_centroid_clustering": _cluster_sql(),
    "op12_quality_rules": _rules_sql(),
    "op13_hard_negatives": _NEGATIVES,
    "op2_license_scan": f"""
        WITH k AS (SELECT template, license, {_WORDS.format(x="x")} AS w FROM (VALUES {_TEMPLATES}) AS v(template, license, x)),
        t AS (SELECT template, license, {_GRAMS.format(w="w")} AS g FROM k),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        m AS (SELECT doc_id, line, {_WORDS.format(x="x")} AS w FROM l),
        d AS (SELECT doc_id, line, {_GRAMS.format(w="w")} AS g FROM m WHERE len(w) BETWEEN 2 AND 200),
        p AS (SELECT doc_id, line, license, template, 2.0 * len(list_intersect(d.g, t.g)) / (len(d.g) + len(t.g)) AS dice FROM d, t)
        SELECT doc_id, CAST(line AS INTEGER) AS line, license, template, CAST(dice AS DOUBLE) AS dice FROM p WHERE dice >= 0.8""",
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20""",
}
