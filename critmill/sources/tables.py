"""Keyed tables: replacement, upsert, snapshot, reset."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in a temporary one where none is set and all runs on this machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def materialized(df: DataFrame) -> DataFrame:
    """Writes a table that several later steps read and reads it back: made once, with true sizes and a short plan."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the folders of tables that `materialized` wrote and nothing will read again."""
    for t in tables:
        spark = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables of at most so many narrow rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def counted_join(big: DataFrame, written: DataFrame, on: list[str] | str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a written table: broadcast where it has `most` rows at most (by default narrow ones), by shuffle beyond."""
    return big.join(F.broadcast(written) if written.count() <= most else written.hint("merge"), on, how)


def replace_by_key(target: DataFrame, batch: DataFrame, key: str, attempted: DataFrame | None = None) -> DataFrame:
    """Target without any row of an attempted key, then the batch; an attempted key without new rows loses its rows.

    Replaying a batch changes nothing. At scale, write with the key's bucket as a partition column and
    spark.sql.sources.partitionOverwriteMode=dynamic, so that only touched buckets are rewritten.
    """
    keys = batch.select(key) if attempted is None else attempted.select(key).union(batch.select(key))
    return target.join(keys.distinct(), key, "left_anti").select(*target.columns).unionByName(batch.select(*target.columns))


#: What happens to a column where stored and new row meet: old and new value to the result.
RULES = {
    "overwrite": lambda old, new: new,
    "keep": lambda old, new: old,
    "coalesce": lambda old, new: F.coalesce(new, old),
    "greatest": lambda old, new: F.greatest(old, new),
    "increment": lambda old, new: F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0)),
}


def single(updates: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Of several updates of a key the greatest row, by those of its columns that are named, in their order."""
    rest = [c for c in columns if c in updates.columns and c not in keys]
    if not rest:
        return updates.select(*keys).distinct()
    return updates.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("__r")).select(*keys, "__r.*")


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], rules: dict[str, object] | None = None, unique: bool = False) -> DataFrame:
    """Keyed merge by one full outer join; `rules` names a rule or gives f(old, new) by column (default: overwrite).

    Of several updates of a key, the greatest row (by its columns in the target's order) counts, so that none multiplies a
    stored row; `unique` updates have none of a key twice. Plain files have no MERGE, so the result is the whole new table.
    """
    rules, updates = rules or {}, updates if unique else single(updates, keys, target.columns)
    t = target.select("*", F.lit(True).alias("__t")).alias("t")
    u = updates.select("*", F.lit(True).alias("__u")).alias("u")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]
    j = t.join(u, on, "full_outer")
    out = []
    for c in target.columns:
        old, new = F.col(f"t.{c}"), F.col(f"u.{c}") if c in updates.columns else None
        if new is None:
            out.append(old.alias(c))
            continue
        rule = rules.get(c, "overwrite")
        both = (RULES[rule] if isinstance(rule, str) else rule)(old, new)
        out.append(F.when(F.col("u.__u").isNull(), old).when(F.col("t.__t").isNull(), new).otherwise(both).cast(target.schema[c].dataType).alias(c))
    return j.select(*out)


#: Results that a new start of an attempt clears.
ATTEMPT_RESULTS = ["finished_at", "criterion_count", "error_message", "llm_prompt_tokens", "llm_completion_tokens"]


def start_attempts(attempts: DataFrame, starts: DataFrame) -> DataFrame:
    """starts: run_id, nct_id, started_at. Sets them running and clears earlier results."""
    new = starts.select("run_id", "nct_id", "started_at", F.lit("running").alias("status"))
    for c in ATTEMPT_RESULTS:
        if c in attempts.columns:
            new = new.withColumn(c, F.lit(None).cast(attempts.schema[c].dataType))
    return upsert(attempts, new, ["run_id", "nct_id"])


def finish_attempts(attempts: DataFrame, results: DataFrame) -> DataFrame:
    """Sets status, counters and times of attempts that were started; others are ignored."""
    known = results.join(attempts.select("run_id", "nct_id"), ["run_id", "nct_id"], "left_semi")
    return upsert(attempts, known, ["run_id", "nct_id"], {"started_at": "keep"})


def record_failures(ledger: DataFrame, failures: DataFrame) -> DataFrame:
    """ledger and failures: nct_id, attempt_count, last_error; counts add up, the last error stays."""
    return upsert(ledger, failures, ["nct_id"], {"attempt_count": "increment", "last_error": "coalesce"})


def export_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Writes each table as Parquet and a manifest of row counts; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [(n, spark.read.parquet(f"{path}/{n}").count()) for n in sorted(tables)]
    manifest = spark.createDataFrame(counts, "table_name string, rows long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def import_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a bundle; raises if a count differs from the manifest."""
    out = {}
    for r in spark.read.schema("table_name string, rows long").json(f"{path}/manifest").collect():
        out[r.table_name] = spark.read.parquet(f"{path}/{r.table_name}")
        if (n := out[r.table_name].count()) != r.rows:
            raise ValueError(f"{r.table_name} has {n} rows; its manifest says {r.rows}")
    return out


def next_id(table: DataFrame, column: str = "id") -> DataFrame:
    """The id that follows a restored table's greatest."""
    return table.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next_id"))


def clear(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An empty table of the same schema, and how many rows went."""
    return table.limit(0), table.agg(F.count(F.lit(1)).alias("removed"))


def csv_field(c: Column) -> Column:
    """Quoted only where it holds a quote, comma or line break; quotes doubled; null is empty."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t)


def csv_rows(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    """One column `line` of rendered rows; the header is `csv_header`."""
    return df.select(F.concat_ws(",", *(csv_field(F.col(c)) for c in df.columns)).alias("line"))


def csv_header(df: DataFrame, headers: list[str] | None = None) -> DataFrame:
    names = [n if not set(n) & set('",\n\r') else '"' + n.replace('"', '""') + '"' for n in headers or df.columns]
    return df.sparkSession.createDataFrame([(",".join(names),)], "line string")


def export_csv(df: DataFrame, path: str, headers: list[str] | None = None) -> None:
    """Text files of CRLF lines, the header first in each file's order."""
    rows = csv_header(df, headers).coalesce(1).union(csv_rows(df))
    rows.write.mode("overwrite").option("lineSep", "\r\n").text(path)
