"""Saved model and service responses as tables: parsing, repair, outcomes, audit rows."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import deterministic_id, let, strip_bullet, trimmed, tui_from_uri
from ..sources.tables import upsert
from .repair import repaired

#: Where an envelope may hold its text, in this order.
TEXT_FIELDS = ["text", "output", "message", "content"]
JSON_BLANKS = " \t\r\n"
#: Record fields and the columns that hold them.
FIELDS = {"NCT_ID": "nct_id", "Criterion": "criterion", "Domain": "domain", "Concept": "concept", "Qualifier": "qualifier", "TimeWindow": "time_window", "OriginalText": "original_text"}
#: A sound record in one cast: missing fields are null.
PLAIN = f"struct<{', '.join(f'{n}: string' for n in FIELDS)}>"


@F.pandas_udf(StringType())
def repair_json(texts: pd.Series) -> pd.Series:
    """Clean JSON of malformed record arrays; null stays null, so callers pass only what failed a strict parse."""
    return texts.map(repaired, na_action="ignore")


def _kind(v: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def _field(v: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _text_field(v: Column, name: str) -> Column:
    """A member that is a string, else null."""
    return let(_field(v, name, "variant"), lambda x: F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def parse_strict(text: Column) -> Column:
    """The parsed text, or null where it is no JSON or more stands after it (the built-in parser stops at the end of the first value)."""
    whole = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return let(whole, lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant")))


def payload(raw: Column) -> Column:
    """The text of an envelope, from its first bracket, without code fences; null if there is none."""
    filled = lambda v: lambda n: let(_text_field(v, n), lambda t: F.when(trimmed(t) != "", t))
    first = F.substring(F.ltrim(raw, F.lit(JSON_BLANKS)), 1, 1)  # tells an object and a string, if it's JSON; nothing else is an envelope
    body = F.when(first == "{", let(parse_strict(raw), lambda v: F.when(v.isNull(), raw).otherwise(F.coalesce(*map(filled(v), TEXT_FIELDS)))))
    text = body.when(first == '"', F.coalesce(F.try_variant_get(parse_strict(raw), "$", "string"), raw)).otherwise(raw)
    text = F.rtrim(text, F.lit("` \t\r\n"))  # a fence at the end; one at the begin goes with all that stands before the bracket
    place = lambda t, mark: F.nullif(F.instr(t, mark), F.lit(0))
    return let(text, lambda t: F.substring(t, F.least(place(t, "["), place(t, "{")), F.length(t)))


def parse_responses(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """nct_id, outcome (success, empty_array, invalid_json), was_repaired and records of each row of nct_id, raw; behind them the columns to keep.

    A strict parse comes first; only text that fails it is read leniently (`repair`) and parsed once more. A record is an
    object, or a string that holds one with an NCT_ID; the trial's own nct_id takes the place of the model's. Numbers and
    truth values become text (a number in the parser's notation: 1e3 gives 1000.0). Duplicate keys need
    spark.sql.variant.allowDuplicateKeys=true.
    """
    own = F.nullif(trimmed(F.col("nct_id")), F.lit(""))  # a row once, not each of its records
    t = df.select("nct_id", *keep, own.alias("own"), F.when(F.col("raw").rlike(r"(?U)\S"), payload(F.col("raw"))).alias("text"))
    t = t.withColumn("strict", parse_strict(F.col("text")))
    t = t.withColumn("mended", repair_json(F.when(F.col("strict").isNull(), F.col("text"))))
    t = t.withColumn("second", parse_strict(F.col("mended")))
    t = t.withColumn("was_repaired", F.col("strict").isNull() & F.col("second").isNotNull()).withColumn("root", F.coalesce("strict", "second"))
    root = F.col("root")

    def record(i: Column, text_of) -> Column:
        texts = {c: text_of(n) for n, c in FIELDS.items()}
        texts |= {"nct_id": F.coalesce("own", texts["nct_id"]), "original_text": strip_bullet(texts["original_text"])}
        return F.struct(i.alias("ord"), *(x.alias(c) for c, x in texts.items()))

    # Nearly all responses are arrays of plain objects: one cast reads them. A field that may hold an object or array (its text begins like one), and an
    # element that is no object, are told apart one by one below.
    t = t.withColumn("plain", F.try_variant_get(root, "$", f"array<{PLAIN}>"))
    nested = lambda x: reduce(Column.__or__, (F.coalesce(x[n].startswith("{") | x[n].startswith("["), F.lit(False)) for n in FIELDS))
    odd = F.exists("plain", lambda x: x.isNull() | nested(x))
    fast = F.transform("plain", lambda x, i: record(i, lambda n: F.coalesce(x[n], F.lit(""))))

    items = F.when(_kind(root) == "ARRAY", F.try_variant_get(root, "$", "array<variant>")).when(_kind(root) == "OBJECT", F.array(root))
    inner = lambda x: F.try_parse_json(F.when(_kind(x) == "STRING", F.try_variant_get(x, "$", "string")))
    told = lambda x: let(inner(x), lambda y: F.when((_kind(y) == "OBJECT") & _field(y, "NCT_ID", "variant").isNotNull(), y))
    objects = F.filter(F.transform(items, lambda x: F.when(_kind(x) == "OBJECT", x).otherwise(told(x))), lambda x: x.isNotNull())
    scalar = lambda y: F.when(_kind(y).isin("OBJECT", "ARRAY"), F.lit("")).otherwise(F.coalesce(F.try_variant_get(y, "$", "string"), F.lit("")))
    slow = F.transform(objects, lambda x, i: record(i, lambda n: F.coalesce(let(_field(x, n, "variant"), scalar), F.lit(""))))
    t = t.withColumn("records", F.when(F.col("plain").isNotNull() & ~odd, fast).otherwise(slow))
    outcome = F.when(root.isNull(), "invalid_json").when(F.coalesce(F.size("records"), F.lit(0)) > 0, "success").otherwise("empty_array")
    # The explode of one element keeps later filters from making the records again.
    return t.select(F.explode(F.array(F.struct("nct_id", outcome.alias("outcome"), "was_repaired", "records", *keep))).alias("r")).select("r.*")


def records(parsed: DataFrame) -> DataFrame:
    """One row a record, with its place in the response."""
    return parsed.select(F.inline("records"))


def attempt_status(parsed: DataFrame, failed: Column | None = None) -> DataFrame:
    """Adds status and message to parsed rows; `failed` marks rows whose response never came."""
    failed = F.lit(False) if failed is None else F.coalesce(failed, F.lit(False))
    status = F.when(failed, "llm_failed").when(F.col("outcome") == "invalid_json", "parse_invalid_json").when(F.col("outcome") == "empty_array", "parse_empty").otherwise("success")
    t = parsed.withColumn("status", status)
    message = F.when(F.col("status") == "llm_failed", "no response").when(F.col("status") == "parse_invalid_json", "the response holds no readable JSON").when(F.col("status") == "parse_empty", "the response holds no record")
    return t.withColumn("message", message)


def prefer_escalated(base: DataFrame, second: DataFrame) -> DataFrame:
    """Parsed rows, with the second response's where the first was an empty array and the second has records."""
    s = second.filter("outcome = 'success'").select("nct_id", *(F.col(c).alias(f"__{c}") for c in base.columns if c != "nct_id"))
    t = base.join(s.hint("merge"), "nct_id", "left")  # both may come from a parser, whose size Spark can't tell
    use = (F.col("outcome") == "empty_array") & F.col("__outcome").isNotNull()
    return t.select("nct_id", *(F.when(use, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in base.columns if c != "nct_id"), use.alias("escalated"))


def empty_batch_placeholder(rows: DataFrame) -> DataFrame:
    """An empty batch becomes one row of empty text, which persistence drops for its empty nct_id."""
    if not rows.isEmpty():
        return rows
    return rows.sparkSession.range(1).select(*(F.lit("" if f.dataType.simpleString() == "string" else None).cast(f.dataType).alias(f.name) for f in rows.schema))


def completion_fields(df: DataFrame) -> DataFrame:
    """Content, finish reason, token counts and stop diagnostics of saved chat completions (raw), or why there are none."""
    v = F.try_parse_json("raw")
    t = df.withColumn("__v", v).withColumn("__choices", _field(F.col("__v"), "choices", "variant"))
    t = t.withColumn("__first", F.try_variant_get("__choices", "$[0]", "variant"))
    bad = F.when(F.coalesce(_kind(F.col("__v")), F.lit("")) != "OBJECT", "root is no object").when(F.coalesce(_kind(F.col("__choices")), F.lit("")) != "ARRAY", "no choices array").when(F.coalesce(_kind(F.col("__first")), F.lit("")) != "OBJECT", "choices array is empty")
    text = lambda c: F.coalesce(c, F.lit(""))
    number = lambda n: F.coalesce(let(_field(F.col("__v"), f"usage.{n}", "variant"), lambda x: F.when(_kind(x).isin("BIGINT", "DECIMAL"), F.try_variant_get(x, "$", "int"))), F.lit(0))
    truth = lambda n: let(_field(F.col("__v"), n, "variant"), lambda x: F.when(_kind(x) == "BOOLEAN", F.try_variant_get(x, "$", "boolean")))
    ok = lambda c: F.when(F.col("error").isNull(), c)
    t = t.withColumn("error", bad)
    out = {
        "content": text(_text_field(F.col("__first"), "message.content")), "finish_reason": text(_text_field(F.col("__first"), "finish_reason")),
        "prompt_tokens": number("prompt_tokens"), "completion_tokens": number("completion_tokens"), "stopped_eos": truth("stopped_eos"), "stopped_limit": truth("stopped_limit"),
        "stopped_word": truth("stopped_word"), "stopping_word": text(_text_field(F.col("__v"), "stopping_word")), "truncated": truth("truncated"),
    }
    return t.select(*df.columns, "error", *(ok(c).alias(n) for n, c in out.items()))


def embedding_vectors(df: DataFrame) -> DataFrame:
    """The vector of saved embedding responses (raw), or why there is none."""
    t = df.withColumn("__v", F.try_parse_json("raw")).withColumn("__data", _field(F.col("__v"), "data", "variant"))
    t = t.withColumn("__first", F.try_variant_get("__data", "$[0]", "variant")).withColumn("__e", _field(F.col("__first"), "embedding", "variant"))
    t = t.withColumn("__items", F.when(_kind(F.col("__e")) == "ARRAY", F.try_variant_get("__e", "$", "array<variant>")))
    none = F.lit("")
    bad = (
        F.when(F.coalesce(_kind(F.col("__v")), none) != "OBJECT", "root is no object").when(F.coalesce(_kind(F.col("__data")), none) != "ARRAY", "no data array").when(F.coalesce(_kind(F.col("__first")), none) != "OBJECT", "data array is empty")
        .when(F.col("__items").isNull(), "no embedding array").when(F.exists("__items", lambda x: x.isNull() | ~_kind(x).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")), "an element is no number").when(F.size("__items") == 0, "vector is empty")
    )
    t = t.withColumn("error", bad)
    return t.select(*df.columns, "error", F.when(F.col("error").isNull(), F.transform("__items", lambda x: F.try_variant_get(x, "$", "float"))).alias("embedding"))


def terminology_search_results(df: DataFrame) -> DataFrame:
    """ord, ui, name, root_source of saved searches (raw), in order, without blank or NONE ids; malformed ones give no rows."""
    items = F.from_json("raw", "result struct<results:array<struct<ui:string,name:string,rootSource:string>>>")["result"]["results"]
    t = df.select(*[c for c in df.columns if c != "raw"], F.posexplode(items).alias("ord", "r"))
    t = t.filter((F.coalesce("r.ui", F.lit("")) != "") & (F.upper("r.ui") != "NONE"))
    return t.select(*[c for c in t.columns if c != "r"], F.col("r.ui").alias("ui"), F.coalesce("r.name", F.lit("")).alias("name"), F.coalesce("r.rootSource", F.lit("")).alias("root_source"))


def terminology_concept_types(df: DataFrame) -> DataFrame:
    """ord, tui, sty of saved concept details (raw); blank names are skipped."""
    items = F.from_json("raw", "result struct<semanticTypes:array<struct<name:string,uri:string>>>")["result"]["semanticTypes"]
    t = df.select(*[c for c in df.columns if c != "raw"], F.posexplode(items).alias("ord", "r")).filter(F.coalesce("r.name", F.lit("")) != "")
    return t.select(*[c for c in t.columns if c != "r"], tui_from_uri(F.coalesce("r.uri", F.lit(""))).alias("tui"), F.col("r.name").alias("sty"))


#: Names the keys of audit rows.
AUDIT_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def criteria_audit(studies: DataFrame, criteria: DataFrame, sources: DataFrame) -> DataFrame:
    """A row for each criterion and source (one for a criterion without): origin, and a key that stays the same from run to run.

    studies: study_id, title; criteria: criterion_id, study_id, criterion, concept, note; sources: criterion_id, nct_id, code, text.
    """
    t = criteria.join(studies, "study_id").join(sources, "criterion_id", "left")
    has = F.max(F.col("nct_id").isNotNull().cast("int")).over(_by("criterion_id"))
    origin = F.when((has == 1) | (trimmed(F.coalesce("note", F.lit(""))) != ""), "Normalised").otherwise("Manually entered")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    key = deterministic_id(AUDIT_NAMESPACE, F.concat_ws("|", blank("criterion_id"), blank("nct_id"), blank("code"), blank("text")))
    return t.select(key.alias("row_id"), "study_id", "title", "criterion_id", "criterion", "concept", origin.alias("origin"), "nct_id", "code", "text")


def _by(*names: str):
    from pyspark.sql import Window

    return Window.partitionBy(*names)


def sync_children(target: DataFrame, new: DataFrame, parent: str, key: str, keep: tuple[str, ...] = ("created_at", "created_by")) -> DataFrame:
    """Children of every parent that `new` names become the new ones; other parents' stay.

    A child that stays (by its key) is updated but for the `keep` columns, others of the parent go.
    """
    others = target.join(new.select(parent).distinct(), parent, "left_anti")
    kept = target.join(new.select(parent, key).distinct(), [parent, key], "left_semi")
    return others.unionByName(upsert(kept.select(*target.columns), new, [key], {c: "keep" for c in keep if c in target.columns})).select(*target.columns)


def replace_sources(sources: DataFrame, new: DataFrame, kept: DataFrame, key: str = "criterion_id") -> DataFrame:
    """Sources of the kept children become the new ones; those of other children stay. kept: the ids that sync_children took."""
    return sources.join(kept.select(key).distinct(), key, "left_anti").select(*sources.columns).unionByName(new.select(*sources.columns))
