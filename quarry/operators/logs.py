"""Analytics of JSON-line logs (ts, level, event, message, modes, request_id, context)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "ts string, level string, event string, message string, modes array<string>, request_id string, context map<string,string>"
# What a message of each kind of event holds, in the order in which they are tried, and the modes in which lines are seen
EVENT_RULES = [
    ("[access.start]", "access.start"),
    ("[access]", "access"),
    ("[service] lifecycle", "service.lifecycle"),
    ("[recommendations] layer timing:", "recommendations.layer_timing"),
    ("[recommendations] profile=", "recommendations.profile"),
    ("[recommendations] exploit cache seed batch", "recommendations.exploit_seed_batch"),
    ("[recommendations] incoming likes body=", "recommendations.incoming_likes_body"),
    ("[similar-cache] hit source=", "similarity.cache_hit"),
    ("[similar-server] candidates=", "similarity.candidates"),
    ("] done count=", "similarity.request_done"),
]
MODES = ["focused", "verbose"]
#: What is told instead of the message.
MESSAGES = {"access.start": "request started", "access": "request finished", "recommendations.incoming_likes_body": "[recommendations] incoming likes", "service.lifecycle": None}
GRAVE = ["WARNING", "ERROR", "CRITICAL"]


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def _fields(message: Column) -> Column:
    """The key=value tokens behind a message's leading [blocks], without commas around values; the last of a key counts."""
    tokens = F.filter(F.split(F.trim(F.regexp_replace(message, r"^(?:\[[^\]]+\])+\s*", "")), r"\s+"), lambda t: F.instr(t, "=") > 1)
    backwards = F.reverse(tokens)
    keys = F.transform(backwards, lambda t: F.substring_index(t, "=", 1))
    values = F.transform(backwards, lambda t: F.btrim(F.regexp_replace(t, "^[^=]*=", ""), F.lit(",")))
    return F.map_from_entries(F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), F.element_at(values, F.array_position(keys, k).cast("int")).alias("value"))))


def classified(logs: DataFrame) -> DataFrame:
    """With event, modes and request_id where they are missing, the message's fields as ``pairs``, and what is told instead of the message.

    Lines of less than a warning are named by the first rule that they hold, and are seen in
    all modes; others by the scope in front of the message, graver ones in all modes, the rest in verbose.
    """
    message, grave = F.coalesce("message", F.lit("")), F.upper("level").isin(*GRAVE)
    scope = F.replace(F.lower(F.trim(F.regexp_extract(message, r"^\[([^\]]+)\]", 1))), F.lit("-"), F.lit("_"))
    derived = F.when(scope == "", "engine.log").otherwise(F.concat(scope, F.lit(".info")))
    ruled = F.coalesce(*[F.when(~F.coalesce(grave, F.lit(False)) & F.contains(message, F.lit(needle)), name) for needle, name in EVENT_RULES])
    event, all_modes = F.coalesce("event", ruled, derived), F.array(*map(F.lit, MODES))
    modes = F.coalesce("modes", F.when(grave | ruled.isNotNull(), all_modes).otherwise(F.array(F.lit("verbose"))))
    request = F.coalesce(F.when(F.trim("request_id") != "", F.trim("request_id")), F.nullif(F.trim(F.regexp_extract(message, r"^\[[^\]]+\]\[([^\]]+)\]", 1)), F.lit("")))
    df = logs.withColumns({"pairs": _fields(message), "event": event, "modes": modes, "request_id": request})
    told = F.col("message")
    for name, text in MESSAGES.items():
        told = F.when(F.col("event") == name, F.lit(text)).otherwise(told)
    return df.withColumn("message", told)


def visible(logs: DataFrame, mode: str) -> DataFrame:
    """Lines of the mode (verbose, if it is none of MODES): warnings and graver ones always, lines without modes in verbose."""
    mode = (mode or "").strip().lower()
    mode = mode if mode in MODES else "verbose"
    tagged = F.coalesce(F.size("modes") > 0, F.lit(False))
    return logs.where(F.coalesce(F.upper("level").isin(*GRAVE), F.lit(False)) | F.when(tagged, F.array_contains("modes", mode)).otherwise(F.lit(mode == "verbose")))


def stage_durations(logs: DataFrame) -> DataFrame:
    """(stage, n, seconds): the n-th "stage X started" is paired with the n-th "stage X finished"."""
    m = F.lower("message")
    df = logs.select(F.regexp_extract(m, r"stage (\S+) (started|finished)", 1).alias("stage"), F.regexp_extract(m, r"stage (\S+) (started|finished)", 2).alias("mark"), F.to_timestamp("ts").alias("at")).where("mark <> ''")
    df = df.withColumn("n", F.row_number().over(W.partitionBy("stage", "mark").orderBy("at")))
    pair = df.groupBy("stage", "n").agg(F.max(F.when(F.col("mark") == "started", F.col("at"))).alias("a"), F.max(F.when(F.col("mark") == "finished", F.col("at"))).alias("b"))
    return pair.where("a is not null and b is not null").select("stage", "n", (F.unix_millis("b") - F.unix_millis("a")).alias("ms"))


def write(logs: DataFrame, path: str) -> None:
    """Lines of JSON with event and pairs filled in, appended."""
    c = classified(logs)
    c.withColumn("context", F.coalesce("context", "pairs")).select(*[f.split()[0] for f in SCHEMA.split(", ")]).write.mode("append").json(path)
