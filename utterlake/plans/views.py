"""Input views of the registered queries, once in Spark and once as DuckDB CTEs of the same names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# The event types in order; a frame's label is the place of its type, 0 stands for blank.
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
# What each event type stands for in a session.
SESSION_EVENTS = {"error": "interrupted", "click": "speech_start", "view": "speech_end", "signup": "tts_start", "purchase": "reply_done"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, p, label, ts"""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    label = F.array_position(F.array(*[F.lit(t) for t in EVENT_TYPES]), F.col("event_type")) - 1
    return e.select(F.col("user_id").alias("key"), (F.row_number().over(order) - 1).cast("long").alias("seq"), F.least(F.col("value") / 100, F.lit(1.0)).alias("p"), label.cast("long").alias("label"), "ts")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stage, ms, ts, event_id"""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"), "ts", "event_id")


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, ts, event_id, type"""
    kind = F.create_map(*[F.lit(x) for pair in SESSION_EVENTS.items() for x in pair])[F.col("event_type")]
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("ts").cast("timestamp").alias("ts"), "event_id", kind.alias("type"))


def waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, n, x"""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.posexplode("embedding").alias("n", "v")).select("key", F.col("n").cast("long").alias("n"), F.col("v").cast("double").alias("x"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, speaker, v"""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("speaker"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def hyp_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, engine, ref, hyp: a turn's text, normalised, and the next turn's."""
    c = table(spark, sf_dir, "conversations")
    whole = tx.normalize(F.col("text"))
    following = F.lead("ref").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.select("conv_id", "turn", F.col("role").alias("engine"), whole.alias("ref")).withColumn("hyp", following).where("hyp is not null and ref is not null")


def sentence_rows(spark: SparkSession, sf_dir: str, min_words: int = 4, max_words: int = 16) -> DataFrame:
    """doc_id, pos, sentence, norm: sentences of 4 to 16 words, the first of equal ones."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("norm", tx.normalize(F.col("sentence")))
    rows = rows.withColumn("n_words", F.size(tx.words(F.col("norm"))).cast("long")).where(F.col("n_words").between(min_words, max_words))
    first = Window.partitionBy("norm").orderBy("doc_id", "pos")
    return rows.withColumn("__r", F.row_number().over(first)).where("__r = 1").select("doc_id", F.col("pos").cast("long").alias("pos"), "sentence", "norm", "n_words")


def manifest(spark: SparkSession, sf_dir: str, rows: Column | None = None) -> DataFrame:
    """path, speaker, duration, text of all documents, or of those with ``rows``, a predicate on stored columns"""
    d = table(spark, sf_dir, "documents")
    d = d if rows is None else d.where(rows)
    return d.select(F.concat_ws("", "source", F.lit("/"), "source", F.lit("-"), "doc_id").alias("path"), F.col("source").alias("speaker"), (F.col("n_chars") / 15.0).alias("duration"), "text", "doc_id")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, step, metric"""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), (F.row_number().over(order) - 1).cast("long").alias("step"), F.col("value").alias("metric"))


_NORM = "trim(regexp_replace(regexp_replace(lower({t}), '[^a-z'' ]+', ' ', 'g'), ' +', ' ', 'g'))"


def norm_sql(column: str) -> str:
    return _NORM.format(t=column)


SQL = {
    "frames": """SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, least(value / 100, 1.0) AS p,
        list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS label, ts FROM events""",
    "stages": "SELECT event_type AS stage, value AS ms, ts, event_id FROM events",
    "session_events": """SELECT user_id AS session, ts, event_id, CASE event_type WHEN 'error' THEN 'interrupted' WHEN 'click' THEN 'speech_start' WHEN 'view' THEN 'speech_end'
        WHEN 'signup' THEN 'tts_start' WHEN 'purchase' THEN 'reply_done' END AS type FROM events""",
    "waves": "SELECT vec_id AS key, CAST(unnest(range(len(embedding))) AS BIGINT) AS n, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "vectors": "SELECT vec_id AS id, CAST(label AS BIGINT) AS speaker, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "hyp_ref": f"""SELECT conv_id, turn, engine, ref, hyp FROM (SELECT conv_id, turn, role AS engine, ref, lead(ref) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM (
        SELECT conv_id, turn, role, {norm_sql('text')} AS ref FROM conversations)) WHERE hyp IS NOT NULL AND ref IS NOT NULL""",
    "sentence_rows": f"""SELECT doc_id, pos, sentence, norm, n_words FROM (
        SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, pos) AS r FROM (
          SELECT *, CAST(len(list_filter(string_split(norm, ' '), lambda w: w <> '')) AS BIGINT) AS n_words FROM (
            SELECT doc_id, pos, sentence, {norm_sql('sentence')} AS norm FROM (
              SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS sentence FROM (
                SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS l
                FROM documents))))
        WHERE n_words BETWEEN 4 AND 16) WHERE r = 1""",
    "manifest": "SELECT source || '/' || source || '-' || doc_id AS path, source AS speaker, n_chars / 15.0 AS duration, text, doc_id FROM documents",
    "runs": "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS metric FROM events",
}


def sql(body: str, *names: str) -> str:
    """A statement over some of the views."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + " " + body


def with_sql(body: str, *names: str) -> str:
    """The same, where ``body`` goes on with further CTEs."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + ", " + body
