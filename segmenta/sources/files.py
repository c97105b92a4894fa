"""Messages from and to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.trees import parse_tree
from ..operators.chunked import id_chunk, numbered, running
from ..session import durable

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (
    ("seq", T.LongType()), ("feed", T.StringType()), ("trigger", T.StringType()), ("controlId", T.StringType()),
    ("at", T.TimestampType()), ("event", T.StringType()), ("part", T.LongType()), ("offset", T.LongType()), ("length", T.IntegerType()))])
#: Values of the order that make a part of a corpus, which is read whole.
PART_ROWS = 1 << 17
FILES = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                      T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def _as_messages(files: DataFrame) -> DataFrame:
    name = F.url_decode(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("+"), F.lit("%2B")))
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("content").alias("raw"),
                        F.create_map(F.lit("source.file"), name).alias("meta"))


def read_message_files(spark: SparkSession, path: str, pattern: str = "*", min_age: str = "1 second",
                       now: Column | None = None) -> DataFrame:
    """One file, one message; files younger than ``min_age`` are left for later."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    cutoff = (F.current_timestamp() if now is None else now) - F.expr(f"INTERVAL {min_age}")
    return _as_messages(f.filter(F.col("modificationTime") <= cutoff))


def stream_message_files(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1000,
                         archive: str | None = None) -> DataFrame:
    """The same as a stream; the checkpoint delivers each file once, and a
    processed file can move to ``archive``."""
    r = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_batch)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return _as_messages(r.load(path))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Messages of concatenated HL7 files; the scan splits large files."""
    t = spark.read.option("lineSep", "\rMSH").text(path)
    v = F.col("value")
    text = F.when(v.startswith("MSH"), v).otherwise(F.concat(F.lit("MSH"), v))
    return t.select(F.when(text.endswith("\r"), text).otherwise(F.concat(text, F.lit("\r"))).alias("raw"))


def read_corpus_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(path)


def read_csv_rows(spark: SparkSession, path: str, width: int, header: bool = False) -> DataFrame:
    """CSV files: c1..c<width> and ``rest``, an array of the cells beyond.

    Short rows end in NULL columns and have no rest.  A file is one text, so it is read in one task; rows come in its order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    rows = parse_tree(files, "csv").select(F.posexplode(F.slice("msg.rows", F.lit(2 if header else 1), F.greatest(F.size("msg.rows"), F.lit(1)))).alias("at", "r"))
    cells = [F.get("r", F.lit(i)).alias(f"c{i + 1}") for i in range(width)]
    return rows.select(*cells, F.slice("r", F.lit(width + 1), F.greatest(F.size("r"), F.lit(1))).alias("rest"))


def unique_names(df: DataFrame, id_col: str, name: str = "name", chunk_rows: int = 1 << 20) -> DataFrame:
    """Add ``unique_name``: a taken name gets .1, .2, ... in id order."""
    n = numbered(df, [name], [id_col], id_chunk(F.col(id_col), chunk_rows), "__n")
    return n.withColumn("unique_name", F.when(F.col("__n") == 1, F.col(name)).otherwise(
        F.concat(F.col(name), F.lit("."), (F.col("__n") - 1).cast("string")))).drop("__n")


def write_payloads(df: DataFrame, path: str, name: Column, id_col: str = "msg_id") -> None:
    """Payload rows with their collision-free file name, partitioned by
    channel and destination; published by the commit protocol."""
    unique_names(df.withColumn("name", name), id_col).write.mode("append").partitionBy("channel_id", "destination_id").parquet(path)


def write_append_csv(df: DataFrame, path: str) -> None:
    """Running CSV; every part file repeats the header."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def corpus_manifest(df: DataFrame, order: str = "msg_id", part_rows: int = PART_ROWS) -> DataFrame:
    """Add seq and start, the position in the whole corpus, in one global order, and part, offset and length of each
    message within its part."""
    sized = df.withColumn("length", F.octet_length(F.col("raw"))).withColumn("part", id_chunk(F.col(order), part_rows))
    out = running(sized, [], [order], id_chunk(F.col(order), part_rows), before=("sum", F.lit(1).cast("long")),
                  start=("sum", F.col("length").cast("long")))
    out = running(out, ["part"], [order], F.lit(0), offset=("sum", F.col("length").cast("long")))
    return out.withColumn("seq", F.col("before") + 1).drop("before")


def write_corpus(df: DataFrame, path: str, order: str = "msg_id", part_rows: int = PART_ROWS) -> None:
    """Messages in parts of at most ``part_rows`` values of the order, one file a part, and a manifest that points into them.

    The input is computed once, into the shared checkpoint folder."""
    text = F.col("raw").cast("string")
    kept = [c for c in ("feed", "trigger", "control_id", "ts", "event") if c in df.columns]
    ended = durable(df.select(order, *kept, F.when(text.endswith("\r"), text).otherwise(F.concat(text, F.lit("\r"))).alias("raw")))
    # the writer's separator is the CR that ends every message
    body = F.substring("raw", F.lit(1), F.length("raw") - 1)
    ended.withColumn("part", id_chunk(F.col(order), part_rows)).repartition("part").sortWithinPartitions("part", order) \
        .select("part", body.alias("value")).write.mode("overwrite").partitionBy("part").option("lineSep", "\r").text(f"{path}/messages")
    has = lambda c, kind: (F.col(c) if c in kept else F.lit(None)).cast(kind)
    corpus_manifest(ended, order, part_rows).select(
        "seq", has("feed", "string").alias("feed"), has("trigger", "string").alias("trigger"), has("control_id", "string").alias("controlId"),
        has("ts", "timestamp").alias("at"), F.coalesce(has("event", "string"), F.lit("")).alias("event"), "part", "offset", "length") \
        .repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").json(f"{path}/manifest")


def corpus_messages(spark: SparkSession, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """The manifest's rows (all, or those given) with ``raw``, cut from their parts by offset and length.

    A part meets its entries as one row, so its bytes are read once and not copied per message.  A row whose part is
    missing or too short has a NULL raw."""
    rows = read_corpus_manifest(spark, f"{path}/manifest") if manifest is None else manifest
    entries = rows.groupBy("part").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "part"))).alias("entries"))
    files = spark.read.format("binaryFile").option("basePath", f"{path}/messages").load(f"{path}/messages") \
        .select(F.col("part").cast("long").alias("of"), "content")
    cut = F.expr("transform(entries, e -> named_struct('e', e, 'raw', substring(content, e.offset + 1, e.length)))")
    got = entries.join(files, F.col("part") == F.col("of"), "left").select("part", F.explode(cut).alias("x")).select("part", "x.e.*", "x.raw")
    return got.withColumn("raw", F.when(F.octet_length("raw") == F.col("length"), F.col("raw")))
