"""Session logs: JSON lines, batch or stream, and tab-separated test sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A line: content is a list of blocks, or a string (kept raw as text).
LINE = "struct<type:string,timestamp:string,message:struct<role:string,content:string>>"
BLOCKS = "array<struct<type:string,text:string>>"

# Entry types that carry no message.
SILENT = ("session", "model_change")


def parse(line: Column, block_types: tuple[str, ...] | None = None, most: int | None = None, skip: tuple[str, ...] = SILENT) -> Column:
    """struct<role, text, timestamp> of a line; null text for silent or malformed ones.

    Text blocks are joined by a space; ``block_types`` admits only those, and
    ``most`` cuts the text.
    """
    x = F.from_json(line, LINE)
    content = x["message"]["content"]
    blocks = F.from_json(content, BLOCKS)
    wanted = F.filter(blocks, lambda b: F.coalesce(b["text"], F.lit("")) != "")
    if block_types:
        wanted = F.filter(wanted, lambda b: b["type"].isin(*block_types))
    joined = F.array_join(F.transform(wanted, lambda b: b["text"]), " ")
    text = F.when(F.coalesce(x["type"].isin(*skip), F.lit(False)), F.lit(None)).when(content.rlike(r"^\s*\["), joined).otherwise(content)
    text = F.nullif(text, F.lit(""))
    if most:
        text = F.substring(text, 1, most)
    return F.struct(x["message"]["role"].alias("role"), text.alias("text"), x["timestamp"].alias("timestamp"))


#: A line with all the places where a time or a channel may stand.
WIDE_LINE = "struct<type:string,channel:string,timestamp:string,createdAt:string,time:string,role:string,content:string,message:struct<role:string,content:string,timestamp:string>>"
WIDE_BLOCKS = "array<struct<type:string,text:string,value:string>>"


def parse_daemon(line: Column, channel: str = "session", most: int = 1000) -> Column:
    """struct<role, text, source, timestamp>, the daemon's form: tool entries are silent
    too, only text blocks count, the text is cut; null text where nothing is said."""
    x = F.from_json(line, WIDE_LINE)
    content = F.coalesce(x["message"]["content"], F.when(x["message"].isNull(), x["content"]))
    blocks = F.filter(F.from_json(content, WIDE_BLOCKS), lambda b: b["type"] == "text")
    listed = F.coalesce(content, F.lit("[]")).rlike(r"^\s*\[")
    text = F.when(listed, F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], F.lit(""))), " ")).otherwise(content)
    silent = F.coalesce(x["type"].isin("session", "model_change", "tool_call", "tool_result"), F.lit(False))
    role = F.coalesce(x["message"]["role"], F.when(x["message"].isNull(), x["role"]), F.lit("unknown"))
    said = F.when(~silent & (F.trim(text) != ""), F.substring(text, 1, most))
    return F.struct(role.alias("role"), said.alias("text"), F.coalesce(x["channel"], F.lit(channel)).alias("source"), F.coalesce(x["timestamp"], x["message"]["timestamp"], x["createdAt"], x["time"]).alias("timestamp"))


def parse_roles(line: Column, roles: tuple[str, ...] = ("user", "assistant")) -> Column:
    """struct<role, text>: messages of these roles only; text, input and output blocks,
    trimmed and joined by a space."""
    x = F.from_json(line, WIDE_LINE)
    content = x["message"]["content"]
    own = F.transform(F.filter(F.from_json(content, WIDE_BLOCKS), lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: F.trim(F.coalesce(F.nullif(b["text"], F.lit("")), F.when(b["type"] != "text", b["value"]), F.lit(""))))
    text = F.when(content.rlike(r"^\s*\["), F.array_join(F.filter(own, lambda t: t != ""), " ")).otherwise(F.trim(content))
    ok = F.coalesce((x["type"] == "message") & x["message"]["role"].isin(*roles), F.lit(False))
    return F.struct(x["message"]["role"].alias("role"), F.when(ok, F.nullif(text, F.lit(""))).alias("text"))


def parse_first(line: Column, most: int = 500) -> Column:
    """struct<role, text>: a message's first text block, cut."""
    x = F.from_json(line, WIDE_LINE)
    first = F.get(F.filter(F.from_json(x["message"]["content"], WIDE_BLOCKS), lambda b: b["type"] == "text"), F.lit(0))["text"]
    ok = F.coalesce(x["type"] == "message", F.lit(False)) & x["message"]["role"].isNotNull()
    return F.struct(x["message"]["role"].alias("role"), F.when(ok, F.nullif(F.substring(first, 1, most), F.lit(""))).alias("text"))


def prefixed(text: Column, agent: Column, least: int = 20, most: int = 500) -> Column:
    """[AGENT] and how a text of ``least`` characters or more begins; null for others."""
    return F.when(F.char_length(text) >= least, F.concat(F.lit("["), F.upper(agent), F.lit("] "), F.substring(text, 1, most)))


def after_offsets(lines: DataFrame, files: DataFrame, offsets: DataFrame, bootstrap: str = "full") -> DataFrame:
    """Lines not read before: those that end beyond their file's offset.

    ``lines``: path, stop (bytes up to the line's end), line; ``files``: path,
    inode, size; ``offsets``: path, inode, pos.  A file whose inode changed, or
    that is shorter than its offset, is read anew; with ``bootstrap`` 'tail' a file
    without an offset isn't read, only noted.
    """
    known = files.select("path", "inode", "size").join(offsets.select("path", F.col("inode").alias("had"), "pos"), "path", "left")
    anew = (F.col("had") != F.col("inode")) | (F.col("pos") > F.col("size")) | (F.col("pos") < 0)
    first = F.col("size") if bootstrap == "tail" else F.lit(0)
    at = F.when(F.col("pos").isNull(), first).when(F.coalesce(anew, F.lit(False)), 0).otherwise(F.col("pos"))
    return lines.join(known.select("path", at.cast("long").alias("from")), "path").filter(F.col("stop") > F.col("from")).drop("from")


def next_offsets(files: DataFrame, offsets: DataFrame) -> DataFrame:
    """(path, inode, pos) once all lines are taken; files that are gone keep theirs."""
    fresh = files.select("path", "inode", F.col("size").alias("pos"))
    return offsets.join(fresh.select("path"), "path", "left_anti").select("path", "inode", "pos").unionByName(fresh)


def stable_id(path: Column, inode: Column, stop: Column) -> Column:
    """A message's id from where its line stands: the same on every replay."""
    return F.substring(F.sha1(F.concat_ws(":", path, inode.cast("string"), stop.cast("string"))), 1, 16)


def read(spark: SparkSession, glob: str) -> DataFrame:
    """(path, line) of all lines under a glob."""
    return spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def read_stream(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """The same as a stream; each file is read once, ``files`` at a time."""
    return spark.readStream.option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def messages(lines: DataFrame, least: int = 8) -> DataFrame:
    """(id, role, content): parsed lines with text of ``least`` characters or more."""
    m = lines.select("path", "line", parse(F.col("line")).alias("m")).filter(F.char_length(F.trim("m.text")) >= least)
    key = F.substring(F.sha1(F.concat_ws(":", F.col("path"), F.col("line"))), 1, 16)
    return m.select(key.alias("id"), "m.role", F.col("m.text").alias("content"), "m.timestamp")


def read_pairs(spark: SparkSession, path: str, language: str) -> DataFrame:
    """(premise, hypothesis, label) of one language from a tab-separated set.

    Labels outside the closed set, or no row of the language, raise an error
    when the frame is read.
    """
    names = ["language", "gold_label", "sentence1", "sentence2"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, quote="", enforceSchema=False)
    own = rows.filter(F.col("language") == language)
    known = F.when(F.col("gold_label").isin("entailment", "neutral", "contradiction"), F.col("gold_label")).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce("gold_label", F.lit("null")))).cast("string"))
    return own.select(F.col("sentence1").alias("premise"), F.col("sentence2").alias("hypothesis"), known.alias("label"))
