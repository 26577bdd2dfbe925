"""The protocol of workers, as a stream: lines with a prefix carry JSON messages, other lines are chatter.

The same functions serve a batch of lines and a streaming DataFrame; the fold is an aggregation by job,
so it runs in update mode with one row of state for each job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

PREFIX = "@@MSG@@ "
TAIL = 25
MESSAGE = "type string, value double, text string, message string, level string, data string"
LINE = "job_id long, seq long, line string"


def read_lines(spark: SparkSession, path: str, max_files: int = 16) -> DataFrame:
    """A stream of (job_id, seq, line) from JSON files that arrive in a folder."""
    return spark.readStream.schema(LINE).option("maxFilesPerTrigger", max_files).json(path)


def parse(lines: DataFrame, prefix: str = PREFIX) -> DataFrame:
    """lines with kind and msg: message with its fields, bad (a prefix but no JSON object; to be ignored), blank or tail."""
    body = F.expr(f"substring(line, {len(prefix) + 1})")
    msg = F.from_json(body, MESSAGE, {"mode": "PERMISSIVE"})
    has = F.col("line").startswith(prefix)
    kind = F.when(has & msg["type"].isNotNull(), "message").when(has, "bad").when(F.trim(F.coalesce("line", F.lit(""))) == "", "blank").otherwise("tail")
    return lines.withColumn("msg", F.when(has, msg)).withColumn("kind", kind)


def fold(parsed: DataFrame) -> DataFrame:
    """The state of each job: last progress and description, number of logs, last result and error, whether canceled.

    Where several messages of a kind came, that of the highest seq counts.
    """
    of = lambda t, c: F.max_by(F.when(F.col("msg.type") == t, F.col(c)), F.when(F.col("msg.type") == t, F.col("seq")))
    return parsed.where("kind in ('message', 'tail')").groupBy("job_id").agg(
        of("progress", "msg.value").alias("progress"),
        of("describe", "msg.text").alias("description"),
        F.count_if(F.col("msg.type") == "log").alias("logs"),
        of("result", "msg.data").alias("result"),
        of("error", "msg.message").alias("error"),
        F.coalesce(F.bool_or(F.col("msg.type") == "error"), F.lit(False)).alias("failed"),
        F.coalesce(F.bool_or(F.col("msg.type") == "canceled"), F.lit(False)).alias("canceled"),
        F.coalesce(F.bool_or(F.col("msg.type") == "result"), F.lit(False)).alias("done"),
    )


def terminal(folded: DataFrame) -> DataFrame:
    """folded with status: canceled before error before no_result before result."""
    return folded.withColumn("status", F.when(F.col("canceled"), "canceled").when(F.col("failed"), "error").when(~F.col("done"), "no_result").otherwise("result"))


def tail(parsed: DataFrame, n: int = TAIL) -> DataFrame:
    """The last n lines of each job that are no messages, for the text of an error."""
    order = F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("seq")))
    return parsed.where("kind = 'tail'").withColumn("r", order).where(F.col("r") <= n).select("job_id", "seq", "line")


def pull_progress(lines: DataFrame, total: int) -> DataFrame:
    """(job_id, percent) from lines "layer: status": half for layers downloaded, half for layers pulled, from 1 to 99; 0 if total is 0."""
    layer, status = F.trim(F.split("line", ":")[0]), F.trim(F.get(F.split("line", ":"), F.lit(1)))
    done = lambda what: F.count_distinct(F.when(status.contains(what), layer))
    counts = lines.groupBy("job_id").agg(done("Download complete").alias("d"), done("Pull complete").alias("p"))
    share = (F.col("d") * 50 / F.lit(float(total or 1)) + F.col("p") * 50 / F.lit(float(total or 1))).cast("int")
    return counts.select("job_id", (F.greatest(F.lit(1), F.least(F.lit(99), share)) if total > 0 else F.lit(0)).alias("percent"))
