"""Reading documents, models and logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from procflow.functions.text import stem_title

#: Extensions (fixed values).
TEXT_EXT = r"\.(txt|md|text|log)$"
BINARY_EXT = r"\.(bin|exe|dll|so|zip|gz|tar|jpg|jpeg|png|gif|bmp|mp3|mp4|xls|xlsx|ppt|pptx|doc)$"


def detect_format(content: Column, path: Column) -> Column:
    """pdf, zip, docx, txt or unsupported: by magic bytes, then extension, then whether the first 512 bytes are
    text without a NUL. A zip is told from a docx by its members, see docx_members()."""
    head = F.substring(content, 1, 512)
    low = F.lower(path)
    ext = low.rlike
    # a cut inside a character is no reason to reject: up to three bytes at the end are left out
    whole = F.is_valid_utf8(head.cast("string"))
    for k in (1, 2, 3):
        whole = whole | ((F.octet_length(content) > 512) & F.is_valid_utf8(F.substring(content, 1, 512 - k).cast("string")))
    texty = (F.instr(F.decode(head, "iso-8859-1"), "\x00") == 0) & whole
    return (
        F.when(F.substring(content, 1, 4) == F.lit(b"%PDF"), "pdf")
        .when(F.substring(content, 1, 4) == F.lit(b"PK\x03\x04"), "zip")
        .when(ext(r"\.pdf$"), "pdf")
        .when(ext(r"\.docx$"), "docx")
        .when(ext(TEXT_EXT), "txt")
        .when(ext(BINARY_EXT), "unsupported")
        .when(texty, "txt")
        .otherwise("unsupported")
    )


@F.pandas_udf(StringType())
def docx_members(content: pd.Series) -> pd.Series:
    """docx if a zip holds members under word/, unsupported otherwise."""
    import io
    import zipfile

    def one(b: bytes | None) -> str:
        try:
            return "docx" if any(n.startswith("word/") for n in zipfile.ZipFile(io.BytesIO(b or b"")).namelist()) else "unsupported"
        except zipfile.BadZipFile:
            return "unsupported"

    return content.map(one)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, source_format, text`` of all files under a path, each read once; the text of text documents only. Bytes
    that are not UTF-8 are replaced."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    f = detect_format(F.col("content"), F.col("path"))
    raw = raw.withColumn("source_format", F.when(f == "zip", docx_members("content")).otherwise(f))
    return raw.select("path", "source_format", F.when(F.col("source_format") == "txt", F.make_valid_utf8(F.col("content").cast("string"))).alias("text"))


def read_documents(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source_file, source_format, title, text`` of the text documents under a path, and the files that
    are none. Bytes that are not UTF-8 are replaced."""
    files = read_files(spark, path)
    texts = files.where("source_format = 'txt'").select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_file"), "source_format", stem_title(F.col("path")).alias("title"), "text")
    return texts, files.where("source_format <> 'txt'").select("path", "source_format")


DECISION = "timestamp string, execution_id string, step_id string, decision string, reason string, evidence string, confidence double, auto_decided boolean, correlation_id string"
COMMAND = "struct<raw:string,normalized:string,vendor:string,protocol:string,mode:string,confidence:double>"
STEP = f"struct<step_id:string,sequence:int,step_type:string,action_type:string,description:string,raw_text:string,commands:array<{COMMAND}>,expected_output:string,section:string,is_rollback:boolean,tags:array<string>>"
MODEL = f"document_title string, source_file string, source_format string, mop_structure string, failure_strategy string, approval_required boolean, steps array<{STEP}>"


def read_models(spark: SparkSession, path: str, one_a_file: bool = True) -> DataFrame:
    """Canonical models, one JSON document a file, or one a line as write_models() writes them."""
    return spark.read.schema(MODEL).option("multiLine", one_a_file).json(path)


def model_steps(models: DataFrame, key: str = "source_file") -> DataFrame:
    return models.select(key, F.posexplode("steps").alias("position", "s")).select(key, "position", "s.*")


def read_decisions(spark: SparkSession, path: str, execution_id: str | None = None) -> DataFrame:
    """The decision log (JSON lines); blank and malformed lines are skipped."""
    d = spark.read.schema(DECISION).option("mode", "DROPMALFORMED").json(path)
    return d.where(F.col("execution_id") == execution_id) if execution_id is not None else d
