"""Text out of files: plain text, word-processor and spreadsheet archives, OCR records."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import constants as K
from siftline.functions.text import exif_text

MEMBER_BYTES = 5 * 1024 * 1024
ARCHIVE_BYTES = 20 * 1024 * 1024
_MEMBERS = {"docx": "word/document.xml", "xlsx": "xl/sharedStrings.xml"}

OCR_RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()), T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType()),
        T.StructField("exif", T.StructType([T.StructField("date_taken", T.StringType()), T.StructField("gps", T.StringType())])), T.StructField("error", T.StringType()),
    ]
)


def archive_text(data: bytes | None, kind: str) -> tuple[str | None, str | None]:
    """Text of an archive's main part, tags out and white space collapsed; or None and what went wrong."""
    try:
        if data is None or len(data) > ARCHIVE_BYTES:
            return None, "no data" if data is None else "too large"
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(_MEMBERS[kind]) as part:
            xml = part.read(MEMBER_BYTES).decode("utf-8", "replace")
        return " ".join(re.sub(r"<[^>]*(?:>|\Z)", " ", xml).split())[: K.DOC_CHARS], None
    except Exception as e:  # one broken file must not stop the rest
        return None, f"{type(e).__name__}: {e}"[:200]


def extract_archives(files: DataFrame, content: str = "content") -> DataFrame:
    """(path, text, error) of the docx and xlsx files of (path, content binary)."""
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def extract(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([archive_text(d, k) for d, k in zip(data, kind)], columns=["text", "error"])

    kind = F.lower(F.substring_index("path", ".", -1))
    rows = files.filter(kind.isin(list(_MEMBERS))).select("path", extract(F.col(content), kind).alias("r"))
    return rows.select("path", "r.text", "r.error")


def read_archives(spark: SparkSession, roots: list[str]) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{docx,xlsx}").load(roots)
    return extract_archives(found.select("path", "content"))


def ocr_text(record: Column) -> Column:
    """Text of an OCR record: null with an error, empty at low confidence, the image's data before the text."""
    meta = exif_text(record["exif"])
    text = F.coalesce(record["text"], F.lit(""))
    full = F.when(F.coalesce(meta, F.lit("")) != "", F.concat(meta, F.lit(" "), text)).otherwise(text)
    return F.when(record["error"].isNull(), F.when(F.coalesce(record["confidence"], F.lit(0.0)) < K.OCR_CONFIDENCE, "").otherwise(full))


def parse_ocr_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(path, text, confidence) of JSON lines; broken lines and those with an error are left out."""
    r = F.from_json(column, OCR_RECORD)
    return lines.select(r.alias("r")).filter("r is not null and r.path is not null and r.error is null").select("r.path", ocr_text(F.col("r")).alias("text"), F.coalesce("r.confidence", F.lit(0.0)).alias("confidence"))
