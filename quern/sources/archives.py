"""Images and ZIP archives as tables: members, checks and a decode test."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.checks import CheckFailed

# Leading bytes of image files.
SIGNATURES = {b"\xff\xd8\xff": "JPEG", b"\x89PNG\r\n\x1a\n": "PNG", b"RIFF": "WEBP"}
MEMBERS = "archive string, member string, label string, size long, sha256 string, safe boolean, intact boolean"


def is_safe_member(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return not name.startswith(("/", "\\")) and ".." not in parts and not (len(name) > 1 and name[1] == ":")


def zip_members(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """Members of all archives at ``path`` whose file names begin with ``prefix``: size, hash, and whether path and CRC are sound.

    One row of the file table is one archive; a member's label is its folder.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for archive, content in zip(pdf["path"], pdf["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        parts = info.filename.replace("\\", "/").split("/")
                        if info.is_dir() or not parts[-1].startswith(prefix):
                            continue
                        try:
                            body, intact = z.read(info), True
                        except zipfile.BadZipFile:
                            body, intact = b"", False
                        rows.append((archive, info.filename, parts[-2] if len(parts) > 1 else "", info.file_size, hashlib.sha256(body).hexdigest(), is_safe_member(info.filename), intact))
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    return files.mapInPandas(cut, MEMBERS)


def verified_members(members: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """``members``, if all are safe and intact and, by label, as many as ``expected`` (label, n)."""
    if not members.where("not safe or not intact").isEmpty():
        raise CheckFailed("unsafe or broken archive member")
    if expected is not None:
        counts = members.groupBy("label").agg(F.count("*").alias("n"))
        if not counts.exceptAll(expected).isEmpty() or not expected.exceptAll(counts).isEmpty():
            raise CheckFailed("member counts differ from those expected")
    return members


def decode_test(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ok, format and error of a test of the leading bytes (and of the pixels where an image library is there)."""

    @F.pandas_udf("struct<ok:boolean,format:string,error:string>")
    def test(bodies: pd.Series) -> pd.DataFrame:
        out = []
        for body in bodies:
            body = bytes(body or b"")
            kind = next((k for s, k in SIGNATURES.items() if body.startswith(s)), None)
            error = None if kind else "not an image"
            if kind:
                try:
                    from PIL import Image
                except ImportError:
                    pass
                else:
                    try:
                        Image.open(io.BytesIO(body)).verify()
                    except Exception as e:
                        error = str(e)
            out.append((error is None, kind, error))
        return pd.DataFrame(out, columns=["ok", "format", "error"])

    return files.withColumn("_t", test(content)).select("*", "_t.ok", "_t.format", "_t.error").drop("_t")
