"""Files in and out: source trees, JSON arrays, CSV, clone lists, reports."""

from __future__ import annotations

import re
import shutil
import subprocess
import time
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_array(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A file that holds one JSON array of records."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def csv(spark: SparkSession, path: str) -> DataFrame:
    """With a header, and values over several lines."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', quote='"')


def extension_map(languages: DataFrame, targets: Sequence[str]) -> DataFrame:
    """extension, language from rows (name, extensions, position); the last of several languages has an extension."""
    rows = languages.where(F.col("name").isin(list(targets))).select("position", "name", F.explode("extensions").alias("extension"))
    return rows.groupBy("extension").agg(F.max_by("name", "position").alias("language"))


@F.pandas_udf(T.StringType())
def _escaped(content: pd.Series) -> pd.Series:
    def read(b: bytes | None) -> str | None:
        try:
            return None if b is None else b.decode("unicode_escape").replace("\r\n", "\n").replace("\r", "\n")
        except UnicodeDecodeError:
            return None

    return content.map(read)


def decoded(content: Column) -> Column:
    """Bytes as text, stripped: UTF-8 where valid, else with escapes decoded, else null."""
    from quarrymill.functions.text import strip

    text = F.regexp_replace(content.cast("string"), "\r\n?", "\n")
    return strip(F.when(F.is_valid_utf8(content.cast("string")), text).otherwise(_escaped(content)))


def source_files(spark: SparkSession, root: str, extensions: DataFrame) -> DataFrame:
    """code, path, project_root, language of all files below root/<owner>/<name> whose last extension is known. A file whose name only starts with a dot has none."""
    # Only files of known extensions are listed and read; the map is small, a row for each extension.
    ends = sorted({r[0].removeprefix(".") for r in extensions.select("extension").distinct().collect()})
    glob = "*.{" + ",".join(re.sub(r"([\\*?\[\]{},^])", r"\\\1", e) for e in ends) + "}" if ends else "*.{}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    known = files.withColumn("extension", F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)).join(extensions, "extension")
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    return known.select(decoded(F.col("content")).alias("code"), "path", F.concat_ws("/", F.lit(root.rstrip("/")), F.substring_index(below, "/", 2)).alias("project_root"), "language")


def cloned(repos: DataFrame, folder: str, retries: int = 2, force: bool = False, pause: float = 5.0) -> DataFrame:
    """status (Done or Error) and message for each git_url, rev, maintainer, name; clones go to folder, which executors share."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for frame in frames:
            out = []
            for r in frame.itertuples():
                target = f"{folder}/{r.maintainer}/{r.name}"
                if {"..", "."} & set(f"{r.maintainer}/{r.name}".split("/")):
                    out.append(("Error", "the folder would lie elsewhere"))
                    continue
                if os.path.isdir(f"{target}/.git") and not force:
                    out.append(("Done", "ok"))
                    continue
                rev = r.rev if isinstance(r.rev, str) else None
                for attempt in range(retries + 1):
                    try:
                        shutil.rmtree(target, ignore_errors=True)  # what an earlier try, or an older clone, left
                        subprocess.run(["git", "clone", *([] if rev else ["--depth", "1"]), "--", r.git_url, target], check=True, capture_output=True, timeout=3600)
                        if rev:
                            subprocess.run(["git", "-C", target, "checkout", "--end-of-options", rev], check=True, capture_output=True)
                        out.append(("Done", "ok"))
                        break
                    except Exception as e:  # noqa: BLE001  a repository that fails has a status of its own
                        if attempt == retries:
                            out.append(("Error", f"{type(e).__name__}: {e}"))
                        else:
                            time.sleep(pause)
            yield frame.assign(status=[s for s, _ in out], message=[m for _, m in out])

    fields = ", ".join(f"{c} string" for c in ("git_url", "rev", "maintainer", "name", "status", "message"))
    return repos.select("git_url", "rev", "maintainer", "name").mapInPandas(run, fields)


def write_csv_with_index(df: DataFrame, path: str, order: Sequence) -> None:
    """CSV whose first column numbers the rows from 0 in this order; for reports, as one task numbers them."""
    df.select((F.row_number().over(Window.orderBy(*order)) - 1).alias("index"), "*").write.csv(path, header=True)


def write_json_array(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON array over all part files, joined in order of their names: a row a line, nulls written out."""
    from quarrymill.plans.storage import cut

    rows = cut(df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"), F.monotonically_increasing_id().alias("at")))
    first, last = rows.agg(F.min("at"), F.max("at")).first()
    if first is None:
        lines = df.sparkSession.createDataFrame([("[]",)], "json string").coalesce(1)
    else:
        lines = rows.select(F.concat(F.when(F.col("at") == first, "[").otherwise(""), "json", F.when(F.col("at") == last, "]").otherwise(",")))
    lines.write.mode("overwrite" if overwrite else "errorifexists").text(path)


def report(df: DataFrame, digits: int = 3) -> str:
    """A small table as Markdown, numbers rounded."""
    rows = df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
