"""Markdown notes as a DataFrame: body, frontmatter as JSON, tags."""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.properties import canonical_json
from ..functions.text import canonical_text, frontmatter, newlines, normalize_tags, strip_frontmatter
from ..lineage import cut
from ..operators.admission import IGNORE_FILE_BYTES, IGNORE_TOTAL_BYTES, PathPolicy, load_policy
from .files import read_start

#: Inline tags: ``#`` at a word's start, then letters, digits, ``_``, ``-`` and ``/``, not all digits.
INLINE_TAG = r"(?:^|(?<=\s))#([\p{L}\p{N}_/-]*[\p{L}_/-][\p{L}\p{N}_/-]*)"


def yaml_value(text: str | None) -> str | None:
    """Canonical JSON of a frontmatter block; null if it is no mapping. Dates stay text, as they were written."""
    if text is None:
        return None
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    try:
        value = yaml.load(text, Loader)
    except yaml.YAMLError:
        return None
    if value is None:
        return "{}"
    return canonical_json(json.loads(json.dumps(value, default=_plain))) if isinstance(value, dict) else None


def _plain(x):
    if isinstance(x, (datetime.date, datetime.datetime)):
        return x.isoformat()
    raise TypeError(f"no JSON form for {type(x).__name__}")


@F.pandas_udf(T.StringType())
def frontmatter_json(block: pd.Series) -> pd.Series:
    return block.map(yaml_value)


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """(path, markdown) of every ``.md`` file below a folder; the path is relative to it."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return files.select(_relative(root, F.url_decode(F.col("_metadata.file_path"))).alias("path"), F.col("value").alias("markdown"))


def _relative(root: str, uri: Column) -> Column:
    """A file's path below the folder."""
    base = root.rstrip("/").split("://")[-1].lstrip("/") + "/"
    return F.substring_index(F.regexp_replace(uri, r"^[a-z]+:/*", ""), base, -1)


def read_controls(spark: SparkSession, root: str, name: str = ".gitignore") -> dict[str, bytes | None]:
    """Ignore files by path, of each directory that has notes below it; null where one can't be read, or is over the caps.

    The directories are told from the notes' paths and looked at in tasks, as Spark's own listing leaves out names with a
    leading dot. What comes to the driver is bounded by the caps: contents of at most ``IGNORE_TOTAL_BYTES``, shallow
    files first, and the names of the rest, which close their directories. Empty files say nothing and are left out.
    """
    files = spark.read.format("binaryFile").options(recursiveFileLookup="true", pathGlobFilter="*.md").load(root).select(_relative(root, F.col("path")).alias("path"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    directories = files.select(F.explode(above).alias("directory")).unionByName(spark.createDataFrame([("",)], "directory string")).distinct()

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [(f"{d}/{name}" if d else name, *read_start(f"{root.rstrip('/')}/{d}/{name}" if d else f"{root.rstrip('/')}/{name}", IGNORE_FILE_BYTES + 1)) for d in frame["directory"]]
            yield pd.DataFrame(found, columns=["path", "there", "content"])

    there = directories.mapInPandas(look, "path string, there boolean, content binary").where("there and not (length(content) <=> 0)")
    held = cut(there)
    order = Window.orderBy(F.size(F.split("path", "/")), "path")
    total = F.sum(F.coalesce(F.length("content"), F.lit(0))).over(order)
    return {r["path"]: None if r["content"] is None else bytes(r["content"]) for r in held.select("path", F.when(total <= IGNORE_TOTAL_BYTES, F.col("content")).alias("content")).collect()}


def vault_policy(spark: SparkSession, root: str, folders: list[str] = [], files: list[str] = []) -> PathPolicy:  # noqa: B006
    """The policy of a folder: exclusions by hand and the ignore files that are there now."""
    return load_policy(read_controls(spark, root), list(folders), list(files))


def list_column(properties: Column, key: str) -> Column:
    """Array of strings under a key of the frontmatter: a list as it is, a text split at commas and spaces."""
    raw = F.get_json_object(properties, f"$.{key}")
    listed = F.from_json(raw, "array<string>")
    return F.coalesce(listed, F.filter(F.split(F.coalesce(raw, F.lit("")), r"[,\s]+"), lambda t: t != ""), F.array().cast("array<string>"))


def parse_notes(files: DataFrame) -> DataFrame:
    """Adds title, body, canonical, properties_json, metadata_ready, ai_index, tags and frontmatter_lines to (path, markdown).

    A frontmatter that can't be read leaves metadata_ready false: the note is deferred, not admitted.
    """
    block = frontmatter(F.col("markdown"))
    staged = files.withColumns({"body": strip_frontmatter(F.col("markdown")), "_block": block}).withColumn("_json", F.when(F.col("_block").isNull(), F.lit("{}")).otherwise(frontmatter_json("_block")))
    title = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", "")
    own, inline = list_column(F.col("_json"), "tags"), F.regexp_extract_all("body", F.lit(INLINE_TAG), F.lit(1))
    return staged.select(
        *files.columns,
        title.alias("title"),
        "body",
        canonical_text(title, F.col("body")).alias("canonical"),
        F.coalesce("_json", F.lit("{}")).alias("properties_json"),
        F.col("_json").isNotNull().alias("metadata_ready"),
        F.get_json_object("_json", "$.ai_index").cast("boolean").alias("ai_index"),
        normalize_tags(F.concat(own, inline)).alias("tags"),
        (newlines(F.col("markdown")) - newlines(F.col("body"))).alias("frontmatter_lines"),
    )
