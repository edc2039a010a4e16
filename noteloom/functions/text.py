"""Canonical text, identities, tags and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that keep a note, and notes under them, out.
BLOCKED_TAGS = ("status/inbox", "type/private")


def strip_frontmatter(markdown: Column) -> Column:
    """The body without byte-order mark and frontmatter; frontmatter that is opened and never closed is an error."""
    text = F.regexp_replace(markdown, r"\A\x{FEFF}", "")
    body = F.regexp_replace(text, r"(?s)\A---\r?\n(?:---[ \t]*(?:\r?\n|\z)|.*?(?<=\n)---[ \t]*(?:\r?\n|\z))", "")
    opened = text.rlike(r"\A---\r?\n")
    return F.when(opened & (F.length(body) == F.length(text)), F.raise_error(F.lit("frontmatter is not closed"))).otherwise(body)


def frontmatter(markdown: Column) -> Column:
    """The text between the frontmatter's fences, or null."""
    text = F.regexp_replace(markdown, r"\A\x{FEFF}", "")
    inner = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)(?<=\n)---[ \t]*(?:\r?\n|\z)", 1)
    return F.when(text.rlike(r"\A---\r?\n") & (inner != ""), inner)


def canonical_text(basename: Column, body: Column) -> Column:
    return F.concat(F.lit("# "), basename, F.lit("\n\n"), body)


def normalize_tag(tag: Column) -> Column:
    return F.lower(F.regexp_replace(tag, "^#", ""))


def normalize_tags(tags: Column) -> Column:
    """Distinct normalized tags in the order of their first appearance."""
    return F.array_distinct(F.transform(tags, normalize_tag))


def prefixes(parts: Column, last: Column) -> Column:
    """``a``, ``a/b`` ... for the first ``last`` lengths of an array of path parts."""
    counts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(counts, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def tag_ancestors(tags: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(tags, lambda t: prefixes(F.split(t, "/"), F.size(F.split(t, "/"))))))


def blocking_tag(tags: Column) -> Column:
    """The first tag that is a blocked one or lies under it, else null."""
    under = lambda t: F.array_contains(F.array(*map(F.lit, BLOCKED_TAGS)), t) | F.exists(F.array(*[F.lit(f"{b}/") for b in BLOCKED_TAGS]), lambda b: F.startswith(t, b))
    return F.get(F.filter(tags, under), 0)


def normalize_path(path: Column) -> Column:
    """Slashes forward, no empty or ``.`` parts; null for absolute paths, NUL characters and ``..``."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    bad = F.startswith(slashed, F.lit("/")) | F.contains(slashed, F.lit("\0")) | F.array_contains(parts, F.lit(".."))
    return F.when(~bad, F.array_join(parts, "/"))


def ancestor_directories(path: Column) -> Column:
    """The root (empty) and every directory above a normalized path."""
    parts = F.split(path, "/")
    return F.concat(F.array(F.lit("")), prefixes(parts, F.size(parts) - 1))


def relative_path(directory: Column, path: Column) -> Column:
    """The path below a directory; null for the directory itself and for paths elsewhere."""
    below = F.substring(path, F.length(directory) + 2, F.length(path))
    return F.when(directory == "", path).when(F.startswith(path, F.concat(directory, F.lit("/"))), below)


def path_list(setting: Column, root_allowed: bool) -> Column:
    """Trimmed distinct lines of a settings text; ``/`` means the root where allowed; absolute and dotted paths become null."""
    lines = F.array_distinct(F.filter(F.transform(F.split(setting, "\n"), lambda p: F.trim(p)), lambda p: p != ""))
    bad = lambda p: F.startswith(p, F.lit("/")) | p.rlike("^[A-Za-z]:") | F.exists(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/"), lambda x: x.isin(".", ".."))
    tidy = lambda p: F.when(F.lit(root_allowed) & (p == "/"), F.lit("")).when(~bad(p), p)
    return F.transform(lines, tidy)


def hex_key(key: Column) -> Column:
    return F.lower(F.hex(F.encode(key, "UTF-8")))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def snapshot_id(body_hash: Column, properties: Column, tags: Column, path: Column, generation: Column) -> Column:
    return digest(body_hash, properties, F.to_json(tags), path, generation.cast("string"))


def object_id(key: Column) -> Column:
    """UUID text from the first 16 bytes of SHA-256, with version 5 and the standard variant."""
    h = F.sha2(key, 256)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 8
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(nibble)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def passage_id(index: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", index, start, end)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def source_line(frontmatter_lines: Column, start_line: Column, title_lines: int = 2) -> Column:
    """Line in the source file of a line of the canonical text, which begins with a title."""
    return frontmatter_lines + F.greatest(F.lit(0), start_line - title_lines)


def passage_label(file: Column, heading: Column, first_line: Column, last_line: Column) -> Column:
    shown = F.when(heading == "", F.lit("Content")).otherwise(F.replace(heading, F.lit(" / "), F.lit(" > ")))
    return F.concat(file, F.lit(" > "), shown, F.lit(" > Lines "), first_line + 1, F.lit("-"), last_line + 1)


def words(text: Column) -> Column:
    """Search terms: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def line_spans(passages: DataFrame, note: str, index: str, text: str) -> DataFrame:
    """note, index, start_offset, start_line and end_line of consecutive passages: running sums of lengths and newlines."""
    before = Window.partitionBy(note).orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    sized = passages.select(note, index, F.length(text).alias("n"), newlines(F.col(text)).alias("nl"))
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return sized.select(note, index, so_far("n").alias("start_offset"), so_far("nl").alias("start_line"), (so_far("nl") + F.col("nl")).alias("end_line"))
