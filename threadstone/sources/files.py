"""Files as tables: project trees, package manifests, commit logs, transcripts, Markdown notes."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadstone.functions.ids import content_hash, file_id
from threadstone.functions.text import BINARY, language, lines

# What a walk leaves out, and its size limit.
IGNORED = [".git/", ".index/", "target/", "node_modules/"]
MAX_KB = 512


def walk(spark: SparkSession, root: str, ignored: list[str] | None = None, max_kb: int = MAX_KB) -> DataFrame:
    """Files below a folder: ``id, relative_path, language, size_bytes, content_hash, content``. Left out: ignored path prefixes
    (relative to the root), what the root's ignore files name, files above the limit that aren't Markdown, and texts that aren't UTF-8; hidden files, which Spark doesn't list. Binary assets have a short
    description for content, and their bytes aren't kept."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    df = raw.select(rel.alias("relative_path"), F.col("length").alias("size_bytes"), "content").withColumn("language", language("relative_path"))
    for prefix in ignored if ignored is not None else IGNORED:
        df = df.filter(~F.col("relative_path").startswith(prefix))
    # Spark lists no hidden files, so the root's ignore files (two small ones at most) are read by their names
    rules = [r for name in IGNORE_FILES for r in ignore_rules(_small_text(spark, f"{root.rstrip('/')}/{name}"))]
    df = df.filter(not_ignored(F.col("relative_path"), rules))
    df = df.filter((F.col("size_bytes") <= max_kb * 1024) | F.col("relative_path").endswith(".md"))
    asset = F.format_string("Asset Type: %s\nFile: %s\nSize: %d bytes\nExtension: %s", "language", "relative_path", "size_bytes", F.regexp_extract("relative_path", r"\.([^./]*)$", 1))
    text, binary = F.col("content").cast("string"), F.col("language").isin(*BINARY)
    df = df.filter(binary | F.is_valid_utf8(text)).withColumn("content", F.when(binary, asset).otherwise(text))
    return df.select(file_id("relative_path").alias("id"), "relative_path", "language", "size_bytes", content_hash("content").alias("content_hash"), "content")


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in s)


def write_tree(df: DataFrame, root: str, path: str, content: str) -> None:
    """A file per row below a folder of the local or mounted file system, written by the tasks that hold the rows. Rows without
    path or content write nothing."""

    def run(batches):
        for b in batches:
            for rel, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at = os.path.join(root, rel)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.part{uuid.uuid4().hex}", "w", encoding="utf-8", newline="") as f:
                    f.write(text)
                os.replace(f.name, at)  # a task that is run again replaces whole files
            yield b.slice(0, 0)

    rows = df.select(F.col(path).alias("p"), F.col(content).alias("c")).filter("p IS NOT NULL AND c IS NOT NULL")
    rows.mapInArrow(run, "p string, c string").write.format("noop").mode("overwrite").save()


# Files whose lines say what a walk leaves out.
IGNORE_FILES = [".gitignore", ".indexignore"]


_WILD = re.compile(r"/\*\*/|^\*\*/|/\*\*$|\*\*|\*|\?|\[[^\]]+\]|[^\w/]")
_FORMS = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}


def ignore_rules(text: str) -> list[tuple[str, bool]]:
    """Patterns of an ignore file as (regular expression on relative paths, whether it takes back), in order: comments, ``!``,
    anchors, folders, ``*``, ``?``, ``**`` and classes of characters."""
    out = []
    for line in text.splitlines():
        p = line.rstrip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.removeprefix("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.removeprefix("/")
        body = _WILD.sub(lambda m: _FORMS.get(m[0]) or (f"[^{m[0][2:]}" if m[0].startswith("[!") else m[0] if m[0].startswith("[") else "\\" + m[0]), p)
        out.append((("^" if anchored else "^(?:.*/)?") + body + ("/.*$" if folder else "(?:/.*)?$"), back))
    return out


def not_ignored(path, rules: list[tuple[str, bool]]):
    """Whether a path is kept: of the rules that match it the last one decides."""
    keep = F.lit(True)
    for form, back in rules:
        keep = F.when(path.rlike(form), F.lit(back)).otherwise(keep)
    return keep


def _small_text(spark: SparkSession, path: str) -> str:
    """A small file's text, '' if there is none."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return ""
    stream = fs.open(at)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def commits(spark: SparkSession, path: str) -> DataFrame:
    """Commits of a log written as ``hash|author|subject`` lines with bodies, closed by ``---COMMIT_END---``:
    ``hash, author, message``. Pieces without the form are left out."""
    raw = spark.read.option("lineSep", "---COMMIT_END---").text(path)
    body = F.regexp_replace("value", r"^\s+|\s+$", "")
    form = r"^([0-9a-f]+)\|([^|\n]*)\|((?s).*)$"
    return raw.filter(body.rlike(form)).select(*[F.regexp_extract(body, form, i + 1).alias(c) for i, c in enumerate(["hash", "author", "message"])])


def transcript_usage(spark: SparkSession, path: str) -> DataFrame:
    """Token usage per line of JSON transcripts: ``file, input_tokens, output_tokens, cached_tokens``, of ``usage`` or
    ``token_usage``. Lines that are no such objects count as nothing; a line without input and output counts a quarter of its
    bytes as input."""
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    one = lambda k: F.coalesce(*[F.get_json_object("value", f"$.{u}.{k}").try_cast("long") for u in ("usage", "token_usage")], F.lit(0))
    usage = F.coalesce(F.get_json_object("value", "$.usage"), F.get_json_object("value", "$.token_usage"))
    df = raw.filter(usage.isNotNull()).select("file", one("input_tokens").alias("i"), one("output_tokens").alias("output_tokens"), one("cached_tokens").alias("cached_tokens"), F.octet_length("value").alias("b"))
    guess = F.when(F.col("i") + F.col("output_tokens") == 0, F.floor(F.col("b") / 4)).otherwise(F.col("i")).cast("long")
    return df.select("file", guess.alias("input_tokens"), "output_tokens", "cached_tokens")


def packages(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Packages by their manifests one level below the roots: ``crate_name, root_path, version, description, no_std``; a name
    that stands under several roots is taken once, by the smallest path."""
    raw = spark.read.format("binaryFile").load([f"{r.rstrip('/')}/*/Cargo.toml" for r in roots])
    text = F.concat(F.lit("\n"), F.col("content").cast("string"))
    section = F.regexp_extract(text, r"(?s)\n\[package\]\s*\n(.*?)(?:\n\[|\z)", 1)
    field = lambda k: F.nullif(F.regexp_extract(F.concat(F.lit("\n"), section), rf"\n\s*{k}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    df = raw.select(
        field("name").alias("crate_name"), F.regexp_replace("path", "/Cargo.toml$", "").alias("root_path"), F.coalesce(field("version"), F.lit("0.1.0")).alias("version"),
        field("description").alias("description"), text.contains("no_std").alias("no_std"),
    ).filter(F.col("crate_name").isNotNull())
    return df.groupBy("crate_name").agg(F.min(F.struct("root_path", "version", "description", "no_std")).alias("x")).select("crate_name", "x.*")


def read_vault(spark: SparkSession, folder: str, kind_from_folder: bool = False) -> DataFrame:
    """Memories of Markdown notes, one file per kind: ``kind, id, title, status, created, tags, symbol_ref, author, content``. A
    section begins with ``## ``; metadata are bullets before the text; ``---`` lines are dropped. A section without id has a
    null one; kinds that aren't known become facts."""
    from threadstone.functions.text import memory_kind

    # notes of a kind lie in a file called so, or, as `write_vault` writes them, in files of a folder called so
    name = F.regexp_extract(F.input_file_name(), r"kind=([^/]+)/[^/]*$" if kind_from_folder else r"([^/]+)\.md$", 1)
    raw = spark.read.text(folder if kind_from_folder else f"{folder}/*.md", wholetext=True).select(name.alias("stem"), F.replace("value", F.lit("\r\n"), F.lit("\n")).alias("v"))
    part = raw.select("stem", F.explode(F.slice(F.split(F.concat(F.lit("\n"), "v"), "\n## "), 2, 1_000_000_000)).alias("p"))
    meta = lambda k: F.nullif(F.trim(F.replace(F.regexp_extract("p", rf"\n- \*\*{k}\*\*:[ \t]*([^\n]*)", 1), F.lit("`"), F.lit(""))), F.lit(""))
    body = F.filter(F.split("p", "\n"), lambda x, i: (i > 0) & (F.trim(x) != "---") & ~x.rlike(r"^- \*\*(ID|Status|Created|Tags|Governs Symbol|Author)\*\*:"))
    return part.select(
        F.coalesce(memory_kind("stem"), F.lit("fact")).alias("kind"), meta("ID").alias("id"), F.trim(F.regexp_extract("p", r"^([^\n]*)", 1)).alias("title"),
        F.coalesce(F.lower(meta("Status")), F.lit("active")).alias("status"), F.regexp_replace(meta("Created"), r"(\+00:00|Z)$", "").try_cast("timestamp_ntz").alias("created"),
        F.filter(F.transform(F.split(F.coalesce(meta("Tags"), F.lit("")), r"[\s,]+"), lambda t: F.regexp_replace(t, "^#", "")), lambda t: t != "").alias("tags"),
        meta("Governs Symbol").alias("symbol_ref"), meta("Author").alias("author"), F.regexp_replace(F.array_join(body, "\n"), r"^\s+|\s+$", "").alias("content"),
    )


def write_vault(memories: DataFrame, folder: str) -> None:
    """One folder of Markdown notes per kind; the notes of a kind are spread over as many files as they need."""
    from threadstone.operators.synthesis import memory_block

    memories.select("kind", memory_block().alias("value")).write.mode("overwrite").partitionBy("kind").text(folder)


def rule_bullets(spark: SparkSession, path: str) -> DataFrame:
    """Bullets of a Markdown file as rules: ``title, confidence``."""
    raw = spark.read.text(path).filter(F.col("value").rlike(r"^\s*[-*] \S"))
    return raw.select(F.trim(F.regexp_replace("value", r"^\s*[-*] ", "")).alias("title"), F.lit(0.9).alias("confidence"))


def find_notes(spark: SparkSession, folder: str, text: str) -> DataFrame:
    """Whole Markdown files that hold a text, whatever the case; all for an empty one: ``file, content``."""
    raw = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    return raw.filter(F.lower("content").contains(text.lower()))


# Headings of a handoff note and the lists below them.
HANDOFF = {"Completed Tasks": "completed_tasks", "Pending Tasks": "pending_tasks", "Key Decisions & Context": "key_decisions", "Modified Files": "modified_files"}


def read_handoff(spark: SparkSession, path: str) -> DataFrame:
    """Handoff notes, a row per file: session, goal, next action and the lists below the known headings; ``*(None)*`` is empty."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.concat(F.lit("\n"), F.replace("value", F.lit("\r\n"), F.lit("\n")), F.lit("\n## ")).alias("v"))
    line = lambda k: F.trim(F.regexp_extract("v", rf"\n- \*\*{k}\*\*:[ \t]*([^\n]*)", 1))
    under = lambda h: F.regexp_extract("v", rf"(?s)\n## {h}[ \t]*\n(.*?)\n## ", 1)
    items = lambda c: F.filter(F.transform(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"^\s*[-*] ")), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*] (?:\[[ x]\] )?`?|`\s*$", ""))), lambda x: (x != "") & (x != "*(None)*"))
    action = F.trim(F.regexp_replace(under("Next Immediate Action"), r"(?m)^>[ \t]?", ""))
    return raw.select("file", line("Session ID").alias("session_id"), line("Active Goal").alias("active_goal"), F.regexp_replace(action, r"^\s+|\s+$", "").alias("next_action"), *[items(under(h)).alias(c) for h, c in HANDOFF.items()])


def chunked(files: DataFrame, symbols: DataFrame, outlined: bool = False) -> DataFrame:
    """Chunks of files: one per symbol's lines, and the whole text of files without symbols that aren't blank:
    ``file_id, symbol_id, kind, text, start_line, end_line``. With ``outlined`` also the outline of each file with symbols, whose
    ``kind, name, qualified_name, signature`` it lists."""
    from threadstone.functions.text import slice_lines

    own = symbols.select(F.col("file_id").alias("id"), "symbol_id", "start_line", "end_line")
    text = files.filter(F.col("content").isNotNull()).select("id", "content")
    by_symbol = text.join(own, "id").select(F.col("id").alias("file_id"), "symbol_id", F.lit("symbol_chunk").alias("kind"), slice_lines("content", "start_line", "end_line").alias("text"), "start_line", "end_line")
    rest = text.join(own.select("id").distinct(), "id", "left_anti").filter(F.col("content").rlike(r"\S"))
    whole = rest.select(F.col("id").alias("file_id"), F.lit(None).cast("string").alias("symbol_id"), F.lit("file_summary").alias("kind"), F.col("content").alias("text"), F.lit(1).cast("long").alias("start_line"), F.size(lines("content")).cast("long").alias("end_line"))
    both = by_symbol.filter(F.col("text") != "").unionByName(whole)
    if not outlined:
        return both
    from threadstone.operators.textual import outlines

    listed = outlines(symbols.withColumn("id", F.col("symbol_id")), "file_id", ["start_line", "end_line", "name", "id"])
    size = text.select(F.col("id").alias("file_id"), F.greatest(F.size(lines("content")), F.lit(1)).cast("long").alias("end_line"))
    top = listed.join(size, "file_id").select(
        "file_id", F.lit(None).cast("string").alias("symbol_id"), F.lit("file_outline").alias("kind"), F.col("outline").alias("text"), F.lit(1).cast("long").alias("start_line"), "end_line"
    )
    return both.unionByName(top)
