"""Text expressions: lines, languages, commit messages, polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lines(text) -> Column:
    """The lines of a text, without line ends; a last empty line is dropped. Null gives null, '' an empty array."""
    parts = F.split(F.replace(_c(text), F.lit("\r\n"), F.lit("\n")), "\n")
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    return F.when(_c(text).isNotNull(), cut)


def slice_lines(text, start, end) -> Column:
    """Lines start to end, from 1, both included and cut to what there is; '' where nothing is left."""
    s = F.greatest(_c(start).cast("int"), F.lit(1))
    n = F.greatest(_c(end).cast("int") - s + 1, F.lit(0))
    return F.array_join(F.slice(lines(text), s, n), "\n")


# Languages and the endings of their files.
LANGUAGE_ENDINGS = {
    "rust": "rs", "c": "c h", "cpp": "cpp hpp cc cxx hh", "python": "py pyi", "javascript": "js mjs cjs jsx", "typescript": "ts mts cts tsx", "go": "go", "java": "java", "kotlin": "kt kts",
    "mojo": "mojo 🔥", "slint": "slint", "bash": "sh bash zsh", "css": "css scss sass less", "html": "html htm", "xml": "xml", "gradle": "gradle", "docker": "dockerfile", "qemu": "qemu",
    "svd": "svd", "linkerscript": "ld", "assembly": "s asm", "systemverilog": "sv svh v vh", "openscad": "scad", "json": "json jsonc json5", "yaml": "yaml yml", "toml": "toml",
    "cfg": "cfg ini conf", "csv": "csv tsv", "markdown": "md markdown", "svg": "svg", "image": "png jpg jpeg webp gif ico bmp", "audio": "mp3 wav flac ogg oga aac m4a mid midi",
    "video": "mp4 m4v mkv webm avi mov", "document": "pdf docx epub",
}
BINARY = ["image", "audio", "video", "document"]


def language(path) -> Column:
    """Language by file name and ending, whatever the case, 'unknown' otherwise; Docker and Gradle files go by name."""
    name = F.lower(F.element_at(F.split(_c(path), "[/\\\\]"), -1))
    ending = F.regexp_extract(name, r"\.([^.]+)$", 1)
    known = F.create_map(*[F.lit(x) for lang, ends in LANGUAGE_ENDINGS.items() for end in ends.split() for x in (end, lang)])
    by_name = F.when((name == "dockerfile") | name.startswith("dockerfile."), "docker").when(name.endswith(".gradle") | name.endswith(".gradle.kts"), "gradle")
    return F.coalesce(by_name, F.try_element_at(known, ending), F.lit("unknown"))


# Kinds of memory records.
MEMORY_KINDS = ["instruction", "fact", "decision", "goal", "commitment", "preference", "relationship", "context", "event", "learning", "observation", "artifact", "error", "skill"]


def memory_kind(x) -> Column:
    """The kind a text names: trimmed, lower case, 'procedural' for skill; null if it names none."""
    k = F.lower(F.trim(_c(x)))
    k = F.when(k == "procedural", "skill").otherwise(k)
    return F.when(k.isin(*MEMORY_KINDS), k)


# What commits of a type become.
COMMIT_KINDS = {"feat": "decision", "fix": "error", "refactor": "decision", "perf": "learning", "docs": "fact"}
COMMIT_SAYS = {"feat": "Commit", "fix": "Resolved issue in commit", "refactor": "Refactoring in commit", "perf": "Performance optimization in", "docs": "Documentation update in"}


def trimmed(x) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def commit_parts(message) -> tuple[Column, Column, Column]:
    """Kind, title and what a memory of it begins with, from a commit message's first line ``type: title`` or
    ``type(scope): title``; null for other forms."""
    first = F.regexp_extract(trimmed(message), r"^([^\r\n]*)", 1)
    form = r"^(feat|fix|refactor|perf|docs)(\([^)]*\))?:\s*(.*)$"
    lookup = lambda d: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), F.regexp_extract(first, form, 1))
    kind = lookup(COMMIT_KINDS)
    return kind, F.when(kind.isNotNull(), trimmed(F.regexp_extract(first, form, 3))), lookup(COMMIT_SAYS)


# Opposed words of rules.
OPPOSED = [("never ", "always "), ("prefer ", "avoid "), ("use ", "do not use "), ("no_std", "with std")]


def opposed(a, b) -> Column:
    """Whether one text says one of a pair of opposed words and the other its opposite, in either direction."""
    a, b = F.lower(_c(a)), F.lower(_c(b))
    tests = [x for p, q in OPPOSED for x in (a.contains(p) & b.contains(q), a.contains(q) & b.contains(p))]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def rule_words(text) -> Column:
    """Distinct words of more than three bytes that carry a rule's subject."""
    parts = F.split(F.lower(_c(text)), r"\s+")
    return F.array_distinct(F.filter(parts, lambda w: (F.octet_length(w) > 3) & ~w.isin("never", "always", "prefer", "avoid")))


def is_conflict(a, b) -> Column:
    """Opposed texts that share at least two subject words."""
    return opposed(a, b) & (F.size(F.array_intersect(rule_words(a), rule_words(b))) >= 2)


def is_watched(path) -> Column:
    """Whether a change of a path counts: not below build, version-control or index folders, and of a known language; Markdown
    counts below ``memories/`` even inside the index folder."""
    p = F.replace(_c(path), F.lit("\\"), F.lit("/"))
    note = p.rlike(r"(^|/)memories/[^/]*\.md$")
    hidden = p.rlike(r"(^|/)(?:target|\.git|\.index)/")
    return F.coalesce(note | (~hidden & (language(path) != "unknown")), F.lit(False))
