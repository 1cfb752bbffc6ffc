"""Lines, sections, outlines, chunks, symbols of texts, and links from documents to symbols."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadstone.functions.text import lines
from threadstone.operators.scanner import Source


def numbered_lines(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """One row per line: the key, ``line_no`` from 1, ``line``. Null and empty texts have none."""
    return df.select(*key, F.posexplode(lines(text)).alias("_i", "line")).select(*key, (F.col("_i") + 1).alias("line_no"), "line")


def headings(df: DataFrame, key: list[str], text: str) -> DataFrame:
    """Markdown headings: ``line_no, level, heading``, of lines that begin with one to six marks."""
    form = r"^\s*(#+)\s*(.*?)\s*$"
    rows = numbered_lines(df, key, text).filter(F.col("line").rlike(r"^\s*#"))
    return rows.select(*key, "line_no", F.length(F.regexp_extract("line", form, 1)).alias("level"), F.regexp_extract("line", form, 2).alias("heading"))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """Sections of a document: ``<key>, section_no, heading, content``. A line whose first mark is ``#`` begins one, inside
    code too; what precedes has the heading Overview; blank sections are dropped and don't count. The lines of a text stay in
    one row from end to end, so a document is cut in one expression."""
    some = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(key, lines(text).alias("_l"))
    heads = F.filter(F.transform("_l", lambda x, i: F.when(F.ltrim(x).startswith("#"), i + 1)), lambda i: i.isNotNull())
    begun = some.select(key, "_l", F.array_distinct(F.concat(F.array(F.lit(0)), heads)).alias("_b"))
    end = lambda i: F.coalesce(F.try_element_at("_b", i + 2), F.size("_l") + 1)
    title = lambda b: F.when(b == 0, "Overview").otherwise(F.trim(F.regexp_replace(F.trim(F.element_at("_l", F.greatest(b, F.lit(1)))), "^#+", "")))
    body = lambda b, i: F.regexp_replace(F.array_join(F.slice("_l", b + 1, F.greatest(end(i) - b - 1, F.lit(0))), "\n"), r"^\s+|\s+$", "")
    made = F.filter(F.transform("_b", lambda b, i: F.struct(title(b).alias("heading"), body(b, i).alias("content"))), lambda x: x["content"] != "")
    return begun.select(key, F.posexplode(made).alias("section_no", "x")).select(key, F.col("section_no").cast("long").alias("section_no"), "x.heading", "x.content")


# How an outline writes the kinds of symbols.
OUTLINE_PREFIX = {
    "function": "fn", "method": "  fn", "struct": "struct", "union": "union", "enum": "enum", "trait": "trait", "class": "class", "interface": "interface", "type_alias": "type",
    "constant": "const", "static": "static", "field": "field", "module": "mod", "import": "use", "macro": "macro",
}


def outlines(symbols: DataFrame, file: str, pos: list[str]) -> DataFrame:
    """An outline per file: one line ``prefix: Lstart-Lend | signature`` per symbol in order of position; without a signature the
    qualified name or the name. Other kinds are written ``symbol``."""
    prefix = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OUTLINE_PREFIX.items() for x in kv]), F.col("kind")), F.lit("symbol"))
    line = F.concat(
        prefix, F.lit(": L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit(" | "), F.coalesce("signature", "qualified_name", "name"),
    )
    rows = symbols.select(F.col(file).alias("_f"), F.struct(*pos, line.alias("line")).alias("_x")).filter(F.col("_f").isNotNull())
    return rows.groupBy("_f").agg(F.array_join(F.transform(F.array_sort(F.collect_list("_x")), lambda x: x["line"]), "\n").alias("outline"), F.count(F.lit(1)).alias("n_symbols")).withColumnRenamed("_f", file)


def enclosing(calls: DataFrame, symbols: DataFrame, by: list[str], key: str, line: str, width: int = 256) -> DataFrame:
    """For each call the outermost function or method whose lines hold it: ``<key>, symbol_id``; calls outside of all are left
    out. ``symbols``: the ``by`` columns, ``symbol_id, start_line, end_line``. A range join over stretches of ``width`` lines."""
    spread = symbols.filter(F.col("end_line") >= F.col("start_line")).withColumn("_b", F.explode(F.sequence(F.floor(F.col("start_line") / width), F.floor(F.col("end_line") / width))))
    at = calls.withColumn("_b", F.floor(F.col(line) / width))
    hit = at.join(spread, [*by, "_b"]).filter((F.col(line) >= F.col("start_line")) & (F.col(line) <= F.col("end_line")))
    return hit.groupBy(key).agg(F.min(F.struct("start_line", (-F.col("end_line")).alias("e"), "symbol_id")).alias("x")).select(key, F.col("x.symbol_id").alias("symbol_id"))


def mentions(docs: DataFrame, key: str, text: list[str], names: DataFrame, name: str, shortest: int = 3) -> DataFrame:
    """Symbols that documents name: ``<key>, <name>``, where a name stands in a text, whatever the case, also inside of words.

    A name's longest run of word characters, for most the name itself, can only stand inside a run of word characters of a text. So
    the distinct runs of all texts are cut into pieces as long as those of the names are, which meet the names in an equi-join; no
    document meets a name it doesn't hold. Names with other characters are then looked for in the texts that have their run.
    Names of fewer than ``shortest`` bytes, and those without any word character, aren't looked for. Null texts count as empty.
    """
    low = F.lower(F.col(name))
    run = F.try_element_at(F.array_sort(F.split(low, r"\W+"), lambda a, b: F.length(b) - F.length(a)), F.lit(1))
    short = names.filter(F.octet_length(low) >= shortest).select(F.col(name).alias("_name"), run.alias("_low"), (run != low).alias("_more")).filter(F.length("_low") > 0).distinct()
    sizes = short.select(F.length("_low").alias("_n")).distinct().agg(F.array_sort(F.collect_set("_n")).alias("_sizes"))  # one row; names' lengths
    whole = F.lower(F.concat_ws(" ", *text))
    runs = docs.select(key, F.explode(F.array_distinct(F.filter(F.split(whole, r"\W+"), lambda w: F.length(w) > 0))).alias("_run"))
    distinct = runs.select("_run").distinct().join(F.broadcast(sizes), F.lit(True))
    at = distinct.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_run"))))
    fits = F.filter("_sizes", lambda n: n <= F.length("_run") - F.col("_i") + 1)
    sub = at.withColumn("_low", F.explode(F.transform(fits, lambda n: F.substring(F.col("_run"), F.col("_i"), n))))
    inside = sub.select("_run", "_low").join(short, "_low").select("_run", "_name", "_more").distinct()
    hits = runs.join(inside, "_run").select(key, "_name", "_more").distinct()
    plain = hits.filter("not _more").select(key, "_name")
    longer = hits.filter("_more").join(docs.select(key, whole.alias("_text")), key).filter(F.contains("_text", F.lower("_name"))).select(key, "_name")
    return plain.unionByName(longer).select(key, F.col("_name").alias(name)).distinct()


def mention_context(name: str, heading: str, content: str) -> Column:
    """What shows a mention: the first line of the content that holds the name, whatever the case, else the heading."""
    rows = F.split(F.replace(content, F.lit("\r\n"), F.lit("\n")), "\n")
    return F.coalesce(F.try_element_at(F.filter(rows, lambda x: F.contains(F.lower(x), F.lower(F.col(name)))), F.lit(1)), F.col(heading))


# Lines that declare symbols, by language: kind, form (the name is the first group), deeper kind inside of a type.
DECLARATIONS = {
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:const|async|unsafe|extern(?:\s+\"[^\"]*\")?)\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)"), ("module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"), ("constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const|static(?:\s+mut)?)\s+(\w+)\s*:"), ("type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"), ("scope", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?(\w+)")],
    "python": [("function", r"^\s*(?:async\s+)?def\s+(\w+)"), ("class", r"^\s*class\s+(\w+)")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("method", r"^\s+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!(?:if|for|while|switch|catch|function|return|new|super)\b)(\w+)\s*\([^;]*\)\s*(?::\s*[^;{]+)?\{\s*$")],
    "c": [("function", r"^(?!\s*(?:if|for|while|switch|return|else|do|typedef)\b)[A-Za-z_][\w\s\*]*?\b(\w+)\s*\([^;]*\)\s*\{?\s*$"), ("struct", r"^\s*(?:typedef\s+)?struct\s+(\w+)\s*\{?\s*$"), ("union", r"^\s*(?:typedef\s+)?union\s+(\w+)\s*\{?\s*$"), ("enum", r"^\s*(?:typedef\s+)?enum\s+(?:(?:class|struct)\s+)?(\w+)\s*(?::\s*[\w:][\w:\s]*)?(?:\{.*)?$"), ("type", r"^\s*\}\s*(\w+)\s*;"), ("constant", r"^\s*#\s*define\s+(\w+)")],
    "go": [("method", r"^func\s*\([^)]*\)\s*(\w+)"), ("function", r"^func\s+(\w+)"), ("struct", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("constant", r"^(?:const|var)\s+(\w+)")],
}
DECLARATIONS["cpp"] = [*DECLARATIONS["c"][:4], ("class", r"^\s*(?:template\s*<[^>]*>\s*)?class\s+(\w+)"), ("namespace", r"^\s*namespace\s+(\w+)"), ("method", r"^\s+(?!(?:if|for|while|switch|return|else|do|typedef)\b)(?:[\w:<>&\*~]+\s+)+\*?(\w+)\s*\([^;]*\)\s*(?:const|noexcept|override|\s)*\{?\s*$"), ("constant", r"^\s*#\s*define\s+(\w+)")]
DECLARATIONS |= {
    "java": [("class", r"^\s*(?:(?:public|private|protected|static|final|abstract|open|data|sealed)\s+)*(?:class|record|object)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|protected|static)\s+)*interface\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|protected|static)\s+)*enum\s+(?:class\s+)?(\w+)"), ("function", r"^\s*(?:(?:public|private|protected|internal|override|suspend|inline)\s+)*fun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\("), ("method", r"^\s+(?!(?:return|new|else|throw)\b)(?:(?:public|private|protected|static|final|synchronized|abstract)\s+)*[\w<>\[\], ?.]+\s+(\w+)\s*\([^;]*\)\s*(?:throws\s+[\w, ]+)?\{\s*$")],
    "bash": [("function", r"^\s*(?:function\s+)?([\w:-]+)\s*\(\)\s*\{?"), ("function", r"^\s*function\s+([\w:-]+)\s*\{")],
    "json": [("struct", r"^\s*\"([^\"]+)\"\s*:\s*[{\[]"), ("field", r"^\s*\"([^\"]+)\"\s*:\s*[^{\[\s]")],
    "yaml": [("struct", r"^\s*(?:-\s+)?([\w.-]+):\s*(?:#.*)?$"), ("field", r"^\s*(?:-\s+)?([\w.-]+):\s+\S")],
    "toml": [("module", r"^\s*\[+([^\]]+)\]"), ("field", r"^\s*([\w.-]+)\s*=")],
    "cfg": [("module", r"^\s*\[+([^\]]+)\]"), ("field", r"^\s*([\w.-]+)\s*[=:]")],
    "html": [("struct", r"<(\w[\w-]*)(?=\s)[^>]*?\sid\s*=\s*[\"']([^\"']+)", "#"), ("struct", r"<(main|nav|header|footer|form|section|template|dialog|\w+-[\w-]+)\b")],
    "css": [("constant", r"^\s*(@keyframes\s+[\w-]+)"), ("struct", r"^\s*([.#]?[\w.#:>\s-]+?)\s*\{")],
    "markdown": [("module", r"^#+\s*(.*?)\s*$")],
    "linkerscript": [("constant", r"^\s*(\w+)\s*\([rwx!ail]*\)\s*:\s*ORIGIN"), ("module", r"^\s*(\.[\w.]+)\s*(?:\([A-Z]+\))?\s*:")],
    "assembly": [("function", r"^\s*([A-Za-z_.$][\w.$]*):")],
    "slint": [("class", r"^\s*(?:export\s+)?component\s+(\w+)"), ("struct", r"^\s*(?:export\s+)?(?:struct|global)\s+(\w+)")],
    "docker": [("module", r"(?i)^\s*FROM\s+\S+\s+AS\s+(\S+)"), ("module", r"(?i)^\s*FROM\s+(\S+)")],
    "gradle": [("function", r"^\s*(?:task\s+|tasks\.(?:register|create)\s*\(?\s*[\"'])(\w+)")],
    "systemverilog": [("module", r"^\s*(?:module|package|interface|program)\s+(\w+)"), ("class", r"^\s*(?:virtual\s+)?class\s+(\w+)"), ("function", r"^\s*(?:function|task)\s+(?:automatic\s+)?(?:[\w\[\]:]+\s+)*(\w+)\s*[(;]")],
    "openscad": [("module", r"^\s*module\s+(\w+)"), ("function", r"^\s*function\s+(\w+)")],
}
DECLARATIONS["kotlin"], DECLARATIONS["javascript"], DECLARATIONS["mojo"] = DECLARATIONS["java"], DECLARATIONS["typescript"], DECLARATIONS["python"]
_TYPES = ["struct", "class", "trait", "enum", "interface", "scope", "union"]


def _scanned(sources: DataFrame, key: str, language: str | None, text: str, what: str, columns: str) -> DataFrame:
    """What the scanner finds in each text, in Arrow batches; a text is as large as its row."""
    lang = F.col(language) if language else F.lit(None).cast("string")
    rows = sources.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), lang.alias("l"), F.col(text).alias("t"))
    names = [c.split()[0] for c in columns.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forms = {x: [(kind, re.compile(form, re.A), *glue) for kind, form, *glue in f] for x, f in DECLARATIONS.items()}
        for batch in batches:
            for one in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                keys, found = [], []
                for k, x, t in zip(*(one.column(c).to_pylist() for c in "klt"), strict=True):
                    source = Source(t, x, forms)
                    got = source.symbols(_TYPES) if what == "symbols" else source.calls(_TYPES) if what == "calls" else [{"imported_path": p} for p in source.imports()]
                    keys += [k] * len(got)
                    found += got
                made = {"k": pa.array(keys, one.schema.field("k").type)}
                for c in columns.split(", "):
                    n, kind = c.split()
                    made[n] = pa.array([f[n] for f in found], pa.int32() if kind == "int" else pa.string())
                yield pa.RecordBatch.from_pydict(made)

    return rows.mapInArrow(scan, f"k {sources.schema[key].dataType.simpleString()}, {columns}").select(F.col("k").alias(key), *names)


def declared_symbols(sources: DataFrame, key: str, language: str, text: str) -> DataFrame:
    """Symbols that source lines declare: ``<key>, line_no, kind, name, parent, end_line, signature, doc``. A function inside of a
    type is a method, and the type its parent. The first line decides; the end follows from braces or indentation, the
    signature is the first line, the doc the comment lines above (Rust, C, C++). What stands in comments or strings declares
    nothing. Texts of other languages, and null or empty ones, have none."""
    rows = sources.filter(F.col(language).isin(*DECLARATIONS))
    found = _scanned(rows, key, language, text, "symbols", "line_no int, kind string, name string, parent string, end_line int, signature string, doc string")
    return found.filter("kind <> 'scope'")


def svd_symbols(sources: DataFrame, key: str, text: str) -> DataFrame:
    """Peripherals and registers of hardware descriptions: ``<key>, line_no, kind, name``; a register's name begins with that of
    its peripheral. What a ``<name>`` line names is what was last opened before it; names of anything else are left out."""
    rows = numbered_lines(sources, [key], text).filter(F.col("line").rlike(r"<(?:peripheral|register|field|cluster)\b|<name>"))
    opened = F.regexp_extract("line", r"<(peripheral|register|field|cluster)\b", 1)
    named = F.nullif(F.regexp_extract("line", r"<name>\s*([^<]*?)\s*</name>", 1), F.lit(""))
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    within = F.last(F.when(opened != "", opened), ignorenulls=True).over(upto)
    rows = rows.select(key, "line_no", named.alias("name"), within.alias("within")).filter(F.col("name").isNotNull() & F.col("within").isin("peripheral", "register"))
    owner = F.last(F.when(F.col("within") == "peripheral", F.col("name")), ignorenulls=True).over(upto)
    rows = rows.withColumn("owner", owner)
    name = F.when(F.col("within") == "register", F.concat_ws("::", "owner", "name")).otherwise(F.col("name"))
    return rows.select(key, "line_no", F.when(F.col("within") == "peripheral", "module").otherwise("field").alias("kind"), name.alias("name"))


def called_names(sources: DataFrame, key: str, text: str, language: str = "language") -> DataFrame:
    """Calls in source texts: ``<key>, line_no, callee, caller, caller_line``, the callee as written before its bracket, without type
    arguments; the caller is the outermost function or method around, null for calls outside of all. Comments, strings and
    the heads of declarations hold no calls."""
    known = language if language in sources.columns else None
    return _scanned(sources, key, known, text, "calls", "line_no int, callee string, caller string, caller_line int")


def imported_paths(sources: DataFrame, key: str, text: str, language: str = "language") -> DataFrame:
    """Imports of source texts, over several lines too: ``<key>, imported_path``, each once. Texts of no known language are looked
    through for the forms of all."""
    known = language if language in sources.columns else None
    return _scanned(sources, key, known, text, "imports", "imported_path string").distinct()


def _members_of(df: DataFrame, key: str, text: str, members: Callable[[str], list[tuple[str, str]]]) -> DataFrame:
    """``<key>, path, kind`` of the members that a parser of one text gives, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, paths, kinds = [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for path, kind in members(t) if t else []:
                    keys.append(k)
                    paths.append(path)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), pa.array(paths, pa.string()), pa.array(kinds, pa.string())], names=["k", "path", "kind"])

    kind = df.schema[key].dataType.simpleString()
    found = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, path string, kind string")
    return found.select(F.col("k").alias(key), "path", "kind")


def json_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, path, kind``: a row per member of every JSON text, with its dotted path; objects and arrays are of kind struct, scalars
    of kind field. Items of arrays have the array's path. Texts that are no JSON, null and empty ones give nothing."""

    def members(t: str) -> list[tuple[str, str]]:
        try:
            todo, out = [(json.loads(t), "")], []
        except (ValueError, RecursionError):
            return []
        while todo:
            v, p = todo.pop()
            if isinstance(v, dict):
                for k, x in v.items():
                    own = f"{p}.{k}" if p else k
                    out.append((own, "struct" if isinstance(x, (dict, list)) else "field"))
                    todo.append((x, own))
            elif isinstance(v, list):
                todo += [(x, p) for x in v]
        return out

    return _members_of(df, key, text, members)


#: A key of a YAML mapping at the start of a line (after its list marks), and what ends it.
_YAML_KEY = r"""(?:"([^"]*)"|'([^']*)'|([^\s"'\[{}\],#&*!|>%@`?-](?:[^:#]|:(?=\S)|(?<=\S)#)*?|-[^\s:][^:#]*?))\s*:(?=\s|$)"""
_YAML_FLOW = r"""\s*(?:([\[{])|([\]}])|(,)|(?:"((?:[^"\\]|\\.)*)"|'((?:[^']|'')*)'|([^\s,\[\]{}"'](?:[^,\[\]{}:]|:(?=\S))*))(\s*:(?=[\s,\[{}\]"']|$))?|(\S))"""


def _yaml_flow(text: str, prefix: str, form: re.Pattern) -> list[tuple[str, str]]:
    """Members of a flow value, which begins the text; what follows its end is passed over."""
    out: list = []
    over: list[str] = []  # paths of the open containers
    pending = prefix  # path of the value that comes next
    for m in form.finditer(text):
        opened, closed, comma, double, single, bare, colon, _ = m.groups()
        if opened:
            if out and pending == out[-1][0] and out[-1][1] == "field":
                out[-1] = (pending, "struct")
            over.append(pending)
        elif closed:
            if over:
                pending = over.pop()
            if not over:
                break
        elif comma:
            pending = over[-1] if over else prefix
        elif colon and over:
            name = next(x for x in (double, single, bare) if x is not None).strip()
            pending = f"{over[-1]}.{name}" if over[-1] else name
            out.append((pending, "field"))
    return out


def yaml_paths(df: DataFrame, key: str, text: str) -> DataFrame:
    """``<key>, path, kind``: a row per member of the mappings of every YAML text, with its dotted path; a member that holds a mapping
    or a list, in block or flow form, is of kind struct, any other, block scalars and empty ones too, of kind field. Items of
    lists have the list's path, several documents of a text follow each other. Null and empty texts and lines that are no
    members give nothing; anchors and tags before a value are passed over."""

    def members(t: str) -> list[tuple[str, str]]:
        form, flow = re.compile(_YAML_KEY), re.compile(_YAML_FLOW)
        lines = t.replace("\r\n", "\n").split("\n")
        out: list[tuple[str, str]] = []
        over: list[tuple[int, str, int]] = []  # column, path and place in the output of the members around
        scalar = None  # column of the member whose block scalar or flow value goes on
        depth, held = 0, []
        for line in lines:
            bare = line.strip()
            col = len(line) - len(line.lstrip(" "))
            if depth > 0:  # a flow value over several lines
                held.append(line)
                depth += sum(bare.count(c) for c in "[{") - sum(bare.count(c) for c in "]}")
                if depth <= 0:
                    out += _yaml_flow("\n".join(held), over[-1][1] if over else "", flow)
                continue
            if not bare or (scalar is not None and col > scalar):
                continue
            scalar = None
            if bare.startswith("#"):
                continue
            if line.startswith(("---", "...")):
                over = []
                continue
            listed = False
            while re.match(r"-(\s|$)", line[col:]):
                mark = col
                while over and (over[-1][0] > mark):  # the list may stand at its owner's own column
                    over.pop()
                if over:
                    out[over[-1][2]] = (over[-1][1], "struct")
                listed = True
                col += 1 + len(line[col + 1 :]) - len(line[col + 1 :].lstrip(" "))
            m = form.match(line, col)
            if not m:
                value = line[col:].strip()
                if value[:1] in ("{", "["):
                    depth, held = sum(value.count(c) for c in "[{") - sum(value.count(c) for c in "]}"), [value]
                    if depth <= 0:
                        out += _yaml_flow(value, over[-1][1] if over else "", flow)
                elif re.match(r"(?:[&!]\S+\s+)*[|>]", value):
                    scalar = mark if listed else col
                continue
            if not listed:
                while over and over[-1][0] >= col:
                    over.pop()
            name = next(x for x in m.groups() if x is not None).strip()
            path = f"{over[-1][1]}.{name}" if over else name
            if over:
                out[over[-1][2]] = (over[-1][1], "struct")
            value = re.sub(r"^(?:[&!]\S*\s*)+", "", line[m.end() :].strip())
            over.append((col, path, len(out)))
            out.append((path, "struct" if value[:1] in ("{", "[") else "field"))
            if value[:1] in ("{", "["):
                depth, held = sum(value.count(c) for c in "[{") - sum(value.count(c) for c in "]}"), [value]
                if depth <= 0:
                    out += _yaml_flow(value, path, flow)
            elif value[:1] in ("|", ">"):
                scalar = col
        if depth > 0:  # never closed
            out += _yaml_flow("\n".join(held), over[-1][1] if over else "", flow)
        return out

    return _members_of(df, key, text, members)
