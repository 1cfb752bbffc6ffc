"""Core operators on small literal inputs, sequential ones against plain models on random inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadstone.functions import ids as I
from threadstone.functions import text as T
from threadstone.functions import tokens as K
from threadstone.functions import vectors as V
from threadstone.operators import delta, graph, hygiene, memory, packing, search, synthesis, textual
from threadstone.operators import vectors as VO


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")


def test_token_estimates(spark):
    got = [tuple(r)[1:] for r in texts(spark, None, "", "short code", "a b c d e f", "x" * 31, "é é").select("i", K.estimate_tokens("t"), K.byte_tokens("t")).orderBy("i").collect()]
    assert got == [(0, 0), (0, 0), (4, 2), (6, 2), (11, 7), (2, 1)]


def test_lines_and_slices(spark):
    rows = texts(spark, None, "", "a", "a\n", "a\r\nb\n\n", "line1\nline2\nline3\nline4\nline5").select("i", T.lines("t").alias("l"), T.slice_lines("t", F.lit(2), F.lit(4)).alias("s")).orderBy("i").collect()
    assert [r.l for r in rows[:5]] == [None, [], ["a"], ["a"], ["a", "b", ""]]
    assert [r.s for r in rows] == [None, "", "", "", "b\n", "line2\nline3\nline4"]


def test_ids(spark):
    r = one(spark, I.file_id(F.lit("src\\a.rs")), I.file_id(F.lit("src/a.rs")), I.symbol_id(F.lit("f"), F.lit("m::g")), I.chunk_id(F.lit("f"), F.lit(None).cast("string"), F.lit("k"), F.lit("h")))
    import hashlib

    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert tuple(r) == (sha("src/a.rs"), sha("src/a.rs"), sha("f::m::g"), sha("fkh"))


def test_languages_kinds_commits(spark):
    got = [r[0] for r in texts(spark, "a/b.RS", "x.py", "Dockerfile", "build.gradle.kts", "none", "a.svd", None).orderBy("i").select(T.language("t")).collect()]
    assert got == ["rust", "python", "docker", "gradle", "unknown", "svd", "unknown"]
    assert [r[0] for r in texts(spark, " Fact ", "procedural", "x", None).orderBy("i").select(T.memory_kind("t")).collect()] == ["fact", "skill", None, None]
    kind, title, _ = T.commit_parts("t")
    got = [tuple(r) for r in texts(spark, "feat: ring buffer\n\nbody", "fix(core): overflow", "chore: x", "feat!: x", None, "perf:  a ").orderBy("i").select(kind, title).collect()]
    assert got == [("decision", "ring buffer"), ("error", "overflow"), (None, None), (None, None), (None, None), ("learning", "a")]


def test_cosine_and_hash_embedding(spark):
    v = lambda *x: F.array(*[F.lit(float(y)) for y in x])
    r = one(spark, V.cosine(v(1, 0), v(1, 1)), V.cosine(v(1, 0), v(1, 0, 0)), V.cosine(v(0, 0), v(1, 0)), V.cosine(F.lit(None).cast("array<float>"), v(1)), V.cosine(F.array().cast("array<float>"), F.array().cast("array<float>")))
    assert r[0] == pytest.approx(1 / math.sqrt(2)) and list(r)[1:] == [0.0] * 4
    e = one(spark, V.hash_embedding(F.lit("x"), 384), V.hash_embedding(F.lit("x"), 384), V.hash_embedding(F.lit(None).cast("string")))
    assert e[0] == e[1] and len(e[0]) == 384 and e[2] is None and np.linalg.norm(e[0]) == pytest.approx(1) and e[0][:8] == e[0][32:40]


def plain_pack(items, budget):
    used, taken = 0, []
    for k, s, t in sorted(items, key=lambda x: (-x[1] / x[2], -x[1], x[2], x[0])):
        if used + t <= budget:
            used += t
            taken.append((k, used))
    return taken


def test_pack_against_plain(spark):
    rnd = random.Random(4)
    rows = [(g, i, float(rnd.randint(1, 9)), rnd.randint(1, 60)) for g in "ab" for i in range(150)]
    got = packing.pack(spark.createDataFrame(rows, "g string, k int, s double, t long"), ["g"], "k", "s", "t", 200).orderBy("g", "pack_rank").collect()
    for g in "ab":
        assert [(r.k, r.used) for r in got if r.g == g] == plain_pack([x[1:] for x in rows if x[0] == g], 200)


def test_pack_skips_and_empties(spark):
    df = spark.createDataFrame([("g", 1, 9.0, 5), ("g", 2, 9.0, 20), ("g", 3, 1.0, 5), ("g", 4, None, 3), ("g", 5, 1.0, None), ("h", 6, 1.0, 99)], "g string, k int, s double, t long")
    got = {r.k: r.used for r in packing.pack(df, ["g"], "k", "s", "t", 12).collect()}
    assert got == {1: 5, 3: 10, 5: 0}
    assert packing.pack(df.limit(0), ["g"], "k", "s", "t", 12).collect() == []
    prefix = packing.pack_prefix(df.filter("g = 'g'"), ["g"], [F.col("k")], "t", 26).orderBy("k").collect()
    assert [(r.k, r.used) for r in prefix] == [(1, 5), (2, 25)]


def test_search_and_mmr(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(120, 8))
    m[7] = m[3]
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(120)] + [(500, None), (501, [1.0])], "id long, v array<double>")
    got = VO.search(df, df.filter("id % 50 = 0"), "id", "v", 5, 8).orderBy("query_id", "rank").collect()
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in (0, 50, 100):
        want = sorted(range(120), key=lambda i: (-(n[i] @ n[q]), i))[:5]
        assert [r.id for r in got if r.query_id == q] == want
    assert {r.query_id for r in got} == {0, 50, 100}
    cand = spark.createDataFrame([(0, 0, [1.0, 0.0, 0.0], [1.0, 1.0, 0.0]), (0, 1, [1.0, 0.0, 0.0], [1.0, 1.0, 0.0]), (0, 2, [0.0, 1.0, 0.0], [1.0, 1.0, 0.0])], "q long, id long, v array<double>, qv array<double>")
    picked = VO.mmr(cand, "q", "id", "v", "qv", 2, 0.5).orderBy("mmr_rank").collect()
    assert [(r.id, round(r.score, 4)) for r in picked] == [(0, 0.7071), (2, 0.7071)]
    assert VO.mmr(cand, "q", "id", "v", "qv", 0).collect() == []


@pytest.mark.parametrize("block", [1000, 17])
def test_leader_clusters(spark, block):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(6, 5))[rng.integers(0, 6, 80)] + rng.normal(size=(80, 5)) * 0.35
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(80)], "id long, v array<double>")
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    lead = {}
    for i in range(80):
        if i not in lead:
            lead |= {j: i for j in range(i, 80) if j not in lead and (j == i or n[i] @ n[j] >= 0.85)}
    assert {r.id: r.leader for r in VO.leader_clusters(df, "id", "v", 5, 0.85, block).collect()} == lead


def test_leader_clusters_odd_rows(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 3)) * [1, 1, 0.2]
    m[50:180] = m[7]  # copies hold a third
    n = m / np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(f"{i:04d}", m[i].tolist(), "x") for i in range(400)]
    odd = [("0100b", None, "x"), ("0100c", [0.0, 0.0, 0.0], "x"), ("0100d", [1.0], "x"), ("0100e", [1.0, None, 0.0], "x"), ("0100f", [float("nan"), 1.0, 0.0], "x"), (None, [1.0, 0.0, 0.0], "x")]
    df = spark.createDataFrame(rows + odd + rows[:9], "cell string, v array<double>, leader string")
    for threshold in (0.9, 0.999):
        want = {k: k for k, *_ in odd}
        for i in range(400):
            if f"{i:04d}" not in want:
                want |= {f"{j:04d}": f"{i:04d}" for j in range(i, 400) if f"{j:04d}" not in want and (j == i or n[i] @ n[j] >= threshold)}
        got = VO.leader_clusters(df, "cell", "v", 3, threshold, 20).collect()
        assert len(got) == len(want) and {r.cell: r.leader for r in got} == want
    assert all(r.cell == r.leader for r in VO.leader_clusters(df, "cell", "v", 3, 1.5).collect())
    assert VO.leader_clusters(df.limit(0), "cell", "v", 3, 0.9).collect() == []


def test_top_k_then_threshold(spark):
    df = spark.createDataFrame([("a", i, [1.0, i / 4]) for i in range(8)] + [("b", 9, [0.0, 1.0]), ("b", 10, None)], "g string, id long, v array<double>")
    q = V.vector([1.0, 0.0])
    assert [r.id for r in VO.top_k(df, "id", "v", q, 3).collect()] == [0, 1, 2]
    assert {r.id for r in VO.top_k_per_group(df, "g", "id", "v", q, 5, 0.9).collect()} == {0, 1}


def test_fusion(spark):
    rows = [("vector", 1, "a"), ("vector", 2, "b"), ("lexical", 1, "a"), ("lexical", 2, "c"), ("lexical", 5, "c")]
    df = spark.createDataFrame(rows, "stream string, rank int, key string")
    got = {r.key: r for r in search.fuse([df]).collect()}
    assert got["a"].score == pytest.approx(0.70 / 61) and got["b"].score == pytest.approx(0.35 / 62) and got["c"].score == pytest.approx(0.35 / 65)
    assert got["a"].graph_rank is None and search.fuse([df.limit(0)]).collect() == []


def test_hybrid_and_hierarchical(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "init", "init line", "calls init"), (2, [0.0, 1.0], None, None, "init"), (3, None, "x", "", "")], "id long, v array<double>, n string, o string, t string")
    got = search.hybrid(df, "id", "v", V.vector([1.0, 0.0]), "INIT", 5, "n", "o", "t").collect()
    assert [(r.id, round(r.score, 6)) for r in got] == [(1, 1.7), (2, 0.2)]
    assert len(search.hybrid(df, "id", "v", V.vector([1.0, 0.0]), "", 5, "n", "o", "t").collect()) == 3
    s = spark.createDataFrame([(1, "run", "m::run", None, ["m"]), (2, "rerun", None, None, None), (3, "x", "run::x", None, None), (4, "y", None, "will run", None), (5, "z", None, None, ["run"]), (6, "q", None, None, [])], "id long, name string, qualified_name string, summary string, breadcrumbs array<string>")
    assert [(r.id, r.confidence) for r in search.hierarchical(s, "id", "run", 9).collect()] == [(1, 1.0), (2, 0.8), (3, 0.7), (4, 0.5), (5, 0.4)]


def test_graph(spark):
    edges = spark.createDataFrame([(f"s{i}", f"s{i - 1}") for i in range(1, 50)] + [("a", "b"), ("b", "a")], "src string, dst string")
    roots = spark.createDataFrame([("s10",), ("a",)], "root string")
    near = {(r.root, r.node, r.hop) for r in graph.neighbourhood(edges, roots, 2).collect()}
    assert near == {("s10", "s9", 1), ("s10", "s8", 2), ("a", "b", 1), ("a", "a", 2)}
    assert {r.node for r in graph.neighbourhood(edges, roots.filter("root = 's10'"), 99, "callers").collect()} == {f"s{i}" for i in range(11, 16)}


def test_conflicts_and_supersession(spark):
    old = "Always use no_std for embedded drivers"
    said = ["Never use no_std for embedded drivers, always use with std", "Also use embedded-hal 1.0 for driver traits", None]
    assert [r[0] for r in texts(spark, *said).orderBy("i").select(T.is_conflict(F.lit(old), "t")).collect()] == [True, False, False]
    rules = spark.createDataFrame([(1, "decision", old), (2, "decision", said[0]), (3, "fact", said[0])], "id long, kind string, content string")
    assert [(r.first, r.second) for r in memory.conflicts(rules, "id", "kind", "content", [F.col("id")]).collect()] == [(1, 2)]
    df = spark.createDataFrame([("e", 1, 10), ("e", 2, 20), ("e", 3, 20), ("f", 4, None)], "e string, id long, at long").withColumn("at", F.timestamp_seconds("at"))
    assert {(r.id, r.valid_until and r.valid_until.second, r.superseded_by, r.status) for r in memory.supersede(df, ["e"], "id", "at").collect()} == {(1, 20, 2, "superseded"), (2, 20, 3, "superseded"), (3, None, None, "active"), (4, None, None, "active")}


def test_decay_and_consolidation(spark):
    d = lambda x: F.lit(float(x))
    r = one(spark, memory.decay_exponential(d(1), d(0)), memory.decay_exponential(d(1), d(30)), memory.decay_exponential(d(1), d(-5)), memory.decay_half_life(d(1), d(60)))
    assert list(r) == pytest.approx([1, math.exp(-1), 1, 0.25])
    bugs = spark.createDataFrame([("b1", 1, "UART timeout", "Set baud", "Serial Driver"), ("b2", 2, "Framing error", "Pull up", "Serial Driver")], "id string, at int, s string, r string, c string")
    rule = memory.consolidate(bugs, F.col("c"), "id", "s", "r", [F.col("at")]).first()
    assert (rule.rule_id, rule.n_incidents, rule.condition_pattern, rule.prescribed_solution, round(rule.confidence, 6)) == ("rule_serial_driver", 2, "UART timeout | Framing error", "1. Set baud\n2. Pull up", 0.7)


def test_staleness_and_delta(spark):
    snap = spark.createDataFrame([("m", "a", "1"), ("m", "b", "1"), ("n", "a", "1"), ("o", "z", None)], "model string, path string, h string")
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, h string")
    got = {r.model: (r.is_stale, r.n_changed, r.n_missing) for r in memory.stale(snap, "model", "path", "h", now, "path", "h").collect()}
    assert got == {"m": (True, 1, 0), "n": (False, 0, 0), "o": (True, 0, 1)}
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("e", None)], "id string, h string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1"), ("e", None)], "id string, h string")
    assert {r.id: r.change for r in delta.classify(old, new, "id", "h").collect()} == {"a": "unchanged", "b": "updated", "c": "removed", "d": "added", "e": "updated"}
    assert {(r.id, r.h) for r in delta.upsert(old, new, ["id"]).collect()} == {("a", "1"), ("b", "2"), ("c", "1"), ("d", "1"), ("e", None)}
    assert {(r.k, r.v) for r in delta.latest(spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 2, 6)], "k string, o int, v int"), ["k"], ["o"]).collect()} == {("k", 6)}


def test_hygiene(spark):
    logs = [("small ok", 0), ("line\nError: broke\npanic: x\n" * 20, 101), ("error[E0308]: mismatched types\n" * 40, 1), (None, 0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(logs)], "i int, t string, code int")
    rows = df.select("i", *hygiene.condense("t", F.col("code"), 64)).orderBy("i").collect()
    assert [r.mode for r in rows] == ["passthrough", "highlights", "head_tail", "passthrough"]
    assert rows[1].n_highlights == 40 and "mismatched" in rows[2].condensed and "\n\n[... 10 lines condensed ...]\n\n" in rows[2].condensed and rows[1].condensed.startswith("Key error/warning highlights (40 total found):\n") and rows[3].condensed == ""
    reads = spark.createDataFrame([(1, "a", "h1", False), (2, "a", "h1", False), (3, "a", "h1", True), (4, "a", "h2", False), (5, "b", None, False), (6, "b", None, False)], "seq int, p string, h string, f boolean")
    got = [(r.suppressed, r["count"], r.is_first) for r in hygiene.read_guard(reads.withColumn("ts", F.timestamp_seconds("seq")), ["p"], "h", "ts", "seq", F.col("f")).orderBy("seq").collect()]
    assert got == [(False, 1, True), (True, 2, False), (False, 1, False), (False, 1, False), (False, 1, True), (True, 2, False)]
    files = spark.createDataFrame([("a/b/x", 30), ("a/b/y", 10), ("z", 60)], "p string, n long")
    assert {r.folder: (r.tokens, r.pct) for r in hygiene.token_map(files, "p", "n").collect()} == {"a/b": (40, 40.0), ".": (60, 60.0)}
    saved = spark.createDataFrame([("c", 7000), ("g", 11000), ("g", None)], "category string, saved_bytes long")
    assert {r.category: r.saved_tokens for r in hygiene.ledger_by_category(saved).collect()} == {"c": 1750, "g": 2750}


def test_sections_headings_outlines(spark):
    doc = "intro\n# One\ntext\n```\n# code comment\n```\n## Two\n\n# Three\nDeviceManager here"
    df = spark.createDataFrame([("d", doc), ("e", ""), ("n", None), ("o", "\n\n")], "id string, t string")
    got = [(r.section_no, r.heading, r.content) for r in textual.sections(df, "id", "t").orderBy("section_no").collect()]
    assert got == [(0, "Overview", "intro"), (1, "One", "text\n```"), (2, "code comment", "```"), (3, "Three", "DeviceManager here")]
    assert [(r.line_no, r.level, r.heading) for r in textual.headings(df, ["id"], "t").orderBy("line_no").collect()] == [(2, 1, "One"), (5, 1, "code comment"), (7, 2, "Two"), (9, 1, "Three")]


def test_mentions_and_enclosing(spark):
    docs = spark.createDataFrame([("d1", "Uses DeviceManagers."), ("d2", "x the manager_x2 run"), ("d3", None)], "id string, t string")
    names = spark.createDataFrame([("DeviceManager",), ("manager",), ("Manager",), ("run",), ("ab",), ("a b",), (None,)], "name string")
    got = {(r.id, r.name) for r in textual.mentions(docs, "id", ["t"], names, "name").collect()}
    assert got == {("d1", "DeviceManager"), ("d1", "manager"), ("d1", "Manager"), ("d2", "manager"), ("d2", "Manager"), ("d2", "run")}
    calls = spark.createDataFrame([(1, "f", 20), (2, "f", 700), (3, "g", 20), (4, "f", 5)], "c int, f string, line int")
    spans = spark.createDataFrame([("f", "outer", 10, 900), ("f", "inner", 15, 30), ("g", "other", 21, 30)], "f string, symbol_id string, start_line int, end_line int")
    assert {(r.c, r.symbol_id) for r in textual.enclosing(calls, spans, ["f"], "c", "line").collect()} == {(1, "outer"), (2, "outer")}


def test_declarations_calls_imports(spark):
    sources = [
        ("rust", "use crate::x;\npub struct DeviceManager {}\nimpl DeviceManager {\n    pub fn new() -> Self { helper(1) }\n    fn reset(&self) {}\n}\nfn free() {}\n"),
        ("python", "import os\nclass ThermalRegulator:\n    def heat_up(self):\n        self.x.go()\n"),
        ("typescript", "import { a } from './a';\nexport class MotorController {\n  setSpeed(v: number): void {\n  }\n}\n"),
        ("c", "#include \"stm32f4xx_hal.h\"\nvoid UART_Init(int x) {\n}\ntypedef struct UART_ConfigTypeDef {\n"),
        ("cobol", "fn x"), ("rust", None), ("rust", ""),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(sources)], "id int, language string, content string")
    got = {(r.name, r.kind) for r in textual.declared_symbols(df, "id", "language", "content").collect()}
    assert got >= {("DeviceManager", "struct"), ("new", "method"), ("reset", "method"), ("free", "function"), ("ThermalRegulator", "class"), ("heat_up", "method"), ("MotorController", "class"), ("setSpeed", "method"), ("UART_Init", "function"), ("UART_ConfigTypeDef", "struct")}
    assert {r.imported_path for r in textual.imported_paths(df, "id", "content").collect()} == {"crate::x", "os", "./a", "stm32f4xx_hal.h"}
    assert "self.x.go" in {r.callee for r in textual.called_names(df, "id", "content").collect()}


def test_answers_and_contexts(spark):
    arr = lambda *x: F.array(*[F.lit(y) for y in x]).cast("array<string>")
    mem = lambda *x: F.array(*[F.struct(F.lit("fact").alias("kind"), F.lit(y).alias("title"), F.lit(y * 2).alias("content")) for y in x]).cast("array<struct<kind:string,title:string,content:string>>")
    r = one(spark, synthesis.answer(F.lit("q?"), mem("m1", "m2"), arr("r"), arr("s1", "s2", "s3", "s4"), 100), synthesis.answer(F.lit("q?"), mem(), arr("r"), arr(), 100), synthesis.answer(F.lit("q?"), mem(), arr(), arr("s" * 900), 20))
    assert r[0].startswith('### 🎯 Answer for: "q?"\n\nBased on active project **FACT** (`m1`):\n> m1m1\n\n') and "- **[FACT] m2**: m2m2\n" in r[0] and "s3" in r[0] and "s4" not in r[0]
    assert "constraints:\n> r\n" in r[1] and r[2].endswith("*(Truncated to fit 20 token budget constraint)*\n")
    c = spark.createDataFrame([("t", 1, 2.0, 5, "A", "one"), ("t", 2, 1.0, 5, None, None), ("t", 3, 9.0, 50, "C", "big")], "task string, k int, s double, n long, title string, text string")
    assert synthesis.packed_context(c, "k", "s", "n", "title", "text", 10, ["task"]).first().context == "### A\none\n\n### \n"


def test_guard_and_supersession_over_stretches_of_time(spark):
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["s", "t", None]), rnd.choice("ab"), rnd.choice([None, *range(0, 400_000, 20_000)])) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, p string, h string, sec long").withColumn("ts", F.timestamp_seconds("sec"))
    got = {r.id: (r.suppressed, r["count"], r.is_first) for r in hygiene.read_guard(df, ["p"], "h", "ts", "id").collect()}
    ended = {r.id: r.superseded_by for r in memory.supersede(df, ["p"], "id", "ts").collect()}
    for p in ("s", "t", None):
        last, n, own = None, 0, sorted((r for r in rows if r[1] == p), key=lambda r: (r[3] is not None, r[3] or 0, r[0]))
        for i, r in enumerate(own):
            n = n + 1 if i and r[2] == last else 1
            assert got[r[0]] == (i > 0 and r[2] == last, n, i == 0)
            assert ended[r[0]] == (own[i + 1][0] if i + 1 < len(own) else None)
            last = r[2]


def test_declarations_of_other_languages(spark):
    sources = [
        ("java", "public class Motor {\n    public void spin(int v) {\n    }\n}\n"), ("kotlin", "class Gear\nfun turn(x: Int): Int {\n"), ("bash", "build() {\n}\nfunction clean {\n}\n"),
        ("json", '{\n  "server": {\n    "port": 1,\n    "enabled": true\n  }\n}\n'), ("yaml", "version: 3\nservices:\n  web:\n    image: x\n"), ("toml", "[package]\nname = \"x\"\n"),
        ("html", '<main id="app-root">\n<form class="c" id="login-form">\n<x-tag>\n<p>\n'), ("css", ".dashboard-card {\n}\n@keyframes pulse {\n"), ("markdown", "# Architecture Overview\n## Subsystems\n"),
        ("linkerscript", "  FLASH (rx) : ORIGIN = 0x0\n  .text :\n"), ("assembly", "Reset_Handler:\n  b x\n"), ("systemverilog", "module alu_core (\n"), ("openscad", "module gear_mount(r) {\n"), ("docker", "FROM rust:1 AS build\n"), ("gradle", "task copyAll {\n"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(sources)], "id int, language string, content string")
    got = {(sources[r.id][0], r.name, r.kind) for r in textual.declared_symbols(df, "id", "language", "content").collect()}
    want = {
        ("java", "Motor", "class"), ("java", "spin", "method"), ("kotlin", "Gear", "class"), ("kotlin", "turn", "function"), ("bash", "build", "function"), ("bash", "clean", "function"), ("json", "server", "struct"),
        ("json", "port", "field"), ("json", "enabled", "field"), ("yaml", "version", "field"), ("yaml", "services", "struct"), ("yaml", "web", "struct"), ("toml", "package", "module"), ("html", "main#app-root", "struct"),
        ("html", "form#login-form", "struct"), ("html", "x-tag", "struct"), ("css", ".dashboard-card", "struct"), ("css", "@keyframes pulse", "constant"), ("markdown", "Architecture Overview", "module"), ("markdown", "Subsystems", "module"),
        ("linkerscript", "FLASH", "constant"), ("linkerscript", ".text", "module"), ("assembly", "Reset_Handler", "function"), ("systemverilog", "alu_core", "module"), ("openscad", "gear_mount", "module"), ("docker", "build", "module"), ("gradle", "copyAll", "function"),
    }
    assert want <= got, want - got
    svd = "<device><name>X</name>\n<peripheral>\n<name>GPIOA</name>\n<register>\n<name>MODER</name>\n<field><name>M0</name></field>\n</register>\n<register>\n<name>ODR</name>\n"
    rows = textual.svd_symbols(spark.createDataFrame([("d", svd), ("e", None)], "id string, t string"), "id", "t").collect()
    assert {(r.name, r.kind) for r in rows} == {("GPIOA", "module"), ("GPIOA::MODER", "field"), ("GPIOA::ODR", "field")}


def test_texts_of_notes(spark):
    k = spark.createDataFrame([("tidy", None, ["t"], ["one", "two"], None, "p", None)], "name string, description string, triggers array<string>, workflow_steps array<string>, required_tools array<string>, provenance_project string, success_count long")
    text = k.select(synthesis.skill_text()).first()[0]
    assert "1. one\n2. two\n" in text and text.endswith("*Provenance: p (Executed 0 times)*\n")
    m = spark.createDataFrame([("io", "q", "a", ["s"], None, True, None)], "topic string, question string, standing_answer string, referenced_symbols array<string>, referenced_files array<string>, is_stale boolean, last_refreshed_at timestamp")
    text = m.select(synthesis.model_text()).first()[0]
    assert "flagged as STALE" in text and "## Referenced Symbols\n- `s`\n" in text and "Referenced Files" not in text
    r = spark.createDataFrame([("T", "rule_x", 0.7, "b1, b2", "p", "1. s")], "title string, rule_id string, confidence double, incident_ids string, condition_pattern string, prescribed_solution string")
    assert "- **Rule ID**: `rule_x`\n- **Confidence**: 0.70\n" in r.select(synthesis.rule_text()).first()[0]


def test_watched_paths(spark):
    got = [r[0] for r in texts(spark, "src/a.rs", "target/a.rs", ".git/x.py", "x.unknown", "logo.png", ".index/memories/fact.md", None).orderBy("i").select(T.is_watched("t")).collect()]
    assert got == [True, False, False, False, True, True, False]


def test_approximate_search_reaches_its_recall_and_splits_hot_cells(spark, monkeypatch):
    rnd = np.random.default_rng(4)
    x = np.r_[rnd.normal(size=(300, 8)), rnd.normal(size=8) + 0.05 * rnd.normal(size=(200, 8))]  # a cell holds two fifths of all rows
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, [1.0])], "id long, v array<float>")
    monkeypatch.setattr(VO, "PART_BYTES", 4000)
    asked = rows.filter("id % 50 = 0")
    found, exact = VO.search_near(rows, asked, "id", "v", 10, 8, cells=12), VO.search(rows, asked, "id", "v", 10, 8)
    got = VO.recall_of(found, exact, "id").first()
    assert got.n_exact == 100 and got.recall >= 0.9
    scores = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.id) in scores)
    assert VO.search_near(rows.limit(0), asked.limit(0), "id", "v", 10, 8).count() == 0


def test_cosine_of_ragged_and_null_vectors(spark):
    from threadstone.functions.vectors import cosine

    rows = [(1, [1.0, 0.0], [1.0, 1.0]), (2, None, [1.0]), (3, [], []), (4, [1.0], [1.0, 2.0]), (5, [0.0, 0.0], [1.0, 1.0]), (6, [1.0, None], [1.0, 1.0]), (7, [3.0], [-2.0])]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<double>")
    got = {r.id: round(r.c, 6) for r in df.select("id", cosine("a", "b").alias("c")).collect()}
    assert got == {1: 0.707107, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0, 7: -1.0}
