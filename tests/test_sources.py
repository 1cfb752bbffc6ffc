"""Sources, sinks, the store and streams: round trips through real files."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from threadstone.functions.ids import file_id
from threadstone.operators import synthesis
from threadstone.sources import files as S
from threadstone.sources.store import Store
from threadstone.streaming import events as ST


def test_walk(spark, tmp_path):
    for name, data in {"src/a.rs": b"fn a() {}\n", "logo.png": b"\x89PNG\x00\xff", "bad.txt": b"\xff\xfe\xfa", "big.txt": b"x" * 3000, "big.md": b"y" * 3000, ".git/x": b"no", "target/y.rs": b"no"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    rows = {r.relative_path: r for r in S.walk(spark, str(tmp_path), max_kb=2).collect()}
    assert set(rows) == {"src/a.rs", "logo.png", "big.md"}
    assert rows["src/a.rs"].language == "rust" and rows["src/a.rs"].content == "fn a() {}\n"
    assert "Extension: png" in rows["logo.png"].content and "6 bytes" in rows["logo.png"].content
    assert rows["src/a.rs"].id == spark.range(1).select(file_id(F.lit("src/a.rs"))).first()[0]


def test_commits_transcripts_packages(spark, tmp_path):
    (tmp_path / "log").write_text("abc1|Ada|feat: ring\n\nbody|x\n---COMMIT_END---\ndef2|Bo|fix: y\n---COMMIT_END---\nnonsense\n---COMMIT_END---")
    got = {r.hash: (r.author, r.message.split("\n")[0]) for r in S.commits(spark, str(tmp_path / "log")).collect()}
    assert got == {"abc1": ("Ada", "feat: ring"), "def2": ("Bo", "fix: y")}
    lines = [json.dumps({"usage": {"input_tokens": 5, "output_tokens": 2}}), json.dumps({"token_usage": {"cached_tokens": 3}}), "broken {", json.dumps({"x": 1})]
    (tmp_path / "t.jsonl").write_text("\n".join(lines))
    got = sorted((r.input_tokens, r.output_tokens, r.cached_tokens) for r in S.transcript_usage(spark, str(tmp_path / "t.jsonl")).collect())
    assert got == [(5, 2, 0), (len(lines[1]) // 4, 0, 3)]
    for root, crate, text in (("r1", "a", '[package]\nname = "alpha"\nversion = "1.2.0"\ndescription = "no_std things"\n[dependencies]\nname = "x"\n'), ("r2", "b", '[package]\nname = "alpha"\n'), ("r2", "c", '[workspace]\nmembers = []\n')):
        (tmp_path / root / crate).mkdir(parents=True)
        (tmp_path / root / crate / "Cargo.toml").write_text(text)
    rows = S.packages(spark, [str(tmp_path / "r1"), str(tmp_path / "r2")]).collect()
    assert [(r.crate_name, r.version, r.no_std) for r in rows] == [("alpha", "1.2.0", True)]


def memories(spark):
    at = dt.datetime(2024, 5, 1, 12, 0)
    rows = [("m1", "decision", "Use pure no_std", "For STM32 drivers\nand more", ["embedded", "stm32"], "active", "init", "ada", at), ("m2", "fact", "Plain", "Text", [], "superseded", None, None, None)]
    return spark.createDataFrame(rows, "id string, kind string, title string, content string, tags array<string>, status string, symbol_ref string, author string, created_at timestamp_ntz")


def test_vault_round_trip(spark, tmp_path):
    S.write_vault(memories(spark), str(tmp_path / "v"))
    for i, p in enumerate((tmp_path / "v").rglob("*.txt")):
        (tmp_path / f"n{i}").mkdir()
        p.rename(tmp_path / f"n{i}" / f"{p.parent.name.removeprefix('kind=')}.md")
    got = {r.id: r for r in S.read_vault(spark, str(tmp_path / "n*")).collect()}
    m = got["m1"]
    assert (m.kind, m.title, m.content, m.tags, m.status, m.symbol_ref, m.author, m.created) == ("decision", "Use pure no_std", "For STM32 drivers\nand more", ["embedded", "stm32"], "active", "init", "ada", dt.datetime(2024, 5, 1, 12, 0))
    assert (got["m2"].kind, got["m2"].tags, got["m2"].author) == ("fact", [], None)


def test_notes(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Rules\n- Never block\n* Always test\nplain\n")
    note = spark.createDataFrame([("s1", dt.datetime(2024, 1, 1), "Ship it", "Test", ["a"], [], None, ["a.rs", "b.rs"])], "session_id string, at timestamp, active_goal string, next_action string, completed_tasks array<string>, pending_tasks array<string>, key_decisions array<string>, modified_files array<string>")
    (tmp_path / "h.md").write_text(note.select(synthesis.handoff_text()).first()[0])
    assert [r.title for r in S.rule_bullets(spark, str(tmp_path / "a.md")).collect()] == ["Never block", "Always test"]
    assert len(S.find_notes(spark, str(tmp_path), "NEVER").collect()) == 1 and len(S.find_notes(spark, str(tmp_path), "").collect()) == 2
    h = S.read_handoff(spark, str(tmp_path / "h.md")).first()
    assert (h.session_id, h.active_goal, h.next_action, h.completed_tasks, h.pending_tasks, h.key_decisions, h.modified_files) == ("s1", "Ship it", "Test", ["a"], [], [], ["a.rs", "b.rs"])


def test_chunks_of_files(spark):
    files = spark.createDataFrame([("f", "a\nb\nc\n"), ("g", "x\ny"), ("h", "  \n"), ("i", None)], "id string, content string")
    symbols = spark.createDataFrame([("f", "s1", 1, 2), ("f", "s2", 3, 3)], "file_id string, symbol_id string, start_line long, end_line long")
    got = {(r.file_id, r.symbol_id, r.kind, r.text) for r in S.chunked(files, symbols).collect()}
    assert got == {("f", "s1", "symbol_chunk", "a\nb"), ("f", "s2", "symbol_chunk", "c"), ("g", None, "file_summary", "x\ny")}


def file_id_of(spark, path):
    return spark.range(1).select(file_id(F.lit(path))).first()[0]


def test_store(spark, tmp_path):
    st = Store(spark, str(tmp_path / "s"))
    assert st.counts() == {"file": 0, "symbol": 0, "chunk": 0}
    st.upsert("file", spark.createDataFrame([("f1", "a.rs", "h1"), ("f2", "b.rs", "h2")], "id string, relative_path string, content_hash string"))
    st.upsert("file", spark.createDataFrame([("f1", "a.rs", "h9")], "id string, relative_path string, content_hash string"))
    assert {r.id: r.content_hash for r in st.table("file").collect()} == {"f1": "h9", "f2": "h2"}
    st.upsert("symbol", spark.createDataFrame([("s1", "f1", "run"), ("s2", "f2", "stop")], "id string, file_id string, name string"))
    st.upsert("calls", spark.createDataFrame([("s1", "stop"), ("s2", "run")], "caller_id string, callee_name string"))
    st.delete_files(st.table("file").filter("id = 'f1'").select("id", "relative_path"))
    assert [r.id for r in st.table("symbol").collect()] == ["s2"] and [r.caller_id for r in st.table("calls").collect()] == ["s2"]
    t = dt.datetime(2024, 1, 1)
    first, none = st.remember("Always use no_std for embedded drivers", [1.0, 0.1], "decision", at=t)
    second, against = st.remember("Never use no_std for embedded drivers, use with std", [1.0, 0.1], "decision", at=dt.datetime(2024, 2, 1), resolve=True)
    assert none == [] and against == [first]
    old = st.get("memory_record", first).first()
    assert (old.status, old.superseded_by, old.valid_until) == ("superseded", second, dt.datetime(2024, 2, 1)) and len(old.embedding) == 2
    assert [r.id for r in st.recall(5, kind="decision").collect()] == [second]
    assert [r.id for r in st.recall(5, as_of=F.lit(dt.datetime(2024, 1, 15))).collect()] == [first]
    assert [r.id for r in st.recall(5, as_of=F.lit(dt.datetime(2024, 2, 1))).collect()] == [second], "not valid at its end"
    st.upsert("mental_model", spark.createDataFrame([("i", "auth", ["b.rs"], [1.0, 0.0]), ("j", "io", ["c.rs"], [0.5, 0.5])], "id string, topic string, referenced_files array<string>, embedding array<double>"))
    assert st.standing_model([1.0, 0.0]).first().topic == "auth"
    assert st.mark_stale(spark.createDataFrame([("b.rs",), ("z",)], "path string")) == 1
    assert st.standing_model([1.0, 0.0]).first().topic == "io"
    st.upsert("chunk", spark.createDataFrame([("c1", file_id_of(spark, "b.rs"), "file_outline", "o")], "id string, file_id string, kind string, text string"))
    st.upsert("symbol", spark.createDataFrame([("s9", file_id_of(spark, "b.rs"), "go", 3)], "id string, file_id string, name string, start_line int"))
    assert st.file_outline("b.rs").first().id == "c1" and [r.name for r in st.file_symbols("b.rs").collect()] == ["go"]
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "decision.md").write_text(f"## {old.title}\n- **ID**: `{first}`\n- **Status**: `active`\n\n{old.content}\n---\n## New\n- **ID**: `m9`\n\nText\n")
    st.sync_vault(str(tmp_path / "notes"), str(tmp_path / "vault"))
    assert len(st.get("memory_record", first).first().embedding) == 2 and st.get("memory_record", "m9").first().kind == "decision"
    assert (tmp_path / "vault" / "kind=decision").exists()
    st.export_bundle(str(tmp_path / "bundle"))
    other = Store(spark, str(tmp_path / "o"))
    other.import_bundle(str(tmp_path / "bundle"))
    assert other.counts() == st.counts() and {r.id for r in other.table("memory_record").collect()} == {first, second, "m9"}
    (tmp_path / "bad" / "manifest").mkdir(parents=True)
    (tmp_path / "bad" / "manifest" / "m.txt").write_text('{"version": 99, "tables": []}')
    with pytest.raises(ValueError):
        other.import_bundle(str(tmp_path / "bad"))


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(minutes=30 * i), i % 2, "view", float(i), p) for i, p in enumerate("aabbaabb")]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    e = ST.read_events(spark, str(tmp_path))
    got = {(r.window_start.hour, r.n) for r in ST.run_to_table(ST.windowed_counts(e, "event_type", "2 hours"), "w", "complete").collect()}
    assert got == {(0, 4), (2, 4)}
    out = ST.guard_to_table(ST.read_events(spark, str(tmp_path)).select("event_id", "ts", "user_id", F.col("props").alias("content")), ["user_id"]).collect()
    assert {r.event_id: r.suppressed for r in out} == {i: False for i in range(8)}, "contents alternate for each user"


def test_guard_over_several_batches(spark, tmp_path):
    """State crosses batches: runs go on, sessions that pause keep theirs, and late reads count as later."""
    rnd = random.Random(6)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, t0 + dt.timedelta(hours=rnd.randint(0, 40) if i % 9 == 0 else i), rnd.choice([1, 1, 1, 2, 3]), rnd.choice(["a", "a", "b", None])) for i in range(90)]
    schema = "event_id long, ts timestamp, user_id long, content string"
    for no in range(3):
        part = spark.createDataFrame(rows[no * 30 : no * 30 + 30], schema).coalesce(1)
        part.write.parquet(str(tmp_path / f"b{no}"))
        part.write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.suppressed, r["count"]) for r in ST.guard_to_table(stream, ["user_id"]).collect()}
    last, want = {}, {}
    for no in range(3):
        for event, ts, user, content in sorted(rows[no * 30 : no * 30 + 30], key=lambda r: (r[1], r[0])):
            seen = last.get(user)
            same = seen is not None and seen[0] == content
            n = seen[1] + 1 if same else 1
            last[user], want[event] = (content, n), (same, n)
    assert got == want


def test_ignore_rules(spark):
    from threadstone.sources.files import ignore_rules, not_ignored

    rules = ignore_rules("# note\n\n*.lock\n!keep.lock\n/build/\ndocs/**/draft?.md\nvendor/\na[1].txt\n")
    want = {
        "x.lock": False, "a/b/x.lock": False, "a/keep.lock": True, "build/x.c": False, "a/build/x.c": True, "docs/draft1.md": False, "docs/a/b/draft2.md": False,
        "docs/draft10.md": True, "a/vendor/x.go": False, "vendor.go": True, "src/main.rs": True, "a1.txt": False, "a[1].txt": True, "docs/draft1.md/x": False,
    }
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.k for r in df.select("p", not_ignored(F.col("p"), rules).alias("k")).collect()} == want
