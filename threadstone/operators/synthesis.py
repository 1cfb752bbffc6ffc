"""Texts put together from ranked pieces: packed contexts, grounded answers, memory blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadstone.functions.tokens import estimate_tokens
from threadstone.operators.packing import pack


def packed_context(candidates: DataFrame, key: str, score: str, tokens: str, title: str, text: str, budget: int, group: list[str]) -> DataFrame:
    """Candidates packed into a budget per group, as one text each: ``<group>, context, used, n_included``. What is joined are the
    taken items, which the budget bounds."""
    taken = pack(candidates, group, key, score, tokens, budget)
    full = taken.drop(tokens).join(candidates.select(*group, key, title, text), [*group, key])
    block = F.concat(F.lit("### "), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct("pack_rank", F.col(key).alias("k"), block.alias("b"))))
    return full.groupBy(*group).agg(
        F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n").alias("context"), F.max("used").alias("used"), F.count(F.lit(1)).alias("n_included")
    )


# Headings and sentences of reflections and contexts.
REFLECTION = "# Reflection: {q}\n\n## Grounded Evidence\n\n"
CONTEXT = "# 🧠 Cognitive Context (Budget: {budget} tokens)\n\n**Task**: `{task}`\n\n"
CONSTRAINTS, SNIPPETS = "## 📜 Active Architectural Constraints\n", "## 🧩 Relevant Symbols & Code Subgraphs\n"
OBJECTIVE = "## 🎯 Active Project Objective\n- **Active Goal**: {goal}\n- **Next Action**: {action}\n\n"
RULE_SCORE, RESERVED = 90.0, 50


def reflection(question: str, standing: DataFrame, evidence: DataFrame, budget: int) -> DataFrame:
    """One row ``question, answer, citations, from_model``: the standing model's answer (``topic, standing_answer``, one row at most),
    else the evidence (``key, score, title, text, tokens``) packed into the budget, in the order of packing."""
    taken = pack(evidence.withColumn("_g", F.lit(0)), ["_g"], "key", "score", "tokens", budget)
    full = taken.select("key", "pack_rank").join(evidence.select("key", "title", "text"), "key")
    block = F.concat(F.lit("### "), F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n\n"))
    listed = full.agg(F.array_sort(F.collect_list(F.struct("pack_rank", F.col("key").alias("k"), block.alias("b")))).alias("x"))
    model = standing.limit(1).agg(F.first("topic").alias("topic"), F.first("standing_answer").alias("standing"))  # a row, of nulls without a model
    has = F.col("topic").isNotNull()
    found = F.concat(F.lit(REFLECTION.replace("{q}", question)), F.array_join(F.transform("x", lambda v: v["b"]), ""))
    cited = F.array_join(F.transform("x", lambda v: v["k"].cast("string")), ",")
    return listed.join(model, F.lit(True)).select(
        F.lit(question).alias("question"), F.when(has, F.coalesce("standing", F.lit(""))).otherwise(found).alias("answer"),
        F.when(has, F.col("topic")).otherwise(cited).alias("citations"), has.alias("from_model"),
    )


def context(task: str, rules: DataFrame, candidates: DataFrame, goal: str | None, action: str | None, budget: int) -> DataFrame:
    """One row ``task, context, n_rules, n_snippets``: rules (``n, title, pattern, solution, confidence``) with a high score and
    candidates (``key, score, title, text, tokens``) packed into what the budget leaves beside the handoff and a reserve, then
    written in sections."""
    said = OBJECTIVE.replace("{goal}", goal or "").replace("{action}", action or "") if goal is not None else ""
    lone = rules.sparkSession.range(1).select(F.greatest(F.lit(budget) - estimate_tokens(F.lit(said)) - RESERVED, F.lit(0)).alias("left")).first().left  # one row
    rule = F.concat(
        F.lit("- **[Rule: "), "title", F.lit("]** When `"), "pattern", F.lit("` => `"), F.coalesce("solution", F.lit("")), F.lit("` (confidence: "), F.format_number("confidence", 2), F.lit(")")
    )
    texts = rules.select(F.concat(F.lit("rule_"), F.lpad("n", 6, "0")).alias("key"), F.lit(RULE_SCORE).alias("score"), "title", rule.alias("text"))
    texts = texts.withColumn("tokens", estimate_tokens("text"))
    items = texts.unionByName(candidates.select(F.concat(F.lit("doc_"), F.lpad(F.col("key").cast("string"), 12, "0")).alias("key"), "score", "title", "text", "tokens"))
    taken = pack(items.withColumn("_g", F.lit(0)), ["_g"], "key", "score", "tokens", lone).select("key", "pack_rank")
    full = taken.join(items.select("key", "title", "text"), "key").withColumn("is_rule", F.startswith("key", F.lit("rule_")))
    listed = full.agg(F.array_sort(F.collect_list(F.struct("pack_rank", "key", "is_rule", "title", "text"))).alias("x"))
    own = lambda yes: F.filter("x", lambda v: v["is_rule"] == F.lit(yes))
    shown_rules = F.array_join(F.transform(own(True), lambda v: F.concat(v["text"], F.lit("\n"))), "")
    shown = F.array_join(F.transform(own(False), lambda v: F.concat(F.lit("### "), v["title"], F.lit("\n```\n"), F.coalesce(v["text"], F.lit("")), F.lit("\n```\n\n"))), "")
    n_rules, n_snippets = F.size(own(True)), F.size(own(False))
    text = F.concat(
        F.lit(CONTEXT.replace("{budget}", str(budget)).replace("{task}", task) + said),
        F.when(n_rules > 0, F.concat(F.lit(CONSTRAINTS), shown_rules, F.lit("\n"))).otherwise(""), F.when(n_snippets > 0, F.concat(F.lit(SNIPPETS), shown)).otherwise(""),
    )
    return listed.select(F.lit(task).alias("task"), text.alias("context"), n_rules.cast("long").alias("n_rules"), n_snippets.cast("long").alias("n_snippets"))


# The sentences in the functions below are fixed values too: what is written has to read so.


def answer(question: Column, memories: Column, rules: Column, snippets: Column, budget: int) -> Column:
    """A grounded answer. ``memories`` are structs of kind, title and content, rules and snippets texts. The first memory is the
    headline, else the first rule, else a fallback; other memories are bullets, then at most three snippets. A text of more
    tokens than the budget is cut to three characters a token, with a notice."""
    top, rule = F.try_element_at(memories, F.lit(1)), F.try_element_at(rules, F.lit(1))
    quote = lambda c: F.concat(F.lit("\n> "), c, F.lit("\n\n"))
    head = F.when(top.isNotNull(), F.concat(F.lit("Based on active project **"), F.upper(top["kind"]), F.lit("** (`"), F.coalesce(top["title"], F.lit("")), F.lit("`):"), quote(F.coalesce(top["content"], F.lit("")))))
    head = head.when(rule.isNotNull(), F.concat(F.lit("According to active architectural constraints:"), quote(rule)))
    head = head.otherwise(F.lit("No direct prescriptive rule or decision found for this query in project memory.\n\n"))
    more = F.transform(F.slice(memories, 2, F.greatest(F.size(memories) - 1, F.lit(0))), lambda m: F.concat(F.lit("- **["), F.upper(m["kind"]), F.lit("] "), F.coalesce(m["title"], F.lit("")), F.lit("**: "), F.coalesce(m["content"], F.lit("")), F.lit("\n")))
    support = F.when(F.size(more) > 0, F.concat(F.lit("#### 📌 Key Supporting Decisions & Facts:\n"), F.array_join(more, ""), F.lit("\n"))).otherwise("")
    code = F.array_join(F.transform(F.slice(snippets, 1, 3), lambda x: F.concat(F.lit("```\n"), x, F.lit("\n```\n"))), "")
    shown = F.when(F.size(snippets) > 0, F.concat(F.lit("#### 🧩 Code Symbols & Graph Context:\n"), code)).otherwise("")
    text = F.concat(F.lit('### 🎯 Answer for: "'), question, F.lit('"\n\n'), head, support, shown)
    long = (estimate_tokens(text) > budget) & (F.length(text) > 3 * budget)
    return F.when(long, F.concat(F.substring(text, 1, 3 * budget), F.lit(f"\n\n*(Truncated to fit {budget} token budget constraint)*\n"))).otherwise(text)


def citations(memory_ids: Column, rules: Column) -> Column:
    """What an answer rests on: its memories, or the first rule, or nothing."""
    return F.when(F.size(memory_ids) > 0, F.array_join(memory_ids, ",")).when(F.size(rules) > 0, F.lit("rule_0")).otherwise(F.lit(""))


def memory_block() -> Column:
    """A memory as a Markdown section: title, metadata bullets, content."""
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"- **{name}**: "), c))
    tick = lambda c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit("`"), c, F.lit("`")))
    tags = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), " ")
    return F.concat_ws(
        "\n", F.concat(F.lit("## "), F.coalesce("title", F.lit(""))), line("ID", tick(F.col("id"))), line("Status", tick(F.col("status"))),
        line("Created", tick(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))), line("Tags", tags), line("Governs Symbol", tick(F.col("symbol_ref"))),
        line("Author", tick(F.col("author"))), F.lit(""), F.coalesce("content", F.lit("")), F.lit("\n---\n"),
    )


def _list(items: Column, form: str) -> Column:
    shown = F.array_join(F.transform(items, lambda x: F.format_string(form + "\n", x)), "")
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, shown).otherwise("- *(None)*\n")


def handoff_text() -> Column:
    """A handoff as Markdown, as `sources.files.read_handoff` reads it."""
    c = lambda x: F.coalesce(F.col(x), F.lit(""))
    return F.concat(
        F.lit("# Project Handover Status\n\n- **Session ID**: "), c("session_id"), F.lit("\n- **Timestamp**: "), F.coalesce(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"), F.lit("")),
        F.lit("\n- **Active Goal**: "), c("active_goal"), F.lit("\n\n## Next Immediate Action\n> "), c("next_action"), F.lit("\n\n## Completed Tasks\n"), _list(F.col("completed_tasks"), "- [x] %s"),
        F.lit("\n## Pending Tasks\n"), _list(F.col("pending_tasks"), "- [ ] %s"), F.lit("\n## Key Decisions & Context\n"), _list(F.col("key_decisions"), "- %s"),
        F.lit("\n## Modified Files\n"), _list(F.col("modified_files"), "- `%s`"), F.lit("\n"),
    )


def _items(items: Column, form: str) -> Column:
    return F.coalesce(F.array_join(F.transform(items, lambda x: F.format_string(form + "\n", x)), ""), F.lit(""))


def skill_text() -> Column:
    """A skill as Markdown: description, triggers, tools, numbered steps, provenance."""
    steps = F.coalesce(F.array_join(F.transform("workflow_steps", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.lit("\n"))), ""), F.lit(""))
    return F.concat(
        F.lit("# Skill: "), "name", F.lit("\n\n> "), F.coalesce("description", F.lit("")), F.lit("\n\n## Triggers\n"), _items(F.col("triggers"), "- `%s`"), F.lit("\n## Required Tools\n"),
        _items(F.col("required_tools"), "- `%s`"), F.lit("\n## Execution Workflow\n"), steps,
        F.format_string("\n*Provenance: %s (Executed %d times)*\n", F.coalesce("provenance_project", F.lit("")), F.coalesce("success_count", F.lit(0))),
    )


def model_text() -> Column:
    """A standing answer as Markdown, marked if it is stale."""
    some = lambda title, c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.concat(F.lit(f"## {title}\n"), _items(F.col(c), "- `%s`"), F.lit("\n"))).otherwise("")
    stale = F.when(F.coalesce("is_stale", F.lit(False)), "> ⚠️ *Note: This mental model is flagged as STALE due to recent code changes.*\n\n").otherwise("")
    return F.concat(
        F.lit("# Mental Model: "), "topic", F.lit("\n\n**Standing Question:** "), F.coalesce("question", F.lit("")), F.lit("\n\n"), stale, F.lit("## Standing Answer\n\n"), F.coalesce("standing_answer", F.lit("")),
        F.lit("\n\n"), some("Referenced Symbols", "referenced_symbols"), some("Referenced Files", "referenced_files"),
        F.lit("*Last Refreshed: "), F.coalesce(F.date_format("last_refreshed_at", "yyyy-MM-dd HH:mm:ss"), F.lit("")), F.lit(" UTC*\n"),
    )


def rule_text() -> Column:
    """A consolidated rule as Markdown: id, confidence and incidents, trigger, prescription."""
    return F.concat(
        F.lit("## "), "title", F.lit("\n- **Rule ID**: `"), "rule_id", F.lit("`\n- **Confidence**: "), F.format_number("confidence", 2), F.lit("\n- **Source Incidents**: "), "incident_ids",
        F.lit("\n\n### Trigger Condition\n> "), "condition_pattern", F.lit("\n\n### Prescribed Action / Fix\n"), "prescribed_solution", F.lit("\n\n---\n\n"),
    )
