"""When a conversation should be reminded to save a note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Tools that edit, tools that only look, and the patterns looked for.
EDIT_TOOLS = ["edit", "write"]
READ_ONLY = ["read", "grep", "find", "ls"]
SHELL_WRITE = (
    r"""\bsed\s+(-\w*\s+)*-i|\bperl\s+-\w*i|(^|[^0-9&>])>{1,2}\s*(?!&|/dev/null)[\w./~"'-]|\btee\b|"""
    r"""\b(mv|cp)\s|write_(bytes|text)\(|writeFileSync\(|open\([^)]*["'][wa]b?["']"""
)
LASTING = r"(?i)以后|今后|往后|记住|记下|别忘|from now on|going forward|in (?:the )?future|remember (?:that|this)|keep in mind"


def shell_writes(command: Column | str) -> Column:
    """Whether a shell command changes files."""
    return F.rlike(F.col(command) if isinstance(command, str) else command, F.lit(SHELL_WRITE))


def note_nudges(
    messages: DataFrame, note_tool: str, own_tools: str, reminder: str
) -> DataFrame:
    """conv_id, reason: ``debugged`` (a tool failed, then a file was edited) or ``told`` (a lasting wish).

    ``messages``: conv_id, turn, role, text, tool, call_id, is_error, arguments, kind. Only what
    follows a conversation's last user message counts, and never twice or after a note was saved.
    ``note_tool`` saves notes, names of the knowledge base's tools begin with ``own_tools``, ``reminder`` is the kind of
    message that reminds. Conversations are reduced by aggregates; the join back is on a one-row-per-conversation side,
    which adaptive execution splits if a conversation is very long. Calls and their results meet by call id; what has
    none joins nothing.
    """
    user = F.col("role") == "user"
    last = messages.filter(user).groupBy("conv_id").agg(
        F.max("turn").alias("said_at"), F.max_by("text", "turn").alias("said")
    )
    run = messages.join(last.select("conv_id", "said_at"), "conv_id").filter(F.col("turn") > F.col("said_at"))

    call = (F.col("role") == "assistant") & F.col("tool").isNotNull()
    writes = (
        run.filter(call & ~F.col("tool").isin(READ_ONLY) & ~F.startswith("tool", F.lit(own_tools)))
        .filter(shell_writes("arguments"))
        .select("conv_id", "call_id")
        .filter("call_id is not null")
        .distinct()
    )
    result = F.col("role") == "toolResult"
    failed = F.coalesce("is_error", F.lit(False))
    shell = run.filter(result & ~failed & F.col("call_id").isNotNull()).join(writes, ["conv_id", "call_id"], "left_semi")
    shell = shell.groupBy("conv_id").agg(F.max("turn").alias("shell_at"))
    facts = run.groupBy("conv_id").agg(
        F.min(F.when(result & failed, F.col("turn"))).alias("failed_at"),
        F.max(F.when(result & ~failed & F.coalesce(F.col("tool").isin(EDIT_TOOLS), F.lit(False)), F.col("turn"))).alias("tool_at"),
        F.max(
            ((F.col("role") == "custom") & F.col("kind").eqNullSafe(reminder))
            | (call & F.col("tool").eqNullSafe(note_tool))
        ).alias("done"),
    )
    facts = facts.join(shell, "conv_id", "left").withColumn("edited_at", F.greatest("tool_at", "shell_at"))
    fixed = F.coalesce(F.col("failed_at") < F.col("edited_at"), F.lit(False))
    reason = F.when(fixed, "debugged").when(F.rlike("said", F.lit(LASTING)), "told")
    return (
        last.join(facts, "conv_id", "left")
        .filter(~F.coalesce("done", F.lit(False)))
        .select("conv_id", reason.alias("reason"))
        .filter("reason is not null")
    )
