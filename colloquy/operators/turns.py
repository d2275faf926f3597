"""Conversations as turns: normalisation, samples, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEGAL_ROLES = ("user", "assistant")
SPEAKERS = {"user": "User", "assistant": "AI"}


def from_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn_index (from 0), role, text: legal roles only, numbered anew in turn order."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    legal = conversations.where(F.col("role").isin(*LEGAL_ROLES))
    return legal.select("conv_id", (F.row_number().over(order) - 1).alias("turn_index"), "role", "text")


def assistant_samples(turns: DataFrame, train_share: int = 8) -> DataFrame:
    """One row per assistant turn: what stands before it, the next user turn, and whether it can train a preference.

    split: train for train_share of ten conversations by a hash of the id. dpo_eligible: the history ends with the user, a user
    turn follows, and the conversation is in train.
    """
    own = Window.partitionBy("conv_id").orderBy("turn_index")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("history", F.collect_list(F.struct("role", "text")).over(before)).withColumn("previous_role", F.lag("role").over(own))
    following = F.when(F.lead("role").over(own) == "user", F.lead("text").over(own))
    rows = rows.withColumn("next_user_turn", following).where("role = 'assistant'")
    split = F.when(bucket("split", "conv_id", 10) < train_share, "train").otherwise("test")
    rows = rows.withColumn("split", split).withColumn("history_ends_with_user", F.coalesce(F.col("previous_role") == "user", F.lit(False)))
    eligible = F.col("history_ends_with_user") & F.col("next_user_turn").isNotNull() & (F.col("split") == "train")
    sample = F.concat(F.col("conv_id").cast("string"), F.lit("#assistant-"), F.lpad(F.col("turn_index").cast("string"), 4, "0"))
    return rows.select("conv_id", "turn_index", sample.alias("sample_id"), "history", F.col("text").alias("response"), "next_user_turn", "split", "history_ends_with_user", eligible.alias("dpo_eligible"))


def bucket(seed: str, key: str, buckets: int) -> Column:
    """A number below buckets that depends on the seed and the key only."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def hash_order(seed: str, *keys: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys)), 256)


def speaker_lines(history: Column) -> Column:
    name = F.create_map(*(F.lit(x) for item in SPEAKERS.items() for x in item))
    return F.array_join(F.transform(history, lambda t: F.concat(F.element_at(name, t["role"]), F.lit(": "), t["text"])), "\n")


def scoring_prompts(samples: DataFrame) -> DataFrame:
    return samples.select("conv_id", "turn_index", speaker_lines(F.col("history")).alias("prompt"), "response", "next_user_turn")


def training_prompts(samples: DataFrame, last: int = 10, instruction: str = "Reply as the assistant.") -> DataFrame:
    """The last turns of the history below an instruction, with an open line for the answer."""
    recent = F.when(F.size("history") > last, F.slice("history", -last, last)).otherwise(F.col("history"))
    prompt = F.concat(F.lit(instruction + "\n"), speaker_lines(recent), F.when(F.size(recent) > 0, "\n").otherwise(""), F.lit("AI:"))
    return samples.select("conv_id", "turn_index", prompt.alias("prompt"))


def bounded_context(turns: DataFrame, last: int = 3) -> DataFrame:
    """Every turn but the first with the last few before it, speakers alternating backwards from the turn itself, numbered from 1."""
    recent = Window.partitionBy("conv_id").orderBy("turn_index").rowsBetween(-last, -1)
    rows = turns.withColumn("context", F.collect_list("text").over(recent)).where(F.size("context") > 0)
    n = F.size("context")
    lines = F.transform("context", lambda t, i: F.concat(F.when((n - i) % 2 == 1, "User: ").otherwise("AI: "), t))
    return rows.select("conv_id", (F.col("turn_index") + 1).alias("turn_number"), F.array_join(lines, "\n").alias("prompt"), F.col("text").alias("response"))


def merge_consecutive(turns: DataFrame) -> DataFrame:
    """Runs of one role as one turn: their texts by line, the same text twice in a row once, with the turns they came from."""
    own = Window.partitionBy("conv_id").orderBy("turn_index")
    change = F.coalesce(F.lag("role").over(own) != F.col("role"), F.lit(True)).cast("int")
    repeat = F.coalesce((F.lag("role").over(own) == F.col("role")) & (F.lag("text").over(own) == F.col("text")), F.lit(False))
    rows = turns.withColumn("island", F.sum(change).over(own)).withColumn("repeated", repeat)
    parts = F.array_sort(F.collect_list(F.when(~F.col("repeated"), F.struct("turn_index", "text"))))
    merged = rows.groupBy("conv_id", "island", "role").agg(parts.alias("parts"), F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn"), F.count("*").alias("n_turns"))
    return merged.select("conv_id", (F.col("island") - 1).cast("int").alias("turn_index"), "role", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"), "first_turn", "last_turn", "n_turns")


def parse_transcript(rows: DataFrame, separator: str = r"\|EOM\|") -> DataFrame:
    """A transcript column as turns: role by the speaker's prefix, a (move) in front taken off, blank segments marked."""
    segments = rows.select("conv_id", F.posexplode(F.split("transcript", separator)).alias("segment_index", "segment"))
    trimmed = F.trim("segment")
    body = F.trim(F.regexp_replace(trimmed, r"^(Teacher|Student):\s*", ""))
    move = F.nullif(F.regexp_extract(body, r"^\(([a-z_]+)\)", 1), F.lit(""))
    text = F.trim(F.regexp_replace(body, r"^\([a-z_]+\)\s*", ""))
    role = F.when(trimmed.startswith("Teacher:"), "assistant").otherwise("user")
    return segments.select("conv_id", "segment_index", role.alias("role"), move.alias("move"), text.alias("text"), (F.length(text) == 0).alias("is_blank"))


def reject_reasons(conversations: DataFrame, min_exchanges: int = 1) -> DataFrame:
    """conv_id, n_turns, reject_reason (null: accepted): roles, strict alternation from the user on, an assistant at the end, enough exchanges, no blank text; the first that fails."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("expected", F.when(F.row_number().over(own) % 2 == 1, "user").otherwise("assistant")).withColumn("is_last", F.lead("turn").over(own).isNull())
    facts = rows.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.bool_or(~F.col("role").isin(*LEGAL_ROLES)).alias("bad_role"),
        F.bool_or(F.col("role") != F.col("expected")).alias("not_alternating"),
        F.bool_or(F.col("is_last") & (F.col("role") != "assistant")).alias("open_end"),
        F.bool_or(F.coalesce(F.trim("text") == "", F.lit(True))).alias("blank"),
    )
    reason = (
        F.when(F.col("bad_role"), "invalid_role").when(F.col("blank"), "blank_text").when(F.col("not_alternating"), "not_alternating")
        .when(F.col("open_end"), "open_end").when(F.col("n_turns") < 2 * min_exchanges, "too_short")
    )
    return facts.select("conv_id", "n_turns", reason.alias("reject_reason"))


def validate(conversations: DataFrame, declared: DataFrame) -> DataFrame:
    """conv_id, violations: declared counts of turns by role that differ from those recounted."""
    real = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants"))
    both = declared.join(real, "conv_id", "left")
    checks = F.array(
        F.when(F.coalesce("n", F.lit(0)) != F.col("num_messages"), "num_messages"),
        F.when(F.coalesce("users", F.lit(0)) != F.col("num_user_turns"), "num_user_turns"),
        F.when(F.coalesce("assistants", F.lit(0)) != F.col("num_assistant_turns"), "num_assistant_turns"),
    )
    return both.select("conv_id", F.array_join(F.array_compact(checks), ",").alias("violations"))


def reassign_roles(lines: Column) -> Column:
    """Lines as turns whose roles alternate backwards from the last, an assistant's; any prefix of the old speaker is dropped."""
    bare = F.transform(lines, lambda t: F.regexp_replace(t, r"^(User|AI|Teacher|Student):\s*", ""))
    n = F.size(bare)
    return F.transform(bare, lambda t, i: F.concat(F.when((n - i) % 2 == 1, "AI: ").otherwise("User: "), t))
