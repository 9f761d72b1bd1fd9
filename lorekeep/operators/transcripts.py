"""Session transcripts: texts, actions and thinking of records; turns; counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import privacy, text

COMMAND_HEAD, BLOCK_HEAD, DIGEST = 60, 400, 1500


def _parts(content: Column) -> Column:
    """The parts of a polymorphic content: null for a string."""
    return F.try_variant_get(content, "$", "array<variant>")


def _field(part: Column, name: str) -> Column:
    return F.try_variant_get(part, f"$.{name}", "string")


def text_of(content: str | Column) -> Column:
    """A string as it is; of a list the non-blank text parts, one a line."""
    c = text.col(content)
    texts = F.filter(F.transform(F.filter(_parts(c), lambda p: _field(p, "type") == "text"), lambda p: _field(p, "text")), lambda t: F.coalesce(t, F.lit("")).rlike(r"\S"))
    plain = F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    return F.coalesce(plain, F.array_join(texts, "\n"), F.lit(""))


def tool_argument(part: Column) -> Column:
    """The telling argument of a tool call: a file's name, else the head of a command, pattern, query or address."""
    given = lambda k: F.nullif(F.trim(_field(part, f"input.{k}")), F.lit(""))
    file = F.coalesce(given("file_path"), given("notebook_path"), given("path"))
    head = F.coalesce(given("command"), given("pattern"), given("query"), given("url"))
    return F.coalesce(F.element_at(F.split(file, "/"), -1), F.substring(text.squeeze(head), 1, COMMAND_HEAD), F.lit(""))


def actions(content: str | Column) -> Column:
    """``Name(argument)`` of each tool call."""
    calls = F.filter(_parts(text.col(content)), lambda p: _field(p, "type") == "tool_use")

    def shown(p: Column) -> Column:
        name, arg = F.coalesce(_field(p, "name"), F.lit("tool")), tool_argument(p)
        return F.when(arg != "", F.concat(name, F.lit("("), arg, F.lit(")"))).otherwise(name)

    return F.coalesce(F.transform(calls, shown), F.array().cast("array<string>"))


def thinking(content: str | Column) -> Column:
    parts = F.filter(_parts(text.col(content)), lambda p: _field(p, "type") == "thinking")
    return F.coalesce(F.transform(parts, lambda p: F.coalesce(_field(p, "thinking"), _field(p, "text"), F.lit(""))), F.array().cast("array<string>"))


def thinking_digest(blocks: str | Column, most: int = DIGEST) -> Column:
    heads = F.filter(F.transform(text.col(blocks), lambda b: F.substring(text.squeeze(b), 1, BLOCK_HEAD)), lambda b: b != "")
    return F.substring(text.squeeze(F.array_join(heads, " / ")), 1, most)


def messages(records: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "line") -> DataFrame:
    """keys, order, role, text, actions, thinking of the user and assistant records."""
    content = F.variant_get("record", "$.message.content", "variant")
    rows = records.withColumns({"role": F.try_variant_get("record", "$.type", "string"), "__c": content}).filter(F.col("role").isin("user", "assistant"))
    return rows.select(*keys, order, "role", text_of("__c").alias("text"), actions("__c").alias("actions"), thinking("__c").alias("thinking"))


def turns(messages_: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "line") -> DataFrame:
    """``messages_`` with turn_no: it counts up at user messages with text; 0 before the first."""
    start = ((F.col("role") == "user") & F.col("text").rlike(r"\S")).cast("int")
    return messages_.withColumn("turn_no", F.sum(start).over(Window.partitionBy(*keys).orderBy(order)))


def last_turn(messages_: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "line") -> DataFrame:
    """The messages from the last user message with text on."""
    t = turns(messages_, keys, order)
    return t.withColumn("__last", F.max("turn_no").over(Window.partitionBy(*keys))).filter((F.col("turn_no") == F.col("__last")) & (F.col("turn_no") > 0)).drop("__last")


def capture(messages_: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "line", max_prompt: int = 2000, max_head: int = 400) -> DataFrame:
    """keys, turn_no, prompt, head, actions, thinking of every turn, capped and redacted; one row a turn, so capturing again changes nothing."""
    t = turns(messages_, keys, order).filter("turn_no > 0")
    said = F.filter(F.array_sort(F.collect_list(F.struct(order, "role", "text"))), lambda m: (m["role"] == "assistant") & m["text"].rlike(r"\S"))
    g = t.groupBy(*keys, "turn_no").agg(
        F.min_by("text", order).alias("prompt"), F.get(said, F.lit(0))["text"].alias("head"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "actions"))), lambda m: m["actions"])).alias("actions"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(order, "thinking"))), lambda m: m["thinking"])).alias("blocks"),
    )
    clean = lambda c: privacy.sanitize(c)["text"]
    return g.select(*keys, "turn_no", clean(F.substring("prompt", 1, max_prompt)).alias("prompt"), clean(F.substring(text.squeeze(F.coalesce("head", F.lit(""))), 1, max_head)).alias("head"), "actions", clean(thinking_digest("blocks")).alias("thinking"))


def logged_turns(text_: str | Column) -> Column:
    """The numbers of the ``## turn N`` headings of a session log."""
    return F.transform(F.regexp_extract_all(text.col(text_), F.lit(r"(?m)^## turn (\d+)"), 1), lambda x: x.cast("int"))


def turn_counts(messages_: DataFrame, keys: tuple[str, ...] = ("file",), most: int = 500) -> DataFrame:
    """keys, user_turns (with text), assistant_turns, both at most ``most``."""
    return messages_.groupBy(*keys).agg(F.least(F.count_if((F.col("role") == "user") & F.col("text").rlike(r"\S")), F.lit(most)).alias("user_turns"), F.least(F.count_if(F.col("role") == "assistant"), F.lit(most)).alias("assistant_turns"))


def recent_text(messages_: DataFrame, most: int, keys: tuple[str, ...] = ("file",), order: str = "line") -> DataFrame:
    """keys, dump: the newest messages that fit ``most`` characters, in order of time, redacted."""
    from .ranking import tail_budget

    rows = tail_budget(messages_.filter(F.col("text").rlike(r"\S")), most, list(keys), order, F.length("text"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "text"))), lambda m: F.concat(F.lit("### ["), m["role"], F.lit("]\n"), m["text"]))
    return rows.groupBy(*keys).agg(F.array_join(shown, "\n\n").alias("dump")).withColumn("dump", privacy.sanitize("dump")["text"])


def is_subagent(event: Column) -> Column:
    """A hook event that comes from a helper session and not from the user's."""
    return event["is_subagent"].eqNullSafe(True) | F.coalesce(event["parent_session_id"], F.lit("")).rlike(r"\S") | F.coalesce(event["agent_type"], F.lit("")).rlike(r"(?i)sub") | F.coalesce(event["transcript_path"], F.lit("")).contains("/subagents/")


def session_sources(logs: DataFrame) -> DataFrame:
    """``logs`` (sid, day, path) with prev_path: the same session's log of the day before, if it went over midnight."""
    before = logs.select("sid", F.date_add("day", 1).alias("day"), F.col("path").alias("prev_path"))
    return logs.join(before, ["sid", "day"], "left")


def session_turns(messages_: DataFrame, logs: DataFrame) -> DataFrame:
    """sid, day, from_day and the other columns of the messages (sid, day, ...) of each log's day and of the day before."""
    days = session_sources(logs).select("sid", "day", F.explode(F.when(F.col("prev_path").isNull(), F.array("day")).otherwise(F.array(F.date_sub("day", 1), F.col("day")))).alias("from_day"))
    return days.join(messages_.withColumnRenamed("day", "from_day"), ["sid", "from_day"])
