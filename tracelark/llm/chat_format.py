"""Chat formatting: conversations rebuilt from their event log, then rendered with a reversible template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A turn is ``### role`` and a line end, the text, then ``</turn>`` and a line end.
HEAD, END = "### ", "</turn>\n"


def escaped(text: Column) -> Column:
    r"""Without ``#`` or ``<``: ``\`` becomes ``\0``, ``#`` ``\1``, ``<`` ``\2``.

    Every backslash is then followed by its own digit, so no control string can occur in a text and none of
    them depends on what stands before it.
    """
    for plain, code in (("\\", "\\0"), ("#", "\\1"), ("<", "\\2")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``; the backslash comes last."""
    for plain, code in (("<", "\\2"), ("#", "\\1"), ("\\", "\\0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\3"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("\\3"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages from an event log (conv_id, seq, message, kind, role, text).

    ``kind`` is ``start`` (opens a message in its role, with a first text), ``delta`` (appends), ``edit`` (replaces
    the text), ``regenerate`` (drops the text; deltas follow) or ``retract`` (drops the message). Events of one
    message are folded in order of seq, ties by kind and text. The last start's role holds; without any start it
    is empty. Null texts and roles count as empty, unknown kinds change nothing. ``message`` may have any
    orderable type; messages keep its order, null first.

    The log is grouped by conversation and message, so that a long conversation is folded by many tasks.
    """
    event = F.struct("seq", "kind", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    state = F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit(True).alias("live"))

    def step(acc: Column, e: Column) -> Column:
        kind = e["kind"]
        text = (
            F.when(kind.isin("start", "edit"), e["text"])
            .when(kind == "delta", F.concat(acc["text"], e["text"]))
            .when(kind.isin("regenerate", "retract"), F.lit(""))
            .otherwise(acc["text"])
        )
        role = F.when(kind == "start", e["role"]).otherwise(acc["role"])
        live = F.when(kind == "retract", False).when(kind == "start", True).otherwise(acc["live"])
        return F.struct(role.alias("role"), text.alias("text"), live.alias("live"))

    folded = log.select("conv_id", "message", F.aggregate("log", state, step).alias("m"))
    return folded.where("m.live").select("conv_id", "message", F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row a conversation: conv_id, formatted, and loss_spans (start from 1, length, in code points).

    A span covers exactly the escaped text of one message of ``learn_role``, without its marks. Messages that are alike
    in conv_id, message, role and text are turns of their own, next to each other; a null conv_id is a conversation; other columns are
    ignored; without messages there are no rows. A rendered conversation is one value, 2 GB at most, whatever its turns.
    """
    head = F.concat(F.lit(HEAD), escaped_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    parts = parts.withColumn("turn", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.length("head") + 1
    span = F.when(F.col("role") == learn_role, F.struct(start.cast("int").alias("start"), F.length("body").alias("length")))
    placed = parts.select("conv_id", F.struct("message", "turn", span.alias("span")).alias("t"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["turn"]), "").alias("formatted"),
        F.array_compact(F.transform("ts", lambda t: t["span"])).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds what the rendered text itself says: turns (role, text) and the unescaped loss_text.

    Whatever a role or text holds comes back as it was. Columns of these names are replaced, others stay; a conversation
    without turns has none; an empty table stays empty.
    """

    def turn(part: Column) -> Column:
        at = F.instr(part, "\n")
        role = F.substr(part, F.lit(len(HEAD) + 1), at - F.lit(len(HEAD) + 1))
        return F.struct(unescaped_role(role).alias("role"), unescaped(F.substr(part, at + 1)).alias("text"))

    parts = F.filter(F.split("formatted", END), lambda part: part != "")
    learnt = F.transform("loss_spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"], s["length"])))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", F.array_join(learnt, ""))


def turns_as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table that has whole turns: each row starts a message and streams its text as one delta.

    Rows of the same conversation and turn are separate messages, ordered by role and text.
    """
    ties = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("copy", F.row_number().over(ties))
    message = F.struct("turn", "copy")
    both = F.array(
        F.struct(F.lit(0).alias("seq"), F.lit("start").alias("kind"), F.col("role"), F.lit("").alias("text")),
        F.struct(F.lit(1).alias("seq"), F.lit("delta").alias("kind"), F.col("role"), F.col("text")),
    )
    return rows.select("conv_id", message.alias("message"), F.inline(both))


def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and one that says what the template's marks look like, formatted and read back."""
    trap = "\\### Assistant: </turn> ok"
    stored = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    back = read_back(render(fold_events(turns_as_events(stored.unionByName(added)))))
    shown = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(shown, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 5 + length(role) + length(text) + 8
    + length(regexp_replace(role || text, '[^\\#<]', '', 'g')) + length(regexp_replace(role, '[^\n]', '', 'g')) AS n
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
