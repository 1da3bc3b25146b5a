"""Chat formatting from event logs.

An event log has one row an event: conversation, sequence, message, operation, role, text. `begin` opens a message and names its role, `delta` (or `message`, which brings all at once) adds to its
text, `edit` puts a text in its place, `regenerate` empties it for new deltas, `end` closes it; other operations are as `end`. Events are folded per message, in their sequence,
so a long stream is not gathered with the rest of its conversation and a task sends on what it has of a message as one row; only finished messages meet, in the
one row that a formatted conversation is. A table of turns is a log too: each row is a message that begins, comes in DELTAS pieces and ends, and goes through the fold.
A message stands where its first event stood. Rendered, a turn is `<s>[INST] role [/INST]text</s>`. Control strings inside roles and texts get
a backslash after their first character (and one more if there are some), which is undone by taking one away. DataFrame functions only.

Defined cases: null text and role are empty strings, null sequences come first, null conversations are one conversation, conversations and sequences have any type that sorts. Messages that
tie in sequence are ordered by role, then text; events of a message that tie by operation, then text; rows of a table of turns that repeat are turns each. A message whose
events all lack text is an empty turn. Very long texts stay whole. No rows, no conversations. Further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOCATOR, pick, with_locator

OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Pieces in which a turn of a table comes.
DELTAS = 4
_CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def messages(events: DataFrame, conv: str = "conv_id", seq: str = "seq", message: str = "message_id", op: str = "op", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, seq, role, text): the final messages of an event log."""
    e = events.select(
        pick(events, conv).alias("conv"), pick(events, seq).alias("seq"), pick(events, message).alias("message"), pick(events, op).alias("op"),
        F.coalesce(pick(events, role).cast("string"), F.lit("")).alias("role"), F.coalesce(pick(events, text).cast("string"), F.lit("")).alias("text"),
    )
    parts = e.groupBy("conv", "message").agg(F.min("seq").alias("seq"), F.max("role").alias("role"), F.sort_array(F.collect_list(F.struct("seq", "op", "text"))).alias("events"))
    # what counts begins at the last event that replaces the text
    last = F.array_max(F.transform("events", lambda x, i: F.when(x["op"].isin("edit", "regenerate"), i).otherwise(F.lit(0))))
    live = F.filter(F.slice("events", last + 1, F.size("events")), lambda x: x["op"].isin("message", "delta", "edit"))
    return parts.select("conv", "seq", "role", F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"))


def render(turns: DataFrame) -> DataFrame:
    """(conv, formatted) of final messages."""
    turn = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MID), escape(F.col("text")), F.lit(CLOSE))
    rows = turns.select("conv", F.struct("seq", "role", "text", turn.alias("turn")).alias("row"))
    together = rows.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return together.select("conv", F.array_join(F.transform("rows", lambda r: r["turn"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation holds: its turns' and its loss mask's digests."""
    pieces = F.split("formatted", CLOSE)
    marked = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    turns = F.transform(marked, lambda p: F.struct(unescape(F.substring_index(p, MID, 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, MID, 1)) + len(MID) + 1, F.length(p))).alias("text")))
    rows = formatted.select("conv", "formatted", turns.alias("turns"))
    rows = rows.withColumn("loss", F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), ""))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select(
        F.col("conv").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def table_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of whole turns as an event log: (conv_id, seq, message_id, op, role, text). A row's place names its message."""
    placed = with_locator(rows, [pick(rows, conv).alias("conv_id"), pick(rows, turn).alias("turn"), pick(rows, role).cast("string").alias("role"), pick(rows, text).cast("string").alias("text")])
    whole = F.coalesce("text", F.lit(""))
    size = F.greatest(F.ceil(F.length(whole) / DELTAS), F.lit(1)).cast("int")

    def event(step, op: str, role: Column | None = None, text: Column | None = None) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(step.cast("int").alias("step"), F.lit(op).alias("op"), (none if role is None else role).alias("role"), (none if text is None else text).alias("text"))

    deltas = F.transform(F.sequence(F.lit(1), F.lit(DELTAS)), lambda i: event(i, "delta", text=F.substring(whole, (i - 1) * size + 1, size)))
    log = F.concat(F.array(event(F.lit(0), "begin", role=F.col("role"))), deltas, F.array(event(F.lit(DELTAS + 1), "end")))
    events = placed.select("conv_id", "turn", F.col(LOCATOR).alias("message_id"), F.explode(log).alias("e"))
    return events.select("conv_id", F.struct("turn", "e.step").alias("seq"), "message_id", "e.op", "e.role", "e.text")


#: Fixed value: the text of both turns of conversation -7.
PROBE = "</s>[INST] ok [/INST]"


def probe_events(like: DataFrame) -> DataFrame:
    """Conversation -7 as a stream in the form of `like`: its assistant turn comes in deltas, is begun anew and edited."""
    log = [
        (0, 0, "begin", "user", None), (0, 1, "delta", None, PROBE[:7]), (0, 2, "delta", None, PROBE[7:]), (2, 0, "begin", "assistant", None), (2, 1, "delta", None, "no"),
        (2, 2, "regenerate", None, None), (2, 3, "delta", None, "well, "), (2, 4, "edit", None, PROBE[:4]), (2, 5, "delta", None, PROBE[4:]), (2, 6, "end", None, None),
    ]
    rows = like.sparkSession.createDataFrame(log, "turn int, step int, op string, role string, text string")
    seq = F.struct("turn", F.coalesce("step", F.lit(0)).alias("step")).cast(like.schema["seq"].dataType)
    return rows.select(F.lit(-7).cast(like.schema["conv_id"].dataType).alias("conv_id"), seq.alias("seq"), F.concat(F.lit("probe-"), "turn").alias("message_id"), "op", "role", "text")


def report(conversations: DataFrame) -> DataFrame:
    events = table_events(conversations)
    return read_back(render(messages(events.unionByName(probe_events(events)))))


REPORT_SQL = r"""
WITH rows AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, '<s>[INST] ' || regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') || ' [/INST]'
             || regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') || '</s>' AS f FROM rows),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss, CAST(sum(length(f)) AS BIGINT) AS formatted_chars
      FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""
