r"""Chat formatting from an event log, natively in Spark.

`reconstruct` folds a log into final messages: events are partitioned by conversation and message and sorted by sequence.
`start` opens a message with a role, `delta` appends streamed text, `edit` puts a new text in place of what came before, and
`regenerate` drops it so that the deltas after it make up the message. `render` writes each conversation with a template and
a loss mask, `read_back` parses such output again.

The template is `### role:\n` text `</turn>\n` for each turn. Inside roles and texts, `\` becomes `\\`, `</turn>` becomes
`<\/turn>`, every `##` becomes `#\#`, and in a role a newline after a colon is escaped, so that neither `###` nor `</turn>` can occur
inside an escaped text, however long a run of `#` is; dropping the backslash before any character undoes all of this.

Defined results: null texts and roles count as empty; a null conversation id is one conversation; rows with the same turn
keep all their messages, ordered by role and text; an empty log gives no conversations; other columns aren't read.
A message folds in its own group; a conversation's digest needs its messages together, so only they meet in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TURN_END = "</turn>\n"
LEARNED_ROLE = "assistant"
#: The conversation that the query adds to the table: control strings inside texts.
PROBE_ID = -7
PROBE_TEXT = r"\### Assistant: </turn> ok"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("##"), F.lit("#\\#"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) from a log (conv_id, message, seq, kind, role, text); the last start's role holds."""
    event = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    opened = F.filter("log", lambda e: e["kind"] == "start")
    reset = F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin("start", "edit", "regenerate"), i + 1))), F.lit(1)))
    kept = F.slice("log", reset, F.size("log"))
    text = F.array_join(F.transform(kept, lambda e: F.when(e["kind"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    return folded.select("conv_id", "message", F.coalesce(F.try_element_at(opened, F.lit(-1))["role"], F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the spans [start, end) of learned text in code points of `formatted`."""
    role = F.replace(escape(F.col("role")), F.lit(":\n"), F.lit(":\\\n"))
    head = F.concat(F.lit("### "), role, F.lit(":\n"))
    body = escape(F.col("text"))
    turn = messages.select("conv_id", "message", head.alias("head"), body.alias("body"), (F.col("role") == LEARNED_ROLE).alias("learned"))
    size = F.length("head") + F.length("body") + len(TURN_END)
    earlier = Window.partitionBy("conv_id").orderBy("message", "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(earlier), F.lit(0)) + F.length("head")
    placed = turn.select("*", begin.cast("int").alias("start"))
    piece = F.struct("message", "head", "body", "start", "learned")
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(TURN_END))), "")
    spans = F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["body"])).alias("end")))
    return whole.select("conv_id", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns as array<struct<role, text>> parsed from the output alone."""
    pieces = F.filter(F.split("formatted", r"</turn>\n"), lambda p: p != "")
    cut = rendered.select("*", pieces.alias("pieces"))

    def parse(p: Column) -> Column:
        at = F.locate(":\n", p)
        return F.struct(
            unescape(F.substring(p, F.lit(5), at - 5)).alias("role"),
            unescape(F.substring(p, at + 2, F.length(p))).alias("text"),
        )

    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return cut.select("conv_id", F.transform("pieces", parse).alias("turns"), F.array_join(masked, "").alias("loss_text"), "formatted")


def as_events(conversations: DataFrame) -> DataFrame:
    """A log for a table (conv_id, turn, role, text): each row starts a message and streams its text in two deltas.

    Of three messages of a conversation one is streamed as it is, one is a draft (its text backwards) that is dropped and generated again,
    and one gets its text by an edit of its first half.
    """
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select("conv_id", F.row_number().over(order).alias("message"), "role", text.alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda seq, kind, role, text: F.struct(F.lit(seq).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    first, rest = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    opened = event(0, "start", F.col("role"), F.lit(""))
    streamed = F.array(opened, event(1, "delta", none, first), event(2, "delta", none, rest))
    again = F.array(opened, event(1, "delta", none, F.reverse("text")), event(2, "regenerate", none, none), event(3, "delta", none, first), event(4, "delta", none, rest))
    edited = F.array(opened, event(1, "delta", none, first), event(2, "edit", none, F.col("text")))
    kind = F.col("message") % 3
    log = F.when(kind == 1, streamed).when(kind == 2, again).otherwise(edited)
    return rows.select("conv_id", "message", F.inline(log))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests read back from the formatted output of all conversations and the probe."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    back = read_back(render(reconstruct(as_events(table.unionByName(probe)))))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) p(conv_id, turn, role, text)),
escaped AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#'), ':' || chr(10), ':\' || chr(10)) AS safe_role,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#') AS safe_text FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(safe_role) + length(safe_text) + 14)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""
