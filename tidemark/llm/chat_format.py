"""Chat formatting by a grammar round trip, with DataFrame functions only.

The turns of a conversation are rendered by a template; the rendered text is parsed again by a deterministic
grammar; the recovered turns are compared with the source. Level 0 renders the texts as they are.
Where that does not give the source back, level 1 escapes the texts that conflict (those that do not come
back when rendered alone), level 2 all of them. A conversation that still differs fails the query.

Template: a user's turn is ``<s>[INST] text [/INST]``, an assistant's ``<s> text </s>``, the system's
``<<SYS>>text<</SYS>>``, any other role's ``<s>[ROLE] role[:]text [/ROLE]``. Escaping writes U+241B and a digit for
each control string and for U+241B itself; the parser undoes it. Texts are read with ``texts`` (array of
segments with a loss flag): the segments joined are the formatted text, the flagged ones are each
assistant's text.

Defined results: a null text is empty, a null role is the empty role; turns are ordered by turn, role and text, so
ties and repeated rows (kept) have one order; a null conv_id is one conversation. Empty tables give
an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"
#: The control strings of the template; the escape of each is its place, from 1.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[:]")
#: Role, opening and closing string.
KINDS = (("user", "<s>[INST] ", " [/INST]"), ("assistant", "<s> ", " </s>"), ("system", "<<SYS>>", "<</SYS>>"))
OTHER = ("<s>[ROLE] ", "[:]", " [/ROLE]")
TURN = "|".join(
    [r"<s>\[INST\] .*? \[/INST\]", r"<s> .*? </s>", r"<<SYS>>.*?<</SYS>>", r"<s>\[ROLE\] .*?\[:\].*? \[/ROLE\]"],
)


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for k, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(control), F.lit(f"{ESCAPE}{k}"))
    return text


def unescaped(text: Column) -> Column:
    for k, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(f"{ESCAPE}{k}"), F.lit(control))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def segments(role: Column, text: Column, safe: Column) -> Column:
    """Opening, text and closing of a turn, with the flag of the loss mask; ``safe`` tells whether to escape."""
    body = F.when(safe, escaped(text)).otherwise(text)

    def three(first: Column, last: str, loss: bool) -> Column:
        return F.array(*(F.struct(x.alias("text"), F.lit(y).alias("loss")) for x, y in ((first, False), (body, loss), (F.lit(last), False))))

    # the name of another role is always escaped
    found = three(F.concat(F.lit(OTHER[0]), escaped(role), F.lit(OTHER[1])), OTHER[2], False)
    for name, first, last in KINDS:
        found = F.when(role == name, three(F.lit(first), last, name == "assistant")).otherwise(found)
    return found


def joined(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda s: s["text"]), "")


def parsed(text: Column) -> Column:
    """The turns (role, text) of a formatted text; null where the grammar does not cover all of it."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){TURN}"), F.lit(0))

    def inner(piece: Column, first: Column | int, last: int) -> Column:
        return unescaped(F.substring(piece, first + 1, F.length(piece) - first - last))

    def turn(piece: Column) -> Column:
        head = F.instr(piece, OTHER[1])
        role = unescaped(F.substring(piece, F.lit(len(OTHER[0]) + 1), head - 1 - len(OTHER[0])))
        found = F.struct(role.alias("role"), inner(piece, head - 1 + len(OTHER[1]), len(OTHER[2])).alias("text"))
        for name, first, last in KINDS:
            found = F.when(piece.startswith(first), F.struct(F.lit(name).alias("role"), inner(piece, F.lit(len(first)), len(last)).alias("text"))).otherwise(found)
        return found

    covered = F.aggregate(pieces, F.lit(0), lambda n, piece: n + F.length(piece)) == F.length(text)
    return F.when(covered, F.transform(pieces, turn))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, level, segments (text, loss), turns (role, text; parsed from the formatted text)."""
    clean = rows.select("conv_id", F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = clean.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    source = whole.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))

    def rendered(safe) -> Column:
        return F.flatten(F.transform("source", lambda t: segments(t["role"], t["text"], safe(t))))

    def conflicts(t: Column) -> Column:
        alone = parsed(joined(segments(t["role"], t["text"], F.lit(False))))
        return ~F.coalesce(alone == F.array(F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))

    found = source.withColumn("segments_0", rendered(lambda t: F.lit(False))).withColumn("turns_0", parsed(joined(F.col("segments_0"))))
    for level, safe in ((1, conflicts), (2, lambda t: F.lit(True))):
        differs = ~F.coalesce(F.col(f"turns_{level - 1}") == F.col("source"), F.lit(False))
        found = found.withColumn(f"segments_{level}", F.when(differs, rendered(safe)).otherwise(F.col(f"segments_{level - 1}")))
        found = found.withColumn(f"turns_{level}", F.when(differs, parsed(joined(F.col(f"segments_{level}")))).otherwise(F.col(f"turns_{level - 1}")))
    same = lambda k: F.coalesce(F.col(f"turns_{k}") == F.col("source"), F.lit(False))
    level = F.when(same(0), 0).when(same(1), 1).when(same(2), 2).otherwise(F.raise_error(F.lit("a conversation does not come back from its formatted text")).cast("int"))
    return found.select("conv_id", joined(F.col("segments_2")).alias("formatted"), level.alias("level"), F.col("segments_2").alias("segments"), F.col("turns_2").alias("turns"))


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: sizes and digests of what is read back from the formatted text.

    The text under the loss mask comes from the flagged segments, unescaped.
    """
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return formatted.withColumn("loss_text", loss).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), F.col("level").alias("escape_level"),
    )


#: DuckDB SQL for digest(format_conversations(conversations and conversation -1)).
ORACLE = """
WITH src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
      '␛', '␛0'), '[INST]', '␛1'), '[/INST]', '␛2'), '<s>', '␛3'), '</s>', '␛4'), '<<SYS>>', '␛5'), '<</SYS>>', '␛6'), '[ROLE]', '␛7'), '[/ROLE]', '␛8'), '[:]', '␛9') AS safe,
    regexp_matches(text, '␛[0-9]') OR CASE role WHEN 'user' THEN contains(text, ' [/INST]') WHEN 'assistant' THEN contains(text, ' </s>')
      WHEN 'system' THEN contains(text, '<</SYS>>') ELSE contains(text, ' [/ROLE]') END AS bad
  FROM src),
seg AS (
  SELECT *, CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 9 WHEN 'system' THEN 15 ELSE 21 + length(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(role,
      '␛', '␛0'), '[INST]', '␛1'), '[/INST]', '␛2'), '<s>', '␛3'), '</s>', '␛4'), '<<SYS>>', '␛5'), '<</SYS>>', '␛6'), '[ROLE]', '␛7'), '[/ROLE]', '␛8'), '[:]', '␛9')) END
    + length(CASE WHEN bad THEN safe ELSE text END) AS chars
  FROM esc)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, max(bad::INT) AS escape_level
FROM seg GROUP BY conv_id
"""
