"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context and only its
reply is trainable. A conversation that ends without a reply gives one more example with nothing to
train on, so that the formatted output holds every turn.

Template: ``<turn ROLE>\\n TEXT </turn>\\n`` (without the blanks). Inside roles and texts a backslash is
doubled and ``<turn`` and ``</turn`` get a backslash behind their ``<``; roles also hide ``>``. So no text
holds a control string, and ``\\X`` always reads back as ``X``.

Turns are escaped by column expressions, dealt by conversation and sorted there (Spark spills what
doesn't fit). A task holds one conversation's prefix, which is no longer than the longest example it has to give.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm.base import map_batches, query, table

CLOSE = "</turn>\n"
ASSISTANT = "assistant"
#: Characters of an output batch, one example more at most.
BATCH_CHARS = 1 << 22
EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escaped(text: Column) -> Column:
    """A text without control strings; ``unescaped`` gives it back."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, "<(?=/?turn)", r"<\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def segments(turns: DataFrame) -> DataFrame:
    """One row per turn: conversation, place, escaped opening and body, whether it is a reply."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit("<turn "), F.replace(escaped(role), F.lit(">"), F.lit("\\>")), F.lit(">\n"))
    return turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), head.alias("head"), escaped(text).alias("body"), (role == ASSISTANT).alias("reply")
    )


def rows_of(batches: Iterable[dict]) -> Iterator[tuple]:
    for columns in batches:
        yield from zip(*columns.values(), strict=True)


def in_batches(rows: Iterable[tuple], names: list[str]) -> Iterator[dict]:
    """Rows as column dictionaries of bounded size; the text is the third field."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[2])
        if chars >= BATCH_CHARS:
            yield dict(zip(names, map(list, zip(*held)), strict=True))
            held, chars = [], 0
    if held:
        yield dict(zip(names, map(list, zip(*held)), strict=True))


def expanded(turns: Iterable[tuple]) -> Iterator[tuple]:
    """Examples of turns that arrive by conversation and in order."""
    conv, prefix, n, open_end, begun = None, "", 0, False, False
    for now, head, body, reply in turns:
        if not begun or now != conv:
            if open_end:
                yield conv, n, prefix, None, None
            conv, prefix, n, begun = now, "", 0, True
        start = len(prefix) + len(head)
        prefix = "".join((prefix, head, body, CLOSE))
        open_end = not reply
        if reply:
            yield conv, n, prefix, start, start + len(body)
            n += 1
    if open_end:
        yield conv, n, prefix, None, None


def prefix_examples(turns: DataFrame) -> DataFrame:
    """One example per assistant turn: ``conv_id, example, text, loss_start, loss_end`` (code points).

    ``example`` counts from 0; outside ``[loss_start, loss_end)`` nothing is trainable. A conversation
    that ends without a reply gives one more example with a null mask. Turns come by ``turn`` (null first), then
    role and text; repeated rows are turns of their own. Null texts and roles count as empty, rows with a null
    ``conv_id`` are one conversation. An empty table gives an empty one; other columns are left behind. The
    rows of a conversation follow one another in one partition, in order.
    """
    dealt = segments(turns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = [c.split()[0] for c in EXAMPLES.split(", ")]
    return map_batches(
        dealt.select("conv_id", "head", "body", "reply"), lambda batches: in_batches(expanded(rows_of(batches)), names), EXAMPLES
    )


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn of an example, unescaped."""
    opening = re.compile(r"<turn ((?:[^\\>]|\\.)*)>\n", re.S)
    at = 0
    while at < len(text):
        head = opening.match(text, at)
        end = text.find(CLOSE, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        yield unescaped(head[1]), unescaped(text[head.end() : end])
        at = end + len(CLOSE)


def digested(examples: Iterable[tuple]) -> Iterator[tuple]:
    """Digests of examples that arrive by conversation and in order."""

    def done():
        turns, n = hashlib.sha256(), 0
        for role, said in read_turns(last):
            turns.update(f"{role}\n{said}\n".encode())
            n += 1
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted

    conv, last = None, None
    for now, _, text, start, end in examples:
        if last is None or now != conv:
            if last is not None:
                yield done()
            conv, loss, loss_chars, formatted = now, hashlib.sha256(), 0, 0
        if start is not None:
            said = unescaped(text[start:end])
            loss.update(said.encode())
            loss_chars += len(said)
        formatted += len(text)
        last = text  # the last example holds all turns
    if last is not None:
        yield done()


def conversation_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from the formatted texts and their masks.

    ``examples`` are those of ``prefix_examples``, in its order. ``formatted_chars`` sums up all examples.
    An empty table gives an empty one.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    return map_batches(examples, lambda batches: in_batches(digested(rows_of(batches)), names), DIGESTS)


MARKED = "\\### Assistant: </turn> ok"
# Every example is a prefix of the conversation, so running sums of the turns' lengths give all of them.
SQL = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{MARKED}' UNION ALL SELECT -7, 1, 'assistant', '{MARKED}'),
  e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn') AS body, replace(replace(replace(replace(role, '\', '\\'), '<turn', '<\turn'), '</turn', '<\/turn'), '>', '\>') AS head FROM t),
  s AS (SELECT *, sum(length(head) + length(body) + 16) OVER w AS upto, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS final FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(upto) FILTER (role = 'assistant' OR final) AS BIGINT) AS formatted_chars FROM s GROUP BY conv_id"""


@query("op11_chat_formatting", SQL)
def op11(spark, sf_dir):
    """All conversations and one full of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.createDataFrame([(-7, 0, "user", MARKED), (-7, 1, ASSISTANT, MARKED)], "conv_id long, turn long, role string, text string")
    return conversation_digests(prefix_examples(turns.unionByName(marked)))
