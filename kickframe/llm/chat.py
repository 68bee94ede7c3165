"""Chat formatting with offset-aligned masks: render, encode once with offsets, intersect turn spans with token spans."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kickframe.llm.common import col, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, CLOSE = "### ", "</turn>"
LEARNT = "assistant"
#: Code points of rendered turns that are encoded together; a longer conversation goes on in the next part, cut between turns.
PART = 200_000


#: White space as the tokenizer's pattern sees it, as the inside of a character class.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ESCAPED = re.compile(rf"\A(?=[{SPACE}])|\\|###|</turn>")
UNESCAPED = re.compile(rf"\A\\(?=[{SPACE}])|\\(\\|###|</turn>)")


def escape(text: str) -> str:
    """Control strings, backslashes and white space at the start of a text get a backslash before them.

    White space there would merge with the line end of the header into one token; white space at the end never takes in
    the line end before the end mark, as the tokenizer splits a run of it before its last character.
    """
    return ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPED.sub(lambda m: m[1] or "", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its escaped text begins and ends in it: "### role:" on its line, the text, "</turn>" on a line.

    Line ends in a role are escaped too, so that a header is one line. A turn begins behind a line end and with a sign
    that is no white space, where the tokenizer always splits: turns encoded apart have the tokens of the whole.
    """
    head = f"{OPEN}{escape(role).replace(chr(10), chr(92) + 'n')}:\n"
    body = escape(text)
    return f"{head}{body}\n{CLOSE}\n", len(head), len(head) + len(body)


HEADER = re.compile(r"### ((?:[^\\\n]|\\.)*):\n", re.S)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation. No escaped text holds a bare control string."""
    turns, at = [], 0
    while at < len(formatted):
        head = HEADER.match(formatted, at)
        if not head:
            raise ValueError("no turn begins here")
        end = at = head.end()
        while True:  # the first bare end mark: an even number of backslashes before it
            end = formatted.index("\n" + CLOSE + "\n", end)
            back = end
            while back > at and formatted[back - 1] == "\\":
                back -= 1
            if (end - back) % 2 == 0:
                break
            end += 1
        role = re.sub(r"\\(n|\\|###|</turn>)", lambda m: "\n" if m[1] == "n" else m[1], head[1])
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(CLOSE) + 2
    return turns


def overlaps(spans: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token number, clipped token span) of every token that meets a span. Both inputs are sorted; spans don't overlap.

    For each span the first token that ends behind its start and the last that starts before its end are found by binary search.
    """
    first = np.searchsorted(tokens[:, 1], spans[:, 0], side="right")
    last = np.searchsorted(tokens[:, 0], spans[:, 1], side="left")
    count = np.maximum(last - first, 0)
    number = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    span = np.repeat(np.arange(len(spans)), count)
    clipped = np.column_stack([np.maximum(tokens[number, 0], spans[span, 0]), np.minimum(tokens[number, 1], spans[span, 1])])
    return number, np.column_stack([span, clipped])


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # their strings in a text are ordinary text
    return made


@dataclass
class Part:
    """A run of whole turns of one conversation, formatted and encoded."""

    text: str
    ids: list[int]
    mask: np.ndarray
    loss: list[str]


def format_part(turns: list[tuple[str, str]], path: str = TOKENIZER, learnt: str = LEARNT) -> Part:
    """Render turns, encode them once and mask: a token counts for the loss if it meets the text of a turn of ``learnt``.

    ``loss`` has the unescaped text of the masked tokens for each such turn, whole tokens: one that covered template text as well
    would be an error.
    """
    parts, spans, at = [], [], 0
    for role, text in turns:
        out, a, b = render(role, text)
        if role == learnt:
            spans.append((at + a, at + b))
        parts.append(out)
        at += len(out)
    whole = "".join(parts)
    coded = tokenizer_of(path).encode(whole, add_special_tokens=False)
    # several tokens may stand for one character; starts and ends never fall, which is all the search needs
    tokens = np.fromiter(chain.from_iterable(coded.offsets), np.int64, 2 * len(coded)).reshape(-1, 2)
    tokens = np.maximum.accumulate(tokens, axis=0) if len(tokens) else tokens
    mask, loss = np.zeros(len(tokens), bool), []
    if spans:
        number, hit = overlaps(np.array(spans), tokens)
        if (hit[:, 1:] != tokens[number]).any():
            raise ValueError("a token crosses the border of a learnt text")
        mask[number] = True
        span, met = hit[:, 0], tokens[number]
        if ((span[1:] == span[:-1]) & (met[1:, 0] > met[:-1, 1])).any():
            raise ValueError("tokens of a learnt text leave a gap")
        # without gaps the tokens of a span stand for all from the first one's start to the last one's end
        first, last = np.searchsorted(span, np.arange(len(spans))), np.searchsorted(span, np.arange(len(spans)), side="right") - 1
        loss = [unescape(whole[met[i, 0] : met[j, 1]]) if i <= j else "" for i, j in zip(first.tolist(), last.tolist(), strict=True)]
    return Part(whole, coded.ids, mask, loss)


@dataclass
class Running:
    """What is known of a conversation after some of its parts."""

    conv_id: object
    n_turns: int = 0
    loss_chars: int = 0
    formatted_chars: int = 0
    n_tokens: int = 0
    loss_tokens: int = 0
    turns: object = field(default_factory=hashlib.sha256)
    loss: object = field(default_factory=hashlib.sha256)

    def add(self, part: Part) -> None:
        for role, text in parse(part.text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        for text in part.loss:
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.formatted_chars += len(part.text)
        self.n_tokens += len(part.ids)
        self.loss_tokens += int(part.mask.sum())


def dealt_turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns of a conversation side by side in order; rows that share a turn number are ordered by role and text, nulls first."""
    rows = df.select(col(conv).alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text).cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def conversations(batches: Iterator[pa.RecordBatch], most: int = PART) -> Iterator[tuple[object, bool, list[tuple[str, str]]]]:
    """(conv_id, last part or not, turns): runs of turns of up to ``most`` code points, so that a conversation of any length streams through."""
    conv, held, size, begun = None, [], 0, False
    for batch in batches:
        ids, roles, texts = (batch.column(k) for k in (0, 2, 3))
        for i, c in enumerate(ids.to_pylist()):
            role, text = roles[i].as_py(), texts[i].as_py()
            if begun and c != conv:
                yield conv, True, held
                held, size = [], 0
            elif held and size + len(text) > most:
                yield conv, False, held
                held, size = [], 0
            conv, begun = c, True
            held.append((role, text))
            size += len(text) + len(role)
    if begun:
        yield conv, True, held


def formatted(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER, learnt: str = LEARNT) -> DataFrame:
    """(conv_id, part, text, token_ids, loss_mask): formatted conversations, long ones in several parts of whole turns."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part = None, 0
        for c, end, turns in conversations(batches):
            made = format_part(turns, tokenizer, learnt)
            part = part if c == last and part else 0
            yield pa.RecordBatch.from_arrays([pa.array([c], kind), pa.array([part], pa.int32()), pa.array([made.text]), pa.array([made.ids], pa.list_(pa.int32())), pa.array([made.mask.tolist()], pa.list_(pa.bool_()))], ["conv_id", "part", "text", "token_ids", "loss_mask"])
            last, part = c, 0 if end else part + 1

    kind = _arrow(df, conv)
    name = df.schema[conv].dataType.simpleString()
    return dealt_turns(df, conv, turn, role, text).mapInArrow(work, f"conv_id {name}, part int, text string, token_ids array<int>, loss_mask array<boolean>")


def summary(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokenizer: str = TOKENIZER, learnt: str = LEARNT) -> DataFrame:
    """One row per conversation, read back from its formatted text and mask.

    Null ids form one conversation, null roles and texts count as empty, a repeated row is a turn of its own; an empty table
    gives no rows. A conversation streams through its task in parts, so that its length costs no memory.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running, done = None, []
        for c, end, turns in conversations(batches):
            running = running or Running(c)
            running.add(format_part(turns, tokenizer, learnt))
            if end:
                done.append(running)
                running = None
            if len(done) >= 1000:
                yield _rows(done, kind)
                done = []
        if done:
            yield _rows(done, kind)

    kind = _arrow(df, conv)
    name = df.schema[conv].dataType.simpleString()
    return dealt_turns(df, conv, turn, role, text).mapInArrow(work, f"conv_id {name}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")


def _arrow(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def _rows(done: list[Running], kind: pa.DataType) -> pa.RecordBatch:
    cols = {
        "conv_id": pa.array([r.conv_id for r in done], kind), "n_turns": pa.array([r.n_turns for r in done]),
        "turns_sha256": pa.array([r.turns.hexdigest() for r in done]), "loss_chars": pa.array([r.loss_chars for r in done]),
        "loss_sha256": pa.array([r.loss.hexdigest() for r in done]), "formatted_chars": pa.array([r.formatted_chars for r in done]),
        "n_tokens": pa.array([r.n_tokens for r in done]), "loss_tokens": pa.array([r.loss_tokens for r in done]),
    }
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


#: A conversation whose texts look like the template itself.
HARD = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], "conv_id long, turn long, role string, text string")
    return summary(rows.unionByName(hard)).drop("n_tokens", "loss_tokens")


SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(15 + length(regexp_replace(replace(role, chr(10), 'nn'), '(\\|###|</turn>)', '\\\1', 'g'))
    + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) + CAST(regexp_matches(text, '^[{SPACE}]') AS INT)) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""
