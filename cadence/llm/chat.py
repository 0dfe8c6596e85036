"""Chat formatting with a grammar round trip.

A turn is rendered as a role marker, its text and an end marker: ``[INST]`` opens a user's turn,
``[/INST]`` an assistant's, ``[ROLE name]`` any other (the name percent-encoded), ``</s>`` closes
each. A deterministic parser reads the rendered turn back; inside a text it accepts no control
string, and takes one backslash out of those that carry some. If the turn it recovers is not the
source, the text's control strings are escaped (one backslash more, after the first character)
and the turn is rendered and read again; after that both are identical, else it is an error. The loss covers assistants' texts.

Each turn is rendered by itself, so a conversation of any length is never gathered; its digests
are streamed over its turns in order. A digest is sequential, so one task reads a conversation's
turns, holding one Arrow batch of them at a time.

Defined cases: null text and null role are empty; turns go by ``turn``, then role, then text, null
turns first; repeated rows are turns of their own; a null conv_id is a conversation of its own;
a very long text is rendered and read back whole; further columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, map_arrow, table

OPENERS = {"user": "[INST]", "assistant": "[/INST]"}
END = "</s>"
LOSS_ROLE = "assistant"
#: A control string, perhaps with backslashes after its first character.
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|ROLE )")
_OPENER = re.compile(r"\[INST\]|\[/INST\]|\[ROLE ([^\]]*)\]")
_ROLES = {v: k for k, v in OPENERS.items()}


class Turn(NamedTuple):
    role: str
    text: str


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def opener(role: str) -> str:
    return OPENERS.get(role) or f"[ROLE {quote(role, safe='')}]"


def parse(line: str) -> list[Turn]:
    """The turns of a rendered stretch; GrammarError if it isn't one."""
    turns, at = [], 0
    while at < len(line):
        m = _OPENER.match(line, at)
        if not m:
            raise GrammarError(f"no role marker at {at}")
        body = m.end()
        while True:
            c = _CONTROL.search(line, body)
            if not c:
                raise GrammarError("no end marker")
            if not c[2]:
                break
            body = c.end()
        if c[0] != END:
            raise GrammarError(f"control string within a text at {c.start()}")
        turns.append(Turn(_ROLES.get(m[0]) or unquote(m[1]), unescape(line[m.end() : c.start()])))
        at = c.end()
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text starts and ends in it."""
    head = opener(role)
    for body in (text, escape(text)):
        line = head + body + END
        try:
            if parse(line) == [Turn(role, text)]:
                return line, len(head), len(head) + len(body)
        except GrammarError:
            continue
    raise GrammarError("this turn can't be rendered")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted, loss_start, loss_end (null outside the loss), a row a turn."""

    def run(batches):
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            made = [render(r, t) for r, t in zip(roles, texts)]
            spans = [(m[1], m[2]) if r == LOSS_ROLE else (None, None) for r, m in zip(roles, made)]
            yield batch(
                **{c: b.column(c) for c in ("conv_id", "turn", "role", "text")}, formatted=pa.array([m[0] for m in made], pa.string()),
                loss_start=pa.array([s[0] for s in spans], pa.int64()), loss_end=pa.array([s[1] for s in spans], pa.int64()),
            )

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return map_arrow(rows, run, "conv_id long, turn long, role string, text string, formatted string, loss_start long, loss_end long")


class _Digest:
    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.whole, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, line: str, start: int | None, end: int | None) -> None:
        for turn in parse(line):
            self.turns += 1
            self.whole.update(f"{turn.role}\n{turn.text}\n".encode())
        self.chars += len(line)
        if start is not None:
            said = unescape(line[start:end])
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.turns, self.whole.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """Each conversation's digests, read back from its formatted turns in order."""
    names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def rows(done):
        return batch(conv_id=pa.array([k for k, _ in done], pa.int64()), **{n: pa.array([d[i] for _, d in done], t) for i, (n, t) in enumerate(zip(names, kinds))})

    def run(batches):
        now, digest, done = None, None, []
        for b in batches:
            for conv, line, start, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if digest is None or conv != now:
                    if digest:
                        done.append((now, digest.row()))
                    now, digest = conv, _Digest()
                digest.add(line, start, end)
            if done:
                yield rows(done)
                done = []
        if digest:
            yield rows([(now, digest.row())])

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted", "loss_start", "loss_end")
    return map_arrow(ordered, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_OK = "</s>[INST] ok [/INST]"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.sql(f"SELECT -1L AS conv_id, CAST(t AS BIGINT) AS turn, IF(t = 0, 'user', 'assistant') AS role, '{_OK}' AS text FROM range(2) AS r(t)")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_turns(given.unionByName(probe)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, CASE role WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[/INST]' ELSE '[ROLE ' || url_encode(role) || ']' END
    || regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|ROLE )', '\1\\\2\3', 'g') || '</s>' AS line
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(length(line)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
