"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Successive prefixes of a conversation are
rendered; where a render continues the previous one, the difference is the turn's span, and where it does not, the
template rewrites history and the spans are located in the last render. A turn's text within its span is found by two
probes: the turn is rendered with two texts that differ in their one character, so the renders part exactly where the
text begins, and the rest behind it is the closing mark. The loss mask covers the texts of assistant turns. A black box must be called
with each whole prefix, so its work is quadratic in a conversation's turns; the renders are compared behind what is known
to be common only, and the built-in template keeps its short turns.

Defined results: rows go by turn (null turns first, ties by role and text); null text or role counts as empty;
repeated rows are repeated turns; a null ``conv_id`` is a conversation of its own; other columns are ignored; an empty
table gives no row. Conversations are streamed one at a time from sorted partitions, so a task holds one conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import stored, tidy

Turns = list[tuple[str, str]]

#: Marks of the built-in template.
OPEN, SEP, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|: |\n")
_TURN = re.compile(r"### ((?:[^\\]|\\.)*?): ((?:[^\\]|\\.)*?) </turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """Puts a backslash before each backslash and control string."""
    return re.sub(r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def escape_role(role: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _turn(role: str, text: str) -> str:
    return f"{OPEN}{escape_role(role)}{SEP}{escape(text)}{CLOSE}"


#: Short turns are escaped once for all prefixes that hold them; 16,384 of 2,000 characters are 33 million characters at most.
SHORT = 2000
_short_turn = lru_cache(1 << 14)(_turn)


def render(turns: Turns) -> str:
    """The built-in template: ``### role: text </turn>`` and a line end for each turn."""
    return "".join([_short_turn(r, t) if len(r) + len(t) <= SHORT else _turn(r, t) for r, t in turns])


def parse(formatted: str) -> Turns:
    """The turns back from the built-in template's output."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def common_prefix(a: str, b: str, known: str = "") -> int:
    """Length of the longest common prefix, by bisection on slices, behind ``known`` where both begin with it."""
    low, high = len(known) if a.startswith(known) and b.startswith(known) else 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def spans(turns: Turns, template: Callable[[Turns], str] = render) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(whole output, span of each turn, span of each turn's text, whether the template rewrites history)."""
    last, whole, text, rewrites = template([]), [], [], False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(last):
            rewrites = True
            break
        one, two = (template([*turns[:k], (role, c)]) for c in "ab")
        start = common_prefix(one, two, last)
        whole.append((len(last), len(now)))
        text.append((start, len(now) - (len(one) - start - 1)))
        last = now
    if not rewrites:
        return last, whole, text, False
    final, whole, text = template(turns), [], []
    for k, (role, _) in enumerate(turns):
        one, two = (template([*turns[:k], (role, c), *turns[k + 1 :]]) for c in "ab")
        start = common_prefix(one, two)
        end = len(final) - (len(one) - start - 1)
        if start >= len(one) or end < start or end > len(final):  # the template leaves this turn's text out
            start = end = min(start, len(final))
        text.append((start, end))
        whole.append((text[-2][1] if k else 0, end))
    return final, whole, text, True


def format_conversations(rows: DataFrame, template: Callable[[Turns], str] = render) -> DataFrame:
    """conv_id, formatted, loss (array of start, end in code points of assistant texts), rewrites."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, turns, out, size = None, [], [], 0

        def done() -> None:
            nonlocal size
            formatted, _, text, rewrites = spans(turns, template)
            loss = [list(s) for s, (r, _) in zip(text, turns, strict=True) if r == "assistant"]
            out.append((None if conv == "null" else int(conv), formatted, loss, rewrites))
            size += len(formatted)

        for pdf in batches:
            for key, c, role, text in zip(pdf["is_null"], pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
                c = "null" if key else c
                if conv is not None and c != conv:
                    done()
                    turns = []
                    if size > 1 << 22:
                        yield pd.DataFrame(out, columns=["conv_id", "formatted", "loss", "rewrites"]).astype({"conv_id": "Int64"})
                        out, size = [], 0
                conv = c
                turns.append((role, text))
        if conv is not None:
            done()
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "formatted", "loss", "rewrites"]).astype({"conv_id": "Int64"})

    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    dealt = dealt.select(F.col("conv_id").isNull().alias("is_null"), F.coalesce("conv_id", F.lit(0)).alias("conv_id"), "role", "text")
    return dealt.mapInPandas(tidy(task), "conv_id long, formatted string, loss array<array<long>>, rewrites boolean")


#: A conversation whose texts are made of the template's own marks.
HARD = "\\### Assistant: </turn> ok"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", HARD), (-7, 1, "assistant", HARD)], rows.schema)
    written = stored(format_conversations(rows.unionByName(extra)), "chat")

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for conv, formatted, loss in zip(pdf["conv_id"], pdf["formatted"], pdf["loss"], strict=True):
                turns = parse(formatted)
                told = "".join(unescape(formatted[s:e]) for s, e in loss)
                out.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(told), hashlib.sha256(told.encode()).hexdigest(), len(formatted)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})

    return written.mapInPandas(tidy(digests), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS esc,
  replace(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ': ', '\: '), chr(10), '\' || chr(10)) AS esc_role FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(esc) + length(esc_role) + 15) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
