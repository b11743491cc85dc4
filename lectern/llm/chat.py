"""Conversations as training windows of a token budget, aligned to turns.

Prefix sums of turn tokens place every turn: a conversation's token axis is cut into cells of equal
length, turns that lie in one cell form a window, and a turn that reaches over its cell's end is a
window of its own. This needs no walk from window to window, so a conversation of any length spreads
over many tasks. A window starts with the conversation's first system turn and as much recent history
as the budget leaves, both marked as context; its own turns are targets. Each turn is a target once;
the loss covers the texts of assistant targets only.

Template, with control strings inside roles and texts broken up by a backslash:

    <|turn|>role<|text|>text<|end|>          a target
    <|context|>role<|text|>text<|end|>       repeated context, never under the loss
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.columns import Batches, arrow_map
from lectern.operators.running import running_total
from lectern.session import pin

TURN, CONTEXT, TEXT, END = "<|turn|>", "<|context|>", "<|text|>", "<|end|>"
# Strings that chat templates in use treat as control.
CONTROL = re.compile(r"\\|[<\[](?=\||/?s>|/?INST\]|</?SYS>>|/?(?:bos|eos|pad|unk|start_of_turn|end_of_turn)>)")
MARKED = re.compile(r"<\|(turn|context)\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
TURN_OVERHEAD = 4


def escape(text: str) -> str:
    """``text`` without any whole control string: a backslash goes in after its first character."""
    return CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"\\\\|([<\[])\\", lambda m: m[1] or "\\", text)


def format_turns(turns: Iterable[tuple[bool, str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of (is target, role, text) turns, and the code point spans under the loss."""
    out, at, loss = [], 0, []
    for target, role, text in turns:
        head = f"{TURN if target else CONTEXT}{escape(role)}{TEXT}"
        body = escape(text)
        if target and role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, END)
        at += len(head) + len(body) + len(END)
    return "".join(out), loss


def read_turns(formatted: str) -> list[tuple[bool, str, str]]:
    """The inverse of ``format_turns``."""
    return [(m[1] == "turn", unescape(m[2]), unescape(m[3])) for m in MARKED.finditer(formatted)]


def format_conversations(
    rows: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    budget: int = 2048,
    history: int = 512,
) -> DataFrame:
    """Windows: ``conv_id``, ``first_token`` (their order), ``formatted``, ``loss`` spans, ``n_tokens``.

    Tokens are words and single other signs, plus a fixed number per turn. Turns are never cut: a turn
    over the budget is a window over the budget. Turns go by ``turn`` (null first), ties by role, then
    by a digest of the text; repeated rows are repeated turns. Null roles and texts count as empty. Rows
    with null ``conv_id`` form one conversation of their own. No rows give no windows.
    """
    turns = rows.select(
        rows[conv_id].isNull().alias("no_id"),
        F.coalesce(rows[conv_id], F.lit(0)).alias("conv"),
        F.coalesce(rows[role], F.lit("")).alias("role"),
        F.coalesce(rows[text], F.lit("")).alias("text"),
        rows[turn].alias("turn"),
    )
    turns = turns.select(
        "*",
        F.struct("turn", "role", F.md5("text")).alias("place"),
        (F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")) + TURN_OVERHEAD).cast("long").alias("tokens"),
    )
    key = ["no_id", "conv"]
    turns = pin(running_total(turns, key, "place", F.col("tokens"), "end").drop("place", "turn"))
    turns = turns.withColumn("start", F.col("end") - F.col("tokens"))
    system = pin(
        turns.where("role = 'system'")
        .groupBy(*key)
        .agg(F.min_by(F.struct("start", "tokens", "text"), "start").alias("system"))
    )
    room = F.greatest(F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0)), F.lit(1))
    placed = (
        turns.join(system.select(*key, F.struct("system.tokens").alias("system")), key, "left")
        .withColumn("room", room)
        .withColumn("cell", F.floor(F.col("start") / F.col("room")))
        .withColumn("over", F.col("end") > (F.col("cell") + 1) * F.col("room"))
        .drop("system")
    )
    windows = placed.groupBy(*key, "cell", "over").agg(
        F.min("start").alias("first_token"), F.sum("tokens").alias("n_target"), F.first("room").alias("room")
    )
    # A window's history lies at most `room` before it, hence in its own or the previous cell.
    near = placed.select(
        *key, "role", "text", "tokens", "start", "end", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell")
    )
    spare = F.least(F.lit(history), F.col("room"), F.greatest(F.lit(budget - history) + history - F.col("n_target"), F.lit(0)))
    before = (
        near.join(windows, [*key, "cell"])
        .where((F.col("end") <= F.col("first_token")) & (F.col("start") >= F.col("first_token") - spare))
        .select(*key, "first_token", F.struct(F.lit(1).alias("part"), "start", "role", "text", "tokens").alias("turn"))
    )
    own = placed.join(windows.drop("room"), [*key, "cell", "over"]).select(
        *key, "first_token", F.struct(F.lit(2).alias("part"), "start", "role", "text", "tokens").alias("turn")
    )
    # Bounded by the budget: every turn counts at least its overhead.
    gathered = own.unionByName(before).groupBy(*key, "first_token").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    with_system = gathered.join(system, key, "left").select(
        *key, "first_token", "turns", F.col("system.start").alias("system_start"),
        F.col("system.text").alias("system_text"), F.col("system.tokens").alias("system_tokens"),
    )

    def write(batches: Batches) -> Iterable[dict]:
        for batch in batches:
            for r in batch.to_pylist():
                parts = [(t["part"] == 2, t["role"], t["text"]) for t in r["turns"]]
                tokens = sum(t["tokens"] for t in r["turns"])
                if r["system_start"] is not None and all(t["start"] != r["system_start"] for t in r["turns"]):
                    if r["system_start"] < r["first_token"]:
                        parts.insert(0, (False, "system", r["system_text"]))
                        tokens += r["system_tokens"]
                formatted, loss = format_turns(parts)
                yield {
                    "conv_id": [None if r["no_id"] else r["conv"]],
                    "first_token": [r["first_token"]],
                    "formatted": [formatted],
                    "loss": [[{"start": s, "end": e} for s, e in loss]],
                    "n_tokens": [tokens],
                }

    id_type = rows.schema[conv_id].dataType.simpleString()
    schema = f"conv_id {id_type}, first_token bigint, formatted string, "
    return arrow_map(with_system, write, schema + "loss array<struct<`start`: bigint, `end`: bigint>>, n_tokens bigint")


def digest_windows(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: turns, loss and length, with digests.

    A digest runs over a conversation in order, so its windows pass through one task; they stream, and
    only the running digests stay in memory.
    """
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "first_token")

    def read(batches: Batches) -> Iterable[dict]:
        state = None

        def result() -> dict:
            conv, n, turns, chars, loss, formatted, n_windows = state
            return {
                "conv_id": [conv], "n_turns": [n], "turns_sha256": [turns.hexdigest()], "loss_chars": [chars],
                "loss_sha256": [loss.hexdigest()], "formatted_chars": [formatted], "n_windows": [n_windows],
            }

        for batch in batches:
            for r in batch.to_pylist():
                if state is None or state[0] != r["conv_id"]:
                    if state is not None:
                        yield result()
                    state = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for target, role, text in read_turns(r["formatted"]):
                    if target:
                        state[1] += 1
                        state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for span in r["loss"]:
                    text = unescape(r["formatted"][span["start"] : span["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode("utf-8", "surrogatepass"))
                state[5] += len(r["formatted"])
                state[6] += 1
        if state is not None:
            yield result()

    id_type = windows.schema["conv_id"].dataType.simpleString()
    return arrow_map(
        ordered,
        read,
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, n_windows bigint",
    )
