"""Chat formatting at the level of tokens.

A conversation is ``<s>`` and its turns in order; a turn is ``[INST]`` role ``[/INST]`` text
``</s>``. The four control strings are reserved ids past the vocabulary, spliced between
segments; role and text are encoded separately as ordinary text, so no text can produce a
reserved id. For the formatted string to be unambiguous as well, control strings inside
roles and texts are escaped by a backslash after their first character; one that is
escaped already gets one backslash more, so that unescaping takes exactly one away.

Positions come from running sums: a segment starts where the lengths before it end, and the
loss mask of a turn is the span of its text's tokens, for turns of the roles to learn.

Turns stay rows (``format_turns``): a conversation is never gathered into one value.
``read_back`` runs over the turns of each conversation in order and keeps only running
digests, so a conversation of any length needs no memory.

Nulls and ties. Null texts and roles are empty. Turns without a number come last; turns of
one number are ordered by role, then by MD5 of the text. A null conversation id is a
conversation of its own. Rows are never merged; further columns are ignored. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annspark.llm.bpe import Encoder, Vocabulary, load_spec

# The control strings of the template, in the order of their reserved ids.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, ROLE, ROLE_END = range(4)
LOSS_ROLES = ("assistant",)
_BARE = re.compile(r"(<|\[)(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"(<|\[)\\(\\*)(/?s>|/?INST\])")


def escape(text: str) -> str:
    return _BARE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


TURNS = ("conv_id long, turn long, role_rank string, tie string, ids array<int>, n_ids int, "
         "text_at int, text_ids int, learn boolean")


def format_turns(turns: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", loss_roles=LOSS_ROLES) -> DataFrame:
    """One row per turn: ``conv_id, turn_no, ids, start, loss_start, loss_end``.

    ``start`` is the position of the turn's first id in its conversation, whose position 0
    holds the id of ``<s>``; ``loss_start`` to ``loss_end`` are the positions under the loss
    mask (equal: none). Rows of a conversation are in one partition, in order."""
    spec = load_spec(tokenizer)
    shared = turns.sparkSession.sparkContext.broadcast(spec)
    learned = set(loss_roles)

    def encode(batches):
        vocabulary = Vocabulary(shared.value)
        encoder, base = Encoder(vocabulary, match_added=False), len(vocabulary.bytes)
        mark = [np.uint32(base + k).tobytes() for k in range(len(CONTROL))]
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            role_ids = encoder.encode_all([escape(r) for r in roles])
            text_ids = encoder.encode_all([escape(t) for t in texts])
            blobs, n, at, inner = [], [], [], []
            for r, t in zip(role_ids, text_ids):
                blobs.append(mark[ROLE] + r + mark[ROLE_END] + t + mark[END])
                n.append(len(blobs[-1]) // 4)
                at.append(len(r) // 4 + 2)
                inner.append(len(t) // 4)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), batch.column("tie"),
                 ids, pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(inner, pa.int32()),
                 pa.array([r in learned for r in roles], pa.bool_())],
                names=["conv_id", "turn", "role_rank", "tie", "ids", "n_ids", "text_at", "text_ids", "learn"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
                        F.col(role_col).alias("role"), F.col(text_col).alias("text")).mapInArrow(encode, TURNS)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role_rank", "tie")
    before = F.coalesce(F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before + 1  # <s> comes first
    return (rows.withColumn("turn_no", F.row_number().over(order)).withColumn("start", start)
            .withColumn("loss_start", F.col("start") + F.col("text_at"))
            .withColumn("loss_end", F.col("loss_start") + F.when(F.col("learn"), F.col("text_ids")).otherwise(0))
            .select("conv_id", "turn_no", "ids", "start", "loss_start", "loss_end"))


READ = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, n_ids long")


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Per conversation what its ids and mask say: number of turns, digest of role, newline,
    text, newline of each turn, characters and digest of the text under the loss mask,
    characters of the formatted string and number of ids."""
    shared = formatted.sparkSession.sparkContext.broadcast(load_spec(tokenizer))

    def read(batches):
        vocabulary = Vocabulary(shared.value)
        base = len(vocabulary.bytes)

        def text_of(ids):
            return b"".join(vocabulary.bytes[i] for i in ids).decode("utf-8", "replace")

        conv, state, out = None, None, []

        def close():
            out.append((conv, state["turns"], state["all"].hexdigest(), state["chars"],
                        state["loss"].hexdigest(), state["formatted"], state["at"]))

        for batch in batches:
            cols = {k: batch.column(k) for k in ("conv_id", "start", "loss_start", "loss_end", "ids")}
            for r in range(batch.num_rows):
                c = cols["conv_id"][r].as_py()
                if state is None or c != conv:
                    if state is not None:
                        close()
                    conv, state = c, {"turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(),
                                      "chars": 0, "formatted": len(CONTROL[BEGIN]), "at": 1}
                ids = cols["ids"][r].values.to_numpy().tolist()
                start = cols["start"][r].as_py()
                if start != state["at"]:
                    raise ValueError(f"conversation {c}: turn at {start}, expected {state['at']}")
                state["at"] += len(ids)
                middle = ids.index(base + ROLE_END)
                role, text = text_of(ids[1:middle]), text_of(ids[middle + 1:-1])
                state["turns"] += 1
                state["all"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                marks = sum(len(CONTROL[i - base]) for i in ids if i >= base)
                state["formatted"] += marks + len(role) + len(text)
                lo, hi = (cols[k][r].as_py() - start for k in ("loss_start", "loss_end"))
                masked = unescape(text_of(ids[lo:hi]))
                state["chars"] += len(masked)
                state["loss"].update(masked.encode())
            if out:
                yield _rows(out)
                out.clear()
        if state is not None:
            close()
            yield _rows(out)

    ordered = formatted.sortWithinPartitions("conv_id", "turn_no")
    return ordered.mapInArrow(read, READ)


def _rows(out) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in READ.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names=names)
