"""Chat formatting: conversations that begin alike are merged into prefix trees, and shared turns are written once, depth first.

A sequence holds the tokens of its tree's turns, each turn once, with position ids as if only a turn's ancestors stood before it and the
intervals of ancestors' tokens that a turn attends to; beside them the text and the same intervals in characters.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, small_batches, table
from .op3_bpe import encoder, vocabulary

#: The template's own marks: a turn is TURN role TEXT text END.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What begins a control string, of this template or another; a backslash is put after that sign, and backslashes are doubled.
CONTROL = r"<(?=[|]|/?s>)|\[(?=/?INST\])"
_ONE_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
SPAN = "struct<start:int,end:int>"
NODE = f"struct<start:int,end:int,parent:int,position:int,loss:{SPAN},attends:array<{SPAN}>,tokens:{SPAN},loss_tokens:{SPAN},attends_tokens:array<{SPAN}>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_NODE = pa.struct([
    ("start", pa.int32()), ("end", pa.int32()), ("parent", pa.int32()), ("position", pa.int32()), ("loss", _SPAN), ("attends", pa.list_(_SPAN)),
    ("tokens", _SPAN), ("loss_tokens", _SPAN), ("attends_tokens", pa.list_(_SPAN)),
])
_LEAVES = pa.list_(pa.struct([("key", pa.string()), ("node", pa.int32())]))


def escaped(text: Column) -> Column:
    """Null counts as empty. The result holds no control string and unescape() gives the text back."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL, "$0\\\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, key (a digest), turns (formatted, in order) of each conversation of rows(conv_id, turn, role, text).

    Rows stand by turn (null first), then role and text; repeated rows are repeated turns. Rows without conv_id are one conversation
    without id. A conversation's turns meet in one task, as they are one text to train on.
    """
    turn = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT), escaped(F.col("text")), F.lit(END))
    rows = rows.select("conv_id", F.struct("turn", turn.alias("s")).alias("t"))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t"))["s"].alias("turns"))
    return out.withColumn("key", F.sha2(F.array_join("turns", "").cast("binary"), 256))


def _and_parent(attends: list[dict], start: int, end: int) -> list[dict]:
    """The intervals that a node attends to with its parent's own, joined where they touch."""
    if attends and attends[-1]["end"] == start:
        return [*attends[:-1], {"start": attends[-1]["start"], "end": end}]
    return [*attends, {"start": start, "end": end}]


class _Tree:
    """The sequence that is being written: its text and tokens, its nodes, and the path to the last conversation."""

    def __init__(self, encode):
        self.encode = encode
        self.parts, self.size, self.nodes, self.leaves, self.path = [], 0, [], [], []
        self.ids, self.positions = [], []

    def new(self, turns: list[str]) -> int:
        """How many of the turns are not on the path yet."""
        shared = 0
        for (own, _), turn in zip(self.path, turns):
            if own != turn:
                break
            shared += 1
        return len(turns) - shared

    def add(self, key: str, turns: list[str]) -> None:
        fresh = self.new(turns)
        del self.path[len(turns) - fresh :]
        for turn in turns[len(turns) - fresh :]:
            parent = self.path[-1][1] if self.path else -1
            above = self.nodes[parent] if self.path else None
            start, end, first = self.size, self.size + len(turn), len(self.ids)
            position = self.positions[above["tokens"]["end"] - 1] + 1 if above else 0
            head = len(f"{TURN}assistant{TEXT}") if turn.startswith(f"{TURN}assistant{TEXT}") else 0
            at = [first]
            for part in (turn[:head], turn[head : -len(END)], END):  # each for itself, so that the loss begins and ends between two tokens
                self.ids += self.encode(part)
                at.append(len(self.ids))
            self.positions += range(position, position + len(self.ids) - first)
            self.nodes.append({
                "start": start, "end": end, "parent": parent, "position": position, "loss": {"start": start + head, "end": end - len(END)} if head else None,
                "attends": _and_parent(above["attends"], above["start"], above["end"]) if above else [],
                "tokens": {"start": first, "end": len(self.ids)}, "loss_tokens": {"start": at[1], "end": at[2]} if head else None,
                "attends_tokens": _and_parent(above["attends_tokens"], above["tokens"]["start"], above["tokens"]["end"]) if above else [],
            })
            self.path.append((turn, len(self.nodes) - 1))
            self.parts.append(turn)
            self.size = end
        self.leaves.append({"key": key, "node": self.path[-1][1]})


def prefix_trees(conversations: DataFrame, most: int = 65_536, path: str | None = None) -> DataFrame:
    """sequence_id, text, ids, positions, nodes, leaves: distinct conversations (key, turns) as depth-first walks over prefix trees.

    ids are the tokens of `text` by the byte-level vocabulary at `path`, turn by turn; positions holds each token's position id, which
    counts on from the end of its turn's parent, as if only its ancestors stood before it. A node is one turn: where it stands in `text`
    and (tokens) in ids, its parent node (-1: none), the position id of its first token, the span under the loss mask (the text of an
    assistant's turn) in characters and tokens, and the ancestor spans that it attends to besides its own before, in characters and
    tokens. A leaf names the node that ends a conversation. A sequence has at most `most` characters unless one conversation is longer;
    the next one repeats the ancestors it needs, so a tree of any size is spread over tasks: conversations are range-partitioned and
    sorted by the hashes of their turns, which puts those that begin alike side by side.
    """
    small_batches(conversations.sparkSession)
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    source = vocabulary(path)

    def walk(batches):
        packed = encoder(source)
        encode = lambda s: np.frombuffer(packed(s), "<u4").tolist()
        part, n, tree = TaskContext.get().partitionId(), 0, _Tree(encode)

        def written():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | n], pa.int64()), pa.array(["".join(tree.parts)]), pa.array([tree.ids], pa.list_(pa.int32())),
                    pa.array([tree.positions], pa.list_(pa.int32())), pa.array([tree.nodes], pa.list_(_NODE)), pa.array([tree.leaves], _LEAVES),
                ],
                names=["sequence_id", "text", "ids", "positions", "nodes", "leaves"],
            )

        for batch in batches:
            for key, turns in zip(batch.column(0).to_pylist(), batch.column(1)):
                turns = turns.as_py()
                if tree.leaves and tree.size + sum(map(len, turns[len(turns) - tree.new(turns) :])) > most:
                    yield written()
                    tree, n = _Tree(encode), n + 1
                tree.add(key, turns)
        if tree.leaves:
            yield written()

    ordered = conversations.select("key", "turns", F.transform("turns", lambda t: F.xxhash64(t)).alias("path"))
    ordered = ordered.repartitionByRange("path", "key").sortWithinPartitions("path", "key").select("key", "turns")
    return ordered.mapInArrow(walk, f"sequence_id long, text string, ids array<int>, positions array<int>, nodes array<{NODE}>, leaves array<struct<key:string,node:int>>")


def read_back(sequences: DataFrame) -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from what prefix_trees() wrote."""
    small_batches(sequences.sparkSession, 100)
    names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for batch in batches:
            rows = []
            for text, nodes, leaves in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for leaf in leaves:
                    path, at = [], leaf["node"]
                    while at >= 0:
                        path.append(nodes[at])
                        at = nodes[at]["parent"]
                    path.reverse()
                    whole = "".join(text[x["start"] : x["end"]] for x in path)
                    turns = [(unescape(r), unescape(t)) for r, t in _ONE_TURN.findall(whole)]
                    loss = "".join(unescape(text[x["loss"]["start"] : x["loss"]["end"]]) for x in path if x["loss"])
                    digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                    rows.append((leaf["key"], len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return sequences.select("text", "nodes", "leaves").mapInArrow(run, "key string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_chats(rows: DataFrame, most: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(conv_id, key) of every conversation, and the sequences in which its key is a leaf, both as written tables.

    Equal conversations share a leaf, so one of very many copies is written once. No rows give two empty tables.
    """
    all_ = keep(conversations_of(rows), "conversations")
    return all_.select("conv_id", "key"), keep(prefix_trees(all_.select("key", "turns").dropDuplicates(["key"]), most), "chat-sequences")


def op8_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    ids, sequences = format_chats(rows.union(more))
    return ids.join(read_back(sequences), "key").drop("key")


QUERIES = {"op8_chat_trees": op8_chat_trees}
ORACLE = {
    "op8_chat_trees": r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(role || text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]') AS x FROM r)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(x) + length('<|turn|><|text|><|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
}
