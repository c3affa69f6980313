"""BPE encoding and decoding by a tokenization automaton.

After Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA": the automaton starts with one state that loops on
every byte, and each merge (a, b) -> ab adds one gadget: arcs of `a` move to a new state, a copy of their old target without the arc
`b`, and every state with an arc `a` gets an arc `ab` to the target of `b`. Its paths are then exactly the tokenizations that the
merges make, so a word has one path, and so has each of its prefixes.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import sys

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table

#: White_Space, and the pattern that splits text before the merges.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def labels(spec: dict) -> dict[int, bytes]:
    """The bytes of each token."""
    letters = byte_letters()
    own = {i: bytes(letters[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    return own | {x["id"]: x["content"].encode() for x in spec["added_tokens"]}


def arc(ranks: dict[tuple[int, int], int], gadgets: tuple, spine: tuple) -> bool:
    """Whether a state that these gadgets made has an arc of the token of this spine: a gadget that took the arc `e` away denies every
    token that began with `e` as the arcs stood then."""
    for a, made in gadgets:
        for e, since, until in spine:
            time = ranks.get((a, e))
            if time is not None and time <= made and since < time <= until:
                return False
    return True


class Automaton:
    """The compiled merges. A state is what a gadget of token `owner` at time `made` left of the older state `base` of that token."""

    def __init__(self, spec: dict):
        model, added = spec["model"], spec["added_tokens"]
        self.label = labels(spec)  # what an arc emits
        self.added = {x["content"]: x["id"] for x in added}
        self.byte = [0] * 256
        for i, s in self.label.items():
            if len(s) == 1:
                self.byte[s[0]] = i
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = {}
        # state 0 loops on the bytes
        self.owner, self.made = [-1], [-1]
        self.target = dict.fromkeys(self.byte, 0)  # all arcs of a token lead to one state
        self.base = dict.fromkeys(self.byte, 0)  # that state as it was when the token was new
        self.ranks: dict[tuple[int, int], int] = {}
        for time, merge in enumerate(model["merges"]):
            a, b = (model["vocab"][x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            ab = model["vocab"]["".join(merge if isinstance(merge, list) else merge.split(" "))]
            if (a, b) in self.ranks or ab in self.born:
                continue
            self._gadget(time, a, b, ab)
        # which tokens end at each byte of a word
        self.ends = ahocorasick.Automaton()
        for i in self.target:
            self.ends.add_word(self.label[i].decode("latin-1"), (i, len(self.label[i])))
        self.ends.make_automaton()
        # of each token: what it began with, from when on, and until when, as the arcs of what it began with became its own
        self.spine: dict[int, tuple] = {}
        for token in self.target:
            own, at, until = [], token, sys.maxsize
            while at is not None:
                since = self.born.get(at, -1)
                own.append((at, since, until))
                at, until = self.left.get(at), since
            self.spine[token] = tuple(own)
        self.table: dict[int, bool] = {}  # whether a state has an arc of a token, of those that texts lead to most
        # of each state: the gadgets that made it, the last one first
        self.gadgets: list[tuple] = [()]
        for state in range(1, len(self.owner)):
            self.gadgets.append(((self.owner[state], self.made[state]), *self.gadgets[self.base[self.owner[state]]]))

    def _gadget(self, time: int, a: int, b: int, ab: int) -> None:
        self.ranks[a, b] = time
        self.left[ab], self.born[ab] = a, time
        self.target[ab] = self.base[ab] = self.target[b]  # as it is before the arcs of `a` move, for a may be b
        self.owner.append(a)
        self.made.append(time)
        self.target[a] = len(self.owner) - 1

    def word(self, text: bytes) -> list[int]:
        """Tokens of the word's one path, in one pass over the tables: each prefix has one path, so just one of the tokens that end there
        goes on from where it begins, and where its arc leads is the prefix's state."""
        target, label, gadgets, table = self.target, self.label, self.gadgets, self.table
        states, by = [0] * (len(text) + 1), [-1] * (len(text) + 1)  # of the prefix of each length: its state, and its last token
        done = 0
        for end, (token, size) in self.ends.iter(text.decode("latin-1")):
            if end < done:
                continue
            state = states[end + 1 - size]
            if gadgets[state]:
                has = table.get(state << 32 | token)
                if has is None:
                    has = arc(self.ranks, gadgets[state], self.spine[token])
                    if len(table) < ARCS:
                        table[state << 32 | token] = has
                if not has:
                    continue
            done = end + 1
            states[done], by[done] = target[token], token
        out, at = [], len(text)
        while at:
            out.append(by[at])
            at -= len(label[by[at]])
        return out[::-1]


#: What a Python worker has compiled: (automaton, ids of the words it has met), by the vocabulary's digest.
_COMPILED: dict[str, tuple[Automaton, dict[str, bytes]]] = {}
#: Words of up to 64 characters whose ids a worker keeps: the first that it meets, which the frequent ones are among.
CACHE = 600_000
#: Arcs that a worker keeps in its table; others are told from the gadgets each time.
ARCS = 300_000
#: Labels of tokens that a worker has read, by the vocabulary's digest.
_LABELS: dict[str, list[bytes]] = {}


def vocabulary(path: str) -> str:
    """The text of a tokenizer's file, read on the driver: tasks get it with the plan, so no executor needs the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def automaton(source: str) -> tuple[Automaton, dict[str, bytes]]:
    """Compiled once in a Python worker."""
    name = hashlib.sha256(source.encode()).hexdigest()
    if name not in _COMPILED:
        _COMPILED[name] = Automaton(json.loads(source)), {}
    return _COMPILED[name]


#: SPLIT for texts of ASCII and Latin-1 letters.
_FAST = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^{SPACE}A-Za-zÀ-ÖØ-öø-ÿ0-9]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def encoder(source: str):
    """A function from text to the bytes of its ids (little-endian, 32 bits)."""
    machine, words = automaton(source)
    split, fast = regex.compile(SPLIT).findall, re.compile(_FAST).findall
    other = re.compile("[^\x00-\x7fÀ-ÖØ-öø-ÿ]").search
    special = re.compile("(" + "|".join(map(re.escape, machine.added)) + ")") if machine.added else None
    get, word = words.get, machine.word
    four = struct.Struct("<I").pack

    def ids(text: str) -> bytes:
        pieces = special.split(text) if special and special.search(text) else (text,)
        out = []
        for i, piece in enumerate(pieces):
            if i % 2:
                out.append(four(machine.added[piece]))
                continue
            for w in split(piece) if other(piece) else fast(piece):
                packed = get(w)
                if packed is None:
                    packed = b"".join(map(four, word(w.encode("utf-8", "surrogatepass"))))
                    if len(words) < CACHE and len(w) < 64:
                        words[w] = packed
                out.append(packed)
        return b"".join(out)

    return ids


def decoder(source: str):
    """A function from the bytes of ids to text: the labels of the arcs, read as UTF-8."""
    name = hashlib.sha256(source.encode()).hexdigest()
    if name not in _LABELS:
        own = labels(json.loads(source))
        _LABELS[name] = [own.get(i, b"") for i in range(max(own) + 1)]
    of = _LABELS[name]

    def text(packed: bytes) -> str:
        return b"".join(map(of.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")

    return text


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Token ids of every whole text: doc_id, ids (little-endian unsigned 32-bit integers, binary). Null texts count as empty, and an
    empty text has no ids; strings of the vocabulary's added tokens become those tokens. Other columns don't matter."""
    small_batches(docs.sparkSession)
    source = vocabulary(path)

    def run(batches):
        ids = encoder(source)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ids(t.as_py() or "") for t in batch.column(1)], pa.binary())], names=["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Texts of what encode() returned: doc_id, ids, text. Bytes that are no UTF-8 become U+FFFD."""
    source = vocabulary(path)

    def run(batches):
        text = decoder(source)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([text(x.as_py()) for x in batch.column(1)], pa.string())], names=["doc_id", "ids", "text"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return decode(encode(table(spark, sf_dir, "documents"), path), path).selectExpr(
        "doc_id", "cast(octet_length(ids) DIV 4 AS bigint) AS n_tokens", "sha2(ids, 256) AS ids_sha256", "sha2(cast(text AS binary), 256) AS decoded_sha256"
    )


QUERIES = {"op3_bpe": op3_bpe}
ORACLE: dict[str, str] = {}
