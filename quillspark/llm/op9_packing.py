"""Best-fit packing: few-document length patterns fitted to the histogram by non-negative least squares, residuals by best fit.

After Krell et al., "Efficient Sequence Packing without Cross-contamination". All planning is done on the histogram of lengths, which
has at most `size` entries however many documents there are; documents then look their places up by their rank within their length.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, small_batches, table
from .op3_bpe import vocabulary

SIZE, END_ID = 4096, 1
#: What the vocabulary does before its merges. Only a vocabulary that does just this is looked up by words.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT, _SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+", "</w>"
#: The same for bytes of Latin-1: letters in lower case, words of them (as most begin with a letter, that is tried first), and the bytes
#: whose kind is the same in both. Texts with other characters, or with what the vocabulary adds, go through the tokenizer as a whole.
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_WORDS = re.compile(b"[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+").findall
_OWN = bytes(c for c in range(256) if not (0x1C <= c <= 0x1F or c == 0x85 or 0xA0 <= c <= 0xBF or c in (0xD7, 0xF7)))


#: What a Python worker holds: (tokenizer, what gives new words their ids, added tokens, ids of the words it has met, ids of what it has
#: met between spaces), by the vocabulary's digest.
_HELD: dict[str, tuple] = {}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def word_merger(tokenizer, spec: dict):
    """A function from distinct words, as _WORDS finds them, to the bytes of their ids; None where the vocabulary has other rules.

    The words go to the tokenizer's own merges, all in one call. They need no normalizing and no splitting by patterns, which take longer
    than the merges do. A word ends with the one token that has the vocabulary's suffix.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    model, before = spec["model"], spec["pre_tokenizer"] or {}
    steps = before.get("pretokenizers", [{}])
    if (
        (spec["normalizer"] or {}).get("normalizers") != _NORMALIZERS
        or steps[0] != {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        or [(s["type"], s["add_prefix_space"], s["use_regex"]) for s in steps[1:]] != [("ByteLevel", False, False)]
        or (model["type"], model["end_of_word_suffix"], spec["post_processor"]) != ("BPE", _SUFFIX, None)
    ):
        return None
    merges = Tokenizer(tokenizer.model)
    merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    last = np.zeros(max(model["vocab"].values()) + 1, bool)
    last[[i for token, i in model["vocab"].items() if token.endswith(_SUFFIX)]] = True

    def of_words(new: list[bytes]) -> list[bytes]:
        ids = np.array(merges.encode_batch_fast([b" ".join(new).decode("latin-1")], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(last[ids]) + 1).tolist()
        if len(ends) != len(new):  # a vocabulary that lacks some bytes
            return [pack_ids(e.ids) for e in tokenizer.encode_batch([w.decode("latin-1") for w in new], add_special_tokens=False)]
        packed = ids.tobytes()
        return [packed[4 * i : 4 * j] for i, j in zip([0, *ends], ends)]

    return of_words


def hold(held: dict[bytes, bytes], found: Iterable[tuple[bytes, bytes]], cache: int) -> None:
    """Keeps what is found while there is room for it; nothing of 64 bytes or more."""
    held.update(islice((x for x in found if len(x[0]) < 64), max(0, cache - len(held))))


def token_bytes(source: str, cache: int = 200_000, group: int = 1 << 22):
    """A function from a list of texts to the bytes of their ids (little-endian, 32 bits), as the tokenizers library gives them for the
    vocabulary with this text, with add_special_tokens=False.

    Arrow cuts texts at spaces, about `group` characters at a time, and what is equal between spaces is looked up once; what is new there
    is cut into words. Words are tokenized once in a worker and then looked up, as the vocabulary's merges never cross words. Of both,
    the first `cache` that a worker meets, which the frequent ones are among, are held.
    """
    name = hashlib.sha256(source.encode()).hexdigest()
    if name not in _HELD:
        import os

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(source)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        spec = json.loads(source)
        _HELD[name] = tokenizer, word_merger(tokenizer, spec), [x["content"] for x in spec["added_tokens"]], {}, {}
    tokenizer, of_words, added, words, chunks = _HELD[name]

    def plain(text: str) -> bytes | None:
        """The text in lower case and Latin-1, if it can be looked up by words."""
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        return None if raw.translate(None, _OWN) or any(x in text for x in added) else raw.translate(_LOWER)

    def of_chunks(new: list[bytes]) -> list[bytes]:
        found = [_WORDS(chunk) for chunk in new]
        unknown = list(set(chain.from_iterable(found)).difference(words))
        own = dict(zip(unknown, of_words(unknown)))
        words.update(own)
        out = [b"".join(map(words.__getitem__, f)) for f in found]
        for w in own:
            del words[w]
        hold(words, own.items(), cache)
        return out

    def of_texts(raw: list[bytes]) -> list[bytes]:
        cut = pc.ascii_split_whitespace(pa.array(raw, pa.binary()).cast(pa.string(), safe=False))
        coded = cut.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
        packed = list(map(chunks.get, distinct))
        at = [k for k, p in enumerate(packed) if p is None]
        new = [distinct[k] for k in at]
        own = of_chunks(new)
        for k, p in zip(at, own):
            packed[k] = p
        hold(chunks, zip(new, own), cache)
        sizes, codes = np.fromiter(map(len, packed), np.int64, len(packed)) // 4, coded.indices.to_numpy()
        starts, n = np.cumsum(sizes) - sizes, sizes[codes]
        ends = np.r_[0, np.cumsum(n)]
        take = np.repeat(starts[codes] - ends[:-1], n)
        take += np.arange(len(take))
        ids, bounds = np.frombuffer(b"".join(packed), "<u4")[take], ends[cut.offsets.to_numpy()]
        return [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:])]

    def ids(texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        at, raw, size = [], [], 0
        for i, text in enumerate(texts):
            low = plain(text) if of_words else None
            if low is None:
                out[i] = pack_ids(tokenizer.encode(text, add_special_tokens=False).ids)
            else:
                at.append(i)
                raw.append(low)
                size += len(low)
            if at and (size >= group or i == len(texts) - 1):
                for k, packed in zip(at, of_texts(raw)):
                    out[k] = packed
                at, raw, size = [], [], 0
        return out

    return ids


def pieces(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of a document's ids with the end id; only longer documents are cut."""
    small_batches(docs.sparkSession)
    source = vocabulary(path)

    def run(batches):
        tokens, end = token_bytes(source), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, packed in zip(batch.column(0).to_pylist(), tokens(texts)):
                packed += end
                for k, at in enumerate(range(0, len(packed), 4 * size)):
                    part = packed[at : at + 4 * size]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            doc, *rest = zip(*rows) if rows else ((), (), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, batch.column(0).type), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def best_patterns(worth: np.ndarray, lengths: np.ndarray, size: int, few: int, slack: int) -> np.ndarray:
    """For each of `lengths` the pattern of up to `few` lengths with it that is worth most, of all that leave at most `slack` of `size`
    unused (what is unused costs in proportion); rows of lengths in falling order, filled up with 0."""
    best, chosen = np.full(size + 1, -np.inf), []
    best[0] = 0
    for _ in range(few - 1):  # of all sets of one more length, by their sum
        new, last = best.copy(), np.zeros(size + 1, np.int64)
        for x in lengths.tolist():
            better = best[: size + 1 - x] + worth[x] > new[x:]
            new[x:][better] = (best[: size + 1 - x] + worth[x])[better]
            last[x:][better] = x
        best = new
        chosen.append(last)
    waste = np.arange(slack + 1)
    at = size - lengths[:, None] - waste
    value = np.where(at >= 0, best[np.maximum(at, 0)], -np.inf) - waste * np.abs(worth).max() / (slack + 1)
    at = np.take_along_axis(at, value.argmax(axis=1)[:, None], axis=1)[:, 0]
    good = np.isfinite(value.max(axis=1))
    rows = np.zeros((good.sum(), few), np.int64)
    rows[:, 0], at = lengths[good], at[good]
    for k, last in enumerate(reversed(chosen)):
        rows[:, k + 1] = last[at]
        at = at - rows[:, k + 1]
    return np.unique(-np.sort(-rows, axis=1), axis=0)


def fit_repeats(rows: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeats x >= 0 of the patterns that least miss the histogram in squares, by accelerated projected gradient."""
    if not len(rows):
        return start
    use = (rows > 0).astype(float)
    covers = lambda v: np.bincount(rows.ravel(), weights=(v[:, None] * use).ravel(), minlength=len(counts))
    back = lambda r: (r[rows] * use).sum(axis=1)
    step = 1 / max(1e-9, back(covers(np.ones(len(rows)))).max())  # bounds the largest eigenvalue, as the matrix has no negative entry
    x = y = start
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(covers(y) - counts))
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        x, y = new, new + (last - 1) / t * (new - x)
    return x


def patterns(counts: np.ndarray, size: int, few: int = 4, rounds: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """Patterns of up to `few` lengths and their repeats, fitted to the histogram by non-negative least squares.

    Of all patterns of that many lengths, those that the fit wants next are found by a table over sums (what a pattern is worth is what
    the fit so far misses of its lengths), for each length one; then all are fitted again. They leave 1/64 of a sequence at most.
    """
    lengths = np.flatnonzero(counts[: size + 1])
    rows, repeats, missed = np.zeros((0, few), np.int64), np.zeros(0), counts.astype(float)
    for _ in range(rounds):
        new = best_patterns(missed, lengths, size, few, size // 64)
        every, first = np.unique(np.vstack([rows, new]), axis=0, return_index=True)
        if len(every) == len(rows):
            break
        repeats = fit_repeats(every, counts, np.r_[repeats, np.zeros(len(new))][first])
        rows, missed = every, counts - np.bincount(every.ravel(), weights=np.repeat(repeats, few), minlength=len(counts))
        missed[0] = 0
    return rows, repeats


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, dict[int, int]]]:
    """(repeats, {length: how often in one sequence}) for all sequences; every piece of the histogram is in one.

    Rounded patterns come first, as often as there are pieces for them; best fit packs what is left. If best fit alone takes fewer
    sequences (as with few pieces of each length), its plan is taken.
    """
    counts = np.zeros(size + 1)
    for length, n in histogram.items():
        counts[length] += n
    left = {int(i): int(counts[i]) for i in np.flatnonzero(counts)}
    alone = best_fit(left, size)
    if sum(n for n, _ in alone) * size < sum(x * n for x, n in left.items()) + size:
        return alone  # no plan takes fewer
    done: list[tuple[int, dict[int, int]]] = []
    rows, repeats = patterns(counts, size)
    repeats = np.rint(repeats).astype(int)
    for i in np.argsort(-repeats, kind="stable"):
        own: dict[int, int] = defaultdict(int)
        for x in rows[i]:
            if x:
                own[int(x)] += 1
        n = min([int(repeats[i]), *(left.get(x, 0) // k for x, k in own.items())])
        if n > 0:
            done.append((n, dict(own)))
            for x, k in own.items():
                left[x] -= n * k
    done += best_fit(left, size)
    return min(done, alone, key=lambda sequences: sum(n for n, _ in sequences))


def best_fit(left: dict[int, int], size: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing of {length: count}, a whole run of equal lengths and equal gaps at a time: the longest goes into the sequences
    with the smallest gap that holds it, and into new sequences where none does."""
    done: list[tuple[int, dict[int, int]]] = []
    gaps: list[int] = []  # sorted
    open_: dict[int, list[list]] = defaultdict(list)  # gap -> [repeats, content]

    def put(gap: int, n: int, content: dict[int, int]) -> None:
        if gap == 0:
            done.append((n, content))
            return
        if gap not in open_:
            insort(gaps, gap)
        open_[gap].append([n, content])

    for length in sorted(left, reverse=True):
        n = left[length]
        while n > 0:
            i = bisect_left(gaps, length)
            if i == len(gaps):
                fits = size // length
                if n >= fits:
                    put(size - fits * length, n // fits, {length: fits})
                    n -= n // fits * fits
                else:
                    put(size - n * length, 1, {length: n})
                    n = 0
                continue
            gap = gaps[i]
            have, content = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            fits = min(gap // length, n)
            used = min(have, n // fits)
            if used < have:
                put(gap, have - used, content)
            put(gap - fits * length, used, content | {length: content.get(length, 0) + fits})
            n -= used * fits
    return done + [(n, content) for rows_ in open_.values() for n, content in rows_]


def slots(sequences: list[tuple[int, dict[int, int]]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """length -> [(first rank, first sequence, how often in one sequence, offset there)] in the order of ranks."""
    out: dict[int, list] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for repeats, content in sequences:
        offset = 0
        for length, k in sorted(content.items(), reverse=True):
            out[length].append((taken[length], sequence, k, offset))
            taken[length] += repeats * k
            offset += length * k
        sequence += repeats
    return dict(out)


def pack(found: DataFrame, size: int = SIZE, group: int = 1_000) -> DataFrame:
    """Gives every piece (doc_id, piece, length, ...) a sequence_id and its offset there.

    The driver sees one count for each length, never a row. A piece's rank within its length is its place in a bucket of the length
    (each length has buckets of its own, dealt by hash, of about `group` rows at most, however many pieces share it) plus the sizes of
    the buckets before. Pieces that are equal in all columns may change places. An empty table gives an empty result.
    """
    histogram = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    where = slots(plan(histogram, size))
    buckets = found.sparkSession.createDataFrame([(x, -(-n // group)) for x, n in histogram.items()], "length long, _buckets long")  # `size` rows at most
    dealt = found.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_buckets"))).drop("_buckets")
    sizes = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("_own", F.row_number().over(own)).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_own") - 1 + F.col("_before"))
    table_ = {n: tuple(np.array(c) for c in zip(*rows)) for n, rows in where.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        order = np.argsort(lengths, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            if len(part):
                first, start, k, at = table_[int(lengths[part[0]])]
                i = np.searchsorted(first, ranks[part], side="right") - 1
                inner = ranks[part] - first[i]
                sequence[part] = start[i] + inner // k[i]
                offset[part] = at[i] + inner % k[i] * lengths[part]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    columns = [c for c in found.columns if c not in ("sequence_id", "offset")]
    return ranked.withColumn("_place", place("length", "_rank")).select(*columns, "_place.sequence_id", "_place.offset")


def packed_documents(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Tokenize, cut and pack `docs` (doc_id, text; null texts count as empty and take one end id each).

    doc_id, piece, start, length, ids_crc32, sequence_id, offset. Lengths are kept as a written table, so the tokenizer runs once.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(keep(pieces(docs, path, size, end_id), "pieces"), size)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
