"""SimHash near-dedup: fingerprints of word shingles, pigeonhole blocks, and a check of the Hamming distance."""

from __future__ import annotations

import math
import re
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_kept, keep, small_batches, spare, table
from .components import connected_components

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile("[^\x20\x09-\x0d]+").findall
#: Rows of one (key, part) in a task; a larger block is compared part by part, in tasks of their own.
PART = 1024
#: Rows of a block that meet all its parts, in the pass that is linear; and the keys that it goes through.
HUBS, FIRST = 16, 3
#: Shingle hashes of a group in a task (a single text may hold more).
HASHES = 1 << 21


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `words` words of a text, A-Z in lower case, repeats included; of all words if there are fewer."""
    found = _WORDS(text.translate(_UPPER))
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        runs = [" ".join(found)]
    else:
        runs = map(" ".join, zip(*(found[i:] for i in range(words))))
    return np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in runs), np.uint64)


def fingerprint(hashes: np.ndarray, lanes: int = 1) -> np.ndarray:
    """`lanes` x 64 bits: bit b of a lane is 1 if it is set in over half of the hashes, mixed anew for each lane after the first."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes if len(hashes) else 0):
        h = hashes
        if lane:
            with np.errstate(over="ignore"):
                h = (h ^ np.uint64(lane * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
                h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
        counts = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 16):
            bits = np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            whole = len(bits) // 255 * 255
            counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.int64)
        out[lane] = np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int = 3, lanes: int = 1, repeats: bool = True, few: int = 0) -> DataFrame:
    """doc_id, f0, f1, ...: signed 64-bit lanes of every whole text's fingerprint, of its shingles with or without repeats. Null and
    blank texts have fingerprint zero. With `few`, also few: the sorted hashes of texts of 1 to `few` different shingles, else null."""
    small_batches(docs.sparkSession)
    names = [f"f{i}" for i in range(lanes)]

    def run(batches):
        for batch in batches:
            f, sets = np.zeros((batch.num_rows, lanes), np.uint64), []
            for i, t in enumerate(batch.column(1)):
                h = shingle_hashes(t.as_py() or "", words)
                h = h if repeats else np.unique(h)
                f[i] = fingerprint(h, lanes)
                sets.append(np.unique(h).tobytes() if 0 < len(h) <= few else None)
            own = [pa.array(sets, pa.binary())] if few else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(f[:, i]).view(np.int64)) for i in range(lanes)), *own], names=["doc_id", *names, *["few"][: len(own)]])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}", *(f"{n} long" for n in names), *["few binary"][: min(few, 1)]]))


def pigeonhole(distance: int, blocks: int) -> list[list[tuple[int, int]]]:
    """Keys of a 64-bit fingerprint, each a list of (lane, bit): with `blocks` blocks, at least blocks - distance of them are equal in
    a pair of that distance, so each choice of that many blocks is a key, and the pair shares one of them."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    own = [[(0, b) for b in range(i, j)] for i, j in zip(edges, edges[1:])]
    return [sum(some, []) for some in combinations(own, blocks - distance)]


def sampled_blocks(lanes: int, keys: int, bits: int, seed: int = 7) -> list[list[tuple[int, int]]]:
    """Keys of `bits` bits drawn from all lanes, for distances at which no choice of whole blocks must agree."""
    rng = np.random.default_rng(seed)
    return [[(int(x) // 64, int(x) % 64) for x in rng.choice(lanes * 64, bits, replace=False)] for _ in range(keys)]


def _key_values(f: np.ndarray, keys: list[list[tuple[int, int]]]) -> np.ndarray:
    out = np.zeros((len(f), len(keys)), np.uint64)
    with np.errstate(over="ignore"):
        for k, bits in enumerate(keys):
            for i, (lane, bit) in enumerate(bits):
                out[:, k] |= ((f[:, lane] >> np.uint64(bit)) & np.uint64(1)) << np.uint64(i)
            out[:, k] = (out[:, k] * np.uint64(len(keys)) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)
            out[:, k] ^= out[:, k] >> np.uint64(31)
    return out.view(np.int64)


def _forest(near: np.ndarray, group: np.ndarray) -> list[tuple[int, int]]:
    """(row, row) links of a boolean matrix that join what all its links join; rows of one group are joined already."""
    out, unseen = [], near.any(axis=1)
    for start in np.flatnonzero(unseen).tolist():
        stack = np.flatnonzero(unseen & (group == group[start])).tolist() if unseen[start] else []
        unseen[stack] = False
        while stack:
            at = stack.pop()
            found = np.flatnonzero(near[at] & unseen)
            if len(found):
                names, first = np.unique(group[found], return_index=True)
                out += [(at, int(j)) for j in found[first]]
                more = np.flatnonzero(unseen & np.isin(group, names))
                unseen[more] = False
                stack += more.tolist()
    return out


def _whole_blocks(batches, columns):
    """Arrays of rows sorted by their first one, the key, so that no key's rows are in two of them. `columns` makes arrays of a batch."""
    held = None
    for batch in batches:
        now = columns(batch)
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        if not len(now[0]):
            continue
        last = np.searchsorted(now[0], now[0][-1])  # the last block may go on in the next batch
        held = [x[last:] for x in now]
        if last:
            yield [x[:last] for x in now]
    if held is not None:
        yield held


def _lanes(batch: pa.RecordBatch, at: int, n: int) -> np.ndarray:
    return np.stack([np.asarray(batch.column(at + i)).view(np.uint64) for i in range(n)], axis=1)


def _parts(rows: DataFrame, block: str, large: DataFrame, broad: bool) -> DataFrame:
    """Deals the rows (block, root, rep, ...) of large blocks to parts, each a task: `block` becomes the task's name, and side tells the
    two parts of a task apart, whose rows are then compared across only.

    `large`: block, n (rows), of_main (rows of its commonest root), main (that root), most (rows in a part). With `broad`, a row is in a
    part of its own and HUBS rows of the block are in each: so the work is linear in the block, but pairs of two parts don't meet. Else
    each pair of parts is a task, but for two that hold the commonest root only: so no pair of two roots is left out, and a block of
    which one root has nearly all rows is linear again.
    """
    large = large.withColumn("d", F.when((F.col("of_main") * 2 < F.col("most")) | F.lit(broad), 0).otherwise(F.ceil(F.col("of_main") / F.col("most"))))
    large = large.withColumn("e", F.greatest(F.lit(1), F.ceil((F.col("n") - F.when(F.col("d") > 0, F.col("of_main")).otherwise(0)) / F.col("most"))))
    large = large.select(block, F.col("n").alias("_n"), F.col("main").alias("_main"), F.col("d").cast("int").alias("_d"), F.col("e").cast("int").alias("_e"))
    n = large.count()
    if not n:
        return rows.withColumn("side", F.lit(False))
    rows = rows.join(F.broadcast(large) if n <= 100_000 else large, block, "left")
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    one = lambda a, b, side: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), side.alias("side"))
    alone, no = F.array(one(F.lit(0), F.lit(0), F.lit(False))), F.lit(False)
    if broad:
        hub = F.pmod(F.xxhash64("rep", F.lit(1)), F.col("_n")) < HUBS
        tasks = F.transform(F.when(hub, F.sequence(F.lit(0), F.col("_e") - 1)).otherwise(F.array(part(F.col("_e")))), lambda x: one(x, x, no))
    else:
        main = (F.col("_d") > 0) & (F.col("root") == F.col("_main"))
        own = F.when(main, part(F.greatest("_d", F.lit(1)))).otherwise(F.col("_d") + part(F.col("_e")))
        others = F.sequence(F.when(main, F.col("_d")).otherwise(F.lit(0)), F.col("_d") + F.col("_e") - 1)
        tasks = F.transform(others, lambda x: one(F.least(x, own), F.greatest(x, own), own > x))
    rows = rows.withColumn("_task", F.explode(F.when(F.col("_e").isNull(), alone).otherwise(tasks)))
    named = F.when(F.col("_e").isNull(), F.col(block)).otherwise(F.xxhash64(block, "_task.a", "_task.b"))
    return rows.withColumns({block: named, "side": F.col("_task.side")}).drop("_n", "_main", "_d", "_e", "_task")


def links(found: DataFrame, lanes: int, keys: list[list[tuple[int, int]]], most: int, compared: int | None = None, broad: bool = False) -> DataFrame:
    """(src, dst) links between roots that join the same roots as all pairs of rows within `most` bits that share a key do.

    `found`: rep, root, f0, ... with distinct fingerprints; rows of one root are joined already and not compared. Each row goes to one
    block for each key; a block's rows meet in a task, sorted, and only links of a spanning forest leave it, so no block lists its pairs.
    A block that a sample of the rows tells to be larger than PART is cut into parts (see _parts; with `broad`, pairs of different parts
    don't meet). Keys are taken from all lanes, distances over `compared` of them (all, unless told otherwise), other ones for each key
    in turn.
    """
    every, names = [f"f{i}" for i in range(lanes)], [f"f{i}" for i in range(compared or lanes)]
    small_batches(found.sparkSession, 10_000)

    def deal(batches):
        for batch in batches:
            values = _key_values(_lanes(batch, 2, lanes), keys)
            for k in range(len(keys)):
                some = [batch.column(2 + (k * len(names) + i) % lanes) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(values[:, k]), batch.column(0), batch.column(1), *some], names=["key", "rep", "root", *names])

    schema = ", ".join(["key long", "rep long", "root long", *(f"{n} long" for n in names)])
    found = found.select("rep", "root", *every)
    tenth = found.filter(F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(16)) == 0).mapInArrow(deal, schema).groupBy("key", "root").count()
    large = tenth.groupBy("key").agg((16 * F.sum("count")).alias("n"), (16 * F.max("count")).alias("of_main"), F.max_by("root", F.struct("count", "root")).alias("main")).filter(F.col("n") > PART // 2)
    large = keep(large.withColumn("most", F.lit(PART)), "large-blocks")

    def compare(batches):
        columns = lambda batch: [np.asarray(batch.column(0)), np.asarray(batch.column(1)), _lanes(batch, 2, len(names)), np.asarray(batch.column(2 + len(names)).to_numpy(zero_copy_only=False))]
        for key, root, f, side in _whole_blocks(batches, columns):
            out = []
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            for d in range(1, 8):  # small blocks all at once
                some = (sizes > d) & (sizes <= 8)
                n = sizes[some] - d
                at = np.repeat(starts[some], n)
                if not len(at):
                    break
                i = at + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                i = i[root[i] != root[i + d]]
                apart = np.zeros(len(i), np.int64)
                for lane in range(f.shape[1]):
                    apart += np.bitwise_count(f[i, lane] ^ f[i + d, lane])
                near = i[apart <= most]
                out.append(np.stack([root[near], root[near + d]], axis=1))
            for at, n in zip(starts[sizes > 8], sizes[sizes > 8]):
                own, group, across = f[at : at + n], root[at : at + n], side[at : at + n]
                if (group == group[0]).all():
                    continue
                near = np.zeros((n, n), bool)
                for i in range(0, n, PART):
                    apart = sum(np.bitwise_count(own[i : i + PART, None, lane] ^ own[None, :, lane]).astype(np.uint16) for lane in range(own.shape[1]))
                    near[i : i + PART] = (apart <= most) & (group[i : i + PART, None] != group[None])
                if across.any():
                    near &= across[:, None] != across[None]
                if pairs := _forest(near, group):
                    out.append(group[np.array(pairs)])
            pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0) if out else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

    dealt = _parts(found.mapInArrow(deal, schema), "key", large, broad)
    dealt = dealt.repartition("key").sortWithinPartitions("key").select("key", "root", *names, "side")
    return dealt.mapInArrow(compare, "src long, dst long")


def _joined(rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """`rows` (root, ...) with the roots of what `edges` (between roots) join, as a written table."""
    roots = connected_components(edges)
    out = keep(rows.join(roots.toDF("root", "_last"), "root", "left").withColumn("root", F.coalesce("_last", "root")).drop("_last"), name)
    drop_kept(roots)
    return out


def reached(found: DataFrame, lanes: int, keys: list[list[tuple[int, int]]], most: int, compared: int | None = None) -> DataFrame:
    """rep, root of rows (rep, f0, ...) with distinct fingerprints: all pairs within `most` bits that share a key have one root.

    The first keys are gone through in linear work, which joins what is dense; then all keys, between different roots only. So a group of
    any number of near rows is compared with itself only in parts, and with others once; its links are a few for each row.
    """
    names = [f"f{i}" for i in range(lanes)]
    rows = found.select("rep", F.col("rep").alias("root"), *names)
    rows = _joined(rows, links(rows, lanes, keys[:FIRST], most, compared, broad=True), "reached")
    out = _joined(rows.select("rep", "root"), links(rows, lanes, keys, most, compared), "reached")
    drop_kept(rows)
    return out


def _smallest(known: DataFrame) -> DataFrame:
    """root, component_id: the smallest `least` of each root, as a written table: a join with it can be split where a root has very many
    rows, which a join with the aggregate itself can't."""
    return keep(known.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")


def near_duplicates(docs: DataFrame, words: int = 3, lanes: int = 1, most: int = 2, keys: list | None = None) -> DataFrame:
    """doc_id, f0, f1, ..., component_id for every row of docs(doc_id, text).

    Documents link where their fingerprints are equal or differ in at most `most` bits and share a key; component_id is the smallest
    doc_id reachable. Without `keys` they are such that every pair in reach shares one (one lane only). Equal fingerprints are first
    merged to one row each, so copies are never paired. Null and blank texts have fingerprint zero and link like any other; a null
    doc_id never is a component's name unless all of it have none. Repeated rows are repeated in the result; an empty table gives none.
    """
    names = [f"f{i}" for i in range(lanes)]
    own = keep(fingerprints(docs, words, lanes), "fingerprints")
    reps = keep(own.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("rep", F.xxhash64(*names) if lanes > 1 else F.col("f0")), "distinct-fingerprints")
    known = keep(reps.join(reached(reps, lanes, keys or pigeonhole(most, most + 2), most), "rep").select(*names, "least", "root"), "fingerprint-classes")
    least = _smallest(known)
    return own.join(known.join(least, "root").select(*names, "component_id"), names)


def differing(shared: int, a: int, b: int) -> float:
    """The share of bits in which the fingerprints of two sets with `shared` hashes in common, and a and b others, are expected to differ."""
    def tail(n: int) -> list[float]:
        """By k: the chance that at least k of n hashes set a bit."""
        return np.cumsum([math.comb(n, k) / 2**n for k in range(n, -1, -1)])[::-1].tolist() + [0.0]

    tails, total = (tail(a), tail(b)), 0.0
    for k in range(shared + 1):
        one, other = (t[min(max((shared + n) // 2 + 1 - k, 0), n + 1)] for t, n in zip(tails, (a, b)))
        total += math.comb(shared, k) / 2**shared * (one * (1 - other) + other * (1 - one))
    return total


@cache
def most_differing(similarity: float, over: int, exact: int = 100) -> float:
    """The largest share of bits in which two sets of this Jaccard similarity or more are expected to differ, the larger of them having more
    than `over` hashes. Up to `exact` it is worked out, where a tie of an even number of hashes raises it; beyond, the share nears that of
    large sets, acos / pi, from values that are less than the largest ones before."""
    out = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for m in range(over + 1, exact + 1):
        for n in range(math.ceil(similarity * m - 1e-9), m + 1):
            shared = math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9)
            if 0 < shared <= n:
                out = max(out, differing(shared, n - shared, m - shared))
    return out


def _distances(bits: int, share: float) -> np.ndarray:
    """By k: the chance that a pair differing in each of `bits` with the chance `share` differs in k."""
    log = lambda k: math.lgamma(bits + 1) - math.lgamma(k + 1) - math.lgamma(bits - k + 1) + k * math.log(share) + (bits - k) * math.log1p(-share)
    return np.exp([log(k) for k in range(bits + 1)])


def _reach(bits: int, share: float, lost: float) -> int:
    """The number of bits that such a pair exceeds with a chance of `lost` at most."""
    return bits - int(np.searchsorted(np.cumsum(_distances(bits, share)[::-1]), lost, side="right"))


def _keys_needed(bits: int, wide: int, share: float, most: int, seen: float, lost: float) -> int:
    """The number of keys of `wide` bits by which such a pair goes unfound with a chance of `lost` at most. It is found if it differs in
    `most` bits or fewer, agrees in a key, and then by a chance of `seen`. Pairs that differ in more bits than the mean need more keys
    than the mean does."""
    chances = _distances(bits, share)
    same = seen * np.cumprod([np.maximum(bits - i - np.arange(bits + 1), 0) / (bits - i) for i in range(wide)], axis=0)[-1]
    missed = lambda n: (chances[: most + 1] * (1 - same[: most + 1]) ** n).sum() + chances[most + 1 :].sum()
    high = 1
    while missed(high) > lost:
        high *= 2
    return next(n for n in range(high // 2, high + 1) if missed(n) <= lost)


def _few_links(reps: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) links that join what all pairs of rows (rep, few) of this Jaccard similarity or more join.

    Each set is written without up to share 1 - similarity of its hashes, in all ways; such a pair has what it shares in common there.
    Among the rows of one remainder, each links to the one that left out least: if any two of them are alike, both are like that one.
    """
    def deal(batches):
        for batch in batches:
            out = []
            for rep, few in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = [few[i : i + 8] for i in range(0, len(few), 8)]
                for gone in range(int(len(h) * (1 - similarity) + 1e-9) + 1):
                    out += [(xxhash.xxh64_intdigest(b"".join(some), 42) - (1 << 63), len(some), gone, rep) for some in combinations(h, len(h) - gone)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["key", "shared", "gone", "rep"])

    dealt = keep(reps.filter("few IS NOT NULL").select("rep", "few").mapInArrow(deal, "key long, shared long, gone long, rep long"), "few-shingles")
    least = dealt.groupBy("key", "shared").agg(F.min(F.struct("gone", "rep")).alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    both = dealt.join(least, ["key", "shared"]).filter(F.col("rep") != F.col("least.rep"))
    both = both.filter(F.col("shared") >= F.lit(similarity) * (F.col("shared") + F.col("gone") + F.col("least.gone")))
    out = keep(both.select(F.col("least.rep").alias("src"), F.col("rep").alias("dst")), "few-links")
    drop_kept(dealt)
    return out


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """rep, root, n, shingles (n sorted hashes, binary) of rows (rep, root, text)."""
    def run(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or "", words)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["rep", "root", "n", "shingles"])

    return texts.select("rep", "root", "text").mapInArrow(run, "rep long, root long, n long, shingles binary")


def alike_forest(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of places that join what all pairs of sets (none empty) of this Jaccard similarity join; sets of one root are joined already,
    and where `side` has both values only sets of different sides are compared. Every pair is compared unless joined by others."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, np.int64)
    first = np.cumsum(sizes) - sizes
    mark, across = np.zeros(int(ids.max(initial=0)) + 1, bool), side.any()
    out, unseen, left = [], np.ones(len(sets), bool), np.arange(len(sets))
    flat, starts = ids, first
    for start in range(len(sets)):
        if not unseen[start]:
            continue
        stack = np.flatnonzero(unseen & (root == root[start])).tolist()
        unseen[stack] = False
        while stack and unseen.any():
            if 2 * np.count_nonzero(unseen) < len(left):  # only what isn't joined yet
                left = np.flatnonzero(unseen)
                flat = np.concatenate([ids[first[i] : first[i] + sizes[i]] for i in left])
                starts = np.cumsum(sizes[left]) - sizes[left]
            at = stack.pop()
            own = ids[first[at] : first[at] + sizes[at]]
            mark[own] = True
            shared = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            good = unseen[left] & (shared >= similarity * (sizes[left] + sizes[at] - shared) - 1e-9)
            found = left[good & (side[left] != side[at])] if across else left[good]
            if len(found):
                names, which = np.unique(root[found], return_index=True)
                out += [(at, int(j)) for j in found[which]]
                more = np.flatnonzero(unseen & np.isin(root, names))
                unseen[more] = False
                stack += more.tolist()
    return out


def _alike(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst) links between roots that join what all pairs of sets in a block do: rows (block, root, side, shingles)."""
    def run(batches):
        def checked(block):
            sets = [np.frombuffer(s, np.uint64) for s in block[2]]
            root = np.array(block[0], np.int64)
            pairs = alike_forest(sets, root, np.array(block[1], bool), similarity)
            at = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(root[at[:, 0]]), pa.array(root[at[:, 1]])], names=["src", "dst"])

        name, held = None, ([], [], [])
        for batch in batches:
            for block, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if block != name:
                    if len(held[0]) > 1:
                        yield checked(held)
                    name, held = block, ([], [], [])
                for column, x in zip(held, row):
                    column.append(x)
        if len(held[0]) > 1:
            yield checked(held)

    return rows.repartition("block").sortWithinPartitions("block").select("block", "root", "side", "shingles").mapInArrow(run, "src long, dst long")


def alike_within(groups: DataFrame, reps: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(src, dst): links that join the same rows as all pairs of one group (rep, root) whose shingle sets have this Jaccard similarity.

    A group's sets meet in one task, as many as HASHES hashes or 4 x PART sets; a larger group goes in parts, first in linear work, with
    a few sets that meet all of it, then between those different roots that are left. So each pair of a group is compared or joined already.
    """
    members = groups.join(keep(groups.groupBy("root").count().filter("count > 1").select("root"), "shared-roots"), "root")
    asked = members.join(reps, "rep").select("rep", "root", F.col("least.doc_id").alias("_id"), F.col("least.key").alias("_key"))
    texts = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key"))
    texts = texts.join(asked, (texts["key"] == asked["_key"]) & texts["doc_id"].eqNullSafe(asked["_id"])).select("rep", "root", "text").dropDuplicates(["rep"])
    small_batches(docs.sparkSession)
    sets = keep(_shingle_sets(texts, words).filter("n > 0").withColumnRenamed("root", "block"), "shingle-sets")
    share = F.least(F.lit(4 * PART), F.greatest(F.lit(1), (F.count("*") * HASHES / F.sum("n")).cast("long")))
    sizes = keep(sets.groupBy("block").agg(F.count("*").alias("n"), share.alias("most")).filter("n > most"), "large-groups")
    none = sizes.select("block", "n", "most", F.lit(0).cast("long").alias("of_main"), F.lit(0).cast("long").alias("main"))
    found = keep(_alike(_parts(sets.withColumn("root", F.col("rep")), "block", none, True), similarity), "near-links")
    if sizes.isEmpty():
        drop_kept(sets)
        return found
    rows = _joined(sets.join(sizes.select("block"), "block").withColumn("root", F.col("rep")), found, "large-group-roots")
    main = rows.groupBy("block", "root").count().groupBy("block").agg(F.max("count").alias("of_main"), F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("roots"))
    open_ = keep(sizes.join(main.filter("roots > 1"), "block"), "open-groups")
    more = keep(_alike(_parts(rows.join(open_.select("block"), "block"), "block", open_, False), similarity), "further-links")
    drop_kept(sets, rows)
    return found.union(more)


def near_texts(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 16, recall: float = 0.999) -> DataFrame:
    """doc_id and component_id, each a struct (none, doc_id, key) that names a row of docs(doc_id, text): key is the MD5 of its text.

    Rows link where the sets of word shingles of their texts have a Jaccard similarity of `similarity` or more. Pairs of sets so small
    that one hash at most may be missing (9 at 0.8) are found by their remainders, all of them. Of others, fingerprints of 64 x `lanes`
    bits reach such a pair with a chance of `recall` or more, by a common key and the distance over 128 bits, at the largest share of
    differing bits of any set sizes. What fingerprints join is a group (see reached); in each group all pairs of sets are then compared
    exactly, save those that exact links join already, so that a fingerprint never decides. A key has so many bits that unlike texts fill
    a block with 512 rows at most, at any size; the number of keys follows from that.
    component_id is the smallest reachable (rows with doc_id first). Null and blank texts are alike. No rows give no rows. The result is
    a written table.
    """
    names, bits = [f"f{i}" for i in range(lanes)], 64 * lanes
    key = F.md5(F.coalesce("text", F.lit("")))
    who = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key"))
    few = max(1, math.ceil(2 / (1 - similarity) - 1e-9) - 1)
    own = keep(fingerprints(docs.select(who.alias("doc_id"), "text"), words, lanes, repeats=False, few=few), "fingerprints")
    reps = keep(own.groupBy(*names).agg(F.min("doc_id").alias("least"), F.min("few").alias("few")).withColumn("rep", F.xxhash64(*names)), "distinct-fingerprints")
    share = most_differing(similarity, few)
    wide = max(16, math.ceil(math.log2(max(2, reps.count()))) - 9)
    keys = sampled_blocks(lanes, _keys_needed(bits, wide, share, bits, 0.999, 1 - recall), wide)
    groups = reached(reps, lanes, keys, _reach(128, share, 0.001), compared=2)
    exact = alike_within(groups, reps, docs, words, similarity).union(_few_links(reps, similarity))
    known = _joined(reps.select("rep", "least", *names, F.col("rep").alias("root")), exact, "fingerprint-classes")
    least = _smallest(known)
    out = keep(own.drop("few").join(known.join(least, "root").select(*names, "component_id"), names).select("doc_id", "component_id"), "near-texts")
    drop_kept(own, reps, groups, known, least)
    return out


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """`docs` with one row of each group of near-duplicate texts: the one with the smallest doc_id (null last; then the smallest MD5 of
    the text), and one of its repeated rows. Columns stay as they are."""
    groups = near_texts(docs.select("doc_id", "text"), words, similarity)
    kept = groups.filter(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").count()
    kept = keep(kept.select(F.col("doc_id.doc_id").alias("_id"), F.col("doc_id.key").alias("_key"), F.col("count").alias("_n")), "kept-rows")
    drop_kept(groups)
    own = spare(docs, "_own")
    rows = docs.withColumn(own, F.md5(F.coalesce("text", F.lit(""))))
    chosen = lambda some: rows.join(kept.filter(some), (rows[own] == kept["_key"]) & rows["doc_id"].eqNullSafe(kept["_id"]), "left_semi")
    if kept.filter("_n > 1").isEmpty():
        return chosen("_n = 1").select(*docs.columns)
    return chosen("_n = 1").union(chosen("_n > 1").dropDuplicates(["doc_id", own])).select(*docs.columns)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("f0")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE: dict[str, str] = {}
