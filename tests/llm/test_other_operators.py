"""Operators over vectors, pages and conversations, and the pipeline, held against brute force and DuckDB."""

import collections
import glob
import gzip
import hashlib
import math
import os
import re

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__
from quillspark.llm import op2_topk, op3_bpe, op6_warc, op7_forest, op8_chat, registry
from quillspark.llm.components import connected_components
from quillspark.llm.common import spare

TINY = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_agrees_with_sql(name, agree):
    agree(registry.QUERIES[name], registry.ORACLE[name])


def test_every_operator_is_registered():
    names = set(__spark_entry__.queries())
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 11)) and "pipeline" in names


# vectors


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.standard_normal(16) * rng.choice([0.05, 0.3, 0.6])]) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [math.inf] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    rows += [(None, rows[0][1]), (5, rows[9][1]), (5, rows[5][1])]  # no id, an id twice, a row twice
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, cls int"), rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def test_top_k_is_exact(spark, vectors):
    quantised = op2_topk.quantised(vectors[0])
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors[1] if i is not None and len(v or []) == 16 and good(v)]
    same = quantised.filter("size(terms) = 16")
    found = op2_topk.top_k(same, same.filter("vec_id % 100 = 0 AND vec_id < 1000"), k=7, block=100, query_block=2)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in found.collect()}
    want = {}
    for q, terms in rows:
        if q % 100 == 0 and q < 1000:
            scores = sorted((-sum(a * b for a, b in zip(terms, t)), i) for i, t in rows if i != q)
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(scores[:7])}
    assert got == want


def test_top_k_of_few_or_no_rows(vectors):
    rows = op2_topk.quantised(vectors[0]).filter("vec_id IN (1, 2)")
    assert op2_topk.top_k(rows, rows, k=10).count() == 2
    assert op2_topk.top_k(rows.limit(0), rows.limit(0)).count() == 0


def test_top_k_of_repeated_and_ragged_queries(spark):
    rows = spark.createDataFrame([(i, [i, 1, -i][: 1 + i % 3]) for i in range(1, 30)], "vec_id long, terms array<bigint>")
    asked = spark.createDataFrame([(5, [2, 0, 1]), (5, [2, 0, 1]), (5, [0, 1]), (40, [1, 1, 1])], rows.schema)
    found = op2_topk.top_k(rows, asked, k=4).collect()
    want = []
    for q, terms in ((5, [2, 0, 1]), (5, [0, 1]), (40, [1, 1, 1])):
        scored = [(-sum(a * b for a, b in zip(terms, [i, 1, -i][: 1 + i % 3])), i) for i in range(1, 30) if i != q]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:4], 1)]
    assert sorted(map(tuple, found)) == sorted(want)


def brute_links(rows):
    able = [(n, i, np.array(v)) for n, (i, v) in enumerate(rows) if i is not None and good(v) and any(v)]
    links, linked = collections.Counter(), []
    for a in range(len(able)):
        for b in range(a):
            u, v = able[a][2], able[b][2]
            if len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= 0.9:
                links[able[a][0]] += 1
                links[able[b][0]] += 1
                linked.append((able[a][0], able[b][0]))
    return links, linked


@pytest.mark.parametrize("leaf", [1000, 40])
def test_forest_finds_links(vectors, leaf):
    df, rows = vectors
    links, linked = brute_links(rows)
    found = op7_forest.near_vectors(df, leaf=leaf, trees=12).collect()
    assert len(found) == len(rows)
    got = {r["vec_id"]: r["n_links"] for r in found}
    want = {i: links[n] for n, (i, _) in enumerate(rows)}
    once = [i for i in want if i is not None and i != 5]
    assert all(got[i] <= want[i] for i in once)
    assert sum(got[i] for i in once) >= (1.0 if leaf == 1000 else 0.9) * sum(want[i] for i in once)
    roots = {n: n for n in range(len(rows))}
    for a, b in linked:
        x, y = roots[a], roots[b]
        roots = {k: min(x, y) if r in (x, y) else r for k, r in roots.items()}
    least = collections.defaultdict(list)
    for n, r in roots.items():
        if rows[n][0] is not None:
            least[r].append(rows[n][0])
    if leaf == 1000:
        assert all(r["component_id"] == min(least[roots[n]]) for n, (i, _) in enumerate(rows) for r in found if i in once and r["vec_id"] == i)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)
    assert got[2000] == got[2001] == got[2002] == got[2004] == 0 and got[2006] == 1


@pytest.mark.parametrize("others", [0, 10_000])
def test_forest_keeps_the_links_of_a_dense_group(spark, others):
    """20,000 distinct vectors of which most pairs are links, more than any leaf may hold."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20_000, 16)) * 0.3 / 4 + np.eye(16)[0]
    x = np.vstack([x, rng.standard_normal((others, 16))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    unit = (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)
    want = sum(np.count_nonzero(unit[i : i + 1000] @ unit.T >= 0.9) for i in range(0, len(x), 1000)) - len(x)
    assert want > 2e8
    found = op7_forest.near_vectors(df).agg({"n_links": "sum"}).first()[0]
    assert 0.99 * want < found < 1.001 * want


@pytest.mark.parametrize("case", ["multiples", "one_dimension", "a_third_of_one_direction"])
def test_forest_ends_where_projections_are_equal(spark, case):
    rng = np.random.default_rng(5)
    if case == "multiples":
        x = np.outer(1 + np.arange(5000), rng.standard_normal(8))
    elif case == "one_dimension":
        x = (1.0 + np.arange(5000))[:, None] * np.where(np.arange(5000) % 2, 1, -1)[:, None]
    else:
        x = np.vstack([np.outer(2.0 ** np.arange(-60, 60), rng.standard_normal(8)), rng.standard_normal((240, 8))])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    want = np.count_nonzero(unit @ unit.T >= 0.9) - len(x)
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    rows = op7_forest.near_vectors(df, leaf=1000 if len(x) > 1000 else 20).selectExpr("sum(n_links) AS n", "max(component_id) AS most").first()
    assert 0.99 * want <= rows["n"] <= want
    assert case != "multiples" or rows["most"] == 0


def test_forest_recall_of_planted_links(spark):
    """Leaves of 100 vectors, so that trees are deep, and 8,000 vectors in pairs and small groups on either side of the threshold."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((2000, 32))
    x = np.repeat(centres, 4, axis=0) + rng.standard_normal((8000, 32)) * np.repeat(rng.uniform(0.05, 0.45, 2000), 4)[:, None]
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.9
    want = near.sum(axis=1) - 1
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in op7_forest.near_vectors(df, leaf=100).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum() > 5000


def test_no_vectors(vectors):
    assert op7_forest.near_vectors(vectors[0].limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2001 + i) for i in range(50)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3)], "src long, dst long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    parent = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert all(got.get(x, x) == r for x, r in parent.items())
    assert connected_components(df.limit(0)).count() == 0


# WARC

PAGES = [(1, "http://a", "x" * 200), (2, "http://b\r\nWARC/1.1", "x" * 200), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 99 + "\r\n\r\nWARC/1.1\r\n" * 9), (8, "u", "é" * 99 + "\r\n\r\nWARC/1.1\r\n" * 9), (9, "v", "y" * 300_000)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, _digest string")
    op6_warc.write_warc(df, f"{tmp_path}/w", compression=compression)
    rows = {int(r["record_id"]): r for r in op6_warc.read_warc(spark, f"{tmp_path}/w", payload=True).collect() if r["problem"] is None}
    assert sorted(rows) == [p[0] for p in PAGES]
    for i, _, html in PAGES:
        data = (html or "").encode()
        assert rows[i]["payload_bytes"] == len(data) and rows[i]["payload_digest"] == hashlib.sha256(data).hexdigest()
        assert (rows[i]["record_type"], rows[i]["refers_to"]) == {2: ("revisit", "1"), 8: ("revisit", "7")}.get(i, ("response", None))
        if i not in (2, 8):
            assert bytes(rows[i]["payload"]) == data


def test_damage_costs_the_records_that_it_hits(spark, tmp_path):
    """One archive with a member for each record: bytes are flipped, cut out and put in, and all other records come back."""
    rng = np.random.default_rng(3)
    pages = [(i, f"http://h/{i}", bytes(rng.integers(32, 127, 300 + i, dtype=np.uint8)).decode()) for i in range(1000)]
    op6_warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/w", date="2020-01-01T00:00:00Z")
    file = max(glob.glob(f"{tmp_path}/w/small/part-*"), key=os.path.getsize)
    with open(file, "rb") as f:
        data = bytearray(f.read())
    assert len(gzip.decompress(data)) > 100_000  # an ordinary archive
    ends = [m.start() for m in re.finditer(re.escape(op6_warc.GZIP), bytes(data))]
    data[ends[120] : ends[120]] = b"garbage"
    data[ends[110] : ends[110] + 9] = b""
    for k in (3, 50, 51, 100):
        data[ends[k] + 40] ^= 0x5A
    with open(file, "wb") as f:
        f.write(bytes(data))
    for checksum in glob.glob(f"{tmp_path}/w/small/.*.crc"):
        os.remove(checksum)
    found = op6_warc.read_warc(spark, f"{tmp_path}/w")
    back = {int(r["record_id"]) for r in found.filter("problem IS NULL").collect()}
    assert len(back) == 995
    assert op6_warc.quarantined(found, 995).count() == 5  # neighbours share a gap, or what was put in has its own
    with pytest.raises(ValueError):
        op6_warc.quarantined(found, 1000)


def test_long_records_go_on_in_more_members(spark, tmp_path):
    html = "".join(chr(97 + i % 26) * (i % 7) for i in range(600_000))
    op6_warc.write_warc(spark.createDataFrame([(1, "u", html * 10), (2, "u", html * 10), (3, "u", "z" * 200)], "page_id long, url string, html string"), f"{tmp_path}/w")
    assert len(html) * 10 > op6_warc.MEMBER
    rows = {r["record_id"]: r for r in op6_warc.read_warc(spark, f"{tmp_path}/w").collect()}
    assert {k: r["record_type"] for k, r in rows.items()} == {"1": "response", "2": "revisit", "3": "response"}
    assert rows["1"]["payload_bytes"] == len(html) * 10 == rows["2"]["payload_bytes"] and rows["2"]["refers_to"] == "1"


def records(n):
    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * 20
        out.append(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Payload-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n")
    return out


def test_salvage_after_damage():
    plain = records(6)
    data = plain[0] + plain[1][:-30] + plain[2] + b"garbage" + plain[3].replace(b"payload 3", b"payload 9", 1) + plain[4] + plain[5][:50]
    found = list(op6_warc.salvage(data))
    assert [r[4]["record_id"] for r in found if r[4]] == ["0", "2", "4"]
    assert sum(r[2] for r in found) == len(data) and all(r[3] for r in found if not r[4])
    at = 0
    for offset, _, size, _, _ in found:
        assert offset == at
        at += size


def test_salvage_of_broken_members():
    members = [gzip.compress(r, mtime=0) for r in records(5)]
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 255
    data = members[0] + bytes(broken) + members[2] + members[3][:-9] + members[4]
    found = list(op6_warc.salvage(data))
    assert {"0", "2", "4"} <= {r[4]["record_id"] for r in found if r[4]}
    assert sum(1 for r in found if r[3]) == 2
    assert list(op6_warc.salvage(b"")) == [] and [r[3] is None for r in op6_warc.salvage(b"no archive")] == [False]


# conversations


@pytest.fixture(scope="module")
def chats(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} of {'all' if t < 2 else c % 3}") for c in range(60) for t in range(1 + c % 5)]
    rows += [(100, 0, "system", "</s>[INST] <|turn|>\\<|end|> \\\\ <|text|>"), (100, 1, "assistant", None), (100, 2, None, "x"), (100, None, "user", "first"), (100, 2, None, "x"), (101, 0, "assistant", "é👩‍👩‍👧"), (None, 0, "user", "lost")]
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string"), rows


@pytest.mark.parametrize("most", [65_536, 200])
def test_chats_read_back(spark, chats, most):
    df, rows = chats
    ids, sequences = op8_chat.format_chats(df, most)
    found = {r["conv_id"]: r for r in ids.join(op8_chat.read_back(sequences), "key").collect()}
    own = collections.defaultdict(list)
    for c, t, role, text, in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(found) == set(own)
    for c, turns in own.items():
        turns.sort()
        loss = "".join(x for _, _, role, x in turns if role == "assistant")
        assert found[c]["n_turns"] == len(turns) and found[c]["loss_chars"] == len(loss)
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert found[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    written = sequences.collect()
    text_of = op3_bpe.decoder(op3_bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.json")))
    decoded = lambda ids: text_of(np.array(ids, "<u4").tobytes())
    for s in written:
        at = first = 0
        assert decoded(s["ids"]) == s["text"] and len(s["ids"]) == len(s["positions"])
        for n in s["nodes"]:  # depth first, nothing between, positions and attention as if only ancestors stood before
            tokens = n["tokens"]
            assert n["start"] == at and tokens["start"] == first
            at, first = n["end"], tokens["end"]
            assert decoded(s["ids"][tokens["start"] : first]) == s["text"][n["start"] : at]
            if n["loss"]:
                assert decoded(s["ids"][n["loss_tokens"]["start"] : n["loss_tokens"]["end"]]) == s["text"][n["loss"]["start"] : n["loss"]["end"]]
            assert s["positions"][tokens["start"] : first] == list(range(n["position"], n["position"] + first - tokens["start"]))
            assert sum(a["end"] - a["start"] for a in n["attends_tokens"]) == n["position"] and (n["parent"] == -1) == (n["position"] == 0)
            for span, attends in (((lambda x: (x["start"], x["end"])), n["attends"]), ((lambda x: (x["tokens"]["start"], x["tokens"]["end"])), n["attends_tokens"])):
                ancestors, p = [], n["parent"]
                while p >= 0:
                    ancestors.append(span(s["nodes"][p]))
                    p = s["nodes"][p]["parent"]
                inside = {i for a, b in ancestors for i in range(a, b)}
                assert inside == {i for a in attends for i in range(a["start"], a["end"])}
        assert at == len(s["text"]) and first == len(s["ids"])
    if most > 1000:
        assert sum(len(s["text"]) for s in written) < sum(r["formatted_chars"] for r in found.values()) / 2


def test_no_chats(chats):
    ids, sequences = op8_chat.format_chats(chats[0].limit(0))
    assert ids.count() == sequences.count() == 0


# pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    bad = {r["doc_id"] for r in spark.read.parquet(f"{TINY}/labels.parquet").filter("quality = 0").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TINY)
        assert out.columns == columns
        kept = {r["doc_id"] for r in out.collect()}
        assert kept <= ids and (name != "pii" or kept == ids)
        if name == "quality":
            assert len(kept & bad) <= 0.15 * len(bad)
        if name == "pii":
            assert out.filter("n_chars <> length(text)").count() == 0
        docs, ids = out, kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, TINY)
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert collections.Counter(r["doc_id"] for r in corpus_pipeline.run(spark, TINY).collect()) == collections.Counter(r["doc_id"] for r in packed.collect())


def test_spare_names(spark):
    assert spare(spark.range(1).selectExpr("id AS `_A`"), "_a") == "_a_"
