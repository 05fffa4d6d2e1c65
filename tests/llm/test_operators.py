"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, against plain versions."""

from __future__ import annotations

import hashlib
import math
import os
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from plain import LOWER, SPACES, contamination, crc, least_reachable, plain_words, simhash, space_words

from tessella.llm import ann, common, components, decontaminate, language_id, line_dedup, lm_scoring, near_dup, packing, simhash as sim, token_store, tokens, url_filter, warc

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
LONG = " ".join(f"word{k % 977}" for k in range(30_000)) + "\nsame line\n" + "x" * 50_000
TEXTS = [
    (0, "Same line\nOne two THREE four five six seven eight nine ten eleven"), (1, None), (2, ""), (3, " \n\t\n"), (4, LONG), (5, "same LINE \nother"), (6, "same line"), (6, "same line"), (7, "  two  spaces\nÉté à la plage. Don't!\t"),
    (8, "one two three four five six seven eight nine ten eleven twelve"), (None, "same line\nnull id"), (9, "<|endoftext|> 日本語 ½ x²"), (10, "same line"), (11, "same line\n\n"), (12, "a.b,,c!!d"), (6, "another text of id six"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if t else None, f"src{k % 3}" if k % 4 else None, k, k) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rep long")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    out = {}
    for path in (BYTE, WORD):
        out[path] = Tokenizer.from_file(path)
        out[path].encode_special_tokens = True
    return lambda path, text: out[path].encode(text or "", add_special_tokens=False).ids


# 1


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?q", "http://sub.example.net/en/#f", "http://example.com/de/", "http://x.org/fr/", "http://org/fr", "no scheme", "", None, "http://notexample.net.org/en/", "x://a.net", "http://a.net://b", "ftp://net/"]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)] + [(0, urls[0], "clash"), (None, urls[1], "clash")], "page_id long, url string, rule string")
    got = url_filter.match_urls(pages, url_filter.rules_frame(spark, url_filter.OP1_RULES), "page_id").collect()

    def plain(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
        fits = [(h + p, v) for h, p, v in url_filter.OP1_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
        return host, path, *best

    assert sorted([(r.host, r.path, r.rule, r.verdict) for r in got], key=str) == sorted([plain(u) for u in [*urls, urls[0], urls[1]]], key=str)
    assert url_filter.match_urls(pages.where("false"), url_filter.rules_frame(spark, url_filter.OP1_RULES), "page_id").count() == 0
    assert {r.verdict for r in url_filter.match_urls(pages, url_filter.rules_frame(spark, []), "page_id", default="block").collect()} == {"block"}


# 2


def line_key(line):
    return line.strip(SPACES).translate(LOWER)


@pytest.mark.parametrize("first", [False, True])
def test_line_dedup(docs, none, first):
    got = line_dedup.dedup_lines(docs, min_docs=4, keep_first=first).select("rep", "text", "n_lines", "n_dropped", "n_chars").collect()
    found = {}
    for i, t in TEXTS:
        for line in (t or "").split("\n"):
            found.setdefault(line_key(line), set()).add(i)
    gone = {k for k, ids in found.items() if k and len(ids) >= 4}
    assert gone == {"same line"}
    if not first:
        for r in got:
            lines = (TEXTS[r.rep][1] or "").split("\n")
            kept = [x for x in lines if line_key(x) not in gone]
            assert (r.text, r.n_lines, r.n_dropped, r.n_chars) == ("\n".join(kept), len(lines), len(lines) - len(kept), r.rep)
    else:
        assert sum(r.n_dropped for r in got) == sum(line_key(x) in gone for _, t in TEXTS for x in (t or "").split("\n")) - 1
    assert line_dedup.dedup_lines(none).count() == 0


def test_line_dedup_of_many_lines(spark):
    many = spark.range(12).selectExpr("id AS doc_id", "concat_ws('\n', transform(sequence(0, 999), x -> if(x % 3 = 0, concat('common ', x), concat(id, ' own ', x)))) AS text")
    r = line_dedup.dedup_lines(many).first()
    assert (r.n_lines, r.n_dropped) == (1000, 334) and "common" not in r.text


# 3


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 12)) * rng.uniform(0.2, 3, size=(600, 1))
    x[7] = x[9]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x.astype("f4"))]
    odd = [(1000, None, 1), (1001, [0.0] * 12, 1), (1002, [None] + [1.0] * 11, 1), (1003, [math.nan] * 12, 1), (1004, [math.inf] + [1.0] * 11, 1), (1005, [1.0, 2.0], 1), (None, x[3].tolist(), 1)]
    v = spark.createDataFrame(rows + odd + [rows[5]], "vec_id long, embedding array<float>, rank int")
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), k=10, block_rows=200, query_rows=16).collect()
    e = x.astype("f4").astype("f8")
    hits = 0
    for q in range(0, 600, 20):
        mine = sorted([r for r in got if r.query_id == q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and len({r.vec_id for r in mine}) == 10
        assert all(abs(r.score - e[q] @ e[r.vec_id]) < 1e-9 and r.vec_id != q for r in mine)
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        s = e @ e[q]
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(600), -s))[:10]) & {r.vec_id for r in mine})
    assert hits / 300 >= 0.9 and {r.query_id for r in got} == set(range(0, 600, 20))
    few = v.where("vec_id < 4")
    assert ann.nearest(few, few.where("vec_id = 0"), k=10).count() == 3
    assert ann.nearest(v.where("false"), v, k=10).count() == 0 and ann.nearest(v, v.where("false"), k=10).count() == 0


def recall_and_share(x, n_queries=40):
    """recall@20 of the first rows as queries, and the share of rows that are scored for a query."""
    n, scale = len(x), float(np.linalg.norm(x, axis=1).max()) * (1 + 1e-9)
    q = x[:n_queries]
    unit, found, scored = q / np.linalg.norm(q, axis=1, keepdims=True), [(np.empty(0, np.int64), np.empty(0))] * n_queries, 0
    directions = np.random.default_rng(ann.SEED).standard_normal((x.shape[1] + 1, ann.PROJECTIONS))
    for a in range(0, n, ann.BLOCK_ROWS):
        block = ann.Block(np.arange(a, min(a + ann.BLOCK_ROWS, n)), x[a : a + ann.BLOCK_ROWS], scale, directions)
        block.search(np.arange(n_queries), q, unit @ directions[:-1], scale, 20, found)
        scored += block.scored
    s = q @ x.T
    s[np.arange(n_queries), np.arange(n_queries)] = -np.inf
    best = np.argpartition(-s, 20, axis=1)[:, :20]
    return sum(len(set(b.tolist()) & set(ids.tolist())) for b, (ids, _) in zip(best, found, strict=True)) / (20 * n_queries), scored / n / n_queries


def test_recall_without_clusters():
    x = np.random.default_rng(4).normal(size=(65_536, 64))
    recall, share = recall_and_share(x / np.linalg.norm(x, axis=1, keepdims=True))
    assert recall >= 0.95 and share <= 0.2, (recall, share)


def test_recall_with_clusters():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(100, 64)).repeat(200, axis=0) + rng.normal(size=(20_000, 64)) * 0.4
    recall, share = recall_and_share(rng.permutation(x))
    assert recall >= 0.95 and share <= 0.02, (recall, share)


def test_query_rows_that_share_an_id(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (3, [-1.0, -1.0])], "vec_id long, embedding array<float>")
    got = ann.nearest(v, v.where("vec_id = 0"), k=3).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 1] and all(r.query_id == 0 for r in got)


# 4


def test_components(spark):
    links = [(5, 3), (3, 9), (9, 12), (1, 1), (20, 21), (21, 20), (None, 4)] + [(k, k + 1) for k in range(100, 160)]
    got, slow = ({r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long"), one_task=n).collect()} for n in (1000, 0))
    assert got == slow
    true = [p for p in links if None not in p and p[0] != p[1]]
    assert got == {k: v for k, v in least_reachable({x for p in true for x in p}, true).items() if k != v}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_simhash(spark, docs, hot):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while rain falls".split()
    near = [(100 + k, " ".join([*base * 12, *(["extra"] * (k % 3))])) for k in range(9)]
    rows = TEXTS + near
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sim.with_components(sim.fingerprints(df, 3), 2, hot=hot).collect()
    prints = [(i, simhash(t, 3)) for i, t in rows]
    assert sorted(((r.doc_id, r.fp % (1 << 64)) for r in got), key=str) == sorted(prints, key=str)
    known = [p for p in prints if p[0] is not None]
    links = [(a, b) for a, x in known for b, y in known if (x ^ y).bit_count() <= 2]
    want = least_reachable({i for i, _ in known}, links)
    assert all(r.component_id == want.get(r.doc_id) for r in got)


def test_simhash_of_random_prints(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**63), 2**63 - 1, 60)
    fps = np.concatenate([base, base ^ np.left_shift(1, rng.integers(0, 62, 60)), base ^ (np.left_shift(1, rng.integers(0, 31, 60)) | np.left_shift(1, rng.integers(31, 62, 60))), rng.integers(-(2**63), 2**63 - 1, 200)])
    df = spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps)], "doc_id long, fp long")
    want = least_reachable(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (int(fps[a]) ^ int(fps[b])) % (1 << 64) in _balls()])
    for how in ({}, {"hot": 0}, {"options": (2,)}, {"options": (3,), "histogram_bits": 5}, {"options": (4,), "histogram_bits": 3, "hot": 1}):
        assert {r.doc_id: r.component_id for r in sim.with_components(df, 2, **how).collect()} == want, how
    with pytest.raises(ValueError):
        sim.link_fingerprints(df.selectExpr("fp", "doc_id AS rep"), 3)


def _balls():
    return {0} | {1 << a for a in range(64)} | {1 << a | 1 << b for a in range(64) for b in range(64)}


def test_thresholds_do_the_work(spark):
    """Values that many share are avoided by thresholds of their own, without midpoints, and no link is lost."""
    rng = np.random.default_rng(14)
    base = rng.integers(0, 2**63, 3000).astype(np.uint64)
    base[:1500] = base[:1500] & ~np.uint64(0xFFFF) | np.uint64(0x1234)  # one part's value is that of half of them
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 31, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(31, 62, 200).astype(np.uint64))
    fps = np.unique(np.concatenate([base, near]))
    df = common.checkpointed(spark.createDataFrame([(k, int(f)) for k, f in enumerate(fps.view(np.int64))], "rep long, fp long"))
    plan = sim.make_plan(df, 2, (4,))
    assert all((c <= sim.HOT).all() for c in plan.counts)
    t = plan.thresholds([sim.part_value(fps, g) for g in plan.parts])
    assert (t.sum(axis=0) + 4 == 3).all() and len({tuple(x) for x in t.T}) > 1  # unequal, and not the same for all
    keys = sim._keys(df, plan, sim.crowded_values(df, plan, sim.HOT))
    assert keys.where("kind = -1").count() == 0
    links = sim.link_keys(keys, 2, 4).collect()
    balls = _balls()
    at = {int(f): k for k, f in enumerate(fps)}
    want = least_reachable(range(len(fps)), [(k, at[int(f) ^ m]) for k, f in enumerate(fps) for m in balls if m and int(f) ^ m in at])
    assert least_reachable(range(len(fps)), [(r.a, r.b) for r in links]) == want and len(set(want.values())) <= 3000


def test_parts_widen_with_the_table():
    def plan(n, parts):
        groups = [list(range(64 * k // parts, 64 * (k + 1) // parts)) for k in range(parts)]
        return sim.Plan.of(2, groups, [np.full(1 << 16, n >> 16) for _ in groups], sim.ROW_COST)

    best = [min(sim.PART_OPTIONS, key=lambda p, n=n: plan(n, p).estimate()) for n in (1 << 20, 1 << 30, 1 << 36)]
    assert best == sorted(best, reverse=True) and best[-1] == 2
    assert plan(1 << 36, 2).estimate() < 10_000  # comparisons and rows, in comparisons


def test_thresholds_keep_the_guarantee():
    rng = np.random.default_rng(0)
    counts = [rng.integers(0, 50, 1 << 16) for _ in range(4)]
    plan = sim.Plan.of(2, [list(range(16 * k, 16 * k + 16)) for k in range(4)], counts)
    t = plan.thresholds([rng.integers(0, 1 << 16, 500) for _ in range(4)])
    assert (t.sum(axis=0) + 4 == 3).all() and t.min() >= -1


def test_near_duplicates(spark, docs, none):
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(40)]
    rows = list(enumerate(texts))
    for k in range(10):
        w = texts[k].split()
        w[100] = "changed"
        rows += [(100 + k, " ".join(w)), (200 + k, texts[k].upper())]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, key int")
    assert sorted(r.doc_id for r in near_dup.drop_near_duplicates(df).collect()) == list(range(40))
    kept = near_dup.drop_near_duplicates(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(map(str, [0, 1, 4, 5, 6, 7, 8, None, 9, 12]))  # blank texts are one group, and repeats of a line
    assert near_dup.drop_near_duplicates(none).count() == 0


def test_hot_values_lose_no_pair(spark):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 16, (32, 4))  # four for each part, each of about 2,000 documents
    base = values[np.arange(32), rng.integers(0, 4, (8000, 32))].astype("<u2")
    flips = np.where(rng.random((1000, 32)).argsort(axis=1) < 11, 0b10010101010010, 0).astype("<u2")  # so many that a part's value is out of reach
    rows = [(x.tobytes(), k, k) for k, x in enumerate(np.concatenate([base, base[:1000] ^ flips]))]
    distinct = common.checkpointed(spark.createDataFrame(rows, "fp binary, rep long, label long").dropDuplicates(["fp"]))
    seen = np.array([np.frombuffer(x, "<u2") for x, _, _ in rows]).reshape(-1, 8, 4)
    parts = [list(range(16 * p, 16 * p + 16)) for p in range(4)]
    plans = [(3, parts, [np.bincount(seen[:, k, p], minlength=1 << 16) for p in range(4)]) for k in range(8)]

    def linked(hot, **how):
        links = near_dup.lane_candidates(near_dup.lane_keys(distinct, plans, hot), plans, near_dup.most_bits(0.8, slack=1.4), 8, **how).collect()
        return least_reachable({k for _, k, _ in rows}, [(r.a, r.b) for r in links])

    want = linked(10**9)
    assert sum(want[8000 + k] == want[k] for k in range(1000)) > 900 and len(set(want.values())) > 7500
    assert linked(700) == want
    assert linked(700, forest=False) == want and linked(10**9, forest=False) == want


# 5


def test_warc_roundtrip(spark, tmp_path):
    big = "é" * 700
    pages = [(1, "http://a/", big, "x"), (2, "http://b/\r\nX: y", big, "x"), (3, None, big, "x"), (4, "u", None, "x"), (5, "u", "", "x"), (6, "u", "short", "x"), (7, "u", "short", "x"), (None, "u", big, "x"), (3, "again", big, "x"), (8, "u", "a\r\n\r\nWARC/1.1\r\n" * 9000, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, payload string")
    path = str(tmp_path / "w")
    warc.write_warc(df, path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(pages)
    for r in got:
        same = [p for p in pages if p[0] == r.page_id]
        raw = (same[0][2] or "").encode()
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (1, 2, None) else ("response", None))
        assert r.payload == (None if r.record_type == "revisit" else raw)
    warc.write_warc(df.where("false"), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def test_damaged_archives():
    records = [warc.record_bytes(k, "u", b"payload %d " % k * 50, hashlib.sha1(b"payload %d " % k * 50).hexdigest(), None, False) for k in range(40)]
    whole = warc.write_archive(records)
    assert whole[:4] == (0x184D2A5D).to_bytes(4, "little") and len(list(warc.read_archive(whole))) == 40
    for bad in (whole[:-3], whole + b"stray", whole[:8] + whole[9:], warc.write_archive([records[0] + records[1]]), warc.write_archive([re.sub(rb"(\r\nContent-Length: )\d+(\r\n\r\nHTTP)", rb"\g<1>7\2", records[0])]), warc.write_archive([b"HTTP/1.1 200"])):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(bad))
    flipped = bytearray(whole)
    flipped[-20] ^= 0xFF
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(bytes(flipped)))


# 6 and 10


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_are_the_librarys(library, path):
    texts = [t or "" for _, t in TEXTS] + ["a  b\n c \n\nd", "   ", "x ", "É,b.\nÀb", "don't we're I'LL 's'", "ẞ İ ﬁ", "e\u0301 a\u0301\u0323", "tab\tq \t r", " \n a", "ªº µm", "a\x00b \x1c c", "word,.\nword", "\u2028 x\u00a0 y", "~ a ~b~"]
    assert list(tokens.PieceEncoder(path).encode(texts)) == [np.array(library(path, t), "<u4").tobytes() for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZéß ,.!'\n\t  ½²日\u0301~|_-0123\u00a0\r")), max_size=60))
def test_pieces_of_any_text(text):
    from tokenizers import Tokenizer

    for path in (BYTE, WORD):
        t = Tokenizer.from_file(path) if path not in _kept else _kept[path]
        _kept[path] = t
        assert next(tokens.encoder(path).encode([text])) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_kept: dict = {}


def test_packing(docs, none, library):
    pieces = packing.pack(packing.tokenize(docs, BYTE).cache(), window=64, min_piece=8, part_tokens=2000).collect()
    of_seq, of_doc = {}, {}
    for p in pieces:
        of_seq.setdefault(p.sequence_id, []).append(p)
        of_doc.setdefault(p.doc_id, []).append(p)
    for s in of_seq.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 64 or at & (at - 1) == 0
    want = sorted(tuple(library(BYTE, t)) + (1,) for i, t in TEXTS if i != 6)
    got = []
    for i, ps in of_doc.items():
        if i == 6:
            continue
        ps.sort(key=lambda p: p.start)
        ids = b"".join(bytes(p.ids) for p in ps)
        assert [p.start for p in ps] == [sum(q.length for q in ps[:k]) for k in range(len(ps))] and {p.doc_tokens for p in ps} == {len(ids) // 4}
        got.append(tuple(np.frombuffer(ids, "<u4").tolist()))
    assert sorted(got) == want
    assert sum(p.length for p in of_doc[6]) == sum(len(library(BYTE, t)) + 1 for i, t in TEXTS if i == 6)
    assert packing.pack_documents(none, BYTE).count() == 0


def test_windows_hold_the_mixture():
    queues = {"a": [500] * 80, "b": [300] * 40, "c": [7] * 1000}
    total = sum(map(sum, queues.values()))
    share = {s: sum(q) / total for s, q in queues.items()}
    starts = np.cumsum([0, 80, 40])
    got = np.zeros((total // 256 + 20, 3))
    for doc, _start, n, seq, _offset in packing.deal(queues, share, {}, 256, 8):
        got[seq, np.searchsorted(starts, doc, "right") - 1] += n
    full = got[got.sum(axis=1) == 256] / 256
    assert np.abs(full[:-3] - list(share.values())).max() < 0.1
    late = list(packing.deal({"a": [1000], "b": [1000]}, {"a": 0.5, "b": 0.5}, {"b": 300.0}, 256, 8))
    assert late[0][0] == 1  # the deficit carried in is served first


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=300))
def test_blocks(ids):
    a = np.array(ids, "<u4")
    assert (token_store.unpack_block(memoryview(token_store.pack_block(a))) == a).all()


def test_shards():
    ids = np.random.default_rng(0).integers(0, 50000, 20000).astype("<u4")
    raw = token_store.pack_shard(3, 1, [5, None, 9], [10000, 0, 10000], ids)
    s = token_store.Shard(raw)
    assert s.doc_ids == [5, None, 9] and (s.ids(4000, 9001) == ids[4000:9001]).all() and len(s.ids(7, 7)) == 0
    for bad in (raw[:-1], b"no", raw[:60] + b"\xff" + raw[61:]):
        with pytest.raises(ValueError):
            t = token_store.Shard(bad)
            t.ids(0, t.n_ids)


def test_token_output(spark, docs, none, library, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "RANGE_BYTES", 2000)
    path = str(tmp_path / "t")
    token_store.write_tokens(docs, path, WORD)
    got = token_store.with_starts(token_store.read_documents(spark, path)).orderBy("start").collect()
    order = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in order]
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(i), len(ids), crc(ids)) for i, ids in ((i, [*library(WORD, t), 1]) for i, t in TEXTS))
    token_store.write_tokens(none, str(tmp_path / "none"), WORD)
    assert token_store.with_starts(token_store.read_documents(spark, str(tmp_path / "none"))).count() == 0


# 7


@pytest.mark.parametrize(("block", "texts"), [(200_000, 9), (5, 1000), (5, 0)])
def test_decontamination(spark, docs, none, block, texts, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_TEXTS", texts)
    items = [(1, "two three four FIVE six seven eight nine ten eleven"), (2, "Same-line"), (3, None), (4, "..."), (None, "same line"), (2, "same line"), (10, "word3 word4 word5 word6 word7 word8 word9 word10 word11 word12 word13 word14")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_contamination(docs.withColumnRenamed("n_chars", "items"), frame, block_words=block).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        n, hit, names = contamination(r.text if r.text != LONG else LONG[:9000], [x for x in items if x[0] is not None])
        spans = [(s.begin, s.end) for s in r.spans]
        assert (r.items == ["10", "2"]) if r.text == LONG else (r.items, r.n_words, sum(b - a for a, b in spans)) == (names, n, hit)
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
    assert decontaminate.find_contamination(none, frame).count() == 0
    assert all(not r.spans for r in decontaminate.find_contamination(docs, frame.where("false")).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.lists(st.sampled_from("abc"), max_size=6), max_size=3))
def test_contamination_of_any_words(words, items):
    block = [(str(k), [w.encode() for w in x]) for k, x in enumerate(items) if x]
    text = [w.encode() for w in words]
    counts = {w: text.count(w) for w in set(text)}
    spans, names = decontaminate.find(text, decontaminate.prefix_index(block, counts, 3))
    n, hit, want = contamination(" ".join(words), [(k, " ".join(x)) for k, x in enumerate(items)], 3)
    assert (sum(b - a for a, b in spans), sorted(names)) == (hit, want) and n == len(words)


# 8


def test_language_id(spark, none):
    en = [(k, f"the cat and the dog went to the house with {k} friends and they were there", "en") for k in range(60)]
    de = [(100 + k, f"der hund und die katze gingen in das haus mit {k} freunden und sie waren dort", "de") for k in range(60)]
    odd = [(200, None, "en"), (201, "", None), (202, "123 ... !!", "de"), (203, "日本語のテキストです", None), (204, "the friends were there", None), (204, "the friends were there", None), (None, "der hund und sie waren dort", "de")]
    df = spark.createDataFrame(en + de + odd, "doc_id long, text string, lang string").withColumn("score", common.F.lit("clash"))
    model = language_id.fit(df)
    got = {(r.doc_id, r.text): r for r in language_id.identify(df, model).collect()}
    assert all(r.lang_pred == r.lang for r in got.values() if r.doc_id is not None and r.doc_id < 200)
    assert [got[k].lang_pred for k in ((200, None), (201, ""), (202, "123 ... !!"))] == ["und"] * 3
    assert got[203, "日本語のテキストです"].rejected and not got[204, "the friends were there"].rejected and got[204, "the friends were there"].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values()) and language_id.identify(df, model).count() == 127
    assert language_id.identify(none, model).count() == 0
    assert {r.lang_pred for r in language_id.identify(df, language_id.fit(none)).collect()} == {"und"}


def test_more_languages_than_sample_rows(spark):
    """The most frequent ones are learnt, within the bound."""
    words = {"aa": "tak tok tik", "bb": "zum zam zim", "cc": "pol pil pul", "dd": "gre gro gru", "ee": "wof waf wuf"}
    rows = [(k, w, lang) for n, (lang, w) in enumerate(words.items()) for k in range(100 * n, 100 * n + 10 * (n + 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample_rows=3)
    assert set(model.languages) <= {"cc", "dd", "ee"} and len(model.languages) <= 3
    model = language_id.fit(df, sample_rows=100)
    assert set(model.languages) == set(words) and all(r.lang_pred == r.lang for r in language_id.identify(df, model).collect())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_language_id_held_out(spark):
    sf = "/root/testdata/sf0.01"
    both = language_id.op8_language_id(spark, sf).join(common.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out")
    assert both.where("lang = lang_pred").count() / both.count() > 0.98


# 9


@pytest.mark.parametrize("small", [False, True])
def test_lm_scoring(spark, docs, none, small, monkeypatch):
    if small:
        monkeypatch.setattr(lm_scoring, "MERGE_WORDS", 300)
        monkeypatch.setattr(lm_scoring, "MERGE_PAIRS", 2000)
        monkeypatch.setattr(lm_scoring, "PAIR_FOLDERS", 5)
    train = common.F.col("rep") % 3 != 1
    got = lm_scoring.score_documents(docs.withColumnRenamed("n_chars", "score"), train, segment_bytes=4000 if small else 1 << 26, chunk_tokens=100 if small else 1 << 20).collect()
    assert len(got) == len(TEXTS)
    words = [[*space_words(t), None] for _, t in TEXTS]
    c, pairs = {}, {}
    for k, w in enumerate(words):
        if k % 3 != 1:
            for h, x in zip([None, *w], w, strict=False):
                c[x] = c.get(x, 0) + 1
                pairs[h, x] = pairs.get((h, x), 0) + 1
    n, v = sum(c.values()), len(c)
    want = []
    for k, (w, (i, _)) in enumerate(zip(words, TEXTS, strict=True)):
        p0 = [(c.get(x, 0) + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        score = 0.0
        for h, x, p in zip([None, *w], w, p0, strict=False):
            q = pairs.get((h, x), 0).bit_length()
            about = min(2 ** (q - 1) if q else 0, c.get(h, 0), c.get(x, 0))
            score += math.log10(0.75 * p + 0.25 * about / c[h] if c.get(h) else p)
        want.append((str(i), k % 3 != 1, len(w), sum(x in c for x in w), n, round(sum(map(math.log10, p0)), 5), round(score, 5)))
    have = [(str(r.doc_id), r.train, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got]
    assert sorted(x[:6] for x in have) == sorted(x[:6] for x in want)
    assert sum(a == b for a, b in zip(sorted(have), sorted(want), strict=True)) >= len(TEXTS) - 1  # a false positive may raise one
    assert lm_scoring.score_documents(none, train).count() == 0
    assert lm_scoring.score_documents(docs, common.F.lit(False)).where("n_known = 0").count() == len(TEXTS)


def test_probabilities_add_up_to_one_at_most(spark):
    """Of all words after each word, and of an unknown one: the score of a text is a log10 probability."""
    texts = ["a b a c a b a d a b a e a f", "b b b b a", "c d", "a b c d e f", "e e a e a"] * 3 + ["f a f b f c f d f e"]
    words = sorted({w for t in texts for w in t.split()}) + ["unknown"]
    asked = [f"{h} {w}" for h in words for w in words] + words
    rows = [(k, t, True) for k, t in enumerate(texts)] + [(1000 + k, t, False) for k, t in enumerate(asked)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, common.F.col("train")).where("NOT train").collect()}
    score = {t: got[1000 + k] for k, t in enumerate(asked)}
    # of "h w" and of "w" alone the ends differ by what follows h: p(h) p(w | h) p(end | w) over p(h) p(end | h), and p(w) p(end | w) where w starts a text
    base = {r.doc_id: r.base_score for r in lm_scoring.score_documents(docs, common.F.col("train"), weight=0.0).where("NOT train").collect()}
    assert all(abs(base[1000 + k] - sum(base[1000 + asked.index(w)] for w in t.split()) + (len(t.split()) - 1) * _end(texts)) < 1e-9 for k, t in enumerate(asked))
    c, follows = _counts(texts)
    for h in [*words, None]:
        total = 0.0
        for w in [*words, None]:
            n, v = sum(c.values()), len(c)
            p0 = (c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
            q = follows.get((h, w), 0).bit_length()
            total += 0.75 * p0 + 0.25 * min(2 ** (q - 1) if q else 0, c.get(h, 0), c.get(w, 0)) / c[h] if c.get(h) else p0
        assert total <= 1 + 1e-9, h
    for t in asked:
        want, before = 0.0, None
        for w in [*t.split(), None]:
            n, v = sum(c.values()), len(c)
            p0 = (c.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
            q = follows.get((before, w), 0).bit_length()
            want += math.log10(0.75 * p0 + 0.25 * min(2 ** (q - 1) if q else 0, c.get(before, 0), c.get(w, 0)) / c[before] if c.get(before) else p0)
            before = w
        assert abs(score[t] - want) < 1e-9


def _counts(texts):
    c, follows = {}, {}
    for t in texts:
        w = [*t.split(), None]
        for h, x in zip([None, *w], w, strict=False):
            c[x] = c.get(x, 0) + 1
            follows[h, x] = follows.get((h, x), 0) + 1
    return c, follows


def _end(texts):
    c, _ = _counts(texts)
    return math.log10((c[None] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1)))


def test_log_filter():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**63, 20000).astype(np.uint64)
    counts = rng.zipf(1.5, 20000).clip(1, 10**6)
    f = lm_scoring.LogFilter.of(hashes, counts)
    levels = f.probe(hashes)
    exact = np.floor(np.log2(counts)).astype(int) + 1
    assert (levels >= exact).all() and (levels > exact).mean() < 0.005
    assert (f.probe(rng.integers(0, 2**63, 20000).astype(np.uint64)) > 0).mean() < 0.005


def test_clashing_names(spark):
    odd = ["doc_id", "text", "_i", "_t", "_row", "_text", "_spans", "_drop", "drop", "_kept", "_gone", "fp", "rep", "spans", "lang_pred", "_0", "a.b"]
    df = spark.createDataFrame([(1, "same text\nand more", *["x"] * 15), (2, "same text\nthat is other", *["y"] * 15)], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in odd))
    plain = df.select(*[c for c in odd if c != "a.b"])
    assert line_dedup.dedup_lines(plain, min_docs=2).where("text <> 'same text' AND _kept IN ('x', 'y') AND n_dropped = 1").count() == 2
    assert near_dup.drop_near_duplicates(plain).where("_gone IN ('x', 'y')").count() == 2
    assert decontaminate.find_contamination(df, spark.createDataFrame([(1, "that is")], "item_id long, text string")).where("size(spans) = 1 AND `a.b` = 'y' AND _text = 'y'").count() == 1
    for frame in (sim.with_components(sim.fingerprints(df)), near_dup.near_duplicates(df), packing.pack(packing.tokenize(df.withColumn("source", common.F.lit("s")), BYTE).cache())):
        assert {r.doc_id for r in frame.collect()} == {1, 2}
    assert language_id.identify(df, language_id.fit(df.withColumn("lang", common.F.lit("en")))).where("lang_pred = 'en' AND _t IN ('x', 'y')").count() == 2


def test_shared_files(spark):
    out, path = common.stored(spark.range(5).toDF("x"), "kept")
    assert out.count() == 5
    common.remove_path(spark, path)
    assert plain_words("A-b 1É") == ["a", "b", "1É"]
