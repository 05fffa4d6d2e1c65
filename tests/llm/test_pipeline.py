"""The pipeline against a plain version of its stages, on the smallest tables."""

from __future__ import annotations

import os

import numpy as np
import pytest
from plain import LOWER, SPACES, contamination, least_reachable, space_words

import corpus_pipeline
from tessella.llm import near_dup
from tessella.llm.common import stored, table
from tessella.llm.language_id import ngram_counts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = table(spark, SF, "documents")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out, _ = stored(stage(spark, docs, SF), name.replace(" ", "-"))
        rows = out.collect()
        if name == "language ID":
            gone = before.keys() - {r.doc_id for r in rows}
            assert all(ngram_counts(t) is None or len(t) < 20 for i, t in before.items() if i in gone)
        if name == "line dedup":
            found = {}
            for i, t in before.items():
                for line in t.split("\n"):
                    found.setdefault(line.strip(SPACES).translate(LOWER), set()).add(i)
            key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            for r in rows:
                left = "\n".join(line for line in before[r.doc_id].split("\n") if not key(line) or len(found[key(line)]) < 10)
                assert r.text == (left if left.strip(SPACES) else before[r.doc_id])  # a document that would be left blank stays whole
            assert len(rows) == len(before)
        if name == "near duplicates":
            groups = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
            assert {r.doc_id for r in rows} == set(groups.values())
            exact = {}
            for i, t in before.items():
                exact.setdefault(" ".join(t.lower().split()), []).append(i)
            kept = {r.doc_id for r in rows}
            assert all(len(kept & set(ids)) == 1 or len({groups[i] for i in ids}) == 1 for ids in exact.values())
            sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in ((i, space_words(t)) for i, t in before.items())}
            links = [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and (x == y or len(x & y) >= 0.8 * len(x | y))]
            want = least_reachable(sets, links)
            assert all(want[i] == want[g] for i, g in groups.items()) and sum(groups[i] != want[i] for i in want) <= 0.02 * len(want)
        if name == "decontamination":
            dirty = {i for i, t in before.items() if contamination(t, items)[1]}
            assert {r.doc_id for r in rows} == before.keys() - dirty and dirty
        if name != "packing":
            assert out.columns == list(corpus_pipeline.COLUMNS) and rows
            docs = out
        seen[name] = rows
    assert {p.doc_id for p in seen["packing"]} == {r.doc_id for r in seen["decontamination"]}
    assert all(sum(p.length for p in seen["packing"] if p.doc_id == i) == n for i, n in {(p.doc_id, p.doc_tokens) for p in seen["packing"]})
    want = sorted((p.doc_id, p.start, p.ids_crc32) for p in seen["packing"])
    assert sorted((p.doc_id, p.start, p.ids_crc32) for p in corpus_pipeline.run(spark, SF).collect()) == want


@pytest.mark.parametrize("gap", ["\n", "\n\n"])
def test_copies_keep_one(spark, gap):
    words = [f"{a}{b}" for a in ("river", "stone", "garden", "winter", "letter") for b in ("s", "like", "side", "less", "work")]
    prose = gap.join(" ".join(words[k:] + words[:k]) for k in range(6))
    texts = [prose] * 12 + [" ".join(words[k:] + words[::-1]) + "\nSubscribe now" for k in range(12)] + ["Subscribe now", None, ""]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    lines, _ = stored(corpus_pipeline.line_stage(spark, docs, SF), "lines")
    got = {r.doc_id: r for r in lines.collect()}
    assert all(got[i].text == prose and got[i].n_chars == len(prose) for i in range(12))
    assert all(got[i].text == texts[i].split("\n")[0] and got[i].n_chars == len(got[i].text) for i in range(12, 24))
    assert got[24].text == "Subscribe now"
    left = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, lines, SF).collect()]
    assert [i for i in left if i < 12] == [0] and 24 in left


def test_near_duplicates_against_shingle_sets(spark):
    rng = np.random.default_rng(11)
    texts = {}
    for level, j in enumerate((0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)):
        lost = int(396 * (1 - j) / (1 + j))  # shingles of 400 words
        for k in range(40):
            words = [f"w{x}" for x in rng.integers(0, 20_000, 400)]
            at = int(rng.integers(5, 390 - lost))
            i = 100 * level + k
            texts[i] = " ".join(words)
            words[at : at + lost - 4] = [f"n{x}" for x in rng.integers(0, 20_000, lost - 4)]
            texts[1000 + i] = " ".join(words)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    group = {r.doc_id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
    shares = []
    for low, high in ((0.55, 0.675), (0.675, 0.775), (0.8, 0.825), (0.845, 1)):
        found = [group[a] == group[b] for (a, b), j in alike.items() if low <= j < high]
        shares.append(sum(found) / len(found))
    few, some, most, all_ = shares
    assert few == some == 0 and most >= 0.9 and all_ >= 0.99, shares
    left = {r.doc_id for r in near_dup.drop_near_duplicates(docs).collect()}
    gone = texts.keys() - left
    assert all(max((j for p, j in alike.items() if i in p), default=0) >= 0.8 for i in gone)  # nothing goes without a text like it


@pytest.mark.parametrize("shuffled", [False, True])
def test_groups_fall_apart_where_pairs_fail(spark, shuffled):
    """Loose groups, in which many candidates prove not alike, end as single linkage by brute force has them."""
    rng = np.random.default_rng(12)
    texts = {}
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(300)]
        for k in range(60):
            words = list(base)
            for at in rng.choice(295, int(rng.integers(0, 14)), replace=False):
                words[at] = f"x{rng.integers(10**9)}"
            texts[int(rng.integers(10**6)) * 10 + g] = " ".join(words)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = least_reachable(sets, links)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), broadcast_ids=0 if shuffled else 1000, hot=50 if shuffled else 4000).collect()}
    assert len(set(want.values())) > 12 and all(want[a] == want[b] for a, b in got.items())  # no link that is none
    lost = sum(got[a] != got[b] for a, b in links)
    assert lost <= 0.01 * len(links) and sum(got[i] != want[i] for i in want) <= 0.05 * len(want)
