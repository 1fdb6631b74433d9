import numpy as np
import pytest
import xxhash

from paysift.llm.graph import components
from paysift.llm.simhash import fingerprint, links, near_duplicates, ring_masks
from tests.llm.conftest import ODD, PROSE


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(ids, prints, distance=3):
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [min((x for x, g in zip(ids, group) if g == mine and x is not None), default=None) for mine in group]


@pytest.mark.parametrize("text", [t for _, t in ODD] + [PROSE.upper(), "a b", "a b c"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain(text)


def test_fingerprint_of_pieces():
    text = " ".join(f"w{i % 977}" for i in range(300_000))
    assert fingerprint(text.encode()) == plain(text)


def test_rings_hold_every_small_difference():
    masks = [m for _, m in ring_masks(3)]
    assert len(masks) == 24 and all(bin(m).count("1") == 32 for m in masks)
    rng = np.random.default_rng(1)
    for _ in range(3000):
        bits = rng.choice(64, 3, replace=False)
        d = sum(1 << int(b) for b in bits)
        assert any(not d & m for m in masks)


def test_links_join_what_brute_force_joins(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    values = set(base)
    for x in base[:15]:
        for _ in range(30):
            values.add(x ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False)))
    values = sorted(values)
    rows = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    for block in (8, 1024):
        root = {r.node: r.root for r in components(links(rows, 3, block)).collect()}
        got = [root.get(v - 2**64 if v >= 2**63 else v, v - 2**64 if v >= 2**63 else v) for v in values]
        want = smallest(list(range(len(values))), values)
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_documents(docs):
    rows = [*ODD, (20, PROSE), (21, PROSE.replace("dawn", "dusk"))]
    got = near_duplicates(docs(*rows)).collect()
    prints = [plain(t) for _, t in rows]
    want = sorted((str(i), f"{p:016x}", str(c)) for (i, _), p, c in zip(rows, prints, smallest([i for i, _ in rows], prints)))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == want


def test_no_documents(docs):
    assert near_duplicates(docs((1, "a")).where("false")).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(7, 7), (100, 101), (101, 100), (100, 101)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(51)) and found[100] == found[101] == 100
