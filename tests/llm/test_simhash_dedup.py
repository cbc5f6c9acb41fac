import random
import re

import numpy as np
import xxhash

from quillgraph.llm.simhash_dedup import fingerprints, shard_forest, simhash_components, simhash_links

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64)) if hashes else 0


def components(prints, radius=2):
    """id -> smallest id reachable, by comparing all pairs."""
    ids = list(range(len(prints)))
    root = ids[:]

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in ids[:i]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in ids]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = "the of And ÉTÉ straße a b c d e f g h".split()
    texts = [None, "", " \t\n", "one", "one two", "ONE\x0btwo", "a b c", "a  b\x0cc", "x\x85y z", "w " * 5000]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 8))) for _ in range(150)]
    texts += texts[20:40]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [plain(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    assert [got[i].component_id for i in range(len(texts))] == components(prints)


def test_crowded_shards_are_dealt_again(spark):
    rng = random.Random(5)
    base = rng.getrandbits(64)
    near = {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 6))) for _ in range(300)} | {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(near)
    rows = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for shard_rows in (8, 60, 4096):
        root = {p: p for p in prints}

        def top(p, root=root):
            while root[p] != p:
                p = root[p]
            return p

        for r in simhash_links(rows, 2, shard_rows).collect():
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            assert (a ^ b).bit_count() <= 2
            root[top(a)] = top(b)
        want = components(prints)
        assert len({(want[i], top(p)) for i, p in enumerate(prints)}) == len(set(want)) == len({top(p) for p in prints})


def test_forest_never_gives_all_pairs():
    points = np.arange(4, dtype=np.uint64)
    assert len(shard_forest(points, 2)) == 3


def test_null_ids_repeats_and_no_rows(spark):
    rows = [(None, "same text here", "", 0), (5, "same text here", "", 0), (5, "same text here", "", 0), (None, "alone", "", 0)]
    got = simhash_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, 5), (5, 5), (5, 5)]
    assert simhash_components(spark.createDataFrame([], SCHEMA)).count() == 0
    assert fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
