import random

from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import stages as pipeline
from quillgraph.llm.common import store
from quillgraph.llm.language_id import language_id
from quillgraph.llm.mixing import mixing_rates
from tests.llm.test_language_id import rows as speech
from tests.llm.test_packing import check

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def documents():
    rng = random.Random(9)
    docs = [(i, " ".join(rng.sample(t.split(), 30)), g, "s", 1) for i, t, g, _, _ in speech(200)]
    docs += [(1000 + i, docs[i % 20][1], "en", "s", 1) for i in range(60)]
    docs += [(2000, "12 34 !!", "en", "s", 1), (2001, None, "en", "s", 1), (2002, "", None, None, None)]
    return docs


def test_stages_against_brute_force(spark, tmp_path):
    spark.createDataFrame([(i, i % 4 != 1, i % 9 == 0) for i in range(0, 200, 2)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) quality", "int(toxic) toxic").write.parquet(f"{tmp_path}/labels.parquet")
    sf_dir = str(tmp_path)
    docs = spark.createDataFrame(documents(), SCHEMA).coalesce(1)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "mixing", "packing"]

    first = store(pipeline.language_stage(spark, docs, sf_dir), "a")
    verdict = {r.doc_id: r for r in language_id(docs).collect()}
    kept = {i for i, *_ in documents() if verdict[i].lang_pred != "und" and verdict[i].score >= pipeline.LEAST_SCORE}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == kept and kept >= set(range(200)) and not kept & {2000, 2001, 2002}

    second = store(pipeline.near_dedup_stage(spark, first, sf_dir), "b")
    rows = sorted(first.collect())
    groups = jaccard_groups([r.text for r in rows])
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == sorted({rows[g].doc_id for g in groups})

    third = store(pipeline.mixing_stage(spark, second, sf_dir), "c")
    rate = {r.doc_id: r.rate for r in mixing_rates(second, spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()}
    copies = {r.doc_id: r["count"] for r in third.groupBy("doc_id").count().collect()}
    assert third.columns == docs.columns and all(int(x) <= copies.get(i, 0) <= int(x) + 1 for i, x in rate.items())

    once = third.dropDuplicates(["doc_id"])
    check([r.text for r in once.orderBy("doc_id").collect()], [r.doc_id for r in once.orderBy("doc_id").collect()], pipeline.packing_stage(spark, once, sf_dir).collect(), 1024)


def test_repeated_rows_and_no_rows(spark, tmp_path):
    rows = [(1, "the same words over here", "en", "s", 1)] * 3 + [(1, "the same words over here", "en", "t", 1), (2, "a quite different text now", "en", "s", 1), (None, "the same words over here", None, None, None)]
    got = pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 2]
    none = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard_groups(texts):
    """Index -> smallest index reachable over pairs with a similarity of 0.8 or more, all pairs compared."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def edited_copies():
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    common, texts = fresh(12), []
    for _ in range(40):
        base = fresh(rng.randint(20, 150))
        texts.append(base)
        for _ in range(rng.randint(0, 5)):
            copy = list(rng.choice(texts[-3:]))
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = "edited"
            texts.append(copy)
        texts.append(common + fresh(rng.randint(1, 60)))
    texts += [["one"], ["ONE"], ["one", "two"], common, [*common, "more"]]
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_edited_copies_against_brute_force_jaccard(spark):
    texts = edited_copies()
    want = jaccard_groups(texts)
    assert 20 < len(texts) - len(set(want)) < len(texts) / 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in pipeline.near_dedup_stage(spark, docs, "").collect()) == sorted(set(want))


def test_components_without_ids_and_ids_with_unlike_texts(spark):
    a, b, c = "the same words over and over here", "one more text that stands alone now", "and a third one with other words"
    rows = [(None, a, "en", "s", 1), (None, a, "en", "t", 1), (None, a, "en", "s", 1), (None, None, "en", "s", 1), (None, None, None, "en", 1)]
    rows += [(5, b, "en", "s", 1), (5, c, "en", "s", 1), (7, b, "en", "s", 1), (7, c, "en", "s", 1)]
    got = pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, a), (5, c), (5, b)]
    assert all(tuple(r) in rows for r in got)


def test_trees_find_most_links_and_shards_are_split(spark, monkeypatch):
    from quillgraph.llm import simhash_similar as similar

    texts = edited_copies()
    docs = store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "d")
    sets = store(similar.shingle_sets(docs, ["doc_id"]), "t")
    keys = similar.leading(sets).withColumn("c", F.col("sig"))
    got = {frozenset(r) for r in similar._verified(similar.tree_links(keys, 0), docs, similar._nodes(sets)).collect()}
    final = {frozenset((r.sig, r.component)) for r in similar.similar_components(sets, docs).collect() if r.sig != r.component}
    assert len(got) >= 0.8 * len(final)
    want = jaccard_groups(texts)
    for rows in (3, 4096):
        monkeypatch.setattr(similar, "SHARD_ROWS", rows)
        named = similar.similar_components(sets, docs)
        of = sets.join(named, "sig", "left").select("doc_id", F.coalesce("component", "sig").alias("c")).groupBy("c").agg(F.collect_list("doc_id").alias("ids"))
        assert sorted(sorted(r.ids) for r in of.collect()) == sorted(sorted(i for i, w in enumerate(want) if w == g) for g in set(want))


def test_room_pairs_against_plain_ints():
    """No pair that can be similar is pruned, in shards of any size; what is left is what the bounds say."""
    from quillgraph.llm import simhash_similar as similar

    rng = random.Random(12)
    for m in (2, 3, 4, 5, 6, 17, 50):
        for spread in (3, 60, 400):
            base = {rng.getrandbits(64) for _ in range(spread)}
            sets = []
            for _ in range(m):
                gone = set(rng.sample(sorted(base), rng.randint(0, max(1, spread // 8))))
                sets.append((base - gone) | {rng.getrandbits(64) for _ in gone} or base)
            arrays = [similar.np.array(sorted(s), similar.np.uint64) for s in sets]
            maps = [similar._bitmap(a) for a in arrays]
            n, at, c = [len(s) for s in sets], [rng.randint(0, len(s) // 6) for s in sets], [rng.randrange(m) for _ in sets]
            for block in ([0] * m, [rng.randrange(2) for _ in range(m)]):
                split = len(set(block)) > 1
                got = {tuple(sorted(p)) for p in similar._room_pairs(list(range(m)), c, n, at, block, [x.view(similar.np.int64).tolist() for x in maps])}
                want = set()
                for i in range(m):
                    for j in range(i):
                        room = c[i] != c[j] and not (split and block[i] == block[j]) and 9 * min(n[i] - at[i], n[j] - at[j]) >= 4 * (n[i] + n[j])
                        differ = (int.from_bytes(maps[i].tobytes(), "big") ^ int.from_bytes(maps[j].tobytes(), "big")).bit_count()
                        if room and 9 * differ <= n[i] + n[j]:
                            want.add((j, i))
                        if room and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                            assert (j, i) in got
                assert got == want


def test_stars_of_edited_copies_are_one_group_each(spark):
    """300 groups of a text, four copies with one edit each, and one with two."""
    rng = random.Random(77)
    rows, group = [], []
    for g in range(300):
        base = [f"g{g}x{rng.randrange(10**6)}" for _ in range(rng.randint(110, 200))]
        for edits in (0, 1, 1, 1, 1, 2):
            copy = list(base)
            for at in rng.sample(range(5, len(base) - 5), edits):
                copy[at] = f"e{rng.randrange(10**9)}"
            rows.append((len(rows), " ".join(copy), "en", "s", 1))
            group.append(g)
    want = jaccard_groups_within([r[1] for r in rows], group)
    kept = pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(want)) and len(kept) == 300


def jaccard_groups_within(texts, group):
    by = {}
    for i, g in enumerate(group):
        by.setdefault(g, []).append(i)
    out = [0] * len(texts)
    for ids in by.values():
        for i, r in zip(ids, jaccard_groups([texts[i] for i in ids]), strict=True):
            out[i] = ids[r]
    return out


def test_columns_of_any_name_pass(spark):
    rows = [(1, "the same words over here", 7, "x", 2.0), (2, "the same words over here", 8, "y", 3.0), (3, "other words stand over there", 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_ long, sig string, text_ double")
    got = pipeline.near_dedup_stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]
