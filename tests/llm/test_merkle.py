import hashlib
import random
import zlib

from pyspark.sql import functions as F

from quillgraph.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row):
    i, text, lang, source, n = row
    return h("".join(map(field, (i, source, lang, n, text))))


def climb(nodes):
    """Root, and for each node the siblings' digests on its way up with its place among them."""
    level, ways, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for x, place in enumerate(at):
            run = runs[place // 8]
            ways[x].append((run[: place % 8], run[place % 8 + 1 :]))
            at[x] = place // 8
        level = [h("".join(r)) for r in runs]
    return level[0], ways


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        mine = sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[g] = mine, *climb([leaf(r) for r in mine])
    root, over = climb([trees[g][1] for g in langs]) if langs else (None, [])
    out = []
    for g, up in zip(langs, over, strict=True):
        mine, subroot, ways = trees[g]
        for r, way in zip(mine, ways, strict=True):
            way = way + up
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            d = leaf((r[0], text, *r[2:]))
            for left, right in way:
                d = h("".join([*left, d, *right]))
            out.append((r[0], leaf(r), subroot, root, h("".join("".join([*a, *b]) for a, b in way)), d, d == root))
    return sorted(out, key=str)


def check(spark, rows):
    got = merkle.tamper_check(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_against_the_whole_tree_built_at_once(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Abc", "x\u00e9", "", None, "long " * 3000, f"T{i}"]), "en", rng.choice(["a", "b", None]), rng.choice([1, None])) for i in rng.sample(range(10**6), 1100)]
    rows += [(i, f"De {i}", "de", "s", 1) for i in range(513)] + [(i, "Es", "es", "s", 1) for i in range(9)] + [(5, "one", "fr", "s", 1)]
    rows += [(i, "n", None, None, None) for i in range(8)] + [(None, "no Id", "en", "s", 1), (None, None, "en", None, None), (77, "Z", "\u00e9", "s", 1), (78, "Z", "\U0001f600", "s", 1)]
    check(spark, rows)


def test_repeated_rows_lone_leaves_and_no_rows(spark):
    check(spark, [(1, "Same Text", "en", "s", 1)] * 700 + [(1, "Other", "en", "s", 1)] * 3)
    check(spark, [(3, "Alone", "en", "s", 1)])
    check(spark, [(i, "A", f"l{i:02}", "s", 1) for i in range(75)])
    assert merkle.tamper_check(spark.createDataFrame([], SCHEMA)).collect() == []


def test_further_columns_and_the_witness(spark):
    rows = [(i, f"text {i}", "en", "s", i, "t", 1) for i in range(70)]
    docs = spark.createDataFrame(rows, f"{SCHEMA}, digest string, pos int")
    found = merkle.manifest(docs, merkle.FIELDS)
    again = found.where(merkle.folded(F.col("leaf"), F.col("witness")) == F.col("root"))
    assert again.count() == 70 and {r.root for r in found.collect()} == {brute([r[:5] for r in rows])[0][3]}


def test_append_extends_witnesses_of_what_stands_before():
    stream = merkle.Appender(2)
    for i in range(11):
        stream.append(f"{i:064}")
        first = stream.runs[0][0]
        assert len(first) == min(i + 1, 8)  # the first leaf's witness grows until its run is whole
    assert len(stream.runs[1]) == 1 and len(stream.runs[1][0]) == 1
    stream.close()
    assert stream.root == merkle._hash(merkle._hash("".join(f"{i:064}" for i in range(8))) + merkle._hash("".join(f"{i:064}" for i in range(8, 11))))
    assert [merkle.levels_of(n) for n in (1, 2, 8, 9, 64, 65, 512, 513)] == [0, 1, 1, 2, 2, 3, 3, 3]
