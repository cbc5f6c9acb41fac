"""Queries that SQL cannot say, as it has no such ratio: against all pairs on the small tables."""

import difflib

from quillgraph.operators import linking as l
from quillgraph.plans import linking_queries as lq
from quillgraph.plans import retrieval_queries as rq
from quillgraph.plans import source_queries as sq

SF = "/root/testdata/sf0.001"


def grams(text):
    padded = f" {text.lower()} "
    return {padded[i : i + 3] for i in range(max(1, len(padded) - 2))}


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio()


def names(concepts):
    """cui -> its aliases, and cui -> its type."""
    out = {c.cui: sorted({x.strip().lower() for x in [c.label, *(c.lang_labels or {}).values(), *(c.synonyms or [])] if x and x.strip()}) for c in concepts}
    return out, {c.cui: c.asDict().get("entity_type") for c in concepts}


def linked(text, kind, aliases, kinds, pool=50):
    """(cui, score) by comparing with every alias."""
    scored = {}
    for cui, known in aliases.items():
        best = max(((len(grams(text) & grams(a)) / (len(grams(text)) * len(grams(a))) ** 0.5, a) for a in known), default=(0, ""))
        if best[0] > 0:
            scored[cui] = best
    top = sorted(scored, key=lambda c: (-scored[c][0], c))[:pool]
    own = [c for c in top if kinds[c] == kind] or top
    if not own:
        return None
    least = 0.75 if text.isascii() else 0.70
    string = {c: max(ratio(text.lower(), scored[c][1]), 0) for c in own}
    string = {c: x if x >= 0.70 else 0.0 for c, x in string.items()}
    direct = [c for c in own if scored[c][0] >= least]
    if direct:
        c = max(direct, key=lambda c: (scored[c][0], string[c], c))
        return c, scored[c][0]
    lexical = [c for c in own if string[c] >= 0.70]
    if lexical:
        c = max(lexical, key=lambda c: (string[c], scored[c][0], c))
        return c, string[c]
    return None


def test_link_mentions_over_all_parts(spark):
    concepts = lq.concepts(spark, SF).collect()
    aliases, kinds = names(concepts)
    rows = lq.link_mentions(spark, SF).collect()
    asked = {(c.label[:4] + c.label[5:], c.entity_type) for c in concepts}
    assert {(r.text, r.entity_type) for r in rows} == asked
    for r in rows:
        want = linked(r.text, r.entity_type, aliases, kinds)
        assert (r.linked, r.link_score) == (want is not None, want and round(want[1], 6))


def test_exact_names_and_others_of_small_tables(spark):
    concepts = spark.createDataFrame(
        [("A", "Warfarin", "Drug", ["coumadin"], {"de": "Warfarin"}), ("B", "warfarin", "Drug", [], None), ("C", "Warfarin", "Disease", [], None), ("D", "Nierenversagen", "Disease", None, {"zh": "肾衰竭"}), ("E", "ininin", "Drug", [], None), ("F", "inininin", "Drug", [], None)],
        "cui string, label string, entity_type string, synonyms array<string>, lang_labels map<string,string>",
    )
    texts = [("Warfarin", "Drug"), ("warfarin", "Disease"), ("WARFARINE", "Drug"), ("coumadin", "Disease"), ("肾衰竭", "Disease"), ("肾衰", "Disease"), ("ininin", "Drug"), ("inininin", "Drug"), ("zz", "Drug"), ("", "Drug")]
    mentions = spark.createDataFrame([(*t, 0.9) for t in texts], "text string, entity_type string, confidence double")
    aliases, kinds = names(concepts.collect())
    for r in l.link_mentions(mentions, concepts).collect():
        want = linked(r.text, r.entity_type, aliases, kinds)
        assert (r.cui, r.link_score and round(r.link_score, 9)) == ((want[0], round(want[1], 9)) if want else (None, None)), r


def test_near_duplicates_of_ranked_lists(spark):
    lists = {}
    for r in rq._ranked_texts(spark, SF).collect():
        lists.setdefault(r.query_id, []).append((r["rank"], r.item_id, (r.text or "").strip().lower()[:300]))
    want = set()
    for q, items in lists.items():
        kept = []
        for _, i, start in sorted(items):
            if not any(ratio(start, k) > 0.90 for k in kept):
                kept.append(start)
                want.add((q, i))
    assert {(r.query_id, r.item_id) for r in rq.near_duplicates(spark, SF).collect()} == want and len(want) < sum(map(len, lists.values()))


def test_string_rerank_of_the_query(spark, monkeypatch):
    held = {}
    kept = l.string_rerank
    monkeypatch.setattr(l, "string_rerank", lambda pairs, concepts, *rest: held.update(pairs=pairs.distinct().collect(), concepts=concepts.collect()) or kept(pairs, concepts, *rest))
    got = {r.text: (r.cui, r.score) for r in sq.string_rerank(spark, SF).collect()}
    aliases, _ = names(held["concepts"])
    want = {}
    for p in held["pairs"]:
        score = max((round(ratio(p.text.lower(), a), 9) for a in aliases.get(p.cui, [])), default=0)
        if score >= 0.70 and (-score, p.cui) < want.get(p.text, (0, "")):
            want[p.text] = (-score, p.cui)
    assert got == {t: (c, -s) for t, (s, c) in want.items()} and got


def test_candidates_do_not_grow_with_the_concepts_of_a_spelling(spark, monkeypatch):
    spellings = ["blue ring", "blue rings", "red ring", "hot bolt"]
    rows = [(f"P{i}", spellings[i % 4], ("Drug", "Disease", "Gene")[i % 3], [spellings[i % 4 - 1]] if i % 5 == 0 else [], None) for i in range(600)]
    concepts = spark.createDataFrame(rows, "cui string, label string, entity_type string, synonyms array<string>, lang_labels map<string,string>")
    mentions = spark.createDataFrame([(x, k, 0.9) for x in ("bluering", "blu ring", "red rin", "hotbolt", "zz") for k in ("Drug", "Other")], "text string, entity_type string, confidence double")
    counted, kept = [], l.best
    monkeypatch.setattr(l, "best", lambda df, by, *rest: (counted.append(df.count()) if by == ["text", "entity_type"] else None) or kept(df, by, *rest))
    got = l.link_mentions(mentions, concepts, pool=7).collect()
    aliases, kinds = names(concepts.collect())
    for r in got:
        want = linked(r.text, r.entity_type, aliases, kinds, pool=7)
        assert (r.cui, r.link_score and round(r.link_score, 9)) == ((want[0], round(want[1], 9)) if want else (None, None)), r
    assert counted and max(counted) <= len(got) * len(spellings) * 7
