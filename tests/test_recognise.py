import re

from quillgraph.functions import vocabulary as v
from quillgraph.operators import linking as l
from quillgraph.operators import retrieval as r

WORD = re.compile(r"[^\W_](?:\S*[^\W_])?")
DICTIONARY = [("renal failure", "Disease", 0.9), ("failure", "Disease", 0.5), ("acute renal", "Disease", 0.8), ("Aspirin", "Drug", 0.9), ("aspirin", "Brand", 0.3), ("low", "Drug", 0.1), ("ångström", "Unit", 0.9), ("x-ray", "Test", 0.7), ("  ", "Drug", 0.9), (None, "Drug", 0.9), ("gift", None, 0.9)]
TEXTS = [
    (1, "Acute renal failure, (ASPIRIN) and aspirins; renal\nfailure. Renal  failure"),
    (2, "pre-renal failure x-ray, x-rays ... ÅNGSTRÖM gift low"),
    (3, None), (4, ""), (None, "failure"), (5, "İİİ aspirin ſ failure_ _failure failure2"), (6, "failure " * 5000),
]


def brute(texts, dictionary, least=0.25):
    """Runs of words, compared one by one."""
    out = []
    for i, text in texts:
        words = [(m.start(), m.end()) for m in WORD.finditer(text or "")]
        for term, kind, confidence in dictionary:
            if not term or not term.strip() or kind is None or confidence < least:
                continue
            n = len(term.split())
            for a, b in zip(words, words[n - 1 :], strict=False):
                cut = text[a[0] : b[1]]
                if re.sub(r"\s", " ", cut).lower() == term.strip().lower():
                    out.append((i, a[0], b[1], cut, kind, confidence))
    return sorted(out, key=str)


def test_terms_of_several_words_against_plain_loops(spark, monkeypatch):
    chunks = spark.createDataFrame(TEXTS, "chunk_id int, text string").repartition(3)
    known = spark.createDataFrame(DICTIONARY, "term string, entity_type string, confidence double")
    got = lambda: sorted(map(tuple, l.recognise(chunks, known).collect()), key=str)
    want = brute(TEXTS, DICTIONARY)
    assert got() == want and len(want) > 5010
    monkeypatch.setattr(l, "AUTOMATON_BYTES", 150)  # several automata
    assert got() == want
    assert l.recognise(chunks, known.limit(0)).collect() == [] and l.recognise(chunks.limit(0), known).collect() == []


def test_every_pattern_holds_what_it_needs():
    seen = 0
    for _, patterns in v.QUERY_RULES:
        for p in patterns:
            needed = r.needed_literals(p)
            seen += bool(needed)
            # without any of the needed texts there is no match: letters are taken out of a match one by one
            for text in ("interactions", "combined", "contra-indicated", "CYP3A4", "take it with", "safe to use", "summarise", "all the drugs", "common chronic conditions", "clinical trials", "studies", "how does", "is it OK", "Was ist", "什么是", "co-administered", "drug and drug", "management of", "dosing", "lay terms"):
                if re.search(p, text, re.I):
                    assert not needed or any(x in text.lower() for x in needed)
    assert seen == sum(len(p) for _, p in v.QUERY_RULES)
