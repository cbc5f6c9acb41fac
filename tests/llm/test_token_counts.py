import random

import public_tokenizers
import sentencepiece

from quillgraph.llm.token_counts import token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes int"


def test_equals_the_library(spark):
    rng = random.Random(1)
    texts = [None, "", " ", "  a  b", "a" * 5000, "ab" * 3000, "-" * 3001, " " * 999, "the" * 2000, "ththeethe" * 700, "</s><s><unk>", "🙂" * 50, "a\x00b", "word " * 50_000]
    texts += ["".join(rng.choices("  ▁abthe\n\t</s>[INST]éßñ中文字😀=-_0123aaa", k=rng.randint(1, 200))) for _ in range(400)]
    texts += texts[:3]
    got = token_counts(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), MODEL, limit=100).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [len(model.encode(t or "")) for t in texts]
    assert [(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in sorted(got)] == [
        (i, len((t or "").encode()), n, n > 100) for i, (t, n) in enumerate(zip(texts, want, strict=True))
    ]


def test_no_rows_and_null_id(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), MODEL).count() == 0
    assert token_counts(spark.createDataFrame([(None, "a", "", 0)], SCHEMA), MODEL).first().n_tokens == 1
