import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quillgraph.llm.packing import curve_keys, hilbert_keys, pack

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, start string, key int"


def check(texts, ids, got, capacity):
    """The contract, against the library's own ids."""
    tokenizer = Tokenizer.from_file(PATH)
    want = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in zip(ids, texts, strict=True)}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert 0 < r.length <= capacity
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        part = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(part.tobytes()), len(part), r.doc_tokens) == (r.ids_crc32, r.length, len(want[r.doc_id]))
    for i, rows in pieces.items():
        at = 0
        for r in sorted(rows, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(want[i])
    assert pieces.keys() == want.keys()
    short = 0
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        short += at < capacity
    assert short <= 1


def test_every_id_is_packed_once(spark):
    rng = random.Random(2)
    bits = ["the", " of", "  ", "\n", "\t", "'s", "'ll", "É", "ü", "123", "²", "!?", "<|endoftext|>", "中文", "😀", "\x1f", "\x85", "\xa0", "_", "a1", " '", "\r\n "]
    texts = [None, "", " ", "word " * 9000, "x" * 5000] + ["".join(rng.choices(bits, k=rng.randint(1, 400))) for _ in range(200)] + ["copy of a text"] * 200
    rows = spark.createDataFrame([(i, t, "clash", 0) for i, t in enumerate(texts)], SCHEMA)
    for capacity in (1024, 64):
        check(texts, range(len(texts)), pack(rows, PATH, capacity).collect(), capacity)


def test_hilbert_curve_visits_neighbours():
    for n, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        keys = hilbert_keys(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_like_documents_lie_closer_on_the_curve():
    rng = np.random.default_rng(0)
    kinds = [rng.integers(0, 50_000, 60) for _ in range(4)]
    ids = [rng.choice(kinds[i % 4], 300).astype(np.uint32) for i in range(200)]
    order = np.argsort(curve_keys(ids, 4, 12)) % 4
    assert (order[1:] == order[:-1]).mean() > 0.8


def test_null_ids_repeats_and_no_rows(spark):
    got = pack(spark.createDataFrame([(None, "a b", "", 0), (3, "a b", "", 0), (3, "a b", "", 0)], SCHEMA), PATH).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 3), (3, 3), (3, 3)]
    assert sorted((r.sequence_id, r.offset) for r in got) == [(0, 0), (0, 3), (0, 6)]
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_encoder_forgets_without_changing_ids(monkeypatch):
    """A cache of few cuts turns over often; ids are the tokenizer's all the same."""
    from quillgraph.llm import packing

    monkeypatch.setattr(packing, "REMEMBERED", 5)
    encoder = packing.Encoder(PATH)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{rng.integers(40)}" for _ in range(12)) + "!" for _ in range(300)]
    for at in range(0, 300, 7):
        for t, ids in zip(texts[at : at + 7], encoder.encode(texts[at : at + 7]), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert len(encoder.known) + len(encoder.older) < 150


def test_latin_words_go_to_the_merges_only():
    from quillgraph.llm import packing

    rng = random.Random(5)
    letters = [chr(x) for x in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250))]
    texts = ["".join(rng.choice(letters) + rng.choice(["", " ", "  ", "e", "'s", "12"]) for _ in range(rng.randrange(200))) for _ in range(150)]
    want = [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encoder = packing.Encoder(PATH)
    encoder.tokenizer = None
    assert [i.tolist() for i in encoder.encode(texts)] == want
    assert [i.tolist() for i in encoder.encode(["", "a", "\n"])] == [[], want_of("a"), want_of("\n")]


def want_of(text):
    return Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
