import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from millrace.llm import packing
from millrace.llm.packing import Encoder, cuts, packed_sequences

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def check(got, rows, tokenizer, capacity=2048):
    ids = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows]
    want = defaultdict(int)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.id, r.doc_tokens].append(r)
    for i, x in ids:
        want[i, len(x)] += 1
    assert {k: sum(r.length for r in v) for k, v in pieces.items()} == {k: k[1] * n for k, n in want.items()}
    data = {i: x for i, x in ids}
    for r in got:
        if want[r.id, r.doc_tokens] == 1 and len(data[r.id]) == r.doc_tokens:
            part = np.array(data[r.id][r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.length == len(part) // 4
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding, len(sequences)


def test_all_pieces_once_with_little_padding(frame, rng, tokenizer):
    rows = [(i, " ".join(rng.choice(["the", "Ünter", "42", "x,y"]) for _ in range(rng.choice([0, 3, 50, 400, 3000])))) for i in range(300)]
    rows = [(i, t + f" {i}") for i, t in rows]
    got = packed_sequences(frame(rows, "doc_id bigint, text string")).collect()
    padding, sequences = check(got, rows, tokenizer)
    assert padding <= 0.01 * 2048 * sequences + 2048


def test_nulls_empty_repeated_long_and_clashing(frame, tokenizer):
    rows = [(None, "a b"), (1, None), (2, ""), (3, "same text"), (3, "same text"), (4, "word " * 30_000), (5, "<|endoftext|>")]
    documents = frame([(*r, 9, 9) for r in rows], "doc_id bigint, text string, start int, k int")
    got = packed_sequences(documents).collect()
    check(got, rows, tokenizer)
    assert [(r.length, r.doc_tokens) for r in got if r.id in (1, 2)] == [(1, 1), (1, 1)]


def test_empty_table(frame):
    assert packed_sequences(frame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize("capacity", [2048, 100, 7])
def test_cuts(capacity):
    for n in [*range(1, 3 * capacity), 10**6]:
        parts = cuts(n, capacity)
        assert sum(parts) == n and min(parts) > 0
        wasted = sum(capacity / (capacity // p) - p for p in parts)
        assert wasted <= 8 + len(parts)


def test_encoder_is_the_tokenizer(rng, tokenizer):
    signs = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "Bc", "'s", "don't", "9", "²", "ⅷ", "_", "!?"]
    signs += ["<|endoftext|>", "é", "日本", "́", "😀", "\0", "​", "ª", "½", "word", " word", "'", "ſ"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    with open(PATH, encoding="utf-8") as file:
        encode = Encoder(file.read())
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):
        for found, text in zip(want, encode(texts)):
            assert np.array(found.ids, "<u4").tobytes() == text


class Counting:
    """A tokenizer that notes how many signs it gets at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.most = tokenizer, 0

    def __getattr__(self, name):
        def called(texts, **options):
            self.most = max(self.most, sum(map(len, texts)))
            return getattr(self.tokenizer, name)(texts, **options)

        return called


def test_encoder_holds_a_bounded_number_of_words(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 5_000)
    monkeypatch.setattr(packing, "KEPT_WORDS", 1_000)
    with open(PATH, encoding="utf-8") as file:
        encode = Encoder(file.read())
    encode.tokenizer = counting = Counting(encode.tokenizer)
    # Words that differ, after a space and after other signs.
    first = " ".join(f"a{i}" for i in range(500))
    many = [first, *(" ".join(f"w{i}:x{i}" for i in range(a, a + 4_000)) for a in range(0, 40_000, 4_000))]
    want = tokenizer.encode_batch(many, add_special_tokens=False)
    want = [np.array(x.ids, "<u4").tobytes() for x in want]
    assert encode(many) == want
    assert counting.most <= 50_000
    assert len(encode.known) == 1_000
    kept = list(encode.known)
    assert [encode([t])[0] for t in many] == want
    assert len(encode.known) <= 5_000 and list(encode.known)[:1_000] == kept
