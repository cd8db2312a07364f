"""Byte-pair encoding: against the library, in steps of any size, and back."""

import hashlib
import json

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer as Library

from millrace.llm.bpe import Decoder, Encoder, Tokenizer, Vocabulary, byte_letters, decoded, encoded, lookaheads
from millrace.llm.queries import op11_bpe

SPEC = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
LIBRARY, OWN = Library.from_str(SPEC), Tokenizer(SPEC)
VOCABULARY = OWN.vocabulary


def small(merges):
    """A vocabulary of the letters a to d with these merges."""
    words = {c: i for i, c in enumerate(byte_letters())}
    pairs = []
    for a, b in merges:
        if a in words and b in words and a + b not in words:
            words[a + b] = len(words)
            pairs.append([a, b])
    spec = json.loads(SPEC)
    spec["added_tokens"], spec["model"] = [], spec["model"] | {"vocab": words, "merges": pairs}
    return Vocabulary(json.dumps(spec))


def streamed(vocabulary, data, cuts, step):
    encoder, out, at, most = Encoder(vocabulary, step), [], 0, 0
    for cut in [*sorted(cuts), len(data)]:
        out.extend(encoder.feed(data[at:cut]))
        most, at = max(most, len(encoder.held)), max(at, cut)
    return out + list(encoder.finish()), most


@st.composite
def vocabularies(draw):
    tokens, merges = list("abcd"), []
    for _ in range(draw(st.integers(0, 14))):
        a, b = draw(st.sampled_from(tokens)), draw(st.sampled_from(tokens))
        if len(a + b) <= 12 and a + b not in tokens:
            tokens.append(a + b)
            merges.append((a, b))
    return small(merges)


def slow(vocabulary, data):
    """The definition: the pair of lowest rank first, leftmost first, until there is none."""
    ids = [vocabulary.letters[b] for b in data]
    while True:
        found = [(vocabulary.ranks[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in vocabulary.ranks]
        if not found:
            return ids
        rank, i = min(found)
        ids[i : i + 2] = [rank & 0xFFFFFF]


@settings(deadline=None, max_examples=400)
@given(vocabularies(), st.text("abcd", max_size=80), st.lists(st.integers(0, 80), max_size=5), st.integers(1, 4))
def test_the_lookahead_suffices(vocabulary, word, cuts, step):
    data = word.encode()
    cuts = [min(c, len(data)) for c in cuts]
    got, most = streamed(vocabulary, data, cuts, step)
    assert got == slow(vocabulary, data)
    # What is held is bounded by the vocabulary, not by the word.
    assert most <= vocabulary.lookahead + vocabulary.longest + vocabulary.longest + step


@settings(deadline=None, max_examples=300)
@given(vocabularies(), st.text("abcd", max_size=60))
def test_both_ways_to_merge(vocabulary, word):
    ids = [vocabulary.letters[b] for b in word.encode()]
    assert vocabulary._scanned(list(ids)) == vocabulary._queued(list(ids)) == slow(vocabulary, word.encode())


def test_lookahead_of_a_chain():
    # a waits for b, which c takes first unless d takes c before that.
    merges = [(2, 3, 4), (1, 2, 5), (0, 1, 6)]
    assert lookaheads(merges, {i: 1 for i in range(4)} | {4: 2, 5: 2, 6: 2})[0] == 3
    assert VOCABULARY.lookahead < 200


@settings(deadline=None, max_examples=300)
@given(st.text(max_size=60) | st.text("ab \n\t'stréx0１<|endoftext|>", max_size=80))
def test_like_the_library(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text).tolist() == want
    decoder = Decoder(VOCABULARY)
    assert "".join(decoder.feed([i]) for i in want) + decoder.finish() == LIBRARY.decode(want, skip_special_tokens=False)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_any_ids_are_decoded(ids):
    decoder = Decoder(VOCABULARY)
    got = "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + decoder.finish()
    assert got == LIBRARY.decode(ids, skip_special_tokens=False)


def test_words_without_end(rng):
    for word in ("a" * 30_000, "=" * 20_001, " " * 9_000, "".join(rng.choices("abcdefgh", k=30_000)), "é漢" * 5_000):
        assert OWN.encode(word).tolist() == LIBRARY.encode(word, add_special_tokens=False).ids
        data = word.encode()
        got, most = streamed(VOCABULARY, data, range(0, len(data), 10), 16)
        # A word may be cut into several by the library: only the size is of interest here.
        assert most < 16 + 10 + 2 * VOCABULARY.longest + VOCABULARY.lookahead


def test_tables(spark, frame):
    texts = ["Hello, world!", None, "", "<|endoftext|> a<|endoftext|>", "tie tie", "tie tie", "x" * 50_000, "\x00�"]
    rows = [(None if i == 5 else i, t, "clash", [1]) for i, t in enumerate(texts)]
    df = frame(rows, "doc_id bigint, text string, id string, ids array<int>")
    ids = encoded(df)
    got = {(r.id, tuple(r.ids)) for r in ids.collect()}
    assert got == {(r[0], tuple(LIBRARY.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows}
    back = {(r.row.id, r.text) for r in decoded(ids).collect()}
    assert back == {(r[0], r[1] or "") for r in rows}
    assert encoded(df.limit(0)).count() == 0 and decoded(encoded(df.limit(0))).count() == 0
    odd = spark.createDataFrame([(1, [15496, None, 999_999, 11]), (2, None)], "k int, ids array<int>")
    assert {r.row.k: r.text for r in decoded(odd).collect()} == {1: "Hello,", 2: ""}


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    got = op11_bpe(spark, folder).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        ids = LIBRARY.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False))
