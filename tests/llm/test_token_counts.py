import pytest

from millrace.llm import token_counts
from millrace.llm.token_counts import count_one, count_words, made, token_counts as counts

LETTERS = "abé日"


def brute(word, pieces):
    """The best over all segmentations, by trying each."""
    if not word:
        return 0, 0
    n = len(word[0].encode())
    options = [(n * pieces.byte_score, -n, word[1:])]
    options += [(s, -1, word[len(p) :]) for p, s in pieces.scores.items() if word.startswith(p)]
    found = []
    for score, count, rest in options:
        more = brute(rest, pieces)
        found.append((score + more[0], count + more[1]))
    return max(found)


def model(rng, pieces):
    names = {"".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 4))) for _ in range(pieces)}
    return made({p: -rng.randint(1, 20) for p in sorted(names)}, -15)


@pytest.mark.parametrize("pieces", [0, 3, 30])
def test_trie_same_as_brute_force(rng, pieces):
    for _ in range(5):
        own = model(rng, pieces)
        words = sorted({"".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 7))) for _ in range(60)}, key=rng.random and hash)
        want = [-brute(w, own)[1] for w in words]
        assert count_words(words, own).tolist() == want
        assert [count_one(w, own) for w in words] == want


def test_long_words_and_shared_prefixes(rng):
    own = model(rng, 30)
    words = ["ab" * 40, "ab" * 41, "ab" * 300, "a" * 127, "a" * 128, "a" * 129]
    assert count_words(words, own).tolist() == [count_one(w, own) for w in words]


def test_table(frame):
    text = "the quick brown fox über \x85 日本 thewordthatislong" * 3
    rows = [(1, text), (1, text), (2, None), (3, ""), (4, " \n\x0b"), (None, "x"), (5, "y" * 5000), (6, "one\ttwo\nthree")]
    got = sorted(map(tuple, counts(frame([(*r, 0) for r in rows], "doc_id bigint, text string, id int")).collect()), key=repr)
    pieces = token_counts.read_pieces(token_counts.public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in rows:
        words = [w.decode() for w in (t or "").encode().split()]
        want.append((i, len(words), sum(count_one("▁" + w, pieces) for w in words)))
    assert got == sorted(want, key=repr)
    assert counts(frame([], "doc_id bigint, text string")).count() == 0
