"""Phrases: against a brute-force count, for any ranges the streams are cut in."""

import re
from collections import Counter

import pytest

from millrace.llm import collocations as module
from millrace.llm.collocations import collocations
from millrace.session import using_settings

SCHEMA = "doc_id bigint, text string, lang string, rank string"


def brute(rows, least=10, covered=50, first=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for w, a in f.items():
            if len(w) == 1 or a < least:
                continue
            cuts = [(1000000 * a * a // (f[w[:k]] * f[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            longer = [b for v, b in f.items() if len(v) == 3 and b >= least and len(w) == 2 and w in (v[:2], v[1:])]
            if not any(100 * b >= covered * a for b in longer):
                found.append((-score, -a, " ".join(w).encode(), f[w[:k]], f[w[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def run(frame, rows, parts=3, **options):
    df = frame([(i, t, lang, "x") for i, (t, lang) in enumerate(rows)], SCHEMA, parts)
    return sorted(map(tuple, collocations(df, **options).collect()))


def text(rng, words, size):
    out = rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=size)
    ends = rng.choices([" ", "  ", "\t", ". ", ",", "\n", "!x "], weights=[60, 3, 1, 3, 2, 1, 1], k=size)
    return "".join(a + b for a, b in zip(out, ends))


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_like_brute_force(spark, frame, rng, parts):
    words = ["The", "of", "a", "É", "é", "x\x01", "x", "new", "york", "city", "\x00", "�", "\U00010001"]
    rows = [(text(rng, words, rng.randrange(60)), rng.choice(["en", "de", "", None])) for _ in range(200)]
    rows += [(None, "en"), ("", None), ("New York City " * 40, "en"), ("a " * 500, "de")] + [("same words here", "fr")] * 90
    with using_settings(spark, {"spark.sql.shuffle.partitions": str(parts)}):
        assert run(frame, rows) == brute(rows)
        assert run(frame, rows, least=3, covered=90, first=7) == brute(rows, 3, 90, 7)


def test_a_word_that_begins_or_ends_a_third_of_all_phrases(spark, frame, rng):
    rows = [(f"hot w{i} v{i}. v{i} w{i} hot. hot hot w{i}", "en") for i in range(60) for _ in range(10 + i % 4)]
    rows += [("hot hot hot " * 200, "en")]
    with using_settings(spark, {"spark.sql.shuffle.partitions": "30"}):
        assert run(frame, rows, 5) == brute(rows)


def test_blocks_and_chunks_of_any_size(spark, frame, rng, monkeypatch):
    rows = [(text(rng, ["aa", "b", "cc", "d"], 300), "en") for _ in range(20)]
    for held, chunk in ((1, 7), (500, 64)):
        monkeypatch.setattr(module, "HELD_WORDS", held)
        monkeypatch.setattr(module, "CHUNK", chunk)
        block = module._Block()
        for t, _ in rows:
            block.add(t.encode())
        found = Counter()
        for batch in block.counted("en", (1, 2, 3)):
            for r in batch.to_pylist():
                if r["phrase"] is not None:
                    found[tuple(r["phrase"].split(" "))] += r["n"]
        want = Counter()
        for t, _ in rows:
            for piece in re.split("[.,;:!?\n-\r]", t):
                w = piece.split()
                want.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
        assert found == want


def test_more_words_than_three_numbers_hold(monkeypatch):
    block = module._Block()
    block.add(" ".join(f"w{i}" for i in range(1000)).encode())
    real = [b.to_pylist() for b in block.counted("en", (1, 2, 3))]
    # As if there were 2^21 words and more: triples go by the number of their pair.
    block.numbers.update({f"other{i}".encode(): i for i in range(1001, (1 << 21) + 1)})
    assert [b.to_pylist() for b in block.counted("en", (1, 2, 3))] == real


def test_a_full_map_of_pairs_changes_nothing(frame, rng, monkeypatch):
    rows = [(text(rng, [f"w{i}" for i in range(30)], 200), rng.choice(["en", "de"])) for _ in range(60)]
    monkeypatch.setattr(module, "MAP_BITS", 8)
    monkeypatch.setattr(module, "_bitmap", lambda pairs: __import__("numpy").full(1, 255, "uint8"))
    assert run(frame, rows) == brute(rows)


def test_none(spark, frame):
    assert run(frame, []) == [] and run(frame, [(None, None), ("", "en"), ("one two", "en")]) == []
