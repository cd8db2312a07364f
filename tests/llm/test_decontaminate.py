import re

import pytest

from millrace.llm import decontaminate
from millrace.llm.decontaminate import contamination, decontaminated

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(rows, items, size=10):
    windows = {}
    for item, text in items:
        words = words_of(text)
        n = min(size, len(words))
        for k in range(len(words) - n + 1) if n else ():
            windows.setdefault(tuple(words[k : k + n]), set()).add(item)
    out = []
    for i, text in rows:
        words, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[w]
        out.append((i, len(words), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("id", "n_words", "n_hit", "items").collect()), key=repr)


def tables(frame, rows, items):
    return frame(rows, "doc_id bigint, text string"), frame(items, "item_id bigint, text string", 1)


def cases(rng, words):
    vocabulary = ["a", "b", "über", "Über", "x1", "42", "ñandú", "日本", "longer", "thewordisverylong"][:words]
    vocabulary += [f"v{i}" for i in range(words)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, rng.choice([" ", "-", ", "]).join(say(rng.choice([0, 1, 2, 5, 9, 10, 11, 30])))) for i in range(25)]
    rows = []
    for i in range(80):
        parts = say(rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            taken = words_of(rng.choice(items)[1])
            a = rng.randint(0, len(taken))
            parts += [w.upper() if w.isascii() else w for w in taken[a:]] + say(rng.randint(0, 3))
        rows.append((i, rng.choice([" ", "\n", "!?", "\x00"]).join(parts)))
    return rows, items


@pytest.mark.parametrize("words", [3, 12, 300])
@pytest.mark.parametrize("pass_bytes", [4 << 20, 400])
def test_same_as_brute_force(frame, rng, words, pass_bytes):
    rows, items = cases(rng, words)
    documents, benchmark = tables(frame, rows, items)
    want = brute(rows, items)
    assert rows_of(contamination(documents, benchmark, pass_bytes=pass_bytes)) == want
    clean = decontaminated(documents, benchmark, pass_bytes=pass_bytes)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[2])


def test_nulls_repeats_and_long_texts(frame):
    ten = "one two three four five six seven eight nine ten"
    rows = [(None, ten), (1, None), (2, ""), (2, ""), (3, ten + " " + ten), (3, ten), (4, "x" * 100_000 + " " + ten)]
    rows += [(5, "w " * 50_000 + ten.upper()), (6, ten[:-1]), (7, "a" + ten), (8, ten.replace(" ", "é"))]
    items = [(1, ten), (1, ten), (None, ten), (2, None), (3, ""), (10, ten + " eleven"), (9, "...")]
    documents, benchmark = tables(frame, rows, items)
    for size in (4 << 20, 10):
        assert rows_of(contamination(documents, benchmark, pass_bytes=size)) == brute(rows, items)


def test_a_benchmark_text_that_repeats_is_sent_once(frame):
    """However many items have one text, what is collected are its distinct windows, by passes of bounded size."""
    ten = "one two three four five six seven eight nine ten eleven"
    items = [(i, ten) for i in range(600)] + [(1000 + i, f"only here {i} " + ten) for i in range(30)]
    documents, benchmark = tables(frame, [(1, ten), (2, "only here 7 " + ten), (3, "none")] + [(4, ten)] * 90, items)
    windows, owners = decontaminate._windows(benchmark, "item_id", "text", 10)
    assert windows.count() == len({w for _, t in items for w, _ in decontaminate.windows_of(t)})
    sizes = [len(b.value.text) for b in decontaminate._passes(windows, 10, 500)]
    assert len(sizes) >= 5 and max(sizes) <= 40 and sum(sizes) == windows.count()
    got = {r.id: (r.n_hit, len(r.items)) for r in contamination(documents, benchmark, pass_bytes=500).collect()}
    assert got == {1: (11, 630), 2: (14, 630), 3: (0, 0), 4: (11, 630)}


def test_empty_tables(frame):
    documents, benchmark = tables(frame, [(1, "a b")], [])
    assert rows_of(contamination(documents, benchmark)) == [(1, 2, 0, [])]
    assert decontaminated(documents, benchmark).count() == 1
    documents, benchmark = tables(frame, [], [(1, "a b")])
    assert contamination(documents, benchmark).count() == 0


def test_clashing_columns(frame):
    rows = [(1, "clean text", "i", 3), (2, "secret words", "j", None), (None, None, None, None)]
    documents = frame(rows, "doc_id bigint, text string, id string, spans int")
    clean = decontaminated(documents, frame([(1, "secret words")], "item_id bigint, text string", 1))
    assert clean.columns == ["doc_id", "text", "id", "spans"]
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted([rows[0], rows[2]], key=repr)
