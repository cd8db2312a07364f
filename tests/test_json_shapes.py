"""JSON of unknown shape, against Python's own parser."""

import json
import random
from collections import Counter

from millrace.operators.json_shapes import kinds_by_path, merged_schema, paths_of, shredded

NAMES = ["k", "a b", "é", "OBJECT<", "x'y", 'q"r', "n.m", "_z9", "`t`"]


def kind_of(v):
    kinds = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number"}
    return "null" if v is None else kinds[type(v)]


def brute(texts):
    found = Counter()

    def walk(v, path):
        found[path, kind_of(v)] += 1
        if isinstance(v, dict):
            for name, inner in v.items():
                quote = "'" if "'" not in name else '"'
                plain = name in ("k", "_z9")
                walk(inner, path + (f".{name}" if plain else f"[{quote}{name}{quote}]"))

    for text in texts:
        if text is not None:
            try:
                walk(json.loads(text), "$")
            except ValueError:
                found["$", "malformed"] += 1
    return found


def got(df):
    return Counter({(r.path, r.kind): r.n_rows for r in kinds_by_path(df, "t").collect()})


def test_objects_like_the_standard_parser(spark):
    """Objects whose fields are always objects or always something else, at any depth."""
    rng = random.Random(3)
    texts = []
    for _ in range(300):
        inner = {n: rng.choice([None, 1, 2.5, "s", True, [1, {"z": 2}]]) for n in rng.sample(NAMES, 3)}
        texts.append(json.dumps({"in": {n: inner for n in rng.sample(["p", "q"], 1)}, **{k: v for k, v in inner.items() if k != "k"}}))
    texts += [None, "{", "", "{}", "nope"] + ['{"in": {}}'] * 150
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    want = Counter()
    for (path, kind), n in brute(texts).items():
        # Paths of names that only look plain are written the short way.
        want[path.replace("['in']", ".in").replace("['p']", ".p").replace("['q']", ".q"), kind] += n
    assert got(df) == want


def test_scalars_arrays_and_nothing(spark):
    df = spark.createDataFrame([(t,) for t in ["1", "[1]", '"s"', "null", "true", None]], "t string")
    assert got(df) == Counter({("$", k): 1 for k in ("number", "array", "string", "null", "boolean")})
    empty = spark.createDataFrame([], "t string")
    assert not got(empty) and merged_schema(empty, "t") is None and list(paths_of(None)) == ["$"]
    assert got(spark.createDataFrame([("{",), (None,)], "t string")) == Counter({("$", "malformed"): 1})


def test_shredded(spark):
    rows = [(1, '{"k": 5, "s": {"t": "x"}}'), (2, '{"k": "five"}'), (3, "{"), (4, None), (5, '{"k": 2.0}')]
    df = spark.createDataFrame(rows, "id int, t string")
    found = shredded(df, "t", {"k": ("$.k", "bigint"), "inner": ("$.s.t", "string")})
    assert sorted((r.id, r.k, r.inner) for r in found.collect()) == [(1, 5, "x"), (2, None, None), (3, None, None), (4, None, None), (5, 2, None)]
