"""The registered queries on the given tables: against SQL, or against what their contract says."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from millrace.llm import chat
from millrace.llm.expected import EXPECTED
from millrace.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "embeddings", "labels")


def sql(text, folder=FOLDER):
    with duckdb.connect() as connection:
        for name in TABLES:
            connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
        found = connection.sql(text)
        return sorted(found.columns), found.df()


def rows(frame, columns):
    frame = frame[columns].astype(object)
    return sorted(map(tuple, frame.where(frame.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.01"])
@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_same_as_sql(spark, name, folder):
    columns, want = sql(EXPECTED[name], folder)
    got = QUERIES[name](spark, folder)
    assert sorted(got.columns) == columns
    assert rows(got.toPandas(), columns) == rows(want, columns)


def documents():
    return {r[0]: r[1:] for r in sql("SELECT doc_id, text, lang FROM documents")[1].itertuples(index=False)}


def test_chat_renders_all_prefixes(spark, monkeypatch):
    """The query makes no promise for its template."""
    asked, formatted = [], chat.formatted
    monkeypatch.setattr(chat, "formatted", lambda rows, **more: asked.append(more) or formatted(rows, **more))
    assert QUERIES["op2_chat"](spark, FOLDER).count() > 1
    assert len(asked) == 1 and asked[0].get("context") is None


def test_language(spark):
    docs, got = documents(), QUERIES["op1_language"](spark, FOLDER).toPandas()
    assert sorted(got.doc_id) == sorted(docs)
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs}
    assert all(held[r.doc_id] == r.held_out and 0 <= r.score <= 1 for r in got.itertuples())
    assert np.mean([docs[r.doc_id][1] == r.lang_pred for r in got.itertuples() if r.held_out]) >= 0.9


def test_quality(spark):
    got = QUERIES["op4_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    _, labels = sql("SELECT * FROM labels", "/root/testdata/sf0.01")
    assert all((zlib.crc32(str(i).encode()) % 3 == 1) == h for i, h in got.held_out.items())
    assert ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = [(got.predicted[r.doc_id], r.quality) for r in labels.itertuples() if got.held_out[r.doc_id]]
    assert np.mean([p == q for p, q in held]) >= 0.95


def test_sharding(spark):
    docs, got = documents(), QUERIES["op10_sharding"](spark, FOLDER).toPandas()
    assert sorted(got.doc_id) == sorted(docs) and set(got.law) == {"bytes"} and got.grown_shard.isna().all()
    for r in got.itertuples():
        data = docs[r.doc_id][0].encode()
        assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_neighbours(spark):
    got = QUERIES["op9_neighbours"](spark, FOLDER).toPandas()
    _, table = sql("SELECT vec_id, embedding FROM embeddings ORDER BY vec_id")
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((ids, far)) if i != q][:10]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        hits, total = hits + len(set(mine.vec_id) & set(ids[best])), total + 10
    assert hits >= 0.9 * total


def test_simhash_and_tokens(spark):
    docs = documents()
    got = QUERIES["op6_simhash"](spark, FOLDER).toPandas()
    assert sorted(got.doc_id) == sorted(docs) and got.fingerprint.str.fullmatch("[0-9a-f]{16}").all()
    copies = {}
    for i, (text, _) in sorted(docs.items()):
        copies.setdefault(hashlib.sha256(text.encode()).digest(), []).append(i)
    of = got.set_index("doc_id").component_id
    assert all(len({of[i] for i in group}) == 1 for group in copies.values())
    tokens = QUERIES["op7_tokens"](spark, FOLDER).toPandas()
    assert sorted(tokens.doc_id) == sorted(docs) and (tokens.n_tokens >= tokens.n_words).all()


def test_packing(spark):
    got = QUERIES["op3_packing"](spark, FOLDER).toPandas()
    assert set(got.doc_id) == set(documents())
    for _, part in got.groupby("doc_id"):
        part = part.sort_values("start")
        assert list(part.start) == [0, *part.length.cumsum()[:-1]] and part.length.sum() == part.doc_tokens.iloc[0]
    used = got.groupby("sequence_id").length.sum()
    assert used.max() <= 2048 and (2048 - used).sum() < 0.02 * 2048 * len(used)
