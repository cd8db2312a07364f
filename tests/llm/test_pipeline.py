import pytest

import corpus_pipeline
from millrace.llm import packing
from millrace.llm.common import table
from llm.test_decontaminate import brute as brute_hits
from llm.test_similar import groups_of, pairs_of
from llm.test_substrings import brute as brute_repeats

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The documents, and what each stage made of its predecessor's rows."""
    docs = table(spark, FOLDER, "documents").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], FOLDER).cache())
    yield out
    for df in out:
        df.unpersist()


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns


def test_rejects_only_low_quality(spark, stages):
    kept = texts(stages[1])
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    wrong = [i for i, q in labels.items() if (i in kept) != (q == 1)]
    assert len(wrong) <= 0.03 * len(labels)
    assert kept.items() <= texts(stages[0]).items()


def test_one_document_of_each_group(stages):
    rows = sorted(texts(stages[1]).items())
    plain = [t.lower() for _, t in rows]
    same = {}
    exact = [(same.setdefault(tuple(t.split()), i), i) for i, t in enumerate(plain)]
    want = {rows[k][0]: rows[k][1] for k in set(groups_of(len(rows), [*pairs_of(plain), *exact]))}
    got = texts(stages[2])
    # A link at the bound may not be found; no row goes without one.
    assert want.items() <= got.items() and len(got) - len(want) <= 0.1 * (len(rows) - len(want))


def test_repeats_are_cut(stages):
    rows = sorted(texts(stages[2]).items())
    want = {i: kept if gone else dict(rows)[i] for i, _, gone, kept in brute_repeats(rows, 50) if kept or not gone}
    assert texts(stages[3]) == want
    assert all(r.n_chars == len(r.text) for r in stages[3].collect())


def test_contaminated_documents_go(spark, stages):
    rows = sorted(texts(stages[3]).items())
    items = [tuple(r) for r in table(spark, FOLDER, "benchmark").collect()]
    clean = {i for i, _, hit, _ in brute_hits(rows, items) if not hit}
    assert texts(stages[4]) == {i: t for i, t in rows if i in clean}


ODD = "doc_id bigint, text string, lang string, id int, uid string, cells string, spans string, n_chars bigint"


def written(spark, folder, rows, labels, items):
    tables = {
        "documents": spark.createDataFrame(rows, ODD),
        "labels": spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
        "benchmark": spark.createDataFrame(items, "item_id bigint, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Clean rows come through whole, whatever else is in the table."""
    prose = table(spark, FOLDER, "documents").join(table(spark, FOLDER, "labels").filter("quality = 1"), "doc_id")
    prose = [r.text for r in prose.orderBy("doc_id").limit(40).collect()]
    rows = [(i, t, "en", 1, "u", "c", "s", len(t)) for i, t in enumerate(prose)]
    rows += [(None, "null id " + prose[0], None, None, None, None, None, None), (3, None, None, 1, "u", "c", "s", 0)]
    rows += [(3, "", "en", 1, "u", "c", "s", 0)] + [rows[5]] * 30
    labels = [(i, 1, 0) for i in range(40)] + [(i, 0, 0) for i in range(100, 110)] + [(None, 1, 1), (5, None, 0)]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, labels, [(1, None), (None, ""), (2, "no such words here")]))
    pieces = {}
    for r in got.collect():
        pieces.setdefault(r.doc_id, []).append(r.length)
    assert 5 in pieces and set(pieces) <= {*range(40), None}
    assert all(sum(p) > 0 for p in pieces.values()) and len(pieces) >= 20


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "none", [], [], [])).count() == 0
    rows = [(1, "some words", "en", 1, "u", "c", "s", 10)]
    assert corpus_pipeline.run(spark, written(spark, tmp_path / "no-labels", rows, [], [])).count() in (0, 1)


def test_packed(spark, stages):
    got = stages[5].collect()
    assert {r.doc_id for r in got} == set(texts(stages[4]))
    assert all(r.offset + r.length <= packing.CAPACITY for r in got)
    again = corpus_pipeline.run(spark, FOLDER).select("doc_id", "start", "length", "ids_crc32")
    assert sorted(again.collect()) == sorted(stages[5].select("doc_id", "start", "length", "ids_crc32").collect())
