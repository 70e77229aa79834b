"""The pipeline against its operators' brute-force versions, stage by stage."""

import pytest

import corpus_pipeline as cp
from gridloom.llm import decontam, simhash, substring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    out = {"in": spark.read.parquet(f"{SF}/documents.parquet")}
    docs = out["in"]
    for i, (name, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_names_and_columns(kept):
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "best-fit packing"]
    for name, _ in cp.STAGES[:-1]:
        assert sorted(kept[name].columns) == sorted(kept["in"].columns)


def test_quality_rejects_the_bad_and_keeps_the_good(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = {i for i, _ in pairs(kept["quality classifier"])}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in good) >= 0.95 * len(good)


def test_near_duplicates(kept):
    rows = pairs(kept["quality classifier"])
    want = {i for i, (_, c) in simhash.brute_force(rows).items() if c == i}
    assert {i for i, _ in pairs(kept["SimHash near-dedup"])} == want


def test_substrings(kept):
    rows = pairs(kept["SimHash near-dedup"])
    want = {}
    for i, (n, gone, text) in substring.brute_force(rows).items():
        if not (gone and gone == n):
            want[i] = text if gone else dict(rows)[i]
    assert dict(pairs(kept["substring dedup"])) == want


def test_benchmark(spark, kept):
    rows = pairs(kept["substring dedup"])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    judged = {r[0]: r for r in decontam.brute_force(rows, items)}
    got = dict(pairs(kept["benchmark decontamination"]))
    assert set(got) == {i for i, r in judged.items() if not r[-1]}
    for i, text in rows:
        if i in got and not judged[i][2]:
            assert got[i] == text
    assert not any(r[2] for r in decontam.brute_force(list(got.items()), items))


def test_benchmark_is_cut_out_of_long_documents(spark, words):
    item, long = words(30, 1), words(2000, 2)
    part = " ".join(item.split()[5:25])
    rows = [(1, f"{long}\n{item}. {long}"), (2, f"Before, {item}! after"), (3, long), (4, None), (5, f"{long} {part[:80]}{item}{part[80:]} {long}")]
    docs = spark.createDataFrame([(i, t, "x", [1], 5, 6, 7) for i, t in rows], "doc_id long, text string, items string, spans array<int>, n_words int, n_chars int, row long")
    bench = spark.createDataFrame([("a", item), ("b", part)], "item_id string, text string")
    for size in (16 << 20, 50):
        got = {r.doc_id: r for r in decontam.remove(docs, bench, size_col="n_chars", block_bytes=size).collect()}
        assert set(got) == {1, 3, 4, 5} and got[3].text == long and got[4].text is None and got[3].n_chars == 6
        assert got[1].text == f"{long}\n. {long}" and got[1].n_chars == len(got[1].text)
        assert decontam.brute_force([(5, got[5].text)], [("a", item), ("b", part)])[0][2] == 0
        assert decontam.remove(docs.limit(0), bench, block_bytes=size).count() == 0
        assert decontam.remove(docs, bench.limit(0), block_bytes=size).count() == 5


def test_packing_takes_all(kept):
    assert {r.doc_id for r in kept["best-fit packing"].select("doc_id").collect()} == {i for i, _ in pairs(kept["benchmark decontamination"])}


def test_stages_take_empty_tables_nulls_and_clashing_names(spark, tmp_path, words):
    own = "doc_id long, text string, lang string, source string, n_chars int, items array<string>, spans string, n_words long, n_removed int, kept_text string, row string, score double, _sets int"
    rest = (["i"], "s", 7, 8, "k", "r", 0.1, 3)
    rows = [(i, words(60, i) + ".", "en", "web", 5, *rest) for i in range(12)] + [(None, words(60, 3), "en", "web", 1, *rest), (50, None, None, None, None, *rest), (51, "", "en", "x", 0, *rest)]
    for name, kept in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(kept, own)
        for i, (_, stage) in enumerate(cp.STAGES):
            path = str(tmp_path / f"{name}{i}")
            stage(spark, docs, SF).write.parquet(path)
            after = spark.read.parquet(path)
            if i < 4:
                assert after.columns == docs.columns
                assert after.where("row is null or _sets <> 3 or kept_text <> 'k'").count() == 0
                docs = after
        assert (after.count() > 0) == bool(kept)
