"""Operators against brute force, exact round trips and held-out accuracy on small fixtures with awkward rows."""

import hashlib
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import ann, components, decontam, langid, license_scan, packing, quality, simhash, sstable, substring, tokens, toxicity

DOC = "doc_id long, text string, lang string, TextOther string, fp long, score double, id string"


def table(spark, rows):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", "x", 1, 0.5, "y") for i, t in rows], DOC)


@pytest.fixture(scope="module")
def rows(words):
    base = [(i, words(40 + 3 * i, i)) for i in range(30)]
    passage = words(60, 999)
    out = base + [(100 + i, t) for i, t in base[:8]] + [(200 + i, t + " changed") for i, t in base[8:14]]
    out += [(300 + i, words(30, 500 + i) + " " + passage + "\n" + words(20, 700 + i)) for i in range(6)]
    out += [(400, None), (401, ""), (402, "   \n"), (403, "one"), (404, "One  Two\tthree"), (405, words(9000, 5)), (406, "ünï çødé " * 9)]
    return out


def test_simhash_matches_brute_force(spark, rows):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(table(spark, rows)).collect()}
    assert got == simhash.brute_force(rows)
    assert got[400][0] == "0" * 16 and got[401][1] == got[400][1] == 400


def clusters(n, size, spread, seed=1):
    rng = np.random.default_rng(seed)
    codes = []
    for b in rng.integers(0, 2**63, size=n, dtype=np.uint64):
        for _ in range(size):
            x = int(b)
            for k in rng.choice(64, size=rng.integers(0, spread), replace=False):
                x ^= 1 << int(k)
            codes.append(x)
    return np.unique(np.array(codes, dtype=np.uint64))


def groups_of(codes, max_bits=4):
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= max_bits
    want = simhash._Forest(len(codes))
    want.unite(*np.nonzero(near))
    return want.find(np.arange(len(codes)))


@pytest.mark.parametrize("frontier", [400_000, 300])
def test_simhash_index_finds_every_link_and_prunes(monkeypatch, frontier):
    monkeypatch.setattr(simhash, "_FRONTIER", frontier)
    codes = clusters(25, 40, 7)
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    starts = np.array([0, 1, 3, 300, len(codes)])
    index = simhash.GrayIndex(codes, starts)
    got = index.components(4)
    for a, b in zip(starts, starts[1:]):
        assert (got[a:b] == a + groups_of(codes[a:b])).all()
    assert index.pruned > len(codes)


def test_simhash_prunes_on_the_documents(spark, sf):
    pruned = spark.sparkContext.accumulator(0)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs, pruned=pruned).collect()}
    assert got == {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.query(spark, sf).collect()}
    assert pruned.value > len({f for f, _ in got.values()})


def test_simhash_empty_repeated_and_null_ids(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    got = simhash.near_duplicates(table(spark, [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "z z z z q")])).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got if r.component_id) == [(0, 1), (1, 1), (1, 1)]


@pytest.mark.parametrize(("node", "depth", "chunk"), [(4096, 4, 65_536), (40, 4, 65_536), (8, 1, 20), (8, 0, 8)])
def test_simhash_large_nodes_are_split(spark, monkeypatch, node, depth, chunk):
    for name, value in (("NODE", node), ("DEPTH", depth), ("CHUNK", chunk)):
        monkeypatch.setattr(simhash, name, value)
    base = 0x0123456789ABCDEF
    codes = np.unique(np.concatenate([clusters(6, 30, 7, seed=2), np.array([base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(12)], np.uint64)]))
    nodes = spark.createDataFrame([(c,) for c in codes.view(np.int64).tolist()], "fp long")
    found = {r.node: r.root for r in components.connected_components(simhash.links(nodes)).collect()}
    got = np.array([found.get(c, c) for c in codes.view(np.int64).tolist()])
    want = groups_of(codes)
    assert all(len(set(got[want == w])) == 1 for w in set(want)) and len(set(got)) == len(set(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("block_bytes", [16 << 20, 200])
def test_decontamination_matches_brute_force(spark, rows, words, block_bytes):
    items = [(i, words(20, 30 + i)) for i in range(5)] + [(7, "one"), (8, None), (9, ""), (10, rows[3][1][:150]), (11, rows[20][1]), (11, "Two Three")]
    docs = rows[:40] + rows[-7:]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.judge(decontam.scan(table(spark, docs), bench, block_bytes=block_bytes, keep=["TextOther"]))
    want = {r[0]: r[1:] for r in decontam.brute_force(docs, items)}
    assert got.columns[:5] == ["doc_id", "n_words", "spans", "items", "row"] and got.select("row.*").columns == ["TextOther"]
    for r in got.collect():
        assert (r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.contaminated) == want[r.doc_id]
    none = decontam.judge(decontam.scan(table(spark, docs), bench.limit(0)))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(docs)


@pytest.mark.parametrize(("batches", "bits"), [(1, 20), (4, 20), (4, 6), (4, -6)])
def test_substring_dedup_matches_brute_force(spark, rows, monkeypatch, batches, bits):
    """With few bits nearly every window meets false candidates: only comparing words tells them apart."""
    if bits < 20:
        made = substring.WindowIndex.__init__

        def narrow(self, spark, path, b, buckets, fanout=4):
            made(self, spark, path, 16 + bits, 16, fanout)

        monkeypatch.setattr(substring.WindowIndex, "__init__", narrow)
    compacted = []
    merge = substring.WindowIndex.compact
    monkeypatch.setattr(substring.WindowIndex, "compact", lambda self: compacted.append((merge(self), len(self.runs()))))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text or "") for r in substring.deduplicate(table(spark, rows), batches=batches, bucket_windows=500, keep=["lang"]).collect()}
    assert got == substring.brute_force(rows)
    # each batch writes its run, and three runs become one
    assert compacted == ([(0, 1)] if batches == 1 else [(0, 1), (0, 2), (1, 1), (0, 2)])


def test_substring_words_are_compared():
    a, b, c = (b" ".join(b"%s%d" % (x, i) for i in range(15)) for x in (b"a", b"b", b"c"))
    docs, repeat = np.array([1, 5, 7, 9, 3]), np.array([False, True, True, True, True])
    found = substring._compared([a, a, b, b, c], docs, repeat, 13)
    assert sorted(set(d for d, _ in found)) == [3, 7] and all(w in (b if d == 7 else c) for d, w in found)
    assert len(found) == 6


def test_substring_index_over_tables_and_compaction(spark, rows, tmp_path):
    path = f"file://{tmp_path}/index"
    tables = [[(i + 1000 * k, t) for i, t in rows[:20]] + [(1000 * k + 500, rows[20 + k][1])] for k in range(4)]
    seen = None
    for k, own in enumerate(tables):
        docs = table(spark, own)
        out = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.deduplicate(docs, batches=1, index_path=path, history=seen).collect()}
        want = substring.brute_force([x for t in tables[: k + 1] for x in t])
        assert out == {i: want[i] for i, _ in own}
        seen = docs if seen is None else seen.unionByName(docs)
    index = substring.WindowIndex(spark, path, 50, 16)
    assert any(level > 0 for level, _, _ in index.runs()) and len(index.runs()) == 2 and index.largest_id() == 3500
    with pytest.raises(ValueError, match="history"):
        substring.deduplicate(docs, index_path=path)
    with pytest.raises(ValueError, match="larger"):
        substring.deduplicate(docs, index_path=path, history=seen)


def test_substring_empty_and_null_ids(spark, words):
    assert substring.deduplicate(table(spark, [])).count() == 0
    t = words(30, 1)
    got = substring.deduplicate(table(spark, [(None, t), (5, t), (5, t), (None, t)])).collect()
    assert all(r.n_removed == 0 for r in got) and len(got) == 4
    odd = spark.createDataFrame([(1, t, "a", 1, "x"), (2, t + " more", "b", 2, "y"), (3, t, None, None, None), (4, None, None, None, None)], "doc_id long, text string, kept_text string, doc long, _sets string")
    out = {r.doc_id: r for r in substring.remove(odd).collect()}
    assert set(out) == {1, 2, 4} and out[2].text == "more" and out[2].kept_text == "b" and out[2].doc == 2 and out[2]["_sets"] == "y" and out[4].text is None


def test_packed_hashes_round_trip():
    h = np.sort(np.random.default_rng(0).integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    assert (substring._unpack(substring._pack(h), 1000) == h).all()
    assert len(substring._unpack(substring._pack(h[:0]), 0)) == 0


def test_ann_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16))
    x[200:400] = x[200]  # a third are one vector
    rows = [(i, x[i].astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 15 + [None]), (1080, [1.0] * 3), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in ann.search(df, F.col("id") % 20 == 0, 20, recall=0.95).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = ann.brute_force([r for r in rows if r[0] is None or r[0] not in (1080,)])
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 21)) for g in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {v[0] for v in got[q].values()}) / 20 for q in want]) >= 0.9
    assert [v[0] for _, v in sorted(got[200].items())] == [i for i, _ in want[200]]
    assert ann.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    assert ann.search(df, F.col("id") == 7_000_000).count() == 0


def test_ann_in_blocks_with_clashing_columns(spark):
    x = np.random.default_rng(5).normal(size=(300, 8))
    rows = [(i, x[i].tolist(), 1, 2, 3.0, [4]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, leaf int, e double, leaves array<int>")
    one = sorted(map(tuple, ann.search(df, F.col("id") % 20 == 0, 20, recall=1.0).collect()))
    assert one == sorted(map(tuple, ann.search(df, F.col("id") % 20 == 0, 20, recall=1.0, query_block=4).collect()))
    want = ann.brute_force([r[:2] for r in rows])
    assert [(q, n, v) for q, n, v, _ in one] == [(q, n, v) for q in sorted(want) for n, (v, _) in enumerate(want[q], 1)]


def test_ann_lists_are_full_where_leaves_are_small(spark, monkeypatch):
    monkeypatch.setattr(ann, "_calibrated", lambda *a: 1)
    x = np.random.default_rng(6).normal(size=(23, 16))
    rows = [(100 * j + i, x[j].tolist()) for j in range(20) for i in range(100)] + [(10_000 + 20 * j + i, x[20 + j].tolist()) for j in range(3) for i in range(5)]
    rows += [(10_000, x[20].tolist())] * 30  # its own rows are no candidates
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {r.query_id: r["count"] for r in ann.search(df, F.col("id") % 20 == 0, 20).groupBy("query_id").count().collect()}
    assert len(found) == 103 and set(found.values()) == {20}


def test_tokens_are_the_librarys(rows):
    e = tokens.CachedEncoder(entries=50)
    for t in [*(t for _, t in rows if t), "a  b", "\n\n x", " lead", "tail ", "don't I'll 12ab ² ñ \x85 z", "<|endoftext|> x", "a.\nB c!! d,"]:
        assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    assert e.raw(None) == b""


def test_other_tokenizers_are_used_whole(tmp_path):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    assert tokens.CachedEncoder().byte_level
    made = Tokenizer.from_file(tokens.default_path())
    made.normalizer = normalizers.Lowercase()
    made.save(str(tmp_path / "lower.json"))
    plain = Tokenizer(models.WordLevel({"a": 0, "b": 1, "?": 2}, unk_token="?"))
    plain.pre_tokenizer = pre_tokenizers.Whitespace()
    plain.save(str(tmp_path / "words.json"))
    for name in ("lower", "words"):
        e = tokens.CachedEncoder(str(tmp_path / f"{name}.json"))
        assert not e.byte_level
        for t in ("A b", "a  Zz b", "HELLO World", ""):
            assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids


def test_words_with_marks_and_line_breaks():
    e = tokens.CachedEncoder(entries=50)
    for head in ("the", "Éa", "日x", "ʰ", "b2", "'", ""):
        for tail in (".", "!,", "###", ".'", "'s", "'s.", "!'ll,", "…", ".\nThe", "\nÉb.", "\n\nx", ".\n x", "\r\nx", "\n1", ".\nb's\nc", "\x85y", "\n\u0301z"):
            for t in (head + tail, f"x {head}{tail} y", f"x  {head}{tail}\n"):
                assert e.ids(t).tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_encoders_are_kept_until_the_file_changes(tmp_path):
    from tokenizers import Tokenizer, normalizers

    path = str(tmp_path / "t.json")
    made = Tokenizer.from_file(tokens.default_path())
    made.save(path)
    first = tokens.kept_encoder(path)
    first.raw("kept between tasks")
    assert tokens.kept_encoder(path) is first and "between" in first.young
    made.normalizer = normalizers.Lowercase()
    made.save(path)
    assert tokens.kept_encoder(path).ids("UPPER").tolist() == made.encode("UPPER", add_special_tokens=False).ids
    assert tokens.kept_encoder() is tokens.kept_encoder(tokens.default_path()) is not first


def test_packing(spark, rows):
    out = packing.pack(table(spark, rows), with_ids=True)
    e = tokens.CachedEncoder()
    by_doc, by_seq = {}, {}
    for r in out.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in rows:
        ids = [*e.ids(t).tolist(), 2]
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            own = ids[at : at + r.length]
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(struct.pack(f"<{len(own)}I", *own)))
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.sequences(out).count() == len(by_seq)
    assert packing.pack(table(spark, [])).count() == 0


def test_null_ids_are_packed_and_judged(spark, words):
    docs = table(spark, [(None, words(50, 1)), (None, None), (3, words(2000, 2)), (3, words(2000, 2))])
    got = packing.pack(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in got} == {None, 3}
    assert packing.pack(docs).where("doc_id is null").count() == 2
    bench = spark.createDataFrame([(None, words(50, 1)), ("b", words(50, 1)), ("b", None)], "item_id string, text string")
    judged = decontam.judge(decontam.scan(docs, bench)).where("doc_id is null").collect()
    assert sorted(r.n_hit for r in judged) == [0, 50] and sorted(len(r["items"]) for r in judged) == [0, 1]


def test_packing_plans_are_whole_and_tight():
    rng = np.random.default_rng(3)
    bent = np.clip(np.exp(rng.normal(5.8, 0.7, 60_000)).astype(int), 1, 1024)
    for lengths in (rng.integers(1, 1025, 60_000), rng.integers(400, 700, 500), rng.integers(1000, 1024, 7), rng.integers(1, 30, 900), bent, np.full(90, 512), np.full(91, 513), np.full(3, 1024)):
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
        for runs in (packing.linear_grouping(counts), packing.linear_grouping(counts, groups=7, small=100), packing.best_fit_decreasing(counts)):
            used: dict = {}
            for own, m in runs:
                assert sum(own) <= 1024 and m > 0
                for x in own:
                    used[x] = used.get(x, 0) + m
            assert used == counts
        n = sum(m for _, m in packing.linear_grouping(counts))
        assert n <= 1.001 * sum(m for _, m in packing.best_fit_decreasing(counts)) + 1
    assert packing.linear_grouping({}) == []


def test_packing_nears_the_bound(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("length", "sequence_id").toPandas()
    assert rows.sequence_id.nunique() <= 1.003 * np.ceil(rows.length.sum() / 1024)


def test_licenses(spark):
    text = "Copyright (c) 2020 Someone\n\n" + license_scan.MIT.upper().replace("SUBLICENSE", "sub-licence")
    docs = table(spark, [(1, text), (2, "prose\nLicensed under the  Apache Licence, version 2.0\nmore"), (3, None), (4, ""), (5, text), (5, text), (6, license_scan.MIT + " but")])
    for limit in (20_000, 1):
        got = sorted(((r.doc_id, r.license_id, r.notices) for r in license_scan.scan(docs, license_scan.builtin_registry(spark), broadcast_rows=limit).collect()), key=str)
        assert got == [(1, "MIT", ""), (2, None, "Apache-2.0"), (3, None, ""), (4, None, ""), (5, "MIT", ""), (5, "MIT", ""), (6, None, "")]


def test_licenses_wrapped_commented_and_without_their_words(spark):
    wrapped = license_scan.ISC.replace("above copyright notice", "above\ncopyright notice")
    marked = "# Copyright 2021 Some One\n// (c) 2020 Another\n * © A Third\n" + license_scan.ISC
    bsd = " ".join((license_scan._BSD_HEAD + license_scan._BSD_TAIL).split())
    docs = table(spark, [(1, wrapped), (2, marked), (3, f"prose\n  * {bsd}\nmore"), (4, "x\nSPDX: Z-1\ny"), (5, license_scan.ISC.replace("copyright notice", "\nnotice"))])
    known = license_scan.builtin_registry(spark).unionByName(spark.createDataFrame([("Z-1", "SPDX: Z-1")], "license_id string, text string"), allowMissingColumns=True)
    for limit in (20_000, 1):
        got = sorted((r.doc_id, r.license_id, r.notices) for r in license_scan.scan(docs, known, broadcast_rows=limit).collect())
        assert got == [(1, "ISC", ""), (2, "ISC", ""), (3, None, "BSD-2-Clause"), (4, None, "Z-1"), (5, None, "")]


@pytest.mark.skipif(not os.path.exists("/usr/share/common-licenses/MPL-2.0"), reason="no whole licence texts here")
def test_whole_licenses(spark):
    rows = []
    for name, n in (("Apache-2.0", 1), ("GPL-3", 2), ("GPL-2", 3), ("LGPL-2.1", 4), ("MPL-2.0", 5), ("CC0-1.0", 6)):
        with open(f"/usr/share/common-licenses/{name}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        rows += [(n, text), (10 + n, "Copyright (c) 2024 Someone\n" + text.upper().replace("\n", "\r\n  ")), (20 + n, text[:-300])]
    got = {r.doc_id: r.license_id for r in license_scan.scan(table(spark, rows), license_scan.builtin_registry(spark)).collect()}
    want = dict(enumerate(["Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"], 1))
    assert got == {**want, **{10 + n: i for n, i in want.items()}, **{20 + n: None for n in want}}


def test_licenses_of_empty_tables_and_long_texts(spark, words):
    known = license_scan.builtin_registry(spark)
    assert license_scan.scan(table(spark, []), known).count() == 0
    docs = table(spark, [(1, words(40_000, 3) + "\nReleased under the MIT License.\n" + words(40_000, 4)), (None, license_scan.MIT)])
    for registry in (known, known.limit(0)):
        got = {r.doc_id: (r.license_id, r.notices) for r in license_scan.scan(docs, registry).collect()}
        assert got == ({1: (None, "MIT"), None: ("MIT", "")} if registry is known else {1: (None, ""), None: (None, "")})


@pytest.mark.parametrize("module", [decontam, substring])
def test_whole_tables_match_sql(spark, sf, module):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = module.query(spark, sf)
    want = con.execute(module.oracle_sql())
    at = [[d[0] for d in want.description].index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_license_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = {tuple(r) for r in con.execute(f"select doc_id, digest, license_id, notices from ({license_scan.oracle_sql()})").fetchall()}
    assert {(r.doc_id, r.digest, r.license_id, r.notices) for r in license_scan.query(spark, sf).collect()} == want


def test_shards_round_trip(spark, rows, tmp_path):
    docs = rows + [(None, "no key"), (3, "again")]
    folder = f"file://{tmp_path}/shards"
    manifest = spark.createDataFrame(sstable.write_shards(table(spark, docs), folder, shard_ids=2000).toPandas())
    got = sstable.read_shards(spark, folder, manifest).collect()
    e = tokens.CachedEncoder()
    want = sorted((-1 if i is None else i, len(e.ids(t)) + 1) for i, t in docs)
    assert sorted((-1 if r.id is None else r.id, r.n_tokens) for r in got) == want
    at, texts = 0, {}
    for i, t in docs:
        texts.setdefault(i, []).append(zlib.crc32(struct.pack(f"<{len(e.ids(t)) + 1}I", *e.ids(t).tolist(), 2)))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        texts[r.id].remove(r.ids_crc32)
    assert not any(texts.values())
    by_start = [r.id for r in sorted(got, key=lambda r: r.start)]
    assert by_start[0] is None and by_start[1:] == sorted(by_start[1:])
    none = f"file://{tmp_path}/none"
    empty = sstable.write_shards(table(spark, []), none)
    assert sstable.read_shards(spark, none, empty).count() == 0


def test_shard_tasks_share_a_workers_encoder(spark, rows, tmp_path):
    for k in range(2):
        assert sstable.write_shards(table(spark, rows), f"file://{tmp_path}/{k}").count() > 0

    def seen(batches):
        for _ in batches:
            info = tokens._kept.cache_info()
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "made": [info.misses], "again": [info.hits]})

    workers = {r.pid: r for r in spark.range(0, 64, 1, 16).mapInArrow(seen, "pid long, made long, again long").collect()}
    assert any(r.again for r in workers.values()) and all(r.made <= 1 for r in workers.values())


def test_shard_lookup():
    w = sstable.ShardWriter(2, block_bytes=64)
    for i in range(-50, 500, 3):
        w.add(sstable.key_bytes(i), np.arange(i % 7, dtype="<u2").tobytes())
    r = sstable.ShardReader(w.finish())
    assert r.entries == len(range(-50, 500, 3)) and len(r.index) > 3
    assert all(len(r.get(i)) == 1 and len(r.get(i)[0]) == i % 7 for i in range(-50, 500, 3))
    assert all(r.get(i) == [] for i in range(-49, 500, 3))
    with pytest.raises(ValueError):
        sstable.ShardReader(b"x" * 100)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = langid.query(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (out.lang == out.lang_pred).mean() >= 0.9
    odd = langid.identify(table(spark, [(1, None), (2, ""), (3, "12 !!")]), None)
    assert {r.lang_pred for r in odd.collect()} == {"und"}
    assert langid.fit(docs.limit(0)) is None and langid.identify(docs.limit(0), None).count() == 0
    learned = langid.fit(docs)
    long = "Der Hund und die Katze gehen in das Haus. " * 30_000
    odd = langid.identify(table(spark, [(1, long), (1, long), (None, "und"), (5, "z")]), learned).collect()
    assert len(odd) == 4 and odd[0].lang_pred == odd[1].lang_pred and all(0 <= r.score <= 1 and r.lang_pred in learned.languages for r in odd)
    net = langid.ByteConvNet(["a", "b"])
    net.train(*(lambda x: (x[0], np.repeat([0, 1], x[1])))(langid.windows_of(["aaa bbb " * 40, "zzz yyy " * 40])), steps=60)
    assert net.predict(["bbb aaa aaa", "1", None, "yyy zzz"])[0] == ["a", "und", "und", "b"]


def test_small_language_is_learned(spark):
    rows = [(i, "aaa bbb abba baab " * 5, "a") for i in range(4000)] + [(None if i % 2 else 5000 + i, "zzz yyy zyzy yzzy " * 5, "z") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs, fit_rows=20)
    assert net.languages == ["a", "z"]
    assert net.predict(["zyzy zzz", "abba aaa"])[0] == ["z", "a"]


def test_quality_and_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    q = quality.query(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    bad = q.quality == 0
    assert (q.predicted == q.quality).mean() >= 0.93 and q.score.between(0, 1).all()  # 0.84 of them are good
    assert (q.predicted[bad] == 0).mean() >= 0.6
    t = toxicity.query(spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    order = t.score.rank().to_numpy()
    y = t.toxic.to_numpy()
    n = y.sum()
    assert (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n)) >= 0.8


def test_class_prior_comes_from_positives_and_unlabelled_rows():
    rng = np.random.default_rng(8)
    d = quality.N_FEATURES
    good = lambda n: rng.normal(0.5, 0.4, (n, d))
    bad = lambda n: rng.normal(-0.5, 0.4, (n, d))
    for share in (0.3, 0.6, 0.9):
        n = int(2000 * share)
        mixed = rng.permutation(np.concatenate([good(n), bad(2000 - n)]))
        model = quality.fit_arrays(good(1000), mixed)
        assert abs(model.prior - share) < 0.04
        # without a single bad label
        assert (model.score(good(200)) >= 0.5).mean() > 0.97 and (model.score(bad(200)) < 0.5).mean() > 0.97
        scaled = quality.fit_arrays(good(1000), mixed, bad(300))
        assert scaled.prior == pytest.approx(model.prior, abs=0.05)


def test_quality_without_labels_and_with_one_class(spark, words):
    docs = table(spark, [(i, words(60, i)) for i in range(40)] + [(None, None), (99, "")])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, none) is None and quality.fit(docs.limit(0), none) is None
    bad = spark.createDataFrame([(i, 0) for i in range(10)] + [(None, 1), (11, None)], "doc_id long, quality int")
    assert quality.fit(docs, bad) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    assert quality.keep(docs, None).count() == docs.count()
    good = spark.createDataFrame([(i, 1) for i in range(10)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, good)).where("score >= 0 and score <= 1").count() == docs.count()


def test_toxicity_learns_from_whole_texts(spark, words):
    plain = [(i, words(300, i)) for i in range(120)]
    # the marks stand beyond the first 12,000 characters, after other words each time
    bad = [(1000 + i, words(4000, 300 + i) + " " + " ".join(w + " zquuxly " + v for w, v in zip(words(9, i).split(), words(9, 50 + i).split()))) for i in range(25)]
    long = [(2000 + i, words(4100, 700 + i)) for i in range(25)]
    docs = table(spark, plain + bad + long)
    labels = spark.createDataFrame([(i, int(1000 <= i < 2000)) for i, _ in plain + bad + long], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    fresh = table(spark, [(1, words(50, 9001) + " zquuxly zquuxly " + words(40, 9002) + " zquuxly"), (2, words(90, 9003)), (3, None), (4, "")])
    got = {r.doc_id: r.score for r in toxicity.score(fresh, model).collect()}
    assert b"zquuxly" in model.toxic and b"zquuxly" not in model.ordinary
    assert got[1] > max(got[2], got[3], got[4]) and got[3] == got[4]


def test_quality_where_every_row_is_labelled(spark, words):
    docs = table(spark, [(i, words(80, i) if i % 2 else f"$$$ ### {i} " * 40) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert min(got[i] for i in range(1, 120, 2)) > 0.5 > max(got[i] for i in range(0, 120, 2))


def test_scores_of_odd_rows(spark):
    docs = table(spark, [(1, None), (2, ""), (2, ""), (3, "a " * 50_000)])
    assert {r.score for r in quality.score(docs, None).collect()} == {0.5}
    for y in (0, 1):
        one = spark.createDataFrame([(1, y), (2, y), (3, y), (None, 1 - y), (3, None)], "doc_id long, toxic int")
        model = toxicity.fit(docs, one)
        assert {r.score for r in toxicity.score(docs, model).collect()} == {float(y)}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, one.limit(0))).collect()} == {0.0}
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs.limit(0), one)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0
    rng = np.random.default_rng(0)
    good, bad = rng.normal(1, 0.3, (60, quality.N_FEATURES)), rng.normal(-1, 0.3, (60, quality.N_FEATURES))
    m = quality.fit_arrays(good, np.concatenate([good[:40], bad[:20]]), bad[20:])
    assert m.score(good).min() > 0.5 > m.score(bad).max()
    assert quality.fit_arrays(good[:0], bad) is None
    assert {r.score for r in quality.score(docs.limit(0), m).collect()} == set()
