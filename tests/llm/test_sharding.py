import pytest
from blockloom.llm import sharding
from blockloom.llm.sharding import CommitConflict, Store


def docs(spark, ids):
    return spark.createDataFrame([(i, None if i % 7 == 0 else "text %d " % i * 50, "x") for i in ids], "doc_id long, text string, shard string")


def test_appends_compact_and_stay_readable(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "SMALLEST", 64)
    store = Store(spark, str(tmp_path / "s"), target=1 << 20)
    assert store.read() is None and store.compact() == 0
    for k in range(5):
        store.append(docs(spark, range(100 * k, 100 * k + 100)).coalesce(1))
    before = store.versions()[-1]
    old = [s.path for s in store.manifest(before)]
    after = store.compact()
    assert after > before and len(store.manifest(after)) < len(old)
    assert sorted(r.doc_id for r in store.read(after).collect()) == list(range(500))
    assert sorted(r.doc_id for r in store.read(before).collect()) == list(range(500))  # old versions stay whole
    assert sum(s.rows for s in store.manifest(after)) == 500
    assert store.read(after).columns == ["doc_id", "text", "shard"]
    store.vacuum()
    assert store.read(before).count() == 500


def test_a_lost_race_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.append(docs(spark, range(3)))
    with pytest.raises(CommitConflict):
        store.commit(0, [])
    assert store.read().count() == 3


def test_two_writers_that_both_pass_the_test(spark, tmp_path, monkeypatch):
    """Both find no version 2 and write their shards; the rename lets one of them through, and a given publish may do so instead."""
    root = str(tmp_path / "s")
    one = Store(spark, root)
    one.append(docs(spark, range(3)))
    two = Store(spark, root)
    real = two.fs

    class Blind:
        def __getattr__(self, name):
            return (lambda path: False) if name == "exists" else getattr(real, name)

    two.fs = Blind()
    one.append(docs(spark, range(3, 6)))
    with pytest.raises(CommitConflict):
        two.commit(1, two.manifest(1))
    assert one.versions() == [1, 2] and sorted(r.doc_id for r in two.read().collect()) == list(range(6))
    taken = []
    with pytest.raises(CommitConflict):
        Store(spark, root, publish=lambda path, data: taken.append(path)).append(docs(spark, [9]))
    assert taken[0].endswith("manifest-0000000003.json") and one.read().count() == 6


def test_contents_against_brute_force(spark, tmp_path, monkeypatch):
    """After every commit each version holds exactly the rows appended before it; parts that lost nothing are used again."""
    monkeypatch.setattr(sharding, "SMALLEST", 64)
    monkeypatch.setattr(sharding, "PART", 2)
    store, want, seen = Store(spark, str(tmp_path / "s"), target=4000), [], {}
    for k in range(7):
        arrival = docs(spark, [*range(9 * k, 9 * k + k + 2), 3]).coalesce(1 + k % 2)
        want += [(r.doc_id, r.text) for r in arrival.collect()]
        seen[store.append(arrival)] = list(want)
        if k % 3 == 2:
            seen[store.compact()] = list(want)
    long = spark.createDataFrame([(1, "x" * 3_000_000, None)], "doc_id long, text string, shard string")
    parts = {s.part for s in store.manifest()}
    seen[store.append(long)] = want + [(1, "x" * 3_000_000)]
    assert parts < {s.part for s in store.manifest()}
    key = lambda r: (r[0], r[1] or "")
    for version, rows in seen.items():
        assert sorted(((r.doc_id, r.text) for r in store.read(version).collect()), key=key) == sorted(rows, key=key)
        assert sum(s.rows for s in store.manifest(version)) == len(rows)


def test_query_shape_for_clashing_columns_nulls_and_empty_tables(spark):
    rows = docs(spark, [1, 1, 7, 8])
    got = sharding.shard_documents(rows)
    assert got.columns == ["doc_id", "shard", "shard_rows", "tier", "version"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 1, 7, 8]
    assert sharding.shard_documents(rows.filter("false")).count() == 0


def test_columns_that_come_go_and_change(spark, tmp_path, monkeypatch):
    """Compaction merges shards of one schema only: nothing that an arrival brought is lost, in any version."""
    monkeypatch.setattr(sharding, "SMALLEST", 64)
    store = Store(spark, str(tmp_path / "s"), target=1 << 20)
    arrivals = [("a long, b string", (1, "x")), ("a long, b string, extra double", (2, "y", 0.5)), ("a long", (3,)), ("a int, b string", (4, "z"))]
    want = []
    for k in range(5):
        for schema, row in arrivals:
            store.append(spark.createDataFrame([(row[0] + 10 * k, *row[1:])], schema).coalesce(1))
            want.append((row[0] + 10 * k, row[1] if len(row) > 1 else None, row[2] if len(row) > 2 else None))
    before, after = store.versions()[-1], store.compact()
    assert len(store.manifest(after)) < len(store.manifest(before)) == 20
    assert len({s.schema for s in store.manifest(after)}) == 4
    for version in (before, after):
        assert sorted(tuple(r[c] for c in ("a", "b", "extra")) for r in store.read(version).collect()) == sorted(want)
    store.vacuum()
    assert store.read().count() == 20


def test_an_append_reads_no_list(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.append(docs(spark, range(3)))
    got = []
    real = store._get
    monkeypatch.setattr(store, "_get", lambda name: got.append(name) or real(name))
    store.append(docs(spark, range(3, 6)))
    assert got == ["manifest-0000000001.json"] and store.read().count() == 6
