from __future__ import annotations

from vecspark import maintenance as M
from vecspark.facades import DocumentStore, Repository
from vecspark.table import VectorTable


def embed(texts):
    return [[float(t.count(c)) for c in "abcd"] for t in texts]


def test_document_store(spark, tmp_path):
    store = DocumentStore.open(spark, str(tmp_path / "s"), embed, 4)
    store = store.add(["aaa", "abb", "ccd"], [1, 2, 3], [{"year": 2020}, {"year": 2021}, None]).add(["dddd"], [3]).save("docs")
    assert [r["id"] for r in store.similar("aa", 2)] == [1, 2] and store.table.count() == 3
    assert [(r["id"], r["text"]) for r in store.similar("aa", 5, where="year > 2020")] == [(2, "abb")]
    assert [r["id"] for r in store.similar("dddd", 5, threshold=0.5)] == [3]
    left, any_deleted = store.delete([1, 99])
    assert any_deleted and left.table.count() == 2 and not store.delete([99])[1]
    assert store.delete_where("year == 2021").table.count() == 2 and store.clear().table.count() == 0
    assert DocumentStore.open(spark, str(tmp_path / "s"), embed, 4).table.count() == 3


def test_repository(spark, tmp_path):
    t = VectorTable.create(spark, str(tmp_path / "r"), 4).insert([1, 2, 3, 4], "a").sync("one")
    main = Repository(t)
    other = main.branch("other")
    other = Repository(other.table.insert([4, 3, 2, 1], "b").sync("two"))
    assert main.system_id() == other.system_id() and main.snapshot_id() == t.get_commit_id() and main.conflicts("other") == []
    merged = main.merge("other")
    assert merged.table.count() == 2 and merged.snapshot_meta()["vector_count"] == 2 and merged.snapshot_id() not in merged.ancestors()
    assert {tuple(r) for r in merged.diff(t.get_commit_id(), merged.snapshot_id()).collect()} == {("b", "string", "added")}
    assert merged.as_of(t.get_commit_id()).count() == 1 and merged.checkout("other").table.count() == 2
    assert merged.branch("third", t.get_commit_id()).table.count() == 1 and len(merged.history(1)) == 1
    stats = M.storage_stats(merged.table)
    assert stats["files"] > stats["snapshot_files"] > 0 and stats["bytes"] > stats["snapshot_bytes"] > 0
