"""Other ways to address a table: as a version-control system, and as a document store."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.table import VectorTable


class Repository:
    """A table as a version-control system; it follows one branch."""

    def __init__(self, table: VectorTable):
        self.table = table

    def system_id(self) -> str:
        return self.table.store.read("config.json").get("table_id", self.table.store.root)

    def snapshot_id(self) -> str | None:
        return self.table.get_commit_id()

    def snapshot_meta(self, commit_id: str | None = None) -> dict | None:
        return self.table.commit_info(commit_id or self.table.parent)

    def as_of(self, commit_id: str) -> VectorTable:
        return VectorTable.load_commit(self.table.spark, self.table.store.root, commit_id)

    def checkout(self, branch: str) -> Repository:
        return Repository(self.table.checkout(branch))

    def branch(self, name: str, source: str | None = None) -> Repository:
        """A new branch from a branch or commit, or from here."""
        at = self.table
        if source is not None:
            at = at.checkout(source) if source in at.branches() else self.as_of(source)
        return Repository(at.make_branch(name))

    def history(self, limit: int | None = None) -> list[dict]:
        return self.table.history(limit)

    def ancestors(self, commit_id: str | None = None) -> list[str]:
        """Without the commit itself."""
        return self.table.ancestors(commit_id, include_self=False)

    def merge(self, source: str, message: str | None = None) -> Repository:
        return Repository(self.table.merge(source, "all", message))

    def conflicts(self, source: str) -> list:
        """None ever: ids that are on both sides keep the target's vector."""
        return []

    def diff(self, a: str, b: str) -> DataFrame:
        """(id, id_type, change) between two commits; ids only."""
        return self.as_of(a).diff(self.as_of(b))


class DocumentStore:
    """Texts with metadata, embedded by a function from texts to vectors. Adding an id that is there replaces it."""

    def __init__(self, table: VectorTable, embed: Callable[[Sequence[str]], Sequence[Sequence[float]]]):
        self.table, self.embed = table, embed

    @classmethod
    def open(cls, spark: SparkSession, root: str, embed: Callable, dim: int, **options: Any) -> DocumentStore:
        try:
            return cls(VectorTable.load(spark, root), embed)
        except FileNotFoundError:
            return cls(VectorTable.create(spark, root, dim, **options), embed)

    def add(self, texts: Sequence[str], ids: Sequence[Any] | None = None, metadata: Sequence[dict | None] | None = None) -> DocumentStore:
        ids = [None] * len(texts) if ids is None else list(ids)
        metadata = [None] * len(texts) if metadata is None else list(metadata)
        own = [{**(m or {}), "text": t} for t, m in zip(texts, metadata, strict=True)]
        known = [i for i in ids if i is not None]
        table = self.table.delete_batch(known) if known else self.table
        return DocumentStore(table.insert_batch(self.embed(texts), ids, own), self.embed)

    def delete(self, ids: Iterable[Any]) -> tuple[DocumentStore, bool]:
        """The store without them, and whether any was there."""
        ids = list(ids)
        found = self.table._filtered(ids).limit(1).count() > 0
        return DocumentStore(self.table.delete_batch(ids), self.embed), found

    def delete_where(self, predicate: str) -> DocumentStore:
        return DocumentStore(self.table.delete_where(predicate), self.embed)

    def clear(self) -> DocumentStore:
        return DocumentStore(self.table.delete_where(F.lit(True)), self.embed)

    def similar(self, text: str, k: int = 4, threshold: float = 0.0, where: Any = None) -> list[dict]:
        """(id, text, metadata, score) of the most similar; filters apply before the k best are chosen, so none is missed."""
        found = self.table.search(self.embed([text])[0], k, where, threshold, with_metadata=True)
        return [{"id": r["id"], "text": r["metadata"].get("text"), "metadata": r["metadata"], "score": 1 / (1 + r["distance"]) if r["distance"] > -1 else None} for r in found]

    def save(self, message: str | None = None) -> DocumentStore:
        return DocumentStore(self.table.sync(message), self.embed)
