"""An index that grows: upserts, deletions and merges without a rebuild.

The index is a folder of *segments*, each the term counts and lengths of one batch of documents, which
never change. A later version of a document, or its deletion, is a row of the *dead* table beside
the segment that brought it: the earlier segment's rows of that id no longer count. What statistics
need are sums: each batch also writes by how much it *changes* the document frequency of
each term (its own documents less those it kills), so the corpus frequency is a sum over batches.

Folder and commit: tables go to new names; then a manifest ``versions/<n>.json`` that lists all that
counts is created under a number that must be new. A reader takes the highest one and sees a
whole version; of two writers at once one fails (FileExistsError) and can try again. ``merge`` writes
the living rows as one segment; ``clean`` removes what no version since then names.

Weights depend on the whole corpus, so they are made when an index is opened: ``bm25`` and ``tfidf`` give
the same indexes as a build over the living documents.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_path, file_system, read_file, shuffle_partitions, write_file
from .features import (TASK_ROWS, Bm25Index, Counts, TfidfIndex, _store, analyzer_id, bm25_from, doc_terms, document_lengths, frequencies, slices_for,
                       text_parts, tfidf_from)
from .ordering import hot_keys

EMPTY = {"version": 0, "segments": [], "dead": [], "changes": [], "n_docs": 0, "total_len": 0}
TERMS, LENGTHS = "segment string, id string, term string, tf long", "segment string, id string, doc_len long"
DEAD, CHANGES = "segment string, id string", "term string, ddf long"


class SegmentedIndex:
    """The index in the folder ``path``; an empty one if there is none yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.facts = self._latest()
        if self.facts["version"] and self.facts["analyzer"] != analyzer_id():
            raise ValueError(f"the index in {path} was written under another analyzer: build it again")

    # --- versions

    def _versions(self) -> list[int]:
        fs, where = file_system(self.spark, f"{self.path}/versions")
        if not fs.exists(where):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _latest(self) -> dict:
        known = self._versions()
        return json.loads(read_file(self.spark, f"{self.path}/versions/{known[-1]}.json")) if known else dict(EMPTY)

    def _commit(self, **facts) -> None:
        new = {**self.facts, **facts, "version": self.facts["version"] + 1, "analyzer": analyzer_id()}
        write_file(self.spark, f"{self.path}/versions/{new['version']}.json", json.dumps(new, indent=1).encode(), new=True)
        self.facts = new

    # --- tables

    def _all(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{kind}/{n}" for n in names])

    def _write(self, kind: str, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/{kind}/{name}")
        return name

    def _dead(self) -> DataFrame:
        return self._all("dead", self.facts["dead"], DEAD)

    def _living(self, kind: str, schema: str) -> DataFrame:
        both = ["segment", "id"]
        return self._dealt(self._all(kind, self.facts["segments"], schema), both).join(self._dealt(self._dead(), both), both, "left_anti")

    def _dealt(self, df: DataFrame, by: list[str]) -> DataFrame:
        """``df`` in as many tasks as the index is worth, if the session's own would be too few."""
        parts = -(-self.facts["total_len"] // TASK_ROWS)
        return df.repartition(parts, *by) if parts > shuffle_partitions(self.spark) else df

    def terms(self) -> DataFrame:
        """``(id, term, tf)`` of the living documents."""
        return self._living("terms", TERMS).select("id", "term", "tf")

    def lengths(self) -> DataFrame:
        """``(id, doc_len)`` of the living documents."""
        return self._living("lengths", LENGTHS).select("id", "doc_len")

    def frequencies(self) -> DataFrame:
        """``(term, df)``: the sum of all changes."""
        total = self._all("changes", self.facts["changes"], CHANGES).groupBy("term").agg(F.sum("ddf").alias("df"))
        return total.where(F.col("df") > 0)

    # --- writing

    def _killed(self, ids: DataFrame) -> DataFrame:
        """``(segment, id, doc_len)``: the living rows of ``ids``."""
        return self._living("lengths", LENGTHS).join(ids.select("id"), "id", "left_semi").select("segment", "id", "doc_len")

    def _change(self, dead: DataFrame, new_terms: DataFrame | None) -> DataFrame:
        both = ["segment", "id"]
        terms, killed = self._dealt(self._all("terms", self.facts["segments"], TERMS), both), self._dealt(dead.select(*both), both)
        gone = terms.join(killed, both, "left_semi")
        parts = [frequencies(gone).select("term", (-F.col("df")).alias("ddf"))]
        if new_terms is not None:
            parts.append(frequencies(new_terms).select("term", F.col("df").alias("ddf")))
        both = reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("ddf").alias("ddf"))
        return both.where(F.col("ddf") != 0)

    def upsert(self, docs: DataFrame, id_col: str = "id", text_col: str = "title") -> None:
        """Add documents; those whose ids are there already replace them. Rows without id or text are
        ignored; of several texts of one id in a batch the last in their own order counts."""
        parts = text_parts(docs, text_col)
        batch = _store(docs, id_col, text_col).repartition(parts, "id").groupBy("id").agg(F.max("text").alias("text"))
        name = uuid.uuid4().hex
        counted = doc_terms(batch, "id", "text", parts=parts)
        counted.select(F.lit(name).alias("segment"), "id", "term", "tf").write.parquet(f"{self.path}/terms/{name}")
        terms = self._all("terms", [name], TERMS)
        lengths = document_lengths(batch, terms)
        lengths.select(F.lit(name).alias("segment"), "id", "doc_len").write.parquet(f"{self.path}/lengths/{name}")
        lengths = self._all("lengths", [name], LENGTHS)
        self._finish(lengths, terms, name)

    def delete(self, ids: DataFrame) -> None:
        """Take the documents with these ``id``s out; unknown ones don't matter."""
        self._finish(ids.select(F.col("id").cast("string").alias("id")).distinct(), None, None)

    def _finish(self, ids: DataFrame, terms: DataFrame | None, segment: str | None) -> None:
        killed = self._write("killed", self._killed(ids))
        dead = self.spark.read.schema(f"{DEAD}, doc_len long").parquet(f"{self.path}/killed/{killed}")
        n_dead, len_dead = dead.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        n_new, len_new = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first() if segment else (0, 0)
        changes = self._write("changes", self._change(dead, terms))
        self._commit(
            segments=[*self.facts["segments"], *([segment] if segment else [])],
            dead=[*self.facts["dead"], self._write("dead", dead.select("segment", "id"))],
            changes=[*self.facts["changes"], changes],
            n_docs=self.facts["n_docs"] + n_new - n_dead, total_len=self.facts["total_len"] + len_new - len_dead)

    def merge(self) -> None:
        """One segment of all living documents in place of the segments so far."""
        name = uuid.uuid4().hex
        for kind, rows, columns in (("terms", self.terms(), ("id", "term", "tf")), ("lengths", self.lengths(), ("id", "doc_len"))):
            ready = rows.select(F.lit(name).alias("segment"), *columns).repartitionByRange("id").sortWithinPartitions("id")
            ready.write.parquet(f"{self.path}/{kind}/{name}")
        changes = self._write("changes", self.frequencies().select("term", F.col("df").alias("ddf")))
        self._commit(segments=[name], dead=[], changes=[changes])

    def clean(self) -> None:
        """Remove all tables and versions that the latest one doesn't name (none may be in use)."""
        keep = {"terms": "segments", "lengths": "segments", "dead": "dead", "changes": "changes", "killed": None}
        for kind, names in keep.items():
            fs, where = file_system(self.spark, f"{self.path}/{kind}")
            for f in fs.listStatus(where) if fs.exists(where) else []:
                if names is None or f.getPath().getName() not in self.facts[names]:
                    drop_path(self.spark, f.getPath().toString())
        for v in self._versions()[:-1]:
            drop_path(self.spark, f"{self.path}/versions/{v}.json")

    # --- reading

    def counts(self) -> Counts:
        df = self.frequencies()
        hot = hot_keys(df, "term", "df", shuffle_partitions(self.spark))
        return Counts(self.terms(), df, self.lengths(), self.facts["n_docs"], self.facts["total_len"], hot, slices_for(self.facts["n_docs"]))

    def bm25(self, ranks: DataFrame | None = None, store: str | None = None, **params) -> Bm25Index:
        """The BM25 index of the living documents (lazy; with a ``store``, as tables with block bounds)."""
        return bm25_from(self.counts(), ranks, store=store, **params)

    def tfidf(self, ranks: DataFrame | None = None, store: str | None = None) -> TfidfIndex:
        return tfidf_from(self.counts(), ranks, store=store)
