"""Text features: exact sparse TF-IDF and BM25 tables, plus the Spark ML pipeline variant.

Exact tables are long-form rows (no vectors): ``doc_terms(id, term, tf)``, ``vocab(term, df, idf)``.
Per-document term counting is a map-side partial aggregate; document frequency is a grouped
count with partial aggregation, so frequent terms never gather their postings in one task.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CLEAN_PATTERN, ENGLISH_STOP_WORDS, analyze, clean_text, tokenize
from ..session import child_session, read_file, shuffle_partitions, write_file
from ..sources.io import stage_buckets, stage_once
from .ordering import hot_keys, spread_join

BM25_K1 = 1.2
BM25_B = 0.75


def _store(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents that enter the feature store: non-null id and text, id as string."""
    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(
        F.col("id").isNotNull() & F.col("text").isNotNull()
    )


def _analyzed_rows(df: DataFrame, key: Sequence[str], text: str, analyzer) -> DataFrame:
    """One row per analyzed token. With the default analyzer, tokens are exploded first and
    stop words dropped by a plain ``NOT IN`` filter (a hash-set test inside generated code),
    instead of a per-element lambda over each token array."""
    if analyzer is analyze:
        toks = df.select(*key, F.explode(tokenize(clean_text(F.col(text)))).alias("term"))
        return toks.where(~F.col("term").isin(*sorted(set(ENGLISH_STOP_WORDS))))
    return df.select(*key, F.explode(analyzer(F.col(text))).alias("term"))


#: Text of one task of a count, and index rows of one task, about: what is counted or sorted stays in memory.
TASK_TEXT, TASK_ROWS = 16 << 20, 2_000_000
#: Terms that may be broadcast (a word and two numbers each): some 50 MB.
SMALL_TERMS = 500_000
#: Documents of a slice, about, and slices of a corpus at the least. A slice is always in one task.
SLICE_DOCS, SLICES = 256, 64
SLICED_TERMS = "slice int, id string, term string, tf long"


def text_parts(docs: DataFrame, text_col: str = "title") -> int:
    """How many tasks the texts of ``docs`` are worth."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // TASK_TEXT))


def doc_terms(docs: DataFrame, id_col: str = "id", text_col: str = "title", analyzer=analyze, parts: int | None = None) -> DataFrame:
    """``(id, term, tf)``: raw term counts per document.

    The texts are dealt by id, which is less to move than their counts, and all tasks tokenise
    whatever the files' cut; counting needs no further shuffle, as a document's rows are together.
    ``parts``: the number of tasks (``text_parts``, so that none counts more the larger the corpus is)."""
    store = _store(docs, id_col, text_col).repartition(parts or shuffle_partitions(docs.sparkSession), "id")
    return _analyzed_rows(store, ["id"], "text", analyzer).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def slice_of(id_col: str, slices: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(slices)).cast("int").alias("slice")


def slices_for(n_docs: int) -> int:
    return max(SLICES, -(-n_docs // SLICE_DOCS))


def sliced_terms(docs: DataFrame, id_col: str, text_col: str, slices: int, parts: int) -> DataFrame:
    """``doc_terms`` with the documents' slices, by which the texts are dealt."""
    store = _store(docs, id_col, text_col).select(slice_of("id", slices), "id", "text").repartition(parts, "slice")
    return _analyzed_rows(store, ["slice", "id"], "text", analyze).groupBy("slice", "id", "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_smooth(df: Column, n_docs: int) -> Column:
    """Spark ML IDF: ln((N + 1) / (df + 1)); an unseen term (df 0) gets ln(N + 1)."""
    return F.log((F.lit(float(n_docs)) + 1.0) / (df.cast("double") + 1.0))


def idf_bm25(df: Column, n_docs: int) -> Column:
    """Okapi BM25 idf: ln(1 + (N - df + 0.5) / (df + 0.5))."""
    d = df.cast("double")
    return F.log(1.0 + (F.lit(float(n_docs)) - d + 0.5) / (d + 0.5))


def vocabulary(terms: DataFrame, n_docs: int, idf=idf_smooth) -> DataFrame:
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", idf(F.col("df"), n_docs))


def frequencies(terms: DataFrame) -> DataFrame:
    """``(term, df)``: how many documents have each term."""
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _kept(df: DataFrame, store: str | None, name: str, *order: str, key: str | None = None) -> DataFrame:
    """``df``, or with a ``store`` its table there, written once for each ``key``, ranged and sorted by ``order`` so
    that a lookup on the first of them reads only the row groups that can hold it."""
    if store is None:
        return df
    ready = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
    return stage_once(df.sparkSession, _at(store, name), lambda: ready, key=key)


def _at(store: str, name: str) -> str:
    return f"{store.rstrip('/')}/{name}"


@dataclass
class Counts:
    """What both indexes are made of: whole numbers that add up over parts of a corpus."""

    terms: DataFrame  # id, term, tf
    df: DataFrame  # term, df
    lengths: DataFrame  # id, doc_len (every stored document; 0 without terms)
    n_docs: int
    total_len: int
    hot: DataFrame | None = None  # term, salts of the terms that many documents have
    slices: int = SLICES
    dealt: DataFrame | None = None  # slice, id, term, tf: ``terms`` in buckets by slice

    def vocabulary(self, idf=idf_smooth) -> DataFrame:
        return self.df.select("term", "df", idf(F.col("df"), self.n_docs).alias("idf"))

    @property
    def parts(self) -> tuple[int, ...]:
        """The number of tasks for all postings, if there are so many that the session's own would be too few."""
        n = -(-self.total_len // TASK_ROWS)
        return (n,) if n > shuffle_partitions(self.df.sparkSession) else ()

    @property
    def few_terms(self) -> bool:
        """Whether the vocabulary of a stored index may be broadcast: postings needn't move to meet it then."""
        return self.hot is not None and self.df.limit(SMALL_TERMS + 1).count() <= SMALL_TERMS

    @property
    def avg_len(self) -> float:
        return self.total_len / self.n_docs if self.n_docs else 0.0

    def sliced(self) -> DataFrame:
        """``(slice, id, term, tf, df)``, slices whole in their tasks.

        Counts in buckets stay where they are. The terms that most documents have are broadcast; only
        postings of the others move, without their counts, to meet the document frequency and back."""
        df = self.df.select("term", "df")
        if self.dealt is None:
            known = spread_join(self.terms, df, "term", self.hot, "id").select(slice_of("id", self.slices), "id", "term", "tf", "df")
            return known.repartition(*self.parts, "slice")
        if self.few_terms:
            return self.dealt.join(F.broadcast(df), "term")
        least = common_from(df)
        often = F.broadcast(df.where(F.col("df") >= least).select("term", F.col("df").alias("__often")))
        seldom = self.dealt.select("slice", "id", "term").join(often, "term", "left_anti").join(
            df.where(F.col("df") < least).select("term", F.col("df").alias("__seldom")), "term")
        known = self.dealt.join(often, "term", "left").join(seldom.hint("shuffle_hash"), ["slice", "id", "term"], "left")
        return known.select("slice", "id", "term", "tf", F.coalesce("__often", "__seldom").alias("df"))


def common_from(df: DataFrame) -> int:
    """The least power of two that at most ``SMALL_TERMS`` terms have as document frequency."""
    sizes = {r["power"]: r["n"] for r in df.groupBy(F.floor(F.log2("df")).alias("power")).agg(F.count(F.lit(1)).alias("n")).collect()}
    power = max(sizes, default=-1) + 1
    known = 0
    while power > 0 and known + sizes.get(power - 1, 0) <= SMALL_TERMS:
        power -= 1
        known += sizes.get(power, 0)
    return 1 << power


def document_lengths(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(id, doc_len)``: analyzed tokens of each document, the sum of its term counts."""
    summed = terms.groupBy("id").agg(F.sum("tf").alias("doc_len"))
    return texts.select("id").join(summed, "id", "left").select("id", F.coalesce("doc_len", F.lit(0)).cast("long").alias("doc_len"))


def count_terms(docs: DataFrame, id_col: str = "id", text_col: str = "title", store: str | None = None, key: str | None = None) -> Counts:
    """Term counts, document frequencies, lengths. With a store they are tables there, which the
    indexes in that folder share, and the hot terms are known.

    Stored counts lie in buckets by slices of documents, so that whatever is made of them for a document, or
    for a term in a slice, is made without moving them."""
    if store is None:
        terms = doc_terms(docs, id_col, text_col)
        lengths = document_lengths(_store(docs, id_col, text_col), terms)
        n, total = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0))).first()
        return Counts(terms, frequencies(terms), lengths, int(n), int(total))
    spark, texts = docs.sparkSession, _store(docs, id_col, text_col)
    n, size = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    slices, parts = slices_for(n), max(shuffle_partitions(spark), -(-int(size or 0) // TASK_TEXT))
    # with these settings counts in buckets by slice needn't move to be joined or grouped by slice and more
    own = child_session(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.requireAllClusterKeysForCoPartition": "false",
                                "spark.sql.sources.bucketing.enabled": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"})
    dealt = stage_buckets(own, _at(store, "terms"), lambda: sliced_terms(docs, id_col, text_col, slices, parts), SLICED_TERMS, "slice", parts, ["id", "term"],
                          key=key)
    terms = spark.read.schema(SLICED_TERMS).parquet(_at(store, "terms")).select("id", "term", "tf")
    df = _kept(frequencies(terms), store, "frequencies", "term", key=key)
    lengths = _kept(document_lengths(texts, terms).withColumn("slices", F.lit(slices)), store, "lengths", key=key)
    n, total, slices = lengths.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_len"), F.lit(0)), F.coalesce(F.max("slices"), F.lit(SLICES))).first()
    return Counts(terms, df, lengths.select("id", "doc_len"), int(n), int(total), hot_keys(df, "term", "df", shuffle_partitions(spark)), int(slices), dealt)


def _with_ranks(docs: DataFrame, ranks: DataFrame | None) -> DataFrame:
    """``docs`` with the link rank ``pr`` of each id, 0.0 where there is none."""
    if ranks is None:
        return docs.withColumn("pr", F.lit(0.0))
    known = ranks.select("id", F.col("rank").alias("pr"))
    return docs.join(known, "id", "left").withColumn("pr", F.coalesce("pr", F.lit(0.0)))


# --- TF-IDF -------------------------------------------------------------------------------------

@dataclass
class TfidfIndex:
    """Exact TF-IDF store. ``postings`` carry the length-normalised weight ``nw = tf*idf / norm``
    and the document's link rank ``pr``; ``docs`` lists every stored document with ``pr``."""

    terms: DataFrame  # id, term, tf
    vocab: DataFrame  # term, df, idf
    weights: DataFrame  # id, term, tf, idf, weight
    norms: DataFrame  # id, norm   (every stored document; 0.0 when it has no terms)
    postings: DataFrame  # term, id, nw, pr
    docs: DataFrame  # id, pr
    n_docs: int
    hot: DataFrame | None = None  # term, salts of the terms that many documents have


def with_idf(rows: DataFrame, vocab: DataFrame, hot: DataFrame | None = None, few: bool = False) -> DataFrame:
    known = vocab.select("term", "idf")
    return rows.join(F.broadcast(known), "term") if few else spread_join(rows, known, "term", hot, "id")


def tfidf_weights(terms: DataFrame, vocab: DataFrame, hot: DataFrame | None = None, few: bool = False) -> DataFrame:
    return with_idf(terms, vocab, hot, few).select("id", "term", "tf", "idf", (F.col("tf") * F.col("idf")).alias("weight"))


def tfidf_from(counts: Counts, ranks: DataFrame | None = None, store: str | None = None, key: str | None = None) -> TfidfIndex:
    """Weights, norms and postings. A document's rows are together in the counts: there its rank is
    joined and its norm is summed (a window over its terms), and its postings are written by the same task, sorted by
    term. They hold counts and the norm; weights are what these give where they are read."""
    own = counts.sliced()
    weight = F.col("tf") * idf_smooth(F.col("df"), counts.n_docs)
    rows = _with_slice_ranks(own, ranks, counts.slices).withColumn("norm", F.sqrt(F.sum(weight * weight).over(Window.partitionBy("slice", "id"))))
    rows = rows.select("term", "id", "tf", "df", "norm", "pr")
    if store is not None:
        rows = stage_once(counts.df.sparkSession, _at(store, "postings"), lambda: rows.sortWithinPartitions("term", "id"), key=key)
    norms = rows.groupBy("id").agg(F.max("norm").alias("norm"))
    docs = counts.lengths.select("id").join(norms, "id", "left").select("id", F.coalesce("norm", F.lit(0.0)).alias("norm"))
    docs = _kept(_with_ranks(docs, ranks).select("id", "pr", "norm"), store, "documents", key=key)
    return _tfidf_index(counts, rows, docs)


def _tfidf_index(counts: Counts, rows: DataFrame, docs: DataFrame) -> TfidfIndex:
    """The index of ``rows`` (``term, id, tf, df, norm, pr``) and ``docs`` (``id, pr, norm``)."""
    weighted = rows.withColumn("idf", idf_smooth(F.col("df"), counts.n_docs)).withColumn("weight", F.col("tf") * F.col("idf"))
    postings = weighted.select(
        # every word of a document may be in all documents: all its weights, and its norm, are 0
        "term", "id", F.when(F.col("norm") > 0, F.col("weight") / F.col("norm")).otherwise(F.lit(0.0)).alias("nw"), "pr"
    )
    return TfidfIndex(counts.terms, counts.vocabulary(), weighted.select("id", "term", "tf", "idf", "weight"), docs.select("id", "norm"), postings,
                      docs.select("id", "pr"), counts.n_docs, counts.hot)


def _with_slice_ranks(rows: DataFrame, ranks: DataFrame | None, slices: int) -> DataFrame:
    """``_with_ranks`` of rows that are dealt by slice: the ranks go to them."""
    if ranks is None:
        return rows.withColumn("pr", F.lit(0.0))
    known = ranks.select(slice_of("id", slices), "id", F.col("rank").alias("pr"))
    return rows.join(known.hint("shuffle_hash"), ["slice", "id"], "left").withColumn("pr", F.coalesce("pr", F.lit(0.0)))


def build_tfidf(docs: DataFrame, ranks: DataFrame | None = None, id_col: str = "id", text_col: str = "title",
                store: str | None = None, key: str | None = None) -> TfidfIndex:
    """Fit + transform: counts, document frequencies, weights, norms, postings.

    Without a ``store`` all tables are one lazy plan (small corpora). With one, each is written
    once under that folder (finished tables of the same ``key`` are reused; without a key, any): counts
    by document, so that lookups push their predicates into the scan, and postings sorted by term in each file, which
    are those of some slices of documents. A hot term is therefore in all files. A manifest is committed last:
    ``open_tfidf`` needs nothing but the folder.
    """
    counts = count_terms(docs, id_col, text_col, store, key)
    index = tfidf_from(counts, ranks, store, key)
    if store is not None:
        commit_manifest(docs.sparkSession, store, "tfidf", counts, key)
    return index


def tfidf_lookup(index: TfidfIndex, paper_id: str, required: bool = False) -> DataFrame:
    """``(id, term, weight)`` of one stored document. Of a stored index only the row groups that
    can hold the id are read. With ``required`` an id that isn't stored raises LookupError."""
    known = F.col("id") == F.lit(str(paper_id))
    if required and index.docs.where(known).isEmpty():
        raise LookupError(f"no document with id {paper_id!r}")
    rows = index.terms.where(known)  # a document's terms: few
    return index.vocab.select("term", "idf").join(F.broadcast(rows), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("weight"))


def tfidf_vector(spark, text: str, index: TfidfIndex) -> DataFrame:
    """``(term, tf, weight)`` of a new text under the index's document frequencies; a word that
    no document has gets the idf of document frequency 0."""
    terms = query_terms(spark.createDataFrame([("new", text)], "query_id string, query string"))
    known = terms.join(index.vocab.select("term", "df"), "term", "left")
    return known.select(
        "term", F.col("qtf").alias("tf"), (F.col("qtf") * idf_smooth(F.coalesce("df", F.lit(0)), index.n_docs)).alias("weight"))


def query_terms(queries: DataFrame, analyzer=analyze) -> DataFrame:
    """``(query_id, term, qtf)`` with repeated query words counted."""
    return _analyzed_rows(queries, ["query_id"], "query", analyzer).groupBy("query_id", "term").agg(
        F.count(F.lit(1)).alias("qtf"))


def query_weights(queries: DataFrame, index: TfidfIndex) -> DataFrame:
    """``(query_id, term, qnw)``: TF-IDF query weights divided by the query norm. Unseen words get
    idf ln(N+1) and count in the norm (as an unseen hash slot does in the ML model)."""
    qt = query_terms(queries).join(index.vocab.select("term", "df"), "term", "left")
    qw = qt.select("query_id", "term", (F.col("qtf") * idf_smooth(F.coalesce("df", F.lit(0)), index.n_docs)).alias("qw"))
    norms = qw.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    return qw.join(norms, "query_id").where(F.col("qnorm") > 0).select(
        "query_id", "term", (F.col("qw") / F.col("qnorm")).alias("qnw")
    )


# --- BM25 ---------------------------------------------------------------------------------------

#: Documents of a block, about (see ``with_blocks``).
BLOCK_DOCS = 32


@dataclass
class Bm25Index:
    postings: DataFrame  # term, id, tf, doc_len, w, pr[, block]
    vocab: DataFrame  # term, df, idf
    doc_len: DataFrame  # id, doc_len
    n_docs: int
    avg_len: float
    terms: DataFrame | None = None  # id, term, tf
    hot: DataFrame | None = None  # term, salts
    blocks: DataFrame | None = None  # term, block, n, top_w, top_pr, low_w, low_pr


def with_blocks(lengths: DataFrame) -> DataFrame:
    """``lengths`` (``slice, id, doc_len``...) with ``block``: documents of like length of a slice, ``BLOCK_DOCS`` of them
    but in a slice's last block, share one. An id may come several times: ``times`` says how often, ``copy`` numbers them.

    Length moves a term's weight, so a block's largest weight is close to most of its weights."""
    place = F.dense_rank().over(Window.partitionBy("slice").orderBy("doc_len", "id")) - 1
    block = F.shiftleft(F.col("slice").cast("long"), 32) + F.floor(place / F.lit(BLOCK_DOCS))
    same = Window.partitionBy("slice", "id")
    return lengths.select("*", block.alias("block"), F.count(F.lit(1)).over(same).alias("times"), F.row_number().over(same.orderBy("doc_len")).alias("copy"))


def with_block_bounds(rows: DataFrame) -> DataFrame:
    """``rows`` (``slice, term, block, id, w, pr, times, copy``...), sorted by term, block and id in their tasks. The first of a
    term's postings in a block has the number ``n`` of its documents there and, if there are more postings, the largest and
    smallest weight and rank (``top_w, top_pr, low_w, low_pr``); these columns are null in the others. A document that
    comes several times weighs as often, as in a score."""
    cell = Window.partitionBy("term", "slice", "block")
    first = F.row_number().over(cell.orderBy("id")) == 1
    whole = F.col("w") * F.col("times")
    bounds = {"top_w": F.max(whole), "top_pr": F.max("pr"), "low_w": F.min(whole), "low_pr": F.min("pr")}
    found = {"many": F.count(F.lit(1)), "n": F.count_if(F.col("copy") == 1), **bounds}
    rows = rows.sortWithinPartitions("term", "slice", "block", "id").withColumn("__first", first)
    for name, agg in found.items():
        rows = rows.withColumn(f"__{name}", agg.over(cell))
    kept = [F.when(F.col("__first") & (F.col("__many") > 1), F.col(f"__{name}")).alias(name) for name in bounds]
    plain = [c for c in rows.columns if not c.startswith("__") and c not in ("times", "copy")]
    return rows.select(*plain, F.when(F.col("__first"), F.col("__n")).alias("n"), *kept)


def block_bounds(rows: DataFrame) -> DataFrame:
    """``(term, block, n, top_w, top_pr, low_w, low_pr)``: documents of a block with a term, their largest and
    smallest weight and rank, from ``with_block_bounds``."""
    own = [F.coalesce(name, name[-2:].strip("_")).alias(name) for name in ("top_w", "top_pr", "low_w", "low_pr")]
    return rows.where(F.col("n").isNotNull()).select("term", "block", "n", *own)


def bm25_weight(tf: Column, idf: Column, doc_len: Column, avg_len: float, k1: float | Column = BM25_K1, b: float | Column = BM25_B) -> Column:
    k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (k1, b))
    norm_len = k1 * ((F.lit(1.0) - b) + b * doc_len / F.lit(avg_len if avg_len else 1.0))
    return idf * (tf.cast("double") * (k1 + F.lit(1.0))) / (tf.cast("double") + norm_len)


def bm25_from(counts: Counts, ranks: DataFrame | None = None, k1: float = BM25_K1, b: float = BM25_B, store: str | None = None,
              key: str | None = None) -> Bm25Index:
    """Postings, and with a ``store`` block bounds. Lengths and ranks (a row a document) go to the counts, which don't
    move; postings are written with the counts that their weights are made of where they are read."""
    lens = _with_ranks(counts.lengths, ranks).select(slice_of("id", counts.slices), "id", "doc_len", "pr")
    if store is not None:
        lens = with_blocks(lens)
    rows = counts.sliced().join(lens.hint("shuffle_hash"), ["slice", "id"]).withColumn("k1", F.lit(float(k1))).withColumn("b", F.lit(float(b)))
    if store is not None:
        rows = with_block_bounds(_with_bm25_weight(rows, counts)).drop("slice", "w")
        rows = stage_once(counts.df.sparkSession, _at(store, "postings-bm25"), lambda: rows, key=key)
    return _bm25_index(counts, rows)


def _with_bm25_weight(rows: DataFrame, counts: Counts) -> DataFrame:
    idf = idf_bm25(F.col("df"), counts.n_docs)
    return rows.withColumn("w", bm25_weight(F.col("tf"), idf, F.col("doc_len"), counts.avg_len, F.col("k1"), F.col("b")))


def _bm25_index(counts: Counts, rows: DataFrame) -> Bm25Index:
    """The index of ``rows`` (``term, id, tf, df, doc_len, pr, k1, b``; stored ones have blocks and their bounds)."""
    weighted, stored = _with_bm25_weight(rows, counts), "block" in rows.columns
    postings = weighted.select("term", "id", "tf", "doc_len", "w", "pr", *(["block"] if stored else []))
    return Bm25Index(postings, counts.vocabulary(idf_bm25), counts.lengths, counts.n_docs, counts.avg_len, counts.terms, counts.hot,
                     block_bounds(weighted) if stored else None)


def build_bm25(docs: DataFrame, ranks: DataFrame | None = None, id_col: str = "id", text_col: str = "title",
               k1: float = BM25_K1, b: float = BM25_B, store: str | None = None, key: str | None = None) -> Bm25Index:
    """Inverted index for lexical matching: per (term, doc) the BM25 term weight and the rank.

    ``store`` and ``key`` as in ``build_tfidf`` (the two may share a folder, and then share their counts).
    A stored index also has block bounds, by which searches skip postings."""
    counts = count_terms(docs, id_col, text_col, store, key)
    index = bm25_from(counts, ranks, k1, b, store, key)
    if store is not None:
        commit_manifest(docs.sparkSession, store, "bm25", counts, key)
    return index


# --- stored indexes -----------------------------------------------------------------------------

FORMAT = 4


def analyzer_id() -> str:
    """Changes whenever the analyzer would give other terms."""
    return hashlib.sha256("\n".join([CLEAN_PATTERN, *ENGLISH_STOP_WORDS]).encode()).hexdigest()[:16]


def commit_manifest(spark, store: str, kind: str, counts: Counts, key: str | None) -> None:
    """The last thing written of an index: what its tables don't say themselves."""
    facts = {"kind": kind, "format": FORMAT, "analyzer": analyzer_id(), "key": key, "n_docs": counts.n_docs, "total_len": counts.total_len}
    write_file(spark, _at(store, f"manifest-{kind}.json"), json.dumps(facts, indent=1).encode())


def read_manifest(spark, store: str, kind: str) -> dict:
    """The manifest, or FileNotFoundError if no index of this kind was finished there; ValueError if it
    was written by another format or analyzer, under which its terms mean something else."""
    raw = read_file(spark, _at(store, f"manifest-{kind}.json"))
    if raw is None:
        raise FileNotFoundError(f"no finished {kind} index in {store}")
    facts = json.loads(raw)
    for name, now in (("format", FORMAT), ("analyzer", analyzer_id())):
        if facts[name] != now:
            raise ValueError(f"the {kind} index in {store} has {name} {facts[name]}, this library has {now}: build it again")
    return facts


def _stored_counts(spark, store: str, kind: str) -> Counts:
    facts = read_manifest(spark, store, kind)
    table = lambda name: spark.read.parquet(_at(store, name))
    df = table("frequencies")
    return Counts(spark.read.schema(SLICED_TERMS).parquet(_at(store, "terms")).select("id", "term", "tf"), df, table("lengths").select("id", "doc_len"), facts["n_docs"], facts["total_len"],
                  hot_keys(df, "term", "df", shuffle_partitions(spark)))


def open_tfidf(spark, store: str) -> TfidfIndex:
    """The TF-IDF index that ``build_tfidf`` wrote to ``store``: lookups and searches without the corpus."""
    counts = _stored_counts(spark, store, "tfidf")
    return _tfidf_index(counts, spark.read.parquet(_at(store, "postings")), spark.read.parquet(_at(store, "documents")))


def open_bm25(spark, store: str) -> Bm25Index:
    """The BM25 index that ``build_bm25`` wrote to ``store``."""
    return _bm25_index(_stored_counts(spark, store, "bm25"), spark.read.parquet(_at(store, "postings-bm25")))


# --- Spark ML variant (hashed features, VectorUDT) --------------------------------------------

def ml_stages(text: str, out: str, buckets: int, stop_words: list[str] | None = None) -> list:
    """The ML stages that turn ``text`` into TF-IDF vectors ``out``, with the hashed raw counts in
    ``{out}_counts`` on the way. ``stop_words``: the library's own list unless given; an empty
    list drops that stage, for texts that are analysed already."""
    from pyspark.ml import feature as ml

    words, kept, counts = (f"{out}_{step}" for step in ("words", "kept", "counts"))
    stages = [ml.Tokenizer(inputCol=text, outputCol=words)]
    if stop_words is None or stop_words:
        stages.append(ml.StopWordsRemover(inputCol=words, outputCol=kept, **({"stopWords": stop_words} if stop_words else {})))
    else:
        kept = words
    stages.append(ml.HashingTF(inputCol=kept, outputCol=counts, numFeatures=buckets))
    return [*stages, ml.IDF(inputCol=counts, outputCol=out)]


def ml_tfidf(docs: DataFrame, id_col: str = "id", text_col: str = "title", buckets: int = 1 << 18,
             stop_words: list[str] | None = None):
    """The fitted ML pipeline and its vectors ``(id, counts, vector)``; rows with a null id or text
    are left out (the tokenizer rejects null)."""
    from pyspark.ml import Pipeline

    texts = _store(docs, id_col, text_col)
    model = Pipeline(stages=ml_stages("text", "vector", buckets, stop_words)).fit(texts)
    return model, ml_vectors(model, docs, id_col, text_col)


def ml_vectors(model, docs: DataFrame, id_col: str = "id", text_col: str = "title") -> DataFrame:
    out = model.transform(_store(docs, id_col, text_col))
    return out.select("id", F.col("vector_counts").alias("counts"), "vector")


#: How sparse vectors lie in Parquet; read with this schema they are plain structs.
STORED_VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def ml_vector_summary(vectors: DataFrame, path: str) -> DataFrame:
    """``(id, total, nnz, norm)``: summed raw counts, distinct hashed words, and length of ML vectors.

    The vectors are written to ``path`` and read back as the structs they are stored as, so
    built-in functions reach their parts."""
    vectors.write.parquet(path)
    stored = vectors.sparkSession.read.schema(f"id string, counts {STORED_VECTOR}, vector {STORED_VECTOR}").parquet(path)
    squares = F.aggregate("vector.values", F.lit(0.0), lambda a, x: a + x * x)
    total = F.aggregate("counts.values", F.lit(0.0), lambda a, x: a + x)
    return stored.select("id", total.alias("total"), F.size("counts.indices").cast("long").alias("nnz"), F.sqrt(squares).alias("norm"))
