"""Views that present the driver's tables in the paper-corpus shape.

* ``papers(id, title)``: one row per document; ``title`` is the *whole* document text (no prefix).
* ``edges(src, dst)``: one row per line item whose order key is a document id (duplicates kept).
* ``papers_with_refs(id, title, references)``: the array form, for the array/JSON operators.

Edges are derived relationally (semi-join), so no reference list is gathered for the graph path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    cited = items.join(docs, items.l_orderkey == docs.doc_id, "left_semi")
    return cited.select(
        F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst")
    )


def papers_with_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``references`` = cited part keys as strings, ordered numerically, duplicates kept, NULL if none."""
    docs = table(spark, sf_dir, "documents")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    items = items.join(docs.select(F.col("doc_id").alias("l_orderkey")), "l_orderkey", "left_semi")
    refs = items.groupBy("l_orderkey").agg(
        F.transform(F.sort_array(F.collect_list("l_partkey")), lambda k: k.cast("string")).alias("references")
    )
    return docs.join(refs, docs.doc_id == refs.l_orderkey, "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), "references"
    )


def timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``timings(key, seconds)`` from ``events``: event type as key, value as seconds."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("key"), F.col("value").alias("seconds"))


def web_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of raw pages: page url (no query/fragment) -> site root + each root-relative href."""
    pages = table(spark, sf_dir, "pages").select("url", "html")
    base = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1)
    src = F.regexp_replace("url", r"[?#].*$", "")
    hrefs = F.regexp_extract_all("html", F.lit(r"""<a\s[^>]*href="(/[^"]*)\""""), 1)
    return pages.select(src.alias("src"), base.alias("base"), F.explode(hrefs).alias("path")).select(
        "src", F.concat("base", "path").alias("dst")
    )


def purchase_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> part (via orders and line items) and part -> supplier edges."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    cp = items.join(orders, items.l_orderkey == orders.o_orderkey).select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"),
    )
    ps = items.select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"),
    )
    return cp.unionByName(ps)


def spans_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same as ``spans`` without a per-user window: rows are globally sorted by (user, ts, id),
    so one very active user is spread over many tasks; each row meets its successor by position."""
    from ..operators.ordering import with_global_position

    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    pos = with_global_position(ev, [F.col("user_id").asc(), F.col("ts").asc(), F.col("event_id").asc()])
    nxt = pos.select((F.col("pos") - 1).alias("pos"), F.col("user_id").alias("n_user"), F.col("ts").alias("end_ts"))
    return pos.join(nxt, "pos").where(F.col("user_id") == F.col("n_user")).select(
        "event_id", F.col("ts").alias("start_ts"), "end_ts"
    )


def papers_by_id(spark: SparkSession, sf_dir: str, paper_id: str) -> DataFrame:
    """Point lookup on the papers view (no row if there is none) with the predicate on the source key, so it reaches the
    Parquet scan (``cast(doc_id as string) = '7'`` cannot be pushed; ``doc_id = 7`` can)."""
    view = papers(spark, sf_dir)
    if paper_id.isdigit() and str(int(paper_id)) == paper_id:
        docs = table(spark, sf_dir, "documents").where(F.col("doc_id") == F.lit(int(paper_id)))
        return docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"))
    return view.where(F.col("id") == F.lit(paper_id))


def paper_or_error(spark: SparkSession, sf_dir: str, paper_id: str) -> DataFrame:
    """``papers_by_id`` that raises LookupError if no paper has the id."""
    found = papers_by_id(spark, sf_dir, paper_id)
    if found.isEmpty():
        raise LookupError(f"no paper with id {paper_id!r}")
    return found
