"""Language identification by Bayesian evidence fusion.

The posterior of a document's language is the product of

* the *text likelihood*: byte trigrams (letters lower-cased, everything else a space) under one
  model for each language, learned from the pages that declare that language in their markup;
* the *declared markup language* of the pages that carry the document, weighed by how often
  each declaration agrees with the text over all such documents;
* a *prior of the address*: the shares of the declared languages at the page's host, smoothed
  towards its domain's, that towards its address suffix's, that towards all pages'. The page's
  own declaration is left out of its prior.

A page carries the document whose id is the last number in its path. Counts are grouped
aggregations over whole tables: tasks emit at most ``BUCKETS`` counts for each language, and the
model (``BUCKETS`` x languages numbers, a fixed size) is the only thing that is collected and
broadcast. A host with a third of all pages is pre-aggregated, and its one row of counts comes
back by a plain equi-join.

A document is rejected as ``und`` (undetermined) if its text has no letters, if independent
letters explain it better than any language does, or if no language's posterior reaches
``MIN_POSTERIOR``. Documents without a page are judged by text and the share of each language.

Nulls: a null text has no letters; a null url, host or declaration is no evidence; a null id
has no page. Repeated rows are judged alike. Ties go to the language that comes first in
``LANGUAGES``. Empty tables: no pages leave the function words below as the only model, no
documents give no rows. Whole texts of any length are read, a part at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LANGUAGES = ("en", "fr", "de", "es")
#: Frequent words of each language: what the models know before they have read a page.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it with as was on are by this be at from or",
    "fr": "le la les de des et un une en est que qui dans pour par sur du au avec pas",
    "de": "der die das und in den von zu mit ist nicht ein eine auf im dem des sich auch als",
    "es": "el la los las de que y en un una por con para se del al es su lo como",
}
WORD_WEIGHT = 5.0
BUCKETS = 1 << 15
#: Trigrams count as this many independent ones at most, so that the other evidence is heard.
INDEPENDENT = 60
MIN_POSTERIOR = 0.5
#: Pseudo-counts with which a level of the address hierarchy trusts the level above.
SMOOTHING = 5.0
PART_CHARS = 1 << 20

#: Where markup may begin, what opens a block whose content is no text, what closes it, and entities.
SIGN = regex.compile(r"[<&]")
BLOCK = regex.compile(r"(?i)<(script|style)\b")
CLOSES = {name: regex.compile(rf"(?i)</{name}\s*+>") for name in ("script", "style")}
ENTITY = regex.compile(r"&#?\w++;")


def visible(html: str) -> str:
    """``html`` with each script or style block, comment, tag and entity as one space.

    One pass: an end that isn't found once (of a block, a comment, a tag) is not looked for again,
    so pages of unclosed tags take no longer than others. What is never closed is text.
    """
    out, lo, gone = [], 0, set()
    sign = SIGN.search(html)
    while sign:
        at, end = sign.start(), -1
        if sign.group() == "&":
            entity = ENTITY.match(html, at)
            end = entity.end() if entity else -1
        else:
            block = BLOCK.match(html, at)
            name = block.group(1).lower() if block else None
            if name and name not in gone:
                close = CLOSES[name].search(html, block.end())
                end = close.end() if close else -1
                if not close:
                    gone.add(name)
            if end < 0 and html.startswith("<!--", at) and "-->" not in gone:
                close = html.find("-->", at + 4)
                end = close + 3 if close >= 0 else -1
                if close < 0:
                    gone.add("-->")
            if end < 0 and ">" not in gone:
                end = html.find(">", at + 1) + 1 or -1
                if end < 0:
                    gone.add(">")
        if end >= 0:
            out += [html[lo:at], " "]
            lo = end
        sign = SIGN.search(html, end if end >= 0 else at + 1)
    return "".join([*out, html[lo:]])



def _classes() -> np.ndarray:
    """Each byte's class: 0 for what is no letter, a-z, and the bytes of other characters."""
    out = np.zeros(256, np.uint32)
    out[97:123] = np.arange(1, 27)
    out[128:] = np.arange(27, 155)
    return out


CLASSES = _classes()


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the trigrams of ``text``, and the classes of their first bytes."""
    c = CLASSES[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    letter = c > 0
    keep = (letter[:-2] & letter[1:-1]) | (letter[1:-1] & letter[2:])  # no two spaces in a row
    a, b, d = c[:-2][keep], c[1:-1][keep], c[2:][keep]
    code = (a * np.uint32(155) + b) * np.uint32(155) + d
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - 15)).astype(np.int32), np.stack([a, b, d])


def parts(text: str) -> Iterator[str]:
    for lo in range(0, len(text), PART_CHARS):
        yield text[lo : lo + PART_CHARS]


class Model:
    """Log-probabilities of trigrams by language, and of single classes."""

    def __init__(self, counts: np.ndarray, singles: np.ndarray, languages: Sequence[str]):
        counts, singles = counts.astype(float), singles.astype(float)
        for k, lang in enumerate(languages):
            for w in FUNCTION_WORDS.get(lang, "").split():
                at, cls = trigrams(w)
                np.add.at(counts[k], at, WORD_WEIGHT)
                np.add.at(singles, cls.ravel(), WORD_WEIGHT)
        smooth = 0.1
        self.grams = np.log((counts + smooth) / (counts.sum(1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float32).copy()
        self.singles = np.log((singles + 0.1) / (singles.sum() + 0.1 * len(singles)))

    def score(self, text: str | None) -> list[float]:
        """Tempered log-likelihood for each language, then the number of trigrams, then how
        much better (per trigram) the best language is than independent letters."""
        total, alone, n = np.zeros(self.grams.shape[1]), 0.0, 0
        for part in parts(text or ""):
            at, cls = trigrams(part)
            if len(at):
                total += self.grams[at].sum(axis=0, dtype=np.float64)
                alone += float(self.singles[cls].sum())
                n += len(at)
        if not n:
            return [0.0] * len(total) + [0.0, 0.0]
        return [*(total / n * min(n, INDEPENDENT)).tolist(), float(n), float((total.max() - alone) / n)]


def host_parts(url: Column) -> dict[str, Column]:
    host = F.nullif(F.lower(F.regexp_extract(url, r"^\w+://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    return {
        "host": host,
        "domain": F.substring_index(host, ".", -2),
        "suffix": F.substring_index(host, ".", -1),
        "doc": F.try_to_number(F.nullif(F.regexp_extract(url, r"/(\d{1,18})(?:\.\w+)?/?(?:[?#].*)?$", 1), F.lit("")), F.lit("9" * 18)).cast("long"),
    }


def markup_language(html: Column) -> Column:
    """The primary subtag of the ``lang`` attribute of a page's ``html`` element, or the empty string."""
    return F.lower(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1))


def page_rows(pages: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``doc, host, domain, suffix, tag`` of each page; ``tag`` is null unless one of the languages."""
    tag = markup_language(F.col("html"))
    return pages.select(
        *[c.alias(n) for n, c in host_parts(F.col("url")).items()],
        F.when(tag.isin(*languages), tag).alias("tag"),
    )


def learn(pages: DataFrame, languages: Sequence[str] = LANGUAGES) -> Model:
    """The text model from all pages, whole, by the language they declare."""
    common.prepare(pages.sparkSession)
    tagged = pages.select(markup_language(F.col("html")).alias("tag"), "html")
    place = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, singles = np.zeros((len(place), BUCKETS), np.int64), np.zeros(155, np.int64)
        for batch in batches:
            for tag, html in zip(batch.column(0), batch.column(1)):
                text = visible(html.as_py() or "")
                for part in parts(text):
                    at, cls = trigrams(part)
                    grams[place[tag.as_py()]] += np.bincount(at, minlength=BUCKETS)
                    singles += np.bincount(cls.ravel(), minlength=155)
        lang, bucket = np.nonzero(grams)
        cls = np.flatnonzero(singles)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(lang, np.full(len(cls), -1)), pa.int32()),
            pa.array(np.append(bucket, cls), pa.int32()),
            pa.array(np.append(grams[lang, bucket], singles[cls]), pa.int64()),
        ], names=["lang", "bucket", "n"])

    counted = tagged.where(F.col("tag").isin(*languages)).mapInArrow(count, "lang int, bucket int, n long")
    # at most (languages x BUCKETS + 155) rows, whatever the data
    summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, bucket, n = (summed.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    grams, singles = np.zeros((len(place), BUCKETS)), np.zeros(155)
    grams[lang[lang >= 0], bucket[lang >= 0]] = n[lang >= 0]
    singles[bucket[lang < 0]] = n[lang < 0]
    return Model(grams, singles, languages)


def text_scores(df: DataFrame, text: str, model: Model) -> Column:
    common.prepare(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for texts in batches:
            yield pa.array([m.score(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return run(df[f"`{text}`"])


def log_priors(rows: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``doc, tag, prior`` of each page that carries a document: log shares of the languages at
    its address, by host, domain, suffix and all pages, without the page itself."""
    own = F.array(*[F.coalesce(F.col("tag") == lang, F.lit(False)).cast("double") for lang in languages])
    per = [F.sum(F.coalesce(F.col("tag") == lang, F.lit(False)).cast("double")) for lang in languages]
    out = rows.where("doc IS NOT NULL").withColumn("own", own)
    totals = rows.agg(F.array(*per)).first()[0]  # one number for each language
    out = out.withColumn("n_all", F.array(*[F.lit(float(n or 0)) for n in totals]))
    for level in ("suffix", "domain", "host"):
        # from a table whose size is known: a suffix or host that many pages share is then no
        # shuffle key, as Spark broadcasts few counts, or one that Spark can split
        counts = common.stage(rows.where(F.col(level).isNotNull()).groupBy(level).agg(F.array(*per).alias(f"n_{level}")), f"{level}-counts")
        out = out.join(counts, level, "left")

    def shares(counts: Column, above: Column | None) -> Column:
        rest = F.zip_with(counts, F.col("own"), lambda n, o: n - o)
        size = F.aggregate(rest, F.lit(0.0), lambda a, x: a + x)
        if above is None:
            return F.transform(rest, lambda n: (n + 1.0) / (size + float(len(languages))))
        return F.coalesce(F.zip_with(rest, above, lambda n, p: (n + SMOOTHING * p) / (size + SMOOTHING)), above)

    out = out.withColumn("p", shares(F.col("n_all"), None))
    for level in ("suffix", "domain", "host"):
        out = out.withColumn("p", shares(F.col(f"n_{level}"), F.col("p")))
    return out.select("doc", "tag", F.transform("p", lambda x: F.log(x)).alias("prior"))


def identify(rows: DataFrame, pages: DataFrame, languages: Sequence[str] = LANGUAGES) -> DataFrame:
    """``row, id, language, posterior, accepted, text_language, declared`` of each of ``rows``
    (``row, id, text``). ``language`` is ``und`` where ``accepted`` is false."""
    k = len(languages)
    addresses = common.stage(page_rows(pages, languages), "page-rows")
    model = learn(pages, languages)
    scored = rows.select("row", "id", text_scores(rows, "text", model).alias("score"))
    scored = common.stage(scored.select(
        "row", "id", F.slice("score", 1, k).alias("text"),
        F.element_at("score", k + 1).alias("n"), F.element_at("score", k + 2).alias("gain"),
    ), "text-scores")
    names = F.array(*[F.lit(x) for x in languages])

    def best(values: Column) -> Column:
        return F.element_at(names, F.array_position(values, F.array_max(values)).cast("int"))

    # how far a declaration agrees with the text: one row for each pair of languages
    priors = common.stage(log_priors(addresses, languages), "priors")
    tags = priors.where("tag IS NOT NULL").select("doc", "tag")
    seen = tags.join(scored.where("n > 0").select(F.col("id").alias("doc"), best(F.col("text")).alias("label")), "doc")
    agreed = {(r.label, r.tag): r.n for r in seen.groupBy("label", "tag").agg(F.count(F.lit(1)).alias("n")).collect()}

    def declared(tag: str) -> Column:
        out = []
        for lang in languages:
            n = sum(agreed.get((lang, t), 0) for t in languages)
            out.append(F.lit(math.log((agreed.get((lang, tag), 0) + 1.0) / (n + k))))
        return F.array(*out)

    markup = F.array(*[F.lit(0.0)] * k)
    for t in languages:
        markup = F.when(F.col("tag") == t, declared(t)).otherwise(markup)
    # a document on several pages: the mean of their evidence
    evidence = priors.withColumn("e", F.zip_with("prior", markup, lambda a, b: a + b))
    evidence = evidence.groupBy("doc").agg(F.array(*[F.avg(F.col("e")[i]) for i in range(k)]).alias("e"), F.min("tag").alias("declared"))
    share = {r.tag: r.n for r in addresses.where("tag IS NOT NULL").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    whole = F.array(*[F.lit(math.log((share.get(x, 0) + 1.0) / (sum(share.values()) + k))) for x in languages])
    joined = scored.join(evidence, scored.id == evidence.doc, "left").drop("doc")
    joined = joined.withColumn("all", F.zip_with("text", F.coalesce("e", whole), lambda a, b: a + b))
    top = F.array_max("all")
    joined = joined.withColumn("posterior", 1.0 / F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("all"))))
    accepted = (F.col("n") > 0) & (F.col("gain") > 0) & (F.col("posterior") >= MIN_POSTERIOR)
    return joined.select(
        "row", "id",
        F.when(accepted, F.element_at(names, F.array_position("all", top).cast("int"))).otherwise(F.lit("und")).alias("language"),
        "posterior", accepted.alias("accepted"),
        F.when(F.col("n") > 0, best(F.col("text"))).alias("text_language"), "declared",
    )


def digests(docs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, language, posterior, accepted, text_language, declared``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), "text")
    return identify(rows, pages).select(F.col("id").alias("doc_id"), "language", "posterior", "accepted", "text_language", "declared")


def accepted(docs: DataFrame, pages: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is determined, with all their columns."""
    row = common.fresh(docs, "row")[0]
    numbered = common.located(docs, row)
    rows = numbered.select(F.col(row).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    gone = common.stage(identify(rows, pages).where("not accepted").select(F.col("row").alias(row)), "language-gone")
    return numbered.join(gone, row, "left_anti").drop(row)
