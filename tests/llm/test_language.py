import pytest

from rankfuse.llm import language

EN = "the house of the old man is in the valley and it was on the way to that river for all of them"
FR = "la maison du vieil homme est dans la vallée et elle est sur le chemin de la rivière pour tous les autres"
DE = "das haus des alten mannes ist in dem tal und es liegt auf dem weg zu dem fluss für alle die anderen"
ES = "la casa del hombre viejo está en el valle y se encuentra en el camino del río para todos los otros"


def page(k, host, lang, body, doc=None):
    path = f"/{doc}.html?x=1" if doc is not None else "/about"
    tag = f'<html lang="{lang}">' if lang else "<html>"
    return (k, f"https://{host}{path}", f"<!DOCTYPE html>{tag}<script>var the = 1</script><p>{body}</p></html>", "extra")


@pytest.fixture(scope="module")
def pages(spark):
    rows = []
    for k in range(10):
        rows.append(page(k, "a.x.com", "en", EN))
        rows.append(page(100 + k, "b.x.fr", "fr", FR))
        rows.append(page(200 + k, "c.x.de", "de-AT", DE))
        rows.append(page(300 + k, "d.x.es", "ES", ES))
    rows += [
        page(900, "b.x.fr", None, "?", 50), page(901, "d.x.es", "es", ES, 51), page(902, "a.x.com", "xx", "?", 52),
        page(903, "a.x.com", "en", EN, 53), page(904, "a.x.com", "en", EN, 53),
        (905, None, None, None), (None, "no url", "", None), (906, "https://[", "<html lang>", "e"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string")


def judged(spark, pages, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, language string")
    return {r.doc_id: r for r in language.digests(docs, pages).collect()}


def test_texts(spark, pages):
    got = judged(spark, pages, [(1, EN, "q"), (2, FR, "q"), (3, DE, "q"), (4, ES, "q"), (5, EN * 3000, "q")])
    assert {k: r.language for k, r in got.items()} == {1: "en", 2: "fr", 3: "de", 4: "es", 5: "en"}
    assert all(r.accepted and r.posterior > 0.99 for r in got.values())


def test_rejected(spark, pages):
    got = judged(spark, pages, [(1, None, "q"), (2, "", "q"), (3, "123 !!! 456 --", "q"), (4, "qxzj wvkq zzxw qjqk xkcd vbqz pxqw " * 5, "q")])
    assert all(r.language == "und" and not r.accepted for r in got.values())


def test_address_and_markup_decide_where_the_text_does_not(spark, pages):
    short = "de"  # a word of two of the languages
    got = judged(spark, pages, [(50, short, "q"), (51, short, "q"), (53, EN, "q"), (None, EN, "q")])
    assert got[50].language == "fr" and got[50].declared is None
    assert got[51].language == "es" and got[51].declared == "es"
    assert got[53].language == "en" and got[None].language == "en"


def test_host_prior_leaves_the_page_out(spark):
    rows = language.page_rows(spark.createDataFrame([page(1, "h.y.org", "es", ES, 7)], "page_id long, url string, html string, text string"))
    (r,) = language.log_priors(rows).collect()
    assert r.prior == pytest.approx([r.prior[0]] * 4)


def test_address_parts(spark):
    df = spark.createDataFrame([("https://u@Blog.A.co.uk:80/x/12?p=3#4",), ("http://h/9/",), ("x",), (None,), ("http://a.b/77.html",)], "url string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in language.host_parts(df.url).items()]).collect()]
    assert got == [
        ("blog.a.co.uk", "co.uk", "uk", 12), ("h", "h", "h", 9), (None, None, None, None), (None, None, None, None), ("a.b", "a.b", "b", 77),
    ]


def test_edge_rows(docs, rows, none, pages):
    got = language.digests(docs, pages).collect()
    assert len(got) == len(rows)
    assert all(not r.accepted for r in got if r.doc_id in (4, 5, 6))
    out = language.accepted(docs, pages)
    assert out.schema == docs.schema and out.count() == sum(r.accepted for r in got)
    assert language.digests(none, pages).collect() == []


def test_without_pages_the_function_words_decide(spark, pages):
    docs = spark.createDataFrame([(1, EN), (2, DE)], "doc_id long, text string")
    got = {r.doc_id: r.language for r in language.digests(docs, pages.limit(0)).collect()}
    assert got == {1: "en", 2: "de"}


def test_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.digests(docs, spark.read.parquet(f"{sf}/pages.parquet"))
    right = got.join(docs, "doc_id").selectExpr("avg(CAST(language = lang AS DOUBLE)) AS share").first().share
    assert right >= 0.99


def test_visible_text_equals_the_pattern_and_is_linear():
    import random
    import time

    import regex

    pattern = regex.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;")
    bits = ["<", ">", "<script>", "<SCRIPT a='b'>", "</script >", "</script", "<style>", "</Style>", "<!--", "-->", "<!-->", "<p>", "&amp;", "&#39;", "&x", ";", "é", " ", "text", "<scripty>", "\n", "İ"]
    rnd = random.Random(4)
    for _ in range(3000):
        html = "".join(rnd.choice(bits) for _ in range(rnd.randrange(14)))
        assert language.visible(html) == pattern.sub(" ", html), html
    for bad in ("<", "<script ", "<!--", "&a", "</script", "<style><!--", "<script></style>"):
        t0 = time.time()
        language.visible(bad * (1_000_000 // len(bad)))
        assert time.time() - t0 < 5, bad
