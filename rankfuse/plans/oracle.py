"""Oracle SQL (DuckDB dialect) for the registered queries, over the driver's table views.

Written independently of the Spark plans: the difference uses the full-outer definition,
PageRank is unrolled into materialised CTEs, positions use window functions.
"""

from __future__ import annotations

from ..functions.text import ENGLISH_STOP_WORDS, LABEL_CHARS
from . import catalog as C
from .workload import (BENCH_ALPHAS, DAMPING, FLAGSHIP_QUERY, N_QUERIES, N_WORDS, ORACLE_ALPHAS, PR_STEPS, SEARCH_ALPHA,
                       SEARCH_BETA, SEARCH_TOP_N, SEED, SIZE_ALPHAS, SWEEP_TOP_N, TOP_FRACTION)
from ..operators.features import BM25_B, BM25_K1


def lit(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def s(x: str) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def skey(x: str) -> str:
    """The leading 33 bits of a double: noise of summation makes ties, at any magnitude."""
    wide = f"({x}) * {lit((1 << 20) + 1)}"
    return f"({wide} - ({wide} - ({x})))"


STOP = "[" + ", ".join(s(w) for w in ENGLISH_STOP_WORDS) + "]"


def clean(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9\\- ]', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split(lower({x}), ' '), lambda t: t <> '')"


def analyze(x: str) -> str:
    return f"list_filter({tokens(clean(x))}, lambda t: NOT list_contains({STOP}, lower(t)))"


def alphas_values(alphas) -> str:
    return "(VALUES " + ", ".join(f"({i}, {lit(a)})" for i, a in enumerate(alphas)) + ") AS g(i, alpha)"


def label(x: str) -> str:
    return f"CASE WHEN length({x}) > {LABEL_CHARS} THEN substring({x}, 1, {LABEL_CHARS}) || '...' ELSE {x} END"


def md5key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([s(SEED)] + [f"CAST({p} AS VARCHAR)" for p in parts]) + "))"


# --- CTE library ---------------------------------------------------------------------------------

BASE = {
    "papers": "SELECT CAST(doc_id AS VARCHAR) AS id, text AS title FROM documents",
    "refs": "SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_partkey) AS refs "
            "FROM lineitem GROUP BY l_orderkey",
    "papers_refs": "SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text AS title, r.refs AS \"references\" "
                   "FROM documents d LEFT JOIN refs r ON r.l_orderkey = d.doc_id",
    "edges": "SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst FROM lineitem "
             "WHERE l_orderkey IN (SELECT doc_id FROM documents)",
    "nodes": "SELECT id FROM papers UNION SELECT src FROM edges UNION SELECT dst FROM edges",
    "deg": "SELECT n.id, COALESCE(o.c, 0) AS out_degree FROM nodes n LEFT JOIN "
           "(SELECT src, COUNT(*) AS c FROM edges GROUP BY src) o ON n.id = o.src",
    "cnt": "SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM nodes",
    "pr0": "SELECT id, out_degree, 1.0::DOUBLE / (SELECT n FROM cnt) AS rank FROM deg",
}
DEPS = {
    "papers_refs": ["refs"], "nodes": ["papers", "edges"], "deg": ["nodes"], "cnt": ["nodes"],
    "pr0": ["deg", "cnt"],
}


def _pr_step(i: int, g: str = "") -> str:
    prev = f"{g}pr{i - 1}"
    base = f"({lit(1.0)} - {lit(DAMPING)}) / (SELECT n FROM {g}cnt)"
    dangling = f"(SELECT COALESCE(SUM(rank), 0.0) FROM {prev} WHERE out_degree = 0) / (SELECT n FROM {g}cnt)"
    return (
        f"SELECT d.id, d.out_degree, {base} + {lit(DAMPING)} * (COALESCE(c.inflow, 0.0) + {dangling}) AS rank "
        f"FROM {g}deg d LEFT JOIN (SELECT e.dst, SUM(p.rank / p.out_degree) AS inflow FROM {g}edges e "
        f"JOIN {prev} p ON e.src = p.id GROUP BY e.dst) c ON d.id = c.dst"
    )


MOST_STEPS, TOLERANCE = 50, 1e-4
for _i in range(1, MOST_STEPS + 1):
    BASE[f"pr{_i}"] = _pr_step(_i)
    DEPS[f"pr{_i}"] = [f"pr{_i - 1}", "deg", "cnt", "edges"]

# the graphs over whole tables: purchases (orders, line items) and links of pages
BASE["purchase_edges"] = (
    "SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
    "UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem")
BASE["web_edges"] = (
    "SELECT src, base || path AS dst FROM (SELECT regexp_replace(url, '[?#].*$', '') AS src, "
    "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS base, "
    "unnest(regexp_extract_all(html, '<a\\s[^>]*href=\"(/[^\"]*)\"', 1)) AS path FROM pages)")
for _g in ("purchase_", "web_"):
    BASE[f"{_g}nodes"] = f"SELECT src AS id FROM {_g}edges UNION SELECT dst FROM {_g}edges"
    BASE[f"{_g}deg"] = (f"SELECT n.id, COALESCE(o.c, 0) AS out_degree FROM {_g}nodes n LEFT JOIN "
                        f"(SELECT src, COUNT(*) AS c FROM {_g}edges GROUP BY src) o ON n.id = o.src")
    BASE[f"{_g}cnt"] = f"SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM {_g}nodes"
    BASE[f"{_g}pr0"] = f"SELECT id, out_degree, 1.0::DOUBLE / (SELECT n FROM {_g}cnt) AS rank FROM {_g}deg"
    DEPS |= {f"{_g}nodes": [f"{_g}edges"], f"{_g}deg": [f"{_g}nodes"], f"{_g}cnt": [f"{_g}nodes"], f"{_g}pr0": [f"{_g}deg", f"{_g}cnt"]}
    for _i in range(1, PR_STEPS + 1):
        BASE[f"{_g}pr{_i}"] = _pr_step(_i, _g)
        DEPS[f"{_g}pr{_i}"] = [f"{_g}pr{_i - 1}"]
    BASE[f"{_g}ranks"] = f"SELECT id, rank / (SELECT SUM(rank) FROM {_g}pr{PR_STEPS}) AS rank FROM {_g}pr{PR_STEPS}"
    DEPS[f"{_g}ranks"] = [f"{_g}pr{PR_STEPS}"]
BASE["ranks"] = f"SELECT id, rank / (SELECT SUM(rank) FROM pr{PR_STEPS}) AS rank FROM pr{PR_STEPS}"
DEPS["ranks"] = [f"pr{PR_STEPS}"]
BASE["titled"] = "SELECT r.id, r.rank, p.title FROM ranks r JOIN papers p ON r.id = p.id"
DEPS["titled"] = ["ranks", "papers"]

# text index
BASE["store"] = "SELECT id, title FROM papers WHERE id IS NOT NULL AND title IS NOT NULL"
DEPS["store"] = ["papers"]
BASE["toks"] = f"SELECT id, {analyze('title')} AS words FROM store"
DEPS["toks"] = ["store"]
BASE["tf"] = "SELECT id, term, COUNT(*) AS tf FROM (SELECT id, unnest(words) AS term FROM toks) GROUP BY id, term"
DEPS["tf"] = ["toks"]
BASE["ndocs"] = "SELECT CAST(COUNT(*) AS DOUBLE) AS n FROM store"
DEPS["ndocs"] = ["store"]
BASE["vocab"] = ("SELECT term, COUNT(*) AS df, ln(((SELECT n FROM ndocs) + 1.0) / (CAST(COUNT(*) AS DOUBLE) + 1.0)) AS idf "
                 "FROM tf GROUP BY term")
DEPS["vocab"] = ["tf", "ndocs"]
BASE["weights"] = "SELECT tf.id, tf.term, tf.tf, v.idf, tf.tf * v.idf AS weight FROM tf JOIN vocab v ON tf.term = v.term"
DEPS["weights"] = ["tf", "vocab"]
BASE["norms"] = ("SELECT s.id, COALESCE(w.norm, 0.0) AS norm FROM store s LEFT JOIN "
                 "(SELECT id, sqrt(SUM(weight * weight)) AS norm FROM weights GROUP BY id) w ON s.id = w.id")
DEPS["norms"] = ["store", "weights"]
BASE["docs_pr"] = "SELECT n.id, COALESCE(r.rank, 0.0) AS pr, n.norm FROM norms n LEFT JOIN ranks r ON n.id = r.id"
DEPS["docs_pr"] = ["norms", "ranks"]
BASE["post_tfidf"] = ("SELECT w.term, w.id, w.weight / d.norm AS nw, d.pr FROM weights w JOIN docs_pr d ON w.id = d.id")
DEPS["post_tfidf"] = ["weights", "docs_pr"]

# BM25 index
BASE["dl"] = "SELECT id, CAST(len(words) AS BIGINT) AS doc_len FROM toks"
DEPS["dl"] = ["toks"]
BASE["dlstat"] = "SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(doc_len) AS avgdl FROM dl"
DEPS["dlstat"] = ["dl"]
BASE["bvocab"] = ("SELECT term, COUNT(*) AS df, ln(1.0 + ((SELECT n FROM dlstat) - CAST(COUNT(*) AS DOUBLE) + 0.5) / "
                  "(CAST(COUNT(*) AS DOUBLE) + 0.5)) AS idf FROM tf GROUP BY term")
DEPS["bvocab"] = ["tf", "dlstat"]
_normlen = (f"{lit(BM25_K1)} * ({lit(1.0 - BM25_B)} + {lit(BM25_B)} * CAST(l.doc_len AS DOUBLE) / (SELECT avgdl FROM dlstat))")
BASE["post_bm25"] = (
    f"SELECT tf.term, tf.id, tf.tf, l.doc_len, v.idf * (CAST(tf.tf AS DOUBLE) * {lit(BM25_K1 + 1.0)}) / "
    f"(CAST(tf.tf AS DOUBLE) + {_normlen}) AS w, COALESCE(r.rank, 0.0) AS pr "
    "FROM tf JOIN bvocab v ON tf.term = v.term JOIN dl l ON tf.id = l.id LEFT JOIN ranks r ON tf.id = r.id"
)
DEPS["post_bm25"] = ["tf", "bvocab", "dl", "dlstat", "ranks"]

# query database
BASE["qwords"] = f"SELECT id, rank, {analyze('title')} AS words FROM titled"
DEPS["qwords"] = ["titled"]
BASE["qelig"] = (f"SELECT id, words, row_number() OVER (ORDER BY {skey('rank')} DESC, id ASC) AS pos "
                 f"FROM qwords WHERE len(words) >= {N_WORDS}")
DEPS["qelig"] = ["qwords"]
BASE["qtop"] = (f"SELECT id, words FROM qelig WHERE pos <= (SELECT CAST(floor({lit(TOP_FRACTION)} * COUNT(*)) AS BIGINT) "
                f"FROM qelig)")
DEPS["qtop"] = ["qelig"]
BASE["qchosen"] = f"SELECT id, words FROM qtop ORDER BY {md5key('id')}, id LIMIT {N_QUERIES}"
DEPS["qchosen"] = ["qtop"]
BASE["qexp"] = "SELECT id, unnest(words) AS w, unnest(range(len(words))) AS i FROM qchosen"
DEPS["qexp"] = ["qchosen"]
BASE["qdb"] = (
    f"SELECT id AS query_id, string_agg(w, ' ' ORDER BY rn) AS query FROM ("
    f"SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY {md5key('id', 'i')}, w) AS rn FROM qexp) "
    f"WHERE rn <= {N_WORDS} GROUP BY id"
)
DEPS["qdb"] = ["qexp"]
BASE["qterms"] = ("SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, unnest(" + analyze("query") +
                  ") AS term FROM qdb) GROUP BY query_id, term")
DEPS["qterms"] = ["qdb"]
BASE["matched"] = ("SELECT q.query_id, p.id, SUM(CAST(q.qtf AS DOUBLE) * p.w) AS lex, MAX(p.pr) AS pr "
                   "FROM qterms q JOIN post_bm25 p ON q.term = p.term GROUP BY q.query_id, p.id")
DEPS["matched"] = ["qterms", "post_bm25"]


def blend(lex: str, pr: str, a: str) -> str:
    return f"({a} * {lex} + ({lit(1.0)} - {a}) * {pr})"


BASE["sweep"] = (
    "SELECT query_id, alpha, pos, id, score FROM (SELECT m.query_id, g.alpha, m.id, "
    f"{blend('m.lex', 'm.pr', 'g.alpha')} AS score, row_number() OVER (PARTITION BY m.query_id, g.alpha "
    f"ORDER BY {skey(blend('m.lex', 'm.pr', 'g.alpha'))} DESC, m.id ASC) AS pos FROM matched m, "
    f"{alphas_values(ORACLE_ALPHAS)}) WHERE pos <= {SWEEP_TOP_N}"
)
DEPS["sweep"] = ["matched"]
# the reference's definition: full outer join of two result sets, absent score 0
BASE["qalphas"] = f"SELECT q.query_id, g.alpha FROM (SELECT DISTINCT query_id FROM qdb) q, {alphas_values(ORACLE_ALPHAS)}"
DEPS["qalphas"] = ["qdb"]
BASE["apairs"] = ("SELECT a.query_id, a.alpha AS alpha1, b.alpha AS alpha2 FROM qalphas a JOIN qalphas b "
                  "ON a.query_id = b.query_id AND a.alpha < b.alpha")
DEPS["apairs"] = ["qalphas"]
BASE["fo"] = (
    "SELECT COALESCE(a.query_id, b.query_id) AS query_id, COALESCE(a.alpha1, b.alpha1) AS alpha1, "
    "COALESCE(a.alpha2, b.alpha2) AS alpha2, COALESCE(a.s1, 0.0) AS s1, COALESCE(b.s2, 0.0) AS s2 FROM "
    "(SELECT p.query_id, p.alpha1, p.alpha2, x.id, x.score AS s1 FROM apairs p JOIN sweep x "
    "ON x.query_id = p.query_id AND x.alpha = p.alpha1) a FULL OUTER JOIN "
    "(SELECT p.query_id, p.alpha1, p.alpha2, y.id, y.score AS s2 FROM apairs p JOIN sweep y "
    "ON y.query_id = p.query_id AND y.alpha = p.alpha2) b "
    "ON a.query_id = b.query_id AND a.alpha1 = b.alpha1 AND a.alpha2 = b.alpha2 AND a.id = b.id"
)
DEPS["fo"] = ["apairs", "sweep"]
BASE["diffs"] = (
    "SELECT p.query_id, p.alpha1, p.alpha2, CASE WHEN COALESCE(f.z, 0.0) = 0 THEN 0.0 ELSE f.num / f.z END AS difference "
    "FROM apairs p LEFT JOIN (SELECT query_id, alpha1, alpha2, SUM(abs(s1 - s2)) AS num, SUM(s1) + SUM(s2) AS z "
    "FROM fo GROUP BY query_id, alpha1, alpha2) f "
    "ON p.query_id = f.query_id AND p.alpha1 = f.alpha1 AND p.alpha2 = f.alpha2"
)
DEPS["diffs"] = ["apairs", "fo"]


# the whole grid: 100 geometric alphas, all pairs, by totals and overlaps
BASE["sweep_full"] = (
    "SELECT query_id, alpha, id, score FROM (SELECT m.query_id, g.alpha, m.id, "
    f"{blend('m.lex', 'm.pr', 'g.alpha')} AS score, row_number() OVER (PARTITION BY m.query_id, g.alpha "
    f"ORDER BY {skey(blend('m.lex', 'm.pr', 'g.alpha'))} DESC, m.id ASC) AS pos FROM matched m, "
    f"{alphas_values(BENCH_ALPHAS)}) WHERE pos <= {SWEEP_TOP_N}"
)
DEPS["sweep_full"] = ["matched"]
BASE["totals_full"] = (
    f"SELECT q.query_id, g.alpha, COALESCE(SUM(s.score), 0.0) AS total FROM (SELECT DISTINCT query_id FROM qdb) q "
    f"CROSS JOIN {alphas_values(BENCH_ALPHAS)} LEFT JOIN sweep_full s ON s.query_id = q.query_id AND s.alpha = g.alpha "
    "GROUP BY q.query_id, g.alpha")
DEPS["totals_full"] = ["qdb", "sweep_full"]
BASE["overlap_full"] = (
    "SELECT x.query_id, x.alpha AS alpha1, y.alpha AS alpha2, SUM(least(x.score, y.score)) AS both_sets FROM sweep_full x "
    "JOIN sweep_full y ON x.query_id = y.query_id AND x.id = y.id AND x.alpha < y.alpha GROUP BY ALL")
DEPS["overlap_full"] = ["sweep_full"]
BASE["diffs_full"] = (
    "SELECT a.query_id, a.alpha AS alpha1, b.alpha AS alpha2, CASE WHEN a.total + b.total = 0 THEN 0.0 ELSE "
    "(a.total + b.total - 2.0 * COALESCE(o.both_sets, 0.0)) / (a.total + b.total) END AS difference FROM totals_full a "
    "JOIN totals_full b ON a.query_id = b.query_id AND a.alpha < b.alpha "
    "LEFT JOIN overlap_full o ON o.query_id = a.query_id AND o.alpha1 = a.alpha AND o.alpha2 = b.alpha")
DEPS["diffs_full"] = ["totals_full", "overlap_full"]


def with_ctes(final: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in DEPS.get(n, []):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = []
    for n in order:
        mat = " MATERIALIZED" if (n.startswith(("pr", "purchase_", "web_")) or n.endswith("_full") or n in {"ranks", "tf", "toks", "matched", "sweep", "qdb", "vocab",
                                                             "weights", "post_bm25", "post_tfidf", "docs_pr", "diffs",
                                                             "qelig", "bvocab", "dl"}) else ""
        parts.append(f"{n} AS{mat} ({BASE[n]})")
    return "WITH " + ",\n".join(parts) + "\n" + final


# --- helpers for statistics ----------------------------------------------------------------------

def stats_sql(src: str, v: str, by: str | None = None) -> str:
    keys = f"{by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return (f"SELECT {keys}round(AVG({v}), 6) AS {v}_mean, round(quantile_cont({v}, 0.5), 6) AS {v}_median, "
            f"round(stddev_samp({v}), 6) AS {v}_std FROM {src}{group}")


def r(x: str, places: int, name: str | None = None) -> str:
    return f"round({x}, {places}) AS {name or x.split('.')[-1]}"


def _search_sql(queries_cte: str) -> str:
    """Top-n of alpha * cosine + beta * pr over every stored document (the Spark scoring path)."""
    qv = (
        f"qt AS (SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, unnest({analyze('query')}) AS term "
        f"FROM {queries_cte}) GROUP BY query_id, term), "
        "qw AS (SELECT qt.query_id, qt.term, qt.qtf * ln(((SELECT n FROM ndocs) + 1.0) / (CAST(COALESCE(v.df, 0) AS DOUBLE) + 1.0)) AS qw "
        "FROM qt LEFT JOIN vocab v ON qt.term = v.term), "
        "qn AS (SELECT query_id, sqrt(SUM(qw * qw)) AS qnorm FROM qw GROUP BY query_id), "
        "cs AS (SELECT w.query_id, p.id, SUM((w.qw / n.qnorm) * p.nw) AS cosine FROM qw w JOIN qn n ON w.query_id = n.query_id "
        "JOIN post_tfidf p ON w.term = p.term WHERE n.qnorm > 0 GROUP BY w.query_id, p.id), "
        f"allq AS (SELECT DISTINCT query_id FROM {queries_cte}), "
        f"sc AS (SELECT q.query_id, d.id, {lit(SEARCH_ALPHA)} * COALESCE(c.cosine, 0.0) + {lit(SEARCH_BETA)} * d.pr AS score "
        "FROM allq q CROSS JOIN docs_pr d LEFT JOIN cs c ON c.query_id = q.query_id AND c.id = d.id), "
        f"rk AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY {skey('score')} DESC, id ASC) AS pos FROM sc) "
    )
    return qv + f"SELECT query_id, CAST(pos AS BIGINT) AS pos, id, round(score, 9) AS score FROM rk WHERE pos <= {SEARCH_TOP_N}"


def _sizes_sql(alphas) -> str:
    """Position of each query's source paper among its matching documents, per alpha."""
    a = "g.alpha"
    sc = blend("m.lex", "m.pr", a)
    ts = blend("t.lex", "t.pr", a)
    return (
        f"SELECT q.query_id, g.alpha, CASE WHEN t.id IS NULL THEN NULL ELSE 1 + COUNT(*) FILTER (WHERE "
        f"{skey(sc)} > {skey(ts)} OR ({skey(sc)} = {skey(ts)} AND m.id < t.id)) END AS size "
        f"FROM qdb q CROSS JOIN {alphas_values(alphas)} "
        "LEFT JOIN matched t ON t.query_id = q.query_id AND t.id = q.query_id "
        "LEFT JOIN matched m ON m.query_id = q.query_id "
        "GROUP BY q.query_id, g.alpha, t.id"
    )


def build() -> dict[str, str]:
    Q: dict[str, str] = {}
    Q["scan_parquet"] = "SELECT CAST(doc_id AS VARCHAR) AS id, n_chars FROM documents"
    Q["filter_pushed"] = "SELECT CAST(doc_id AS VARCHAR) AS id, n_chars FROM documents WHERE lang = 'en'"
    Q["cast_ids"] = "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents"
    Q["drop_nulls"] = with_ctes('SELECT id, CAST(len("references") AS BIGINT) AS n_refs FROM papers_refs WHERE "references" IS NOT NULL', "papers_refs")
    Q["lookup_by_id"] = with_ctes(f"SELECT id, title FROM papers WHERE id = {s(C.LOOKUP_ID)}", "papers")
    Q["min_word_filter"] = with_ctes(f"SELECT id, CAST(len({analyze('title')}) AS BIGINT) AS word_count FROM papers "
                                     f"WHERE len({analyze('title')}) >= 5", "papers")
    cond = " OR ".join(f"contains(title, {s(w)})" for w in C.FILTER_WORDS.split())
    Q["word_or_filter"] = with_ctes(f"SELECT id FROM papers WHERE {cond}", "papers")
    Q["null_refs_to_empty"] = with_ctes('SELECT id, CAST(COALESCE(len("references"), 0) AS BIGINT) AS n_refs FROM papers_refs', "papers_refs")
    Q["corpus_project"] = with_ctes("SELECT id, title, array_to_string(\"references\", ',') AS refs_text FROM papers_refs", "papers_refs")
    Q["corpus_head"] = with_ctes(f"SELECT id, title, array_to_string(\"references\", ',') AS refs_text FROM papers_refs "
                                 f"ORDER BY id LIMIT {C.HEAD_N}", "papers_refs")
    Q["decimal_to_double"] = ("SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS price, "
                              "CAST(CAST(l_tax AS DECIMAL(12,2)) AS DOUBLE) AS tax, "
                              "CAST(CAST(l_discount AS DECIMAL(12,2)) AS DOUBLE) AS discount FROM lineitem")
    # graph
    Q["citation_edges"] = with_ctes("SELECT src, dst FROM edges", "edges")
    Q["graph_nodes"] = with_ctes("SELECT id FROM nodes", "nodes")
    Q["node_count"] = with_ctes("SELECT (SELECT COUNT(*) FROM nodes) AS n_nodes, (SELECT COUNT(*) FROM edges) AS n_edges", "nodes")
    Q["out_degree"] = with_ctes("SELECT src, COUNT(*) AS out_degree FROM edges GROUP BY src", "edges")
    Q["in_degree"] = with_ctes("SELECT dst, COUNT(*) AS in_degree FROM edges GROUP BY dst", "edges")
    Q["in_degree_histogram"] = with_ctes("SELECT in_degree, COUNT(*) AS node_count FROM (SELECT dst, COUNT(*) AS in_degree "
                                         "FROM edges GROUP BY dst) GROUP BY in_degree", "edges")
    Q["avg_in_degree"] = with_ctes(
        "SELECT in_edges, cited_nodes, round(CASE WHEN cited_nodes > 0 THEN in_edges / cited_nodes ELSE 0.0 END, 9) AS avg_in_degree_cited, "
        "all_nodes, round(CASE WHEN all_nodes > 0 THEN in_edges / all_nodes ELSE 0.0 END, 9) AS avg_in_degree_all FROM ("
        "SELECT (SELECT COUNT(*) FROM edges) AS in_edges, (SELECT COUNT(DISTINCT dst) FROM edges) AS cited_nodes, "
        "(SELECT COUNT(*) FROM nodes) AS all_nodes)", "nodes")
    Q["dangling_nodes"] = with_ctes("SELECT id FROM nodes WHERE id NOT IN (SELECT src FROM edges)", "nodes")
    Q["pagerank_contribs"] = with_ctes("SELECT e.dst, round(SUM(p.rank / p.out_degree), 12) AS inflow FROM edges e "
                                       "JOIN pr0 p ON e.src = p.id GROUP BY e.dst", "pr0")
    Q["pagerank_step"] = with_ctes("SELECT id, round(rank, 12) AS rank FROM pr1", "pr1")
    Q["pagerank"] = with_ctes("SELECT id, round(rank, 12) AS rank FROM ranks", "ranks")
    steps = " UNION ALL ".join(
        f"SELECT CAST({i} AS BIGINT) AS iteration, (SELECT SUM(abs(a.rank - b.rank)) FROM pr{i} a JOIN pr{i - 1} b ON a.id = b.id) AS error, "
        f"(SELECT SUM(rank) FROM pr{i}) AS total" for i in range(1, PR_STEPS + 1))
    Q["pagerank_errors"] = with_ctes(f"SELECT iteration, round(error, 12) AS error, round(total, 12) AS total FROM ({steps})", f"pr{PR_STEPS}")
    Q["dangling_mass"] = with_ctes("SELECT round(COALESCE(SUM(rank), 0.0), 12) AS dangling_mass FROM ranks "
                                   "WHERE id NOT IN (SELECT src FROM edges)", "ranks")
    Q["rank_total"] = with_ctes("SELECT round(COALESCE(SUM(rank), 0.0), 9) AS rank_total FROM ranks", "ranks")
    Q["top_ranked"] = with_ctes(f"SELECT id, round(rank, 12) AS rank FROM ranks ORDER BY {skey('rank')} DESC, id LIMIT {C.TOP_N_RANKED}", "ranks")
    Q["titled_ranks"] = with_ctes("SELECT id, round(rank, 12) AS rank, title FROM titled", "titled")
    Q["sorted_positions"] = with_ctes(f"SELECT id, row_number() OVER (ORDER BY {skey('rank')} DESC, id) AS pos FROM titled", "titled")
    Q["top_decile"] = with_ctes(
        f"SELECT id, pos FROM (SELECT id, row_number() OVER (ORDER BY {skey('rank')} DESC, id) AS pos, COUNT(*) OVER () AS n "
        f"FROM titled) WHERE pos <= CAST(floor({lit(0.1)} * n) AS BIGINT)", "titled")
    Q["sample_rows"] = with_ctes(f"SELECT id FROM papers ORDER BY {md5key('id')}, id LIMIT {C.SAMPLE_N}", "papers")
    Q["sample_edges"] = with_ctes(f"SELECT src, dst FROM edges ORDER BY {md5key('src', 'dst')}, src, dst LIMIT {C.SAMPLE_EDGES_N}", "edges")
    Q["edges_in_corpus"] = with_ctes("SELECT src, dst FROM edges WHERE src IN (SELECT id FROM papers) AND dst IN (SELECT id FROM papers)", "papers", "edges")
    lab = (f"SELECT e.src, e.dst, {label('a.title')} AS src_label, {label('b.title')} AS dst_label FROM {{e}} e "
           "JOIN papers a ON a.id = e.src JOIN papers b ON b.id = e.dst")
    Q["edge_titles"] = with_ctes(lab.format(e="edges"), "papers", "edges")
    Q["sample_subgraph"] = with_ctes(lab.format(e=f"(SELECT src, dst FROM edges ORDER BY {md5key('src', 'dst')}, src, dst LIMIT {C.SAMPLE_N})"), "papers", "edges")
    Q["corpus_subset_by_rank"] = with_ctes(
        f"SELECT src, dst FROM edges WHERE src IN (SELECT id FROM keep) AND dst IN (SELECT id FROM keep)".replace(
            "FROM keep", f"FROM (SELECT id FROM titled ORDER BY {skey('rank')} DESC, id LIMIT {C.SUBSET_N})"), "titled", "edges")
    # text
    Q["title_labels"] = with_ctes(f"SELECT id, {label('title')} AS label FROM papers", "papers")
    Q["clean_text"] = with_ctes(f"SELECT id, {clean('title')} AS cleaned FROM papers", "papers")
    Q["tokenize"] = with_ctes(f"SELECT id, array_to_string({tokens(clean('title'))}, ' ') AS tokens, "
                              f"CAST(len({tokens(clean('title'))}) AS BIGINT) AS n_tokens FROM papers", "papers")
    Q["remove_stopwords"] = with_ctes(f"SELECT id, array_to_string({analyze('title')}, ' ') AS kept, "
                                      f"CAST(len({analyze('title')}) AS BIGINT) AS n_kept FROM papers", "papers")
    Q["parse_for_matching"] = with_ctes(f"SELECT id, array_to_string({analyze('title')}, ' ') AS parsed FROM papers", "papers")
    Q["title_word_count"] = with_ctes(f"SELECT id, CAST(len({analyze('title')}) AS BIGINT) AS word_count FROM papers", "papers")
    phrase = "[" + ", ".join(s(w) for w in C.COMMON_PHRASE.lower().split()) + "]"
    Q["common_word_count"] = with_ctes(
        f"SELECT id, CAST(len(list_distinct(list_filter(string_split_regex(lower(title), '[\\s\\v]+'), "
        f"lambda t: list_contains({phrase}, t)))) AS BIGINT) AS common FROM papers", "papers")
    Q["elapsed_seconds"] = (
        "SELECT event_id, round((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 6) AS seconds FROM ("
        "SELECT event_id, ts AS start_ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS end_ts FROM events) "
        "WHERE end_ts IS NOT NULL")
    # statistics
    tim = "(SELECT event_type AS key, value AS seconds FROM events)"
    Q["latency_stats"] = stats_sql(tim, "seconds")
    Q["stats_global"] = stats_sql("lineitem", "l_quantity")
    Q["stats_by_key"] = stats_sql(tim, "seconds", "key")
    lo, hi, bins = C.HIST_LO, C.HIST_HI, C.HIST_BINS
    width = (hi - lo) / bins
    b = (f"CAST(CASE WHEN seconds < {lit(lo)} THEN 0 WHEN seconds >= {lit(hi)} THEN {bins + 1} ELSE "
         f"floor((seconds - {lit(lo)}) * {lit(float(bins))} / {lit(float(hi - lo))}) + 1 END AS BIGINT)")
    Q["value_histogram"] = (f"SELECT bucket, round({lit(lo)} + (bucket - 1) * {lit(width)}, 6) AS bucket_lo, "
                            f"round({lit(lo)} + bucket * {lit(width)}, 6) AS bucket_hi, COUNT(*) AS count FROM "
                            f"(SELECT {b} AS bucket FROM {tim} WHERE seconds IS NOT NULL) GROUP BY bucket")
    Q["box_stats"] = (
        f"WITH t AS {tim}, q AS (SELECT key, quantile_cont(seconds, 0.25) AS q1, quantile_cont(seconds, 0.5) AS median, "
        "quantile_cont(seconds, 0.75) AS q3 FROM t GROUP BY key) "
        "SELECT q.key, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
        "round(MIN(CASE WHEN t.seconds >= q1 - 1.5 * (q3 - q1) THEN t.seconds END), 6) AS whisker_lo, "
        "round(MAX(CASE WHEN t.seconds <= q3 + 1.5 * (q3 - q1) THEN t.seconds END), 6) AS whisker_hi "
        "FROM q JOIN t ON q.key = t.key GROUP BY q.key, q1, median, q3")
    Q["nonnull_counts"] = with_ctes('SELECT COUNT(id) AS id_count, COUNT(title) AS title_count, COUNT("references") AS references_count '
                                    "FROM papers_refs", "papers_refs")
    # features
    Q["term_freq"] = with_ctes("SELECT id, term, tf FROM tf", "tf")
    Q["doc_freq_idf"] = with_ctes("SELECT term, df, round(idf, 12) AS idf FROM vocab", "vocab")
    Q["tfidf_weights"] = with_ctes("SELECT id, term, round(weight, 9) AS weight FROM weights", "weights")
    Q["doc_norms"] = with_ctes("SELECT id, round(norm, 9) AS norm FROM norms", "norms")
    Q["tfidf_lookup"] = with_ctes(f"SELECT id, term, round(weight, 9) AS weight FROM weights WHERE id = {s(C.LOOKUP_ID)}", "weights")
    cos_core = (
        f"qt AS (SELECT query_id, term, COUNT(*) AS qtf FROM (SELECT query_id, unnest({analyze('query')}) AS term "
        "FROM qdb) GROUP BY query_id, term), "
        "qw AS (SELECT qt.query_id, qt.term, qt.qtf * ln(((SELECT n FROM ndocs) + 1.0) / (CAST(COALESCE(v.df, 0) AS DOUBLE) + 1.0)) AS qw "
        "FROM qt LEFT JOIN vocab v ON qt.term = v.term), "
        "qn AS (SELECT query_id, sqrt(SUM(qw * qw)) AS qnorm FROM qw GROUP BY query_id), "
        "cs AS (SELECT w.query_id, p.id, SUM((w.qw / n.qnorm) * p.nw) AS cosine, MAX(p.pr) AS pr FROM qw w JOIN qn n ON w.query_id = n.query_id "
        "JOIN post_tfidf p ON w.term = p.term WHERE n.qnorm > 0 GROUP BY w.query_id, p.id) "
    )
    Q["cosine_scores"] = with_ctes(", " + cos_core + "SELECT query_id, id, round(cosine, 9) AS cosine FROM cs", "qdb", "post_tfidf", "ndocs").replace("\n, ", ",\n", 1)
    Q["hybrid_scores"] = with_ctes(", " + cos_core + f"SELECT query_id, id, round({lit(SEARCH_ALPHA)} * cosine + {lit(SEARCH_BETA)} * pr, 9) AS score FROM cs",
                                   "qdb", "post_tfidf", "ndocs").replace("\n, ", ",\n", 1)
    flag = f"fq AS (SELECT 'flagship' AS query_id, {s(FLAGSHIP_QUERY)} AS query), "
    one = (cos_core.replace("FROM qdb)", "FROM fq)") + "SELECT d.id, {cols} FROM docs_pr d JOIN papers p ON p.id = d.id "
           "LEFT JOIN cs c ON c.id = d.id")
    Q["score_left_join"] = with_ctes(", " + flag + one.format(cols="round(COALESCE(c.cosine, 0.0), 9) AS cosine, round(d.pr, 12) AS pr"),
                                     "post_tfidf", "ndocs", "papers").replace("\n, ", ",\n", 1)
    Q["search_full_ranking"] = with_ctes(", " + flag + one.format(
        cols=f"p.title, round({lit(SEARCH_ALPHA)} * COALESCE(c.cosine, 0.0) + {lit(SEARCH_BETA)} * d.pr, 9) AS score"),
        "post_tfidf", "ndocs", "papers").replace("\n, ", ",\n", 1)
    Q["tfidf_new_text"] = with_ctes(
        f"SELECT q.term, q.tf, round(q.tf * ln(((SELECT n FROM ndocs) + 1.0) / (CAST(COALESCE(v.df, 0) AS DOUBLE) + 1.0)), 9) AS weight FROM "
        f"(SELECT term, COUNT(*) AS tf FROM (SELECT unnest({analyze(s(FLAGSHIP_QUERY))}) AS term) GROUP BY term) q LEFT JOIN vocab v ON q.term = v.term",
        "vocab", "ndocs")
    Q["search_topk"] = with_ctes(", " + flag + _search_sql("fq"), "post_tfidf", "ndocs").replace("\n, ", ",\n", 1)
    Q["search_batch_topk"] = with_ctes(", " + _search_sql("qdb"), "qdb", "post_tfidf", "ndocs").replace("\n, ", ",\n", 1)
    Q["index_postings"] = with_ctes("SELECT term, id, tf, doc_len FROM post_bm25", "post_bm25")
    Q["match_any"] = with_ctes("SELECT DISTINCT q.query_id, p.id FROM qterms q JOIN post_bm25 p ON q.term = p.term", "qterms", "post_bm25")
    Q["bm25_scores"] = with_ctes("SELECT query_id, id, round(lex, 9) AS lex FROM matched", "matched")
    topn = ("SELECT query_id, CAST(pos AS BIGINT) AS pos, id, round(score, 9) AS score FROM (SELECT query_id, id, {sc} AS score, "
            "row_number() OVER (PARTITION BY query_id ORDER BY {key} DESC, id) AS pos FROM matched) WHERE pos <= {n}")
    for name, a, n in (("bm25_hybrid_topk", C.HYBRID_ALPHA, C.HYBRID_N), ("topn_per_query", C.TOPN_ALPHA, C.TOPN_N)):
        sc = blend("lex", "pr", lit(a))
        Q[name] = with_ctes(topn.format(sc=sc, key=skey(sc), n=n), "matched")
    # evaluation
    Q["query_database"] = with_ctes("SELECT query_id, query FROM qdb", "qdb")
    Q["alpha_grid_scores"] = with_ctes(f"SELECT m.query_id, round(g.alpha, 9) AS alpha, m.id, round({blend('m.lex', 'm.pr', 'g.alpha')}, 9) AS score "
                                       f"FROM matched m, {alphas_values(ORACLE_ALPHAS)}", "matched")
    Q["alpha_sweep_topn"] = with_ctes("SELECT query_id, round(alpha, 9) AS alpha, CAST(pos AS BIGINT) AS pos, id, round(score, 9) AS score FROM sweep", "sweep")
    Q["alpha_pairs"] = with_ctes("SELECT query_id, alpha1, alpha2 FROM apairs", "apairs")
    Q["resultset_diff"] = with_ctes(
        "SELECT query_id, round(CASE WHEN SUM(s1) + SUM(s2) = 0 THEN 0.0 ELSE SUM(abs(s1 - s2)) / (SUM(s1) + SUM(s2)) END, 9) AS difference "
        "FROM (SELECT COALESCE(a.query_id, b.query_id) AS query_id, COALESCE(a.score, 0.0) AS s1, COALESCE(b.score, 0.0) AS s2 FROM "
        f"(SELECT * FROM sweep WHERE alpha = {lit(C.DIFF_A1)}) a FULL OUTER JOIN (SELECT * FROM sweep WHERE alpha = {lit(C.DIFF_A2)}) b "
        "ON a.query_id = b.query_id AND a.id = b.id) GROUP BY query_id", "sweep")
    Q["alpha_differences"] = with_ctes("SELECT query_id, round(alpha1, 9) AS alpha1, round(alpha2, 9) AS alpha2, round(difference, 9) AS difference FROM diffs", "diffs")
    Q["alpha_stats_global"] = with_ctes(stats_sql("diffs", "difference"), "diffs")
    Q["alpha_stats_by_query"] = with_ctes(stats_sql("diffs", "difference", "query_id"), "diffs")
    cols = ", ".join(f"round(AVG(CASE WHEN alpha2 = {lit(a)} THEN difference END), 9) AS a{i}" for i, a in enumerate(ORACLE_ALPHAS))
    Q["alpha_heatmap"] = with_ctes(f"SELECT round(alpha1, 9) AS alpha1, {cols} FROM diffs GROUP BY alpha1", "diffs")
    Q["required_size"] = with_ctes(f"SELECT query_id, size FROM ({_sizes_sql([0.5])})", "qdb", "matched")
    Q["required_size_by_alpha"] = with_ctes(f"SELECT query_id, round(alpha, 12) AS alpha, size FROM ({_sizes_sql(SIZE_ALPHAS)})", "qdb", "matched")
    Q["required_size_stats"] = with_ctes(stats_sql(f"(SELECT round(alpha, 2) AS alpha, size FROM ({_sizes_sql(SIZE_ALPHAS)}))", "size", "alpha"),
                                         "qdb", "matched")
    Q["first_hit_counts"] = with_ctes(f"SELECT size = 1 AS first_hit, COUNT(*) AS count FROM ({_sizes_sql(SIZE_ALPHAS)}) GROUP BY size = 1",
                                      "qdb", "matched")
    sized = f"(SELECT round(alpha, 2) AS alpha, size FROM ({_sizes_sql(SIZE_ALPHAS)}))"
    Q["required_size_box"] = with_ctes(
        f", t AS MATERIALIZED (SELECT * FROM {sized} WHERE size IS NOT NULL), q AS (SELECT alpha, quantile_cont(size, 0.25) AS q1, "
        "quantile_cont(size, 0.5) AS median, quantile_cont(size, 0.75) AS q3 FROM t GROUP BY alpha) "
        "SELECT q.alpha, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr, "
        "round(CAST(MIN(CASE WHEN t.size >= q1 - 1.5 * (q3 - q1) THEN t.size END) AS DOUBLE), 6) AS whisker_lo, "
        "round(CAST(MAX(CASE WHEN t.size <= q3 + 1.5 * (q3 - q1) THEN t.size END) AS DOUBLE), 6) AS whisker_hi "
        "FROM q JOIN t ON q.alpha = t.alpha GROUP BY q.alpha, q1, median, q3", "qdb", "matched").replace("\n, ", ",\n", 1)
    # the whole alpha grid
    Q["alpha_differences_full"] = with_ctes("SELECT query_id, round(alpha1, 9) AS alpha1, round(alpha2, 9) AS alpha2, "
                                            "round(difference, 6) AS difference FROM diffs_full", "diffs_full")
    Q["alpha_heatmap_log"] = with_ctes("SELECT round(log10(alpha1), 2) AS log_alpha1, round(log10(alpha2), 2) AS log_alpha2, "
                                       "round(AVG(difference), 6) AS difference FROM diffs_full GROUP BY 1, 2", "diffs_full")
    Q["alpha_scatter"] = with_ctes("SELECT query_id, round(log10(alpha1), 2) AS x, round(log10(alpha2), 2) AS y, "
                                   "round(difference * 100, 4) AS size FROM diffs_full", "diffs_full")
    Q["alpha_stats_full"] = with_ctes(stats_sql("diffs_full", "difference"), "diffs_full")
    Q["alpha_stats_by_query_full"] = with_ctes(stats_sql("diffs_full", "difference", "query_id"), "diffs_full")
    # an index after an upsert and a deletion: the same over the documents as they are then
    grown = (
        f", sst AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = {s(C.REVISED_LANG)} THEN text || ' ' || text || {s(C.REVISION)} ELSE text END AS title "
        f"FROM documents WHERE text IS NOT NULL AND lang IS DISTINCT FROM {s(C.DELETED_LANG)}), "
        f"stoks AS MATERIALIZED (SELECT id, {analyze('title')} AS words FROM sst), "
        "stf AS MATERIALIZED (SELECT id, term, COUNT(*) AS tf FROM (SELECT id, unnest(words) AS term FROM stoks) GROUP BY id, term), "
        "sdf AS MATERIALIZED (SELECT term, COUNT(*) AS df FROM stf GROUP BY term) ")
    Q["index_segments_df"] = with_ctes(grown + "SELECT term, df FROM sdf", "papers").replace("\n, ", ",\n", 1)
    one = (grown + ", sdl AS (SELECT id, CAST(len(words) AS DOUBLE) AS doc_len FROM stoks), sstat AS (SELECT CAST(COUNT(*) AS DOUBLE) AS n, AVG(doc_len) AS avgdl FROM sdl), "
           "sv AS (SELECT term, ln(1.0 + ((SELECT n FROM sstat) - df + 0.5) / (df + 0.5)) AS idf FROM sdf), "
           f"ssc AS (SELECT q.query_id, f.id, SUM(q.qtf * v.idf * f.tf * {lit(BM25_K1 + 1.0)} / (f.tf + {lit(BM25_K1)} * ({lit(1.0 - BM25_B)} + {lit(BM25_B)} * "
           "l.doc_len / (SELECT avgdl FROM sstat)))) AS score FROM qterms q JOIN stf f ON q.term = f.term JOIN sv v ON f.term = v.term JOIN sdl l ON f.id = l.id GROUP BY q.query_id, f.id) "
           f"SELECT query_id, CAST(pos AS BIGINT) AS pos, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {skey('score')} DESC, id) AS pos "
           f"FROM ssc) WHERE pos <= {C.SEGMENT_TOP_N}")
    Q["index_segments_topk"] = Q["index_merged_topk"] = with_ctes(one, "qterms").replace("\n, ", ",\n", 1)
    # corpus subsets, whole-table graphs
    best = "(SELECT id FROM titled ORDER BY " + skey("rank") + " DESC, id LIMIT {n})"
    Q["corpus_subset_papers"] = with_ctes(" UNION ALL ".join(
        f"SELECT CAST({n} AS BIGINT) AS n, id FROM {best.format(n=n)}" for n in C.SUBSET_SIZES), "titled")
    Q["corpus_subset_edges"] = with_ctes(" UNION ALL ".join(
        f"SELECT CAST({n} AS BIGINT) AS n, src, dst FROM edges WHERE src IN {best.format(n=n)} AND dst IN {best.format(n=n)}"
        for n in C.SUBSET_SIZES), "titled", "edges")
    for g in ("purchase", "web"):
        Q[f"{g}_pagerank"] = with_ctes(f"SELECT id, round(rank, 12) AS rank FROM {g}_ranks", f"{g}_ranks")
    Q["purchase_top_ranked"] = with_ctes(f"SELECT id, round(rank, 12) AS rank FROM purchase_ranks ORDER BY {skey('rank')} DESC, id "
                                         f"LIMIT {C.TOP_N_RANKED}", "purchase_ranks")
    Q["purchase_degrees"] = with_ctes("SELECT src AS id, 'out' AS kind, COUNT(*) AS degree FROM purchase_edges GROUP BY src UNION ALL "
                                      "SELECT dst, 'in', COUNT(*) FROM purchase_edges GROUP BY dst", "purchase_edges")
    Q["web_in_degree_histogram"] = with_ctes("SELECT in_degree, COUNT(*) AS node_count FROM (SELECT dst, COUNT(*) AS in_degree "
                                             "FROM web_edges GROUP BY dst) GROUP BY in_degree", "web_edges")
    # round trips give what was written
    for name, same in (("src_json_roundtrip", "corpus_project"), ("parquet_roundtrip", "pagerank"),
                       ("csv_roundtrip", "alpha_differences"), ("csv_roundtrip_full", "alpha_differences_full"),
                       ("pipeline_e2e", "alpha_stats_full"), ("head_parquet", "corpus_head"), ("json_array_roundtrip", "corpus_project"),
                       ("bm25_pruned_topk", "bm25_hybrid_topk"), ("required_size_by_blocks", "required_size_by_alpha"), ("index_reopened_topk", "search_batch_topk"), ("index_reopened_bm25", "bm25_scores")):
        Q[name] = Q[same]
    errors = " UNION ALL ".join(
        f"SELECT {i} AS k, (SELECT SUM(abs(a.rank - b.rank)) FROM pr{i} a JOIN pr{i - 1} b ON a.id = b.id) AS error"
        for i in range(1, MOST_STEPS + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS k, id, rank FROM pr{i}" for i in range(1, MOST_STEPS + 1))
    Q["pagerank_converged"] = with_ctes(
        f", stop AS (SELECT COALESCE(MIN(k) FILTER (WHERE error < {lit(TOLERANCE)}), {MOST_STEPS}) AS k FROM ({errors})), "
        f"final AS (SELECT id, rank FROM ({every}) e WHERE e.k = (SELECT k FROM stop)) "
        "SELECT id, round(rank / (SELECT SUM(rank) FROM final), 12) AS rank FROM final", f"pr{MOST_STEPS}").replace("\n, ", ",\n", 1)
    # plain iteration, far past what is left of the first step's error
    Q["pagerank_residual"] = with_ctes(f"SELECT id, round(rank / (SELECT SUM(rank) FROM pr{MOST_STEPS}), 9) AS rank FROM pr{MOST_STEPS}", f"pr{MOST_STEPS}")
    Q["ml_tfidf_roundtrip"] = with_ctes(
        "SELECT id, CAST(len(list_filter(string_split_regex(regexp_replace(lower(title), '\\s+$', ''), '\\s'), "
        f"lambda t: NOT list_contains({STOP}, t))) AS BIGINT) AS total FROM store", "store")
    return Q
