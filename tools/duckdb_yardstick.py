"""The stages of bench.py on DuckDB (single process, same Parquet), from the oracle's SQL.

Tables that bench.py stores are stored here, too, and each stage is timed with all the work that
no earlier one has stored.
"""

import json
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from rankfuse.plans import oracle  # noqa: E402
from tools.check_oracle import TABLES  # noqa: E402

STAGES = {
    "pagerank": ["ranks"], "pagerank_purchases": ["purchase_ranks"], "build_tfidf": ["tf", "vocab", "weights", "norms", "docs_pr", "post_tfidf"],
    "build_bm25": ["bvocab", "dl", "post_bm25"], "build_queries": ["qdb"], "search_topk": "search_topk",
    "search_batch_topk": "search_batch_topk", "match_queries": ["matched"], "alpha_differences": "alpha_differences_full",
    "required_size_by_alpha": "required_size_by_alpha",
}

sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
con = duckdb.connect()
for t in TABLES:
    files = f"{sf_dir}/{t}.parquet" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{t}.parquet") else "")
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
out = {}
for stage, what in STAGES.items():
    t0 = time.time()
    if isinstance(what, str):
        con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {oracle.build()[what]}")
    else:
        for cte in what:
            con.execute(f"CREATE TEMP TABLE {cte} AS {oracle.with_ctes(f'SELECT * FROM {cte}', cte)}")
            oracle.BASE[cte], oracle.DEPS[cte] = f"SELECT * FROM temp.{cte}", []
    out[stage] = round(time.time() - t0, 3)
print(json.dumps({"engine": "duckdb", "sf_dir": sf_dir, "queries": out, "total": round(sum(out.values()), 3)}))
