"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, decontam, hardneg, katz, license, maintext, periodic, secrets, simhash, tokencount, toxicity, urlfilter

MODULES = [tokencount, maintext, ann, decontam, simhash, license, toxicity, katz, urlfilter, bpe, secrets, hardneg, periodic]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
