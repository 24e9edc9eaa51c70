"""The queries of this package, by name, and their SQL."""

from __future__ import annotations

from .bpe import op6_bpe
from .embedding_dedup import ORACLE as OP4_SQL
from .embedding_dedup import op4_embeddings
from .fingerprints import op2_fingerprints
from .language_id import op8_language_id
from .licenses import op7_licenses
from .licenses import oracle as op7_sql
from .line_dedup import op10_lines
from .merkle import ORACLE as OP12_SQL
from .merkle import op12_merkle
from .mixing import op9_mixing
from .periodic_runs import op11_periodic_runs
from .simhash import op3_simhash
from .substring_dedup import ORACLE as OP1_SQL
from .substring_dedup import op1_substring_dedup
from .toxicity import op13_toxicity
from .url_filter import op5_url_filter

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_simhash": op3_simhash,
    "op4_embeddings": op4_embeddings,
    "op6_bpe": op6_bpe,
    "op5_url_filter": op5_url_filter,
    "op7_licenses": op7_licenses,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_lines": op10_lines,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_merkle": op12_merkle,
    "op13_toxicity": op13_toxicity,
}
#: Hashes, models and random keys are beyond SQL; those operators are tested against brute force.
ORACLE_SQL = {"op1_substring_dedup": OP1_SQL, "op4_embeddings": OP4_SQL, "op7_licenses": op7_sql(), "op12_merkle": OP12_SQL}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
