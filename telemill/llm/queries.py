"""The registered corpus queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import corpus_pipeline

from .annsearch import op5_ann
from .decontaminate import op2_decontaminate
from .dialogue import op13_dialogue_repair
from .langid import op3_langid
from .licenses import OP7_SQL, op7_licenses
from .mixing import op4_mixing
from .pii import op1_pii
from .quality import op10_quality
from .sharding import OP12_SQL, op12_sharding
from .simhash import op6_simhash
from .substrings import op8_substrings
from .tokenstore import op9_token_store
from .whitening import op11_whitening

QUERIES = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_langid, op4_mixing, op5_ann, op6_simhash, op7_licenses, op8_substrings, op9_token_store, op10_quality, op11_whitening, op12_sharding, op13_dialogue_repair)}
QUERIES["pipeline"] = corpus_pipeline.run
ORACLE_SQL: dict[str, str] = {"op7_licenses": OP7_SQL, "op12_sharding": OP12_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
