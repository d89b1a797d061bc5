"""Registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from gleanspark.llm import oracles
from gleanspark.llm.jaccard import op6_jaccard
from gleanspark.llm.packing import op10_packing
from gleanspark.llm.pieces import op4_pieces
from gleanspark.llm.quality import op3_quality
from gleanspark.llm.repeats import op1_repeats
from gleanspark.llm.secrets import op5_secrets
from gleanspark.llm.sharding import op2_sharding
from gleanspark.llm.toxicity import op9_toxicity
from gleanspark.llm.vafile import op8_topk
from gleanspark.llm.warc import op7_warc
from gleanspark.plans.shipping import shipped

OPERATORS = (op1_repeats, op2_sharding, op3_quality, op4_pieces, op5_secrets, op6_jaccard, op7_warc, op8_topk, op9_toxicity, op10_packing)
QUERIES = {f.__name__: shipped(f) for f in OPERATORS}

#: The others have models, packings or substrings that SQL can't express, or not over whole texts.
ORACLE_SQL: dict[str, str] = {"op6_jaccard": oracles.JACCARD, "op7_warc": oracles.WARC, "op8_topk": oracles.TOP_K}
