"""The operators' registered queries."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, langid, minhash, oracles, packing, partitions, pii, pq, suffixes, toxicity, urls


def queries() -> dict:
    found = [toxicity.op1_toxicity, langid.op2_language_id, pii.op3_pii, minhash.op4_minhash, bpe.op5_bpe, partitions.op6_partitions, suffixes.op7_suffixes, urls.op8_url_filters, packing.op9_packing, pq.op10_pq]
    return {**{f.__name__: f for f in found}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash": oracles.MINHASH, "op7_suffixes": oracles.SUFFIXES, "op10_pq": oracles.VECTORS}
