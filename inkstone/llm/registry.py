"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from inkstone.llm import bpe, codes, ctw, decontaminate, license, pii, quality, sharding, simhash, topk, toxicity, trie, warc


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_pii": pii.op2_pii,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_license": license.op4_license,
        "op5_quality": quality.op5_quality,
        "op6_sharding": sharding.op6_sharding,
        "op7_simhash": simhash.op7_simhash,
        "op8_ctw": ctw.op8_ctw,
        "op9_bpe": bpe.op9_bpe,
        "op10_warc": warc.op10_warc,
        "op11_topk": topk.op11_topk,
        "op12_codes": codes.op12_codes,
        "op13_trie": trie.op13_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op5_quality": quality.OP5_SQL,
        "op10_warc": warc.OP10_SQL,
        "op11_topk": topk.OP11_SQL,
        "op12_codes": codes.OP12_SQL,
        "op13_trie": trie.OP13_SQL,
    }
