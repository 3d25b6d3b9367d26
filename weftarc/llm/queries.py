"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from weftarc.llm import embeddings, extract, jaccard, lines, lm, media, mixing, packing, quality, warc

MODULES = {"op1_warc": warc, "op2_mixing": mixing, "op3_lm": lm, "op4_quality": quality, "op5_extract": extract, "op6_embeddings": embeddings, "op7_jaccard": jaccard, "op8_packing": packing, "op9_media": media, "op10_lines": lines}


def queries() -> dict:
    import corpus_pipeline

    return {name: getattr(m, name) for name, m in MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    found = {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
