"""The operators' queries, over whole tables. Those without SQL are held against brute force, round trips or held-out rows."""

from __future__ import annotations

from fennwick.llm.ann import op8_ann
from fennwick.llm.conversations import SQL as REPAIR_SQL
from fennwick.llm.conversations import op12_repair
from fennwick.llm.decontam import op7_decontam
from fennwick.llm.html_extract import op6_html
from fennwick.llm.langid import op5_langid
from fennwick.llm.name_join import SQL as NAMES_SQL
from fennwick.llm.name_join import op13_names
from fennwick.llm.oph import SQL as OPH_SQL
from fennwick.llm.oph import op11_minhash
from fennwick.llm.packing import op10_packing
from fennwick.llm.pii import op3_pii
from fennwick.llm.quality import op9_quality
from fennwick.llm.sharding import op1_sharding
from fennwick.llm.simhash import op2_simhash
from fennwick.llm.token_files import op4_tokens


def queries() -> dict:
    import corpus_pipeline

    found = (op1_sharding, op2_simhash, op3_pii, op4_tokens, op5_langid, op6_html, op7_decontam, op8_ann, op9_quality, op10_packing, op11_minhash, op12_repair, op13_names)
    return {f.__name__: f for f in found} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op11_minhash": OPH_SQL, "op12_repair": REPAIR_SQL, "op13_names": NAMES_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
