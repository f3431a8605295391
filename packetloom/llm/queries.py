"""The registered queries of this subpackage and the SQL that says the same, where SQL can."""

from __future__ import annotations

from . import oracles
from .html_tree import op4_html_text
from .lang_id import op2_language_id
from .manifest import op13_manifest
from .mixing import op11_mixing
from .packing import op5_packing
from .quality_mil import op3_quality_model
from .quality_rules import op6_quality_rules
from .sentence_pieces import op7_sentencepiece
from .sharding import op9_sharding
from .shingle_join import op8_shingle_join
from .source_audit import op12_source_audit
from .url_rules import op10_url_filter
from .vector_pairs import op1_embedding_dedup

QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_model": op3_quality_model,
    "op4_html_text": op4_html_text,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_shingle_join": op8_shingle_join,
    "op9_sharding": op9_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_mixing": op11_mixing,
    "op12_source_audit": op12_source_audit,
    "op13_manifest": op13_manifest,
}

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": oracles.VECTORS,
    "op6_quality_rules": oracles.RULES,
    "op8_shingle_join": oracles.SHINGLES,
    "op12_source_audit": oracles.AUDIT,
    "op13_manifest": oracles.MANIFEST,
}
