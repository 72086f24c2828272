"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from corpusloom.llm.bpe import op2_bpe_roundtrip
from corpusloom.llm.embedding_dedup import OP3_SQL, op3_embedding_dedup
from corpusloom.llm.jaccard_join import op4_jaccard_join
from corpusloom.llm.licenses import OP13_SQL, op13_licenses
from corpusloom.llm.mixing import OP9_SQL, op9_mix_sources
from corpusloom.llm.phrases import OP11_SQL, op11_phrases
from corpusloom.llm.quality import op1_quality
from corpusloom.llm.secrets import op10_secrets
from corpusloom.llm.substring_dedup import op7_substring_dedup
from corpusloom.llm.topk import OP6_SQL, op6_topk
from corpusloom.llm.url_filter import OP5_SQL, op5_url_filter
from corpusloom.llm.vector_codes import OP12_SQL, op12_vector_codes
from corpusloom.llm.warc import op8_warc_derivatives

QUERIES = {
    "op1_quality": op1_quality,
    "op2_bpe_roundtrip": op2_bpe_roundtrip,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_topk": op6_topk,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_warc_derivatives": op8_warc_derivatives,
    "op9_mix_sources": op9_mix_sources,
    "op10_secrets": op10_secrets,
    "op11_phrases": op11_phrases,
    "op12_vector_codes": op12_vector_codes,
    "op13_licenses": op13_licenses,
}

ORACLES: dict[str, str] = {
    "op3_embedding_dedup": OP3_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_topk": OP6_SQL,
    "op9_mix_sources": OP9_SQL,
    "op11_phrases": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_licenses": OP13_SQL,
}
