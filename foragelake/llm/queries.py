"""Queries of the corpus operators, and the SQL that DuckDB can check them with."""

from __future__ import annotations

from foragelake.llm.audio import op3_audio_features
from foragelake.llm.chat import OP8_SQL, op8_format_chats
from foragelake.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from foragelake.llm.importance import OP13_SQL, op13_importance
from foragelake.llm.licenses import op10_license_scan
from foragelake.llm.mixing import op1_mix_sources
from foragelake.llm.negatives import OP11_SQL, op11_hard_negatives
from foragelake.llm.ngram_join import op5_ngram_join
from foragelake.llm.packing import op2_pack
from foragelake.llm.quality import op9_quality
from foragelake.llm.repetition import op12_quality_rules
from foragelake.llm.secrets import op7_secret_scan
from foragelake.llm.sharding import op6_shard

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_pack": op2_pack,
    "op3_audio_features": op3_audio_features,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_ngram_join": op5_ngram_join,
    "op6_shard": op6_shard,
    "op7_secret_scan": op7_secret_scan,
    "op8_format_chats": op8_format_chats,
    "op9_quality": op9_quality,
    "op10_license_scan": op10_license_scan,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_quality_rules": op12_quality_rules,
    "op13_importance": op13_importance,
}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL, "op8_format_chats": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_importance": OP13_SQL}
