"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontamination, linededup, quality, sharding, suffixdedup
from .common import Query
from .idfiles import op10_id_files
from .packing import op3_packing
from .scoring import op5_scoring
from .simhash import op8_simhash

QUERIES: dict[str, Query] = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_packing": op3_packing,
    "op4_chat": chat.op4_chat,
    "op5_scoring": op5_scoring,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": suffixdedup.op9_suffix_dedup,
    "op10_id_files": op10_id_files,
}

ORACLE_SQL: dict[str, str] = {
    "op1_quality": quality.oracle(),
    "op2_sharding": sharding.oracle(),
    "op4_chat": chat.ORACLE,
    "op6_line_dedup": linededup.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op9_suffix_dedup": suffixdedup.ORACLE,
}
