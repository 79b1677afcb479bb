"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .chat_format import op8_chat_format
from .decontamination import OP4_SQL, op4_decontamination
from .line_dedup import OP1_SQL, op1_line_dedup
from .near_duplicates import OP2_SQL, op2_near_duplicates
from .nearest import op6_nearest
from .packing import op9_packing
from .quality import op3_quality
from .secrets import op7_secret_scan
from .sharding import op10_sharding
from .toxicity import op5_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality": op3_quality,
    "op4_decontamination": op4_decontamination,
    "op5_toxicity": op5_toxicity,
    "op6_nearest": op6_nearest,
    "op7_secret_scan": op7_secret_scan,
    "op8_chat_format": op8_chat_format,
    "op9_packing": op9_packing,
    "op10_sharding": op10_sharding,
}
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": OP1_SQL,
    "op2_near_duplicates": OP2_SQL,
    "op4_decontamination": OP4_SQL,
}
