"""The ten operators' queries, by the names they are registered under."""

from __future__ import annotations

from .bpe import op9_bpe
from .decontaminate import OP1_SQL, op1_decontamination
from .digest import op4_fingerprints
from .line_dedup import op6_line_dedup
from .lm_score import op2_lm_scores
from .shards import op3_sharding
from .simhash import op7_simhash
from .token_count import op5_token_counts
from .toxicity import op8_toxicity
from .url_filter import OP10_SQL, op10_url_filter


def queries() -> dict:
    every = (
        op1_decontamination, op2_lm_scores, op3_sharding, op4_fingerprints, op5_token_counts,
        op6_line_dedup, op7_simhash, op8_toxicity, op9_bpe, op10_url_filter,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op10_url_filter": OP10_SQL}
