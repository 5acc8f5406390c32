"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op2_bpe
from .decontaminate import op8_decontaminate
from .gated_lm import op5_gated_lm
from .host_quality import op3_host_quality
from .jaccard_join import op7_jaccard_join
from .language_id import op1_language_id
from .oracle import ORACLE_SQL  # noqa: F401
from .pii import op6_pii
from .ring_sharding import op9_ring_sharding
from .substring_dedup import op4_substring_dedup
from .warc import op10_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_bpe,
        op3_host_quality,
        op4_substring_dedup,
        op5_gated_lm,
        op6_pii,
        op7_jaccard_join,
        op8_decontaminate,
        op9_ring_sharding,
        op10_warc,
    )
}
