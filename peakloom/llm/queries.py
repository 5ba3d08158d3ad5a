"""The registered query of each operator, by name, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_alignment
from .chat import OP6_SQL, op6_chat
from .cover_tree import OP4_SQL, op4_cover_tree
from .decontaminate import op10_decontaminate
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .html_text import op1_html_text
from .jaccard_join import OP7_SQL, op7_jaccard_join
from .packing import op2_packing
from .pii import op3_pii
from .quality import op5_quality
from .secrets import op9_secrets
from .substring_dedup import op8_substring_dedup
from .warc import OP13_SQL, op13_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_packing,
        op3_pii,
        op4_cover_tree,
        op5_quality,
        op6_chat,
        op7_jaccard_join,
        op8_substring_dedup,
        op9_secrets,
        op10_decontaminate,
        op11_hard_negatives,
        op12_alignment,
        op13_warc,
    )
}
ORACLE: dict[str, str] = {"op4_cover_tree": OP4_SQL, "op6_chat": OP6_SQL, "op7_jaccard_join": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op13_warc": OP13_SQL}
