"""Queries of the training-data operators; ``__spark_entry__`` adds them when this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagecask.llm.boilerplate import p3_found
from pagecask.llm.language import p1_found, p1_segments
from pagecask.llm.mixing import p7_mixed, p7_shares
from pagecask.llm.near_duplicates import p4_classes, p4_found
from pagecask.llm.packing import p6_fill, p6_packed
from pagecask.llm.residue import p2_found, p2_reasons
from pagecask.llm.splitting import p8_pieces
from pagecask.llm.visual_form import p5_forms, p5_found

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p2_reasons": p2_reasons,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_classes": p4_classes,
    "p5_found": p5_found,
    "p5_forms": p5_forms,
    "p6_packed": p6_packed,
    "p6_fill": p6_fill,
    "p7_mixed": p7_mixed,
    "p7_shares": p7_shares,
    "p8_pieces": p8_pieces,
}
#: SQL cannot state these operators; tests hold them against brute force, round trips and held-out accuracy.
ORACLE_SQL: dict[str, str] = {}
