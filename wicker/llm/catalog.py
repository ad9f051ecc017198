"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wicker.llm import canonical, cooccurrence, distinctiveness, markup, mixture, sentences, split_overlap, tokenize

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "p2_found": cooccurrence.found,
        "p2_pairs": cooccurrence.pairs,
        "p4_found": canonical.found,
        "p4_unmatched": canonical.unmatched,
        "p5_found": distinctiveness.found,
        "p5_weights": distinctiveness.weights,
        "p6_found": markup.found,
        "p7_found": split_overlap.found,
        "p7_report": split_overlap.report,
        "p8_ids": tokenize.ids,
        "p9_mix": mixture.mix,
        "p9_shares": mixture.shares,
        "p10_found": sentences.found,
    }


def oracle_sql() -> dict[str, str]:
    return {**cooccurrence.SQL, **distinctiveness.SQL, **split_overlap.SQL}
