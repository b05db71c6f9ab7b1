"""What an extraction of nodes was made with: its operators as data, and a digest of them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from sparkscape.functions import text as T


def declaration(top_k: int = 20, stop: tuple[str, ...] = T.STOP_WORDS, most: int = 1, min_df: int = 2) -> list[tuple[str, str]]:
    """(operator, parameters as JSON) in the order they apply."""
    steps = [
        ("normalize", {"form": "NFC", "case": "lower"}),
        ("tokenize", {"pattern": T.TOKEN}),
        ("stop_words", {"words": sorted(stop)}),
        ("ngrams", {"most": most}),
        ("document_frequency", {"least": min_df}),
        ("pool", {"factor": 3, "by": ["tf", "term"]}),
        ("score", {"measure": "mean tf-idf", "digits": 9}),
        ("cut", {"top_k": top_k, "ties": "members stay"}),
    ]
    return [(name, json.dumps(p, ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for name, p in steps]


def digest(steps: list[tuple[str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{n} {p}" for n, p in steps).encode()).hexdigest()


def declared(spark: SparkSession, **parameters) -> DataFrame:
    """ordinal, operator, parameters, sha256 of the whole."""
    steps = declaration(**parameters)
    sha = digest(steps)
    return spark.createDataFrame([(k, n, p, sha) for k, (n, p) in enumerate(steps)], "ordinal int, operator string, parameters string, sha256 string")
