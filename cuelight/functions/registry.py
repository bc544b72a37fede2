"""The library's own functions for SQL: text folding, repeats, common subsequence, and captions as a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from cuelight.functions.text import nfkc
from cuelight.operators.detectors import most_repeats, widest_repeat
from cuelight.operators.distance import edit_length, lcs_length
from cuelight.sources.captions import CUE, cues


@F.pandas_udf(StringType())
def plain_text(text: pd.Series) -> pd.Series:
    """Text at the level of the production detectors."""
    from cuelight.functions.text import plain_py

    return text.map(lambda t: None if t is None else plain_py(t))


@F.udtf(returnType=StructType(CUE.fields[1:]))
class CaptionCues:
    """The cues of one caption file's text."""

    def eval(self, document: str):
        for i, c in enumerate(cues(document or "")):
            yield i, c["start_s"], c["end_s"], c["text"], c["ruby"], c["drcs"], c["cleared"]


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, function in (("nfkc", nfkc), ("plain_text", plain_text), ("lcs_length", lcs_length), ("edit_length", edit_length), ("widest_repeat", widest_repeat), ("most_repeats", most_repeats)):
        spark.udf.register(name, function)
    spark.udtf.register("caption_cues", CaptionCues)
