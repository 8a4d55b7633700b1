"""Text clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts a CSV reader of the source system takes as "missing".
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Every character that counts as white space.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(code) for code in range(0x2000, 0x200B)
)


def strip(text: Column) -> Column:
    """Cut white space, of any kind, from both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def zero_fill(text: Column, width: int) -> Column:
    """Pad with leading zeros; a text that is already longer stays whole."""
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def without_missing_tokens(df: DataFrame) -> DataFrame:
    """Null every text column value that only says "missing"."""
    texts = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(
        [F.when(~F.col(c).isin(*MISSING_TOKENS), F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    )
