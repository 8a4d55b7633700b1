"""Tables with every awkward case: nulls, empty and long texts, ties, repeated rows, clashing column names."""

from __future__ import annotations

from pathlib import Path

import duckdb

ROOT, SMALL = Path(__file__).resolve().parents[2], "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"

LINE = "This very line stands in several of the documents."
PASSAGE = "one two three four five six seven eight nine ten eleven twelve"
LONG = " ".join(f"word{n % 997}" for n in range(60_000))

ROWS = [
    (1, None, "en", "a", 0),
    (2, "", None, None, 0),
    (3, " \t\n\r\x0b\x0c ", "en", "b", None),
    (4, LINE, "en", "a", 1),
    (5, f"{LINE.upper()}\nown line of five, long enough\n{LINE}", "en", "a", 1),
    (6, f"  {LINE}\t\n\n", "en", "c", 1),
    (7, f"{LINE}\nshort", "en", "a", 1),
    (8, LONG, "en", "b", 1),
    (9, LONG + " end", "en", "b", 1),
    (10, f"Before, {PASSAGE.upper()}! and after", "en", "a", 1),
    (11, "one two three four five six seven eight nine", "en", "a", 1),
    (12, "Äpfel und Öl, größer als 12,5 % — ß 漢字 \U0001f600", "de", "a", 1),
    (13, "x" * 30 + "\n" + "x" * 30, "de", "z", 1),
    (14, "### 123 $$$ 456", "fr", None, 1),
    (15, "the same text", "en", "b", 1),
    (16, "the same text", "en", "b", 1),
    (16, "the same text", "en", "b", 1),
    (17, "the other text with this number", "en", "b", 1),
    (17, f"{LINE}\nanother row of the same number", "en", "b", 1),
    (None, f"{LINE}\nwithout a number", "en", "b", 1),
    (None, None, None, None, None),
    (18, "zeile eins\nzeile zwei\nzeile eins\nzeile eins", "de", "d", 1),
    (19, "spam " * 200, "en", "d", 1),
]

BENCHMARK = [
    (1, PASSAGE),
    (2, "seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"),
    (3, "漢字"),
    (4, None),
    (5, "...!"),
    (6, PASSAGE),
    (None, "one two three four five six seven eight nine TEN"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def benchmark(spark, rows=BENCHMARK):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def clashing(docs):
    """Columns named like those that operators add or use inside."""
    names = "print row key h1 pos size copies target shard slot curve_index held_out words rank kind found fp root".split()
    from pyspark.sql import functions as F

    return docs.withColumns({name: F.lit("x") for name in names})


def sql(spark, query, **tables):
    """Rows of a query's SQL over small tables."""
    connection = duckdb.connect()
    for name, df in tables.items():
        connection.register(name, df.toArrow())
    return connection.execute(query).fetchall(), [d[0] for d in connection.description]


def rows_of(df, columns=None):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)
