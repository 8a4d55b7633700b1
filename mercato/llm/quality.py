"""Quality rules as a cascade that stops at the first rule that rejects.

Each rule compares measures of a text: expressions over the text and its words. On a sample, one pass counts for every
set of rules that reject a document how many documents it has and what each rule costs on them: the steps that its
measures take, as counted from bytes and words, times what a step was measured to cost. The rules then stand in a CASE:
first the one that rejects most for its cost, next the one that does so among the documents left over, and so on. Clocks
take no part in it and the sample is chosen by hash from all files, so two runs give one order, however the table
is cut. The verdict does not depend on the order.

Defined results: null text has no words and no lines and is rejected as too short. Words are runs of anything but
ASCII white space. All rows are judged alone, so repeated rows, ties and copies get equal verdicts. Very long texts are
judged whole; they are only left out of the sample. An empty table gives an empty result and the rules by cost per text.
Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import SPACES, let, words

#: Rows at most whose rejections and steps are counted, and bytes of each. They decide the order of the rules only.
SAMPLE_ROWS, SAMPLE_BYTES = 500, 65536


def n_words(w: Column) -> Column:
    return F.size(w).cast("bigint")


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line."""
    held = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(held, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(w: Column) -> Column:
    """Words inside three-word windows that occur twice or more.

    Windows are hashed and sorted with their places, so equal ones are neighbours: n log n steps for n words.
    """

    def pairs(a: Column, step: int, f: Callable) -> Column:
        return F.zip_with(F.slice(a, 1, F.size(a) - step), F.slice(a, 1 + step, F.size(a) - step), f)

    def covered(hashes: Column) -> Column:
        tagged = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        places = lambda a: F.array(a["i"], a["i"] + 1, a["i"] + 2)
        equal = lambda a, b: F.when(a["h"] == b["h"], F.concat(places(a), places(b)))
        found = let(tagged, lambda s: F.filter(pairs(s, 1, equal), lambda x: x.isNotNull()))
        return F.size(F.array_distinct(F.flatten(found)))

    two = lambda a: pairs(a, 1, lambda x, y: F.xxhash64(x, y))
    windows = let(w, lambda v: let(two(v), two))
    repeated = let(
        windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
    )
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(repeated).cast("bigint")


def base_failed(n: Column, repeat: Column) -> Column:
    return (n < 50) | (repeat * 100 > n * 50)


def _count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


@dataclass(frozen=True)
class Measure:
    """``value(text, words)``, and nanoseconds of a step; a step is a byte of the text, or a word of a sort by pairs."""

    value: Callable[[Column, Column], Column]
    nanoseconds: float
    sorts: bool = False

    def cost(self, text: Column, w: Column) -> Column:
        """Estimated nanoseconds for one text: fixed work, and its steps."""
        n = F.size(w).cast("double")
        steps = n * F.log2(n + 2) if self.sorts else F.coalesce(F.octet_length(text), F.lit(0)).cast("double")
        return F.lit(100.0) + steps * self.nanoseconds


#: What a step costs was measured once, over 6,000 texts of 16 MB on one core; only the ratios matter.
MEASURES = {
    "n_words": Measure(lambda text, w: n_words(w), 0.0),
    "word_chars": Measure(lambda text, w: word_chars(w), 5.0),
    "n_symbols": Measure(lambda text, w: n_symbols(text), 5.0),
    "n_lines": Measure(lambda text, w: F.size(F.split(F.coalesce(text, F.lit("")), "\n")), 1.0),
    "n_dup_lines": Measure(lambda text, w: n_dup_lines(text), 9.0),
    "n_repeat_words": Measure(lambda text, w: n_repeat_words(w), 75.0, sorts=True),
    "n_shouts": Measure(lambda text, w: _count(text, "!!"), 3.0),
    "n_capitals": Measure(lambda text, w: _count(text, "[A-Z]"), 8.0),
}

Measures = Callable[[str], Column]


def fresh(text: Column, w: Column) -> Measures:
    """Measures worked out where they are asked for."""
    return lambda name: MEASURES[name].value(text, w)


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the measures by name and is true or false, never null; ``uses`` are the names it asks for."""

    name: str
    uses: tuple[str, ...]
    rejects: Callable[[Measures], Column]


RULES = (
    Rule("short", ("n_words",), lambda m: m("n_words") < 50),
    Rule("repeats", ("n_repeat_words", "n_words"), lambda m: m("n_repeat_words") * 100 > m("n_words") * 50),
    Rule("symbols", ("n_symbols", "n_words"), lambda m: m("n_symbols") * 4 > m("n_words")),
    Rule(
        "word_length",
        ("word_chars", "n_words"),
        lambda m: (m("word_chars") < m("n_words") * 2) | (m("word_chars") > m("n_words") * 20),
    ),
    Rule("lines", ("n_dup_lines", "n_lines"), lambda m: m("n_dup_lines") * 2 > m("n_lines")),
    Rule("shouting", ("n_shouts", "n_words"), lambda m: m("n_shouts") * 4 > m("n_words")),
    Rule("capitals", ("n_capitals", "word_chars"), lambda m: m("n_capitals") * 2 > m("word_chars")),
)


@dataclass(frozen=True)
class Estimate:
    """A rule's place in the cascade: what it costs and rejects on the documents of the sample that reach it."""

    rule: Rule
    reached: int
    rejected: int
    nanoseconds: float


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Estimate]:
    """The cascade for ``docs``, from the ``rows`` different documents with the smallest hashes of doc_id and text.

    Each next rule rejects most for its cost among the documents that the earlier ones left; where none rejects any, the
    cheaper goes first. The greatest hash of the sample is found first, from the hashes alone, so no text is
    shuffled but the sample's. The driver sees one row for each set of rules that reject a document of it together.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.where(F.octet_length("text") <= SAMPLE_BYTES)
    texts = texts.select(F.xxhash64("doc_id", "text").alias("print"), "text")
    last = texts.select("print").distinct().orderBy("print").limit(rows).agg(F.max("print")).first()[0]
    sample = texts.where(F.col("print") <= F.lit(last).cast("bigint"))
    sample = sample.groupBy("print").agg(F.first("text").alias("text"))
    text, w = F.col("text"), F.col("w")
    judged = sample.select("text", words(text).alias("w")).select(
        F.array(*[rule.rejects(fresh(text, w)) for rule in rules]).alias("rejects"),
        *[sum((MEASURES[u].cost(text, w) for u in rule.uses), F.lit(0.0)).alias(rule.name) for rule in rules],
    )
    sums = judged.groupBy("rejects").agg(F.count(F.lit(1)).alias("n"), *[F.sum(r.name).alias(r.name) for r in rules])
    groups, waiting, cascade = sums.collect(), list(range(len(rules))), []
    groups.sort(key=lambda g: g["rejects"])

    def estimate(k: int) -> Estimate:
        rejected = sum(g["n"] for g in groups if g["rejects"][k])
        cost = sum(g[rules[k].name] for g in groups)
        return Estimate(rules[k], sum(g["n"] for g in groups), rejected, cost)

    def gain(k: int) -> tuple[float, float, int]:
        found = estimate(k)
        return found.rejected / max(found.nanoseconds, 1.0), -found.nanoseconds, -k

    while waiting:
        best = max(waiting, key=gain)
        waiting.remove(best)
        cascade.append(estimate(best))
        groups = [g for g in groups if not g["rejects"][best]]
    return cascade


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules of the cascade in their order."""
    return [found.rule for found in estimates(docs, rules, rows)]


def first_to_reject(rules: list[Rule], m: Measures) -> Column:
    """The name of the first rule that rejects, else null. Later rules are not evaluated."""
    out = F
    for rule in rules:
        out = out.when(rule.rejects(m), F.lit(rule.name))
    return out.otherwise(F.lit(None).cast("string"))


def verdict(text: Column, rules: list[Rule]) -> Column:
    """``first_to_reject`` of a text; a measure is worked out when a rule that uses it is reached."""
    return let(words(text), lambda w: first_to_reject(rules, fresh(text, w)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``rejected_by``; a column of that name is replaced."""
    return docs.withColumn("rejected_by", verdict(F.col("text").cast("string"), order_rules(docs, rules)))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, columns as they were."""
    return docs.where(verdict(F.col("text").cast("string"), order_rules(docs, rules)).isNull())


def measured(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, five measures, base_failed and kept.

    The five are returned for every document, so the rules take them from their columns; what only a rule looks at is
    worked out when the cascade reaches the rule.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    order = [rule for rule in order_rules(docs, rules) if rule.name not in ("short", "repeats")]
    text = F.col("text").cast("string")
    split = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), words(text).alias("w"))
    text, w = F.col("text"), F.col("w")
    counted = split.select("doc_id", "text", "w", *[MEASURES[n].value(text, w).alias(n) for n in names])
    base = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rejected = first_to_reject(order, lambda n: F.col(n) if n in names else MEASURES[n].value(text, w))
    kept = F.when(base, F.lit(False)).otherwise(rejected.isNull())
    return counted.select("doc_id", *names, base.alias("base_failed"), kept.alias("kept"))
