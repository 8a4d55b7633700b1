"""Language identification with error-correcting output codes.

Each language has a codeword of signs. A binary logistic classifier over hashed n-grams (one to four bytes of a word
and its edges) predicts each sign. A text is decoded by the logistic losses of its margins
against every codeword; the language with the least loss wins, and a text whose two best are close is flagged.

The classifiers are fitted on a bounded sample: at most ``SAMPLE`` documents, the same number for each language at
most, those with the smallest hashes of their texts; texts under ``LEAST_BYTES`` only where longer ones do not
suffice. All documents are predicted, over whole texts.

Defined results: ``und`` with score 0 for null and for texts without a letter, or if nothing can be learned. Texts in
one learned language only are given that language. A null doc_id is not held out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mercato.llm.common import fingerprint, held_out, need, small_batches
from mercato.session import written

#: Documents that classifiers are fitted on, and the bytes under which a text is taken last.
SAMPLE, LEAST_BYTES = 1200, 100
#: Hashed n-grams, and the bytes of the longest.
FEATURE_BITS = 11
FEATURES, LONGEST = 1 << FEATURE_BITS, 4
#: Words that are hashed at once.
STRETCH = 1 << 16
#: Signs of a codeword at least.
BITS = 15
STEPS = 80
#: Loss per sign between the two best languages under which a text is ambiguous.
CLOSE = 0.05

_LETTER = re.compile(r"[^\W\d_]")
_WORD = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split()


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a text: runs of one to four bytes within a word and its two edges."""
    counts = np.zeros(FEATURES, np.int64)
    split = words_of(text)
    for start in range(0, len(split), STRETCH):
        marked = b" ".join([b"", *split[start : start + STRETCH], b""])
        a = np.frombuffer(marked, np.uint8).astype(np.uint32)
        inner = a != 32
        hashes = np.zeros(len(a), np.uint32)
        for n in range(1, LONGEST + 1):
            hashes = hashes[: len(a) - n + 1] * np.uint32(0x01000193) ^ a[n - 1 :]
            # Only blanks at either end: all bytes between are of one word.
            whole = inner if n == 1 else np.ones(len(hashes), bool)
            for k in range(1, n - 1):
                whole = whole & inner[k : k + len(hashes)]
            mixed = (hashes[whole] + np.uint32(n)) * np.uint32(0x9E3779B1)
            counts += np.bincount(mixed >> np.uint32(32 - FEATURE_BITS), minlength=FEATURES)
    return counts


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Signs (languages, bits): of a number of random codes the one whose closest two words differ most."""
    bits = max(BITS, 8 * int(np.ceil(np.log2(max(languages, 2)))) - 1)
    rng, best, most = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (languages, bits))
        if languages > 1:
            constant = np.abs(code.sum(axis=0)) == languages
            code[0, constant] *= -1
            apart = (code[:, None, :] != code[None, :, :]).sum(axis=2) + np.eye(languages, dtype=int) * bits
            if apart.min() > most:
                best, most = code, apart.min()
        else:
            best = code
    return best


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The n-gram counts of each text, packed."""
    for batch in batches:
        packed = [ngram_counts(t).astype(np.float32).tobytes() for t in batch["text"]]
        yield pd.DataFrame({"lang": batch["lang"], "counts": packed})


def sample(docs: DataFrame, rows: int = SAMPLE) -> DataFrame:
    """lang and n-gram counts of ``rows`` documents at most. First the keys are chosen, then their texts are read.

    Of each language's different texts, long and short ones apart, only those whose hash is small enough are ranked:
    some four times as many as can be taken, so the ranking does not grow with the documents. Where fewer than can be
    taken have such a hash, all are ranked. So the smallest hashes are taken, however often a text is repeated.
    """
    short = F.octet_length("text") < LEAST_BYTES
    usable = docs.where(F.col("lang").isNotNull() & (~short | F.col("text").rlike(r"\p{L}")))
    usable = usable.withColumns({"print": fingerprint(F.col("text")), "short": short})
    keys = written(usable.select("lang", "short", "print").distinct(), "language-keys")
    kinds = keys.groupBy("lang", "short").agg(F.count(F.lit(1)).alias("n"))
    kinds = written(kinds, "language-kinds")
    each = max(rows // max(kinds.select("lang").distinct().count(), 1), 1)
    place = F.shiftrightunsigned("print", 11)
    small = place / F.lit(float(1 << 53)) * F.col("n") <= 4 * each
    marked = keys.join(kinds, ["lang", "short"]).withColumn("small", small)
    few = marked.groupBy("lang", "short").agg(F.count_if("small").alias("found"), F.first("n").alias("n"))
    few = few.where(F.col("found") < F.least("n", F.lit(each))).select("lang", "short", F.lit(True).alias("few"))
    few = written(few, "languages-with-few")
    ranked = marked.join(few, ["lang", "short"], "left").where(F.col("small") | F.col("few"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("short", place, "print"))
    chosen = ranked.withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "print")
    # At most ``rows`` keys, or one for each language.
    texts = usable.join(F.broadcast(chosen), ["lang", "print"])
    once = texts.groupBy("lang", "print").agg(F.first("text").alias("text"))
    return once.select("lang", "text").mapInPandas(_features, "lang string, counts binary")


def fit(x: np.ndarray, signs: np.ndarray, steps: int = STEPS, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, bits) and bias of one logistic classifier for each sign, by accelerated gradient steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 0, scale, np.inf)
    z = ((x - mean) / scale).astype(np.float32)
    probe = np.ones(z.shape[1], np.float32)
    for _ in range(15):
        probe = z.T @ (z @ probe)
        probe /= max(float(np.linalg.norm(probe)), 1e-12)
    step = 4.0 * len(z) / max(float(np.linalg.norm(z @ probe)) ** 2, 1e-6)
    w = ahead = np.zeros((z.shape[1], signs.shape[1]), np.float32)
    b = np.zeros(signs.shape[1], np.float32)
    for k in range(steps):
        pull = -signs / (1 + np.exp(np.clip(signs * (z @ ahead + b), -30, 30)))
        after = ahead - step * (z.T @ pull / len(z) + penalty * ahead)
        b = b - 0.5 * pull.mean(axis=0)
        ahead, w = after + k / (k + 3) * (after - w), after
    weights = w / scale[:, None]
    return weights.astype(np.float32), b - mean @ weights


def decode(margins: np.ndarray, code: np.ndarray) -> tuple[int, float, bool]:
    """The nearest codeword, its share of the weight, and whether the second is close."""
    losses = np.log1p(np.exp(np.clip(-code * margins, -30, 30))).sum(axis=1)
    weight = np.exp(losses.min() - losses)
    best = int(losses.argmin())
    others = np.delete(losses, best)
    close = bool(len(others)) and (others.min() - losses[best]) / code.shape[1] < CLOSE
    return best, float(weight[best] / weight.sum()), close


def identify(docs: DataFrame, of: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous. Documents with crc32(doc_id) mod ``of`` at ``remainder`` teach nothing."""
    docs = need(small_batches(docs), doc_id="bigint", text="string", lang="string")
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), of, remainder))
    rows = sorted(tuple(r) for r in sample(docs.where(~F.col("held_out"))).collect())
    names = sorted({lang for lang, _ in rows})
    code = weights = bias = None
    if names:
        x = np.stack([np.frombuffer(counts, np.float32) for _, counts in rows])
        x = x / np.maximum(x.sum(axis=1, keepdims=True), 1)
        code = codewords(len(names))
        weights, bias = fit(x, code[[names.index(lang) for lang, _ in rows]])
    model = docs.sparkSession.sparkContext.broadcast((names, code, weights, bias))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, code, weights, bias = model.value
        for batch in batches:
            out = []
            for text in batch["text"]:
                if not names or text is None or not _LETTER.search(text):
                    out.append(("und", 0.0, True))
                    continue
                counts = ngram_counts(text)
                best, score, close = decode(counts / max(counts.sum(), 1) @ weights + bias, code)
                out.append((names[best], score, close))
            found = pd.DataFrame(out, columns=["lang_pred", "score", "ambiguous"], index=batch.index)
            yield pd.concat([batch[["doc_id", "held_out"]], found], axis=1).astype({"doc_id": "Int64"})

    schema = "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean"
    return docs.select("doc_id", "held_out", "text").mapInPandas(predict, schema)
