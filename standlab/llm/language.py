"""Language identification by compression with per-language zstandard dictionaries.

For every language a raw-content dictionary is made of labelled texts: the model is just text.
A text is cut into pieces, each piece is compressed once with every dictionary, and the language
with the smallest total wins.  Where the second smallest is close, the answer is rejected.

Texts and dictionaries are reduced to lower-case letters and single spaces, so that case,
digits and signs do not vote.  Pieces are short because a long text soon compresses by itself:
the dictionary only helps at the start of what is compressed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from standlab.llm.registry import register
from standlab.llm.tables import table

SAMPLE = 400  # texts of a language in its dictionary
EACH = 400  # letters of each of these texts
PIECE = 1000  # bytes compressed at once
LEVEL = 3
MARGIN = 0.01  # smallest share by which the second language must be larger
UNKNOWN = "und"
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> str:
    """Lower-case words of letters; a word that repeats at once counts once, as it would be
    compressed from itself."""
    return " ".join(word for word, _ in groupby(_OTHER.sub(" ", text or "").strip().lower().split(" ")))


def dictionaries(docs: DataFrame, sample: int = SAMPLE, each: int = EACH) -> dict[str, bytes]:
    """Raw content for each non-null ``lang``: the first ``each`` letters of ``sample`` texts.

    The sample is the documented bound of this classifier: the distinct texts with the smallest
    hashes, so that copies of a text take one place.  Hashes are made distinct and ranked inside
    every task before the shuffle; only the chosen texts are read whole and reduced to letters
    before they are cut.  Texts without letters teach nothing.
    Languages come in the order of their labelled texts, the most frequent first.
    """
    order = Window.partitionBy("lang").orderBy("_hash")
    known = (docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
             .select("lang", "text", F.xxhash64("text").alias("_hash")))
    chosen = (known.select("lang", "_hash").distinct()
              .withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= sample))

    def reduce(batches):  # every chosen text once a task
        seen = set()
        for batch in batches:
            rows = []
            for lang, key, text in zip(batch["lang"], batch["_hash"], batch["text"]):
                if (lang, key) not in seen:
                    seen.add((lang, key))
                    rows.append((lang, key, letters(text)[:each]))
            yield pd.DataFrame(rows, columns=["lang", "_hash", "text"])

    sampled = (known.join(F.broadcast(chosen.select("lang", "_hash")), ["lang", "_hash"], "left_semi")
               .select("lang", "_hash", "text").mapInPandas(reduce, "lang string, _hash long, text string")
               .groupBy("lang", "_hash").agg(F.min("text").alias("text")))
    counts = docs.filter("lang IS NOT NULL").groupBy("lang").count().collect()
    parts: dict[str, list[str]] = {}
    for row in sampled.orderBy("lang", F.desc("_hash")).collect():
        parts.setdefault(row["lang"], []).append(row["text"])
    ranked = [r["lang"] for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))]
    return {lang: " ".join(parts[lang]).encode() for lang in ranked if lang in parts}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        self.langs = list(content)
        self.coders = []
        for lang in self.langs:
            data = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(
                level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> np.ndarray:
        """Compressed bytes of all pieces of the text, for each language."""
        data = (" " + text + " ").encode("utf-8", "replace")
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        return np.array([sum(len(c.compress(p)) for p in pieces) for c in self.coders], float)


def identify(spark, content: dict[str, bytes], margin: float = MARGIN):
    """A column function of texts: struct of lang, score (0 to 1), margin and rejected.

    score is the smallest size's weight among all, where a byte more divides a weight by e^2;
    margin is the share by which the second language is larger, and rejected
    tells that it is below ``margin``.  A null text, one without a letter, and any text where
    nothing was learned are ``und`` with score 0 and rejected.  Ties go to the language with more
    labelled texts.
    """
    shared = spark.sparkContext.broadcast(content)

    @F.pandas_udf("lang string, score double, margin double, rejected boolean")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Classifier(shared.value)
        for texts in batches:
            rows = []
            for text in texts:
                plain = letters(text)
                if not own.langs or not _LETTER.search(plain):
                    rows.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                size = own.sizes(plain)
                best = int(np.argmin(size))
                rest = np.delete(size, best)
                gap = float((rest.min() - size[best]) / size[best]) if len(rest) else 1.0
                weight = 1 / float(np.exp(-2 * np.minimum(size - size[best], 300)).sum())
                rows.append((own.langs[best], weight, gap, gap < margin))
            yield pd.DataFrame(rows, columns=["lang", "score", "margin", "rejected"])

    return found


@register("op2_language_id")
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    content = dictionaries(docs.filter(~held_out))
    told = docs.select("doc_id", held_out.alias("held_out"), identify(spark, content)("text").alias("p"))
    return told.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.margin", "p.rejected")
