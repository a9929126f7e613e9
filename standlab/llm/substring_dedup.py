"""Substring de-duplication by fixed-block anchors.

A window is ``window`` consecutive words of one text; a word is removed if a window that covers
it has the same words as a window that starts anywhere else, in the same text or another.

* Anchors.  Every text is cut into blocks of ``(window + 1) // 2`` words at fixed places, so any
  window holds one whole block of its text.  The blocks are the index; every place of every text
  probes it with the hash of as many words.  A repeated window therefore covers a probe that hits
  a block at another place.
* Extension.  Only windows over such hits are compared, by 96-bit hashes of all their words;
  overlapping repeats merge to maximal runs of removed words.

Probes and windows travel packed: a task sends, for each partition of the hash space, one row
of arrays for some megabytes of text, and gets its hits back in rows by text group.  Hits are
decided by counts, never by pairs, so a passage that a third of all texts share costs
its own length each time.  Texts are shuffled once, by a hash of id and text.  Memory of a task
follows the size of a partition, so ``spark.sql.shuffle.partitions`` should follow the input.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from standlab.llm.packed import PLACES, dealt, part_of, read_places
from standlab.llm.registry import register
from standlab.llm.tables import table
from standlab.llm.words import Words, by_text, gram_hashes, utf8


WINDOW = np.dtype([("x", "<u8"), ("y", "<u4")])  # a window's hash


def _probes(keyed: DataFrame, window: int, block: int, parts: int) -> DataFrame:
    def run(batches):
        for rows, words in by_text(batches):
            doc = words.doc()
            pos = np.arange(len(doc)) - words.first[doc]
            at = np.flatnonzero(words.whole(block) & (words.counts >= window)[doc])
            if not len(at):
                continue
            hashes = words.grams(block)[at]
            key = hashes.astype(np.uint32) & np.uint32(0xFFFFFFFE) | (pos[at] % block == 0)
            yield pd.DataFrame(dealt(part_of(hashes, parts), doc[at], pos[at], rows["id"].to_numpy(),
                                     {"hashes": key.astype(np.uint32)}))

    return keyed.select("id", "text").mapInPandas(run, PLACES + ", hashes binary")


def _hits(packed: DataFrame, parts: int, anchored: bool) -> DataFrame:
    """Places whose hash occurs twice at least (and at a block, if ``anchored``), by text group."""
    def run(batches):
        rows = [r for batch in batches for r in batch.itertuples(index=False)]
        if not rows:
            return
        hashes = np.concatenate([np.frombuffer(r.hashes, np.uint32 if anchored else WINDOW) for r in rows])
        hit = np.zeros(len(hashes), bool)
        if anchored:
            blocks = np.unique(hashes[hashes & 1 == 1] >> 1)
            if not len(blocks):
                return
            value = hashes >> 1
            near = np.minimum(np.searchsorted(blocks, value), len(blocks) - 1)
            maybe = np.flatnonzero(blocks[near] == value)
            order = maybe[np.argsort(value[maybe], kind="stable")]
            same = value[order][1:] == value[order][:-1]
        else:
            order = np.lexsort((hashes["y"], hashes["x"]))
            same = hashes[order][1:] == hashes[order][:-1]
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        at, ids, pos = 0, [], []
        for r in rows:
            i, p = read_places(r.ids, r.counts, r.steps)
            mine = hit[at:at + len(i)]
            at += len(i)
            ids.append(i[mine]), pos.append(p[mine])
        ids, pos = np.concatenate(ids), np.concatenate(pos)
        if len(ids):  # one answer for each text group
            order = np.lexsort((pos, ids))
            known, doc = np.unique(ids[order], return_inverse=True)
            yield pd.DataFrame(dealt(ids[order] % parts, doc, pos[order], known, {}))

    return packed.repartitionById(parts, F.col("part")).mapInPandas(run, PLACES)


def _by_id(hits: pd.DataFrame) -> dict[int, np.ndarray]:
    """Places of a text group's texts."""
    if not len(hits):
        return {}
    ids, pos = (np.concatenate(x) for x in zip(*[read_places(r.ids, r.counts, r.steps)
                                                 for r in hits.itertuples(index=False)]))
    order = np.lexsort((pos, ids))
    known, first = np.unique(ids[order], return_index=True)
    return dict(zip(known.tolist(), np.split(pos[order], first[1:])))


def _windows(keyed: DataFrame, hits: DataFrame, window: int, block: int, parts: int) -> DataFrame:
    """Hashes of all windows that cover a hit."""
    def run(texts, hits):
        places = _by_id(hits)
        texts = texts[texts["id"].isin(places.keys())]
        rows = []
        for group, words in by_text([texts], seeds=(1, 2)):
            ids = group["id"].to_numpy()
            cover = np.zeros(len(words.starts) + 1, np.int64)
            for k, i in enumerate(ids.tolist()):
                at = places[i]
                low = np.maximum(at - (window - block), 0)
                np.add.at(cover, words.first[k] + low, 1)
                np.add.at(cover, words.first[k] + at + 1, -1)
            at = np.flatnonzero((np.cumsum(cover)[:-1] > 0) & words.whole(window))
            if len(at):
                doc = words.doc()[at]
                both = np.empty(len(at), WINDOW)
                both["x"], both["y"] = (gram_hashes(h, window)[at] for h in words.hashes)
                rows += dealt(part_of(both["x"], parts), doc, at - words.first[doc], ids, {"hashes": both})
        return pd.DataFrame(rows, columns=["part", "ids", "counts", "steps", "hashes"])

    return (keyed.groupBy("part").cogroup(hits.groupBy("part"))
            .applyInPandas(run, PLACES + ", hashes binary"))


def repeated_windows(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Texts by group, and the places of their repeated windows by the same groups."""
    block = (window + 1) // 2
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("id", F.xxhash64("doc_id", "text"))
    keyed = keyed.select("*", F.pmod("id", F.lit(parts)).cast("int").alias("part"))
    anchors = _hits(_probes(keyed, window, block, parts), parts, anchored=True)
    windows = _windows(keyed, anchors, window, block, parts)
    return keyed, _hits(windows, parts, anchored=False)


def remove_repeats(docs: DataFrame, window: int = 35, digest: bool = False) -> DataFrame:
    """Every row of ``docs`` (doc_id, text and any others) without its repeated windows.

    With ``digest``: doc_id, n_words, n_removed and kept_sha256 of the kept words joined by one
    space.  Else the columns of ``docs``, with ``text`` the input without the removed runs (each
    run and the white space around it gives one space), then n_words, n_removed and ``spans``, the
    removed runs as [first word, behind the last word]; columns of these names are replaced.
    A null text has no words and stays null.  Texts shorter than a window lose nothing.  Rows may
    repeat, share a doc_id or have none: a row counts as a place of its own.
    """
    rest = [] if digest else [f for f in docs.schema.fields
                              if f.name not in ("doc_id", "text", "n_words", "n_removed", "spans")]
    # whole numbers travel as text: a null beside them would make them floats in pandas
    exact = {f.name: isinstance(f.dataType, T.IntegralType) for f in rest}
    plain = docs.select(F.col("doc_id").cast("string"), "text", *[
        F.col(f"`{f.name}`").cast("string" if exact[f.name] else f.dataType).alias(f"c{i}")
        for i, f in enumerate(rest)])
    keyed, repeats = repeated_windows(plain, window)

    def run(texts, hits):
        places = _by_id(hits)
        out = []
        for row in texts.itertuples(index=False):
            words = utf8([row.text])[0].split()
            gone = np.zeros(len(words) + 1, np.int64)
            at = places.get(row.id)
            if at is not None:
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
            keep = np.cumsum(gone)[:-1] == 0
            record = [len(words), int((~keep).sum())]
            if digest:
                record.append(hashlib.sha256(b" ".join(compress(words, keep))).hexdigest())
            else:
                edge = np.flatnonzero(np.diff(keep.astype(np.int8), prepend=1, append=1)).reshape(-1, 2)
                record += [edge.tolist(), _cut(row.text, edge)]
            out.append(record)
        new = ["n_words", "n_removed"] + (["kept_sha256"] if digest else ["spans", "text"])
        kept = texts[["doc_id", *[f"c{i}" for i in range(len(rest))]]].reset_index(drop=True)
        return kept.join(pd.DataFrame(out, columns=new))

    schema = "doc_id string" + "".join(
        f", c{i} {'string' if exact[f.name] else f.dataType.simpleString()}" for i, f in enumerate(rest))
    schema += ", n_words long, n_removed long, " + (
        "kept_sha256 string" if digest else "spans array<array<long>>, text string")
    found = keyed.groupBy("part").cogroup(repeats.groupBy("part")).applyInPandas(run, schema)
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    if digest:
        return found.withColumn("doc_id", doc_id)
    named = {f.name: F.col(f"c{i}").cast(f.dataType) for i, f in enumerate(rest)} | {
        "doc_id": doc_id, "text": F.col("text")}
    return found.select(*[named[c].alias(c) for c in docs.columns if c in named], "n_words", "n_removed", "spans")


def _cut(text: str | None, spans: np.ndarray) -> str | None:
    if text is None or not len(spans):
        return text
    data = utf8([text])
    words = Words(data)
    raw, kept, at = data[0], [], 0
    for a, b in spans:
        kept.append(raw[at:words.starts[a]].rstrip(b" \t\n\v\f\r"))
        at = int(words.ends[b - 1])
    kept.append(raw[at:].lstrip(b" \t\n\v\f\r"))
    return b" ".join(k for k in kept if k).decode("utf-8", "surrogatepass")


@register("op8_substring_dedup", sql=r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(words[i:i + 34], ' ')) AS n FROM g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM h WHERE n > 1),
l AS (SELECT doc_id, list(j) AS gone FROM r GROUP BY doc_id),
k AS (SELECT w.doc_id, words, CASE WHEN gone IS NULL THEN words ELSE list_transform(list_filter(
      range(1, len(words) + 1), lambda x: NOT list_contains(gone, x)), lambda x: words[x]) END AS kept
      FROM w LEFT JOIN l ON l.doc_id = w.doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - len(kept) AS n_removed,
       sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
""")
def op8_substring_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
