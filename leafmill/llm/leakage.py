"""Held-out items whose text stands, whole or in part, in corpus documents.

A document holds an item if a passage of at least half the item, in the item's
order, stands in it with at most a tenth of its words changed, added or
missing. Any such passage shares a known number of five-word shingles with the
document. So of an item's shingles, ordered by rarity in the corpus, all but
that many less one make up a prefix of which the document must share one:
documents and items are joined on prefix shingles only. A pair must then pass
bounds of length and of position: enough shared shingles must lie on nearly the
same diagonal, as edits shift what follows them by at most their number. What
passes is verified on item-sized windows of the text.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.words import shingles, word_ids, words
from leafmill.session import cut, small, table

#: Words of a shingle, least share of the item, greatest share of the passage that may differ.
SIZE, PART, EDITS = 5, 0.5, 0.1
#: Most bits of the filter that documents' shingles pass before they are joined; more items make it less selective only.
BLOOM_BITS = 1 << 27


def least_words(n: int) -> int:
    """Words of the shortest passage that counts for an item of ``n`` words."""
    return max(1, -(-n // 2)) if PART == 0.5 else max(1, int(np.ceil(PART * n)))


def least_shared(n: int, distinct: int, size: int = SIZE) -> int:
    """Distinct shingles that a document with a counting passage shares at least.

    A passage of p words has p - size + 1 shingles; each of its p/10 edits
    breaks ``size`` of them; repeated ones count once.
    """
    m = least_words(n)
    least = min(p - size + 1 - size * int(p * EDITS) for p in range(m, m + 11))
    return max(1, least - (n - size + 1 - distinct))


def contains(item: list, doc: list, size: int = SIZE) -> bool:
    """True if ``doc`` holds a counting passage of ``item``; both are token lists.

    Windows of the document, as long as the item and its edits, are taken
    around shared shingles and aligned with the item.
    """
    n = len(item)
    if n == 0 or not doc:
        return False
    size = min(size, least_words(n))
    where: dict[tuple, list[int]] = {}
    for i in range(n - size + 1):
        where.setdefault(tuple(item[i : i + size]), []).append(i)
    # Starts that the item would have in the document, by each shared shingle.
    starts = sorted(j - i for j in range(len(doc) - size + 1) for i in where.get(tuple(doc[j : j + size]), ()))
    slack, at = int(n * EDITS) + 1, 0
    while at < len(starts):
        end = at
        while end + 1 < len(starts) and starts[end + 1] - starts[at] <= 2 * slack:
            end += 1
        lo, hi = max(0, starts[at] - slack), min(len(doc), starts[end] + n + slack)
        if _aligned(item, doc[lo:hi]):
            return True
        # Groups overlap by half, so a passage that drifts isn't parted.
        step = next((k for k in range(at + 1, end + 1) if starts[k] - starts[at] > slack), end + 1)
        at = step
    return False


def _aligned(item: list, window: list) -> bool:
    pairs = [
        (b.a + k, b.b + k)
        for b in SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks()
        for k in range(b.size)
    ]
    n, m = len(item), least_words(len(item))
    if len(pairs) < (1 - 2 * EDITS) * m:
        return False
    gaps = [0] + [max(i2 - i1, j2 - j1) - 1 for (i1, j1), (i2, j2) in zip(pairs, pairs[1:])]
    total = np.cumsum(gaps)
    first = np.array([p[0] for p in pairs])
    for s in range(len(pairs)):
        length = first[s:] - first[s] + 1
        edits = total[s:] - total[s]
        # Words at the ends may be among those that differ.
        more = np.minimum(np.maximum(0, m - length), first[s] + n - 1 - first[s:])
        if np.any((length + more >= m) & (edits + more <= EDITS * (length + more))):
            return True
    return False


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    """(item, h, at, need, n, k): shingles of distinct item texts by place, for each text its smallest item_id.

    Items of fewer words than a shingle use shingles of their least passage's
    length, which is told by ``k``.
    """

    def run(batches):
        for b in batches:
            out = [pd.DataFrame({c: [] for c in ("item", "h", "at", "need", "n", "k")})]
            for item, text in zip(b["item"], b["text"]):
                tokens = words(text)
                if not tokens:
                    continue
                k = min(size, least_words(len(tokens)))
                hs = shingles(word_ids(tokens), k)
                need = least_shared(len(tokens), len(np.unique(hs)), k)
                out.append(pd.DataFrame({"item": item, "h": hs, "at": np.arange(len(hs)), "need": need, "n": len(tokens), "k": k}))
            yield pd.concat(out[1:] or out)

    texts = benchmark.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item"))
    return texts.mapInPandas(run, "item bigint, h bigint, at int, need int, n int, k int")


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(h.view(np.uint64) >> np.uint64(s)) & np.uint64(bits - 1) for s in (0, 12, 24, 36)]


def bloom(hashes: DataFrame, most: int = BLOOM_BITS) -> np.ndarray:
    """Words of a Bloom filter of a column ``h``, of at most ``most`` bits, set side by side and joined by bit."""
    rows = hashes.select("h").distinct()
    bits = max(1024, min(most, 1 << (16 * rows.count()).bit_length()))
    places = F.array(*[F.shiftrightunsigned("h", s).bitwiseAND(F.lit(bits - 1)) for s in (0, 12, 24, 36)])
    each = rows.select(F.explode(places).alias("p")).select(
        F.shiftright("p", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    )
    out = np.zeros(bits // 64, np.uint64)
    for word, value in each.groupBy("word").agg(F.bit_or("bit")).toLocalIterator():
        out[word] = np.uint64(value & 0xFFFFFFFFFFFFFFFF)
    return out


def passes(h: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    """True for the hashes that a filter may hold."""
    ok = np.ones(len(h), bool)
    for p in _places(h, len(filter_) * 64):
        ok &= (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def _hits(docs: DataFrame, sizes: list[int], filter_: np.ndarray) -> DataFrame:
    """(doc_id, n_words, hs, ats): of each document the shingles that the filter lets pass, with their places."""
    shared = docs.sparkSession.sparkContext.broadcast(filter_)

    def lists(parts, kind):
        ends = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
        return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else [], kind))

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                keep, hs, ats, counts = [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = word_ids(words(text))
                    found = [(h, np.flatnonzero(passes(h, shared.value))) for h in (shingles(ids, k) for k in sizes)]
                    if any(len(at) for _, at in found):
                        keep.append(row)
                        hs.append(np.concatenate([h[at] for h, at in found]))
                        ats.append(np.concatenate([at for _, at in found]))
                        counts.append(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array(counts, pa.int32()), lists(hs, pa.int64()), lists(ats, pa.int32())],
                    names=["doc_id", "n_words", "hs", "ats"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n_words int, hs array<bigint>, ats array<int>")


def on_a_diagonal(item: dict[int, list[int]], need: int, n: int, hs, ats) -> bool:
    """True if ``need`` distinct shingles of an item lie within as many diagonals as it may have edits, plus one.

    A shingle at place j of the document and i of the item lies on diagonal
    j - i; every word added or missing shifts what follows by one.
    """
    points = sorted((j - i, h) for h, j in zip(hs, ats) for i in item.get(h, ()))
    if len(points) < need:
        return False
    wide, held, left = int(n * EDITS), {}, 0
    for d, h in points:
        held[h] = held.get(h, 0) + 1
        while points[left][0] < d - wide:
            old = points[left][1]
            held[old] -= 1
            if not held[old]:
                del held[old]
            left += 1
        if len(held) >= need:
            return True
    return False


def _positional(batches):
    """Pairs with the shingles of both sides: those that pass the bound of position."""
    for b in batches:
        ok = []
        for ih, iat, need, n, hs, ats in zip(b["ih"], b["iat"], b["need"], b["n"], b["hs"], b["ats"]):
            item: dict[int, list[int]] = {}
            for h, i in zip(ih.tolist(), iat.tolist()):
                item.setdefault(h, []).append(i)
            ok.append(on_a_diagonal(item, need, n, hs.tolist(), ats.tolist()))
        yield b.loc[ok, ["doc_id", "item"]]


def leaked(documents: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, item_id) of documents that hold a passage of an item, each pair once.

    Null, empty and wordless texts hold nothing and are held by nothing. Items
    with equal texts are all listed. Repeated rows count once; a doc_id of
    several texts is held if one of them holds. Documents' shingles pass a
    Bloom filter of the items' where they are made, so only likely ones are
    moved. Pairs come from prefix shingles alone and are made distinct before
    anything else is joined to them, one row per pair from then on. A shingle
    that a third of the documents hold takes part only where an item has no
    rarer ones; the items' side is broadcast if it measures small, and
    otherwise adaptive execution splits such a shingle's rows.
    """
    docs = documents.select("doc_id", "text").where(F.length("text") > 0)
    items = benchmark.select("item_id", "text").distinct()
    known = cut(_items(items, size))
    sizes = sorted({r[0] for r in known.select("k").distinct().collect()}) or [size]
    hits = cut(_hits(docs, sizes, bloom(known)))
    each = hits.select("doc_id", "n_words", F.explode(F.array_distinct("hs")).alias("h"))
    rarity = each.groupBy("h").agg(F.count("*").alias("df"))
    ordered = known.select("item", "h", "need", "n").distinct().join(rarity, "h", "left").fillna(0, ["df"])
    ordered = ordered.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("df", "h")))
    ordered = ordered.withColumn("distinct", F.count("*").over(Window.partitionBy("item")))
    prefix = ordered.where("rank <= distinct - need + 1").select("item", "h", "n")
    pairs = (
        each.join(small(prefix), "h")
        .where(F.col("n_words") >= F.ceil((1 - EDITS) * F.ceil(PART * F.col("n"))) - 1)
        .select("doc_id", "item")
        .distinct()
    )
    pairs = cut(pairs)
    both = F.sort_array(F.collect_list(F.struct("at", "h")))
    whole = known.groupBy("item", "need", "n").agg(both.alias("l")).select("item", "need", "n", F.col("l.h").alias("ih"), F.col("l.at").alias("iat"))
    near = hits.drop("n_words").join(small(pairs), "doc_id").join(small(whole), "item")
    enough = cut(near.mapInPandas(_positional, "doc_id bigint, item bigint").distinct())
    texts = items.where("text is not null").groupBy("text").agg(F.min("item_id").alias("item"))
    item_texts = texts.select("item", F.col("text").alias("item_text"))
    todo = docs.join(small(enough), "doc_id").join(small(item_texts), "item")

    def verify(batches):
        memo: dict[str, list[str]] = {}

        def tokens(text):
            got = memo.get(text)
            if got is None:
                if len(memo) > 1000:
                    memo.clear()
                got = memo[text] = words(text)
            return got

        for b in batches:
            ok = [contains(tokens(i), tokens(t), size) for i, t in zip(b["item_text"], b["text"])]
            yield b.loc[ok, ["doc_id", "item"]]

    found = todo.mapInPandas(verify, "doc_id bigint, item bigint").distinct()
    members = items.join(texts, "text").select("item", "item_id")
    return found.join(small(members), "item").select("doc_id", "item_id").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 9 over all documents and all items."""
    return leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
