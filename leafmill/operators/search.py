"""Boolean search: the index narrows, a pattern on the stored sentence verifies.

A search is one plan. The terms of all predicates select postings in one scan;
sentences are grouped once, and each predicate's condition is a column of the
group. Only candidate sentences meet the sentence table. Documents are then
grouped once for the boolean result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.plans.query import Predicate, load_token
from leafmill.session import cut, small


@dataclass
class Index:
    """Tables of an index: postings, sents, docinfo and segments.

    Segments of broken-off runs are left out; repeated rows count once; other
    columns than the known ones are ignored. ``prefix`` selects segments.
    """

    postings: DataFrame
    sents: DataFrame
    docinfo: DataFrame
    segments: DataFrame
    prefix: str = ""

    def live(self) -> DataFrame:
        """(seg, fname) of published segments with the prefix."""
        rows = self.segments.where(F.col("fname").endswith(".cdb"))
        if self.prefix:
            rows = rows.where(F.col("prefix") == self.prefix)
        return rows.select("seg", "fname").distinct()

    def docs(self) -> DataFrame:
        """(seg, fname, doc_id, loc, mtime) of all documents; repeated rows stay, they go after the search."""
        rows = self.docinfo.select("seg", "doc_id", "loc", "mtime")
        return rows.join(small(self.live()), "seg")


def _terms(pred: Predicate) -> Column | None:
    """True where a sentence's set of query terms fulfils the predicate."""
    has = lambda kt: F.array_contains("terms", kt[0] + ":" + kt[1])
    parts = [has(t) for t in pred.every]
    if pred.some:
        parts.append(reduce(lambda a, b: a | b, [has(t) for t in pred.some]))
    if pred.title:
        parts.append(F.col("sent_id") == 0)
    return reduce(lambda a, b: a & b, parts) if parts else None


def narrow(index: Index, preds: list[Predicate]) -> DataFrame:
    """(seg, doc_id, sent_id, p0, p1, ...): sentences that some predicate's terms narrow to."""
    wanted = sorted({t for p in preds for t in p.terms})
    kinds = sorted({k for k, _ in wanted})
    rows = index.postings.select("kind", "term", "seg", "doc_id", "sent_id")
    # Both lists reach the scan as pushed filters; the pairs are checked after.
    rows = rows.where(F.col("kind").isin(kinds) & F.col("term").isin(sorted({t for _, t in wanted})))
    rows = rows.join(small(index.live().select("seg")), "seg", "left_semi")
    pair = F.concat_ws(":", "kind", "term")
    rows = rows.where(pair.isin([f"{k}:{t}" for k, t in wanted]))
    by_sent = rows.groupBy("seg", "doc_id", "sent_id").agg(F.collect_set(pair).alias("terms"))
    flags = [(_terms(p) if p.terms else F.lit(False)).alias(f"p{i}") for i, p in enumerate(preds)]
    out = by_sent.select("seg", "doc_id", "sent_id", *flags)
    return out.where(reduce(lambda a, b: a | b, [F.col(f"p{i}") for i in range(len(preds))]))


def _matches(pred: Predicate) -> Column:
    """True where the sentence carries the predicate's patterns."""
    text = F.col("sent")
    ok = F.lit(True)
    if pred.pattern:
        ok = (text if pred.exact else F.lower(text)).rlike(pred.pattern)
    if pred.start:
        ok = ok & F.lower(text).rlike(pred.start)
    return ok


def search(index: Index, preds: list[Predicate], *, any_of: bool = False, dedupe: bool = False) -> DataFrame:
    """(seg, fname, doc_id, loc, mtime, contexts) of documents that hold the predicates.

    All positive predicates must hold, each in a verified sentence of its own;
    with ``any_of`` one is enough. Negative predicates take out every document
    they narrow to, without verification, in both modes. Without positive
    predicates all documents less the negative ones come out. Without any
    predicate none does. ``contexts`` has each predicate's first sentence,
    distinct and ascending; it is empty for terms that need no sentence.
    A location indexed again comes once per segment, or once with ``dedupe``.
    """
    docs = index.docs()
    if not preds:
        return docs.where(F.lit(False)).withColumn("contexts", F.array().cast("array<int>"))
    used = [p for p in preds if p.terms]
    hits = None
    if used:
        # Written once, so that measuring a side doesn't scan the postings again.
        cand = cut(narrow(index, used))
        needs = [i for i, p in enumerate(used) if not p.neg and (p.pattern or p.start)]
        if needs:
            # Repeated sentences don't matter to what follows, so the table isn't shuffled to remove them.
            sents = index.sents.select("seg", "doc_id", "sent_id", "sent")
            look = reduce(lambda a, b: a | b, [F.col(f"p{i}") for i in needs])
            # Candidates that measure small are broadcast, so the sentence table isn't shuffled.
            found = sents.join(small(cand.where(look)), ["seg", "doc_id", "sent_id"])
            verified = found.select(
                "seg", "doc_id", "sent_id",
                *[(F.col(f"p{i}") & _matches(p) if i in needs else F.lit(False)).alias(f"p{i}") for i, p in enumerate(used)],
            )
            rest = [i for i in range(len(used)) if i not in needs]
            if rest:
                others = cand.select(
                    "seg", "doc_id", "sent_id", *[(F.col(f"p{i}") if i in rest else F.lit(False)).alias(f"p{i}") for i in range(len(used))]
                ).where(reduce(lambda a, b: a | b, [F.col(f"p{i}") for i in rest]))
                verified = verified.unionByName(others)
            cand = verified
        hits = cand.groupBy("seg", "doc_id").agg(
            *[F.bool_or(f"p{i}").alias(f"p{i}") for i in range(len(used))],
            *[F.min(F.when(F.col(f"p{i}"), F.col("sent_id"))).alias(f"s{i}") for i in range(len(used))],
        )
        hits = cut(hits)
    place = {id(p): i for i, p in enumerate(used)}

    def holds(p: Predicate) -> Column:
        return F.coalesce(F.col(f"p{place[id(p)]}"), F.lit(False)) if id(p) in place else F.lit(bool(p.always))

    positive, negative = [p for p in preds if not p.neg], [p for p in preds if p.neg]
    if positive:
        ok = reduce((lambda a, b: a | b) if any_of else (lambda a, b: a & b), [holds(p) for p in positive])
    else:
        ok = F.lit(True)
    for p in negative:
        ok = ok & ~holds(p)
    anchored = positive and all(id(p) in place for p in positive)
    if hits is not None:
        docs = docs.join(small(hits), ["seg", "doc_id"], "inner" if anchored else "left")
    context = [F.col(f"s{place[id(p)]}") for p in positive if id(p) in place]
    contexts = (
        F.array_sort(F.array_distinct(F.array_compact(F.array(*context)))) if context else F.array().cast("array<int>")
    )
    out = docs.where(ok).select("seg", "fname", "doc_id", "loc", "mtime", contexts.alias("contexts"))
    out = out.dropDuplicates(["seg", "doc_id", "loc", "mtime"])
    return newest(out) if dedupe else out


def newest(found: DataFrame) -> DataFrame:
    """Of each location the row of the newest segment, then the greatest doc_id; rows without location stay."""
    top = found.where("loc is not null").groupBy("loc").agg(F.max(F.struct("fname", "doc_id")).alias("top"))
    kept = found.join(top.select("loc", "top.fname", "top.doc_id"), ["loc", "fname", "doc_id"], "left_semi")
    return kept.unionByName(found.where("loc is null"))


def order(found: DataFrame) -> DataFrame:
    """Newest segment first, then the greatest doc_id."""
    return found.orderBy(F.desc("fname"), F.desc("doc_id"))


def page(found: DataFrame, n: int, token: str | None = None) -> DataFrame:
    """The next ``n`` hits after a token; sorting keeps only ``n`` rows a task."""
    if token:
        fname, doc_id, _ = load_token(token)
        found = found.where((F.col("fname") < fname) | ((F.col("fname") == fname) & (F.col("doc_id") < doc_id)))
    return order(found).limit(n)


def between(found: DataFrame, start: tuple[str, int] | None = None, end: tuple[str, int] | None = None) -> DataFrame:
    """Hits from ``start`` to ``end``, both (fname, doc_id) and both included, oldest first."""
    at = F.struct(F.col("fname").alias("a"), F.col("doc_id").cast("bigint").alias("b"))
    edge = lambda x: F.struct(F.lit(x[0]).alias("a"), F.lit(x[1]).cast("bigint").alias("b"))
    if start:
        found = found.where(at >= edge(start))
    if end:
        found = found.where(at <= edge(end))
    return found


def decide(found: DataFrame, rules: list[Column]) -> DataFrame:
    """Hits that document rules let pass: the first rule that isn't 0 decides, positive accepts; none accepts too."""
    verdict = F.coalesce(*[F.nullif(r, F.lit(0)) for r in rules], F.lit(1))
    return found.where(verdict > 0)


def estimate(total: int, searched: int, found: int) -> int:
    """Hits to expect after ``searched`` of ``total`` documents gave ``found``."""
    return found + found * (total - searched) // max(searched, 1)


def highlighted(text: str, patterns: list[str]) -> list[tuple[int, int]]:
    """Ranges of the text that some pattern matches, overlaps joined."""
    edges = []
    for p in patterns:
        for m in re.finditer(p, text):
            if m.end() > m.start():
                edges += [(m.start(), 1), (m.end(), -1)]
    out, depth, start = [], 0, 0
    for at, step in sorted(edges, key=lambda e: (e[0], -e[1])):
        if depth == 0:
            start = at
        depth += step
        if depth == 0:
            out.append((start, at))
    return out


def ranges(*patterns: str):
    """``highlighted`` as a function of a text column: an array of (start, end) for each text; null for null."""

    @F.udf("array<struct<start:int,end:int>>")
    def run(text):
        return None if text is None else highlighted(text, list(patterns))

    return run


def _java_to_python(pattern: str) -> str:
    return pattern.replace(r"[^\p{L}\p{N}_]*", r"\W*")


def snippet(sents: dict[int, str], contexts: list[int], patterns: list[tuple[str, bool]], *, chars: int = 100, around: int = 20, most: int = 3) -> str:
    """Text around the matches, matches in ``<b>``, joined over contexts; plain start of the text without patterns."""
    out, left = [], chars
    for c in contexts or [0]:
        if left < around:
            break
        parts, k = [], c
        while k in sents and k < c + most and sum(map(len, parts)) < chars:
            parts.append(sents[k])
            k += 1
        text = " ".join(parts)
        plain = [_java_to_python(p) if exact else "(?i)" + _java_to_python(p) for p, exact in patterns]
        ranges = highlighted(text, plain)
        if not ranges:
            cut_off = text[:left]
            out.append(cut_off + ("..." if len(text) > left else ""))
            left -= len(cut_off)
            continue
        start = max(0, ranges[0][0] - around)
        piece, at = ("... " if start else ""), start
        for a, b in ranges:
            if a - at > left:
                break
            piece += text[at:a] + "<b>" + text[a:b] + "</b>"
            left -= b - at
            at = b
        tail = text[at : at + around]
        piece += tail + ("..." if at + around < len(text) else "")
        left -= len(tail)
        out.append(piece)
    return " ".join(out)


def with_snippets(index: Index, found: DataFrame, preds: list[Predicate]) -> DataFrame:
    """``found`` with ``title`` (sentence 0) and ``snippet``; for a page of hits or any number of them.

    Each hit meets at most three sentences per context, so groups are small.
    """
    patterns = [(p.pattern, p.exact) for p in preds if not p.neg and p.pattern]
    wanted = F.flatten(
        F.transform(
            F.when(F.size("contexts") > 0, F.col("contexts")).otherwise(F.array(F.lit(0))),
            lambda c: F.sequence(c, c + 2),
        )
    )
    need = found.select("seg", "doc_id", F.explode(F.array_distinct(F.concat(F.array(F.lit(0)), wanted))).alias("sent_id"))
    got = (
        need.join(index.sents.select("seg", "doc_id", "sent_id", "sent"), ["seg", "doc_id", "sent_id"])
        .dropDuplicates(["seg", "doc_id", "sent_id"])
        .groupBy("seg", "doc_id")
        .agg(F.collect_list("sent_id").alias("ids"), F.collect_list("sent").alias("said"))
    )

    def run(batches):
        for b in batches:
            texts = [dict(zip(i, t)) if i is not None else {} for i, t in zip(b["ids"], b["said"])]
            b = b.drop(columns=["ids", "said"])
            b["title"] = [t.get(0) for t in texts]
            b["snippet"] = [snippet(t, list(c), patterns) for t, c in zip(texts, b["contexts"])]
            yield b

    schema = "seg int, doc_id int, fname string, loc string, mtime int, contexts array<int>, title string, snippet string"
    joined = found.select("seg", "doc_id", "fname", "loc", "mtime", "contexts").join(got, ["seg", "doc_id"], "left")
    return joined.mapInPandas(run, schema)
