"""Share of each document that repeats what it said before.

Four rules mark letters and digits that stand in a paragraph, line, sentence
or phrase which occurred earlier in the same text. What they mark is joined;
a document is rejected when the joint share passes the limit. The rules form a
cascade that stops at the rejection. Each rule's cost and the share of
documents it rejects are measured on a bounded sample, and the rules run in
order of rejection per cost. The order changes the work, never the result: a
document that passes has met all rules.
"""

from __future__ import annotations

import time
import unicodedata

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.words import UNSPACED
from leafmill.session import table

#: Share above which a document is rejected; words, and characters of unspaced scripts, of a phrase.
LIMIT, WORDS, CHARACTERS = 0.3, 4, 10
#: Documents, about, on which cost and selectivity of the rules are estimated, spread over all of them.
SAMPLE = 400

_WORD = regex.compile(r"[\p{L}\p{N}\p{M}]+")
_UNSPACED = regex.compile(rf"[{UNSPACED}]")
_PARAGRAPH_END = regex.compile(r"\n[^\S\n]*(?=\n)")
_SENTENCE_END = regex.compile(r"[.!?…।؟]+(?=[\s\"'”’»)\]]|$)|[。！？．｡]+|\n[^\S\n]*(?=\n)")


class Folded:
    """A text as its letters and digits in one case, with the places where units end."""

    def __init__(self, text: str):
        text = unicodedata.normalize("NFKC", text).casefold().replace("\r\n", "\n").replace("\r", "\n")
        self.text = text
        self.words: list[tuple[int, int, bool]] = []  # span in ``letters``, unspaced
        spans, parts, at = [], [], 0
        for m in _WORD.finditer(text):
            w = m[0]
            spans.append((m.start(), at))
            parts.append(w)
            self.words.append((at, at + len(w), not w.isascii() and _UNSPACED.search(w) is not None))
            at += len(w)
        self.letters = "".join(parts)
        self._spans = spans
        self.marks = bytearray(len(self.letters))
        self.marked = 0

    def units(self, pattern) -> list[tuple[int, int]]:
        """Spans in ``letters`` of what the pattern's matches part."""
        out, k, start, spans = [], 0, 0, self._spans
        for m in pattern.finditer(self.text):
            while k < len(spans) and spans[k][0] < m.end():
                k += 1
            end = spans[k][1] if k < len(spans) else len(self.letters)
            if end > start:
                out.append((start, end))
                start = end
        if start < len(self.letters):
            out.append((start, len(self.letters)))
        return out

    def mark(self, start: int, end: int) -> None:
        new = end - start - self.marks.count(1, start, end)
        if new:
            self.marks[start:end] = b"\1" * (end - start)
            self.marked += new

    def repeat(self, units) -> None:
        """Mark the units that occurred before."""
        seen, letters = set(), self.letters
        for start, end in units:
            key = letters[start:end]
            if key in seen:
                self.mark(start, end)
            else:
                seen.add(key)

    @property
    def share(self) -> float:
        return self.marked / len(self.letters) if self.letters else 0.0


_LINE_END = regex.compile(r"\n")


def _paragraphs(t: Folded) -> None:
    t.repeat(t.units(_PARAGRAPH_END))


def _lines(t: Folded) -> None:
    t.repeat(t.units(_LINE_END))


def _sentences(t: Folded) -> None:
    t.repeat(t.units(_SENTENCE_END))


def _phrases(t: Folded) -> None:
    """Windows of four words, or of ten characters inside unspaced runs, as short as they can be."""
    whole = WORDS * CHARACTERS
    starts, ends, weights = [], [], []
    for start, end, unspaced in t.words:
        if unspaced:
            for k in range(start, end):
                starts.append(k)
                ends.append(k + 1)
                weights.append(WORDS)
        else:
            starts.append(start)
            ends.append(end)
            weights.append(CHARACTERS)
    units, right, held = [], 0, 0
    for left in range(len(starts)):
        while held < whole and right < len(starts):
            held += weights[right]
            right += 1
        if held < whole:
            break
        units.append((starts[left], ends[right - 1]))
        held -= weights[left]
    t.repeat(units)


RULES = {"paragraphs": _paragraphs, "lines": _lines, "sentences": _sentences, "phrases": _phrases}


def share(text: str | None, rules=tuple(RULES), limit: float | None = None) -> float:
    """Share of letters and digits that repeat earlier ones; 0 for null, empty and letterless texts.

    With ``limit`` the cascade stops as soon as the share passes it.
    """
    if not text:
        return 0.0
    folded = Folded(text)
    for rule in rules:
        RULES[rule](folded)
        if limit is not None and folded.share > limit:
            break
    return folded.share


def cascade(docs: DataFrame, key: str, text: str, limit: float = LIMIT, sample: int = SAMPLE) -> tuple[str, ...]:
    """The rules in order of rejections per second on about ``sample`` documents, drawn by a hash of ``key`` from all.

    Texts stay on the executors; four pairs of numbers a task come back.
    """
    total = docs.count()
    if not total:
        return tuple(RULES)
    drawn = F.pmod(F.xxhash64(key, F.lit(10)), F.lit(1_000_000)) < max(1, 1_000_000 * sample // total)

    def run(batches):
        spent, hits = dict.fromkeys(RULES, 0.0), dict.fromkeys(RULES, 0)
        for b in batches:
            for x in b[text]:
                if not x:
                    continue
                for name, rule in RULES.items():
                    folded = Folded(x)
                    began = time.perf_counter()
                    rule(folded)
                    spent[name] += time.perf_counter() - began
                    hits[name] += folded.share > limit
        yield pd.DataFrame({"rule": list(RULES), "spent": list(spent.values()), "hits": list(hits.values())})

    got = docs.where(drawn).select(text).mapInPandas(run, "rule string, spent double, hits bigint")
    total = got.groupBy("rule").agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits")).collect()
    rate = {r["rule"]: (r["hits"] + 0.01) / (r["spent"] + 1e-9) for r in total}
    return tuple(sorted(RULES, key=lambda r: -rate.get(r, 0.0)))


def repeated(docs: DataFrame, key: str, text: str, limit: float | None = None) -> DataFrame:
    """(key, share) of every document; with ``limit`` only those above it, whose share then is a lower bound.

    Null, empty and letterless texts have share 0. Repeated rows stay; other
    columns are dropped. Takes no shuffle.
    """
    rows = docs.select(key, text)
    kind = rows.schema[key].dataType.simpleString()
    rules = tuple(RULES) if limit is None else cascade(rows, key, text, limit)

    def run(batches):
        for b in batches:
            out = pd.DataFrame({key: b[key], "share": [share(x, rules, limit) for x in b[text]]})
            yield out if limit is None else out[out["share"] > limit]

    return rows.mapInPandas(run, f"`{key}` {kind}, share double")


def p10_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, share) of every document by all rules."""
    return repeated(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 10: documents of which more than three tenths repeat earlier text."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return repeated(docs, "doc_id", "text", LIMIT).select("doc_id").distinct()
