"""Sentences of texts in any language, script and line layout.

Statistics are learned without labels of sentences, per language, over all
texts. Log-likelihood ratios give abbreviations (tokens that keep company with
a period), collocations (words that follow numbers with a period) and sentence
starters. Each period is then classified with these, and by how words are
written elsewhere: a word that stands in lower case inside sentences and in
upper case after an abbreviation begins one. Marks of other scripts,
quotations, brackets, lists and blank lines follow rules. The language of a
paragraph is told by the commonest words of the texts of each label.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.session import BROADCAST_BYTES, cut, small, table

#: Least score of an abbreviation, least log-likelihood ratios of a collocation and of a sentence starter.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
#: Least share of an abbreviation's capitalised followers that start sentences for it to end some sentences itself.
SOMETIMES = 0.3
#: Commonest words by which a paragraph's language is told, least share of a label's letters in a script for it to be written in it.
PROFILE, SCRIPT_SHARE = 60, 0.3
#: Keys a training task counts before it passes them on.
HELD = 200_000

_BLANK_LINE = regex.compile(r"(?>\r\n|\n|\r)[^\S\r\n]*(?:(?>\r\n|\n|\r)[^\S\r\n]*)+")
_LINE = regex.compile(r"[^\r\n]+")
_LIST_MARK = regex.compile(r"[^\S\r\n]*(?:([・•‣◦●○▪■])|([*+\-–])[^\S\r\n]+|\(?(\d{1,3}|[A-Za-z](?=\)))([.)])[^\S\r\n]+)(?=\S)")
_UNMARKED = regex.compile(r"[\p{Thai}\p{Lao}]")
_LETTER = regex.compile(r"\p{L}")
_CJK = r"\p{Han}\p{Hiragana}\p{Katakana}ー"
_HARD = "。！？｡؟۔।॥።"
_END = regex.compile(rf"[.!?…．{_HARD}]+")
_CJK_CHAR = regex.compile(rf"[{_CJK}]")
_OPEN = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】", "《": "》"}
_CLOSERS = "”“»›」』)）]】》\"’"
_PAIRED = regex.compile("[\"" + regex.escape("".join(_OPEN) + "”»›」』)）]】》") + "]")
_COMMAS = ",;:،؛、，；：—–-"
#: Particles that carry a Japanese sentence on after a quotation, verbs that name a Chinese speaker.
_PARTICLE = regex.compile(r"\s*(?:と|って|は|が|を|に|の|で|も|へ|や|か)")
_SAYS = regex.compile(r"\s*[^。！？“”「」，；…\n]{0,24}?[说問问道喊叫答]\s*[。！？]")
_TOKEN = regex.compile(r"\S+")
_NOT_BLANK = regex.compile(r"\S")
_STRIP = "“”„«»‹›「」『』()（）[]\"'¿¡*—–-"
_OPENING = regex.compile(f"[{regex.escape(_STRIP)}]*")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """Spans of paragraphs (False) and of single lines of lists (True), in order."""
    out, at = [], 0
    for m in [*_BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        lines = [x.span() for x in _LINE.finditer(text, at, end) if not x[0].isspace()]
        marks = [_LIST_MARK.match(text, a, b) for a, b in lines]
        if lines and all(marks) and _is_list(marks):
            out += [(a, b, True) for a, b in lines]
        elif lines:
            out.append((lines[0][0], lines[-1][1], False))
        at = m.end() if m else end
    return out


def _is_list(marks) -> bool:
    """Signs always make a list; numbers only if they go up, as a wrapped line may start with a number."""
    numbers = [int(m[3]) for m in marks if m[3] and m[3].isdigit()]
    if numbers:
        return len(numbers) == len(marks) and all(b == a + 1 for a, b in zip(numbers, numbers[1:])) and (
            len(numbers) > 1 or marks[0][4] == ")" or numbers[0] == 1
        )
    return True


@lru_cache(maxsize=100_000)
def _type(token: str) -> tuple[str, bool]:
    """(lower-case type without final period, has one); a number's type is ``#``; empty for no word and for codes with digits."""
    token = token.lstrip(_STRIP)
    ends = token.endswith(".") and not token.endswith("..")
    word = token.rstrip(_STRIP + ",;:!?…、。.").lower()
    if word and not word.isalpha() and any(c.isdigit() for c in word):
        # Versions, codes and the like are no abbreviations, however often they end a sentence.
        word = "#" if all(c.isdigit() or c in ".,:-/" for c in word) else ""
    return (word if word == "#" or _LETTER.search(word) else ""), ends


@lru_cache(maxsize=100_000)
def _first_of(token: str) -> str:
    return _first(token)


def _first(token: str) -> str:
    """First letter or digit after opening marks."""
    token = token.lstrip(_STRIP)
    return token[:1]


_SCRIPTS = regex.compile(
    r"(?P<latn>\p{Latin})|(?P<cyrl>\p{Cyrillic})|(?P<arab>\p{Arabic})|(?P<deva>\p{Devanagari})|(?P<grek>\p{Greek})|(?P<hebr>\p{Hebrew})"
    rf"|(?P<cjk>[{_CJK}])|(?P<thai>[\p{{Thai}}\p{{Lao}}])|(?P<other>\p{{L}})"
)


@lru_cache(maxsize=100_000)
def script_of(word: str) -> str | None:
    """Name of the script of a word's first letter; None without letters."""
    m = _SCRIPTS.search(word)
    return m.lastgroup if m else None


def _label(said: str | None) -> str:
    return (said or "").strip().lower()


#: Marks after which a sentence may start.
_FRESH = ".!?…" + _HARD
#: Letters of scripts other than Latin.
_NOT_LATIN = regex.compile(r"[^\P{L}\p{Latin}\p{Common}\p{Inherited}]")


def _foreign(token: str, latin: bool) -> bool:
    """True for a token that teaches nothing about a paragraph's language: Chinese, Japanese, Thai or, in ``latin``, any other script."""
    if token.isascii():
        return False
    return bool(_CJK_CHAR.search(token) or _UNMARKED.search(token) or latin and _NOT_LATIN.search(token))


def _words(batches, text: str, lang: str):
    """Counts of words not in upper case, and letters of each script, by the label of the texts."""
    held: Counter = Counter()

    def out():
        rows = [(*k, n) for k, n in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "script", "word", "n"])

    for batch in batches:
        for body, said in zip(batch[text], batch[lang]):
            key = _label(said)
            if not body or not key:
                continue
            for token, n in Counter(body.split()).items():
                script = script_of(token)
                if script is None:
                    continue
                held[key, script, ""] += n * len(token)
                word = _type(token)[0]
                if word and word != "#" and script not in ("cjk", "thai") and not _first_of(token).isupper():
                    held[key, script, word] += n
            if len(held) > HELD:
                yield out()
    if held:
        yield out()


def _count(batches, text: str, lang: str, known: Model):
    """Counts of events by language: tokens with and without period, cases, followers of periods.

    The language of a paragraph is told by the profiles of ``known``; without profiles there is one key a script.
    """
    held: Counter = Counter()

    def out():
        rows = [(*k, n) for k, n in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["lang", "event", "a", "b", "n"])

    for batch in batches:
        for body, said in zip(batch[text], batch[lang]):
            if not body:
                continue
            for a, b, _ in blocks(body):
                part = body[a:b]
                tokens = part.split()
                key, script = known.told(tokens, said)
                types = [("", False) if _foreign(t, script == "latn") else _type(t) for t in tokens]
                fresh = True  # at a sentence start, as far as one can tell
                for k, (token, (word, ends)) in enumerate(zip(tokens, types)):
                    if word:
                        held[key, "dot" if ends else "no", word, ""] += 1
                        first = _first_of(token)
                        if fresh and k:
                            held[key, "start", word, ""] += 1
                        if first.islower():
                            held[key, "lower", word, ""] += 1
                        elif not fresh and first.isupper():
                            held[key, "upper", word, ""] += 1
                        if ends and k + 1 < len(tokens):
                            follower = types[k + 1][0]
                            if _first_of(tokens[k + 1]).islower():
                                held[key, "low", word, ""] += 1
                            if follower == "#":
                                held[key, "number", word, ""] += 1
                            elif follower and _first_of(tokens[k + 1]).isupper():
                                held[key, "next", word, follower] += 1
                    fresh = token.rstrip(_CLOSERS)[-1:] in _FRESH or token[0] in _STRIP
                if len(held) > HELD:
                    yield out()
    if held:
        yield out()


def _ratio(k: int, n: int, p0: float, p1: float) -> float:
    """-2 log likelihood ratio of k hits in n under p0 against p1."""
    log = lambda p: k * math.log(max(p, 1e-12)) + (n - k) * math.log(max(1 - p, 1e-12))
    return -2 * (log(p0) - log(p1))


@lru_cache(maxsize=100_000)
def _bare(token: str) -> str:
    return token.strip(_STRIP + ".,;:!?").lower()


#: What the model knows of a word in a language.
KINDS = ("abbreviations", "final", "sometimes", "plain", "starters", "ordinary", "collocations", "numbered", "mixed")


class Model:
    """What was learned by language: abbreviations, those that end sentences themselves always or sometimes, plain words
    (after which a period ends a sentence even before a lower-case word), starters, words ordinarily in
    lower case, collocations of numbers, words that always or sometimes go with a number, profiles and the commonest
    language of each script. ``pieces`` has (kind, lang, word) where it is too large to be broadcast."""

    def __init__(self):
        for kind in (*KINDS, "profile"):
            setattr(self, kind, defaultdict(set))
        self.common: dict[str, str] = {}
        self.pieces: DataFrame | None = None
        self._index: tuple[dict, dict] | None = None

    def _profiles(self) -> tuple[dict[str, list[str]], dict[str, set]]:
        """(word -> labels, label -> scripts)."""
        if self._index is None:
            labels, scripts = defaultdict(list), defaultdict(set)
            for label, words in sorted(self.profile.items()):
                for w in words:
                    labels[w].append(label)
                    scripts[label].add(script_of(w))
            self._index = dict(labels), dict(scripts)
        return self._index

    def told(self, tokens: list[str], said: str | None) -> tuple[str, str]:
        """(language key, script) of a paragraph's tokens: the label whose profile most of them are in; on a tie, or if none
        is, what the text is said to be, then the commonest language of the script."""
        labels, scripts = self._profiles()
        said = _label(said)
        hits: Counter = Counter()
        for t in tokens:
            for label in labels.get(_bare(t), ()):
                hits[label] += 1
        script = next((x for x in map(script_of, tokens) if x and x not in ("cjk", "thai")), None) or ""
        if hits:
            top = max(hits, key=lambda k: (hits[k], k == said, k))
            return top, script
        if not scripts:
            return said or script, script
        return said if script in scripts.get(said, ()) else self.common.get(script, script), script

    def language(self, part: str, said: str | None) -> str:
        """Language key of a paragraph."""
        return self.told(part.split(), said)[0]


def learn(df: DataFrame, text: str = "doctext", lang: str = "lang", limit: int = BROADCAST_BYTES) -> Model:
    """The model of all texts; null texts teach nothing.

    Labelled texts give the profiles by which the language of paragraphs is
    told; then all are counted where they are. Abbreviations, starters and
    collocations are decided in Spark, and only the accepted ones come to the
    driver, if they measure under ``limit``; else they stay a table, which
    ``sentences`` joins with the words it needs them for.
    """
    texts = df.select(text, lang).distinct()
    known = _profiles_of(texts, text, lang)
    counts = cut(
        texts.mapInPandas(lambda b: _count(b, text, lang, known), "lang string, event string, a string, b string, n bigint")
        .groupBy("lang", "event", "a", "b")
        .agg(F.sum("n").alias("n"))
    )
    of = lambda e: F.sum(F.when(F.col("event") == e, F.col("n")).otherwise(0)).alias(e)
    types = cut(
        counts.where("event <> 'next'").groupBy("lang", F.col("a").alias("word")).agg(*map(of, ("dot", "no", "lower", "upper", "start", "number", "low")))
    )
    totals = types.groupBy("lang").agg(
        F.sum("dot").alias("dots"), F.sum(F.col("dot") + F.col("no")).alias("all"), F.sum("start").alias("starts"),
        F.sum(F.when(F.col("word") == "#", F.col("dot"))).alias("number_dots"),
        F.sum(F.when(F.col("word") == "#", F.col("dot") + F.col("no"))).alias("numbers"),
    )
    types = types.join(small(totals), "lang").withColumn("total", F.col("dot") + F.col("no"))
    p = F.try_divide("dots", "all")
    ll = -2 * (F.col("dot") * F.log(p / 0.99) + F.col("no") * F.log((1 - p) / 0.01))
    dots = F.length("word") - F.length(F.regexp_replace("word", r"\.", ""))
    letters = F.length("word") - dots + 1
    score = ll * F.exp(-letters) * (dots + 1) * F.pow(letters, -F.col("no"))
    short = types.where("dot > 0 and word <> '#'").where(score >= ABBREVIATION).select("lang", "word")
    # A single letter with a period is an initial or abbreviation whatever its score.
    nexts = counts.where("event = 'next'").select("lang", F.col("a").alias("after"), F.col("b").alias("word"), "n")
    wanted = short.withColumnRenamed("word", "after")
    followed = nexts.join(small(wanted), ["lang", "after"], "left_semi").unionByName(nexts.where(F.length("after") == 1)).distinct()
    followed = cut(
        followed.join(types, ["lang", "word"]).select("lang", "after", "word", "n", _starts().alias("starts"), _ordinary().alias("ordinary"))
    )
    begins = F.col("starts") | F.col("ordinary")
    final = followed.groupBy("lang", "after").agg(F.sum("n").alias("n"), F.sum(F.when(begins, F.col("n")).otherwise(0)).alias("s"))
    # Of the starts that follow no abbreviation a share q are such words, the others names. So an abbreviation with s of them among n capitalised
    # followers ends s / q sentences; it ends one before a name too if more of its names start sentences than don't.
    begun = types.groupBy("lang").agg(F.sum(F.when(_starts() | _ordinary(), F.col("start")).otherwise(0)).alias("b"), F.sum("start").alias("t"))
    begun = begun.join(small(final.groupBy("lang").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"))), "lang")
    q = begun.select("lang", F.try_divide(F.col("b") - F.col("fs"), F.col("t") - F.col("fn")).alias("q"))
    final = final.join(small(q), "lang").withColumn("ends", F.when(F.col("q") > 0, F.least(F.col("n"), F.try_divide("s", "q"))).otherwise(0))
    final = final.where(F.col("ends") >= SOMETIMES * F.col("n"))
    always = F.when(F.col("ends") * (1 - F.col("q")) >= F.col("n") - F.col("ends"), "final").otherwise("sometimes")
    after_number = nexts.where("after = '#'").join(types, ["lang", "word"]).where("lower = 0 and n > 1 and n >= 0.2 * total")
    before_number = types.where("number > 0 and word <> '#' and number >= 0.2 * dot")
    share = F.col("number") >= 0.5 * F.col("dot")
    kind = lambda df, k: df.select(F.lit(k).alias("kind") if isinstance(k, str) else k.alias("kind"), "lang", "word").distinct()
    plain = types.where("low > 0 and word <> '#' and no >= 2 * dot").join(small(short), ["lang", "word"], "left_anti")
    pieces = (
        kind(short, "abbreviations")
        .unionByName(kind(plain, "plain"))
        .unionByName(kind(final.withColumnRenamed("after", "word"), always))
        .unionByName(kind(followed.where("starts"), "starters"))
        .unionByName(kind(followed.where("ordinary"), "ordinary"))
        .unionByName(kind(after_number.where(_more_than("n", "number_dots", F.try_divide("total", "all"))), "collocations"))
        .unionByName(
            kind(before_number.where(_more_than("number", "dot", F.try_divide("numbers", "all"))), F.when(share, "numbered").otherwise("mixed"))
        )
    )
    pieces = cut(pieces)
    size = pieces.select(F.sum(F.octet_length("word") + F.octet_length("lang") + 64)).first()[0] or 0
    if size > limit:
        known.pieces = pieces
        return known
    for r in pieces.collect():
        getattr(known, r["kind"])[r["lang"]].add(r["word"])
    return known


def _profiles_of(texts: DataFrame, text: str, lang: str) -> Model:
    """A model with the profiles of the labels alone: a label has one for each script that it is written in."""
    seen = texts.mapInPandas(lambda b: _words(b, text, lang), "lang string, script string, word string, n bigint")
    seen = cut(seen.groupBy("lang", "script", "word").agg(F.sum("n").alias("n")))
    letters = seen.where("word = ''").select("lang", "script", F.col("n").alias("letters"))
    whole = letters.groupBy("lang").agg(F.sum("letters").alias("whole"))
    own = letters.join(small(whole), "lang").where(F.col("letters") >= SCRIPT_SHARE * F.col("whole"))
    place = F.row_number().over(Window.partitionBy("lang", "script").orderBy(F.desc("n"), "word"))
    top = seen.where("word <> ''").withColumn("place", place).where(F.col("place") <= PROFILE)
    m = Model()
    for r in top.join(small(own), ["lang", "script"]).select("lang", "word").collect():
        m.profile[r["lang"]].add(r["word"])
    for r in own.groupBy("script").agg(F.max_by("lang", F.struct("letters", "lang")).alias("lang")).collect():
        m.common[r["script"]] = r["lang"]
    return m


def _ratio(k: Column, n: Column, p0: Column, p1: Column) -> Column:
    """-2 log likelihood ratio of k hits in n under p0 against p1."""
    log = lambda p: k * F.log(F.greatest(p, F.lit(1e-12))) + (n - k) * F.log(F.greatest(1 - p, F.lit(1e-12)))
    return -2 * (log(p0) - log(p1))


def _more_than(k: str, n: str, p: Column) -> Column:
    """True if k hits in n are more than the share p by a log-likelihood ratio that makes a collocation."""
    k, n = F.col(k), F.col(n)
    own = F.try_divide(k, n)
    return (p > 0) & (p < 1) & (own > p) & (_ratio(k, n, p, own) >= COLLOCATION)


def _starts() -> Column:
    """True for a frequent sentence starter: more often at starts than chance by its log-likelihood ratio, and no name."""
    p, own = F.try_divide("starts", "all"), F.try_divide("start", "total")
    more = (p > 0) & (p < 1) & (own > p) & (_ratio(F.col("start"), F.col("total"), p, own) >= STARTER)
    return F.coalesce(more, F.lit(False)) & (F.col("lower") > 0) & (5 * F.col("lower") >= F.col("lower") + F.col("upper"))


def _ordinary() -> Column:
    """True for a word that is written in lower case inside sentences, so its capital tells a start."""
    return (F.col("lower") >= 2) & (F.col("lower") >= 0.5 * (F.col("lower") + F.col("upper")))


@lru_cache(maxsize=100_000)
def _bare(token: str) -> str:
    return token.strip(_STRIP + ".,;:!?").lower()


class _Paragraph:
    """One paragraph's boundaries."""

    def __init__(self, text: str, a: int, b: int, model: Model, said: str | None):
        self.text, self.a, self.b, self.m = text, a, b, model
        self.lang = model.language(text[a:b], said)

    def enclosed(self) -> list[tuple[int, int]]:
        """Outermost spans of matched quotation marks and brackets.

        ``waiting`` counts the closers that the open marks wait for, so a
        closer that nothing waits for costs no search, in any text.
        """
        text, stack, pairs, waiting = self.text, [], [], Counter()

        def push(i: int, closers: str):
            stack.append((i, closers))
            waiting.update(closers)

        for m in _PAIRED.finditer(text, self.a, self.b):
            i, c = m.start(), m[0]
            if c in _OPEN and not (c == "“" and waiting["“"]):
                push(i, _OPEN[c])
                continue
            if waiting[c]:
                while stack:
                    start, closers = stack.pop()
                    waiting.subtract(closers)
                    if c in closers:
                        pairs.append((start, i))
                        break
            elif c == '"':
                push(i, c)
        out: list[tuple[int, int]] = []
        for p in sorted(pairs):
            if not out or p[0] > out[-1][1]:
                out.append(p)
        return out

    def _word_before(self, at: int) -> str:
        """The token that the period at ``at`` ends, with it."""
        k = at
        while k > self.a and not self.text[k - 1].isspace():
            k -= 1
        return self.text[k : at + 1]

    def _rest(self, at: int) -> int:
        """Where what follows after blanks begins; -1 if nothing does."""
        m = _NOT_BLANK.search(self.text, at, self.b)
        return m.start() if m else -1

    def _first_at(self, at: int) -> str:
        """First character after opening marks from ``at`` on."""
        end = _OPENING.match(self.text, at, self.b).end()
        return self.text[end] if end < self.b else ""

    def _next(self, at: int) -> str:
        m = _TOKEN.search(self.text, at, self.b)
        return m[0] if m else ""

    def abbreviated(self, at: int) -> bool:
        """True if the period at ``at`` ends a known abbreviation or an initial."""
        word, _ = _type(self._word_before(at))
        return word in self.m.abbreviations[self.lang] or (len(word) == 1 and word.isalpha())

    def period(self, at: int) -> bool:
        """True if the single period at ``at``, before a blank, ends a sentence."""
        nxt = self._next(at + 1)
        if not nxt:
            return True
        first = _first(nxt)
        word, _ = _type(self._word_before(at))
        if first.islower() and _first(nxt.lstrip("¿¡")) == first:
            return word in self.m.plain[self.lang]
        follower, _ = _type(nxt)
        if first.isdigit() and word in self.m.numbered[self.lang]:
            return False
        if word == "#":
            return not (follower in self.m.collocations[self.lang] and first.isupper())
        initial = len(word) == 1 and word.isalpha()
        if not initial and word not in self.m.abbreviations[self.lang]:
            return True
        if word in self.m.final[self.lang]:
            return not (first.isdigit() and word in self.m.mixed[self.lang])
        if first.isdigit():
            return word in self.m.sometimes[self.lang] and word not in self.m.mixed[self.lang]
        if not first:
            return False
        if len(follower) == 1 and _type(nxt)[1]:
            # An initial goes on with the name.
            return False
        return follower in self.m.starters[self.lang] or follower in self.m.ordinary[self.lang]

    def ends(self) -> list[int]:
        """Positions after which a sentence ends."""
        text, b = self.text, self.b
        inside = self.enclosed()
        skip = {i: j for i, j in inside}
        out, at = [], self.a
        spans = iter([*inside, (b, b)])
        span = next(spans)
        while at < b:
            m = _END.search(text, at, span[0])
            if m:
                end = m.end()
                while end < b and text[end] in _CLOSERS and end not in skip:
                    end += 1
                if self._mark(m[0], m.start(), end):
                    out.append(end)
                at = end
                while span[1] < at:
                    span = next(spans)
                continue
            if span[0] >= b:
                break
            i, j = span
            at = j + 1
            span = next(spans)
            inner = j - 1
            while inner > i and (text[inner].isspace() or text[inner] in _CLOSERS):
                inner -= 1
            if inner > i and text[inner] in "…．.!?" + _HARD and self._after_quote(i, j, inner):
                out.append(at)
        return out

    def _mark(self, marks: str, start: int, end: int) -> bool:
        text = self.text
        here = text[end] if end < self.b else ""
        rest = self._rest(end)
        if rest < 0:
            return True
        spaced = here.isspace()
        if text[rest] in _COMMAS and not (spaced and text[rest] in "—–-" and self._first_at(rest).isupper()):
            return False
        if any(c in _HARD for c in marks):
            return True
        if "．" in marks:
            return not (text[start - 1 : start].isdigit() and here.isdigit())
        cjk = bool(here) and _CJK_CHAR.match(here) is not None
        before = start > self.a and _CJK_CHAR.match(text[start - 1]) is not None
        if marks.strip(".…") == "" and len(marks) + marks.count("…") * 2 > 1:
            return (spaced or cjk or before or "…" in marks) and not self._first_at(rest).islower()
        if not spaced:
            return (cjk and before) or (cjk and marks != ".")
        if marks == ".":
            return self.period(start)
        return not self._first_at(rest).islower()

    def _after_quote(self, i: int, j: int, inner: int) -> bool:
        """True if a quotation or bracket that closes at ``j``, with an end mark inside, ends the sentence."""
        text = self.text
        rest = self._rest(j + 1)
        if rest < 0:
            return True
        if text[inner] == "." and text[inner - 1] != "." and self.abbreviated(inner):
            return False
        if text[rest] in _COMMAS + ".!?…．" + _HARD or text[rest] in _CLOSERS:
            return False
        if self._first_at(rest).islower() and text[rest] not in "¿¡":
            return False
        if text[i] in "「『" and _PARTICLE.match(text, rest, self.b):
            return False
        if text[i] in "“「『《" and _CJK_CHAR.search(text, i, j) and _SAYS.match(text, rest, self.b):
            return False
        return True


def split(text: str | None, model: Model, lang: str | None = None) -> list[tuple[int, int]]:
    """1-based positions of the first and last character of each sentence; none for null, empty and blank."""
    if not text or text.isspace():
        return []
    out, plain = [], text.isascii()
    for a, b, listed in blocks(text):
        unmarked = 0 if plain else len(_UNMARKED.findall(text, a, b))
        if unmarked and not listed and 2 * unmarked > len(_LETTER.findall(text, a, b)):
            cuts = [m.end() for m in regex.finditer(r"[^\S\r\n]+", text, pos=a, endpos=b)]
        elif listed:
            cuts = []
        else:
            cuts = _Paragraph(text, a, b, model, lang).ends()
        start = a
        for end in (*cuts, b):
            s, e = start, end
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            if e > s:
                out.append((s + 1, e))
            start = end
    return out


def _asked(text: str | None) -> list[str]:
    """Words that the model may be asked about: those with a period and those that follow one."""
    out, before = set(), False
    for token in (text or "").split():
        # A closing mark may stand between the word and the period's end.
        word, _ = _type(token)
        here = "." in token
        if word and (here or before):
            out.add(word)
        if here:
            out.add(_type(token[: token.rindex(".") + 1])[0])
        before = here or before and not word
    return sorted(out - {""})


def sentences(df: DataFrame, key: str, text: str, lang: str, model: Model) -> DataFrame:
    """(key, start_pos, end_pos) of every sentence of distinct rows.

    Null, empty and blank texts give no rows; a null language is told from the
    text. A model travels with the task; its size was measured by ``learn``.
    One that is too large stays a table: the words that a text may ask about
    are joined with it, and each text gets its own small part of the model.
    """
    rows = df.select(key, text, lang).distinct()
    kind = rows.schema[key].dataType.simpleString()
    pieces, model.pieces = model.pieces, None
    shared = df.sparkSession.sparkContext.broadcast(model)
    model.pieces = pieces
    extra = []
    if pieces is not None:
        asked = F.udf(_asked, "array<string>")
        rows = cut(rows.withColumn("_row", F.expr("uuid()")))
        words = rows.select("_row", F.explode(asked(F.col(text))).alias("word")).join(pieces, "word")
        parts = words.groupBy("_row").agg(F.collect_list(F.struct("kind", "lang", "word")).alias("_known"))
        rows, extra = rows.join(parts, "_row", "left").drop("_row"), ["_known"]

    def run(batches):
        whole = shared.value
        for b in batches:
            ids, starts, ends = [], [], []
            for i, t, said, *part in zip(b[key], b[text], b[lang], *[b[c] for c in extra]):
                m = whole
                if extra:
                    m = Model()
                    m.profile, m.common, m._index = whole.profile, whole.common, whole._profiles()
                    for x in part[0] if part[0] is not None else ():
                        getattr(m, x["kind"])[x["lang"]].add(x["word"])
                for s, e in split(t, m, said):
                    ids.append(i)
                    starts.append(s)
                    ends.append(e)
            yield pd.DataFrame({key: ids, "start_pos": starts, "end_pos": ends})

    return rows.mapInPandas(run, f"`{key}` {kind}, start_pos int, end_pos int").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 2 over all texts; the statistics are learned from the same texts."""
    docs = table(spark, sf_dir, "doctexts", "docid", "doctext", "lang")
    return sentences(docs, "docid", "doctext", "lang", learn(docs))
