"""One consistent form for text that looks the same but differs in its characters.

Width and joined forms are folded, invisible characters dropped, accents
decomposed and blanks collapsed. Each token is then resolved by script sets. A
letter has the set of its own script, augmented by the writing systems that use
it (Han, kana, Hangul and Bopomofo are written together), and the set of every
script that has a letter drawn alike. The own sets intersected across the token
tell whether it is mixed; the wider sets intersected tell in which scripts all
of it could be spelled, which makes it a whole-script confusable or gives the
consistent spelling of a mixed token. Where nothing remains, each letter takes
the spelling of the first script it has.

``form`` is the key of comparison: it depends only on the looks, so two texts
that read the same get the same form. ``consistent`` is the text for reading
on: only mixed tokens are respelled, clean text of any language stays.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from leafmill.session import small, table

#: Order in which a script is preferred for a token that several could spell.
SCRIPTS = (
    "Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu", "Hebrew", "Arabic", "Tifinagh", "Malayalam",
    "Myanmar", "Oriya", "Hangul", "Bopomofo", "Katakana", "Hiragana", "Han",
)
#: Writing systems that use letters of several scripts.
AUGMENTED = {
    "Han": ("Hanb", "Jpan", "Kore"), "Hiragana": ("Jpan",), "Katakana": ("Jpan",), "Hangul": ("Kore",), "Bopomofo": ("Hanb",),
}

#: Letters drawn alike. First the scripts, then one group a word in their order.
ALIKE = (
    ("Latin Cyrillic", "aа eе oо pр cс yу xх iі jј sѕ dԁ qԛ wԝ hһ vѵ lӏ yү æӕ ǝә ɵѳ"),
    ("Latin Cyrillic", "AА BВ EЕ KК MМ HН OО PР CС TТ YУ XХ IІ JЈ SЅ QԚ WԜ VѴ YҮ IӀ ÆӔ"),
    ("Latin Greek", "oο vν aα iι pρ uυ yγ ßβ"),
    ("Latin Greek", "AΑ BΒ EΕ ZΖ HΗ IΙ KΚ MΜ NΝ OΟ PΡ TΤ YΥ XΧ CϹ FϜ JͿ"),
    ("Latin Armenian", "oօ nո uս hհ gց qզ OՕ UՍ SՏ LԼ"),
    ("Latin Cherokee", "DᎠ RᎡ TᎢ AᎪ JᎫ EᎬ WᎳ MᎷ HᎻ GᏀ ZᏃ VᏙ SᏚ LᏞ CᏟ PᏢ KᏦ"),
    ("Latin Coptic", "oⲟ pⲣ cⲥ xⲭ OⲞ PⲢ CⲤ KⲔ MⲘ NⲚ TⲦ HⲎ IⲒ XⲬ"),
    ("Latin Lisu", "Aꓮ Bꓐ Cꓚ Dꓓ Eꓰ Fꓝ Gꓖ Hꓧ Iꓲ Jꓙ Kꓗ Lꓡ Mꓟ Nꓠ Oꓳ Pꓑ Rꓣ Sꓢ Tꓔ Uꓴ Vꓦ Wꓪ Xꓫ Yꓬ Zꓜ"),
    ("Latin Hebrew", "oס lו vט"),
    ("Latin Arabic", "oه lا"),
    ("Latin Tifinagh", "Oⵔ lⵏ"),
    ("Latin Malayalam", "oഠ"),
    ("Latin Myanmar", "oဝ"),
    ("Latin Oriya", "Oଠ"),
    ("Cyrillic Greek", "ГΓ ПΠ ФΦ фφ"),
    ("Katakana Han", "ニ二 カ力 ロ口 エ工 ハ八 タ夕 ト卜 チ千 ノ丿 ー一"),
    ("Katakana Hiragana", "ヘへ"),
)


def _classes() -> tuple[dict[str, int], list[dict[str, str]]]:
    """letter -> class, and of each class the spelling by script; chains of pairs are joined."""
    of: dict[str, int] = {}
    spell: list[dict[str, str]] = []
    for scripts, groups in ALIKE:
        for group in groups.split():
            known = [of[c] for c in group if c in of]
            k = known[0] if known else len(spell)
            if not known:
                spell.append({})
            for script, c in zip(scripts.split(), group):
                of[c] = k
                spell[k].setdefault(script, c)
    return of, spell


CLASS, SPELL = _classes()
_EAST = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Bopomofo}ー"
_WEST = "".join(rf"\p{{{s}}}" for s in SCRIPTS[:13])
_TOKEN = regex.compile(rf"[{_WEST}\p{{M}}]+|[{_EAST}\p{{M}}]+")
_ODD = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{Armenian}\p{Cherokee}" + "".join(c for c in CLASS if c > "\x7f") + "]")
_UNSEEN = regex.compile(r"[[\p{DI}\p{Cf}\p{Cc}]--[\p{Prepended_Concatenation_Mark}\s\x1c-\x1f]]+", regex.V1)
_OF_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}


def _folds() -> dict[int, str]:
    """Characters that are another width or a joined form of others, by Unicode's decompositions."""
    tags = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<square>"}
    out = {}
    for i in range(0x80, sys.maxunicode + 1):
        way = unicodedata.decomposition(chr(i))
        if not way.startswith("<"):
            continue
        tag, _, to = way.partition(" ")
        name = unicodedata.name(chr(i), "")
        if tag in tags or tag == "<compat>" and ("LIGATURE" in name or 0x132 <= i <= 0x1F3):
            out[i] = "".join(chr(int(x, 16)) for x in to.split())
    out[0x1C4], out[0x1C5], out[0x1C6] = "DŽ", "Dž", "dž"
    return out


FOLDS = _folds()
_VOICED = regex.compile(r"(?<=[\p{Hiragana}\p{Katakana}])[゛゜]")


@lru_cache(maxsize=100_000)
def own_scripts(letter: str) -> frozenset[str]:
    """Script of a letter and the writing systems that use it; empty for marks and other characters."""
    if unicodedata.category(letter)[0] == "M":
        return frozenset()
    own = next((s for s, p in _OF_SCRIPT.items() if p.match(letter)), "Katakana" if letter == "ー" else None)
    return frozenset((own, *AUGMENTED.get(own, ()))) if own else frozenset()


@lru_cache(maxsize=100_000)
def scripts_of(letter: str) -> frozenset[str]:
    """Scripts and writing systems in which a letter has a spelling."""
    k = CLASS.get(letter)
    if k is None:
        return own_scripts(letter)
    return frozenset(x for s in SPELL[k] for x in (s, *AUGMENTED.get(s, ())))


def resolved(token: str) -> tuple[frozenset | None, frozenset | None]:
    """Script sets of a token, intersected over its letters: as it stands, and with look-alikes; None without letters."""
    own = could = None
    for c in token:
        mine = own_scripts(c)
        if mine:
            own = mine if own is None else own & mine
            could = scripts_of(c) if could is None else could & scripts_of(c)
    return own, could


#: Classes of ideographs that are numbers, and of the long mark, which no word begins with.
_NUMBERS = {CLASS[c] for c in "二八千一"}
_LONG = CLASS["ー"]


def _kana(token: str, at: int, near: list[str | None]) -> bool:
    """True if the ambiguous letter at ``at`` reads as Katakana, by the letters around it that can be one script only."""
    left = next((x for x in reversed(near[:at]) if x), None)
    right = next((x for x in near[at + 1 :] if x), None)
    k = CLASS[token[at]]
    if k == _LONG and at == 0:
        return False
    if left is None and right is None:
        classes = [CLASS[c] for c in token if c in CLASS]
        return len(classes) > 1 and CLASS[token[0]] != _LONG and not _NUMBERS.issuperset(classes)
    if "Katakana" not in (left, right):
        return False
    if left == "Katakana" and right == "Han" and k in _NUMBERS and k != _LONG:
        return False
    return left in ("Katakana", None) or right == "Katakana" and k != _LONG


def _spell_east(token: str) -> str:
    """Ambiguous letters of a token in kana, Han and Hangul, which are written together, spelled by their neighbours."""
    near = [None if c in CLASS else next((s for s in SCRIPTS if s in own_scripts(c)), None) for c in token]
    out = []
    for at, c in enumerate(token):
        if c in CLASS:
            ways = SPELL[CLASS[c]]
            c = ways["Katakana"] if _kana(token, at, near) else ways.get("Han") or ways["Hiragana"]
        out.append(c)
    return "".join(out)


@lru_cache(maxsize=100_000)
def _spell(token: str) -> str:
    """The token in the one script that can spell all of it, else letter by letter; depends on its looks only."""
    if token.isascii():
        return token
    _, could = resolved(token)
    if could and not could.isdisjoint(("Jpan", "Hanb", "Kore")):
        return _spell_east(token)
    pick = next((s for s in SCRIPTS if could and s in could), None)
    out = []
    for c in token:
        k = CLASS.get(c)
        if k is not None:
            ways = SPELL[k]
            c = ways[pick] if pick else next(ways[s] for s in SCRIPTS if s in ways)
        out.append(c)
    return "".join(out)


def _kind(token: str) -> str:
    """``mixed`` if a token joins scripts it needn't, ``whole`` if a token of one script could be another's, else ``plain``."""
    own, could = resolved(token)
    if own is not None and not own and could:
        return "mixed"
    return "whole" if own and could and own != could and "Latin" not in own and not token.isascii() else "plain"


#: As FOLDS, without the full-width marks that belong to texts in Han, kana and Hangul.
_FOLDS_EAST = {k: v for k, v in FOLDS.items() if not 0xFF01 <= k <= 0xFF5E or v.isalnum()}
_IS_EAST = regex.compile(rf"[{_EAST}]")


def _prepared(text: str, folds: dict[int, str] = FOLDS) -> str:
    text = _UNSEEN.sub("", text.translate(folds))
    text = _VOICED.sub(lambda m: "゙" if m[0] == "゛" else "゚", text)
    return unicodedata.normalize("NFD", text)


def form(text: str | None) -> str | None:
    """The consistent form of a text: two texts read the same exactly if their forms are equal.

    Null stays null; empty, blank and invisible texts give the empty string.
    Letter case, punctuation, accents and other letters are kept.
    """
    if text is None:
        return None
    if not text.isascii():
        text = _prepared(text)
        if _ODD.search(text):
            text = _TOKEN.sub(lambda m: _spell(m[0]), text)
    else:
        text = _UNSEEN.sub("", text)
    return " ".join(text.split())


def consistent(text: str | None) -> str | None:
    """A text in one form for reading on: width, joined forms, blanks and accents normalised, mixed tokens respelled.

    A token of one writing system stays as it is, whatever it could be mistaken
    for. Null stays null.
    """
    if text is None:
        return None
    if text.isascii():
        return " ".join(_UNSEEN.sub("", text).split())
    text = _prepared(text, _FOLDS_EAST if _IS_EAST.search(text) else FOLDS)
    if _ODD.search(text):
        text = _TOKEN.sub(lambda m: _spell(m[0]) if _kind(m[0]) == "mixed" else m[0], text)
    return unicodedata.normalize("NFC", " ".join(text.split()))


def tangle(text: str | None) -> str:
    """``mixed`` if some token joins scripts it needn't, ``whole`` if one could be of another script, else ``plain``."""
    kinds = {_kind(m[0]) for m in _TOKEN.finditer(_prepared(text or ""))}
    return next((k for k in ("mixed", "whole") if k in kinds), "plain")


@F.pandas_udf(StringType())
def form_udf(text: pd.Series) -> pd.Series:
    """``form`` as a column function."""
    return text.map(form, na_action="ignore")


@F.pandas_udf(StringType())
def consistent_udf(text: pd.Series) -> pd.Series:
    """``consistent`` as a column function."""
    return text.map(consistent, na_action="ignore")


@F.pandas_udf(StringType())
def tangle_udf(text: pd.Series) -> pd.Series:
    """``tangle`` as a column function; null counts as plain."""
    return text.map(tangle)


def read_alike(queries: DataFrame, sents: DataFrame) -> DataFrame:
    """(query_id, seg, doc_id, sent_id) of pairs that read the same but aren't the same string.

    Null, empty and blank queries and sentences are no case. Repeated rows
    give one row. The queries are broadcast if they measure small, else both
    sides shuffle by form; either way it is an equi-join.
    """
    q = queries.select("query_id", "q").where(F.col("q").isNotNull()).distinct()
    q = q.withColumn("form", form_udf("q")).where(F.col("form") != "")
    s = sents.select("seg", "doc_id", "sent_id", "sent").where(F.col("sent").isNotNull())
    s = s.withColumn("form", form_udf("sent"))
    return (
        s.join(small(q), "form")
        .where(F.col("q") != F.col("sent"))
        .select("query_id", "seg", "doc_id", "sent_id")
        .distinct()
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 1 over all queries and all sentences."""
    return read_alike(table(spark, sf_dir, "queries"), table(spark, sf_dir, "sents"))


def p1_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, form, tangle) of every query with a form."""
    q = table(spark, sf_dir, "queries", "query_id", "q").distinct()
    return q.select("query_id", form_udf("q").alias("form"), tangle_udf("q").alias("tangle")).where("form <> ''")


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seg, doc_id, sent_id, sent, clean) of every stored sentence that isn't in consistent form."""
    s = table(spark, sf_dir, "sents", "seg", "doc_id", "sent_id", "sent").where("sent is not null").distinct()
    return s.withColumn("clean", consistent_udf("sent")).where("clean <> sent")
