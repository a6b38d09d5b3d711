"""The query language: strings to predicates, predicates to conditions on the index."""

from __future__ import annotations

import base64
import re
import struct
from dataclasses import dataclass, field, replace

GAP = r"[^\p{L}\p{N}_]*"
_UNSPACED = re.compile("[぀-ヺー-ヿ㐀-䶿一-鿿]+")
_WORD = re.compile(r"[^\W]+")
_TERM = re.compile(r'"[^"]+"|\S+')
_DATE = re.compile(r"^(\d{4})(?:[/-](\d{1,2})(?:[/-](\d{1,2}))?)?$")
#: Mail headers that a query may name, and names that stand for several.
HEADERS = {"subject": ("subject",), "from": ("from",), "to": ("to",), "cc": ("cc",), "rcpt": ("to", "cc"), "addr": ("from", "to", "cc")}
#: Terms of a query that count.
MOST_TERMS = 10


@dataclass(frozen=True)
class Predicate:
    """One condition: index terms that narrow, and a pattern that verifies the sentence.

    ``every`` must all stand in one sentence, and at least one of ``some`` if
    there are any. ``pattern`` is matched on the lower-cased sentence, unless
    ``exact``. ``start`` must match too; it fixes the header of a mail
    sentence. Negative predicates only narrow.
    """

    every: tuple[tuple[str, str], ...] = ()
    some: tuple[tuple[str, str], ...] = ()
    neg: bool = False
    title: bool = False
    pattern: str | None = None
    exact: bool = False
    start: str | None = None
    always: bool | None = None
    text: str = field(default="", compare=False)

    @property
    def terms(self) -> tuple[tuple[str, str], ...]:
        return (*self.every, *self.some)


ALL, NONE = Predicate(always=True), Predicate(always=False)


def terms_of(text: str) -> tuple[tuple[str, str], ...]:
    """(kind, term) of a keyword: words, and pairs of neighbours in unspaced runs."""
    text = _narrow(text)
    out = [("word", w) for w in _WORD.findall(_UNSPACED.sub(" ", text.lower()))]
    for run in _UNSPACED.findall(text):
        out += [("gram", run[i : i + 2]) for i in range(max(1, len(run) - 1))]
    return tuple(dict.fromkeys(out))


def _narrow(text: str) -> str:
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else " " if c == "　" else c for c in text)


def _quoted(c: str) -> str:
    return c if c.isalnum() or c == "_" or ord(c) > 127 else "\\" + c


def keyword_pattern(text: str) -> str:
    """Significant characters in order with anything that is no letter between."""
    return GAP.join(_quoted(c) for c in _narrow(text).lower() if c.isalnum() or c == "_")


def strict_pattern(text: str) -> str:
    """All characters in order, case and signs included, with blanks between."""
    return r"\s*".join(_quoted(c) for c in _narrow(text) if not c.isspace())


def keyword(text: str, *, neg: bool = False, title: bool = False, strict: bool = False) -> Predicate:
    """Keyword or phrase; one without any letter or digit never holds."""
    every = terms_of(text)
    if not every:
        return replace(NONE, neg=neg, text=text)
    signs = strict and re.search(r"[^\w\s|]", text)
    pattern = strict_pattern(text) if signs else keyword_pattern(text)
    return Predicate(every, neg=neg, title=title, pattern=pattern, exact=bool(signs), text=text)


def dates(text: str, *, neg: bool = False) -> Predicate:
    """Any of comma-separated dates: a year, month or day; others are left out."""
    some = []
    for d in text.split(","):
        if m := _DATE.match(d.strip()):
            y, mo, da = m.groups()
            some.append(("date", y + (f"/{int(mo):02d}" if mo else "") + (f"/{int(da):02d}" if da else "")))
    return Predicate(some=tuple(some), neg=neg, text=text) if some else replace(NONE, neg=neg)


def feature(kind: str, values, *, neg: bool = False) -> Predicate:
    """Any of the raw terms of a kind, such as labels."""
    some = tuple((kind, v) for v in values)
    return Predicate(some=some, neg=neg) if some else replace(NONE, neg=neg)


def header(name: str, text: str, *, neg: bool = False, strict: bool = False) -> Predicate:
    """Keyword in a mail header's sentence; unlike a loose check, the keyword is verified as well."""
    found = keyword(text, neg=neg, strict=strict)
    return found if found.always is False else replace(found, start="^(?:" + "|".join(HEADERS[name]) + "):")


def message(text: str, *, refer: bool = False, neg: bool = False) -> Predicate:
    """Messages that are the first ``<id>`` of the text, with ``refer`` also those that refer to it."""
    m = re.search(r"<([^>]+)>", text)
    if not m:
        return replace(NONE, neg=neg)
    kinds = ("msgid", "reply", "ref") if refer else ("msgid",)
    return Predicate(some=tuple((k, m[1]) for k in kinds), neg=neg)


def reading(text: str, *, neg: bool = False) -> Predicate:
    """Reading in kana: all pairs of neighbours in one sentence."""
    pairs = tuple(("yomi", text[i : i + 2]) for i in range(max(1, len(text) - 1))) if text else ()
    return Predicate(tuple(dict.fromkeys(pairs)), neg=neg) if pairs else replace(NONE, neg=neg)


#: Latin spellings of morae, longest first.
MORAE = dict(
    x.split("=")
    for x in (
        "kya=きゃ kyu=きゅ kyo=きょ sha=しゃ shu=しゅ sho=しょ cha=ちゃ chu=ちゅ cho=ちょ nya=にゃ nyu=にゅ nyo=にょ hya=ひゃ hyu=ひゅ"
        " hyo=ひょ mya=みゃ myu=みゅ myo=みょ rya=りゃ ryu=りゅ ryo=りょ gya=ぎゃ gyu=ぎゅ gyo=ぎょ ja=じゃ ju=じゅ jo=じょ bya=びゃ"
        " byu=びゅ byo=びょ pya=ぴゃ pyu=ぴゅ pyo=ぴょ shi=し chi=ち tsu=つ ka=か ki=き ku=く ke=け ko=こ sa=さ su=す se=せ so=そ ta=た"
        " te=て to=と na=な ni=に nu=ぬ ne=ね no=の ha=は hi=ひ fu=ふ he=へ ho=ほ ma=ま mi=み mu=む me=め mo=も ya=や yu=ゆ yo=よ"
        " ra=ら ri=り ru=る re=れ ro=ろ wa=わ wo=を ga=が gi=ぎ gu=ぐ ge=げ go=ご za=ざ ji=じ zu=ず ze=ぜ zo=ぞ da=だ de=で do=ど"
        " ba=ば bi=び bu=ぶ be=べ bo=ぼ pa=ぱ pi=ぴ pu=ぷ pe=ぺ po=ぽ a=あ i=い u=う e=え o=お n=ん"
    ).split()
)


def kana(text: str) -> str | None:
    """Reading that a Latin or kana string spells; None if it can't be one."""
    out, i, text = [], 0, text.lower()
    while i < len(text):
        c = text[i]
        if "ァ" <= c <= "ヶ":
            c = chr(ord(c) - 0x60)
        if "ぁ" <= c <= "ゖ" or c == "ー":
            out.append(c)
            i += 1
            continue
        if i + 1 < len(text) and c == text[i + 1] and c in "kstpgzdbcj":
            out.append("っ")
            i += 1
            continue
        size = next((k for k in (3, 2, 1) if text[i : i + k] in MORAE and len(text[i : i + k]) == k), 0)
        if not size:
            return None
        out.append(MORAE[text[i : i + size]])
        i += size
    return "".join(out) or None


def _hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


def reading_pairs(text: str | None, known: dict[str, list[str]]) -> list[str]:
    """Pairs of morae that a text may be read with: inside readings, and from one to those that may follow it; none for null.

    ``known`` has the readings of words; a kana reads as it stands.
    """
    if not text:
        return []
    sizes = sorted({len(w) for w in known})
    text = _hiragana(text)
    spans: list[list[tuple[int, str]]] = []
    for i, c in enumerate(text):
        here = [(i + 1, c)] if "ぁ" <= c <= "ゖ" or c == "ー" else []
        spans.append(here + [(i + n, _hiragana(r)) for n in sizes for r in known.get(text[i : i + n], ()) if i + n <= len(text)])
    out = set()
    for here in spans:
        for end, r in here:
            out.update(r[k : k + 2] for k in range(len(r) - 1))
            for _, after in spans[end] if end < len(text) else ():
                out.add(r[-1] + after[0])
    return sorted(out)


def parse(query: str, *, strict: bool = False, most: int = MOST_TERMS) -> list[Predicate]:
    """Predicates of a query string: words, ``"phrases"``, ``-`` or ``!`` negation, ``title:``, ``date:``,
    ``label:``, mail headers, ``message-id:`` and ``references:``; terms beyond ``most`` don't count.
    """
    out = []
    for term in _TERM.findall(query or "")[:most]:
        neg = term[:1] in "-!" and len(term) > 1
        body = (term[1:] if neg else term).strip('"')
        name, colon, rest = body.partition(":")
        name = name.lower()
        if not colon or not rest:
            out.append(keyword(body, neg=neg, strict=strict))
        elif name == "title":
            out.append(keyword(rest, neg=neg, title=True, strict=strict))
        elif name == "date":
            out.append(dates(rest, neg=neg))
        elif name == "label":
            out.append(feature("label", rest.split(","), neg=neg))
        elif name in HEADERS:
            out.append(header(name, rest, neg=neg, strict=strict))
        elif name in ("message-id", "references"):
            out.append(message(rest, refer=name == "references", neg=neg))
        else:
            out.append(keyword(body, neg=neg, strict=strict))
    return out


def parse_readings(query: str, *, strict: bool = False, most: int = MOST_TERMS) -> tuple[bool, list[Predicate]]:
    """(any_of, predicates) of a query over an index with readings.

    If every term can be read, a single Latin one is searched as keyword or
    reading, and any others as readings; else it is an ordinary query.
    """
    terms = [t.strip('"') for t in _TERM.findall(query or "")[:most]]
    read = [kana(t) if t and t[:1] not in "-!" else None for t in terms]
    if terms and all(read):
        if len(terms) == 1 and terms[0].isascii():
            return True, [keyword(terms[0], strict=strict), reading(read[0])]
        return False, [reading(r) for r in read]
    return False, parse(query, strict=strict, most=most)


def save_token(fname: str, doc_id: int, found: int) -> str:
    """Where a listing stopped, as text that can be handed out."""
    name = fname.encode()
    return base64.urlsafe_b64encode(struct.pack(">qqH", doc_id, found, len(name)) + name).decode()


def load_token(token: str) -> tuple[str, int, int]:
    """(segment file, doc_id, documents found so far)."""
    data = base64.urlsafe_b64decode(token.encode())
    doc_id, found, n = struct.unpack(">qqH", data[:18])
    return data[18 : 18 + n].decode(), doc_id, found
