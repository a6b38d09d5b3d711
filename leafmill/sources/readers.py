"""Documents of several types to sentences, features and sub-documents."""

from __future__ import annotations

import email
import email.header
import email.utils
from html.entities import name2codepoint

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from leafmill.functions.text import date_terms
from leafmill.operators.index import line_sents, number_sents, plain_sents

#: Tags that part blocks, elements whose content is dropped, headers that become sentences.
BLOCK = frozenset("br p div li dd dt td th h1 h2 h3 h4 h5 h6 title pre blockquote address".split())
DROPPED = frozenset("script style".split())
MAIL_HEADERS = ("from", "subject", "to", "cc", "bcc", "date")
#: Bytes of a mail that the original tool parses.
MAIL_BYTES = 1_000_000

# A comment ends at the first ->; a < inside a tag ends it; a CDATA section is text.
_HTML = regex.compile(
    r"<!--.*?(?:->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^<>]*>?|<(/?)([A-Za-z][\w:.-]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>?"
    r"|<(/?)([A-Za-z][\w:.-]*)([^<>]*)>?",
    regex.S,
)
_ENTITY = regex.compile(r"&(?:#(\d+)|#[xX]([0-9A-Fa-f]+)|([A-Za-z]\w*));?")
_ALT = regex.compile(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", regex.I)


def _entity(m) -> str:
    number = int(m[1]) if m[1] else int(m[2], 16) if m[2] else name2codepoint.get(m[3].lower())
    if number is None or not 0 < number < 0x110000 or 0xD800 <= number < 0xE000:
        return m[0]
    return chr(number)


def entities(text: str) -> str:
    """Character references resolved; names in any case, the semicolon may lack, unknown ones stay."""
    return _ENTITY.sub(_entity, text)


def html_blocks(text: str) -> list[str]:
    """Blocks of text as block tags part them, empty ones included; inside ``pre`` a line break parts too."""
    out: list[str] = []
    held: list[str] = []
    at, dropped, pre = 0, None, 0

    def add(part: str):
        if dropped or not part:
            return
        part = entities(part)
        while pre and "\n" in part:
            line, _, part = part.partition("\n")
            held.append(line + "\n")
            flush()
        held.append(part)

    def flush():
        out.append("".join(held))
        held.clear()

    for m in _HTML.finditer(text):
        add(text[at : m.start()])
        at = m.end()
        if m[1] is not None:
            held.append(m[1])
            continue
        tag = (m[3] or m[6] or "").lower()
        end = bool(m[2] or m[5])
        if dropped:
            if end and tag == dropped:
                dropped = None
            continue
        if tag in DROPPED and not end:
            dropped = tag
        elif tag == "img" and not end:
            alt = _ALT.search(m[4] or m[7] or "")
            if alt:
                held.append("[" + entities(alt[1] or alt[2] or alt[3] or "") + "]")
        elif tag in BLOCK:
            flush()
            if tag == "pre":
                pre = max(0, pre + (-1 if end else 1))
    add(text[at:])
    flush()
    return out


@F.pandas_udf(ArrayType(StringType()))
def html_sents(text: pd.Series) -> pd.Series:
    """Blocks of a page as a column; null stays null."""
    return text.map(html_blocks, na_action="ignore")


@F.pandas_udf(StringType())
def decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes as text under a declared encoding; null is UTF-8, an unknown name latin1, bad bytes are replaced."""

    def one(data, name):
        if data is None:
            return None
        try:
            return bytes(data).decode("utf-8" if name is None else name, "replace")
        except (LookupError, ValueError):
            return bytes(data).decode("latin-1")

    return pd.Series([one(c, e) for c, e in zip(content, encoding)], dtype=object)


def _header(value) -> str:
    """A header with its encoded words decoded; unknown charsets count as latin1, bad bytes are left out."""
    out = []
    for part, charset in email.header.decode_header(str(value)):
        if isinstance(part, str):
            out.append(part)
            continue
        try:
            out.append(part.decode(charset or "latin-1", "ignore"))
        except LookupError:
            out.append(part.decode("latin-1", "ignore"))
    return " ".join("".join(out).split())


def _body(part) -> str:
    data = part.get_payload(decode=True)
    if data is None:
        return ""
    charset = part.get_content_charset() or "utf-8"
    try:
        return data.decode(charset, "replace")
    except LookupError:
        return data.decode("latin-1")


def _parsed(text: str, most: int | None):
    return email.message_from_bytes(text.encode("utf-8", "surrogateescape")[:most])



def _get(message, name: str) -> str | None:
    for k, v in message.raw_items():
        if k.lower() == name:
            text = v.encode("utf-8", "surrogateescape").decode("utf-8", "replace") if isinstance(v, str) else str(v)
            return _header(text)
    return None


def mail(text: str | None, most: int | None = None) -> dict | None:
    """Headers, ids and parts of a mail; None for null.

    A multipart mail keeps no text of its own: its text, HTML and message
    leaves are parts from 1 on. Other mails have their body as part 0. A date
    that can't be read is 0. With ``most`` only so many bytes are parsed, as
    the original tool does at ``MAIL_BYTES``.
    """
    if text is None:
        return None
    m = _parsed(text, most)
    date = 0
    if (d := _get(m, "date")) is not None:
        try:
            when = email.utils.parsedate_tz(d)
            date = int(email.utils.mktime_tz(when)) if when else 0
        except (ValueError, OverflowError, TypeError):
            date = 0
    ids = lambda name: regex.findall(r"<([^<>]+)>", _get(m, name) or "")
    parts = []
    if m.is_multipart():
        for leaf in m.walk():
            kind = leaf.get_content_type()
            if kind in ("text/plain", "text/html"):
                parts.append((len(parts) + 1, kind, _body(leaf)))
            elif leaf is not m and kind.startswith("message/"):
                inner = leaf.get_payload()
                parts.append((len(parts) + 1, kind, str(inner[0]) if isinstance(inner, list) and inner else str(inner)))
    else:
        parts.append((0, m.get_content_type(), _body(m)))
    return {
        "title": _get(m, "subject"),
        "date": date,
        "headers": [f"{h.capitalize()}: {v}" for h in MAIL_HEADERS if (v := _get(m, h))],
        "msgid": ids("message-id")[:1],
        "reply": ids("in-reply-to"),
        "ref": ids("references"),
        "parts": parts,
    }


def _mails(df: DataFrame, key: str, text: str, schema: str, rows_of) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = [(k, *r) for k, t in zip(b[key], b[text]) if t is not None for r in rows_of(mail(t))]
            yield pd.DataFrame(out, columns=[key, *[c.split()[0] for c in schema.split(", ")]])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, {schema}")


def mail_headers(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, place, header): header sentences ``Name: value`` of each mail in fixed order."""
    return _mails(df, key, text, "place int, header string", lambda m: list(enumerate(m["headers"])))


def mail_info(df: DataFrame, key: str, text: str, mtime: str) -> DataFrame:
    """(key, title, mtime): Subject, and the Date header as epoch, else the given mtime."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            got = [mail(t) for t in b[text]]
            yield pd.DataFrame({
                key: b[key],
                "title": [m and m["title"] for m in got],
                "mtime": [(m and m["date"]) or (0 if pd.isna(old) else int(old)) for m, old in zip(got, b[mtime])],
            })

    return df.select(key, text, mtime).mapInPandas(run, f"`{key}` {kind}, title string, mtime bigint")


def mail_features(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, term): the mail's own id and the ids it replies and refers to."""
    return _mails(
        df, key, text, "kind string, term string",
        lambda m: dict.fromkeys((k, t) for k in ("msgid", "reply", "ref") for t in m[k]),
    )


def mail_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, kind, text): the body as part 0, or the leaves of a multipart mail from 1 on."""
    return _mails(df, key, text, "part int, kind string, text string", lambda m: m["parts"])


def sents_of(df: DataFrame, keys: list[str], text: str, doctype: str, title: str | None = None, most: int | None = None) -> DataFrame:
    """(keys, sent_id, sent) of documents by type: T plain, C lines, H blocks of HTML, E mail headers then body.

    An unknown type reads as plain text. Python runs over pages and mails only.
    """
    t = F.upper(F.coalesce(F.col(doctype), F.lit("T")))
    rest = df.where(~t.isin("H", "E"))
    cut_text = F.when(t == "C", line_sents(F.col(text))).otherwise(plain_sents(F.col(text)))
    head = F.col(title) if title else None
    out = number_sents(rest, keys, cut_text, head, most)
    pages = df.where(t == "H")
    out = out.unionByName(number_sents(pages, keys, html_sents(F.col(text)), head, most))
    mails = df.where(t == "E").withColumn("_s", _mail_sents(F.col(text)))
    return out.unionByName(number_sents(mails, keys, F.flatten(F.transform("_s", plain_sents)), most=most))


def with_leaves(df: DataFrame, text: str, doctype: str) -> DataFrame:
    """The rows with a column ``part``, 0; each text leaf of a multipart mail is a row more, of type T or H, with its part."""
    rest = [c for c in df.columns if c not in (text, doctype)]
    mails = df.where(F.upper(doctype) == "E").select(*rest, F.explode(_leaves(F.col(text))).alias("_leaf"))
    leaves = mails.select(*rest, "_leaf.part", F.col("_leaf.kind").alias(doctype), F.col("_leaf.body").alias(text))
    return df.withColumn("part", F.lit(0)).unionByName(leaves)


@F.udf(ArrayType(StructType([StructField("part", IntegerType()), StructField("kind", StringType()), StructField("body", StringType())])))
def _leaves(text: str | None):
    kinds = {"text/plain": "T", "text/html": "H"}
    return [(n, kinds[kind], body) for n, kind, body in (mail(text) or {"parts": []})["parts"] if n and kind in kinds]


@F.udf(ArrayType(StructType([StructField("kind", StringType()), StructField("term", StringType())])))
def mail_ids(text: str | None):
    """(kind, term): a mail's own id and those it replies and refers to, each once; none for null."""
    m = mail(text) or {}
    return list(dict.fromkeys((k, t) for k in ("msgid", "reply", "ref") for t in m.get(k, ())))


@F.pandas_udf(ArrayType(StringType()))
def _mail_sents(text: pd.Series) -> pd.Series:
    def one(t):
        m = mail(t)
        title = [m["title"]] if m["title"] else []
        return title + m["headers"] + [p[2] for p in m["parts"] if p[0] == 0]

    return text.map(one, na_action="ignore")


#: Readers by document type; a dummy has dates but no sentences.
DOCTYPES = {
    "T": plain_sents, "plaintext": plain_sents, "C": line_sents, "sourcecode": line_sents,
    "H": html_sents, "html": html_sents, "E": _mail_sents, "email": _mail_sents,
    "dummy": lambda text: F.array().cast("array<string>"),
}


def doctype(name: str):
    """The reader of a document type, as a function of a text column."""
    try:
        return DOCTYPES[name] if name in DOCTYPES else DOCTYPES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown document type {name!r}") from None


def default_features(df: DataFrame, keys: list[str], mtime: str) -> DataFrame:
    """(keys, term): date terms of each document; none where the mtime is unknown."""
    return df.select(*keys, F.explode(date_terms(F.col(mtime))).alias("term"))
