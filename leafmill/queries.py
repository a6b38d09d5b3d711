"""Queries of the core over the given tables, each with the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.functions.text import (
    date_terms, from_hex, grams, hex_id, key_hash, marks, readings, stored,
)
from leafmill.operators import incremental, index as ix, search as se, segments as sg, versions as vs
from leafmill.operators.numbering import number
from leafmill.plans import query as ql
from leafmill.session import table
from leafmill.sources import corpus, readers, store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- SQL parts

_CJK = r"\x{3040}-\x{30fa}\x{30fc}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_lit = lambda s: "'" + s.replace("'", "''") + "'"
_STORED = lambda c: f"trim(regexp_replace(translate({c}, {_lit(_WIDE)}, {_lit(_HALF)}), '\\s+', ' ', 'g'))"
_SPLIT = "string_split(regexp_replace(text, '([.!?])\\s+|\\n', '\\1' || chr(1), 'g'), chr(1))"
_KEPT = lambda l: f"list_filter(list_transform({l}, lambda x: {_STORED('x')}), lambda x: x <> '')"
_SENTS = lambda l, src, key="doc_id": (
    f"SELECT {key}, CAST(generate_subscripts(l, 1) - 1 AS INT) AS sent_id, unnest(l) AS sent FROM (SELECT {key}, {_KEPT(l)} AS l FROM {src})"
)
_WORDS = f"list_distinct(regexp_extract_all(regexp_replace(lower(sent), '[{_CJK}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'))"
_PAIRS = "CASE WHEN length(r) < 2 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) END"
_GRAMS = f"list_distinct(flatten(list_transform(regexp_extract_all(sent, '[{_CJK}]+'), lambda r: {_PAIRS})))"
_TERMS = lambda s, keys="doc_id, sent_id": (
    f"SELECT 'word' AS kind, unnest({_WORDS}) AS term, {keys} FROM ({s}) UNION ALL SELECT 'gram', unnest({_GRAMS}), {keys} FROM ({s})"
)
_DATES = "[" + ", ".join(f"strftime(to_timestamp(mtime) AT TIME ZONE 'UTC', '{f}')" for f in ("%Y", "%Y/%m", "%Y/%m/%d")) + "]"
_LIVE = "live AS (SELECT DISTINCT seg, fname FROM segments WHERE fname LIKE '%.cdb')"
_DOCS = "docs AS (SELECT DISTINCT d.seg, l.fname, d.doc_id, d.loc, d.mtime FROM docinfo d JOIN live l ON d.seg = l.seg)"


def _pred_sql(p: ql.Predicate, postings: str = "postings", sents: str = "sents") -> str:
    """(seg, doc_id, sent_id) of sentences that a predicate holds in."""
    pairs = ", ".join(f"({_lit(k)}, {_lit(t)})" for k, t in (p.every or p.some))
    out = f"SELECT seg, doc_id, sent_id FROM {postings} WHERE (kind, term) IN ({pairs})" + (" AND sent_id = 0" if p.title else "")
    out += f" GROUP BY ALL HAVING count(DISTINCT kind || ':' || term) >= {len(p.every) or 1}"
    if (p.pattern or p.start) and not p.neg:
        out = f"SELECT DISTINCT n.* FROM ({out}) n JOIN {sents} s ON n.seg = s.seg AND n.doc_id = s.doc_id AND n.sent_id = s.sent_id WHERE true"
        if p.pattern:
            out += f" AND regexp_matches({'s.sent' if p.exact else 'lower(s.sent)'}, {_lit(p.pattern)})"
        if p.start:
            out += f" AND regexp_matches(lower(s.sent), {_lit(p.start)})"
    return out


def _search_sql(preds: list[ql.Predicate], any_of: bool = False, with_: str = f"{_LIVE}, {_DOCS}", postings="postings", sents="sents") -> str:
    pos = [p for p in preds if not p.neg]
    parts = [f"h{i} AS (SELECT seg, doc_id, min(sent_id) AS s FROM ({_pred_sql(p, postings, sents)}) GROUP BY ALL)" for i, p in enumerate(preds)]
    joins = "".join(f" LEFT JOIN h{i} ON d.seg = h{i}.seg AND d.doc_id = h{i}.doc_id" for i in range(len(preds)))
    ok = (" OR " if any_of else " AND ").join(f"h{i}.s IS NOT NULL" for i, p in enumerate(preds) if not p.neg) or "true"
    no = "".join(f" AND h{i}.s IS NULL" for i, p in enumerate(preds) if p.neg)
    first = "least(" + ", ".join(f"h{i}.s" for i, p in enumerate(preds) if not p.neg) + ")" if pos else "CAST(NULL AS INT)"
    return f"WITH {with_}, {', '.join(parts)} SELECT d.seg AS seg, d.fname AS fname, d.doc_id AS doc_id, d.loc AS loc, d.mtime AS mtime, {first} AS first_sent FROM docs d{joins} WHERE ({ok}){no}"


def _index(spark: SparkSession, d: str) -> se.Index:
    return se.Index(*(table(spark, d, t) for t in ("postings", "sents", "docinfo", "segments")))


def _shown(found: DataFrame) -> DataFrame:
    return found.select("seg", "fname", "doc_id", "loc", "mtime", F.array_min("contexts").alias("first_sent"))


def _hand(*terms: tuple[str, str], like: str | None = None, **more) -> ql.Predicate:
    """A condition for the SQL, with its terms and pattern written out by hand, so that it doesn't depend on the parser."""
    return ql.Predicate(every=terms, pattern=like, **more)


_NO_WORD = r"[^\p{L}\p{N}_]*"
_HARBOR = [_hand(("word", "harbor"), like="harbor")]


def _searching(name: str, text: str, *by_hand: ql.Predicate, any_of: bool = False, strict: bool = False) -> None:
    preds = ql.parse(text, strict=strict)

    def run(spark: SparkSession, d: str) -> DataFrame:
        return _shown(se.search(_index(spark, d), preds, any_of=any_of))

    run.__name__, run.__doc__ = name, f"Documents of the published segments that match {text!r}."
    _query(_search_sql(list(by_hand), any_of))(run)


# --- deliveries

#: CRC-32 in SQL: the table of byte remainders, then a fold over the bytes.
_CRC = """
    crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
    crcs AS (SELECT rec_id, loc, xor(list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(range(1, octet_length(content) + 1), lambda i: ('0x' || substr(hex(content), 2 * i - 1, 2))::BIGINT)),
            lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc
        FROM now, crc_table)
"""



@_query(f"""
        WITH live AS (SELECT DISTINCT seg FROM segments WHERE fname LIKE '%.cdb'),
             now AS (SELECT loc, rec_id, content FROM rawdocs WHERE content IS NOT NULL AND loc IS NOT NULL
                     QUALIFY row_number() OVER (PARTITION BY loc ORDER BY seen_at DESC NULLS LAST, rec_id DESC) = 1),
             held AS (SELECT loc, crc FROM docinfo WHERE seg IN (SELECT seg FROM live) AND loc IS NOT NULL
                      QUALIFY row_number() OVER (PARTITION BY loc ORDER BY seg DESC, doc_id DESC) = 1),
             {_CRC}
        SELECT n.loc AS loc, n.rec_id AS rec_id FROM crcs n LEFT JOIN held h ON n.loc = h.loc AND n.crc = h.crc
        WHERE h.loc IS NULL""")
def p4_found(spark, d):
    """Problem 4: deliveries that the next index run has to process."""
    return incremental.p4_found(spark, d)


# --- search over the segments

_CATALOG, _NEAR = _hand(("word", "catalog"), like="catalog"), [("word", "near"), ("word", "the"), ("word", "harbor")]
_searching("kw_and", "harbor catalog", *_HARBOR, _CATALOG)
_searching("kw_or", "harbor catalog", *_HARBOR, _CATALOG, any_of=True)
_searching("kw_not", "harbor -river", *_HARBOR, _hand(("word", "river"), neg=True))
_searching("kw_not_only", "-the", _hand(("word", "the"), neg=True))
_searching("kw_or_not", "harbor catalog -lunch", *_HARBOR, _CATALOG, _hand(("word", "lunch"), neg=True), any_of=True)
_searching("kw_phrase", '"near the harbor"', _hand(*_NEAR, like=f"near{_NO_WORD}the{_NO_WORD}harbor"))
_searching("kw_strict", '"lunch."', _hand(("word", "lunch"), like=r"lunch\s*\.", exact=True), strict=True)
_searching("kw_title", "title:harbor", _hand(("word", "harbor"), like="harbor", title=True))
_searching("kw_hot", "the", _hand(("word", "the"), like="the"))
_searching("kw_cjk", "図書館", _hand(("gram", "図書"), ("gram", "書館"), like=f"図{_NO_WORD}書{_NO_WORD}館"))
_LABELS = ql.Predicate(some=(("label", "archive"), ("label", "todo")))
_searching("kw_mixed", "harbor date:2023 label:archive,todo", *_HARBOR, ql.Predicate(some=(("date", "2023"),)), _LABELS)
_searching("date_feature", "date:2023/01", ql.Predicate(some=(("date", "2023/01"),)))
_searching("date_or", "date:2022/12,2023/2,2023/01/23", ql.Predicate(some=(("date", "2022/12"), ("date", "2023/02"), ("date", "2023/01/23"))))
_searching("label_search", "label:archive,todo", _LABELS)


@_query(f"WITH x AS ({_search_sql(_HARBOR)}) SELECT * FROM x WHERE loc IS NULL UNION ALL SELECT * FROM (SELECT * FROM x WHERE loc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY loc ORDER BY fname DESC, doc_id DESC) = 1)")
def search_dedupe(spark, d):
    """Hits of which only the newest row of each location stays."""
    return _shown(se.search(_index(spark, d), ql.parse("harbor"), dedupe=True))


@_query(f"SELECT * FROM ({_search_sql(_HARBOR)}) ORDER BY fname DESC, doc_id DESC LIMIT 10")
def search_top10(spark, d):
    """Newest ten hits; a page is the feature."""
    return _shown(se.page(se.search(_index(spark, d), ql.parse("harbor")), 10))


@_query(f"SELECT * FROM ({_search_sql(_HARBOR)}) WHERE fname < 'bbb00009' OR fname = 'bbb00009' ORDER BY fname DESC, doc_id DESC LIMIT 10")
def search_page(spark, d):
    """Ten hits after a saved place."""
    return _shown(se.page(se.search(_index(spark, d), ql.parse("harbor")), 10, ql.save_token("bbb00009", 1 << 30, 10)))


@_query(f"SELECT seg, doc_id, CAST(row_number() OVER (ORDER BY fname DESC, doc_id DESC) AS BIGINT) AS place FROM ({_search_sql(_HARBOR)})")
def search_place(spark, d):
    """Place of every hit in the listing, from 1."""
    found = se.search(_index(spark, d), ql.parse("harbor")).select("fname", "seg", "doc_id")
    return number(found, F.desc("fname"), F.desc("doc_id"), name="place").select("seg", "doc_id", (F.col("place") + 1).alias("place"))


@_query(f"SELECT seg, doc_id, loc FROM ({_search_sql(_HARBOR)}) WHERE (fname > 'aaa00000.cdb' OR fname = 'aaa00000.cdb' AND doc_id >= 100) AND (fname < 'idx00003.cdb' OR fname = 'idx00003.cdb' AND doc_id <= 200)")
def doc_range(spark, d):
    """Hits between two places of the index."""
    found = se.search(_index(spark, d), ql.parse("harbor"))
    return se.between(found, ("aaa00000.cdb", 100), ("idx00003.cdb", 200)).select("seg", "doc_id", "loc")


@_query(f"SELECT seg, doc_id, loc FROM ({_search_sql(_HARBOR)}) WHERE loc NOT LIKE 'mail/%' AND (loc LIKE 'site/%' OR mtime > 1690000000)")
def doc_predicate(spark, d):
    """Hits that a list of document rules lets pass."""
    loc = F.col("loc")
    rules = [F.when(loc.startswith("mail/"), -1).otherwise(0), F.when(loc.startswith("site/"), 1).otherwise(0), F.when(F.col("mtime") > 1690000000, 1).otherwise(-1)]
    return se.decide(se.search(_index(spark, d), ql.parse("harbor")), rules).select("seg", "doc_id", "loc")


@_query(f"WITH x AS ({_search_sql(_HARBOR)}), t AS (SELECT CAST(sum(ndocs) AS BIGINT) AS total FROM (SELECT DISTINCT seg, ndocs FROM segments WHERE fname LIKE '%.cdb')), f AS (SELECT count(*) AS n FROM x WHERE fname >= 'bbb'), s AS (SELECT CAST(sum(ndocs) AS BIGINT) AS searched FROM (SELECT DISTINCT seg, ndocs, fname FROM segments WHERE fname LIKE '%.cdb' AND fname >= 'bbb')) SELECT n AS found, searched, total, n + n * (total - searched) // greatest(searched, 1) AS expected FROM t, f, s")
def hit_estimate(spark, d):
    """Hits to expect in all segments from those of the segments from ``bbb`` on."""
    found = se.search(_index(spark, d), ql.parse("harbor")).where("fname >= 'bbb'").agg(F.count("*").alias("found"))
    live = table(spark, d, "segments").where(F.col("fname").endswith(".cdb")).select("seg", "fname", "ndocs").distinct()
    sums = live.agg(
        F.sum(F.when(F.col("fname") >= "bbb", F.col("ndocs")).otherwise(0)).cast("bigint").alias("searched"),
        F.sum("ndocs").cast("bigint").alias("total"),
    )
    both = found.withColumn("k", F.lit(1)).join(sums.withColumn("k", F.lit(1)), "k").drop("k")
    return both.withColumn("expected", F.expr("found + found * (total - searched) div greatest(searched, 1)"))


@_query(f"SELECT count(*) AS narrowed, count(*) FILTER (ok) AS verified FROM (SELECT n.*, bool_or(coalesce(regexp_matches(lower(s.sent), {_lit(f'near{_NO_WORD}the{_NO_WORD}harbor')}), false)) AS ok FROM ({_pred_sql(_hand(*_NEAR, neg=True))}) n JOIN (SELECT DISTINCT seg FROM segments WHERE fname LIKE '%.cdb') l ON n.seg = l.seg LEFT JOIN sents s ON n.seg = s.seg AND n.doc_id = s.doc_id AND n.sent_id = s.sent_id GROUP BY ALL)")
def search_counters(spark, d):
    """Sentences that the terms narrow to, and those that the pattern verifies."""
    i, p = _index(spark, d), ql.keyword("near the harbor")
    cand = se.narrow(i, [p])
    sents = i.sents.select("seg", "doc_id", "sent_id", "sent")
    ok = F.max(F.coalesce(F.lower("sent").rlike(p.pattern), F.lit(False)))
    each = cand.join(sents, ["seg", "doc_id", "sent_id"], "left").groupBy("seg", "doc_id", "sent_id").agg(ok.alias("ok"))
    return each.agg(F.count("*").alias("narrowed"), F.count_if("ok").alias("verified"))


@_query(f"WITH x AS ({_search_sql(_HARBOR)}) SELECT DISTINCT x.seg AS seg, x.doc_id AS doc_id, x.first_sent AS first_sent, s.sent AS sent FROM x JOIN sents s ON x.seg = s.seg AND x.doc_id = s.doc_id AND x.first_sent = s.sent_id")
def snippet_first_match(spark, d):
    """First verified sentence of each hit."""
    found = _shown(se.search(_index(spark, d), ql.parse("harbor"))).select("seg", "doc_id", "first_sent")
    sents = table(spark, d, "sents").select("seg", "doc_id", F.col("sent_id").alias("first_sent"), "sent")
    return found.join(sents, ["seg", "doc_id", "first_sent"]).distinct()


@_query("SELECT DISTINCT seg, doc_id, sent_id, regexp_replace(sent, 'harbor', '<b>\\0</b>', 'g') AS shown FROM sents WHERE regexp_matches(sent, 'harbor')")
def snippet_highlight(spark, d):
    """Every sentence with a match, matches marked."""
    s = table(spark, d, "sents").where(F.col("sent").rlike("harbor"))
    return s.select("seg", "doc_id", "sent_id", marks(F.col("sent"), "harbor").alias("shown")).distinct()


@_query("SELECT DISTINCT seg, doc_id, sent_id, CAST(len(regexp_extract_all(sent, 'harbor')) AS INT) AS n, CAST(strpos(sent, 'harbor') - 1 AS INT) AS first FROM sents WHERE contains(sent, 'harbor')")
def snippet_ranges(spark, d):
    """Every sentence with a match: how many ranges are highlighted and where the first begins."""
    s = table(spark, d, "sents", "seg", "doc_id", "sent_id", "sent").where(F.col("sent").contains("harbor"))
    found = se.ranges("harbor")(F.col("sent"))
    return s.select("seg", "doc_id", "sent_id", F.size(found).alias("n"), found[0]["start"].alias("first")).distinct()


@_query()
def snippet_full(spark, d):
    """Title and snippet of every hit, contexts cut around the matches."""
    i, preds = _index(spark, d), ql.parse("harbor catalog")
    return se.with_snippets(i, se.search(i, preds), preds).select("seg", "doc_id", "loc", "title", "snippet")


# --- statistics of the segments


@_query("SELECT term, count(*) AS n FROM (SELECT DISTINCT kind, term, seg, doc_id, sent_id FROM postings WHERE kind IN ('word', 'gram')) GROUP BY term")
def gram_counts(spark, d):
    """Length of each text term's posting lists."""
    return ix.gram_counts(table(spark, d, "postings"))


@_query("SELECT seg, doc_id, count(*) AS n_sents, CAST(sum(length(regexp_replace(sent, '\\s', '', 'g'))) AS BIGINT) AS n_chars FROM (SELECT DISTINCT seg, doc_id, sent_id, sent FROM sents) GROUP BY ALL")
def sent_stats(spark, d):
    """Sentences and characters of each document."""
    return ix.sent_stats(table(spark, d, "sents"), ["seg", "doc_id"])


@_query("SELECT seg, doc_id, string_agg(CAST(sent_id AS VARCHAR), ',' ORDER BY sent_id DESC) AS sents FROM (SELECT DISTINCT seg, doc_id, sent_id FROM postings WHERE kind = 'word' AND term = 'harbor') GROUP BY ALL")
def posting_list(spark, d):
    """One term's list."""
    return ix.posting_list(table(spark, d, "postings"), "word", "harbor")


@_query("SELECT d.seg AS seg, ndocs, coalesce(nterms, 0) AS nterms FROM (SELECT seg, count(DISTINCT doc_id) AS ndocs FROM docinfo GROUP BY seg) d LEFT JOIN (SELECT seg, count(DISTINCT (kind, term)) AS nterms FROM postings WHERE kind IS NOT NULL GROUP BY seg) t ON d.seg = t.seg")
def index_info(spark, d):
    """Documents and distinct terms of each segment, counted."""
    return ix.index_info(table(spark, d, "docinfo"), table(spark, d, "postings").where("kind is not null"))


@_query("SELECT CAST(coalesce(sum(ndocs), 0) AS BIGINT) AS total FROM (SELECT DISTINCT seg, ndocs FROM segments WHERE fname LIKE '%.cdb')")
def total_docs(spark, d):
    """Documents of all published segments."""
    return sg.total_docs(table(spark, d, "segments"))


@_query("WITH l AS (SELECT DISTINCT prefix, fname, seg, mtime FROM segments WHERE fname LIKE '%.cdb' QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY fname DESC, seg DESC) = 1), o AS (SELECT DISTINCT seg, doc_id, loc FROM docinfo QUALIFY row_number() OVER (PARTITION BY seg ORDER BY doc_id DESC, loc DESC) = 1) SELECT l.prefix AS prefix, l.fname AS fname, l.mtime AS mtime, o.loc AS lastloc FROM l LEFT JOIN o ON l.seg = o.seg")
def index_lastloc(spark, d):
    """Newest segment of each prefix and its last location."""
    return sg.last_loc(table(spark, d, "docinfo"), table(spark, d, "segments"))


@_query("SELECT 'doc ' || seg || ' ' || doc_id AS key, mtime || ' ' || loc AS value FROM (SELECT DISTINCT seg, doc_id, mtime, loc FROM docinfo) UNION ALL SELECT 'sent ' || seg || ' ' || doc_id || ' ' || sent_id, sent FROM (SELECT DISTINCT seg, doc_id, sent_id, sent FROM sents) UNION ALL SELECT concat_ws(' ', kind, term, seg), CAST(count(*) AS VARCHAR) FROM (SELECT DISTINCT kind, term, seg, doc_id, sent_id FROM postings) GROUP BY kind, term, seg")
def index_dump(spark, d):
    """Everything the index holds, as text."""
    docinfo = table(spark, d, "docinfo", "seg", "doc_id", "mtime", "loc")
    return ix.dump(docinfo, table(spark, d, "sents", "seg", "doc_id", "sent_id", "sent"), table(spark, d, "postings", "kind", "term", "seg", "doc_id", "sent_id"))


_STORED_ROWS = "SELECT DISTINCT kind, term, seg, doc_id, sent_id, CASE WHEN kind = 'label' THEN doc_id * 1000 + sent_id ELSE -doc_id * 1000 - sent_id END AS pos FROM postings WHERE kind IS NOT NULL AND term IS NOT NULL"


@_query(f"SELECT kind, term, seg, doc_id, sent_id, pos FROM (SELECT *, lag((seg, doc_id, sent_id)) OVER (PARTITION BY kind, term, seg ORDER BY pos) AS b FROM ({_STORED_ROWS})) WHERE b <= (seg, doc_id, sent_id)")
def posting_order_check(spark, d):
    """Entries of stored lists that aren't smaller than the one before; the stored order is doctored here."""
    rows = table(spark, d, "postings", "kind", "term", "seg", "doc_id", "sent_id").where("kind is not null and term is not null").distinct()
    place = F.col("doc_id") * 1000 + F.col("sent_id")
    rows = rows.withColumn("pos", F.when(F.col("kind") == "label", place).otherwise(-place))
    return ix.out_of_order(rows, ["kind", "term", "seg"])


@_query("""WITH p AS (SELECT prefix, list(CAST(nterms AS BIGINT) ORDER BY seg) AS l FROM (SELECT DISTINCT prefix, seg, nterms FROM segments WHERE fname LIKE '%.cdb') GROUP BY prefix)
    SELECT prefix, list_reduce(list_prepend(0, l), lambda r, n: r + greatest(n - CAST(floor(r * 0.25) AS BIGINT), 0)) AS terms FROM p""")
def term_estimate(spark, d):
    """Terms to expect in a merge of each prefix's segments."""
    live = table(spark, d, "segments").where(F.col("fname").endswith(".cdb")).select("prefix", "seg", "nterms").distinct()
    listed = live.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("seg", "nterms"))).alias("l"))
    return listed.select("prefix", ix.estimated_terms(F.transform("l", lambda x: x["nterms"].cast("bigint"))).alias("terms"))


# --- building an index from documents


@_query(_SENTS(_SPLIT, "documents"))
def sents_plain(spark, d):
    """Sentences of every document read as plain text."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return ix.number_sents(docs, ["doc_id"], ix.plain_sents(F.col("text")))


@_query(_SENTS("string_split(text, chr(10))", "documents"))
def sents_lines(spark, d):
    """Sentences of every document read line by line."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return ix.number_sents(docs, ["doc_id"], ix.line_sents(F.col("text")))


@_query(f"WITH s AS ({_SENTS(_SPLIT, 'documents')}) SELECT kind, term, count(*) AS n FROM ({_TERMS('SELECT * FROM s')}) GROUP BY ALL")
def postings_count(spark, d):
    """Postings of every term of the documents."""
    return ix.postings_of(sents_plain(spark, d), ["doc_id"]).groupBy("kind", "term").agg(F.count("*").alias("n"))


@_query(f"SELECT 'gram' AS kind, unnest({_GRAMS}) AS term, seg, doc_id, sent_id FROM (SELECT DISTINCT seg, doc_id, sent_id, sent FROM sents)")
def cjk_bigrams(spark, d):
    """Pairs of neighbours in unspaced runs of every stored sentence."""
    s = table(spark, d, "sents", "seg", "doc_id", "sent_id", "sent").distinct()
    return s.select(F.lit("gram").alias("kind"), F.explode(grams(F.col("sent"))).alias("term"), "seg", "doc_id", "sent_id")


_NUMBERED = "SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents"


def _built(spark, d, typed=False):
    docs = table(spark, d, "documents", "doc_id", "text", "loc", "mtime", "lang", "source", "doctype")
    docs = docs.withColumn("labels", F.array_compact(F.array("lang", "source"))).withColumnRenamed("doc_id", "id")
    if typed:
        return ix.build(docs, ["id"], labels="labels", doctype="doctype")
    return ix.build(docs, ["id"], labels="labels", lines=F.col("doctype") == "C")


@_query(f"SELECT CAST(n // 1000 AS INT) AS seg, CAST(n % 1000 + 1 AS INT) AS doc_id, mtime, loc FROM ({_NUMBERED})")
def build_docinfo(spark, d):
    """Documents of a new index, a thousand a segment."""
    return _built(spark, d)["docinfo"]


_BUILT_SENTS = _SENTS(f"CASE WHEN doctype = 'C' THEN string_split(text, chr(10)) ELSE {_SPLIT} END", f"(SELECT CAST(n // 1000 AS INT) AS seg, CAST(n % 1000 + 1 AS INT) AS doc_id, * EXCLUDE (doc_id, n) FROM ({_NUMBERED}))", "seg, doc_id")
_BUILT_FEATURES = f"""SELECT DISTINCT 'label' AS kind, unnest(list_filter([lang, source], lambda x: x IS NOT NULL AND x <> '')) AS term, CAST(n // 1000 AS INT) AS seg, CAST(n % 1000 + 1 AS INT) AS doc_id, 0 AS sent_id FROM ({_NUMBERED})
    UNION ALL SELECT 'date', unnest({_DATES}), CAST(n // 1000 AS INT), CAST(n % 1000 + 1 AS INT), 0 FROM ({_NUMBERED}) WHERE mtime > 0"""


@_query(_BUILT_SENTS)
def build_sents(spark, d):
    """Sentences of a new index, source code by lines."""
    return _built(spark, d)["sents"]


@_query(f"WITH s AS ({_BUILT_SENTS}) SELECT seg, kind, count(*) AS n, count(DISTINCT term) AS terms FROM ({_TERMS('SELECT * FROM s', 'seg, doc_id, sent_id')} UNION ALL {_BUILT_FEATURES}) GROUP BY ALL")
def build_postings(spark, d):
    """Postings and terms of a new index by segment and kind, features included."""
    return _built(spark, d)["postings"].groupBy("seg", "kind").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@_query()
def build_sents_typed(spark, d):
    """Sentences of a new index, each document read by its type: pages, mails and their text leaves as well."""
    return _built(spark, d, typed=True)["sents"]


@_query()
def build_postings_typed(spark, d):
    """Postings and terms of a new index by segment and kind, each document read by its type."""
    return _built(spark, d, typed=True)["postings"].groupBy("seg", "kind").agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"))


@_query(f"SELECT doc_id, unnest({_DATES}) AS term FROM documents WHERE mtime > 0")
def default_features(spark, d):
    """Date terms of every document with a known mtime."""
    return readers.default_features(table(spark, d, "documents"), ["doc_id"], "mtime")


@_query("SELECT l_shipmonth, count(*) AS n FROM (SELECT strftime(l_shipdate, '%Y/%m') AS l_shipmonth FROM lineitem) GROUP BY ALL")
def date_load(spark, d):
    """Month terms over the largest dated table."""
    li = table(spark, d, "lineitem", "l_shipdate")
    return li.select(date_terms(F.unix_timestamp("l_shipdate"))[1].alias("l_shipmonth")).groupBy("l_shipmonth").agg(F.count("*").alias("n"))


@_query()
def html_sents(spark, d):
    """Sentences of every page."""
    pages = table(spark, d, "pages", "page_id", "html")
    return ix.number_sents(pages, ["page_id"], readers.html_sents(F.col("html")))


@_query()
def typed_sents(spark, d):
    """Sentences of every document by its type."""
    return readers.sents_of(table(spark, d, "documents", "doc_id", "text", "doctype"), ["doc_id"], "text", "doctype")


@_query()
def raw_sents(spark, d):
    """Sentences of every delivery, decoded as declared."""
    raw = corpus.corpus(table(spark, d, "rawdocs", "rec_id", "loc", "content", "mtime", "size", "labels", "encoding").dropDuplicates(["rec_id"]))
    text = raw.where("content is not null").select("loc", "content", readers.decoded("content", "encoding").alias("text"))
    return ix.number_sents(text, ["loc"], ix.plain_sents(F.col("text")))


@_query("SELECT DISTINCT docid AS loc, mtime, octet_length(encode(doctext)) AS size, doctext AS text FROM doctexts")
def corpus_database(spark, d):
    """Documents of a database table as a corpus."""
    docs = corpus.reader("sql")(table(spark, d, "doctexts", "docid", "doctext", "mtime"))
    return docs.select("loc", "mtime", "size", readers.decoded("content", "encoding").alias("text")).distinct()


@_query("SELECT p_brand AS loc, 0 AS mtime, octet_length(encode(arg_min(p_type, p_partkey))) AS size, arg_min(p_type, p_partkey) AS text FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def corpus_key_values(spark, d):
    """Entries of a key-value table as a corpus: the first value of each key."""
    docs = corpus.reader("kv")(_parts(spark, d).where("key is not null"))
    return docs.select("loc", "mtime", "size", readers.decoded("content", "encoding").alias("text"))


@_query("SELECT 'nation-' || n_nationkey AS loc, n_name AS title FROM nation")
def corpus_hooks(spark, d):
    """A corpus whose locations and titles are columns of their own."""
    rows = table(spark, d, "nation", "n_nationkey", "n_name")
    named = corpus.corpus(rows, loc=F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")), title=F.col("n_name"))
    return named.select("loc", "title")


# --- mails

_HEAD = "string_split(replace(text, chr(13), ''), chr(10) || chr(10))[1]"
_FIELD = lambda h: f"nullif(trim(regexp_extract({_HEAD}, '(?m)^{h}: *(.*)$', 1)), '')"
_MAILS = f"SELECT doc_id, text FROM documents WHERE doctype = 'E' AND text IS NOT NULL AND regexp_matches(text, '^[A-Z][A-Za-z-]*: ')"


def _every_mail(spark, d):
    return table(spark, d, "documents", "doc_id", "text", "doctype", "loc", "mtime").where("doctype = 'E' and text is not null")


def _mail_docs(spark, d):
    """Mails that begin with a header: those that the SQL takes."""
    return _every_mail(spark, d).where(F.col("text").rlike("^[A-Z][A-Za-z-]*: "))


@_query(f"""WITH m AS ({_MAILS}), h AS (
    SELECT doc_id, 'From' AS k, {_FIELD('From')} AS v FROM m UNION ALL SELECT doc_id, 'Subject', {_FIELD('Subject')} FROM m
    UNION ALL SELECT doc_id, 'To', {_FIELD('To')} FROM m UNION ALL SELECT doc_id, 'Cc', {_FIELD('Cc')} FROM m
    UNION ALL SELECT doc_id, 'Date', {_FIELD('Date')} FROM m)
    SELECT doc_id, k || ': ' || regexp_replace(v, '\\s+', ' ', 'g') AS header FROM h WHERE v IS NOT NULL""")  # fmt: skip
def mail_headers(spark, d, mails=_mail_docs):
    """Header sentences of every mail that begins with a header."""
    return readers.mail_headers(mails(spark, d), "doc_id", "text").select("doc_id", "header")


@_query(f"SELECT doc_id, 'msgid' AS kind, regexp_extract({_FIELD('Message-ID')}, '<([^<>]+)>', 1) AS term FROM ({_MAILS}) WHERE {_FIELD('Message-ID')} IS NOT NULL")
def mail_features(spark, d, mails=_mail_docs):
    """Ids of every mail that begins with a header."""
    return readers.mail_features(mails(spark, d), "doc_id", "text")


@_query(f"SELECT doc_id, regexp_replace({_FIELD('Subject')}, '\\s+', ' ', 'g') AS title, CAST(epoch(strptime({_FIELD('Date')}, '%d %b %Y %H:%M:%S')) AS BIGINT) AS mtime FROM ({_MAILS})")
def mail_info(spark, d, mails=_mail_docs):
    """Title and time of every mail that begins with a header."""
    return readers.mail_info(mails(spark, d), "doc_id", "text", "mtime")


@_query(f"SELECT doc_id, 0 AS part, 'text/plain' AS kind, regexp_replace(text, '^(?s:.*?)\\r?\\n\\r?\\n', '') AS text FROM ({_MAILS})")
def mail_parts(spark, d, mails=_mail_docs):
    """Body or parts of every mail that begins with a header."""
    return readers.mail_parts(mails(spark, d), "doc_id", "text")


def _mail_index(spark, d, mails) -> se.Index:
    docs = mails(spark, d).select(F.lit(0).alias("seg"), F.col("doc_id").cast("int").alias("doc_id"), "text", "doctype", "loc", "mtime")
    keys = ["seg", "doc_id"]
    sents = readers.sents_of(docs, keys, "text", "doctype")
    feats = readers.mail_features(docs, "doc_id", "text").select("kind", "term", F.lit(0).alias("seg"), "doc_id", F.lit(0).alias("sent_id"))
    segments = spark.createDataFrame([(0, "idx", "idx00000.cdb")], "seg int, prefix string, fname string")
    return se.Index(ix.postings_of(sents, keys).unionByName(feats), sents, docs.select(*keys, "mtime", "loc"), segments)


_MAIL_WITH = f"""h AS (SELECT CAST(doc_id AS INT) AS doc_id, lower({_STORED("coalesce(" + _FIELD('Subject') + ", '')")}) AS subject, lower({_STORED("coalesce(" + _FIELD('From') + ", '')")}) AS sender FROM ({_MAILS}))"""


@_query(f"WITH {_MAIL_WITH} SELECT doc_id FROM h WHERE list_contains(regexp_extract_all(regexp_replace(subject, '[{_CJK}]+', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'), 'harbor')")
def mail_subject_search(spark, d, mails=_every_mail):
    """Mails whose Subject holds a word; over every mail, as the SQL gives the same on the test data."""
    return se.search(_mail_index(spark, d, mails), ql.parse("subject:harbor")).select("doc_id")


@_query(f"WITH {_MAIL_WITH} SELECT doc_id FROM h WHERE regexp_matches(sender, '[^\\p{{L}}\\p{{N}}_]example[^\\p{{L}}\\p{{N}}_]')")
def mail_sender_search(spark, d, mails=_mail_docs):
    """Mails whose From line holds a word."""
    return se.search(_mail_index(spark, d, mails), ql.parse("from:example")).select("doc_id")


@_query(f"WITH m AS (SELECT doc_id, regexp_extract({_FIELD('Message-ID')}, '<([^<>]+)>', 1) AS term FROM ({_MAILS}) WHERE {_FIELD('Message-ID')} IS NOT NULL) SELECT CAST(doc_id AS INT) AS doc_id, loc FROM documents WHERE doc_id IN (SELECT doc_id FROM m WHERE term = (SELECT arg_min(term, doc_id) FROM m))")
def mail_thread(spark, d, mails=_mail_docs):
    """Mails that are or refer to a message; the message is the one of the smallest document."""
    i = _mail_index(spark, d, mails)
    first = i.postings.where("kind = 'msgid'").agg(F.min_by("term", "doc_id")).first()[0]
    return se.search(i, [ql.message(f"<{first}>", refer=True)]).select("doc_id", "loc")


@_query(f"WITH m AS (SELECT doc_id, regexp_extract({_FIELD('Message-ID')}, '<([^<>]+)>', 1) AS term FROM ({_MAILS}) WHERE {_FIELD('Message-ID')} IS NOT NULL) SELECT CAST(doc_id AS INT) AS doc_id FROM m WHERE term = (SELECT arg_max(term, doc_id) FROM m)")
def mail_by_id(spark, d, mails=_mail_docs):
    """Mails with a message's id; the message is the one of the greatest document."""
    i = _mail_index(spark, d, mails)
    last = i.postings.where("kind = 'msgid'").agg(F.max_by("term", "doc_id")).first()[0]
    return se.search(i, ql.parse(f"message-id:<{last}>")).select("doc_id")


def _whole(query):
    """A query over every mail as ``NAME_all``, those that don't begin as the SQL wants included; it has no SQL."""

    def run(spark, d):
        return query(spark, d, _every_mail)

    run.__name__, run.__doc__ = f"{query.__name__}_all", f"{query.__name__} over all mails, with any header or none."
    return _query()(run)


for _q in (mail_headers, mail_features, mail_info, mail_parts, mail_sender_search, mail_thread):
    _whole(_q)


# --- readings

#: A small dictionary of words and their readings.
_READINGS = (
    ("図書館", "としょかん"), ("学生", "がくせい"), ("漢字", "かんじ"), ("文書", "ぶんしょ"), ("辞書", "じしょ"), ("時計", "とけい"), ("報告書", "ほうこくしょ"),
)


@_query("SELECT DISTINCT seg, doc_id FROM sents WHERE seg IN (SELECT seg FROM segments WHERE fname LIKE '%.cdb') AND regexp_matches(sent, '図書館|文書|辞書|報告書|しょ|ショ|シょ|しョ') AND (seg, doc_id) IN (SELECT (seg, doc_id) FROM docinfo)")
def yomi_search(spark, d):
    """Documents with a sentence that can be read as a Latin spelling says, by the readings of its words and its kana."""
    keys = ["seg", "doc_id"]
    i = _index(spark, d)
    words = spark.createDataFrame(_READINGS, "word string, reading string")
    sents = i.sents.select(*keys, "sent_id", "sent").where("sent is not null").distinct()
    read = se.Index(ix.reading_postings(sents, keys, words), i.sents, i.docinfo, i.segments)
    return se.search(read, [ql.reading(ql.kana("sho"))]).select(*keys).distinct()


# --- upkeep of segments

_NEWEST = "newest AS (SELECT seg, doc_id, mtime, loc FROM (SELECT DISTINCT seg, doc_id, mtime, loc FROM docinfo) WHERE loc IS NOT NULL AND seg IN (SELECT seg FROM live) QUALIFY row_number() OVER (PARTITION BY loc ORDER BY seg DESC, doc_id DESC, mtime DESC) = 1)"
_FOUND = "found AS (SELECT DISTINCT loc, mtime FROM documents WHERE loc IS NOT NULL UNION SELECT loc, mtime FROM rawdocs WHERE loc IS NOT NULL)"


def _found(spark, d):
    docs = table(spark, d, "documents", "loc", "mtime").where("loc is not null")
    return docs.unionByName(table(spark, d, "rawdocs", "loc", "mtime").where("loc is not null")).distinct()


@_query(f"WITH {_LIVE}, {_NEWEST}, {_FOUND} SELECT f.loc AS loc, f.mtime AS mtime FROM found f LEFT JOIN newest n ON f.loc = n.loc WHERE n.loc IS NULL OR coalesce(f.mtime, 0) >= n.mtime")
def update_changed(spark, d):
    """Locations to index again: unknown or changed ones."""
    return sg.candidates(_found(spark, d), table(spark, d, "docinfo"), table(spark, d, "segments"), "U")


@_query(f"WITH {_LIVE}, {_NEWEST}, {_FOUND} SELECT loc, mtime FROM found WHERE loc NOT IN (SELECT loc FROM newest)")
def update_new(spark, d):
    """Locations that aren't indexed."""
    return sg.candidates(_found(spark, d), table(spark, d, "docinfo"), table(spark, d, "segments"), "N")


@_query(f"WITH {_FOUND} SELECT loc, mtime FROM found")
def update_all(spark, d):
    """All locations."""
    return sg.candidates(_found(spark, d), table(spark, d, "docinfo"), table(spark, d, "segments"), "F")


_MAP = f"{_LIVE}, {_NEWEST}, map AS (SELECT *, CAST(row_number() OVER (ORDER BY seg, doc_id, loc) AS INT) AS new_id FROM newest)"


def _merged(spark, d):
    m = sg.remap(table(spark, d, "docinfo"), table(spark, d, "segments"))
    return sg.merge(table(spark, d, "postings"), table(spark, d, "sents"), m, 9)


@_query(f"WITH {_MAP} SELECT 9 AS seg, new_id AS doc_id, mtime, loc FROM map")
def segment_merge(spark, d):
    """Documents of the merge of all segments: the newest row of each location."""
    return _merged(spark, d)["docinfo"]


@_query(f"WITH {_MAP} SELECT DISTINCT 9 AS seg, m.new_id AS doc_id, s.sent_id AS sent_id, s.sent AS sent FROM sents s JOIN map m ON s.seg = m.seg AND s.doc_id = m.doc_id")
def merge_sents(spark, d):
    """Sentences of the merge."""
    return _merged(spark, d)["sents"]


@_query(f"WITH {_MAP} SELECT kind, term, count(*) AS n FROM (SELECT DISTINCT p.kind, p.term, m.new_id, p.sent_id FROM postings p JOIN map m ON p.seg = m.seg AND p.doc_id = m.doc_id) GROUP BY ALL")
def merge_postings(spark, d):
    """Posting counts of the merge."""
    return _merged(spark, d)["postings"].groupBy("kind", "term").agg(F.count("*").alias("n"))


@_query("""WITH RECURSIVE s AS (SELECT prefix, seg, CAST(coalesce(ndocs, 0) AS BIGINT) AS n, CAST(coalesce(nterms, 0) AS BIGINT) AS t, row_number() OVER (PARTITION BY prefix ORDER BY seg) AS k FROM (SELECT DISTINCT prefix, seg, ndocs, nterms FROM segments WHERE fname LIKE '%.cdb')),
    r AS (SELECT prefix, seg, k, CAST(0 AS BIGINT) AS grp, n, t FROM s WHERE k = 1
      UNION ALL SELECT s.prefix, s.seg, s.k, CASE WHEN r.n > 500 OR r.t > 4000 THEN r.grp + 1 ELSE r.grp END,
        CASE WHEN r.n > 500 OR r.t > 4000 THEN s.n ELSE r.n + s.n END,
        CASE WHEN r.n > 500 OR r.t > 4000 THEN s.t ELSE r.t + greatest(s.t - CAST(floor(r.t * 0.25) AS BIGINT), 0) END
      FROM r JOIN s ON s.prefix = r.prefix AND s.k = r.k + 1)
    SELECT prefix, seg, grp FROM r""")
def merge_policy(spark, d):
    """Groups of segments to merge, with small bounds."""
    return sg.merge_policy(table(spark, d, "segments"), 500, 4000)


@_query("SELECT loc, count(*) AS n FROM (SELECT DISTINCT d.seg, d.doc_id, d.loc FROM docinfo d WHERE d.seg IN (SELECT seg FROM segments WHERE fname LIKE '%.cdb')) GROUP BY loc HAVING count(*) > 1")
def segment_union_all(spark, d):
    """Locations that come more than once without merge."""
    docs = _index(spark, d).docs().select("seg", "doc_id", "loc").distinct()
    return docs.groupBy("loc").agg(F.count("*").alias("n")).where("n > 1")


@_query(f"WITH {_LIVE}, {_NEWEST}, a AS (SELECT DISTINCT loc FROM rawdocs WHERE loc IS NOT NULL) SELECT a.loc AS loc, n.seg AS seg, n.doc_id AS doc_id FROM a LEFT JOIN newest n ON a.loc = n.loc")
def loc_lookup(spark, d):
    """Newest place of every delivered location."""
    return sg.loc_lookup(table(spark, d, "docinfo"), table(spark, d, "segments"), table(spark, d, "rawdocs", "loc"))


@_query("SELECT loc, mtime, CASE WHEN coalesce(mtime, 0) > 1700000000 - 3 * 86400 THEN 'bbb' ELSE 'aaa' END AS tier FROM documents")
def tier_split(spark, d):
    """Documents by tier at a fixed time."""
    return sg.tiers(table(spark, d, "documents", "loc", "mtime"), 1700000000)


@_query("SELECT loc, mtime FROM documents WHERE mtime IS NOT NULL")
def sort_by_mtime(spark, d):
    """Documents by time, ties by location."""
    return sg.by_mtime(table(spark, d, "documents", "loc", "mtime"))


# --- versioned articles

_SNAPS = "snaps AS (SELECT DISTINCT tid, aid, name, size, mtime, data FROM articles WHERE tid IS NOT NULL AND aid IS NOT NULL)"
_CHAIN = "ids AS (SELECT DISTINCT tid, aid FROM snaps), chain AS (SELECT tid, CASE WHEN tid = aid THEN max(tid) OVER (PARTITION BY aid) ELSE lag(tid) OVER (PARTITION BY aid ORDER BY tid) END AS next FROM ids)"


@_query(f"WITH {_SNAPS} SELECT aid, max(tid) AS tid, count(DISTINCT tid) AS revs, arg_max(mtime, tid) AS mtime, nullif(regexp_replace(substr(max(name ORDER BY tid), 17), '\\.gz$', ''), '') AS label FROM (SELECT aid, tid, mtime, name FROM snaps) GROUP BY aid" .replace("max(name ORDER BY tid)", "arg_max(name, tid)"))
def cms_latest(spark, d):
    """Newest snapshot of every article."""
    return vs.latest(table(spark, d, "articles")).drop("data")


@_query(f"WITH {_SNAPS} SELECT aid, tid, CAST(row_number() OVER (ORDER BY tid DESC) AS INT) AS place FROM (SELECT DISTINCT aid, tid FROM snaps WHERE aid = (SELECT aid FROM snaps GROUP BY aid ORDER BY count(DISTINCT tid) DESC, aid LIMIT 1))")
def cms_history(spark, d):
    """Snapshots of the article that has most of them."""
    rows = table(spark, d, "articles")
    counts = vs.snapshots(rows).groupBy("aid").agg(F.count_distinct("tid").alias("n"))
    most = counts.orderBy(F.desc("n"), "aid").first()
    return vs.history(rows, most["aid"] if most else "")


@_query(f"WITH {_SNAPS}, {_CHAIN} SELECT tid, next FROM chain")
def cms_chain(spark, d):
    """The circular chain of every article."""
    return vs.chain(table(spark, d, "articles"))


@_query(f"WITH {_SNAPS} SELECT aid FROM (SELECT DISTINCT aid, tid FROM snaps) GROUP BY aid HAVING count(*) = 1")
def cms_unmodified(spark, d):
    """Articles that were never modified."""
    return vs.unmodified(table(spark, d, "articles"))


@_query(f"WITH {_SNAPS}, {_CHAIN} SELECT tid, next, 'ffffffff' AS stored FROM chain WHERE next >= tid AND next <> 'ffffffff'")
def cms_validate(spark, d):
    """Where a doctored chain disagrees with the names."""
    rows = table(spark, d, "articles")
    doctored = vs.chain(rows).withColumn("next", F.when(F.col("next") >= F.col("tid"), "ffffffff").otherwise(F.col("next")))
    return vs.validate(rows, doctored)


@_query(f"WITH {_SNAPS} SELECT aid, max(tid) AS tid FROM snaps WHERE regexp_matches(lower(data), '(^|[^\\p{{L}}\\p{{N}}_])harbor([^\\p{{L}}\\p{{N}}_]|$)') GROUP BY aid")
def cms_find_articles(spark, d):
    """Articles with a snapshot that holds a word, each by its newest hit, found in an index of all snapshots."""
    rows = table(spark, d, "articles")
    tables = ix.build(vs.snapshot_documents(rows), ["loc"], labels="labels")
    segments = tables["segments"].withColumn("fname", F.format_string("idx%05d.cdb", "seg"))
    return vs.find(se.Index(tables["postings"], tables["sents"], tables["docinfo"], segments), ql.parse("harbor"), rows)


_TOP = "(SELECT max(('0x' || tid)::BIGINT) FROM articles)"


@_query(f"SELECT printf('%08x', n) AS tid, printf('%08x', n) AS aid, printf('%08x', n) || printf('%08x', n) || coalesce(source, '') || '.gz' AS name FROM (SELECT source, {_TOP} + row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def cms_create(spark, d):
    """Snapshots that new articles of all documents would get."""
    docs = table(spark, d, "documents", "doc_id", "text", "source", "mtime")
    new = docs.select(F.col("doc_id").alias("pos"), F.col("source").alias("label"), "mtime", F.col("text").alias("data"))
    return vs.create(table(spark, d, "articles"), new).select("tid", "aid", "name")


@_query(f"WITH {_SNAPS} SELECT printf('%08x', {_TOP} + row_number() OVER (ORDER BY aid)) AS tid, aid FROM (SELECT DISTINCT aid FROM snaps)")
def cms_modify(spark, d):
    """Snapshots that an edit of every article would get."""
    rows = table(spark, d, "articles")
    new = vs.articles(rows).select(F.col("aid").alias("pos"), "aid", F.lit(None).cast("string").alias("label"), F.lit(1).alias("mtime"), F.lit("x").alias("data"))
    return vs.modify(rows, new).select("tid", "aid")


@_query(f"WITH {_SNAPS}, {_CHAIN} SELECT tid, next, CASE WHEN next < tid THEN next END AS was FROM chain")
def cms_recover(spark, d):
    """The right chain beside a stored one that lost some records."""
    rows = table(spark, d, "articles")
    return vs.recover(rows, vs.chain(rows).where("next < tid"))


@_query(f"WITH {_SNAPS}, {_CHAIN} SELECT DISTINCT aid, CASE WHEN name LIKE '%.gz' AND length(name) > 19 THEN substr(name, 17, length(name) - 19) END AS label FROM snaps")
def cms_labels(spark, d):
    """Labels that the names of snapshots carry."""
    return vs.snapshots(table(spark, d, "articles")).select("aid", vs.labels(F.col("name")).alias("label")).distinct()


# --- stores


def _parts(spark, d):
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_type", "p_name")
    return p.select(F.col("p_partkey").alias("seq"), F.col("p_brand").alias("key"), F.col("p_type").alias("value"))


@_query("SELECT p_brand AS key, string_agg(p_type, ' ' ORDER BY p_partkey, p_type) AS value FROM part WHERE p_brand IS NOT NULL AND p_type IS NOT NULL GROUP BY p_brand")
def kv_merge(spark, d):
    """Values of equal keys joined."""
    return store.merge_values(_parts(spark, d).withColumn("source", F.lit(0)))


@_query("SELECT p_brand AS key, arg_min(p_type, p_partkey) AS value FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand")
def kv_get(spark, d):
    """First value of every key."""
    kv = _parts(spark, d)
    return store.get(kv, kv.select("key"))


@_query("SELECT p_partkey AS seq, p_brand AS key, p_type AS value FROM part WHERE p_partkey >= (SELECT min(p_partkey) FROM part WHERE p_brand = (SELECT max(p_brand) FROM part))")
def kv_range(spark, d):
    """Entries from a key on."""
    kv = _parts(spark, d)
    return store.range_from(kv, kv.agg(F.max("key")).first()[0])


@_query("SELECT p_partkey AS seq, '+' || octet_length(encode(p_brand)) || ',' || octet_length(encode(p_type)) || ':' || p_brand || '->' || p_type AS line FROM part")
def kv_dump(spark, d):
    """Entries as text."""
    return store.dump_text(_parts(spark, d))


@_query("SELECT p_partkey AS seq, p_brand AS key, p_type AS value FROM part")
def kv_load(spark, d):
    """Entries back from their text."""
    return store.load_text(store.dump_text(_parts(spark, d)))


def _trie(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    rn = n.join(r, n.n_regionkey == r.r_regionkey)
    a = r.select(F.array("r_name").alias("path"), F.col("r_regionkey").cast("string").alias("value"))
    b = rn.select(F.array("r_name", "n_name").alias("path"), F.col("n_nationkey").cast("string").alias("value"))
    e = c.join(rn, c.c_nationkey == rn.n_nationkey).select(F.array("r_name", "n_name", "c_name").alias("path"), F.col("c_custkey").cast("string").alias("value"))
    return a.unionByName(b).unionByName(e)


@_query("SELECT r_name || '/' || n_name || '/' || c_name AS at, r_regionkey || ' ' || n_nationkey || ' ' || c_custkey AS found FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def trie_lookup(spark, d):
    """Values along the paths of all customers; paths that end nowhere find nothing."""
    trie = _trie(spark, d)
    deep = trie.where(F.size("path") == 3).select("path")
    asked = deep.unionByName(deep.select(F.concat(F.slice("path", 1, 2), F.array(F.lit("nobody"))).alias("path")))
    got = store.trie_lookup(trie, asked)
    return got.select(F.array_join("path", "/").alias("at"), F.array_join("values", " ").alias("found"))


@_query("SELECT r_name || '/' || n_name AS at, CAST(n_nationkey AS VARCHAR) AS value FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT r_name, CAST(r_regionkey AS VARCHAR) FROM region WHERE r_name = 'ASIA' UNION ALL SELECT r_name || '/' || n_name || '/' || c_name, CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def trie_below(spark, d):
    """Everything under a path."""
    return store.trie_below(_trie(spark, d), ["ASIA"]).select(F.array_join("path", "/").alias("at"), "value")


@_query("""WITH RECURSIVE s AS (SELECT doc_id AS recno, 512 * (1 + (coalesce(octet_length(encode(text)), 0) + 511) // 512) AS b, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
    r AS (SELECT recno, k, CAST(0 AS INT) AS tar_idx, CAST(0 AS BIGINT) AS tar_offset, b FROM s WHERE k = 1
      UNION ALL SELECT s.recno, s.k, CASE WHEN r.tar_offset + r.b >= 20480 THEN r.tar_idx + 1 ELSE r.tar_idx END, CASE WHEN r.tar_offset + r.b >= 20480 THEN 0 ELSE r.tar_offset + r.b END, s.b FROM r JOIN s ON s.k = r.k + 1)
    SELECT recno, tar_idx, tar_offset FROM r""")
def archive_layout(spark, d):
    """Where every document goes in an archive with small files."""
    docs = table(spark, d, "documents", "doc_id", "text")
    return store.layout(docs.select(F.col("doc_id").alias("recno"), F.octet_length("text").alias("size")), 20480)


@_query("SELECT printf('%08x', doc_id) AS loc, text FROM documents WHERE text IS NOT NULL")
def archive_get(spark, d):
    """Documents packed into an archive and read back by their locations."""
    docs = table(spark, d, "documents", "doc_id", "text", "mtime").where("text is not null")
    entries = docs.select(F.col("doc_id").alias("recno"), store.gzipped(F.encode("text", "utf-8")).alias("data"), "mtime")
    got = store.archive_get(entries, docs.select(hex_id(F.col("doc_id")).alias("loc")))
    return store.archive_corpus(got, packed=True).select("loc", F.decode("content", "utf-8").alias("text"))


@_query("SELECT doc_id AS recno, CASE WHEN doctype = 'T' THEN 'new' ELSE loc END AS name, CASE WHEN doctype = 'T' THEN 1 ELSE mtime END AS mtime FROM documents")
def archive_set_info(spark, d):
    """Names and times changed for the plain texts among all entries."""
    docs = table(spark, d, "documents", "doc_id", "loc", "mtime", "doctype").withColumnRenamed("doc_id", "recno")
    changes = docs.where("doctype = 'T'").select("recno", F.lit("new").alias("name"), F.lit(1).alias("mtime"))
    return store.set_info(docs.select("recno", F.col("loc").alias("name"), "mtime"), changes)


@_query("SELECT doc_id AS recno, printf('%07x%08x', 0, doc_id * 512) AS code, CASE WHEN doctype = 'E' THEN NULL ELSE printf('%07x%08x', 1, doc_id * 512) END AS scanned FROM documents WHERE doctype IN ('E', 'H')")
def catalog_validate(spark, d):
    """Entries on which a doctored catalog and a scan disagree."""
    recno = F.col("doc_id")
    docs = table(spark, d, "documents", "doc_id", "doctype")
    cat = docs.select(recno.alias("recno"), store.catalog_code(F.lit(0), recno * 512).alias("code"))
    scan = docs.where("doctype <> 'E'").select(
        recno.alias("recno"), store.catalog_code(F.when(F.col("doctype") == "H", 1).otherwise(0), recno * 512).alias("code")
    )
    return store.validate(cat, scan)


@_query("SELECT doc_id AS recno, rpad(substr(loc, 1, 12), 16, ' ') AS record FROM documents WHERE loc IS NOT NULL")
def fixed_records(spark, d):
    """Records of one width."""
    docs = table(spark, d, "documents", "doc_id", "loc").where("loc is not null")
    return store.fixed(docs.select(F.col("doc_id").alias("recno"), F.substring("loc", 1, 12).alias("record")), 16)


# --- scalar functions


@_query("SELECT DISTINCT loc, list_reduce(list_prepend(5381::BIGINT, list_transform(range(1, length(loc) + 1), lambda i: ascii(substr(loc, i, 1))::BIGINT)), lambda h, c: xor(h * 33, c) & 4294967295) AS h FROM documents WHERE loc IS NOT NULL")
def cdb_hash(spark, d):
    """Bucket hash of every location."""
    return table(spark, d, "documents", "loc").where("loc is not null").select("loc", key_hash(F.col("loc")).alias("h")).distinct()


@_query("SELECT doc_id, printf('%08x', doc_id) AS hex, doc_id AS back FROM documents")
def hex_ids(spark, d):
    """Ids in hex and back."""
    docs = table(spark, d, "documents", "doc_id").withColumn("hex", hex_id(F.col("doc_id")))
    return docs.withColumn("back", from_hex(F.col("hex")))


@_query(f"SELECT DISTINCT query_id, {_STORED('q')} AS stored FROM queries WHERE q IS NOT NULL")
def width_fold(spark, d):
    """Queries in one width with blanks collapsed."""
    return table(spark, d, "queries", "query_id", "q").where("q is not null").select("query_id", stored(F.col("q")).alias("stored")).distinct()


# --- dictionaries


_DICT = "SELECT p_name AS reading, p_brand AS word, p_type AS pos FROM part"


@_query(f"SELECT DISTINCT * FROM ({_DICT} UNION ALL {_DICT} WHERE p_size <= 25)")
def dictionary_build(spark, d):
    """Union of word lists, each entry once."""
    p = table(spark, d, "part", "p_size", "p_name", "p_brand", "p_type")
    rows = lambda df: df.select(F.col("p_name").alias("reading"), F.col("p_brand").alias("word"), F.col("p_type").alias("pos"))
    return rows(p).unionByName(rows(p.where("p_size <= 25"))).dropDuplicates(["reading", "word", "pos"])


@_query(f"SELECT 'gone' AS change, * FROM ({_DICT} WHERE p_size <= 30 EXCEPT ALL {_DICT} WHERE p_size >= 10) UNION ALL SELECT 'new', * FROM ({_DICT} WHERE p_size >= 10 EXCEPT ALL {_DICT} WHERE p_size <= 30)")
def dictionary_diff(spark, d):
    """Entries that go and come between two word lists."""
    p = table(spark, d, "part", "p_size", "p_name", "p_brand", "p_type")
    rows = lambda part: p.where(part).select(F.col("p_name").alias("reading"), F.col("p_brand").alias("word"), F.col("p_type").alias("pos"))
    old, new = rows("p_size <= 30"), rows("p_size >= 10")
    gone = old.exceptAll(new).select(F.lit("gone").alias("change"), "*")
    return gone.unionByName(new.exceptAll(old).select(F.lit("new").alias("change"), "*"))
