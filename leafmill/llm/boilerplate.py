"""The main body of web pages, by paths that the pages of a host agree on.

Each page's containers are scored by the prose in them, and by whether they
hold the headline that the page's title names. A container is known by the
path of tags and classes that leads to it. Spark sums the votes of all pages of
a host; paths whose text is the same on page after page lose. The winning path
is then extracted from every page of the host that has it; elsewhere the page's
own best container counts. Without headline it needs prose to be an article.
Inside the container, parts of the host's template, such as adverts, have paths
of their own.
"""

from __future__ import annotations

import html as _html
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.session import cut, small, table

#: Tags that part blocks; those that hold text of an article; those never part of one; those without end.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre section select summary table"
    " tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset("p li ul ol dl dd dt h1 h2 h3 h4 h5 h6 blockquote pre center figure figcaption".split())
NEVER = frozenset("nav footer aside form header menu select button fieldset option label".split())
VOID = frozenset("br hr img input meta link base col wbr area source track embed param".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tr": {"tr", "td", "th"}, "option": {"option"},
}
_TOKEN = regex.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|noscript|iframe)\b[^>]*>(.*?)(?:</\1\s*>|\Z)|<!\[CDATA\[.*?\]\]>"
    r"|<[!?][^>]*>|<(/?)([A-Za-z][\w:-]*+)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][\w:-]*+)([^<>]*)>",
    regex.S | regex.I,
)
_NAME = regex.compile(r"\b(class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", regex.I)
_DIGITS = regex.compile(r"(?<![A-Za-z0-9])\d+(?![A-Za-z0-9])")
_BYLINE = regex.compile(r"[^.!?。]{0,60}\b\d{1,2}\.? \p{L}{3,12}\.? \d{4}|[^.!?。]{0,60}\b\d{4}[-/]\d\d[-/]\d\d")
_PROSE = regex.compile(r"[.!?…。！？؟।]")


class Block:
    """Text between two block tags, with the elements it stands in."""

    __slots__ = ("text", "linked", "where", "big")

    def __init__(self, text: str, linked: int, where: tuple, big: bool):
        self.text, self.linked, self.where, self.big = text, linked, where, big

    @property
    def tags(self) -> list[str]:
        return [e[1] for e in self.where]

    @property
    def links(self) -> bool:
        return 2 * self.linked > len(self.text)


@lru_cache(maxsize=50_000)
def _step(tag: str, attrs: str) -> str:
    """An element's step in a path: its tag with classes and id, lone numbers generalised."""
    step = tag
    for m in _NAME.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        mark = "." if m[1].lower() == "class" else "#"
        step += "".join(mark + _DIGITS.sub("0", v) for v in sorted(value.split()))
    return step


def parse(page: str) -> tuple[str, list[Block]]:
    """(title, blocks) of a page; sloppy nesting is mended as browsers do, roughly."""
    title, out = "", []
    stack: list[tuple[int, str, str]] = []  # number, tag, step
    text: list[str] = []
    linked, links, big, number, at = 0, 0, False, 0, 0

    def flush():
        nonlocal linked, big
        if text:
            body = " ".join(_html.unescape("".join(text)).split())
            if body:
                out.append(Block(body, min(linked, len(body)), tuple(stack), big))
            text.clear()
        linked, big = 0, False

    def add(part: str):
        nonlocal linked
        # Blanks between block tags are nothing; inside a block they part words.
        if part and (text or not part.isspace()):
            text.append(part)
            if links:
                linked += len(" ".join(_html.unescape(part).split()))

    def close(to: int):
        del stack[to:]

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if m[1]:
            if m[1].lower() == "title" and not title:
                title = " ".join(_html.unescape(m[2]).split())
            continue
        tag = (m[4] or m[7] or "").lower()
        if not tag:
            continue
        end, attrs = bool(m[3] or m[6]), m[5] or m[8] or ""
        if tag == "a":
            links = 0 if end else 1
            continue
        if tag == "font":
            big = big or not end
            continue
        if tag not in BLOCK:
            continue
        flush()
        if end:
            at_k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == tag), None)
            if at_k is not None and tag not in ("html", "body"):
                close(at_k)
            continue
        if tag in VOID or tag in ("html", "body"):
            continue
        while stack and stack[-1][1] in ({"p"} | HEADINGS):
            stack.pop()
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][1] in _CLOSES.get(tag, ()):
                close(k)
                break
            if stack[k][1] in ("ul", "ol", "dl", "table") or tag not in _CLOSES:
                break
        number += 1
        stack.append((number, tag, _step(tag, attrs)))
    add(page[at:])
    flush()
    return title, out


def _container(block: Block) -> int:
    """How many elements of a block's path lead to its container: those before the content tags at its end."""
    n = len(block.where)
    while n and block.where[n - 1][1] in CONTENT and "." not in block.where[n - 1][2] and "#" not in block.where[n - 1][2]:
        n -= 1
    return n


def _path(where: tuple, n: int) -> str:
    return ">".join(e[2] for e in where[:n])


def _headline(title: str, text: str) -> bool:
    return len(text) > 1 and (title == text or title.startswith(text) and not title[len(text)].isalnum())


class Container:
    """One element that directly holds article text, with its blocks."""

    def __init__(self, path: str, tags: list[str]):
        self.path, self.tags, self.blocks, self.titled = path, tags, [], False

    @property
    def score(self) -> float:
        """Prose outside links; a container with the headline counts many times."""
        if not NEVER.isdisjoint(self.tags):
            return 0.0
        total = 0.0
        for b in self.blocks:
            if not b.links and "©" not in b.text:
                total += len(b.text) if _PROSE.search(b.text) else 0.2 * len(b.text)
        return total * (8.0 if self.titled else 1.0)

    @property
    def prose(self) -> int:
        """Blocks of prose outside links."""
        return sum(not b.links and "©" not in b.text and _PROSE.search(b.text) is not None for b in self.blocks)


def containers(title: str, blocks: list[Block]) -> list[Container]:
    """The containers of a page in order; the page itself is one if text stands bare."""
    out: dict[int, Container] = {}
    for b in blocks:
        n = _container(b)
        key = b.where[n - 1][0] if n else 0
        c = out.get(key)
        if c is None:
            c = out[key] = Container(_path(b.where, n), [e[1] for e in b.where[:n]])
        first = not any(not x.links for x in c.blocks)
        c.titled |= _headline(title, b.text) and (first or b.big or (b.where and b.where[-1][1] in HEADINGS))
        c.blocks.append(b)
    return list(out.values())


def candidates(page: str | None) -> tuple[list[tuple], list[tuple]]:
    """(votes, articles) of a page.

    Votes are (path, score, titled, said), the best container of each path,
    where ``said`` is a hash of its prose without numbers. Articles are (path,
    score, titled, prose, bodies), the containers that hold the headline or
    prose, with their blocks less links, bylines and copyright lines.
    """
    if not page:
        return [], []
    found = [c for c in containers(*parse(page)) if c.score > 0]
    best: dict[str, Container] = {}
    for c in found:
        if c.path not in best or c.score > best[c.path].score:
            best[c.path] = c
    votes = []
    for c in best.values():
        said = _NUMBER.sub("0", " ".join(b.text for b in c.blocks if not b.links))
        votes.append((c.path, c.score, c.titled, xxhash.xxh64_intdigest(said) >> 1))
    return votes, [(c.path, c.score, c.titled, c.prose, _bodies(c)) for c in found if c.titled or c.prose]


_NUMBER = regex.compile(r"\d+")


def _bodies(container: Container) -> list[str]:
    out = []
    for b in container.blocks:
        tag = b.where[-1][1] if b.where else ""
        if not (b.links or "©" in b.text or (tag not in HEADINGS and _BYLINE.fullmatch(b.text))):
            out.append(b.text)
    return out


_PARSED = pa.schema([
    ("votes", pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64()), ("titled", pa.bool_()), ("said", pa.int64())]))),
    ("articles", pa.list_(pa.struct([("path", pa.string()), ("score", pa.float64()), ("titled", pa.bool_()), ("prose", pa.int32()), ("bodies", pa.list_(pa.string()))]))),
])
_PARSED_SQL = (
    "votes array<struct<path:string,score:double,titled:boolean,said:bigint>>,"
    " articles array<struct<path:string,score:double,titled:boolean,prose:int,bodies:array<string>>>"
)


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, votes, articles) of every page; each is parsed once."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                got = [candidates(x) for x in part.column(2).to_pylist()]
                votes = pa.array([[dict(zip(_VOTE, v)) for v in g[0]] for g in got], _PARSED.field(0).type)
                articles = pa.array([[dict(zip(_ARTICLE, v)) for v in g[1]] for g in got], _PARSED.field(1).type)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), votes, articles], names=["page_id", "host", "votes", "articles"]
                )

    return pages.select("page_id", "host", "html").mapInArrow(run, f"page_id bigint, host string, {_PARSED_SQL}")


_VOTE, _ARTICLE = ("path", "score", "titled", "said"), ("path", "score", "titled", "prose", "bodies")


def winning_paths(votes: DataFrame) -> DataFrame:
    """(host, path, agreed, fixed): of each host the container path with the most votes, ties by path.

    Takes (host, votes). Votes are the scores of all pages, times the share of
    pages on which the container says something else. ``agreed`` is true if the
    path says different things on different pages; ``fixed`` are paths that say
    the same on more than half of their pages. Sums and the approximate distinct count
    are combined before the shuffle, so one host may hold any share of the pages.
    """
    each = votes.where("host is not null").select("host", F.explode("votes").alias("v")).select("host", "v.*")
    sums = each.groupBy("host", "path").agg(
        F.sum("score").alias("score"),
        F.count("*").alias("pages"),
        F.approx_count_distinct("said", 0.02).alias("said"),
    )
    weight = F.col("score") * F.least(F.lit(1.0), F.col("said") / F.col("pages"))
    best = F.min(F.struct((-weight).alias("votes"), "path", "said")).alias("best")
    fixed = F.collect_list(F.when(F.col("said") * 2 < F.col("pages"), F.col("path"))).alias("fixed")
    return sums.groupBy("host").agg(best, fixed).select("host", "best.path", (F.col("best.said") > 1).alias("agreed"), "fixed")


def body_blocks(page: str | None, path: str | None) -> list[str]:
    """Texts of the article's blocks in order; none for null, empty and pages without article.

    ``path`` is the path that pages of the host agree on. Without one, or where
    the page doesn't have it, the page's own best container counts, if it holds
    the headline or several blocks of prose.
    """
    articles = [a for a in candidates(page)[1] if a[2] or a[3] > 1 or a[0] == path]
    return max(articles, key=lambda a: (a[0] == path, a[2], a[1]))[4] if articles else []


def article_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, body): the distinct blocks of each page's article.

    Null and empty pages give no rows; pages without url or host are extracted
    by their own best container. Repeated rows count once. Pages are parsed
    once; what is kept until the votes are counted is text and votes.
    """
    rows = pages.select("page_id", "url", "html").where("html is not null and html <> ''")
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)))
    rows = rows.withColumn("host", F.when(F.col("host") != "", F.col("host")))
    seen = cut(parsed(rows))
    winners = cut(winning_paths(seen.select("host", "votes")))
    todo = seen.where(F.size("articles") > 0).select("page_id", "host", "articles").join(small(winners), "host", "left")
    won = lambda a: a["path"].eqNullSafe(F.col("path"))
    said_often = lambda a: F.coalesce(F.array_contains("fixed", a["path"]), F.lit(False))
    is_article = lambda a: a["titled"] | (won(a) & F.col("agreed")) | ((a["prose"] > 1) & ~said_often(a))
    chosen = F.array_max(
        F.transform(
            F.filter("articles", is_article),
            lambda a: F.struct(won(a).alias("won"), a["titled"].alias("titled"), a["score"].alias("score"), a["bodies"].alias("bodies")),
        )
    )
    return todo.select("page_id", F.explode(chosen["bodies"]).alias("body")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problem 3 over all pages."""
    return article_bodies(table(spark, sf_dir, "pages", "page_id", "url", "html"))
