from pyspark.sql import functions as F

from leafmill.llm.boilerplate import article_bodies, body_blocks, containers, parse


def page(k, body, host="a"):
    nav = "<nav><ul><li><a href=/1>Home page<li><a href=/2>About us</a></ul></nav>"
    foot = "<div class=f><p>All rights belong to the owners of this site. They always have.</p><p>&copy; 2020</p></div>"
    return (k, f"http://{host}.example/{k}", f"<html><head><title>Story {k} &amp; more - Site</title><script>var p='<p>no</p>'</script></head><body>{nav}{body}{foot}")


def story(k):
    return (
        f"<div id=main><h1>Story <b>{k}</b> &amp; more</h1><div class=by>Ann, 3 May 2020</div><p>The river {k} rose. It fell."
        f"<p>A second\n paragraph {k}.<br>After a break.<ul><li>one {k}<li>two</ul><div class=ad>Buy this now.</div><blockquote>Said {k}.</blockquote></div>"
    )


WANT = ["Story {k} & more", "The river {k} rose. It fell.", "A second paragraph {k}.", "After a break.", "one {k}", "two", "Said {k}."]


def test_hosts_vote(spark):
    rows = [page(k, story(k)) for k in range(6)]
    rows += [page(6, "")] + [(7, None, rows[0][2]), (8, "http://a.example/8", None), (9, "http://a.example/9", ""), (10, "", rows[1][2])]
    rows += rows[:2]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("path", F.lit("x")).withColumn("host", F.lit("y"))
    got = {}
    for r in article_bodies(df).collect():
        got.setdefault(r["page_id"], set()).add(r["body"])
    want = {k: {w.format(k=k) for w in WANT} for k in range(6)}
    assert got == want | {7: want[0], 10: want[1]}


def test_sloppy():
    assert [b.text for b in parse("<p>a<p>b<li>c<td>d")[1]] == ["a", "b", "c", "d"]
    assert parse("<title>T &lt; U</title><!-- <p>x</p> -> --><style>p{}</style>y<")[1][0].text == "y<"
    assert parse("") == ("", []) and body_blocks(None, None) == [] and body_blocks("x" * 10**6, None) == []
    assert [b.text for b in parse("<P CLASS='a>b'>x</P>")[1]] == ["x"]


def test_links_are_no_article():
    title, blocks = parse("<title>A b</title><div><a href=x>A b</a></div><main><h2>A b</h2><p>Text is here.</p></main>")
    assert max(containers(title, blocks), key=lambda c: c.score).path == "main"


def test_empty(spark):
    assert article_bodies(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_title_is_only_a_vote(spark):
    """Pages without title, or with one that doesn't begin with the headline, are extracted by the host's path or their prose."""
    words = "ash birch cedar dogwood elm fir ginkgo hazel ivy".split()  # numbers alone don't make texts differ

    def bare(k, body, host, title=""):
        k, url, html = page(k, body, host)
        return k, url, html.replace(f"<title>Story {k} &amp; more - Site</title>", title)

    rows = [page(k, story(words[k]))[:2] + (page(k, story(words[k]))[2].replace(f"<title>Story {k}", f"<title>Story {words[k]}"),) for k in range(3)]
    rows += [bare(3, story("fir"), "a"), bare(4, story("elm"), "a", "<title>Site | Story elm</title>")]
    rows += [bare(k, story(words[k]), "b") for k in (5, 6, 7)]
    rows += [bare(8, "<div id=main><p>Only one paragraph here.</div>", "a"), (20, None, rows[5][2])]
    rows += [bare(k, "", "a") for k in (21, 22, 23)]
    got = {}
    for r in article_bodies(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect():
        got.setdefault(r["page_id"], set()).add(r["body"])
    said = dict(enumerate(words[:3])) | {3: "fir", 4: "elm"} | {k: words[k] for k in (5, 6, 7)} | {20: words[5]}
    assert got == {k: {w.format(k=v) for w in WANT} for k, v in said.items()} | {8: {"Only one paragraph here."}}
