"""Mail queries over mails with any header or none, against brute force."""

from leafmill.queries import QUERIES
from leafmill.sources import readers

TEXTS = [
    "From: ann@a.example\nSubject: The harbor\nMessage-ID: <1@a>\n\nBody one.",
    "No header at all, only a body. Here it ends.",
    "\nTo: late@a.example\n\nA blank line comes first.",
    "From ann Mon Jan  2 03:04:05 2023\nFrom: box@b.example\nSubject: Old harbor\nReferences: <1@a>\n\nFrom a mailbox.",
    "subject: lower harbor\nfrom: low@c.example\nin-reply-to: <1@a>\n\nLower-case header.",
    "From:\u2009thin@d.example\n\nA thin blank.",
    "",
    None,
]


def test_every_mail_counts(spark, table_dir):
    rows = [(k, t, "E", f"/m/{k}", 100 + k) for k, t in enumerate(TEXTS, 1)] + [(99, TEXTS[0], "T", "/m/99", 5)]
    d = table_dir(spark, documents=(rows, "doc_id bigint, text string, doctype string, loc string, mtime int"))
    got = lambda name: sorted(tuple(r) for r in QUERIES[name if name == "mail_subject_search" else f"{name}_all"](spark, d).collect())
    want = {k: readers.mail(t) for k, t in enumerate(TEXTS, 1) if t is not None}
    assert {r[0] for r in got("mail_info")} == {r[0] for r in got("mail_parts")} == set(want)
    assert {r["doc_id"]: (r["title"], r["mtime"]) for r in QUERIES["mail_info_all"](spark, d).collect()} == {
        k: (m["title"], m["date"] or 100 + k) for k, m in want.items()
    }
    assert got("mail_parts") == sorted((k, *p) for k, m in want.items() for p in m["parts"])
    bodies = {r[0]: r[3] for r in got("mail_parts")}
    assert bodies[2] == TEXTS[1] and "A blank line comes first." in bodies[3] and bodies[4] == "From a mailbox."
    assert got("mail_headers") == sorted((k, h) for k, m in want.items() for h in m["headers"])
    assert got("mail_features") == [(1, "msgid", "1@a"), (4, "ref", "1@a"), (5, "reply", "1@a")]
    assert got("mail_subject_search") == [(1,), (4,), (5,)]
    assert got("mail_sender_search") == [(1,), (4,), (5,), (6,)]
    assert got("mail_thread") == [(1, "/m/1"), (4, "/m/4"), (5, "/m/5")]
