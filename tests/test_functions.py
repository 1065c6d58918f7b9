"""Scalars and chunkers on strings whose result is known, and against plain forms."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lexarium.functions import dates, html, ids, text, urls
from lexarium.operators import chunk, clean, prepare, variants


def values(spark, column, rows, schema="x string"):
    df = spark.createDataFrame([(r,) for r in rows] if rows and not isinstance(rows[0], tuple) else rows, schema)
    return [r[0] for r in df.select(column.alias("out")).collect()]


def test_text(spark):
    x = F.col("x")
    given = ["a\r\n\r\n\r\n b \t c ", None, ""]
    assert values(spark, text.normalize(x), given) == ["a\n\nb c", None, ""] or values(spark, text.normalize(x), given)[1:] == [None, ""]
    assert values(spark, text.collapse(x), given) == ["a b c", None, ""]
    assert values(spark, text.tokens(x), ["Ünï_x C:\\a-b 3.5 ñ"]) == [["uni_x", "c", "\\a-b", "3.5", "n"]]
    assert values(spark, text.tidy_phrase(x), [" , hi  there . ok"]) == ["hi there. ok"]
    assert values(spark, text.markdown_title(x), ["\n## Title here\nmore"]) == ["Title here"]
    assert values(spark, text.truncate(x, 3), ["abcdef", "ab"]) == ["abc...[truncated]", "ab"]
    assert values(spark, text.safe_filename(x), ["a b/ç.pdf"]) == ["a_b__.pdf"]


def test_html(spark):
    page = "<html><head><title>A &amp; B</title><link rel='canonical' href='https://x.org/p'></head><body><nav>menu</nav><p>One</p><p>One</p><p>x</p><!-- c --><ul><li>FAQ</li><li>two&nbsp;2</li></ul></body></html>"
    x = F.col("x")
    assert values(spark, html.lines(x), [page]) == [["One", "two 2"]]
    assert values(spark, html.title(x), [page, "none"]) == ["A & B", None]
    assert values(spark, html.canonical_href(x), [page, ""]) == ["https://x.org/p", None]
    assert values(spark, html.unescape(x), ["&amp;lt;"]) == ["&lt;"]


def test_urls(spark):
    x = F.col("x")
    assert values(spark, urls.canonicalize(x), ["HTTPS://User@Ex.org:80/a/b//?q#f", "nope"]) == ["https://user@ex.org:80/a/b", None]
    assert values(spark, urls.host_label(x), ["www.big-data.org", "ft3.x.es", ""]) == ["Big Data".replace("Big", "BIG"), "FT3", None]
    assert values(spark, urls.forbidden_host(x), ["10.1.2.3", "localhost", "172.20.0.1", "172.32.0.1", "x.org", ""]) == [True, True, True, False, False, True]
    own = ["100.64.0.1", "100.128.0.1", "224.0.0.1", "::ffff:10.0.0.1", "[::1]", "fe80::1", "8.8.8.8", "198.51.100.7"]
    assert values(spark, urls.forbidden_host(x), own) == [True, False, True, True, True, True, False, True]
    shapes = ["https://github.com/a/b/blob/main/README.md?x#y", "https://github.com/a/b/wiki/Home", "https://gitlab.com/g/s/n/-/wikis/p/q", "https://github.com/a/b", "ftp://github.com/a/b/wiki"]
    shapes += ["https://github.com/a/b/blob/main/docs/README.md", "https://gitlab.org/g/n/-/wikis", "https://gitlab.com/n/-/wikis"]
    got = values(spark, urls.classify_repo(x), shapes)
    assert [(g.provider, g.doc_kind, g.repo_name) if g else None for g in got] == [("github", "readme", "b"), ("github", "wiki", "b"), ("gitlab", "wiki", "n"), *[None] * 5]
    assert got[0].doc_path == "README.md" and got[2].wiki_page_slug == "p/q" and got[2].repo_namespace == "g/s" and not got[1].is_wiki_root
    assert got[0].acquisition_url == "https://raw.githubusercontent.com/a/b/main/README.md"
    assert values(spark, urls.repo_problem(x), shapes) == [None, None, None, "shape", "scheme", "shape", "host", "shape"]
    paths = ["/a/./b/../c", "/../a", "/a/..", "/a/b/.", "/plain"]
    assert values(spark, urls.without_dots(x), paths) == ["/a/c", "/a", "/", "/a/b/", "/plain"]


def test_references_and_folds_equal_the_standard_library(spark):
    import html as standard
    import unicodedata

    rng, names = random.Random(1), list(standard.entities.html5)
    parts = lambda: rng.choice([f"&{rng.choice(names)}", f"&#{rng.randrange(0x11FFFF)};", f"&#x{rng.randrange(3000):x}", " ", "x", ";", "&", "amp;", "#"])
    given = ["&eacute;&#233;&hellip;", "&amp;lt;", "&notit; &copy2020 &ampx", "&#0;&#128;&#xD800;&#99999999;", "&#xFFFFFFFFFFFF;", *("".join(parts() for _ in range(8)) for _ in range(400))]
    assert values(spark, html.unescape(F.col("x")), given) == [standard.unescape(t) for t in given]
    texts = ["Ünï çödé ﬁ ½ ² é Ǆ ß ĳ ™ ａｂｃ ①", *("".join(chr(rng.randrange(0x21, 0x3000)) for _ in range(30)) for _ in range(300))]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    lowered = values(spark, F.lower("x"), texts)
    assert values(spark, text.unaccent(F.lower("x")), texts) == [plain(t) for t in lowered]


def test_ids(spark):
    x = F.col("x")
    given = ["BIG DATA", "bd", "Data Science Team", "Platform/Ops", "Aplicación", "x", "a" * 40, "a$b", None, "  "]
    assert values(spark, ids.department(x, True), given) == ["bigdata", "bigdata", "data_science_team", "platform_ops", "aplicaciones", "x", "a" * 40, "ab", None, None]
    assert values(spark, ids.department(x), given)[:5] == ["bigdata", "bigdata", None, None, "aplicaciones"]
    assert values(spark, ids.valid_department(x), given)[5:8] == [None, None, None]
    assert values(spark, ids.conversation_id(x), ["https://x/?id=12", "l"])[0] == "conv_12"
    rows = [("ticket", "5", None, None), ("html", "5", None, None), (None, None, "u?id=7", None), (None, None, None, "conv_9"), (None, None, None, "conv_x")]
    df = spark.createDataFrame(rows, "k string, t string, s string, c string")
    assert [r[0] for r in df.select(ids.ticket_group(F.col("k"), F.col("t"), F.col("s"), F.col("c"))).collect()] == ["ticket:5", None, "ticket:7", "ticket:9", None]
    linked = spark.createDataFrame([(None, "u?id=4"), (" ", "u?id=4"), ("s", "u?id=4"), ("t?id=5", "u?id=4")], "s string, l string")
    groups = linked.select(ids.ticket_group(F.lit("ticket"), F.lit(None), F.col("s"), F.lit(None).cast("string"), F.col("l")))
    assert [r[0] for r in groups.collect()] == ["ticket:4", "ticket:4", None, "ticket:5"]


def test_dates(spark):
    x = F.col("x")
    given = ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "02/01/2024", "2024-01-02", "garbage", ""]
    got = values(spark, dates.parse(x), given)
    assert got[1] == datetime(2024, 1, 2, 1, 4, 5) and got[3] == got[4] == datetime(2024, 1, 2) and got[5:] == [None, None]
    assert values(spark, dates.normalized(x), given)[5:] == ["garbage", None]
    now = datetime(2024, 1, 10)
    assert dates.window(datetime(2024, 1, 9), datetime(2024, 1, 8, 12), 48, now) == (datetime(2024, 1, 8, 12), now)
    assert dates.window(None, datetime(2020, 1, 1), 48, now)[0] == datetime(2020, 1, 1)
    assert dates.next_run(now, "weekly", 3, 0, 0) == datetime(2024, 1, 14, 3)
    assert dates.next_run(now, "interval", interval=timedelta(hours=1)) == now + timedelta(hours=1)
    with pytest.raises(ValueError):
        dates.window(None, now, 169, now)


def test_split_long_equals_plain_form(spark):
    rng = random.Random(1)
    texts = ["\n\n".join("x" * rng.choice([1, 10, 299, 300, 301, 599, 600, 601, 1500]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["", "a"]
    got = values(spark, chunk.split_long(F.col("x"), 600), texts)
    assert got == [chunk.split_text(t, 600) for t in texts]
    pages = values(spark, chunk.synthetic_pages(F.col("x"), 700, 900), texts)
    assert all(len(p) <= 900 for own in pages for p in own)
    assert ["".join(own).replace("\n", "") for own in pages] == [t.replace("\n", "") for t in texts]
    chunks = values(spark, chunk.page_chunks(F.col("x"), 500, 600, 120), texts)
    assert all(len(p) <= 600 for own in chunks for p in own)


def test_conversation_chunks():
    turns = [("user", "hello " * 20, None), ("user", "hello " * 20, None), ("comment", "answer " * 60, None), ("assistant", "z" * 1300, None), ("user", "bye", None)]
    out = chunk.chunk_conversation(turns)
    assert all(len(p.retrieval) <= 600 for _, p in out)
    assert out[0][1].retrieval.startswith("User: hello") and "Assistant: answer" in out[0][1].retrieval
    assert sum("User: hello" in p.retrieval for _, p in out) == 1
    assert chunk.chunk_conversation([]) == [] and chunk.chunk_conversation([("user", " ", None)]) == []
    # A single short turn is kept although it is below the least size.
    assert [p.retrieval for _, p in chunk.chunk_conversation([("user", "hi", None)])] == ["User: hi"]


def test_cleaning(spark):
    rows = [
        (1, "user", "fine\nOn Monday X wrote:\nold text"),
        (2, "user", "This transaction appears to have no content"),
        (3, "user", 'Greetings, This message has been automatically generated in response to the creation of a trouble ticket regarding: "Disk full", a summary of which appears below. There is no need to reply to this message right now. The disk is full'),
        (4, "comment", "<p>Hola Ana,</p><p>cierro este ticket.</p><p>Saludos</p>"),
        (5, "comment", "<div>the job failed with error 3 &amp; more</div>"),
        (6, "user", "AVISO DE CONFIDENCIALIDAD bla\nreal line\nOwner: me\n_________\nAVISO DE CONFIDENCIALIDAD error in /opt/x"),
        (7, "user", None),
    ]
    df = spark.createDataFrame(rows, "id int, role string, text string")
    got = {r.id: r for r in clean.clean_messages(df).collect()}
    assert got[1].content_clean == "fine" and got[2].content_clean == "" and got[2].content_raw == ""
    assert got[3].content_clean.startswith("Subject: Disk full") and "The disk is full" in got[3].content_clean and "automatically" not in got[3].content_clean
    assert got[4].content_clean == "" and got[5].content_clean == "the job failed with error 3 & more"
    # Phrase cleanup sees one line; without it lines are judged one by one.
    by_line = {r.id: r for r in clean.clean_messages(df, clean.Cleaning(phrases=False, replies=False)).collect()}
    assert by_line[6].content_clean == "real line\nOwner: me\nAVISO DE CONFIDENCIALIDAD error in /opt/x"
    assert {"signature_hint", "boilerplate", "separator_noise"} <= set(by_line[6].noise_flags)
    assert got[7].content_clean == ""
    plain = {r.id: r.content_clean for r in clean.clean_messages(df, clean.PASSTHROUGH).collect()}
    assert plain[2] == "This transaction appears to have no content"
    auto = {r.id: r.content_clean for r in clean.clean_messages(df, clean.AUTOREPLY).collect()}
    assert "old text" in auto[1] and auto[2] == ""


def test_variants():
    v = variants.variants("¿Qué es Slurm?")
    assert v[0] == ("¿Qué es Slurm?", 1.0, 1.0) and ("what is slurm", 0.95, 0.9) in v and len(v) <= 6
    assert ("python errors", 0.95, 0.95) in variants.variants("python failed")
    assert variants.rerank_queries("Mol") == ["Mol", "mol", "MOL"]
    assert variants.exact_token("the MOLPRO") == "molpro" and variants.exact_token("12345") is None and variants.exact_token("two words") is None
    fix = lambda w: {"swap": "swan"}.get(w)
    assert ("swan lake", 0.85, 1.0) in variants.variants("swap lake", fix)


def test_message_parsing():
    assert prepare.parse_messages('{"messages": "[{\\"role\\": \\"agent\\", \\"content\\": \\"x\\"}]"}') == [{"role": "assistant", "content": "x"}]
    assert prepare.parse_messages("{broken") == [{"role": "user", "content": "{broken"}]
    assert prepare.parse_messages({"question": "q", "answer": "a"}) == [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]
    assert prepare.parse_messages(None) == [] and prepare.parse_messages("  ") == []
    assert prepare.parse_messages({"role": "usuario", "content": " x "}) == [{"role": "user", "content": "x"}]
    assert prepare.parse_messages([{"query": "q", "response": "a"}, "plain", 5]) == [{"role": r, "content": t} for r, t in (("user", "q"), ("assistant", "a"), ("user", "plain"), ("user", "5"))]
    deep = "x"
    for _ in range(30):
        deep = [deep]
    assert prepare.parse_messages(deep) == [{"role": "user", "content": str(deep[0][0][0][0][0][0][0][0][0][0][0][0][0][0][0][0][0][0][0][0])}]
    assert prepare.row_messages({"messages": [], "thread": "t", "body": "b"}) == [{"role": "user", "content": "t"}]
    assert prepare.row_messages({"body": "b"}) == [{"role": "user", "content": "b"}] and prepare.row_messages({}) == []


def test_contract_errors_and_roles(spark):
    schema = "link string, updated string, messages array<struct<role:string,content:string>>, subject string"
    rows = [("l", "2024", None, "s"), (" ", " ", [("user", "a"), (None, "b"), None, ("", " ")], None), ("l", "2024", [], None), ("l", "2024", [], "s"), ("l", "2024", [(None, "x")] * 50, None)]
    df = spark.createDataFrame(rows, schema)
    errors = prepare.contract_errors(F.col("link"), F.col("updated"), F.col("messages"), F.col("subject"))
    got = [r[0] for r in df.select(errors).collect()]
    assert got[0] == ["'messages' must be a list"] and got[3] == []
    assert got[1] == ["missing/empty 'link'", "missing 'lastUpdated' or 'last_updated'", "messages[1].role missing/empty", "messages[2] must be an object"]
    assert len(got[2]) == 1 and got[2][0].startswith("row must contain") and len(got[4]) == 50
    assert [len(r[0]) for r in df.select(prepare.shown(errors)).collect()] == [1, 4, 1, 0, 40]
    assert values(spark, prepare.role(F.col("x")), ["Agent", "system", "usuario", "nobody", None]) == ["assistant", "system", "user", "user", "user"]
    kinds = spark.createDataFrame([("Comment", "a@org.es"), ("Correspond", "a@ORG.es"), ("Create", None)], "k string, a string")
    assert [r[0] for r in kinds.select(prepare.transaction_role(F.col("k"), F.col("a"), "org")).collect()] == ["comment", "assistant", "user"]


def test_noise_flags_and_stats(spark):
    rows = [
        (1, 1, "user", "fine\nOn Monday X wrote:\nold text"),
        (1, 2, "user", "This transaction appears to have no content"),
        (1, 3, "user", 'Greetings, This message has been automatically generated in response to the creation of a trouble ticket regarding: "Disk full", a summary of which appears below. The disk is full'),
        (1, 4, "comment", "<p>Hola Ana,</p><p>cierro este ticket.</p><p>Saludos</p>"),
        (2, 1, "user", " "),
        (2, 2, "user", "a line\n-----\nerror _______ here"),
    ]
    df = spark.createDataFrame(rows, "conv int, turn int, role string, text string")
    cleaned = clean.clean_messages(df).cache()
    got = {(r.conv, r.turn): r for r in cleaned.collect()}
    assert got[1, 1].noise_flags == ["ticketformater_reply_trim"] and got[1, 1].noise_stats.ticketformater_quote_reply_trims == 1
    assert got[1, 2].noise_flags == ["ticket_phrase_hard_drop", "ticket_phrase_removed_all"]
    assert {"ticket_phrase_header", "ticket_phrase_header_context"} <= set(got[1, 3].noise_flags) and got[1, 3].noise_stats.phrase_cleanup_header_replacements >= 2
    assert {"comment_role_cleanup", "comment_role_html", "comment_role_closure", "comment_role_removed_all"} == set(got[1, 4].noise_flags)
    assert got[2, 2].noise_stats.ticketformater_separator_line_trims == 1 and "protected_technical" in got[2, 2].noise_flags
    told = {r.conv: r for r in clean.conversation_totals(cleaned, "conv").collect()}
    assert (told[1].n_messages, told[1].messages_with_noise, told[2].empty_messages_skipped, told[2].n_messages) == (2, 2, 1, 1)
