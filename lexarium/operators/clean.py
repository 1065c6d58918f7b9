"""Message cleaning: quoted replies, ticket phrases, comment closures and noise lines, as Column chains."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexarium.functions import html
from lexarium.functions.text import TECHNICAL, collapse, normalize, strip, tidy_phrase

# Markers after which a message quotes another, and before which a form letter stands.
REPLY_MARKERS = ("escribiu:\n", "escribió:\n", "wrote:\n", "De: ", "From: ")
CREATE_MARKERS = ("* Descripcion:",)
TICKET_URL_LINE = r"(?im)^\s*<URL:\s*https?://\S+/Ticket/Display\.html\?id=\d+\s*>\s*$"
SEPARATOR_LINE = r"(?m)^\s*[-_]{3,}\s*$"
HEADER_CONTEXT = (
    r"(?i)(?:greetings,\s*)?this message has been automatically generated in response to the creation of a trouble ticket regarding:"
)
# Configured patterns.
CLOSURES = (
    r"(?i)\bpecho\s+este\s+ticket\b",
    r"(?i)\bcierro\s+este\s+ticket\b",
    r"(?i)\bcerramos\s+este\s+ticket\b",
    r"(?i)\bte\s+cierro\s+este\s+ticket\b",
)
SIGNATURE_LINES = (r"(?i)^\s*(?:_{5,}|-{8,})\s*$",)
TRIVIAL = (
    r"(?i)^\s*(?:ok!?|de acuerdo|gracias(?:\s+por\s+la\s+confirmaci[oó]n)?[!.]*)\s*$",
    r"(?i)^\s*(?:saludos,?|un saludo,?|best regards,?|kind regards,?)\s*$",
    r"(?i)^\s*cualquier cosa nos dec[ií]s[,.! ]*$",
    r"(?i)^\s*si tienes alguna duda o problema no dudes en contactar con nosotros[,.! ]*$",
    r"(?i)^\s*(?:entonces|hola(?:\s+[A-ZÁÉÍÓÚÑ][\wÁÉÍÓÚÑáéíóúñ.-]+)?[,.!]*)\s*$",
)
HARD_DROPS = (
    r"(?i)This transaction appears to have no content",
    r"(?i)Output other",
    r"(?i)This ticket has been created by (?:\[[A-Z]+\]|[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}), who has put you as Cc so you can follow it\.",
    r"(?i)We are sorry if you got notified about this twice\.",
    r"(?i)To access this ticket, click:\s*https?://\S+",
)
HEADERS = (
    r"(?i)Greetings, This message has been automatically generated in response to the creation of a trouble ticket regarding:",
    r"(?i)This message has been automatically generated in response to the creation of a trouble ticket regarding:",
    r"(?i)a summary of which appears below\.",
    r"(?i)There is no need to reply to this message right now\.",
    r"(?i)Your ticket has been assigned an ID of \[[^\]]+\]\.",
    r"(?i)Please include the string:\s*\[[^\]]+\]\s*in the subject line of all future correspondence about this issue\.",
    r"(?i)To do so, you may reply to this message\.",
    r"(?i)Thank you,",
)
PRESERVED = (r'(?i)regarding:\s*"[^"]+"', r"(?i)subject:\s*[^\n]+")
BOILERPLATE = (
    r"(?i)^\s*Requestor:",
    r"(?i)^\s*AddRequestor:",
    r"(?i)^\s*Owner:",
    r"(?i)^\s*Status:",
    r"(?i)^\s*CF\.\{",
    r"(?i)This message has been automatically generated in response to the creation of a trouble ticket",
    r"(?i)There is no need to reply to this message right now",
    r"(?i)Your ticket has been assigned an ID of",
    r"(?i)Please include the string:",
    r"(?i)This transaction appears to have no content",
    r"(?i)^\s*>+\s*",
    r"(?i)^\s*\*\s*CC\s+a\s+correo:",
    r"(?i)Para mas información entar en el siguiente link",
)
DROP_LINES = (
    r"(?i)^--$",
    r"(?i)^AVISO DE CONFIDENCIALIDAD",
    r"(?i)^This message.*confidential",
    r"(?i)^Please consider the environment",
    r"(?i)^El .* via RT <",
    r"(?i)^On .* via RT <",
    r"(?i)^-----Original Message-----",
    r"(?i)^-----Mensaje original-----",
)
#: What breaks or leaves a comment's HTML, in order, and what stands there instead.
COMMENT_BREAKS = (
    (r"(?is)<\s*(?:br\s*/?|/p|/div|/li|/tr|/ul|/ol|/table|hr)\s*>|<\s*(?:p|div|li|tr|ul|ol|table)\b[^>]*>", "\n"),
    (r"(?is)<[^>]+>", " "),
    (r"(?i)([.!?])\s+(saludos,?|un saludo,?|best regards,?|kind regards,?)\b", "$1\n$2"),
    (r"(?i)\s+--\s+(?=[A-ZÁÉÍÓÚÑ_])", "\n--\n"),
    (r"(?i)\s+(?=(?:tel\.?|phone|fax|e-?mail)\b)", "\n"),
)
DOWNLOAD_REPLY = ("escribiu:\n", "escribio:\n", "wrote:\n", "de: ", "from: ")
DOWNLOAD_CREATE = ("* descripcion:",)
SIGNATURE_HINT = r"(?i)(aviso de confidencialidad)"
SEPARATOR_NOISE = r"[\\/]{5,}|[_-]{6,}"


@dataclass(frozen=True)
class Cleaning:
    """What a cleaning mode does; ``PASSTHROUGH`` only normalises, ``AUTOREPLY`` only treats ticket phrases."""

    passthrough: bool = False
    comments: bool = True
    replies: bool = True
    phrases: bool = True
    lines: bool = True
    drop_boilerplate: bool = False
    protect_technical: bool = True
    create_markers: tuple[str, ...] = CREATE_MARKERS


FULL = Cleaning()
PASSTHROUGH = Cleaning(passthrough=True)
AUTOREPLY = Cleaning(comments=False, replies=False, lines=False)


def let(c: Column, body) -> Column:
    """``body`` of a column that is computed once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def any_match(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.regexp_like(c, F.lit(p))
    return out


def total_count(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(c, F.lit(p))
    return out


def replaced(c: Column, patterns: tuple[str, ...], to: tuple[str, ...] | str = " ") -> Column:
    """Struct (text, n): the patterns replaced one after the other, and how often."""

    def step(p: str, shown: str):
        return lambda x: F.struct(F.regexp_replace(x["text"], p, shown).alias("text"), (x["n"] + F.regexp_count(x["text"], F.lit(p))).alias("n"))

    state = F.struct(c.alias("text"), F.lit(0).alias("n"))
    for p, shown in zip(patterns, (to,) * len(patterns) if isinstance(to, str) else to, strict=True):
        state = let(state, step(p, shown))
    return state


def reply_trims(c: Column, create_markers: tuple[str, ...] = CREATE_MARKERS) -> Column:
    """Struct (text, quote_reply, create_header, rt_url_line, separator_line).

    The text is without quoted tails (the marker's own line goes too), form heads, ticket url lines and separators; the
    others count what was cut.
    """

    def cut(m: str, part: int, edge: str, counts: tuple[int, int]):
        def step(x: Column) -> Column:
            has = F.contains(x["text"], F.lit(m))
            return F.struct(
                F.when(has, F.regexp_replace(F.substring_index(x["text"], m, part), edge, "")).otherwise(x["text"]).alias("text"),
                (x["quote_reply"] + has.cast("int") * counts[0]).alias("quote_reply"),
                (x["create_header"] + has.cast("int") * counts[1]).alias("create_header"),
            )

        return step

    def lines(x: Column) -> Column:
        bare = F.regexp_replace(x["text"], TICKET_URL_LINE, "")
        return F.struct(
            normalize(F.regexp_replace(bare, SEPARATOR_LINE, "")).alias("text"), x["quote_reply"].alias("quote_reply"), x["create_header"].alias("create_header"),
            F.regexp_count(x["text"], F.lit(TICKET_URL_LINE)).alias("rt_url_line"), F.regexp_count(bare, F.lit(SEPARATOR_LINE)).alias("separator_line"),
        )

    state = F.struct(c.alias("text"), F.lit(0).alias("quote_reply"), F.lit(0).alias("create_header"))
    for m in REPLY_MARKERS:
        state = let(state, cut(m, 1, r"\n?[^\n]*\z", (1, 0)))
    for m in create_markers:
        state = let(state, cut(m, -1, r"\A[^\n]*\n?", (0, 1)))
    return let(state, lines)


def trim_replies(c: Column, create_markers: tuple[str, ...] = CREATE_MARKERS) -> Column:
    return reply_trims(c, create_markers)["text"]


def downloaded(c: Column, ticket: Column, markers: tuple[str, ...] = DOWNLOAD_REPLY, create_markers: tuple[str, ...] = DOWNLOAD_CREATE, base: str = "") -> Column:
    """A message as the ticket system gives it: cut at the first reply marker in any case that does not start it, form heads and
    the link to its own ticket (below ``base``) and separator lines gone."""

    def before(m: str):
        return lambda x: F.when(F.locate(m, F.lower(x)) > 1, F.substr(x, F.lit(1), F.locate(m, F.lower(x)) - 1)).otherwise(x)

    def after(m: str):
        def step(x: Column) -> Column:
            at = F.locate(m, F.lower(x))
            tail = F.ltrim(F.substr(x, at + len(m)), F.lit("\n "))
            return F.when((at > 0) & (tail != ""), tail).otherwise(x)

        return step

    c = F.replace(F.replace(html.unescape(F.coalesce(c, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    for step in (*map(before, markers), *map(after, create_markers)):
        c = let(c, step)
    if base:
        c = F.replace(c, F.concat(F.lit(f"\n<URL: {base}/Ticket/Display.html?id="), ticket.cast("string"), F.lit(" >\n\n")), F.lit(""))
    return strip(F.regexp_replace(F.regexp_replace(c, SEPARATOR_LINE, ""), r"\n{3,}", "\n\n"))


def comment_html(c: Column) -> Column:
    """Struct (text, n): HTML of a comment as lines, broken before closings, signatures and contact details; how often that did something."""
    plain = F.replace(html.unescape(c), F.lit("\u00a0"), F.lit(" "))
    broken = replaced(plain, tuple(p for p, _ in COMMENT_BREAKS), tuple(to for _, to in COMMENT_BREAKS))
    return let(broken, lambda x: F.struct(tidy_phrase(x["text"]).alias("text"), x["n"].alias("n")))


def sift(c: Column, patterns: tuple[str, ...]) -> Column:
    """Struct (text, n): trimmed lines that are not blank and match none of the patterns, and how many do."""
    lines = F.filter(F.transform(F.split(c, "\n"), normalize), lambda x: x != "")
    told = F.transform(lines, lambda x: F.struct(x.alias("line"), any_match(x, patterns).alias("cut")))
    return let(
        told,
        lambda t: F.struct(
            F.array_join(F.transform(F.filter(t, lambda x: ~x["cut"]), lambda x: x["line"]), "\n").alias("text"), F.size(F.filter(t, lambda x: x["cut"])).alias("n")
        ),
    )


def comment_cleanup(c: Column) -> Column:
    """Struct (text, html_normalized, signature_lines, closures, removed_all) of a comment.

    Signature lines and closing phrases are cut; the text is empty if little but a closing was in it.
    """

    def signed(made: Column) -> Column:
        touched = (made["n"] > 0) | (made["text"] != normalize(c))
        return let(
            sift(made["text"], SIGNATURE_LINES),
            lambda kept: let(
                replaced(kept["text"], CLOSURES),
                lambda bare: let(
                    F.when(bare["n"] > 0, sift(tidy_phrase(bare["text"]), TRIVIAL)).otherwise(F.struct(tidy_phrase(bare["text"]).alias("text"), F.lit(0).alias("n"))),
                    lambda rest: judged(touched, kept["n"], bare["n"] + rest["n"], tidy_phrase(rest["text"])),
                ),
            ),
        )

    def judged(touched: Column, signatures: Column, closures: Column, rest: Column) -> Column:
        words = F.size(F.filter(F.split(rest, r"\s+"), lambda x: x != ""))
        gone = (rest == "") | ((closures > 0) & (words <= 12) & ~F.regexp_like(rest, F.lit(TECHNICAL)))
        return F.struct(
            F.when(gone, "").otherwise(rest).alias("text"), touched.cast("int").alias("html_normalized"), signatures.alias("signature_lines"),
            closures.alias("closures"), gone.cast("int").alias("removed_all"),
        )

    return let(comment_html(c), signed)


def clean_comment(c: Column) -> Column:
    return comment_cleanup(c)["text"]


def preserved_fragments(c: Column) -> Column:
    """Subjects named in a ticket's head, in order, without repeats in another case."""
    found = F.concat(*[F.regexp_extract_all(c, F.lit(p), F.lit(0)) for p in PRESERVED])
    bare = F.transform(found, lambda x: F.regexp_replace(normalize(F.regexp_replace(normalize(x), r"(?i)^(?:regarding|subject):", "")), r"^[\"' ]+|[\"' ]+$", ""))
    return F.aggregate(
        F.filter(bare, lambda x: x != ""),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )


def without_leading(c: Column, fragment: Column) -> Column:
    """Without a fragment in front, quoted, named or bare."""
    quoted = F.concat(F.lit(r"\Q"), fragment, F.lit(r"\E"))
    out = F.lit(None).cast("string")
    shapes = (("^\\s*\"", "\""), ("^\\s*'", "'"), ("(?i)^\\s*subject:\\s*", ""), ("(?i)^\\s*regarding:\\s*\"?", "\"?"), ("^\\s*", ""))
    for before, after in reversed(shapes):
        pattern = F.concat(F.lit(before), quoted, F.lit(after + r"\s*,?\s*"))
        out = F.when(F.regexp_like(c, pattern), F.regexp_replace(c, pattern, F.lit(""))).otherwise(out)
    return let(F.coalesce(out, c), tidy_phrase)


def phrase_cleanup(c: Column) -> Column:
    """Struct (text, hard, headed, header, removed_all): form phrases cut; a form head's subjects come first as ``Subject:`` lines.

    ``hard`` and ``header`` count what was cut, ``headed`` tells whether the text has a form's head.
    """

    def headless(x: Column) -> Column:
        headed = F.regexp_like(x["text"], F.lit(HEADER_CONTEXT))
        return let(
            replaced(x["text"], HEADERS),
            lambda bare: F.struct(
                F.when(headed, named(preserved_fragments(c), tidy_phrase(bare["text"]))).otherwise(x["text"]).alias("text"),
                x["n"].alias("hard"), headed.alias("headed"), F.when(headed, bare["n"]).otherwise(0).alias("header"),
            ),
        )

    def named(fragments: Column, bare: Column) -> Column:
        return let(
            F.struct(fragments.alias("fragments"), F.aggregate(fragments, bare, without_leading).alias("bare")),
            lambda y: F.array_join(
                F.filter(
                    F.concat(
                        F.transform(F.filter(y["fragments"], lambda f: ~F.contains(F.lower(y["bare"]), F.lower(f))), lambda f: F.concat(F.lit("Subject: "), f)),
                        F.array(y["bare"]),
                    ),
                    lambda f: f != "",
                ),
                "\n",
            ),
        )

    def judged(x: Column) -> Column:
        def told(t: Column) -> Column:
            probe = F.regexp_replace(F.regexp_replace(t, r"(?i)<URL:\s*https?://[^>]+>", " "), r"(?i)https?://\S+", " ")
            probe = strip(F.regexp_replace(F.regexp_replace(probe, r"\[[A-Z]+\]", " "), r"[<>{}()\[\],.:;!?\-_/\\]+", " "))
            gone = (x["hard"] + x["header"] > 0) & (probe == "")
            return F.struct(
                F.when(gone, "").otherwise(t).alias("text"), x["hard"].alias("hard"), x["headed"].alias("headed"), x["header"].alias("header"), gone.alias("removed_all")
            )

        return let(tidy_phrase(x["text"]), told)

    return let(let(replaced(collapse(c), HARD_DROPS), headless), judged)


def clean_phrases(c: Column) -> Column:
    """Struct (text, replaced, removed) of ``phrase_cleanup``."""
    return let(phrase_cleanup(c), lambda x: F.struct(x["text"].alias("text"), (x["hard"] + x["header"]).alias("replaced"), x["removed_all"].alias("removed")))


def line_reasons(line: Column) -> Column:
    """Struct of what marks a line as noise, and whether it is technical."""
    return F.struct(
        line.alias("line"),
        F.regexp_like(line, F.lit(SIGNATURE_HINT)).alias("signature_hint"),
        F.regexp_like(line, F.lit(SEPARATOR_NOISE)).alias("separator_noise"),
        any_match(line, DROP_LINES).alias("legacy_drop_pattern"),
        any_match(line, BOILERPLATE).alias("boilerplate"),
        F.regexp_like(line, F.lit(TECHNICAL)).alias("technical"),
    )


def noise_lines(c: Column) -> Column:
    """``line_reasons`` of all lines that are not blank."""
    return F.transform(F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != ""), line_reasons)


def is_hard(x: Column) -> Column:
    return x["signature_hint"] | x["separator_noise"] | x["legacy_drop_pattern"]


def drop_noise_lines(lines: Column, mode: Cleaning = FULL) -> Column:
    def kept(x: Column) -> Column:
        noise = is_hard(x) | (x["boilerplate"] if mode.drop_boilerplate else F.lit(False))
        return ~noise | (x["technical"] if mode.protect_technical else F.lit(False))

    return F.array_join(F.transform(F.filter(lines, kept), lambda x: x["line"]), "\n")


#: What is counted of a message's cleaning.
STATS = (
    "noise_candidates", "protected_technical", "dropped_hard_noise", "dropped_boilerplate", "kept_tagged",
    "phrase_cleanup_candidates", "phrase_cleanup_replacements", "phrase_cleanup_header_replacements", "phrase_cleanup_removed_all_content",
    "comment_role_html_normalized", "comment_role_signature_lines_removed", "comment_role_closure_replacements", "comment_role_removed_all_content",
    "ticketformater_quote_reply_trims", "ticketformater_create_header_trims", "ticketformater_rt_url_line_trims", "ticketformater_separator_line_trims",
)
CLEANED = ("content_clean", "content_retrieval", "content_raw", "noise_flags", "noise_stats", "retrieval_fallback_used")


def line_stats(lines: Column, mode: Cleaning) -> dict[str, Column]:
    """Counts of a text's noisy lines by what becomes of them."""
    noisy = lambda x: is_hard(x) | x["boilerplate"]
    safe = lambda x: x["technical"] if mode.protect_technical else F.lit(False)
    count = lambda test: F.size(F.filter(lines, lambda x: noisy(x) & test(x)))
    soft = lambda x: ~safe(x) & ~is_hard(x)
    return {
        "noise_candidates": count(lambda x: F.lit(True)),
        "protected_technical": count(safe),
        "dropped_hard_noise": count(lambda x: ~safe(x) & is_hard(x)),
        "dropped_boilerplate": count(soft) if mode.drop_boilerplate else F.lit(0),
        "kept_tagged": F.lit(0) if mode.drop_boilerplate else count(soft),
    }


def clean_messages(messages: DataFrame, mode: Cleaning = FULL, text: str = "text", role: str = "role") -> DataFrame:
    """``messages`` with the columns ``CLEANED``; ``noise_stats`` is a struct of the counts ``STATS``.

    A message that cleaning empties falls back to its trimmed original, unless phrase or comment cleanup
    has shown that it holds nothing else. Each step is a column of its own, so that no step is computed twice.
    """
    c = F.col
    out = messages.withColumn("_text", normalize(F.coalesce(text, F.lit(""))))
    none = F.array().cast("array<string>")
    if mode.passthrough:
        zeros = F.struct(*[F.lit(0).alias(n) for n in STATS])
        values = (c("_text"), c("_text"), c("_text"), none, zeros, F.lit(False))
        return out.withColumns(dict(zip(CLEANED, values, strict=True))).drop("_text")
    comment = F.coalesce(F.col(role) == "comment", F.lit(False))
    numbers = ("html_normalized", "signature_lines", "closures", "removed_all")
    untold = F.struct(c("_text").alias("text"), *[F.lit(0).alias(n) for n in numbers])
    out = out.withColumn("_told", F.when(comment, comment_cleanup(c("_text"))).otherwise(untold) if mode.comments else untold)
    plain = F.struct(normalize(c("_told.text")).alias("text"), *[F.lit(0).alias(n) for n in ("quote_reply", "create_header", "rt_url_line", "separator_line")])
    trimmed = F.when(comment, plain).otherwise(reply_trims(normalize(c("_told.text")), mode.create_markers))
    out = out.withColumn("_original", trimmed if mode.replies else plain)
    same = F.struct(c("_original.text").alias("text"), F.lit(0).alias("hard"), F.lit(False).alias("headed"), F.lit(0).alias("header"), F.lit(False).alias("removed_all"))
    out = out.withColumn("_phrases", phrase_cleanup(c("_original.text")) if mode.phrases else same)
    out = out.withColumn("_lines", noise_lines(c("_phrases.text")))
    out = out.withColumn("_clean", drop_noise_lines(c("_lines"), mode) if mode.lines else normalize(c("_phrases.text")))
    gone = c("_phrases.removed_all") | (c("_told.removed_all") > 0)
    out = out.withColumn("content_raw", F.when(gone, "").otherwise(c("_original.text")))
    out = out.withColumn("retrieval_fallback_used", (c("_clean") == "") & (c("content_raw") != ""))
    out = out.withColumn("content_retrieval", F.when(c("retrieval_fallback_used"), c("content_raw")).otherwise(c("_clean")))
    both = c("_phrases.hard") + c("_phrases.header")
    counts = line_stats(c("_lines"), mode) if mode.lines else {n: F.lit(0) for n in STATS[:5]}
    counts |= dict(zip(STATS[5:9], (both, both, c("_phrases.header"), c("_phrases.removed_all").cast("int")), strict=True))
    counts |= dict(zip(STATS[9:13], (c(f"_told.{n}") for n in numbers), strict=True))
    counts |= dict(zip(STATS[13:], (c(f"_original.{n}") for n in ("quote_reply", "create_header", "rt_url_line", "separator_line")), strict=True))
    out = out.withColumn("noise_stats", F.struct(*[counts[n].cast("int").alias(n) for n in STATS]))
    noisy = lambda r: F.exists("_lines", lambda x: x[r])
    n = lambda name: c(f"noise_stats.{name}") > 0
    told = {
        **({r: noisy(r) for r in ("signature_hint", "separator_noise", "legacy_drop_pattern", "boilerplate")} if mode.lines else {}),
        "protected_technical": n("protected_technical"),
        "ticket_phrase_hard_drop": c("_phrases.hard") > 0,
        "ticket_phrase_header_context": c("_phrases.headed"),
        "ticket_phrase_header": n("phrase_cleanup_header_replacements"),
        "ticket_phrase_removed_all": c("_phrases.removed_all"),
        "comment_role_cleanup": comment if mode.comments else F.lit(False),
        "comment_role_html": n("comment_role_html_normalized"),
        "comment_role_signature": n("comment_role_signature_lines_removed"),
        "comment_role_closure": n("comment_role_closure_replacements"),
        "comment_role_removed_all": n("comment_role_removed_all_content"),
        "ticketformater_reply_trim": n("ticketformater_quote_reply_trims"),
        "ticketformater_create_trim": n("ticketformater_create_header_trims"),
        "ticketformater_url_trim": n("ticketformater_rt_url_line_trims"),
        "ticketformater_separator_trim": n("ticketformater_separator_line_trims"),
    }
    flags = F.array_sort(F.array_compact(F.array(*[F.when(test, name) for name, test in told.items()])))
    out = out.withColumn("noise_flags", flags).withColumn("content_clean", c("content_retrieval"))
    return out.drop("_text", "_told", "_original", "_phrases", "_lines", "_clean")


def conversation_totals(cleaned: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Of each conversation of ``clean_messages`` rows: messages kept, empty ones, noisy ones, fallbacks and the sums of ``STATS``.

    Empty messages, and those of which nothing is left, count in no other number.
    """
    blank = normalize(F.coalesce(text, F.lit(""))) == ""
    kept = ~blank & ((F.col("content_retrieval") != "") | (F.col("content_raw") != ""))
    return cleaned.groupBy(key).agg(
        F.count_if(kept).alias("n_messages"),
        F.count_if(blank).alias("empty_messages_skipped"),
        F.count_if(kept & (F.size("noise_flags") > 0)).alias("messages_with_noise"),
        F.count_if(kept & F.col("retrieval_fallback_used")).alias("retrieval_fallback_used"),
        *[F.sum(F.when(kept, F.col(f"noise_stats.{n}")).otherwise(0)).alias(n) for n in STATS],
    )
