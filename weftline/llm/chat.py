"""Quotation linking: nested quotes of messages are joined to the messages they come from and taken out of the text.

A line's quote level is the number of > at its start. Neighbouring lines of one level are a passage. Passages, and their single
lines and sentences of some length, are normalised and hashed; the first message of the same conversation whose own words hash
alike is the original: a message's units are all of it, its paragraphs, lines and sentences, so that passages wrapped anew or
quoted in part are found by whole sentences. Less than a sentence or a line finds nothing. The lowest level that finds an earlier
original names the message answered. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import written

#: Words from which a single line or sentence can show where a quote is from.
LEAST_WORDS = 3
MARK, ATTRIBUTION = r"^[ \t>]*>[ \t]?", r"^(On|Am|Le|El) .*(wrote|schrieb|a écrit|escribió):[ \t]*$"
SPACE = r"[ \t\n\f\r]+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))


def normalised(text: Column) -> Column:
    """Lower case, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def _long(unit: Column) -> Column:
    return F.size(F.split(unit, " ")) >= LEAST_WORDS


def _sentences(paragraph: Column) -> Column:
    """Of a normalised paragraph: what ends in . ! or ? before a blank."""
    return F.filter(F.split(F.regexp_replace(paragraph, r"([.!?]) ", "$1\n"), "\n"), _long)


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, clean, quotes, qh): own words; quoted passages as (level, lines), null without any; their hash.

    Only messages with a quoted line are taken apart. An attribution line before a quote goes with it.
    """
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\r\n?", "\n")
    raw = messages.withColumn("_t", text).withColumn("_quoting", F.contains("_t", F.lit(">")) & F.col("_t").rlike(r"(?md)^[ \t]*>"))
    lines = F.transform(F.split("_t", "\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARK, "").alias("body")))
    out = raw.withColumn("_raw", F.when(F.col("_quoting"), lines))
    named = F.transform(
        "_raw",
        lambda x, i: F.struct(F.when((x["level"] == 0) & (F.coalesce(F.get("_raw", i + 1)["level"], F.lit(0)) > 0) & x["body"].rlike(ATTRIBUTION), -1).otherwise(x["level"]).alias("level"), x["body"].alias("body")),
    )
    out = out.withColumn("_lines", named)
    # A run begins where the line before is of another level.
    starts = F.expr("filter(sequence(0, size(_lines) - 1), i -> _lines[i].level > 0 AND (i = 0 OR _lines[i].level <> _lines[i - 1].level))")
    ends = F.expr("filter(sequence(1, size(_lines)), i -> _lines[i - 1].level > 0 AND (i = size(_lines) OR _lines[i - 1].level <> _lines[i].level))")
    out = out.withColumn("_starts", F.when(F.col("_quoting"), starts)).withColumn("_ends", F.when(F.col("_quoting"), ends))
    quotes = F.expr("transform(_starts, (s, j) -> struct(_lines[s].level AS level, transform(slice(_lines, s + 1, _ends[j] - s), x -> x.body) AS lines))")
    own = F.when(F.col("_quoting"), F.expr("array_join(transform(filter(_lines, x -> x.level = 0), x -> x.body), '\n')")).otherwise(F.col("_t"))
    out = out.withColumn("quotes", F.when(F.col("_quoting"), quotes)).withColumn("clean", F.trim(F.regexp_replace(own, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")))
    return out.select("conv_id", "turn", "role", "clean", "quotes", F.when(F.col("_quoting"), F.xxhash64("quotes")).alias("qh"))


def own_units(messages: DataFrame) -> DataFrame:
    """(conv_id, unit, original): hashes of all of a message, its paragraphs, lines and sentences; the first turn that has each."""
    lines = F.transform(F.split("clean", "\n"), normalised)
    rows = messages.where("clean <> '' and conv_id is not null and turn is not null").select("conv_id", "turn", lines.alias("_lines"))
    paragraphs = F.transform(F.split(F.array_join("_lines", "\n"), "\n\n+"), lambda p: F.trim(F.translate(p, "\n", " ")))
    rows = rows.withColumn("_paragraphs", paragraphs)
    whole = F.array_join(F.filter("_paragraphs", lambda p: p != ""), " ")
    units = F.concat(F.array(whole), F.col("_paragraphs"), F.col("_lines"), F.flatten(F.transform("_paragraphs", _sentences)))
    hashed = F.array_distinct(F.transform(F.filter(units, lambda u: u != ""), lambda u: F.xxhash64(u)))
    return rows.select("conv_id", "turn", F.explode(hashed).alias("unit")).groupBy("conv_id", "unit").agg(F.min("turn").alias("original"))


def asked(quoting: DataFrame) -> DataFrame:
    """(conv_id, turn, qh, at, level, kind, unit): hashes of each quoted passage (kind 0), its lines and sentences (kind 1)."""
    rows = quoting.select("conv_id", "turn", "qh", F.posexplode("quotes").alias("at", "q")).withColumn("_lines", F.transform("q.lines", normalised))
    rows = rows.withColumn("_whole", F.array_join(F.filter("_lines", lambda x: x != ""), " ")).where("_whole <> ''")
    parts = F.array_distinct(F.transform(F.concat(F.filter("_lines", _long), _sentences(F.col("_whole"))), lambda u: F.xxhash64(u)))
    units = F.concat(F.array(F.struct(F.lit(0).alias("kind"), F.xxhash64("_whole").alias("unit"))), F.transform(parts, lambda u: F.struct(F.lit(1).alias("kind"), u.alias("unit"))))
    return rows.select("conv_id", "turn", "qh", "at", F.col("q.level").alias("level"), F.explode(units).alias("u")).select("conv_id", "turn", "qh", "at", "level", "u.kind", "u.unit")


def linked(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, quotes, linked, anchor, message) of every row.

    text is without quotes; reply_to is the turn answered as its quotes show, else null; quotes and linked count quoted passages
    and those whose original was found; anchor is reply_to or the turn before, so that (conv_id, anchor, turn) puts each message
    behind the one it answers; message is the formatted text. Null texts count as empty; rows without conv_id or turn find
    no originals; other columns are left out; an empty table gives no rows. Repeated rows stay. Rows of one (conv_id, turn)
    keep their own quotes and links; as originals they stand for that turn alike. Of several originals the first turn counts.

    Messages are parsed once, into a table. Only those that quote are joined, by (conv_id, turn, hash of their quotes).
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    messages = written(parsed(rows))
    quoting, plain = messages.where("qh is not null"), messages.where("qh is null")
    none = plain.withColumns({"reply_to": F.lit(None).cast("long"), "linked": F.lit(0)})
    if quoting.isEmpty():  # nothing to look up
        return _shown(none)
    found = asked(quoting.where("conv_id is not null and turn is not null")).join(own_units(messages), ["conv_id", "unit"]).where("original < turn")
    answers = found.groupBy("conv_id", "turn", "qh").agg(F.min(F.struct("level", "kind", "at", "original"))["original"].alias("reply_to"), F.count_distinct("at").cast("int").alias("linked"))
    joined = quoting.join(answers, ["conv_id", "turn", "qh"], "left").withColumn("linked", F.coalesce("linked", F.lit(0)))
    return _shown(none.unionByName(joined))


def _shown(rows: DataFrame) -> DataFrame:
    formatted = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), "clean", F.lit("\n"))
    anchor = F.coalesce("reply_to", F.col("turn") - 1)
    return rows.select("conv_id", "turn", "role", F.col("clean").alias("text"), "reply_to", F.coalesce(F.size("quotes"), F.lit(0)).alias("quotes"), "linked", anchor.alias("anchor"), formatted.alias("message"))


def ordered(messages: DataFrame) -> DataFrame:
    """linked()'s rows in reply order. Ranges of (conv_id, anchor, turn) are dealt out, so a conversation of any size is spread."""
    return messages.repartitionByRange("conv_id", "anchor", "turn", "role", "text").sortWithinPartitions("conv_id", "anchor", "turn", "role", "text")


#: The same rows in DuckDB SQL over `conversations`.
SQL = r"""
WITH msgs AS (SELECT row_number() OVER () AS m, conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM conversations),
ln AS (SELECT m, conv_id, turn, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM msgs),
lv AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t>]*>[ \t]?'), '[^>]', '', 'g')) AS l0, regexp_replace(line, '^[ \t>]*>[ \t]?', '') AS body FROM ln),
la AS (SELECT *, CASE WHEN l0 = 0 AND regexp_matches(body, '^(On|Am|Le|El) .*(wrote|schrieb|a écrit|escribió):[ \t]*$') AND coalesce(lead(l0) OVER (PARTITION BY m ORDER BY i), 0) > 0 THEN -1 ELSE l0 END AS level FROM lv),
st AS (SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER (PARTITION BY m ORDER BY i) THEN 1 ELSE 0 END AS s FROM la),
rn AS (SELECT *, sum(s) OVER (PARTITION BY m ORDER BY i) AS run, trim(regexp_replace(lower(body), '[ \t\n\f\r]+', ' ', 'g')) AS norm FROM st),
runs AS (SELECT m, conv_id, turn, run, any_value(level) AS level, list(norm ORDER BY i) AS lines FROM rn GROUP BY ALL),
own AS (SELECT m, trim(regexp_replace(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY i) FILTER (WHERE level = 0), ''), '^[ \t\n\f\r]+', ''), '[ \t\n\f\r]+$', '')) AS clean FROM rn GROUP BY m),
ol AS (SELECT m, list_transform(string_split(clean, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \t\n\f\r]+', ' ', 'g'))) AS lines FROM own WHERE clean <> ''),
op AS (SELECT m, lines, list_transform(regexp_split_to_array(array_to_string(lines, chr(10)), '\n\n+'), lambda p: trim(replace(p, chr(10), ' '))) AS ps FROM ol),
os AS (SELECT m, list_concat([array_to_string(list_filter(ps, lambda p: p <> ''), ' ')], ps, lines, list_filter(flatten(list_transform(ps, lambda p: string_split(regexp_replace(p, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))), lambda u: len(string_split(u, ' ')) >= 3)) AS us FROM op),
units AS (SELECT DISTINCT g.conv_id, g.turn, u AS unit FROM (SELECT m, unnest(us) AS u FROM os) JOIN msgs g USING (m) WHERE u <> '' AND g.conv_id IS NOT NULL AND g.turn IS NOT NULL),
orig AS (SELECT conv_id, unit, min(turn) AS original FROM units GROUP BY ALL),
q AS (SELECT m, conv_id, turn, level, row_number() OVER (PARTITION BY m ORDER BY run) - 1 AS pno, lines, array_to_string(list_filter(lines, lambda x: x <> ''), ' ') AS whole FROM runs WHERE level > 0),
asked AS (SELECT m, conv_id, turn, pno, level, 0 AS kind, whole AS unit FROM q
  UNION ALL SELECT m, conv_id, turn, pno, level, 1, u FROM (SELECT *, unnest(list_concat(lines, string_split(regexp_replace(whole, '([.!?]) ', '\1' || chr(10), 'g'), chr(10)))) AS u FROM q) WHERE len(string_split(u, ' ')) >= 3),
found AS (SELECT a.*, o.original FROM asked a JOIN orig o USING (conv_id, unit) WHERE o.original < a.turn AND unit <> ''),
ans AS (SELECT m, arg_min(original, (level, kind, pno, original)) AS reply_to, count(DISTINCT pno)::INT AS linked FROM found GROUP BY ALL)
SELECT g.conv_id, g.turn, g.role, own.clean AS text, ans.reply_to, (SELECT count(*) FROM q WHERE q.m = g.m)::INT AS quotes, coalesce(ans.linked, 0)::INT AS linked,
  coalesce(ans.reply_to, g.turn - 1) AS anchor, '<|' || coalesce(g.role, 'unknown') || '|>' || chr(10) || own.clean || chr(10) AS message
FROM msgs g JOIN own USING (m) LEFT JOIN ans USING (m)
"""
