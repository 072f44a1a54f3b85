"""Quotation linking: nested quotes are parsed, hashed and joined to the messages they came from.

DataFrame functions only. Messages come back without their quotes, ordered by conversation,
thread and turn, so a reply always follows what it quotes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

#: Least normalised length of a single line that names a source in another conversation; within a conversation, and for whole passages, there is none.
LEAST_LINE = 12
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java patterns (line feeds alone end a line); the SQL form below writes the same for its own library.
_BLOCK = r"(?md)(?:^On [^\n]* wrote:[ \t]*\n)?(?:^[ \t]*>[^\n]*(?:\n|\z))+"
_MARKS = r"(?md)^(?:[ \t]*>)+[ \t]?"


def _level_pattern(level: Column) -> Column:
    return F.concat(F.lit(r"(?md)(?:^(?:[ \t]*>){"), level.cast("string"), F.lit(r"}[ \t]*(?:[^>\s][^\n]*)?(?:\n|\z))+"))


def norm(text: Column) -> Column:
    """A-Z lower-cased, runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), r"[\x20\x09-\x0D]+", " "))


def unquoted(text: Column) -> Column:
    """The text without quoted blocks (and the attribution line before one), trimmed of line feeds and blanks."""
    return F.regexp_replace(F.regexp_replace(text, _BLOCK, ""), r"^[ \t\n]+|[ \t\n]+\z", "")


def _units(body: Column) -> Column:
    """(u, wide): normalised whole and, where there are several, lines; wide: the whole, or a line of LEAST_LINE or more."""
    lines = F.transform(F.split(body, "\n"), norm)
    whole = norm(body)
    return F.transform(F.filter(F.array_distinct(F.concat(F.array(whole), lines)), lambda x: x != ""), lambda x: F.struct(x.alias("u"), ((x == whole) | (F.length(x) >= LEAST_LINE)).alias("wide")))


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per input row: conv_id, turn, role, text (without quotes), thread_turn, parent_turn, depth, n_quotes, source_conv, source_turn; ordered by conv_id, thread_turn, turn.

    A quoted passage is a run of lines of one quote level. It is matched, whole or by line, to the earliest
    earlier message of its conversation that wrote it; the parent is that of the outermost matched level,
    then of the longest match, then the latest. Passages unknown in their conversation name the first other
    conversation that has them as source. Messages without a matched quote begin a thread.

    Null text counts as empty; rows with null conversation or turn keep their text unlinked as threads of
    their own; rows that repeat a (conversation, turn) are linked as one message and all returned; of equal
    originals the earliest is linked; extra columns are ignored; an empty table gives an empty result.
    Conversations may have ids of any type that can be ordered; turns are numbers, and one that is not
    counts as null. Very long texts are parsed whole.

    Scale: only quoting messages are exploded by passage; originals are reduced map-side to one row a hash,
    so common lines and hot conversations are never gathered; threads are resolved by doubling. The final order
    is by ranges of (conversation, thread, turn), so a hot conversation is spread over tasks."""
    base = messages.select(F.col(f"`{conv_col}`").alias("c"), F.col(f"`{turn_col}`").try_cast("long").alias("t"), F.col(f"`{role_col}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keyed = base.filter("c IS NOT NULL AND t IS NOT NULL")
    quoting = keyed.filter(F.col("text").rlike(r"(?md)^[ \t]*>"))
    level_of = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, r"^(?:[ \t]*>)+", 0), "[^>]", ""))
    levels = quoting.select("c", "t", "text", F.explode(F.sequence(F.lit(1), F.array_max(F.transform(F.split("text", "\n"), level_of)))).alias("level"))
    passages = levels.select("c", "t", "level", F.explode(F.regexp_extract_all("text", _level_pattern(F.col("level")), F.lit(0))).alias("raw"))
    parts = written(passages.select("c", "t", "level", F.regexp_replace("raw", _MARKS, "").alias("body")), "quotes")
    if parts.isEmpty():
        discard(parts)
        plain = base.select("c", "t", "role", unquoted(F.col("text")).alias("text"))
        none = F.lit(None).cast("long")
        return _named(plain.withColumns({"thread": F.col("t"), "parent": none, "depth": F.lit(0), "n_quotes": F.lit(0).cast("long"), "sc": F.lit(None).cast(plain.schema["c"].dataType), "st": none}), conv_col, turn_col, role_col, text_col)
    asked = parts.select("c", "t", "level", F.explode(_units(F.col("body"))).alias("x")).select("c", "t", "level", F.length("x.u").alias("len"), F.sha2("x.u", 256).alias("h"), "x.wide").groupBy("c", "t", "level", "len", "h").agg(F.max("wide").alias("wide"))
    own = keyed.select("c", "t", F.explode(_units(unquoted(F.col("text")))).alias("x")).select("c", "t", F.sha2("x.u", 256).alias("h"), "x.wide")
    local = own.groupBy("c", "h").agg(F.min("t").alias("ot"))
    first = own.filter("wide").groupBy("h").agg(F.min(F.struct("c", "t")).alias("o"))
    met = written(asked.join(local, ["c", "h"], "left").join(first, "h", "left"), "met")
    inside = F.col("ot") < F.col("t")
    linked = met.groupBy("c", "t").agg(
        F.min(F.when(inside, F.struct("level", (-F.col("len")).alias("l"), (-F.col("ot")).alias("o")))).alias("best"),
        F.min(F.when(~F.coalesce(inside, F.lit(False)) & F.col("wide") & (F.col("o.c") != F.col("c")), F.struct("level", (-F.col("len")).alias("l"), F.col("o.c").alias("sc"), F.col("o.t").alias("st")))).alias("src"),
    )
    counts = parts.groupBy("c", "t").agg(F.count(F.lit(1)).alias("n_quotes"))
    info = written(counts.join(linked, ["c", "t"], "left").select("c", "t", "n_quotes", (-F.col("best.o")).alias("parent"), F.col("src.sc").alias("sc"), F.col("src.st").alias("st")), "quote-links")
    discard(parts, met)

    up = written(info.filter("parent IS NOT NULL").select("c", "t", F.col("parent").alias("up"), F.lit(1).alias("depth")), "ancestors")
    while True:
        above = up.select("c", F.col("t").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        step = up.join(above, ["c", "up"], "left").select("c", "t", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up2").isNotNull().alias("moved"))
        new = written(step, "ancestors")
        discard(up)
        up = new.drop("moved")
        up._scratch_path = new._scratch_path
        if new.filter("moved").isEmpty():
            break
    both = written(info.join(up.select("c", "t", F.col("up").alias("root"), "depth"), ["c", "t"], "left"), "threads")
    discard(info, up)
    out = base.select("c", "t", "role", unquoted(F.col("text")).alias("text")).join(both, ["c", "t"], "left")
    done = out.select("c", "t", "role", "text", F.coalesce("root", "t").alias("thread"), "parent", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("n_quotes", F.lit(0).cast("long")).alias("n_quotes"), "sc", "st")
    return _named(done, conv_col, turn_col, role_col, text_col)


def _named(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    names = {"c": conv_col, "t": turn_col, "role": role_col, "text": text_col, "thread": "thread_turn", "parent": "parent_turn", "depth": "depth", "n_quotes": "n_quotes", "sc": "source_conv", "st": "source_turn"}
    return df.orderBy("c", "thread", "t").select(*[F.col(k).alias(v) for k, v in names.items()])


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


_NORM = rf"trim(regexp_replace(translate({{0}}, '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+', ' ', 'g'))"
_OWN = r"regexp_replace(regexp_replace(text, '(?m)(?:^On [^\n]* wrote:[ \t]*\n)?(?:^[ \t]*>[^\n]*(?:\n|\z))+', '', 'g'), '^[ \t\n]+|[ \t\n]+\z', '', 'g')"


def _sql_units(body: str) -> str:
    line, whole = _NORM.format("x"), _NORM.format(body)
    found = f"list_filter(list_distinct(list_concat([{whole}], [{line} FOR x IN string_split({body}, chr(10))])), lambda y: y <> '')"
    return f"list_transform({found}, lambda y: {{'u': y, 'wide': y = {whole} OR length(y) >= {LEAST_LINE}}})"


ORACLE = rf"""
WITH RECURSIVE m AS (SELECT conv_id AS c, CAST(turn AS BIGINT) AS t, role, coalesce(text, '') AS text FROM conversations),
q AS (SELECT DISTINCT * FROM m WHERE regexp_matches(text, '(?m)^[ \t]*>')),
lv AS (SELECT c, t, text, unnest(range(1, 1 + list_max([length(regexp_replace(regexp_extract(x, '^(?:[ \t]*>)+', 0), '[^>]', '', 'g')) FOR x IN string_split(text, chr(10))]))) AS level FROM q),
ps AS (SELECT c, t, CAST(level AS INTEGER) AS level, unnest(regexp_extract_all(text, '(?m)(?:^(?:[ \t]*>){{' || level || '}}[ \t]*(?:[^>\s][^\n]*)?(?:\n|\z))+', 0)) AS raw FROM lv),
pb AS (SELECT c, t, level, regexp_replace(raw, '(?m)^(?:[ \t]*>)+[ \t]?', '', 'g') AS body FROM ps),
pu AS (SELECT c, t, level, unnest({_sql_units("body")}) AS x FROM pb),
asked AS (SELECT c, t, level, length(x.u) AS len, sha256(x.u) AS h, bool_or(x.wide) AS wide FROM pu GROUP BY ALL),
ob AS (SELECT c, t, {_OWN} AS body FROM m WHERE c IS NOT NULL AND t IS NOT NULL),
ou AS (SELECT c, t, unnest({_sql_units("body")}) AS x FROM ob),
loc AS (SELECT c, sha256(x.u) AS h, min(t) AS ot FROM ou GROUP BY ALL),
fst AS (SELECT sha256(x.u) AS h, min({{'c': c, 't': t}}) AS o FROM ou WHERE x.wide GROUP BY ALL),
met AS (SELECT asked.*, loc.ot, fst.o FROM asked LEFT JOIN loc USING (c, h) LEFT JOIN fst USING (h)),
lk AS (SELECT c, t, min({{'a': level, 'b': -len, 'o': -ot}}) FILTER (ot < t) AS best,
  min({{'a': level, 'b': -len, 'sc': o.c, 'st': o.t}}) FILTER (coalesce(ot >= t, true) AND wide AND o.c <> c) AS src FROM met GROUP BY c, t),
info AS (SELECT n.c, n.t, n.n_quotes, -best.o AS parent, src.sc AS sc, src.st AS st FROM (SELECT c, t, count(*) AS n_quotes FROM pb GROUP BY ALL) n LEFT JOIN lk USING (c, t)),
up AS (SELECT c, t, parent AS up, 1 AS depth FROM info WHERE parent IS NOT NULL
  UNION ALL SELECT up.c, up.t, i.parent, depth + 1 FROM up JOIN info i ON i.c = up.c AND i.t = up.up WHERE i.parent IS NOT NULL),
rt AS (SELECT c, t, min(up) AS root, max(depth) AS depth FROM up GROUP BY ALL)
SELECT m.c AS conv_id, m.t AS turn, m.role, {_OWN} AS text, coalesce(rt.root, m.t) AS thread_turn, info.parent AS parent_turn,
  CAST(coalesce(rt.depth, 0) AS INTEGER) AS depth, coalesce(info.n_quotes, 0) AS n_quotes, info.sc AS source_conv, info.st AS source_turn
FROM m LEFT JOIN info USING (c, t) LEFT JOIN rt USING (c, t)"""
