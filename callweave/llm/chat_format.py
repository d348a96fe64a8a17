"""Chat formatting with a grammar round trip, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """turn := opener role separator text closer; conversation := begin turn*."""

    begin: str = "<s>"
    opener: str = "[INST]"
    separator: str = "[/INST]"
    closer: str = "</s>"
    #: Doubled where a text has it, put into control strings of texts behind their first character.
    escape: str = "␛"

    @property
    def control(self) -> list[str]:
        return [self.begin, self.opener, self.separator, self.closer]


def escape(text: Column, t: Template) -> Column:
    """No control string of ``t`` is left in the result; ``unescape`` gives the text back."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for c in t.control:
        out = F.replace(out, F.lit(c), F.lit(c[0] + t.escape + c[1:]))
    return out


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, f"{t.escape}({t.escape}?)", "$1")


def render(turns: Column, t: Template, escaped: bool) -> Column:
    put = (lambda x: escape(x, t)) if escaped else (lambda x: x)
    one = lambda x: F.concat(F.lit(t.opener), put(x["role"]), F.lit(t.separator), put(x["text"]), F.lit(t.closer))
    return F.concat(F.lit(t.begin), F.array_join(F.transform(turns, one), ""))


def pieces(formatted: Column, t: Template) -> Column:
    """array<struct<role, text>> as they stand in the string, still escaped; null where it isn't in the grammar."""
    parts = F.split(F.substr(formatted, F.lit(len(t.begin) + 1)), _literal(t.closer), -1)
    body = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def piece(x: Column) -> Column:
        after = F.substr(x, F.lit(len(t.opener) + 1))
        role = F.substring_index(after, t.separator, 1)
        text = F.substr(after, F.length(role) + F.lit(len(t.separator) + 1))
        fits = F.startswith(x, F.lit(t.opener)) & F.contains(after, F.lit(t.separator))
        return F.when(fits, F.struct(role.alias("role"), text.alias("text")))

    ok = F.startswith(formatted, F.lit(t.begin)) & (F.element_at(parts, -1) == "")
    return F.when(ok, F.transform(body, piece))


def parse(formatted: Column, t: Template) -> Column:
    """array<struct<role, text>>, unescaped."""
    return F.transform(pieces(formatted, t), lambda x: F.struct(unescape(x["role"], t).alias("role"), unescape(x["text"], t).alias("text")))


def _literal(s: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in s)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped, turns, loss_spans.

    ``turns`` are those that the parser reads back from ``formatted``; loss_spans holds start and end (code points in
    ``formatted``, end exclusive) of each assistant turn's text. A conversation is first written as it is; where the
    parser doesn't give back the source, it is escaped and parsed again. The second try can't fail: see ``escape``.

    Rows are ordered by turn, then role, then text, so equal turn numbers have a defined order; a null turn comes
    first. A null role or text is the empty string; a null conv_id is a conversation of its own. Repeated rows are
    repeated turns. An empty table gives no rows; other columns are ignored.
    """
    t = template or Template()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select("conv_id", F.struct(F.col("turn"), text("role").alias("role"), text("text").alias("text")).alias("__row"))
    source = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
    source = source.select("conv_id", F.transform("__rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("__source"))
    tried = source.withColumn("__plain", render(F.col("__source"), t, False))
    tried = tried.withColumn("escaped", ~parse(F.col("__plain"), t).eqNullSafe(F.col("__source")))
    out = tried.withColumn("formatted", F.when(F.col("escaped"), render(F.col("__source"), t, True)).otherwise(F.col("__plain")))
    out = out.withColumn("__pieces", pieces(F.col("formatted"), t))
    fixed = len(t.opener) + len(t.separator)
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["role"]) + F.length(x["text"]) + F.lit(fixed + len(t.closer))).alias("at"),
        F.when(
            unescape(x["role"], t) == "assistant",
            F.array_append(acc["spans"], F.struct((acc["at"] + F.length(x["role"]) + F.lit(fixed)).alias("start"), (acc["at"] + F.length(x["role"]) + F.length(x["text"]) + F.lit(fixed)).alias("end"))),
        ).otherwise(acc["spans"]).alias("spans"),
    )
    start = F.struct(F.lit(len(t.begin)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    return out.select("conv_id", "formatted", "escaped", parse(F.col("formatted"), t).alias("turns"), F.aggregate("__pieces", start, step)["spans"].alias("loss_spans"))
