"""Where a pattern matches, in code points, by built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once, however often `use` names it."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def in_runs(items: Column) -> Column:
    """An array cut into arrays of RUN elements."""
    return bound(
        items,
        lambda x: F.when(F.size(x) == 0, F.array(x)).otherwise(
            F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda i: F.slice(x, i * RUN + 1, RUN))
        ),
    )


def pieces(text: Column, pattern: str | Column) -> Column:
    """array<struct<g, h>>: the texts between matches and the matches, in turn; the last match is null."""
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.zip_with(F.split(text, rx, -1), F.regexp_extract_all(text, rx, F.lit(0)), lambda g, h: F.struct(g.alias("g"), h.alias("h")))


def match_spans(text: Column, pattern: str | Column, context: int = 0) -> Column:
    """array<struct<s, e, v>>: the leftmost non-overlapping matches of a pattern (end exclusive) and what they hold.

    With a context, also b and a: so many characters before and after, as far as the next match.
    The pattern must match no empty string. Positions are running sums of the lengths of what
    lies between matches and of the matches, taken in runs, so that long texts take linear time.
    """
    parts = pieces(text, pattern)
    if context:
        rx = F.lit(pattern) if isinstance(pattern, str) else pattern
        parts = F.zip_with(parts, bound(F.split(text, rx, -1), lambda x: F.slice(x, 2, F.size(x))), lambda p, a: F.struct(p["g"].alias("g"), p["h"].alias("h"), a.alias("n")))
    fields = lambda x, at: [(at + F.length(x["g"])).alias("s"), (at + F.length(x["g"]) + F.length(x["h"])).alias("e"), x["h"].alias("v")]
    kind = "s:int,e:int,v:string"
    if context:
        plain, kind = fields, f"{kind},b:string,a:string"
        fields = lambda x, at: [*plain(x, at), F.substring(x["g"], -context, context).alias("b"), F.substring(x["n"], 1, context).alias("a")]
    empty = F.array().cast(f"array<struct<{kind}>>")

    def run(items: Column) -> Column:
        return F.aggregate(
            items,
            F.struct(F.lit(0).alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["g"]) + F.length(x["h"])).alias("at"), F.array_append(acc["out"], F.struct(*fields(x, acc["at"]))).alias("out")
            ),
        )

    moved = lambda out, at: F.transform(
        out, lambda x: F.struct((x["s"] + at).alias("s"), (x["e"] + at).alias("e"), *(x[c].alias(c) for c in ("v", "b", "a") if context or c == "v"))
    )
    return F.aggregate(
        F.transform(in_runs(F.filter(parts, lambda x: x["h"].isNotNull())), run),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<struct<{kind}>>>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["out"], moved(x["out"], acc["at"])).alias("out")),
        lambda acc: F.flatten(acc["out"]),
    )


def blanked(text: Column, pattern: str, keep: Callable[[Column], Column] | None) -> Column:
    """The text with a blank for every match that `keep` holds for."""
    put = lambda h: F.when(keep(h), F.lit(" ")).otherwise(h) if keep else F.lit(" ")
    return F.array_join(F.transform(pieces(text, pattern), lambda x: F.concat(x["g"], F.when(x["h"].isNull(), F.lit("")).otherwise(put(x["h"])))), "")


def replaced(text: Column, marks: Column) -> Column:
    """The text with r in place of s to e for every mark (struct<s, e, r>), in order of place; a mark that begins inside the one before only extends it."""

    def cut(run: Column, start: Column, end: Column, at: Column) -> Column:
        return bound(
            F.substring(text, start + 1, end - start),
            lambda part: F.aggregate(
                run,
                F.struct(F.greatest(at, start).alias("at"), F.array().cast("array<string>").alias("out")),
                lambda acc, m: F.struct(
                    F.greatest(acc["at"], m["e"]).alias("at"),
                    F.when(m["s"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(part, acc["at"] - start + 1, m["s"] - acc["at"]), m["r"])))
                    .otherwise(acc["out"])
                    .alias("out"),
                ),
                lambda acc: F.struct(acc["at"].alias("at"), F.concat(F.array_join(acc["out"], ""), F.substring(part, acc["at"] - start + 1, F.greatest(end - acc["at"], F.lit(0)))).alias("out")),
            ),
        )

    # each run of marks works on its own part of the text, up to the next run's first mark
    with_ends = lambda runs: F.transform(
        runs,
        lambda run, i: F.struct(
            run.alias("run"),
            F.when(i == 0, F.lit(0)).otherwise(F.get(run, F.lit(0))["s"]).alias("start"),
            F.coalesce(F.get(F.get(runs, i + 1), F.lit(0))["s"], F.length(text)).alias("end"),
        ),
    )
    return F.aggregate(
        bound(in_runs(F.array_sort(marks)), with_ends),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: bound(
            cut(x["run"], x["start"], x["end"], acc["at"]),
            lambda now: F.struct(now["at"].alias("at"), F.array_append(acc["out"], now["out"]).alias("out")),
        ),
        lambda acc: F.array_join(acc["out"], ""),
    )
