r"""Operator 4: information-theoretic sanitisation of personal data (native).

Base entities are leftmost non-overlapping matches per kind (e-mail, IP, card, phone) that pass
their checks. Terms in a text that holds an entity may give it away although they aren't personal
data themselves. A term is a run of two or more letters or digits outside the text's entities.
Over the corpus, the share of an entity's information that a term discloses is

    PMI(term; entity) / IC(entity) = 1 + log P(entity | term) / log (N / df(entity))

Pairs that MIN_CONTEXTS texts hold (copies of one text count once), or that stand together in so many
neighbourhoods of one entity (CONTEXT characters on both sides, up to the next entity of its kind), and
whose share reaches REMOVE are removed, those that reach GENERALISE give way to their class (name,
number, id or word), wherever the term stands in a text that holds the entity. Entities' own matches always go.

Base entities are looked for once; the rows, with what was found, are written to the shared
folder. Texts are shuffled once, to count terms over distinct ones; all later steps touch only
the rows that hold entities. Entities that the same texts hold are counted as one class.

Patterns differ from the plain ones in possessive repeats and in starting only where a run of
the class starts or the last match ended (\G): the matches are the same, but no input makes the
regex engine go back over a run again and again.

Defined cases: a null text counts as empty and stays null when sanitised; repeated rows give repeated results (the
statistic counts distinct texts, so copies of a document change no share); rows without doc_id are handled like others; an empty
table gives an empty result; other columns are kept by sanitise() and ignored by digest().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .spans import blanked, bound, match_spans, replaced

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

CONTEXT = 80
MIN_CONTEXTS = 2
REMOVE, GENERALISE = 0.95, 0.85
TERM = r"[\p{L}\p{M}\p{N}]{2,}+"
SPANS = "array<struct<s:int,e:int,v:string>>"
MARKS = "array<struct<s:int,e:int,v:string,remove:boolean>>"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _octets(hit: Column) -> Column:
    bare = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = lambda p: F.when(F.length(p) <= 3, F.coalesce(p.try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False))
    return F.forall(bare, small)


def _luhn(hit: Column) -> Column:
    d = _digits(hit)
    n = F.length(d)
    digit = lambda i: F.substring(d, n - i + 1, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 1, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + value(i))
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def _gates(text: Column) -> dict[str, Column]:
    """By kind, what a text must hold for its pattern to be tried."""
    return {
        "email": F.instr(text, "@") > 0,
        "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
        "phone": F.instr(text, "+") > 0,
    }


_PATTERNS = {"email": (EMAIL, None), "ip": (IP, _octets), "card": (CARD, _luhn), "phone": (PHONE, _phone)}


def base_spans(text: Column, context: int = 0) -> dict[str, Column]:
    """By kind, array<struct<s, e, v>> of the base entities of a text that isn't null."""
    none = F.array().cast(SPANS.replace("v:string", "v:string,b:string,a:string") if context else SPANS)
    gates = _gates(text)

    def of(kind: str) -> Column:
        pattern, keep = _PATTERNS[kind]
        hits = match_spans(text, pattern, context)
        return F.when(gates[kind], F.filter(hits, lambda x: keep(x["v"])) if keep else hits).otherwise(none)

    return {k: of(k) for k in KINDS}


def find_base(df: DataFrame) -> DataFrame:
    """df with a column `base`: struct of the four kinds' spans."""
    found = base_spans(F.coalesce(F.col("text"), F.lit("")))
    return df.withColumn("base", F.struct(*(found[k].alias(k) for k in KINDS)))


def _labelled(base: Column) -> Column:
    """All base spans as one array of struct(k, s, e, v)."""
    of = lambda k: F.transform(base[k], lambda x: F.struct(F.lit(k).alias("k"), *(x[c].alias(c) for c in "sev")))
    return F.concat(*(of(k) for k in KINDS))


def _name(kind: Column, value: Column) -> Column:
    """What tells one entity from another: its digits (cards and phones) or its text in lower case."""
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value)))


def _terms(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _terms_outside(text: Column) -> Column:
    """The distinct terms of a text without its entities."""
    for kind in ("email", "phone", "card", "ip"):
        text = bound(text, lambda t, k=kind: F.when(_gates(t)[k], blanked(t, *_PATTERNS[k])).otherwise(t))
    return _terms(text)


def _held(found: DataFrame) -> DataFrame:
    """The rows with entities: doc_id, text, its hash h, mentions m (struct(k, s, e, v)), their names, the distinct ones, and terms."""
    rows = found.withColumn("m", _labelled(F.col("base"))).where(F.size("m") > 0)
    names = F.transform("m", lambda x: _name(x["k"], x["v"]))
    terms = F.col("terms") if "terms" in found.columns else _terms_outside(F.col("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("h"), "m", names.alias("names"), F.array_distinct(names).alias("entities"), terms.alias("terms"))


def _with_terms(found: DataFrame) -> DataFrame:
    """found with the distinct terms outside entities, and with the text only where there are entities."""
    holds = F.exists(F.array(*(F.size(F.col("base")[k]) for k in KINDS)), lambda n: n > 0)
    found = found.withColumn("h", F.xxhash64("text")).withColumn("text", F.when(holds, F.col("text")))
    return found.withColumn("terms", F.when(holds, _terms_outside(F.col("text"))))


def _neighbourhoods(found: DataFrame) -> DataFrame:
    """(entity, context, term) of terms beside the entities that a text holds more than once."""
    rows = _held(found).where(F.size("entities") < F.size("names")).select("text").distinct()
    around = base_spans(F.col("text"), CONTEXT + 1)
    beside = lambda k: F.transform(around[k], lambda x: F.struct(_name(F.lit(k), x["v"]).alias("entity"), x["b"].alias("b"), x["a"].alias("a")))
    rows = rows.select(F.explode(F.concat(*(beside(k) for k in KINDS))).alias("x")).select("x.*")
    # a term cut by the edge of the neighbourhood is left out
    before = F.when(F.length("b") > CONTEXT, F.regexp_replace("b", r"^[\p{L}\p{M}\p{N}]+", "")).otherwise(F.col("b"))
    after = F.when(F.length("a") > CONTEXT, F.regexp_replace("a", r"[\p{L}\p{M}\p{N}]+$", "")).otherwise(F.col("a"))
    near = F.concat_ws(" ", before, after)
    return rows.select("entity", F.xxhash64("b", "a").alias("context"), F.explode(_terms_outside(near)).alias("term"))


def _entity_classes(held: DataFrame) -> DataFrame:
    """(entity, df_e, class): entities that the same texts hold are one class, as they have all counts of texts in common.

    A class is named by a 64-bit hash of the set of its texts' hashes.
    """
    mixed = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "h"))
    by = held.select("h", F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df_e"), mixed(1).alias("x"), mixed(2).alias("y"))
    return by.select("entity", "df_e", F.xxhash64("df_e", "x", "y").alias("class"))


def _disclosing(found: DataFrame, mentions: DataFrame, texts: DataFrame | None, keep: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(class, term, share) as in disclosing_terms, by classes of entities; the entities' classes; and (h, classes) of the texts.

    A text's terms are paired with its classes, not with its entities, so that a text of thousands of addresses has few pairs.
    All three are written tables, which keeps the plans small.
    """
    # texts are told apart by 64-bit hashes, and only their terms are moved
    text = F.coalesce("text", F.lit(""))
    texts = (found if texts is None else texts).select(F.xxhash64(text).alias("h"), F.array_join(_terms(text), " ").alias("terms")).distinct()
    held = _held(found).select("h", "entities", "terms").distinct()
    known = keep(_entity_classes(held), "classes")
    near = mentions.groupBy("entity", "term").agg(F.count_distinct("context").alias("contexts")).where(f"contexts >= {MIN_CONTEXTS}")
    near = keep(near.join(known, "entity").select("class", "term", F.lit(True).alias("near")).distinct(), "near")
    # a class of fewer texts and no such neighbourhoods has no pair to count
    classes = known.select("class", "df_e").distinct()
    live = classes.join(near.select("class", "near").distinct(), "class", "left").where(f"df_e >= {MIN_CONTEXTS} or near").select("class")
    live = known.select("entity", "class").join(live, "class")
    by_text = held.select("h", F.explode("entities").alias("entity")).join(live, "entity").groupBy("h").agg(F.collect_set("class").alias("classes"))
    by_text = keep(by_text, "by_text")
    pairs = held.select("h", "terms").join(by_text, "h").select(F.explode("classes").alias("class"), "terms")
    seen = pairs.select("class", F.explode("terms").alias("term")).groupBy("class", "term").agg(F.count("*").alias("df_te"))
    together = seen.join(near, ["class", "term"], "left").where(f"df_te >= {MIN_CONTEXTS} or near").drop("near")
    terms = texts.select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    total = texts.agg(F.greatest(F.count("*"), F.lit(2)).alias("n"))
    share = together.join(classes, "class").join(terms, "term").crossJoin(F.broadcast(total))
    given = F.least(F.col("df_te") / F.col("df_t"), F.lit(1.0))
    rarity = F.log(F.greatest(F.col("n") / F.col("df_e"), F.lit(1.0001)))
    risky = share.select("class", "term", (1 + F.log(given) / rarity).alias("share")).where(f"share >= {GENERALISE}")
    return keep(risky, "risky"), known, by_text


def disclosing_terms(found: DataFrame, mentions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(entity, term, share) of the pairs whose disclosed share of information reaches GENERALISE.

    All four counts are of distinct texts: texts with the pair, with the entity, with the term, and all
    (those of `texts`, if `found` holds only some). Entities that the same texts hold have the same terms.
    """
    risky, known, _ = _disclosing(found, mentions, texts, Scratch(found.sparkSession))
    return risky.join(known, "class").select("entity", "term", "share")


def term_spans(found: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(h, places): spans of disclosing terms by the text's hash, in order.

    Every step takes a text's terms, mentions and places as rows: no array is searched for each element of another.
    """
    keep = Scratch(found.sparkSession)
    risky, _, by_text = _disclosing(found, _neighbourhoods(found), texts, keep)
    held = _held(found).select("h", "text", "m", "terms").dropDuplicates(["h"])
    # how many pairs disclose is known when they are there, so none of these joins may broadcast by an estimate
    named = held.select("h", "terms").join(by_text, "h").select("h", F.explode("classes").alias("class"), "terms")
    named = named.join(risky.select("class").distinct().hint("merge"), "class", "left_semi")
    named = named.select("h", "class", F.explode("terms").alias("term")).join(risky.hint("merge"), ["class", "term"])
    named = keep(named.groupBy("h", "term").agg((F.max("share") >= REMOVE).alias("remove")), "named")
    keep.drop("classes", "near", "by_text", "risky")
    rows = held.select("h", "text", "m").join(named.select("h").distinct().hint("merge"), "h", "left_semi")
    hits = rows.select("h", F.explode(match_spans(F.col("text"), F.lit(TERM))).alias("t")).select("h", F.lower("t.v").alias("term"), "t.s", "t.e", "t.v")
    hits = hits.join(named.hint("merge"), ["h", "term"]).drop("term")
    mentions = rows.select("h", F.explode("m").alias("x")).select("h", "x.s", "x.e")
    both = hits.unionByName(mentions, allowMissingColumns=True)
    # a hit may overlap no mention: none that begins before it may end beyond its start, none may begin inside it
    by_start = Window.partitionBy("h").orderBy("s")
    held_end = F.max(F.when(F.col("v").isNull(), F.col("e"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    next_start = F.min(F.when(F.col("v").isNull(), F.col("s"))).over(Window.partitionBy("h").orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumns({"held": held_end, "next": next_start}).where("v is not null and (held is null or held <= s) and (next is null or next >= e)")
    return both.groupBy("h").agg(F.array_sort(F.collect_list(F.struct("s", "e", "v", "remove"))).alias("places"))


def digest(df: DataFrame) -> DataFrame:
    """One row per document: counts, base_sha256 and all spans as text."""
    found = find_base(df.select("doc_id", "text"))
    listed = F.array_join(F.transform(_labelled(F.col("base")), lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")
    counts = [F.size(F.col("base")[k]).cast("long").alias(f"n_{k}") for k in KINDS]
    found = Scratch(df.sparkSession)(_with_terms(found).select("*", *counts, listed.alias("listed")), "pii")
    joined = found.select("doc_id", "h", *(f"n_{k}" for k in KINDS), "listed").join(term_spans(found, df), "h", "left")
    extra = F.transform(F.coalesce("places", F.array().cast(MARKS)), lambda x: F.concat_ws(":", F.lit("term"), x["s"], x["e"]))
    return joined.select(
        "doc_id",
        *(f"n_{k}" for k in KINDS),
        F.sha2("listed", 256).alias("base_sha256"),
        F.array_join(F.concat(F.when(F.col("listed") == "", F.array().cast("array<string>")).otherwise(F.array("listed")), extra), ",").alias("spans"),
    )


def _class(term: Column) -> Column:
    """What a generalised term gives way to."""
    digits = term.rlike("[0-9]")
    return (
        F.when(digits & ~term.rlike(r"\p{L}"), F.lit("[number]")).when(digits, F.lit("[id]")).when(term.rlike(r"^\p{Lu}"), F.lit("[Name]")).otherwise(F.lit("[word]"))
    )


def sanitise(df: DataFrame) -> DataFrame:
    """df with text replaced by its sanitised form: entities by [KIND], removed terms by [...], generalised ones by their class."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    found = Scratch(df.sparkSession)(_with_terms(find_base(df.select("doc_id", "text", row))), "pii")
    key = term_spans(found, df.select("text"))
    # rows without entities stay as they are and aren't moved
    holds = F.coalesce(F.size("terms") >= 0, F.lit(False))
    rest = found.where(~holds).select(*(F.col("row").getField(c).alias(c) for c in df.columns))
    held = found.where(holds).join(key, "h", "left")
    mark = lambda x, r: F.struct(x["s"].alias("s"), x["e"].alias("e"), r.alias("r"))
    entities = F.transform(_labelled(F.col("base")), lambda x: mark(x, F.concat(F.lit("["), F.upper(x["k"]), F.lit("]"))))
    terms = F.transform(F.coalesce("places", F.array().cast(MARKS)), lambda x: mark(x, F.when(x["remove"], F.lit("[...]")).otherwise(_class(x["v"]))))
    held = held.withColumn("marks", F.concat(entities, terms)).withColumn("clean", replaced(F.col("text"), F.col("marks")))
    clean = held.select(*(F.col("clean").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in df.columns))
    return rest.unionByName(clean) if len(set(df.columns)) == len(df.columns) else rest.union(clean)
