"""Text operators: chunks, sentences, dictionary matches, list parsing, and rule-based labels."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import MISSING, dataclass, field, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import around, spans

CHUNK_CHARS = 500
# Marks to cut a chunk after, by priority.
BREAK_MARKS = (". ", "! ", "? ", "다. ", "요. ", "\n", " ")


_BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_BLANK = f"[{_BLANKS}]"


def chunks(text: Column, limit: int = CHUNK_CHARS) -> Column:
    """Pieces of at most ``limit`` characters: the rest of the text if it fits, else up to the foremost mark whose last place lies past the middle, else ``limit`` characters.

    One pattern says so: its branches stand in that order, and each takes as many characters as it can. White space
    around pieces goes. A null or empty text has none.
    """
    marks = [rf".{{{limit // 2 + 1},{limit - len(m)}}}{re.escape(m)}" for m in BREAK_MARKS if limit - len(m) > limit // 2]
    branches = "|".join([rf".{{1,{limit}}}+\z", *marks, f".{{1,{limit}}}"])
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    pieces = F.regexp_extract_all(body, F.lit(f"(?s){_BLANK}*({branches})"), 1)
    return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(_BLANKS))), lambda p: p != "")


def chunk_table(docs: DataFrame, doc: str, text: str, normalize=None) -> DataFrame:
    """(doc, ordinal, chunk_id, chunk, digest): ids are ``doc#ordinal`` from 0."""
    body = F.col(text) if normalize is None else normalize(F.col(text))
    c = docs.select(doc, F.posexplode(chunks(body)).alias("ordinal", "chunk"))
    return c.select(doc, "ordinal", F.concat(F.col(doc).cast("string"), F.lit("#"), F.col("ordinal").cast("string")).alias("chunk_id"), "chunk", F.md5(F.col("chunk").cast("binary")).alias("digest"))


def sentences(text: Column, minimum: int = 4) -> Column:
    """Sentences longer than ``minimum`` characters; the whole text if there is none."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: F.length(s) > minimum)
    whole = F.trim(text)
    return F.when(F.size(parts) > 0, parts).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))


def match_terms(docs: DataFrame, text: str, terms: DataFrame, term: str, key: str) -> DataFrame:
    """Rows of ``docs`` with each dictionary term that their text has, and its first place, whatever the letters' case.

    A term that starts with a Latin letter or a digit is met as a whole word; one in another script anywhere, as
    its words carry endings. Words and pairs of characters of the texts are met with the dictionary by equality, so
    the work does not grow with texts times terms; only (``key``, term) is shuffled, and a text comes back once for
    all its candidates. Rows of one key are taken for one.
    """
    low = F.lower(text)
    latin = F.lower(term).rlike("^[a-z0-9]")
    t = terms.withColumn("__w", F.when(latin, F.regexp_extract(F.lower(term), "^[a-z0-9]+", 0)).otherwise(F.substring(F.lower(term), 1, 2))).where(F.length("__w") > 0)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), 0)
    # each character of another script, and with the one after it
    others = F.concat(F.regexp_extract_all(low, F.lit("[^\\x00-\\x7f]"), 0), F.regexp_extract_all(low, F.lit("(?s)(?=([^\\x00-\\x7f].))"), 1))
    named = docs.select(key, F.explode(F.array_distinct(F.concat(words, others))).alias("__w"))
    met = named.join(t, "__w").drop("__w").groupBy(key).agg(F.collect_set(F.struct(*terms.columns)).alias("__t"))
    found = docs.join(met, key).withColumn("__t", F.explode("__t")).select(*docs.columns, "__t.*")
    bound = lambda p: F.when(latin, F.lit(p)).otherwise("")
    pattern = F.concat(bound("(?<![a-z0-9])"), F.lit(r"\Q"), F.lower(term), F.lit(r"\E"), bound("(?![a-z0-9])"))
    return found.withColumn("span_start", F.regexp_instr(low, pattern) - 1).where("span_start >= 0")


# Marks that go from an ingredient list, and how deep parentheses are followed.
MARK = r"\[[^\]]*\]"
DEPTH = 8


def balanced(depth: int) -> str:
    """A pattern of balanced parentheses, that many inside each other."""
    inner = r"\([^()]*+\)"
    for _ in range(depth - 1):
        inner = rf"\((?:[^()]++|{inner})*+\)"
    return inner


def list_names(text: Column, separators: str = ",@") -> Column:
    """An array of the names of an ingredient list: cut at separators outside parentheses; bracketed marks go. A parenthesis without its partner hides nothing. None for a null text."""
    cut = re.escape(separators)
    names = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), MARK, " "), F.lit(rf"(?:{balanced(DEPTH)}|[^{cut}(]++|\()++"), 0)
    return F.filter(F.transform(names, lambda n: F.regexp_replace(n, r"(?U)^\s+|\s+$", "")), lambda n: n != "")


#: Matches nothing.
NEVER = "(?!)"
# How many characters before and after an aspect can negate it, those before a request that can name its
# object, and those around a name that can hold a product's word. The reasons that ``judged`` gives are fixed, too.
BEFORE, AFTER = 22, 16
REQUEST_WINDOW = 30
NAME_WINDOW = 25


@dataclass(frozen=True)
class PolarityRules:
    """Patterns of a rule-based polarity judge; a language is a set of them. ``aspects`` are (name, pattern, neutral noun), first ones first.

    An aspect is negated by ``after`` within AFTER characters behind it or ``before`` within BEFORE characters before
    it, and not the product's own after ``context``. ``skin`` speaks of a kind of reader, whom ``warning`` warns;
    after ``contrast`` comes what counts. A ``wish`` is no praise, but where ``negated_tail`` goes on.
    """

    positive: str
    negative: str
    negated_positive: str
    wish: str
    before: str = r"(?:\bno|\bnot|\bnever|\bwithout)\s*$"
    after: str = r"^.{0,14}?(?:\bnot\b|\bnone\b|\bgone\b)"
    aspects: tuple[tuple[str, str, bool], ...] = field(default=())
    negated_tail: str = NEVER
    context: str = NEVER
    skin: str = NEVER
    warning: str = NEVER
    contrast: str = NEVER


def judged(rules: PolarityRules, s: Column) -> Column:
    """A struct (aspect, polarity, reason) of a sentence: complaint, satisfied or neutral, by the first rule that holds. A null sentence is an empty one."""
    s = F.coalesce(s, F.lit(""))
    has = lambda p, t=s: F.coalesce(t.rlike(p), F.lit(False))

    def hits(name: str, pattern: str, neutral: bool) -> Column:
        def one(m: Column) -> Column:
            before, after = around(s, m["start"] - BEFORE, m["start"]), around(s, m["stop"], m["stop"] + AFTER)
            off = F.when(before.rlike(rules.context), F.lit(None)).otherwise(after.rlike(rules.after) | before.rlike(rules.before))
            return F.struct(F.lit(name).alias("aspect"), F.lit(neutral).alias("neutral"), off.alias("negated"), m["start"].alias("start"))

        return F.transform(spans(s, pattern), one)

    kind = "array<struct<aspect:string,neutral:boolean,negated:boolean,start:int>>"
    every = F.concat(*[hits(*a) for a in rules.aspects]).cast(kind) if rules.aspects else F.array().cast(kind)
    turn = F.try_element_at(spans(s, rules.contrast), F.lit(1))
    unlike = has(rules.negated_positive)
    told = F.struct(
        every.alias("every"), turn.alias("turn"), (has(rules.negative) | unlike).alias("neg"), unlike.alias("unlike"),
        (has(rules.positive) & ~unlike & ~(has(rules.wish) & ~has(rules.negated_tail))).alias("pos"),
    )

    def ruled(x: Column) -> Column:
        some = lambda cond, of=None: F.filter(x["every"] if of is None else of, cond)
        own, other = some(lambda h: h["negated"].isNotNull()), some(lambda h: h["negated"].isNull())
        negated, bare = some(lambda h: h["negated"]), some(lambda h: ~h["negated"] & ~h["neutral"])
        nouns = some(lambda h: ~h["negated"] & h["neutral"])
        tail = some(lambda h: h["negated"].isNotNull() & (h["start"] >= x["turn"]["start"]))
        said = around(s, x["turn"]["stop"], F.length(s))
        first = lambda *of: F.coalesce(*[F.try_element_at(h, F.lit(1))["aspect"] for h in of])
        any_ = lambda h: F.size(h) > 0
        pos, neg = x["pos"] & ~x["neg"], x["neg"] & ~x["pos"]
        reader, turned = has(rules.skin) & ~has(rules.contrast), x["turn"].isNotNull()
        tail_bare = some(lambda h: ~h["negated"] & ~h["neutral"], tail)
        behind = around(s, F.try_element_at(negated, F.lit(1))["start"], F.length(s))
        # in order: when, aspect, polarity, reason
        table = [
            (reader & (has(rules.warning) | x["unlike"]), first(own, other), "complaint", "warning-to-others"),
            (reader & pos & any_(own), first(own), "satisfied", "skin-ctx+pos"),
            (reader, first(own, other), "neutral", "skin-context"),
            (~any_(own) & neg, first(other), "complaint", "neg-only"),
            (~any_(own) & pos, first(other), "satisfied", "pos-only"),
            (~any_(own) & any_(other), first(other), "neutral", "context-only"),
            (~any_(own), F.lit(None).cast("string"), "neutral", "no-aspect"),
            (turned & any_(tail_bare) & has(rules.negative, said), first(tail_bare), "complaint", "contrast-tail-raw"),
            (turned & (has(rules.positive, said) | F.exists(tail, lambda h: h["negated"])), first(tail, own), "satisfied", "contrast-tail-pos"),
            (any_(bare) & pos & any_(negated) & (F.size(negated) >= F.size(bare)), first(bare), "satisfied", "mostly-negated+pos"),
            (any_(bare), first(bare), "complaint", "aspect-raw"),
            (any_(nouns) & ~any_(negated) & neg, first(nouns), "complaint", "neutral-aspect+neg"),
            (any_(nouns) & ~any_(negated) & x["pos"], first(nouns), "satisfied", "neutral-aspect+pos"),
            (any_(nouns) & ~any_(negated), first(nouns), "neutral", "neutral-aspect-only"),
            (neg & ~has(rules.after, behind), first(negated), "complaint", "aspect-negated+neg"),
        ]
        out = F.struct(first(negated).alias("aspect"), F.lit("satisfied").alias("polarity"), F.lit("aspect-negated").alias("reason"))
        for when, aspect, polarity, reason in reversed(table):
            out = F.when(when, F.struct(aspect.alias("aspect"), F.lit(polarity).alias("polarity"), F.lit(reason).alias("reason"))).otherwise(out)
        return out

    # through an array of one, so that what the rules look at is found once
    return F.element_at(F.transform(F.array(told), ruled), 1)


def rules_of(kind: type, rows: DataFrame, version: int | None = None, most: int = 20_000):
    """``PolarityRules`` or ``WishRules`` of a versioned dictionary (slot, name, pattern, neutral, place, active, version): patterns of a slot are alternatives.

    Without a ``version`` the active one counts, of which there must be one. Slot ``aspect`` gives the aspects, those of a
    name in one pattern, the first by place first. A slot that the dictionary lacks keeps its default, or matches nothing.
    """
    if version is None:
        found = [r[0] for r in rows.where("active").select("version").distinct().limit(2).collect()]
        if len(found) != 1:
            raise ValueError(f"{len(found) or 'no'} active versions of the dictionary" if len(found) != 2 else "more than one active version of the dictionary")
        version = found[0]
    entries = rows.where(F.col("version") == version).select("slot", "name", "pattern", "neutral", "place").limit(most + 1).collect()
    if len(entries) > most:
        raise ValueError(f"more than {most} patterns: find names with a dictionary instead")
    entries.sort(key=lambda r: (r.place is None, r.place, r.pattern))
    slots: dict[str, list[str]] = {}
    aspects: dict[str, list] = {}
    for r in entries:
        if r.slot == "aspect":
            aspects.setdefault(r.name, []).append(r)
        else:
            slots.setdefault(r.slot, []).append(r.pattern)
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(slots) - set(known)):
        raise ValueError(f"no slot {', '.join(unknown)}")
    told: dict = {name: "|".join(f"(?:{p})" for p in patterns) for name, patterns in slots.items()}
    told |= {name: NEVER for name, f in known.items() if name not in told and f.default is MISSING and f.default_factory is MISSING}
    if aspects:
        told["aspects"] = tuple((name, "|".join(f"(?:{r.pattern})" for r in own), bool(own[0].neutral)) for name, own in aspects.items())
    return kind(**told)


@dataclass(frozen=True)
class WishRules:
    """Patterns of wish classes; a language is a set of them. See ``wish_class``."""

    launch: str  # asks for a product to come out
    launched: str  # says that one did
    again: str  # asks for it once more, whatever was said
    not_launch: str
    less: str  # before the marker: fewer symptoms are to come, not products
    content: str  # words of videos and posts
    content_no_market: str
    over_content: str  # launch markers that outweigh them
    channel: str
    asked: str  # asks why there is no such product
    asked_not: str
    demand: str  # asks a creator for content at once
    request: str  # an ending that asks
    request_bad: str
    request_object: str
    hope: str
    not_hope: str


def wish_class(rules: WishRules, s: Column) -> Column:
    """A struct (kind, marker) of a sentence: a for a product to be launched, b for content of a creator, c for any other wish, n for none."""
    s = F.coalesce(s, F.lit(""))
    has = lambda p, t=s: t.rlike(p)
    first = lambda p: F.try_element_at(spans(s, p), F.lit(1))
    told = F.struct(first(rules.launch).alias("launch"), first(rules.asked).alias("asked"), first(rules.demand).alias("demand"), first(rules.hope).alias("hope"), spans(s, rules.request).alias("requests"))

    def ruled(x: Column) -> Column:
        stated = (has(rules.launched) & ~has(rules.again)) | has(rules.not_launch)
        launch = x["launch"].isNotNull() & ~stated & ~has(f"(?:{rules.less})$", around(s, F.lit(0), x["launch"]["start"]))
        asks = F.filter(x["requests"], lambda m: ~has(rules.request_bad, around(s, m["start"] - 6, m["stop"] + 4)) & has(rules.request_object, around(s, m["start"] - REQUEST_WINDOW, m["stop"])))
        table = [
            (launch & ~has(rules.content), "a", x["launch"]["found"]),
            (x["asked"].isNotNull() & ~has(rules.content_no_market) & ~has(rules.asked_not), "a", x["asked"]["found"]),
            (launch & has(rules.over_content) & ~has(rules.channel), "a", x["launch"]["found"]),
            (x["demand"].isNotNull() & ~has(rules.request_bad), "b", x["demand"]["found"]),
            (F.size(asks) > 0, "b", F.try_element_at(asks, F.lit(1))["found"]),
            (x["hope"].isNotNull() & ~has(rules.not_hope), "c", x["hope"]["found"]),
        ]
        out = F.struct(F.lit("n").alias("kind"), F.lit("").alias("marker"))
        for when, kind, marker in reversed(table):
            out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), marker.alias("marker"))).otherwise(out)
        return out

    return F.element_at(F.transform(F.array(told), ruled), 1)


@dataclass(frozen=True)
class Surface:
    """A way to write an entity's name; ``tier``: ``link``, ``stop`` (never) or ``near`` (only near a product's word)."""

    surface: str
    canonical: str
    kind: str
    tier: str = "link"


def surface_hits(text: Column, surfaces: Sequence[Surface], product_words: str, left: str = r"(?<![\p{L}\p{N}])", right: str = r"(?![\p{L}\p{N}])", window: int = NAME_WINDOW) -> Column:
    """An array of (kind, canonical, surface, start, stop, near) of the names in a text, whatever the letters' case.

    Longer surfaces are tried first, and those of one length by name; of one surface's entries the first counts.
    ``near`` tells that a product's word stands within ``window`` characters of it.
    """
    first: dict[str, Surface] = {}
    for x in surfaces:
        first.setdefault(x.surface.lower(), x)
    stopped = {x.canonical for x in surfaces if x.tier == "stop"}
    known = {k: x for k, x in first.items() if x.canonical not in stopped}
    if not known:
        return F.array().cast("array<struct<kind:string,canonical:string,surface:string,start:int,stop:int,near:boolean>>")
    names = "|".join(re.escape(k) for k in sorted(known, key=lambda k: (-len(k), k)))
    strict = {x.canonical for x in surfaces if x.tier == "near"}
    said = F.create_map(*[F.lit(v) for k, x in sorted(known.items()) for v in (k, f"{x.kind}\t{x.canonical}")])

    def one(m: Column) -> Column:
        parts = F.split(F.try_element_at(said, F.lower(m["found"])), "\t")
        near = around(text, m["start"] - window, m["stop"] + window).rlike(product_words)
        return F.struct(parts[0].alias("kind"), parts[1].alias("canonical"), m["found"].alias("surface"), m["start"].alias("start"), m["stop"].alias("stop"), near.alias("near"))

    hits = F.transform(spans(text, f"(?iu){left}(?:{names}){right}"), one)
    return F.filter(hits, lambda h: h["near"] | ~h["canonical"].isin(sorted(strict))) if strict else hits


def candidate_sentences(units: DataFrame, ref: str, text: str, rating: str, wish: str, complaint: str, low: float = 2) -> DataFrame:
    """(ref, sentence, kind): sentences that wish, else complain, else come with a low rating; the first of equal ones."""
    s = units.select(ref, rating, F.posexplode(sentences(F.col(text))).alias("__i", "sentence"))
    kind = F.when(F.col("sentence").rlike(wish), "wish").when(F.col("sentence").rlike(complaint), "complaint").when(F.col(rating) <= low, "low_rating")
    s = s.withColumn("kind", kind).where("kind is not null")
    n = F.row_number().over(Window.partitionBy(ref, "sentence").orderBy("__i"))
    return s.withColumn("__n", n).where("__n = 1").select(ref, "sentence", "kind")


def candidate_terms(brand: Column, name: Column, generic: Column, cap: int = 3) -> Column:
    """Search terms of a product: brand, line and category; line and category; brand and line; the line alone without the other two.

    The line is the name without generic words and the brand's own, the category its last generic word. No line, no terms.
    """
    words = lambda c: F.filter(F.split(F.trim(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != "")
    of_line = F.array_except(F.array_distinct(words(name)), F.array_union(generic, words(brand)))
    line = F.nullif(F.array_join(F.filter(words(name), lambda w: F.array_contains(of_line, w)), " "), F.lit(""))
    category = F.try_element_at(F.filter(words(name), lambda w: F.array_contains(generic, w)), F.lit(-1))
    own = F.nullif(F.trim(F.coalesce(brand, F.lit(""))), F.lit(""))
    shapes = F.array(F.concat(own, F.lit(" "), line, F.lit(" "), category), F.concat(line, F.lit(" "), category), F.concat(own, F.lit(" "), line), F.when(own.isNull() & category.isNull(), line))
    return F.slice(F.array_distinct(F.array_compact(shapes)), 1, cap)


def fingerprint(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a digest of a table as a multiset, whatever the order of its rows and parts.

    Rows' digests meet in 65,536 buckets by their first four digits, each bucket's sorted digests give one, and these
    give the last; so no task has all rows, and the top one has a digest for each bucket at most.
    """
    line = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)
    whole = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), "").cast("binary"), 256)
    buckets = rows.select(line.alias("h")).groupBy(F.left("h", F.lit(4)).alias("b")).agg(whole(F.col("h")).alias("d"))
    return buckets.agg(whole(F.concat("b", "d")).alias("fingerprint"))
