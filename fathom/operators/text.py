"""Chunks, keywords, entities, languages, intents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions.dense import col

from fathom.functions.lexicon import (
    CAUSE_SIGNS, CODE_SIGNS, COMMON_WORDS, DOMAIN_SIGNS, EFFECT_SIGNS, ENTITIES, NEGATIONS, PRODUCES_SIGNS, PROFILE_WORDS, RELATION_SIGNS, RESULTS_SIGNS, SOURCE_SIGNS, STOP_WORDS,
    TARGET_SIGNS,
)
from fathom.functions.phrases import affirmed

CODE_WORDS, ENTITY_WORDS = ("function", "class", "method", "implement", "struct", "code"), ("who", "entity", "person", "company", "organization")
#: Characters before a phrase in which a negation counts, and what an expanded question gets (fixed values).
NEGATION_REACH = 15
EXPANSIONS = {"cause": (("cause", "reason", "why"), " cause reason root source"), "effect": (("effect", "result", "happen"), " effect result consequence outcome")}


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200, overlap: int = 50) -> DataFrame:
    """(id, chunk, start_word, end_word, text) of at most `size` words, each with `overlap` of the chunk before; a text without words has none."""
    own = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    step = size - overlap
    rows = docs.select(F.col(key).alias("id"), own.alias("w")).where(F.size("w") > 0)
    count = F.greatest(F.lit(1), F.ceil((F.size("w") - overlap) / step).cast("int"))
    each = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("chunk") * step
    part = F.slice("w", start + 1, F.lit(size))
    return each.select("id", "chunk", start.alias("start_word"), (start + F.size(part)).alias("end_word"), F.array_join(part, " ").alias("text"))


def sentence_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 200, overlap: int = 50) -> DataFrame:
    """As chunks, but a chunk ends at the last sentence end in its last fifth, if there is one, and the next begins `overlap` words before that end.

    Each start depends on the end before, so one fold goes over the row's words.
    """
    own = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    rows = docs.select(F.col(key).alias("id"), own.alias("w")).where(F.size("w") > 0)
    n = F.size("w")

    def step(bounds: Column, _: Column) -> Column:
        last = F.element_at(bounds, -1)
        start = F.when(F.size(bounds) == 0, 0).otherwise(F.greatest(last["start"] + 1, last["end"] - overlap))
        full = F.least(start + size, n)
        tail = F.filter(F.sequence(F.greatest(start + int(size * 0.8), F.lit(1)), F.greatest(full, F.greatest(start + int(size * 0.8), F.lit(1)))), lambda i: (i <= full) & F.element_at(F.col("w"), F.least(i, n)).rlike("[.!?]$"))
        end = F.when((full < n) & (F.size(tail) > 0), F.array_max(tail)).otherwise(full)
        done = (F.size(bounds) > 0) & (last["end"] >= n)
        return F.when(done, bounds).otherwise(F.concat(bounds, F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))))

    empty = F.array().cast("array<struct<start:int,end:int>>")
    rounds = F.sequence(F.lit(0), F.ceil(n / (int(size * 0.8) - overlap)).cast("int"))
    each = rows.select("id", "w", F.posexplode(F.aggregate(rounds, empty, step)).alias("chunk", "b"))
    return each.select("id", "chunk", F.col("b.start").alias("start_word"), F.col("b.end").alias("end_word"), F.array_join(F.slice("w", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")), " ").alias("text"))


def _literals(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _count(text: Column, signs) -> Column:
    """How many of the signs a text contains."""
    return F.size(F.filter(_literals(signs), lambda p: F.contains(text, p)))


def keywords(text: Column | str) -> Column:
    """Lower-case words of letters, digits, _ and - of two bytes or more that are no stop words, each once, as first seen."""
    own = F.filter(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_-]+"), lambda w: F.octet_length(w) >= 2)
    return F.array_except(F.array_distinct(own), _literals(STOP_WORDS))


def mentions(text: Column | str) -> Column:
    """Words, less marks around them, that may name something: with a capital, all capitals and digits, with _ or - inside, or known; in order, repeated.

    Words under two bytes and common ones are none.
    """
    bare = F.transform(F.split(col(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}_-]+|[^\p{L}\p{N}_-]+$", ""))
    sign = lambda w: w.rlike(r"^\p{Lu}|^[\p{Lu}\p{N}]+$|[_-]") | F.lower(w).isin([n for own in ENTITIES.values() for n in own])
    return F.filter(bare, lambda w: (F.octet_length(w) >= 2) & ~F.lower(w).isin(list(COMMON_WORDS)) & sign(w))


def entities(text: Column | str) -> Column:
    """What a text may name, in lower case, each once, as first seen."""
    return F.array_distinct(F.transform(mentions(text), F.lower))


def entity_links(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, entity, surface, kind, confidence): what each row names, as first written; kinds that are known have confidence 1, others 0.5."""
    rows = docs.select(F.col(key).alias("id"), F.posexplode(mentions(text)).alias("pos", "surface")).withColumn("entity", F.lower("surface"))
    each = rows.groupBy("id", "entity").agg(F.min_by("surface", "pos").alias("surface")).withColumn("kind", kind_of("entity"))
    return each.withColumn("confidence", F.when(F.col("kind") == "Unknown", 0.5).otherwise(1.0))


def capitalised(text: Column | str, least: int = 4) -> Column:
    """Distinct words of unaccented letters that begin with a capital and go on in small ones, sorted."""
    words = F.array_distinct(F.split(col(text), r"[^\p{L}]+"))
    return F.array_sort(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]{%d,}$" % (least - 1))))


def kind_of(entity: Column | str) -> Column:
    out = None
    for kind, names in reversed(ENTITIES.items()):
        out = F.when(col(entity).isin(*names), kind) if out is None else out.when(col(entity).isin(*names), kind)
    return out.otherwise("Unknown")


def code_scores(text: Column | str) -> Column:
    """Signs of each language of code in a text, 3 at most."""
    t = F.lower(col(text))
    return F.array(*[F.least(_count(t, signs), F.lit(3)) for signs in CODE_SIGNS.values()])


def code_language(text: Column | str) -> Column:
    """The language with most signs (a third each, 1 at most), the later of equals; null without any."""
    names = _literals(CODE_SIGNS)
    best = F.array_max(F.transform(code_scores(text), lambda n, i: n * 100 + i))
    return F.when(best >= 100, F.element_at(names, (best % 100 + 1).cast("int")))


def code_confidence(text: Column | str) -> Column:
    return F.array_max(code_scores(text)) / 3


def _begun(signs: tuple[str, ...]) -> str:
    return r"\b(" + "|".join(signs) + ")"


def _larger(a: Column, b: Column, one: str, two: str, tie: str = "unknown") -> Column:
    return F.when(a > b, one).when(b > a, two).when(a > 0, tie).otherwise("unknown")


def _intents(text: Column | str, patterns: dict[str, str] | None = None) -> Column:
    return affirmed(text, {"cause": CAUSE_SIGNS, "effect": EFFECT_SIGNS}, NEGATIONS, NEGATION_REACH, patterns)


def _direction(found: Column) -> Column:
    return _larger(found["cause"], found["effect"], "cause", "effect", "cause")


def intent(text: Column | str) -> Column:
    """Whether a question seeks a cause or an effect, by phrases that are not negated; a tie of some is cause, none unknown."""
    return _direction(_intents(text))


def content_direction(text: Column | str) -> Column:
    """Whether a content tells of a cause or of an effect; a tie is unknown."""
    t = F.lower(col(text))
    return _larger(_count(t, PRODUCES_SIGNS), _count(t, RESULTS_SIGNS), "cause", "effect")


def graph_intent(text: Column | str) -> Column:
    """Whether a question seeks sources (what uses it) or targets (what it uses); a tie of some is source."""
    t = F.lower(col(text))
    return _larger(_count(t, SOURCE_SIGNS), _count(t, TARGET_SIGNS), "source", "target", "source")


def expanded(text: Column | str, direction: Column | None = None) -> Column:
    """A question with fixed terms of its direction behind it, unless it has one of them; the direction is its intent if none is given, found by the same search."""
    t, terms = col(text), {f"{kind}_terms": "|".join(present) for kind, (present, _) in EXPANSIONS.items()}
    found = _intents(t, terms) if direction is None else affirmed(t, {}, NEGATIONS, NEGATION_REACH, terms)
    own = _direction(found) if direction is None else direction
    out = F.when(F.lit(False), t)
    for kind, (_, more) in EXPANSIONS.items():
        out = out.when((own == kind) & ~found[f"{kind}_terms"], F.concat(t, F.lit(more)))
    return out.otherwise(t)


def domain(text: Column | str) -> Column:
    """code, legal, academic or general: two signs at least, code before the others only with the most, legal before academic with more than code."""
    t = F.lower(col(text))
    code, legal, academic = (_count(t, [p.lower() for p in DOMAIN_SIGNS[k]]) for k in ("code", "legal", "academic"))
    return F.when((code >= 2) & (code > legal) & (code > academic), "code").when((legal >= 2) & (legal > code), "legal").when((academic >= 2) & (academic > code), "academic").otherwise("general")


def domain_of_pair(a: Column, b: Column) -> Column:
    """The domain of two texts' domains: the one they share or the one that isn't general."""
    return F.when(a == b, a).when(a == "general", b).when(b == "general", a).otherwise("general")


def relation_kinds(text: Column | str) -> Column:
    """Kinds of relations of which a text has a sign, in the order of the list."""
    t = F.lower(col(text))
    found = [F.when(_count(t, signs) > 0, F.lit(kind)) for kind, signs in RELATION_SIGNS.items()]
    return F.array_compact(F.array(*found))


def lexical_boost(text: Column | str) -> Column:
    """How much exact terms matter for a question, 0.5 to 2: paths of code, versions, acronyms and names raise it."""
    t = col(text)
    path = F.contains(t, F.lit("::")) | F.contains(t, F.lit("->")) | (F.contains(t, F.lit(".")) & t.rlike("fn |impl |struct |trait "))
    version, acronym, name = t.rlike(r"(^|\s)v[0-9]|[0-9]+\.[0-9]+"), t.rlike(r"(^|\s)[A-Z]{2,}(\s|$)"), t.rlike(r"\s[A-Z][a-z]+")
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    return F.least(F.lit(2.0), F.greatest(F.lit(0.5), 1.0 + part(path, 0.5) + part(version, 0.3) + part(acronym, 0.3) + part(name, 0.2)))


def route(text: Column | str) -> Column:
    """Type of a query: code, causal, entity or general."""
    found = _intents(text, {"code": _begun(CODE_WORDS), "entity": _begun(ENTITY_WORDS)})
    return F.when(found["code"], "code").when(_direction(found) != "unknown", "causal").when(found["entity"], "entity").otherwise("general")


def profile_match(text: Column | str) -> Column:
    """(profile, similarity): the profile with most of its words in the text, a fifth for each and 1 at most, the first of equals; of no word the first, with 0.1."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    share = lambda words: F.least(F.lit(1.0), F.lit(0.2) * sum((F.contains(t, F.lit(w)).cast("int") for w in words), F.lit(0)))
    each = [F.struct(share(words).alias("similarity"), F.lit(-i).alias("place"), F.lit(name).alias("profile")) for i, (name, words) in enumerate(PROFILE_WORDS.items())]
    best, first = F.greatest(*each), next(iter(PROFILE_WORDS))
    some = best["similarity"] > 0
    return F.struct(F.when(some, best["profile"]).otherwise(first).alias("profile"), F.when(some, best["similarity"]).otherwise(0.1).alias("similarity"))


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.trim(F.lower(col(text))), 256)


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, section, title, body) of texts with # headings; what stands before the first has no title."""
    parts = F.split(text, r"(?m)^(?=#{1,6} )")
    rows = docs.select(F.col(key).alias("id"), F.posexplode(F.filter(parts, lambda p: F.trim(p) != "")).alias("section", "p"))
    return rows.select("id", "section", F.nullif(F.regexp_extract("p", r"^#{1,6} (.*)", 1), F.lit("")).alias("title"), F.regexp_replace("p", r"^#{1,6} .*\n?", "").alias("body"))


def code_units(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, unit, name, line) of function and type definitions, by pattern."""
    sign = r"^\s*(?:pub |async |export )*(fn|def|class|struct|enum|trait|function|impl)\s+(\w+)"
    rows = docs.select(F.col(key).alias("id"), F.posexplode(F.split(text, "\n")).alias("pos", "l")).where(F.col("l").rlike(sign))
    return rows.select("id", F.regexp_extract("l", sign, 1).alias("unit"), F.regexp_extract("l", sign, 2).alias("name"), (F.col("pos") + 1).alias("line"))
