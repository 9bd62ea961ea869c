"""Replacing personal data by keyed surrogates, in DataFrame functions only.

Entities are found by patterns: e-mail and IPv4 addresses, phone numbers (with a country code, in
groups, or ten digits), numbers of three, two and four digits, payment cards, secrets (assigned to a
name such as token or password, in quotes or, where they hold a digit, without; and keys of
well-known prefixes), and names after a title (Mr, Frau, Señora, Dr, г-н, ..., also in capitals), with
initials, particles and any number of words. A number in a card's form is a card if it stands alone;
next to other digits its check sum decides, for every place where one may begin. In a text where a name
was found, all other mentions of its words are replaced too, with or without a title. A match has the
kind of the alternative that matched. Every entity becomes a surrogate of its own type, drawn from
a keyed hash:

* letters stay letters of their case, digits digits, all other characters stay as they are,
  so the format is the entity's own; a hexadecimal secret stays hexadecimal;
* a card keeps its first digit and whether its check digit is right; an IPv4 address keeps
  four octets of up to three digits, each at most 255; a phone number keeps its country
  code; an e-mail address keeps the last two labels of its domain; initials and particles of
  names stay;
* a name is replaced word for word, by syllables of its script (Latin or Cyrillic) and an
  ending of the title's gender, in its letter case.

The same entity (e-mail: without regard to letter case) gets the same surrogate in all
documents; of names each word is an entity, together with the gender, so that "Mr John Smith"
and a later "Mr Smith" or "Smith" stay one person and "Mrs Smith" another. A word without a title
follows the first titled mention in its text. Distinct entities get distinct surrogates: of several
entities of a type that draw the same surrogate one keeps it and the others draw again, as do
those whose draw is itself an entity of the documents; the rounds end when none is left. So
that forms never run out, they grow with every ``GROW`` rounds: names get a syllable more a
word, e-mails a letter before and secrets one after, phones and other numbers a digit after; IPv4
octets get any length. Cards keep their form, of which there are 10^13. With forms so many times
those that collide, ``MOST_ROUNDS`` rounds suffice; if not, the run fails and leaks nothing.

The documents are written once with the key of those that hold an entity; only entities, and
texts that hold them, are shuffled, and equal texts are worked on once.

Defined results: a null text stays null, an empty one empty; entities are found in the whole
text; repeated rows change alike; noncharacters U+FDD0 to U+FDD3 go from texts that hold entities; columns other than text pass through unchanged, but for one
named n_replaced, which is replaced by the number of entities found; an empty table gives no
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Rounds after which what still collides draws from more forms.
GROW = 4
MOST_ROUNDS = 64
#: Noncharacters around cards that the check sum has told, around matches, and between their groups.
OPEN, CLOSE, EDGE, NEXT = "\uFDD0", "\uFDD1", "\uFDD2", "\uFDD3"
# Titles that a name follows, by gender, and particles of names.
MALE = ["Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "Г-н", "г-н", "господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Г-жа", "г-жа", "госпожа"]
EITHER = ["Dr", "Prof", "Professor", "Doctor", "доктор", "профессор"]
PARTICLES = ["von", "van", "der", "den", "de", "del", "della", "la", "le", "du", "di", "da", "zu", "zum"]
#: Names that a secret is assigned to, and prefixes of well-known keys.
ASSIGNED = r"(?i:(?=[tspa])(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,9}[=:]\s{0,9})"
PREFIXED = r"(?=[Agsxe])(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abp]-|eyJ)"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: A word of a name: two letters at least, or one before an apostrophe; a possessive s isn't part of it.
WORD = r"\p{Lu}(?:[\p{L}\p{M}]+|(?=['’]\p{L}))(?:['’](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*)*"
#: White space within a name, and after a title.
GAP, AFTER = r"[\x20\t\xA0]{1,9}", r"[\s\xA0]{1,9}"
NAME = rf"(?:(?:{'|'.join(PARTICLES)})\x20)*+(?:\p{{Lu}}\.\x20?)*+{WORD}(?:-{WORD})*"
TITLE = sorted({y for x in MALE + FEMALE + EITHER for y in (x, x.upper())}, key=lambda x: (-len(x), x))
#: A title; most places are ruled out by their first letter.
TITLES = rf"(?=[{''.join(sorted({x[0] for x in TITLE}))}])(?<!\p{{L}})(?:{'|'.join(TITLE)})"
#: A number as cards are written; one that stands alone, and all places where one may begin.
CARD = r"(?:\d{16}|\d{4}\x20\d{4}\x20\d{4}\x20\d{4}|\d{4}-\d{4}-\d{4}-\d{4}|3[47]\d{13}|3[47]\d{2}\x20\d{6}\x20\d{5}|3[47]\d{2}-\d{6}-\d{5})"
CANDIDATE = rf"(?<!\d)(?=[2-6])(?=({CARD})(?!\d))"
#: By kind, in order of precedence; without groups of their own.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.){1,126}[A-Za-z]{2,}(?![A-Za-z0-9])",
    "secret": rf"(?:{ASSIGNED}(?:[\"'][^\"'\s]{{6,}}(?=[\"'])|(?=[^\s\"']*\d)[A-Za-z0-9_+/=.~-]{{7,}}[A-Za-z0-9_+/=~-])|(?<![A-Za-z0-9]){PREFIXED}[A-Za-z0-9_.-]{{15,}}[A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": rf"{OPEN}[\d -]+{CLOSE}|(?<!\d)(?<!\d[ -]){CARD}(?!\d|[ -]\d)",
    "number": r"(?<![\p{L}\d+-])\d{3}-\d{2}-\d{4}(?!-?\d)",
    "phone": r"(?<![\p{L}\d+(])(?:\+\d(?:[ .()-]{0,2}\d){7,14}|(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{3,4}|[2-9]\d{9})(?!\d|[.-]\d)",
    "name": rf"{TITLES}\.?{AFTER}{NAME}(?:{GAP}{NAME})*+",
}
#: Any entity; the group that matched tells the kind.
ANY = "|".join(f"({p})" for p in PATTERNS.values())
#: Kinds whose digits are drawn and laid out as they were.
NUMBERS = ["card", "number", "phone"]
HINT = rf"[@0-9]|{ASSIGNED}|{PREFIXED}|{TITLES}[.\s\xA0]"
# Syllables of names by script.
LATIN = ["ba", "ben", "cor", "da", "del", "el", "far", "gan", "hal", "is", "jo", "ka", "lan", "mar", "ne", "or", "per", "ros", "sel", "ta", "ul", "ver", "wen", "ya", "zor"]
CYRILLIC = ["ба", "вен", "гор", "да", "дел", "ел", "жар", "зан", "кал", "ил", "йо", "ка", "лан", "мар", "не", "ор", "пет", "рос", "сел", "та", "ул", "фер", "хен", "ша", "яр"]


def _marked(text: Column) -> Column:
    """The text with marks around numbers that are cards by their check sum, whatever stands beside them."""
    valid = F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)), lambda c: _luhn(_digits(c)) == 0))
    mark = lambda t, c: F.regexp_replace(t, F.concat(F.lit(rf"(?<![\d{OPEN}])"), c, F.lit(r"(?!\d)")), F.lit(f"{OPEN}$0{CLOSE}"))
    return F.when(text.rlike(CANDIDATE), F.aggregate(valid, text, mark)).otherwise(text)


def _mentions(texts: DataFrame) -> DataFrame:
    """texts(node, text) that hold entities, with mentions: each match and its kind, by the group that took part in it; and parts: what lies between.

    One pass writes every match as its groups, of which all but one are empty; plain splits do the rest.
    """
    coded = F.regexp_replace("text", ANY, EDGE + NEXT.join(f"${i}" for i in range(1, len(PATTERNS) + 1)) + EDGE)
    rows = texts.select("node", F.split(coded, EDGE).alias("pieces"))
    of = lambda odd: F.filter("pieces", lambda p, i: i % 2 == odd)

    def mention(code):
        kind = F.raise_error(F.lit("a match without a kind")).cast("string")
        for i, k in reversed(list(enumerate(PATTERNS))):
            kind = F.when(F.get(F.split(code, NEXT), F.lit(i)) != "", F.lit(k)).otherwise(kind)
        return F.struct(F.translate(code, OPEN + CLOSE + NEXT, "").alias("match"), kind.alias("kind"))

    return rows.select("node", of(0).alias("parts"), F.transform(of(1), mention).alias("mentions")).filter(F.size("mentions") > 0)


def _prefix(kind: Column, entity: Column) -> Column:
    """The part of a match that stays: the assignment of a secret or its known prefix, the title of a name."""
    return F.when(kind == "secret", F.regexp_extract(entity, rf"^({ASSIGNED}[\"']?|{PREFIXED})", 1)).when(kind == "name", F.regexp_extract(entity, r"^([^\s\xA0]+[\s\xA0]+)", 1)).otherwise(F.lit(""))


def _gender(kind: Column, prefix: Column) -> Column:
    title = F.upper(F.regexp_replace(prefix, r"[.\s\xA0]+$", ""))
    of = lambda titles: (kind == "name") & title.isin([x.upper() for x in titles])
    return F.when(of(MALE), "m").when(of(FEMALE), "f").otherwise("n")


def _canonical(kind: Column, value: Column) -> Column:
    """What spellings of an entity have in common."""
    return F.when(kind == "email", F.lower(value)).when(kind.isin(NUMBERS), F.regexp_replace(value, r"[^0-9+]", "")).otherwise(value)


def _byte(draws: Column, i: Column) -> Column:
    """Number i (cyclic) of the drawn ones."""
    return F.element_at(draws, i % 96 + 1)


def _draws(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """96 numbers from 0 to 255 from the key, the entity and the attempt."""
    seed = lambda n: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), F.lit(str(n))), 256)
    pairs = F.regexp_extract_all(F.concat(seed(0), seed(1), seed(2)), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda x: F.conv(x, 16, 10).cast("int"))


def _characters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substr(value, i, F.lit(1)))


def _same_shape(value: Column, draws: Column, keep: Column, hexadecimal: Column) -> Column:
    """Letters to letters of the same case, digits to digits; the first ``keep`` characters stay."""

    def swap(c, i):
        b = _byte(draws, i)
        small = F.when(hexadecimal, F.char(97 + b % 6)).otherwise(F.char(97 + b % 26))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), F.upper(small)).otherwise(c)

    return F.when(F.length(value) > 0, F.array_join(F.transform(_characters(value), swap), "")).otherwise(value)


def _luhn(digits: Column) -> Column:
    """The check sum modulo 10 of a string of digits, its last digit included."""
    n = F.length(digits)
    parts = F.transform(_characters(digits), lambda c, i: F.when((n - i) % 2 == 0, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda s, x: s + x) % 10


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _laid_out(value: Column, digits: Column) -> Column:
    """The value with its digits replaced by these in turn, so that spellings of a number stay spellings of one."""

    def put(c, i):
        return F.when(c.rlike("[0-9]"), F.substr(digits, F.length(_digits(F.substr(value, F.lit(1), i + 1))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(_characters(value), put), "")


def _ip(value: Column, draws: Column, grown: int) -> Column:
    """Octets with as many digits as before; grown ones of any."""

    def octet(c, i):
        b = _byte(draws, i)
        if grown:
            return b.cast("string")
        return F.when(F.length(c) == 1, b % 10).when(F.length(c) == 2, 10 + b % 90).otherwise(100 + b % 156).cast("string")

    return F.array_join(F.transform(F.split(value, r"\."), octet), ".")


def _extra(draws: Column, grown: int, hexadecimal: Column) -> Column:
    """A letter for each growth."""
    letters = [F.char(97 + F.when(hexadecimal, _byte(draws, F.lit(95 - n)) % 6).otherwise(_byte(draws, F.lit(95 - n)) % 26)) for n in range(grown)]
    return F.concat(F.lit(""), *letters)


def _name(value: Column, draws: Column, gender: Column, grown: int) -> Column:
    """Syllables of the script, closed by an ending of the gender, in the word's letter case."""
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    pick = lambda table, b: F.element_at(F.array(*[F.lit(x) for x in table]), b % len(table) + 1)
    syllables = F.transform(F.sequence(F.lit(0), F.lit(2 + grown)), lambda k: F.when(cyrillic, pick(CYRILLIC, _byte(draws, k))).otherwise(pick(LATIN, _byte(draws, k))))
    latin_end = F.when(gender == "f", "ine").when(gender == "m", "en").otherwise("i")
    end = F.when(~cyrillic, latin_end).when(gender == "f", "ова").when(gender == "m", "ов").otherwise("ко")
    word = F.initcap(F.concat(F.array_join(syllables, ""), end))
    return F.when((F.length(value) > 2) & (value == F.upper(value)), F.upper(word)).otherwise(word)


def with_surrogate(entities: DataFrame, key: str, attempt: int) -> DataFrame:
    """entities(kind, value, canon, gender) with their surrogate at an attempt.

    Columns that later ones use many times are steps of their own, so that each is computed
    once a row.
    """
    kind, value, draws, grown = F.col("kind"), F.col("value"), F.col("draws"), attempt // GROW
    rows = entities.withColumn("draws", _draws(key, kind, F.col("canon"), F.lit(attempt)))
    rows = rows.withColumn("digits", F.when(kind.isin(NUMBERS), _digits(value)))
    # a card's first digit and a phone's country code stay
    stay = F.when(kind == "card", F.lit(1)).otherwise(F.length(F.regexp_extract(value, r"^\+(1|7|\d{2,3}(?=[ .(-]))", 1)))
    rows = rows.withColumn("drawn", F.when(F.col("digits").isNotNull(), _same_shape(F.col("digits"), draws, stay, F.lit(False))))
    # a card's last digit makes its check sum what the original's is
    n = F.length("drawn")
    off = F.when(kind == "card", (_luhn(F.col("digits")) - _luhn(F.col("drawn")) + 20) % 10)
    rows = rows.withColumn("off", off)
    last = (F.substr("drawn", n, F.lit(1)).cast("int") + F.col("off")) % 10
    rows = rows.withColumn("drawn", F.when(F.col("off").isNotNull(), F.concat(F.substr("drawn", F.lit(1), n - 1), last.cast("string"))).otherwise(F.col("drawn")))
    hexadecimal = (kind == "secret") & value.rlike("^[0-9a-fA-F]+$")
    rows = rows.withColumn("hexadecimal", hexadecimal).withColumn("local", F.regexp_extract(value, r"^([^@]*@(?:.*\.)?)[^.@]+\.[^.@]+$", 1))
    local = F.col("local")
    surrogate = (
        F.when(kind == "email", F.concat(_extra(draws, grown, F.lit(False)), _same_shape(local, draws, F.lit(0), F.lit(False)), F.substr(value, F.length(local) + 1, F.length(value))))
        .when(kind == "ip", _ip(value, draws, grown))
        .when(kind == "card", _laid_out(value, F.col("drawn")))
        .when(F.col("digits").isNotNull(), F.concat(_laid_out(value, F.col("drawn")), *[(_byte(draws, F.lit(95 - g)) % 10).cast("string") for g in range(grown)]))
        .when(kind == "name", _name(value, draws, F.col("gender"), grown))
        .otherwise(F.concat(_same_shape(value, draws, F.lit(0), F.col("hexadecimal")), _extra(draws, grown, F.col("hexadecimal"))))
    )
    return rows.select(*entities.columns, surrogate.alias("surrogate"))


def surrogate_map(entities: DataFrame, key: str) -> DataFrame:
    """kind, value, gender, surrogate for entities(kind, value, gender): distinct, and none an entity itself.

    Mentions of an entity that differ in spelling (letter case, grouping) draw from the same
    hash, so each keeps its own format; they count as one for distinctness. Rounds go on
    until nothing collides.
    """
    kind = F.col("kind")
    ids = entities.distinct().withColumn("plain", _canonical(kind, F.col("value")))
    ids = common.cut(ids.withColumn("canon", F.concat_ws(":", "gender", "plain")), "pii-entities")
    taken = ids.select("kind", F.col("plain").alias("drawn")).distinct()
    pending, done = ids.drop("plain"), None
    for attempt in range(MOST_ROUNDS):
        drawn = common.cut(with_surrogate(pending, key, attempt).withColumn("drawn", _canonical(kind, F.col("surrogate"))), "pii-drawn")
        owner = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("owner"))
        fits = owner.join(taken, ["kind", "drawn"], "left_anti")
        settled = drawn.join(fits, ["kind", "drawn"]).filter(F.col("owner") == F.col("canon"))
        settled = common.cut(settled.select("kind", "value", "gender", "canon", "surrogate", "drawn"), "pii-settled")
        own = settled.select("kind", "value", "gender", "surrogate")
        done = own if done is None else done.unionByName(own)
        last = pending
        pending = pending.join(settled.select("kind", "canon").distinct(), ["kind", "canon"], "left_anti")
        pending = common.cut(pending.select(*last.columns), "pii-pending")
        if pending.isEmpty():
            return done
        taken = taken.union(settled.select("kind", "drawn").distinct())
    raise RuntimeError(f"surrogates still collide after {MOST_ROUNDS} rounds")


def _woven(text: Column, pattern: str, new: Column) -> Column:
    """The text with its matches of a pattern replaced by the strings of an array in turn."""
    return F.array_join(F.transform(F.split(text, pattern, -1), lambda p, i: F.concat(p, F.coalesce(F.get(new, i), F.lit("")))), "")


def _bare_names(text: Column, names: Column) -> Column:
    """A stretch of text with the words that ``names`` holds replaced."""
    alone = rf"(?<!\p{{L}}){WORD}(?!\p{{L}})"
    words = F.transform(F.regexp_extract_all(text, F.lit(alone), F.lit(0)), lambda w: F.coalesce(F.try_element_at(names, w), w))
    return F.when(text.rlike(alone), _woven(text, alone, words)).otherwise(text)


def _free(name: str, columns: list[str]) -> str:
    while name in columns:
        name = f"_{name}"
    return name


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """docs(text, ...) with surrogates in the texts, and n_replaced."""
    text, kept = F.col("text"), [c for c in docs.columns if c != "n_replaced"]
    node_, new_, n_ = (_free(c, kept) for c in ("node", "new", "n"))
    with_node = common.cut(docs.select(*[F.col(f"`{c}`") for c in kept]).withColumn(node_, F.when(text.rlike(HINT) & text.rlike(f"{ANY}|{CANDIDATE}"), common.text_key())), "pii-docs")
    held = with_node.filter(F.col(f"`{node_}`").isNotNull())
    texts = held.select(F.col(f"`{node_}`").alias("node"), "text").groupBy("node").agg(F.first("text").alias("text"))
    # a number in a card's form among other digits may be no entity at all
    texts = texts.select("node", _marked(F.translate("text", OPEN + CLOSE + EDGE + NEXT, "")).alias("text"))
    found = common.cut(_mentions(texts), "pii-texts")
    mention = found.select("node", F.posexplode("mentions").alias("at", "m")).select("node", "at", "m.match", "m.kind")
    mention = mention.withColumn("prefix", _prefix(F.col("kind"), F.col("match")))
    mention = mention.withColumn("value", F.substr("match", F.length("prefix") + 1, F.length("match"))).withColumn("gender", _gender(F.col("kind"), F.col("prefix")))
    # a name is taken word by word, with what stands before each word and after the last
    name = F.col("kind") == "name"
    mention = mention.withColumn("between", F.when(name, F.split("value", WORD, -1)).otherwise(F.array(F.lit(""), F.lit(""))))
    mention = mention.withColumn("words", F.when(name, F.regexp_extract_all("value", F.lit(WORD), F.lit(0))).otherwise(F.array("value")))
    words = mention.select("node", "at", "kind", "gender", "prefix", "between", F.posexplode("words").alias("k", "value"))
    before = F.concat(F.when(F.col("k") == 0, F.col("prefix")).otherwise(F.lit("")), F.get("between", F.col("k")))
    after = F.when(F.col("k") == F.size("between") - 2, F.get("between", F.col("k") + 1)).otherwise(F.lit(""))
    words = common.cut(words.select("node", "at", "k", "kind", "gender", "value", before.alias("before"), after.alias("after")), "pii-mentions")
    mapped = words.join(surrogate_map(words.select("kind", "value", "gender"), key), ["kind", "value", "gender"])
    mapped = common.cut(mapped.select("node", "at", "k", "kind", "value", "surrogate", F.concat("before", "surrogate", "after").alias("new")), "pii-mapped")
    each = mapped.groupBy("node", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "new"))), lambda x: x["new"]), "").alias("new"))
    news = each.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "new"))), lambda x: x["new"]).alias("news"))
    named = mapped.filter(F.col("kind") == "name").groupBy("node", "value").agg(F.min_by("surrogate", F.struct("at", "k")).alias("surrogate"))
    named = named.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("names"))
    rows = found.join(news, "node").join(named, "node", "left")
    parts = F.when(F.col("names").isNull(), F.col("parts")).otherwise(F.transform("parts", lambda p: _bare_names(p, F.col("names"))))
    woven = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get("news", i), F.lit("")))), "")
    new = rows.select(F.col("node").alias(node_), woven.alias(new_), F.size("news").alias(n_))
    quoted = lambda c: F.col(f"`{c}`")
    columns = [F.coalesce(quoted(new_), text).alias("text") if c == "text" else quoted(c) for c in kept]
    changed = held.join(new, node_, "left").select(*columns, F.coalesce(quoted(n_), F.lit(0)).alias("n_replaced"))
    clean = with_node.filter(quoted(node_).isNull()).select(*[quoted(c) for c in kept], F.lit(0).alias("n_replaced"))
    return clean.unionByName(changed)
