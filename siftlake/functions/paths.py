"""Paths and file-name marks, as columns. Separators are '/'."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks of file names and the tokens that stand for them.
MARKS = {"b": "block", "e": "erase", "h": "hold", "d": "dedupe", "s": "save", "r": "replace", "t": "transfer"}
#: Directories that mark everything in them.
MARK_DIRS = {"!block": "block", "!erase": "erase", "!hold": "hold", "!dedupe": "dedupe", "!save": "save", "!replace": "replace", "!transfer": "transfer"}


def lookup(table: dict, key: Column) -> Column:
    """A literal map's value, null where the key is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+(\.[^./]*)$", 1)


def marks(path: Column) -> Column:
    """Marks of a path, distinct: those of mark directories if there are any, else the letters after ``.!`` in the inner extension."""
    in_dirs = F.filter(F.transform(F.split(directory(path), "/"), lambda d: lookup(MARK_DIRS, d)), lambda m: m.isNotNull())
    letters = F.regexp_extract(path, r"\.!([a-z]+)[0-9]*\.[^./]*$", 1)
    in_name = F.filter(F.transform(F.split(F.when(letters == "ut", "").otherwise(letters), ""), lambda c: lookup(MARKS, c)), lambda m: m.isNotNull())
    return F.array_distinct(F.when(F.size(in_dirs) > 0, in_dirs).otherwise(in_name))


def mark_number(path: Column) -> Column:
    """The number in the inner extension; null without one."""
    digits = F.regexp_extract(path, r"\.[^./]*?([0-9]+)[^./]*\.[^./]*$", 1)
    return F.when(digits != "", F.expr("1") * F.try_to_number(F.substr(digits, F.lit(1), F.lit(9)), F.lit("999999999"))).cast("int")


def without_marks(path: Column) -> Column:
    """The path without its inner mark extension, sort marks and mark directories (the first of each)."""
    out = F.regexp_replace(path, r"^([^\n]*?)\.![a-z]+[0-9]*(\.[^./]*)$", "$1$2")
    out = F.regexp_replace(out, r"^(.*?)\[!_[^\]]*\]", "$1")
    return reduce(lambda p, d: F.regexp_replace(p, f"^(.*?/){d}/", "$1"), MARK_DIRS, out)


def with_marks(path: Column, letters: Column, sort_mark: Column) -> Column:
    """The path with a sort mark before the name and the marks' letters before the extension; unchanged without letters."""
    token = F.array_join(letters, "")
    marked = F.concat(directory(path), F.lit("/"), F.when(sort_mark != "", F.concat(F.lit("[!_"), sort_mark, F.lit("]"))).otherwise(""), stem(path), F.lit(".!"), token, extension(path))
    return F.when(F.size(letters) > 0, marked).otherwise(path)


def dedupe_tokens(path: Column) -> Column:
    """Repeated directories dropped, the first kept; the file name stays."""
    dirs = F.array_distinct(F.split(directory(path), "/"))
    return F.concat(F.array_join(dirs, "/"), F.lit("/"), base_name(path))


def rename(path: Column, rules: list) -> Column:
    """Rules in order: (regex, text, every) replaces by pattern, the first or every match; (text, text) replaces every literal one; a function maps the column."""

    def one(p: Column, rule) -> Column:
        if callable(rule):
            return rule(p)
        if len(rule) == 2:
            return F.replace(p, F.lit(rule[0]), F.lit(rule[1]))
        pattern, to, every = rule
        return F.regexp_replace(p, pattern, to) if every else F.regexp_replace(p, f"^((?s:.*?)){pattern}", "$1" + to)

    return reduce(one, rules, path)


def converged(path: Column, prefix: str, target: str, rules: list) -> Column:
    """Where a path lands under a target: own prefix off, rules, repeated directories out, target in front, marks off."""
    bare = F.regexp_replace(path, f"^{prefix}", "")
    return without_marks(F.concat(F.lit(target), dedupe_tokens(rename(bare, rules))))


def library_path(bases: dict, kind: Column, when: Column, offset_hours: int, name: Column) -> Column:
    """Base of the type / year / month-day of the time less an offset / name."""
    at = when - F.make_dt_interval(hours=F.lit(offset_hours))
    return F.concat(lookup(bases, kind), F.lit("/"), F.date_format(at, "yyyy"), F.lit("/"), F.date_format(at, "MM-dd"), F.lit("/"), name)


def ancestors(path: Column) -> Column:
    """All folders above a path, from the top."""
    parts = F.split(directory(path), "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
