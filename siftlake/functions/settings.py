"""Settings of rows by layers of rules that are data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are configuration; a table of more is refused, as all of them become one expression.
MOST_RULES = 1000


def layered(rules: DataFrame, path: Column, type_: Column, base: dict) -> dict[str, Column]:
    """A column for every setting of base, of rules(place, kind, match, setting, value, forced).

    From the weakest: the base; ``path`` rules whose match is part of the path, the last by place
    winning; the ``type`` rule of the row's type; forced path rules; forced type rules. Values are text
    and take the base value's type. An empty match fits all paths; null paths and types fit no rule.
    """
    found = rules.orderBy("place").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    unknown = {r["setting"] for r in found} - base.keys()
    if unknown:
        raise ValueError(f"no such settings: {sorted(unknown)}")

    def column(name: str, default) -> Column:
        kind = {bool: "boolean", int: "long", float: "double", str: "string"}[type(default)]
        layers = []
        for forced, by in ((True, "type"), (True, "path"), (False, "type"), (False, "path")):
            for r in reversed(found):
                if r["setting"] == name and r["kind"] == by and bool(r["forced"]) == forced:
                    fits = F.contains(path, F.lit(r["match"])) if by == "path" else type_ == r["match"]
                    layers.append(F.when(fits, F.lit(r["value"]).cast(kind)))
        return F.coalesce(*layers, F.lit(default).cast(kind))

    return {name: column(name, default) for name, default in base.items()}
