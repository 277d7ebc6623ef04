"""Documents with closed fields: JSON read as variants, so that what a schema doesn't know is found, not dropped.

A description says what every object of a document must hold, field by field, down to the last. Checking gives a
table of violations: fields that are not declared, fields that are missing, values of another type, and values
that aren't allowed, each with the place of its object.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Text:
    pattern: str | None = None
    values: Sequence[str] | None = None
    null: bool = False

    def typed(self, kind: Column) -> Column:
        return kind == "STRING"

    def allowed(self, value: Column) -> Column:
        said = F.try_variant_get(value, "$", "string")
        ok = F.lit(True) if self.pattern is None else said.rlike(self.pattern)
        return ok if self.values is None else ok & said.isin(*self.values)


@dataclass(frozen=True)
class Number:
    low: float | None = None
    high: float | None = None
    whole: bool = False
    null: bool = False
    above: bool = False  # whether ``low`` itself is too low

    def typed(self, kind: Column) -> Column:
        return kind == "BIGINT" if self.whole else kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")

    def allowed(self, value: Column) -> Column:
        x = F.try_variant_get(value, "$", "double")
        low = F.lit(True) if self.low is None else (x > self.low if self.above else x >= self.low)
        return low if self.high is None else low & (x <= self.high)


@dataclass(frozen=True)
class Flag:
    value: bool | None = None
    null: bool = False

    def typed(self, kind: Column) -> Column:
        return kind == "BOOLEAN"

    def allowed(self, value: Column) -> Column:
        return F.lit(True) if self.value is None else F.try_variant_get(value, "$", "boolean") == self.value


@dataclass(frozen=True)
class Fields:
    of: dict
    null: bool = False

    def typed(self, kind: Column) -> Column:
        return kind.startswith("OBJECT")

    def allowed(self, value: Column) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Items:
    """A list. ``unique``: the field of its objects (or "" for plain items) that no two may share."""

    of: object
    least: int = 0
    most: int | None = None
    unique: str | None = None
    null: bool = False

    def typed(self, kind: Column) -> Column:
        return kind.startswith("ARRAY")

    def allowed(self, value: Column) -> Column:
        n = F.size(_items(value))
        return (n >= self.least) if self.most is None else n.between(self.least, self.most)


def _get(value: Column, field: str) -> Column:
    return F.try_variant_get(value, f"$.{field}", "variant")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _faults(spec, value: Column, field: str) -> Column:
    """An array of (rule_id, field) structs, or nulls, of a value that is there."""
    return _once(value, lambda v: _once(F.schema_of_variant(v), lambda kind: F.array(*_found(spec, v, kind, field))))


def _found(spec, value: Column, kind: Column, field: str) -> list[Column]:
    fault = lambda rule: F.struct(F.lit(rule).alias("rule_id"), F.lit(field).alias("field"))
    there = value.isNotNull() & ~((kind == "VOID") & F.lit(spec.null))
    found = [F.when(there & ~spec.typed(kind), fault("wrong_type")), F.when(there & spec.typed(kind) & ~F.coalesce(spec.allowed(value), F.lit(False)), fault("value"))]
    if isinstance(spec, Items):
        plain = not isinstance(spec.of, Fields)
        each = lambda x: spec.of.typed(F.schema_of_variant(x)) & (F.coalesce(spec.of.allowed(x), F.lit(False)) if plain else F.lit(True))
        found.append(F.when(F.coalesce(F.exists(_items(value), lambda x: ~each(x)), F.lit(False)), fault("item")))
        if spec.unique is not None:
            named = F.transform(_items(value), lambda x: F.to_json(_get(x, spec.unique) if spec.unique else x))
            found.append(F.when(F.size(F.array_distinct(named)) < F.size(named), fault("repeated")))
    return found


def _visit(spec: Fields, objects: DataFrame, key: str) -> list[DataFrame]:
    """``objects``: key, path, v. Violations of these objects, and of those inside them."""
    names = F.map_keys(F.try_variant_get("v", "$", "map<string,variant>"))
    declared = F.array(*map(F.lit, spec.of))
    as_faults = lambda fields, rule: F.transform(fields, lambda f: F.struct(F.lit(rule).alias("rule_id"), f.alias("field")))
    own = [_faults(inner, _get(F.col("v"), field), field) for field, inner in spec.of.items()]
    every = _once(names, lambda n: F.concat(as_faults(F.array_except(n, declared), "unknown_field"), as_faults(F.array_except(declared, n), "missing_field"), F.array_compact(F.concat(*own))))
    out = [objects.where(names.isNotNull()).select(key, "path", F.inline(every))]
    for field, inner in spec.of.items():
        at = F.concat(F.col("path"), F.lit(f".{field}"))
        if isinstance(inner, Fields):
            out += _visit(inner, objects.select(key, at.alias("path"), _get(F.col("v"), field).alias("v")), key)
        elif isinstance(inner, Items) and isinstance(inner.of, Fields):
            listed = objects.select(key, at.alias("_at"), F.posexplode(_items(_get(F.col("v"), field))).alias("_place", "v"))
            out += _visit(inner.of, listed.select(key, F.concat("_at", F.lit("["), F.col("_place").cast("string"), F.lit("]")).alias("path"), "v"), key)
    return out


def closed_violations(documents: DataFrame, key: str, document: str, spec: Fields) -> DataFrame:
    """(key, path, rule_id, field) of every document that doesn't keep to ``spec``; path begins with ``$``.

    Rules: ``not_an_object`` (of the whole document), ``unknown_field``, ``missing_field``, ``wrong_type``, ``value``, and for
    lists ``item`` (an item of another type or value) and ``repeated``. Nulls are values: only what allows them may hold them.
    """
    parsed = documents.select(key, F.lit("$").alias("path"), F.try_parse_json(document).alias("v"))
    broken = F.coalesce(~F.schema_of_variant("v").startswith("OBJECT"), F.lit(True))
    root = parsed.where(broken).select(key, "path", F.lit("not_an_object").alias("rule_id"), F.lit("").alias("field"))
    return reduce(DataFrame.unionAll, [root, *_visit(spec, parsed.where(~broken), key)])
