"""A JSON schema over VARIANT columns: all errors of a document, with their paths (V01, V17). Schemas become Python functions, those with regular expressions a column expression."""

from __future__ import annotations

import json
import math
import operator
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions import variants
from tallyloom.functions.variants import ABSENT, NUMBERS as NUMERIC, Shared, in_order, to_json

ERRORS = "array<struct<path:string,rule:string,detail:string>>"
#: How the types of a schema are called in Spark's description of a variant.
KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "boolean": ("BOOLEAN",), "null": ("VOID",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")}
#: Keywords of Draft 7 that are understood; annotations are passed over, anything else is an error when the schema is compiled.
ANNOTATIONS = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "format", "definitions", "$defs", "readOnly", "writeOnly"}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def field(document: Column, name: str) -> Column:
    """A member of an object as a variant; null if it is absent or the document no object (a JSON null is a variant of its own)."""
    return F.try_variant_get(document, "$[" + json.dumps(name, ensure_ascii=False) + "]", "variant")


def members(document: Column) -> Column:
    """The members of an object as map<string, variant>, null for anything else."""
    return F.try_variant_get(document, "$", "map<string,variant>")


def elements(document: Column) -> Column:
    return F.try_variant_get(document, "$", "array<variant>")


def scalar(document: Column, kind: str) -> Column:
    return F.try_variant_get(document, "$", kind)


def kind_of(document: Column) -> Column:
    return F.substring_index(F.substring_index(F.schema_of_variant(document), "<", 1), "(", 1)


def quoted(text: str) -> str:
    """A text as a SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(document: str, name: str) -> str:
    return f"try_variant_get({document}, {quoted('$[' + json.dumps(name, ensure_ascii=False) + ']')}, 'variant')"


def _as(document: str, kind: str) -> str:
    return f"try_variant_get({document}, '$', {quoted(kind)})"


NUMBERS = "({})".format(", ".join(map(quoted, KINDS["number"])))
NOTHING = f"CAST(NULL AS {ERRORS})"


class Compiler:
    """Compiles a schema to the text of one SQL expression; names of lambda variables are its own.

    A rule gives null or an array of errors. References are put in where they stand, so a schema may not contain itself.
    """

    def __init__(self, schema: dict) -> None:
        self.root, self.names = schema, 0

    def fresh(self) -> str:
        self.names += 1
        return f"x{self.names}"

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """body of a value that is computed once, however often body names it."""
        x = self.fresh()
        return f"get(transform(array({value}), {x} -> {body(x)}), 0)"

    def errors(self, document: str, schema: dict | bool, path: str, seen: tuple[str, ...] = ()) -> str:
        """Errors of a value that is there: in the order of the rules below, members and elements after the value itself."""
        if schema is True or schema == {}:
            return NOTHING
        if schema is False:
            return self._error(path, "false", f"to_json({document})")
        if "$ref" in schema:  # in Draft 7 nothing stands beside it
            ref = schema["$ref"]
            if ref in seen:
                raise ValueError(f"schema contains itself: {ref}")
            return self.errors(document, self._resolve(ref), path, (*seen, ref))
        unknown = set(schema) - ANNOTATIONS - set(self.RULES) - {"then", "else"}
        if unknown:
            raise ValueError(f"keywords not understood: {sorted(unknown)}")
        return self.let(f"substring_index(substring_index(schema_of_variant({document}), '<', 1), '(', 1)", lambda kind: self._joined([rule(self, document, kind, schema, path, seen) for name, rule in self.RULES.items() if name in schema]))

    def _resolve(self, ref: str) -> dict:
        if not ref.startswith("#"):
            raise ValueError(f"not a reference within the schema: {ref}")
        return reduce(lambda at, key: at[key.replace("~1", "/").replace("~0", "~")], [k for k in ref[1:].split("/") if k], self.root)

    @staticmethod
    def _joined(parts: list[str]) -> str:
        return f"flatten(array_compact(array({', '.join([NOTHING, *parts])})))"

    @staticmethod
    def _struct(path: str, rule: str, detail: str) -> str:
        return f"named_struct('path', {path}, 'rule', {quoted(rule)}, 'detail', CAST({detail} AS STRING))"

    def _error(self, path: str, rule: str, detail: str) -> str:
        return f"array({self._struct(path, rule, detail)})"

    def _unless(self, good: str, path: str, rule: str, detail: str) -> str:
        return f"IF(coalesce({good}, true), NULL, {self._error(path, rule, detail)})"

    def _fine(self, document: str, schema: dict | bool, path: str, seen) -> str:
        return f"(coalesce(size({self.errors(document, schema, path, seen)}), 0) <= 0)"

    def _of_type(self, document: str, kind: str, name: str) -> str:
        if name == "integer":
            number = _as(document, "double")
            return f"({kind} = 'BIGINT' OR ({kind} IN {NUMBERS} AND coalesce({number} % 1D = 0D, false)))"
        return f"{kind} IN ({', '.join(map(quoted, KINDS[name]))})"

    def _equal(self, document: str, kind: str, value) -> str:
        """Equality of JSON values: numbers by value, objects whatever the order of members."""
        if isinstance(value, bool):
            return f"({kind} = 'BOOLEAN' AND {_as(document, 'boolean')} = {str(value).lower()})"
        if isinstance(value, int | float):
            return f"({kind} IN {NUMBERS} AND {_as(document, 'double')} = {float(value)!r}D)"
        if isinstance(value, str):
            return f"({kind} = 'STRING' AND {_as(document, 'string')} = {quoted(value)})"
        return f"(to_json({document}) = {quoted(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(',', ':')))})"

    def type(self, document, kind, schema, path, seen):
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        return self._unless(" OR ".join(self._of_type(document, kind, n) for n in names), path, "type", f"lower({kind})")

    def enum(self, document, kind, schema, path, seen):
        return self._unless(" OR ".join(self._equal(document, kind, v) for v in schema["enum"]), path, "enum", f"to_json({document})")

    def const(self, document, kind, schema, path, seen):
        return self._unless(self._equal(document, kind, schema["const"]), path, "const", f"to_json({document})")

    def _number(name, sign):
        def rule(self, document, kind, schema, path, seen):
            return self._unless(f"{kind} NOT IN {NUMBERS} OR {_as(document, 'double')} {sign} {float(schema[name])!r}D", path, name, f"to_json({document})")

        return rule

    def _size(name, of, measured):
        """measured: SQL over {d}, the document, and {n}, the keyword's value."""

        def rule(self, document, kind, schema, path, seen):
            value = quoted(schema[name]) if isinstance(schema[name], str) else schema[name]
            return self._unless(f"{kind} <> '{of}' OR {measured.format(d=document, n=value)}", path, name, f"to_json({document})")

        return rule

    def multipleOf(self, document, kind, schema, path, seen):  # noqa: N802
        share = f"({_as(document, 'double')} / {float(schema['multipleOf'])!r}D)"
        return self._unless(f"{kind} NOT IN {NUMBERS} OR abs({share} - round({share})) < 1e-9", path, "multipleOf", f"to_json({document})")

    def required(self, document, kind, schema, path, seen):
        missing = [f"IF({kind} = 'OBJECT' AND {_get(document, n)} IS NULL, {self._struct(path, 'required', quoted(n))}, NULL)" for n in schema["required"]]
        return f"array_compact(array({', '.join(missing)}))" if missing else NOTHING

    def properties(self, document, kind, schema, path, seen):
        def one(name, inner):
            return self.let(_get(document, name), lambda v: f"IF({v} IS NULL, NULL, {self.errors(v, inner, f'concat({path}, {quoted("." + name)})', seen)})")

        return self._joined([one(n, s) for n, s in schema["properties"].items() if s is not True and s != {}])

    def _each(self, entries: str, schema, path, seen) -> str:
        """Errors of every entry (a member's name and value)."""
        e = self.fresh()
        return f"flatten(array_compact(transform({entries}, {e} -> {self.errors(f'{e}.value', schema, f"concat({path}, '.', {e}.key)", seen)})))"

    def _members(self, document: str, test: Callable[[str], str]) -> str:
        e = self.fresh()
        return f"filter(map_entries({_as(document, 'map<string,variant>')}), {e} -> {test(f'{e}.key')})"

    def _others(self, document: str, schema: dict) -> str:
        """Members that neither properties nor patternProperties speak of."""
        named, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
        return self._members(document, lambda key: " AND ".join(["true", *([f"{key} NOT IN ({', '.join(map(quoted, named))})"] if named else []), *(f"NOT rlike({key}, {quoted(p)})" for p in patterns)]))

    def patternProperties(self, document, kind, schema, path, seen):  # noqa: N802
        return self._joined([self._each(self._members(document, lambda key: f"rlike({key}, {quoted(p)})"), s, path, seen) for p, s in schema["patternProperties"].items()])  # noqa: B023

    def additionalProperties(self, document, kind, schema, path, seen):  # noqa: N802
        inner, others, e = schema["additionalProperties"], self._others(document, schema), self.fresh()
        if inner is False:
            return f"transform({others}, {e} -> {self._struct(path, 'additionalProperties', f'{e}.key')})"
        return self._each(others, inner, path, seen)

    def propertyNames(self, document, kind, schema, path, seen):  # noqa: N802
        k = self.fresh()
        inner = self.errors(f"CAST({k} AS VARIANT)", schema["propertyNames"], f"concat({path}, '.', {k})", seen)
        return f"flatten(array_compact(transform(map_keys({_as(document, 'map<string,variant>')}), {k} -> {inner})))"

    def dependencies(self, document, kind, schema, path, seen):
        def one(needs):
            return self.required(document, kind, {"required": needs}, path, seen) if isinstance(needs, list) else self.errors(document, needs, path, seen)

        return self._joined([f"IF({_get(document, n)} IS NULL, NULL, {one(needs)})" for n, needs in schema["dependencies"].items()])

    def items(self, document, kind, schema, path, seen):
        array = _as(document, "array<variant>")
        if isinstance(schema["items"], list):
            places = [self.let(f"get({array}, {i})", lambda v: f"IF({v} IS NULL, NULL, {self.errors(v, s, f"concat({path}, '[{i}]')", seen)})") for i, s in enumerate(schema["items"])]  # noqa: B023
            return self._joined(places)
        v, i = self.fresh(), self.fresh()
        return f"flatten(array_compact(transform({array}, ({v}, {i}) -> {self.errors(v, schema['items'], f"concat({path}, '[', {i}, ']')", seen)})))"

    def contains(self, document, kind, schema, path, seen):
        v = self.fresh()
        return self._unless(f"exists({_as(document, 'array<variant>')}, {v} -> {self._fine(v, schema['contains'], path, seen)})", path, "contains", "NULL")

    def uniqueItems(self, document, kind, schema, path, seen):  # noqa: N802
        v = self.fresh()
        texts = f"transform({_as(document, 'array<variant>')}, {v} -> to_json({v}))"
        return self._unless(f"size(array_distinct({texts})) = size({texts})", path, "uniqueItems", "NULL") if schema["uniqueItems"] else NOTHING

    def allOf(self, document, kind, schema, path, seen):  # noqa: N802
        return self._joined([self.errors(document, s, path, seen) for s in schema["allOf"]])

    def anyOf(self, document, kind, schema, path, seen):  # noqa: N802
        return self._unless(" OR ".join(self._fine(document, s, path, seen) for s in schema["anyOf"]), path, "anyOf", "NULL")

    def oneOf(self, document, kind, schema, path, seen):  # noqa: N802
        return self.let(" + ".join(f"CAST({self._fine(document, s, path, seen)} AS INT)" for s in schema["oneOf"]), lambda n: self._unless(f"{n} = 1", path, "oneOf", n))

    def not_(self, document, kind, schema, path, seen):
        return self._unless(f"NOT {self._fine(document, schema['not'], path, seen)}", path, "not", "NULL")

    def if_(self, document, kind, schema, path, seen):
        then, other = (self.errors(document, schema.get(k, True), path, seen) for k in ("then", "else"))
        return f"IF({self._fine(document, schema['if'], path, seen)}, {then}, {other})"

    _TEXT, _ITEMS, _MEMBERS = (f"try_variant_get({{d}}, '$', '{kind}')" for kind in ("string", "array<variant>", "map<string,variant>"))
    RULES = {
        "type": type, "enum": enum, "const": const, "minimum": _number("minimum", ">="), "maximum": _number("maximum", "<="), "exclusiveMinimum": _number("exclusiveMinimum", ">"), "exclusiveMaximum": _number("exclusiveMaximum", "<"),
        "multipleOf": multipleOf, "minLength": _size("minLength", "STRING", f"length({_TEXT}) >= {{n}}"), "maxLength": _size("maxLength", "STRING", f"length({_TEXT}) <= {{n}}"), "pattern": _size("pattern", "STRING", f"rlike({_TEXT}, {{n}})"),
        "minItems": _size("minItems", "ARRAY", f"size({_ITEMS}) >= {{n}}"), "maxItems": _size("maxItems", "ARRAY", f"size({_ITEMS}) <= {{n}}"),
        "minProperties": _size("minProperties", "OBJECT", f"size({_MEMBERS}) >= {{n}}"), "maxProperties": _size("maxProperties", "OBJECT", f"size({_MEMBERS}) <= {{n}}"),
        "required": required, "properties": properties, "patternProperties": patternProperties, "additionalProperties": additionalProperties, "propertyNames": propertyNames, "dependencies": dependencies,
        "items": items, "contains": contains, "uniqueItems": uniqueItems, "allOf": allOf, "anyOf": anyOf, "oneOf": oneOf, "not": not_, "if": if_,
    }


#: An error: path below the value that was checked, rule and detail.
Error = tuple[str, str, str | None]
Check = Callable[[object], list[Error]]
FIELDS = ("path", "rule", "detail")


class Checker:
    """Compiles a schema to a Python function from a value (of variants.Reader) to its errors, in the order of Compiler.

    Patterns are not among its rules, as they are Java's. An object that documents share is checked by a node once.
    """

    def __init__(self, schema: dict) -> None:
        self.root = schema
        self.check = self.errors(schema)

    def errors(self, schema: dict | bool, seen: tuple[str, ...] = ()) -> Check | None:
        """None: a schema that nothing fails."""
        if schema is True or schema == {}:
            return None
        if schema is False:
            return lambda v: [("", "false", to_json(v))]
        if "$ref" in schema:
            ref = schema["$ref"]
            if ref in seen:
                raise ValueError(f"schema contains itself: {ref}")
            return self.errors(Compiler._resolve(self, ref), (*seen, ref))
        unknown = set(schema) - ANNOTATIONS - set(self.RULES) - {"then", "else"}
        if unknown:
            raise ValueError(f"keywords not understood: {sorted(unknown)}")
        rules = [r for name, rule in self.RULES.items() if name in schema and (r := rule(self, schema, seen))]
        kinds, key, only_type = variants.KINDS, object(), self.type(schema, seen) if not set(schema) - ANNOTATIONS - {"type"} and "type" in schema else None
        if only_type:
            return lambda v: only_type(v, kinds.get(type(v)) or v.kind) or []

        def check(v):
            shared = type(v) is Shared
            if shared and (known := v.found.get(key)) is not None:
                return known
            kind, found = kinds.get(type(v)) or v.kind, []
            for rule in rules:
                if e := rule(v, kind):
                    found += e
            if shared:
                v.found[key] = found
            return found

        return check

    def _fine(self, schema, seen) -> Callable[[object], bool]:
        check = self.errors(schema, seen)
        return (lambda v: not check(v)) if check else (lambda v: True)

    def type(self, schema, seen):
        names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        good, whole = frozenset(k for n in names if n != "integer" for k in KINDS[n]) | ({"BIGINT"} if "integer" in names else set()), "integer" in names

        def rule(v, kind):
            if kind not in good and not (whole and kind in NUMERIC and math.isfinite(n := v if kind == "DECIMAL" else float(v)) and n == math.floor(n)):
                return [("", "type", kind.lower())]

        return rule

    @staticmethod
    def _equal(value) -> Callable[[object, str], bool]:
        if isinstance(value, bool):
            return lambda v, kind: v is value
        if isinstance(value, int | float):
            return lambda v, kind: kind in NUMERIC and float(v) == float(value)
        if isinstance(value, str):
            return lambda v, kind: v == value
        text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return lambda v, kind: to_json(v) == text

    def enum(self, schema, seen):
        texts = frozenset(v for v in schema["enum"] if isinstance(v, str))
        others = [self._equal(v) for v in schema["enum"] if not isinstance(v, str)]
        return lambda v, kind: None if kind == "STRING" and v in texts or any(e(v, kind) for e in others) else [("", "enum", to_json(v))]

    def const(self, schema, seen):
        equal = self._equal(schema["const"])
        return lambda v, kind: None if equal(v, kind) else [("", "const", to_json(v))]

    def _number(name, good):
        def rule(self, schema, seen):
            n = float(schema[name])
            return lambda v, kind: [("", name, to_json(v))] if kind in NUMERIC and not good(float(v), n) else None

        return rule

    def _size(name, of, good):
        def rule(self, schema, seen):
            n = schema[name]
            return lambda v, kind: [("", name, to_json(v))] if kind == of and not good(len(v), n) else None

        return rule

    def multipleOf(self, schema, seen):  # noqa: N802
        n = float(schema["multipleOf"])

        def rule(v, kind):
            if kind in NUMERIC and not (math.isfinite(share := float(v) / n) and abs(share - round(share)) < 1e-9):
                return [("", "multipleOf", to_json(v))]

        return rule

    def required(self, schema, seen):
        names, every = schema["required"], frozenset(schema["required"])
        return lambda v, kind: [("", "required", n) for n in names if n not in v] if kind == "OBJECT" and not every <= v.keys() else None

    @staticmethod
    def _at(place: str, errors: list[Error]) -> list[Error]:
        return [(place + path, rule, detail) for path, rule, detail in errors]

    @staticmethod
    def _classes(schema: dict | bool) -> frozenset:
        """Classes of which a schema that asks for types alone takes any value: with these, its check need not be called."""
        names = [] if not isinstance(schema, dict) or set(schema) - ANNOTATIONS - {"type"} or "type" not in schema else [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
        kinds = {k for n in names for k in (KINDS[n] if n != "integer" else ("BIGINT",))}
        return frozenset(c for c, k in variants.KINDS.items() if k in kinds)

    def properties(self, schema, seen):
        checks, at = [(n, f".{n}", c, self._classes(s)) for n, s in schema["properties"].items() if (c := self.errors(s, seen))], self._at

        def rule(v, kind):
            if kind == "OBJECT":
                found = []
                for name, place, check, classes in checks:
                    if name in v and type(x := v[name]) not in classes and (e := check(x)):
                        found += at(place, e)
                return found

        return rule

    def additionalProperties(self, schema, seen):  # noqa: N802
        named, inner = frozenset(schema.get("properties", {})), schema["additionalProperties"]
        check, at = self.errors(inner, seen), self._at

        def rule(v, kind):
            if kind == "OBJECT" and check and not named.issuperset(v):
                others = [k for k in in_order(v) if k not in named]
                if inner is False:
                    return [("", "additionalProperties", k) for k in others]
                return [e for k in others for e in at(f".{k}", check(v[k]))]

        return rule

    def propertyNames(self, schema, seen):  # noqa: N802
        check = self.errors(schema["propertyNames"], seen)
        return lambda v, kind: [e for k in in_order(v) for e in self._at(f".{k}", check(k))] if kind == "OBJECT" and check else None

    def dependencies(self, schema, seen):
        needs = {n: (lambda v, names=needed: [("", "required", m) for m in names if m not in v]) if isinstance(needed, list) else self.errors(needed, seen) for n, needed in schema["dependencies"].items()}
        return lambda v, kind: [e for n, check in needs.items() if check and n in v for e in check(v)] if kind == "OBJECT" else None

    def items(self, schema, seen):
        if isinstance(schema["items"], list):
            places = [self.errors(s, seen) for s in schema["items"]]
            return lambda v, kind: [e for i, (x, check) in enumerate(zip(v, places, strict=False)) if check for e in self._at(f"[{i}]", check(x))] if kind == "ARRAY" else None
        check = self.errors(schema["items"], seen)
        return lambda v, kind: [e for i, x in enumerate(v) for e in self._at(f"[{i}]", check(x))] if kind == "ARRAY" and check else None

    def contains(self, schema, seen):
        fine = self._fine(schema["contains"], seen)
        return lambda v, kind: [("", "contains", None)] if kind == "ARRAY" and not any(map(fine, v)) else None

    def uniqueItems(self, schema, seen):  # noqa: N802
        return (lambda v, kind: [("", "uniqueItems", None)] if kind == "ARRAY" and len(set(map(to_json, v))) < len(v) else None) if schema["uniqueItems"] else None

    def allOf(self, schema, seen):  # noqa: N802
        checks = [c for s in schema["allOf"] if (c := self.errors(s, seen))]
        return lambda v, kind: [e for check in checks for e in check(v)]

    def anyOf(self, schema, seen):  # noqa: N802
        fine = [self._fine(s, seen) for s in schema["anyOf"]]
        return lambda v, kind: None if any(f(v) for f in fine) else [("", "anyOf", None)]

    def oneOf(self, schema, seen):  # noqa: N802
        fine = [self._fine(s, seen) for s in schema["oneOf"]]
        return lambda v, kind: None if (n := sum(f(v) for f in fine)) == 1 else [("", "oneOf", str(n))]

    def not_(self, schema, seen):
        fine = self._fine(schema["not"], seen)
        return lambda v, kind: [("", "not", None)] if fine(v) else None

    def if_(self, schema, seen):
        fine, then, other = self._fine(schema["if"], seen), *(self.errors(schema.get(k, True), seen) for k in ("then", "else"))
        return lambda v, kind: check(v) if (check := then if fine(v) else other) else None

    RULES = {
        "type": type, "enum": enum, "const": const, "minimum": _number("minimum", operator.ge), "maximum": _number("maximum", operator.le), "exclusiveMinimum": _number("exclusiveMinimum", operator.gt), "exclusiveMaximum": _number("exclusiveMaximum", operator.lt),
        "multipleOf": multipleOf, "minLength": _size("minLength", "STRING", operator.ge), "maxLength": _size("maxLength", "STRING", operator.le), "minItems": _size("minItems", "ARRAY", operator.ge), "maxItems": _size("maxItems", "ARRAY", operator.le),
        "minProperties": _size("minProperties", "OBJECT", operator.ge), "maxProperties": _size("maxProperties", "OBJECT", operator.le), "required": required, "properties": properties, "additionalProperties": additionalProperties, "propertyNames": propertyNames,
        "dependencies": dependencies, "items": items, "contains": contains, "uniqueItems": uniqueItems, "allOf": allOf, "anyOf": anyOf, "oneOf": oneOf, "not": not_, "if": if_,
    }


def has_patterns(schema) -> bool:
    """Whether a pattern or patternProperties stands anywhere in it (a member that is merely called so counts as well)."""
    if isinstance(schema, dict):
        return bool({"pattern", "patternProperties"} & set(schema)) or any(map(has_patterns, schema.values()))
    return isinstance(schema, list) and any(map(has_patterns, schema))


def checked(schema: dict) -> Check:
    """All errors of a value against a schema without patterns; paths begin with $. ABSENT stands for a text that is no JSON."""
    check = Checker(schema).check or (lambda v: [])
    return lambda v: [("$", "json", None)] if v is ABSENT else Checker._at("$", check(v))


def compiled_errors(document: str, schema: dict) -> Column:
    """schema_errors as one expression of the JVM: for schemas with patterns, which are Java's; costs about a millisecond a record for large schemas."""
    column = f"`{document}`"
    compiler = Compiler(schema)
    json_error = compiler._error("'$'", "json", "NULL")
    return F.expr(f"IF({column} IS NULL, {json_error}, coalesce({compiler.errors(column, schema, quoted('$'))}, CAST(array() AS {ERRORS})))")


def schema_errors(document: str, schema: dict) -> Column:
    """All errors of a VARIANT column against a Draft-7 schema, as structs of path ($ is the whole), rule and detail.

    The detail is the missing or forbidden member's name, the type found, or the value found. A null document (no JSON)
    has the single error `json`. References must be within the schema and may not lead back to themselves.
    """
    if has_patterns(schema):
        return compiled_errors(document, schema)
    check, reader = checked(schema), variants.Reader()

    def errors(column: pa.Array) -> pa.Array:
        return variants.lists_of([check(v) for v in variants.values_of(column, reader)], FIELDS)

    return F.arrow_udf(errors, ERRORS)(F.col(f"`{document}`"))


def _record() -> dict:
    """The schema of an evaluation record. Names, types and choices of its members."""
    text, number, whole, flag = {"type": "string"}, {"type": "number"}, {"type": "integer"}, {"type": "boolean"}
    details = {"type": "object", "additionalProperties": text}
    texts = {"type": "array", "items": text}

    def members_of(required: str, optional: dict, extra: bool = True, **needed) -> dict:
        return {"type": "object", "required": required.split(), "properties": needed | optional} | ({} if extra else {"additionalProperties": False})

    model = members_of("name id", {k: text for k in ("developer", "parameter_count", "model_alignment", "quantization", "inference_platform")} | {"inference_engine": members_of("", {"name": text, "version": text}), "additional_details": details}, name=text, id=text)
    data = lambda kind, optional, required="dataset_name source_type", **needed: members_of(required, {"dataset_split": text, "sample_size": whole, "additional_details": details} | optional, dataset_name=text, source_type={"const": kind}, **needed)
    uncertainty = members_of("", {
        "standard_error": members_of("value", {"method": text}, value=number), "standard_deviation": number, "num_samples": whole, "num_bootstrap_samples": whole,
        "confidence_interval": members_of("lower upper", {"confidence_level": {"type": "number", "minimum": 0, "maximum": 1}, "method": text}, lower=number, upper=number),
    })
    judge = members_of("model_info", {"temperature": number, "weight": number, "additional_details": details}, model_info={"$ref": "#/definitions/model_info"})
    scoring = members_of("judges input_prompt", {"aggregation_method": {"enum": ["majority_vote", "average", "weighted_average", "median"]}, "expert_baseline": number, "additional_details": details}, judges={"type": "array", "minItems": 1, "items": judge}, input_prompt=text)
    metric = members_of("lower_is_better", {
        "evaluation_description": text, "metric_name": text, "score_type": {"enum": ["binary", "continuous", "levels"]}, "level_names": texts, "level_metadata": texts, "has_unknown_level": flag,
        "min_score": number, "max_score": number, "llm_scoring": scoring, "additional_details": details,
    }, lower_is_better=flag) | {"allOf": [
        {"if": {"required": ["score_type"], "properties": {"score_type": {"const": "levels"}}}, "then": {"required": ["level_names", "has_unknown_level"]}},
        {"if": {"required": ["score_type"], "properties": {"score_type": {"const": "continuous"}}}, "then": {"required": ["min_score", "max_score"]}},
    ]}
    tools = members_of("", {"available_tools": {"type": "array", "items": members_of("", {"name": text, "description": text, "parameters": details})}, "additional_details": details})
    arguments = members_of("", {
        "shots": whole, "temperature": number, "top_p": number, "top_k": number, "max_tokens": {"type": "integer", "minimum": 1}, "execution_command": text, "reasoning": flag, "reasoning_mode": text, "chain_of_thought": flag,
        "prompt_template": text, "agentic_eval_config": tools, "eval_plan": members_of("", {"name": text, "steps": texts, "config": details}), "eval_limits": members_of("", {k: whole for k in ("time_limit", "message_limit", "token_limit")}),
        "sandbox": members_of("", {"type": text, "config": text}), "max_attempts": whole, "incorrect_attempt_feedback": text,
    }, extra=False)
    result = members_of("evaluation_name source_data metric_config score_details", {"evaluation_timestamp": text, "generation_config": members_of("", {"generation_args": arguments, "additional_details": details})},
        evaluation_name=text, source_data={"oneOf": [
            data("url", {}, "dataset_name source_type url", url={"type": "array", "minItems": 1, "items": text}),
            data("hf_dataset", {"hf_repo": text, "hf_split": text, "samples_number": whole, "sample_ids": texts}), data("other", {}),
        ]}, metric_config=metric, score_details=members_of("score", {"details": details, "uncertainty": uncertainty}, score=number),
    )
    source = members_of("source_type source_organization_name evaluator_relationship", {"source_name": text, "source_organization_url": text, "source_organization_logo_url": text, "additional_details": details},
        source_type={"enum": ["documentation", "evaluation_run"]}, source_organization_name=text, evaluator_relationship={"enum": ["first_party", "third_party", "collaborative", "other"]})
    detailed = members_of("", {"format": {"enum": ["jsonl", "json"]}, "file_path": text, "hash_algorithm": {"enum": ["sha256", "md5"]}, "checksum": text, "total_rows": whole, "additional_details": details})
    return members_of("schema_version evaluation_id retrieved_timestamp source_metadata eval_library model_info evaluation_results", {"evaluation_timestamp": text, "detailed_evaluation_results": detailed}, extra=False,
        schema_version=text, evaluation_id=text, retrieved_timestamp=text, source_metadata=source, eval_library=members_of("name version", {"additional_details": details}, name=text, version=text),
        model_info={"$ref": "#/definitions/model_info"}, evaluation_results={"type": "array", "items": result}) | {"definitions": {"model_info": model}}


RECORD_SCHEMA = _record()
