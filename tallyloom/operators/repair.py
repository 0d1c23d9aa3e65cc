"""Repairs of JSON records as an ordered fold in Python over VARIANT: each step sees what the one before has left, and logs what it changed."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import variants
from tallyloom.functions.variants import ABSENT, NUMBERS, in_order, kind_of, to_json
from tallyloom.operators.schema import ERRORS, FIELDS, RECORD_SCHEMA, checked, has_patterns, schema_errors

VERSION = "0.2.1"
VERSIONS = ("0.2.0", "0.2.1")
# How older names of source types and parties are called now.
SOURCE_TYPES = {"evaluation_platform": "evaluation_run", "paper_html": "documentation"}
PARTIES = {"unknown": "other", "self_reported": "first_party"}
LOG = "array<struct<fix:string,path:string,before:string,after:string>>"
CHANGE = ("fix", "path", "before", "after")
#: A change: fix, path, and the texts of the value before and after.
Change = tuple[str, str, str | None, str | None]
#: A step gets a document and gives it anew with the changes made; nothing is changed in place, as documents share their parts.
Step = Callable[[object], tuple[object, list[Change]]]


def field(document, name: str):
    """A member of an object; ABSENT if there is none or the document is no object (a JSON null is None)."""
    return document.get(name, ABSENT) if isinstance(document, dict) else ABSENT


def put(document, name: str, value):
    """The object with a member set; anything but an object stays as it is."""
    return {**document, name: value} if isinstance(document, dict) else document


def without(document, *names: str):
    return {k: v for k, v in document.items() if k not in names} if isinstance(document, dict) else document


def spelled(value) -> str:
    """A value as the text that records use for it: strings as they are, True, False and None, numbers, lists and objects as JSON."""
    return value if isinstance(value, str) else str(value) if value is None or isinstance(value, bool) else to_json(value)


def _change(fix: str, path: str, before, after) -> Change:
    return fix, path, to_json(before), to_json(after)


def replace(fix: str, where: tuple[str, ...], test: Callable[[object], bool], value: Callable[[object], object]) -> Step:
    """A step that sets the member at a path, where its present value (ABSENT: none) passes the test; the objects on the way must be there."""

    def within(at, names: tuple[str, ...], new):
        return put(at, names[0], within(at[names[0]], names[1:], new) if names[1:] else new)

    def step(document):
        owner = document
        for name in where[:-1]:
            owner = field(owner, name)
        now = field(owner, where[-1])
        if not isinstance(owner, dict) or not test(now):
            return document, []
        new = value(now)
        return within(document, where, new), [_change(fix, "$." + ".".join(where), now, new)]

    return step


def renamed(fix: str, where: tuple[str, ...], names: dict[str, str]) -> Step:
    """A step that replaces old names at a path."""
    return replace(fix, where, lambda v: isinstance(v, str) and v in names, lambda v: names[v])


def in_results(change: Callable[[object, str], tuple[object, list[Change]]]) -> Step:
    """A step on each of evaluation_results: change gets a result and its path, and gives what a step gives."""

    def step(document):
        results = field(document, "evaluation_results")
        if not isinstance(results, list):
            return document, []
        done = [change(r, f"$.evaluation_results[{i}]") for i, r in enumerate(results)]
        log = [c for _, changes in done for c in changes]
        return (put(document, "evaluation_results", [new for new, _ in done]) if log else document), log

    return step


#: Texts that Spark's cast takes for a finite double: digits with or without the point, an exponent, Java's suffixes, and hexadecimal doubles.
_DECIMAL = re.compile(r"[\x00-\x20]*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)[fFdD]?[\x00-\x20]*")
_HEXADECIMAL = re.compile(r"[\x00-\x20]*([+-]?0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][+-]?[0-9]+)[fFdD]?[\x00-\x20]*")


def _finite(text: str) -> float | None:
    if m := _DECIMAL.fullmatch(text):
        number = float(m[1])
    elif m := _HEXADECIMAL.fullmatch(text):
        try:
            number = float.fromhex(m[1])
        except OverflowError:
            return None
    else:
        return None
    return number if math.isfinite(number) else None


def _score_number(result, path: str):
    details = field(result, "score_details")
    score = field(details, "score")
    number = _finite(score) if isinstance(score, str) else None
    if number is None:
        return result, []
    return put(result, "score_details", put(details, "score", number)), [_change("score as number", f"{path}.score_details.score", score, number)]


def _metric_bounds(result, path: str):
    config = field(result, "metric_config")
    bounds = {n: v for n, v in (("max_score", 100.0), ("min_score", 0.0)) if field(config, n) is None}
    if not bounds:
        return result, []
    return put(result, "metric_config", {**config, **bounds}), [_change("score bound", f"{path}.metric_config.{n}", None, v) for n, v in bounds.items()]


def _arguments(allowed: list[str]):
    """n_shot becomes shots first; members that the schema does not know go, spelled out, beside the arguments."""
    known = frozenset(allowed)

    def change(result, path: str):
        config = field(result, "generation_config")
        args, at = field(config, "generation_args"), f"{path}.generation_config"
        if not isinstance(args, dict):
            return result, []
        shots, log = field(args, "n_shot"), []
        if shots is not ABSENT:
            args = put(without(args, "n_shot"), "shots", shots)
            log.append(_change("n_shot as shots", f"{at}.generation_args.n_shot", shots, shots))
        odd = in_order({k: v for k, v in args.items() if k not in known})
        if odd:
            there = field(config, "additional_details")
            config = put(config, "additional_details", {**(there if isinstance(there, dict) else {}), **{k: spelled(v) for k, v in odd.items()}})
            log += [_change("argument beside", f"{at}.generation_args.{k}", v, spelled(v)) for k, v in odd.items()]
        return (put(result, "generation_config", put(config, "generation_args", without(args, *odd))) if log else result), log

    return change


def _spelled_details(owner: str) -> Step:
    def step(document):
        details = field(field(document, owner), "additional_details")
        odd = in_order({k: v for k, v in details.items() if not isinstance(v, str)}) if isinstance(details, dict) else {}
        if not odd:
            return document, []
        new = put(document, owner, put(document[owner], "additional_details", {k: spelled(v) for k, v in details.items()}))
        return new, [_change("detail as text", f"$.{owner}.additional_details.{k}", v, spelled(v)) for k, v in odd.items()]

    return step


def _legacy(document):
    """`validated` and `incorrect_values` of older records go into the source's details."""
    told = {n: v for n in ("validated", "incorrect_values") if (v := field(document, n)) is not ABSENT}
    if not told:
        return document, []
    texts = {n: "; ".join(map(spelled, v)) if n == "incorrect_values" and isinstance(v, list) else spelled(v) for n, v in told.items()}
    source = document.get("source_metadata", {})
    details = source.get("additional_details", {}) if isinstance(source, dict) else {}
    for n, text in texts.items():
        details = put(details, n, text)
    new = put(without(document, *told), "source_metadata", put(source, "additional_details", details))
    return new, [_change("legacy member moved", f"$.{n}", v, texts[n]) for n, v in told.items()]


def _arguments_of(schema: dict) -> list[str]:
    return list(schema["properties"]["evaluation_results"]["items"]["properties"]["generation_config"]["properties"]["generation_args"]["properties"])


def _steps(source_types: dict, parties: dict) -> dict[str, Step]:
    version = lambda v: VERSION
    return {
        "schema_version": replace("schema version", ("schema_version",), lambda v: not (isinstance(v, str) and v in VERSIONS), version),
        "retrieved_timestamp": replace("timestamp as text", ("retrieved_timestamp",), lambda v: v is not ABSENT and kind_of(v) in NUMBERS, to_json),
        "source_type": renamed("source type", ("source_metadata", "source_type"), source_types), "evaluator_relationship": renamed("relationship", ("source_metadata", "evaluator_relationship"), parties),
        "score": in_results(_score_number), "eval_library": replace("library", ("eval_library",), lambda v: v is ABSENT, lambda v: {"name": "unknown", "version": "unknown"}),
        "eval_library_version": replace("library version", ("eval_library", "version"), lambda v: v is ABSENT or v is None, lambda v: "unknown"),
        "model_id": _model_id, "source_details": _spelled_details("source_metadata"), "library_details": _spelled_details("eval_library"), "legacy": _legacy,
        "generation_args": in_results(_arguments(_arguments_of(RECORD_SCHEMA))), "metric_bounds": in_results(_metric_bounds),
    }


def _model_id(document):
    info = field(document, "model_info")
    name = field(info, "name")
    if name is ABSENT or field(info, "id") is not ABSENT:
        return document, []
    return put(document, "model_info", put(info, "id", name)), [_change("model id", "$.model_info.id", ABSENT, name)]


#: All repairs, in order.
FIXES = _steps(SOURCE_TYPES, PARTIES)
#: The older set, which knows fewer old names and leaves details, arguments and bounds alone.
OLDER_FIXES = {k: v for k, v in _steps({"evaluation_platform": "evaluation_run"}, {"unknown": "other"}).items() if k in ("schema_version", "retrieved_timestamp", "source_type", "evaluator_relationship", "score", "eval_library", "model_id")}


def folded(document, steps: list[Step]) -> tuple[object, list[Change]]:
    """A document after all steps, one after the other, and all changes; one that is no object stays as it is."""
    log = []
    if isinstance(document, dict):
        for step in steps:
            document, changes = step(document)
            log += changes
    return document, log


def _column(kind: str, of: Callable[[object], object], made: Callable[[list], pa.Array], document: Column) -> Column:
    """A column that a Python function computes of each document (ABSENT for null)."""
    reader = variants.Reader()

    def run(column: pa.Array) -> pa.Array:
        return made([of(v) for v in variants.values_of(column, reader)])

    return F.arrow_udf(run, kind)(document)


_changes = partial(variants.lists_of, names=CHANGE)
_errors = partial(variants.lists_of, names=FIELDS)


def repair(rows: DataFrame, document: str = "document", fixes: dict[str, Step] | None = None, log: str = "fixes") -> DataFrame:
    """The documents after all steps, in order, and what each changed. A null document, or one that is no object, stays as it is.

    The fold is a Python function of the row: nothing is shuffled, and no row needs another. Documents and changes are two
    columns, each computed only if it is read.
    """
    steps = list((FIXES if fixes is None else fixes).values())

    def renewed(value):
        new, changes = folded(value, steps)
        return variants.written(new) if changes else None

    given = F.col(document)
    return rows.withColumns({document: F.coalesce(_column("variant", renewed, variants.variants_of, given), given), log: _column(LOG, lambda v: folded(v, steps)[1], _changes, given)})


def validated(rows: DataFrame, document: str = "document", schema: dict | None = None, fixes: dict[str, Step] | None = None, write: bool = True) -> DataFrame:
    """Status valid, fixed (fixable if nothing is to be written) or invalid, with the repairs made and the errors left.

    Documents that were valid are not repaired; a text that is no JSON object is invalid and has no repairs.
    """
    schema = RECORD_SCHEMA if schema is None else schema
    if has_patterns(schema):
        return _validated_in_columns(rows, document, schema, fixes, write)
    steps, errors = list((FIXES if fixes is None else fixes).values()), checked(schema)

    def status(value) -> str:
        return "valid" if not errors(value) else "invalid" if errors(folded(value, steps)[0]) else "fixed" if write else "fixable"

    def renewed(value):
        new, changes = folded(value, steps) if errors(value) else (value, [])
        return variants.written(new) if changes else None

    given = F.col(document)
    columns = {
        "status": _column("string", status, partial(pa.array, type=pa.string()), given), "fixes": _column(LOG, lambda v: folded(v, steps)[1] if errors(v) else [], _changes, given),
        "errors": _column(ERRORS, lambda v: errors(folded(v, steps)[0]) if errors(v) else [], _errors, given),
    }
    return rows.withColumns(columns | ({document: F.coalesce(_column("variant", renewed, variants.variants_of, given), given)} if write else {}))


def _validated_in_columns(rows: DataFrame, document: str, schema: dict, fixes: dict[str, Step] | None, write: bool) -> DataFrame:
    """validated() by a schema with patterns, whose errors are a column expression before and after the repairs."""
    before = rows.withColumn("_given", F.col(document)).withColumn("_valid", F.size(schema_errors(document, schema)) == 0)
    after = repair(before, document, fixes).withColumn("errors", schema_errors(document, schema))
    status = F.when(F.col("_valid"), "valid").when(F.size("errors") == 0, "fixed" if write else "fixable").otherwise("invalid")
    untouched = F.col("_valid") | F.lit(not write)
    return after.withColumns({"status": status, "fixes": F.when(F.col("_valid"), F.array().cast(LOG)).otherwise(F.col("fixes")), "errors": F.when(F.col("_valid"), F.array().cast(ERRORS)).otherwise(F.col("errors")), document: F.when(untouched, F.col("_given")).otherwise(F.col(document))}).drop("_given", "_valid")
