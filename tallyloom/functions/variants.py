"""VARIANT values in Python: read from their bytes with the kind of every value kept, written again, and spelled as Spark's to_json spells them."""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable
from datetime import UTC, date, datetime, timedelta
from decimal import Context, Decimal
from uuid import UUID

import pyarrow as pa

WIDE = Context(prec=80)
#: Calls within calls that are allowed: Spark's parser goes 1,000 values deep.
DEEP = 9_000


class Absent:
    """The class of ABSENT, which is pickled by its name and so stays one object."""

    def __reduce__(self) -> str:
        return "ABSENT"


#: What stands for a member that is absent: a JSON null is None.
ABSENT = Absent()


class Shared(dict):
    """An object that several documents have alike: never changed in place, and with room for what a schema's nodes found in it."""

    __slots__ = ("found",)


class Other:
    """A scalar that JSON does not know, which only casts make: its kind, its text and its bytes."""

    __slots__ = ("kind", "text", "raw")

    def __init__(self, kind: str, text: str, raw: bytes) -> None:
        self.kind, self.text, self.raw = kind, text, raw

    def __float__(self) -> float:
        return float(self.text)


#: Kinds as Spark's schema_of_variant calls them.
KINDS = {type(None): "VOID", bool: "BOOLEAN", int: "BIGINT", Decimal: "DECIMAL", float: "DOUBLE", str: "STRING", dict: "OBJECT", Shared: "OBJECT", list: "ARRAY"}
NUMBERS = frozenset(("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"))


def kind_of(value) -> str:
    return KINDS.get(type(value)) or value.kind


def in_order(members: dict) -> dict:
    """Members in the order in which a VARIANT keeps them: by UTF-16 units of their names."""
    return dict(sorted(members.items(), key=lambda e: e[0].encode("utf-16-be")))


# Reading

_DAY, _MOMENT = date(1970, 1, 1), datetime(1970, 1, 1, tzinfo=UTC)
_HALF, _WORD, _LONG, _DOUBLE, _FLOAT = (struct.Struct(f).unpack_from for f in ("<h", "<i", "<q", "<d", "<f"))


def _decimal(size: int):
    return lambda b, at: Decimal(int.from_bytes(b[at + 2 : at + 2 + size], "little", signed=True)).scaleb(-b[at + 1], WIDE)


def _other(kind: str, size: int, text: Callable[[bytes], str]):
    return lambda b, at: Other(kind, text(b[at + 1 : at + 1 + size]), b[at : at + 1 + size])


def _moment(zone: str):
    def text(b: bytes) -> str:
        t = _MOMENT + timedelta(microseconds=_LONG(b, 0)[0])
        return t.strftime("%Y-%m-%d %H:%M:%S") + (f".{t.microsecond:06}".rstrip("0") if t.microsecond else "") + zone

    return text


def _binary(b: bytes, at: int) -> Other:
    import base64

    end = at + 5 + int.from_bytes(b[at + 1 : at + 5], "little")
    return Other("BINARY", base64.b64encode(b[at + 5 : end]).decode(), b[at:end])


_PRIMITIVES = {
    0: lambda b, at: None, 1: lambda b, at: True, 2: lambda b, at: False, 3: lambda b, at: b[at + 1] - 256 if b[at + 1] > 127 else b[at + 1], 4: lambda b, at: _HALF(b, at + 1)[0], 5: lambda b, at: _WORD(b, at + 1)[0],
    6: lambda b, at: _LONG(b, at + 1)[0], 7: lambda b, at: _DOUBLE(b, at + 1)[0], 8: _decimal(4), 9: _decimal(8), 10: _decimal(16), 11: _other("DATE", 4, lambda b: (_DAY + timedelta(days=_WORD(b, 0)[0])).isoformat()),
    12: _other("TIMESTAMP", 8, _moment("+00:00")), 13: _other("TIMESTAMP_NTZ", 8, _moment("")), 14: _other("FLOAT", 4, lambda b: float_text(float(f"{_FLOAT(b, 0)[0]:.9g}"))), 15: _binary,
    16: lambda b, at: b[at + 5 : at + 5 + _WORD(b, at + 1)[0]].decode(), 20: _other("UUID", 16, lambda b: str(UUID(bytes=b))),
}


def _numbers(b: bytes, at: int, n: int, size: int):
    """n unsigned numbers of so many bytes each."""
    if size == 1:
        return b[at : at + n]
    if size == 3:
        return [int.from_bytes(b[i : i + 3], "little") for i in range(at, at + 3 * n, 3)]
    return struct.unpack_from(f"<{n}{'H' if size == 2 else 'I'}", b, at)


class Reader:
    """Reads values; names of members are read once for all documents that have the same, and so are small objects."""

    SMALL, MOST = 1024, 5_000

    def __init__(self) -> None:
        self.known: dict[bytes, tuple[list[str], dict[bytes, Shared]]] = {}
        self.kept = 0

    def __call__(self, value: bytes, metadata: bytes):
        known = self.known.get(metadata)
        if known is None:
            if len(self.known) >= 1000:
                self.known, self.kept = {}, 0
            known = self.known[metadata] = self._names(metadata), {}
        return self._value(value, 0, *known)

    @staticmethod
    def _names(b: bytes) -> list[str]:
        size = (b[0] >> 6) + 1
        n = int.from_bytes(b[1 : 1 + size], "little")
        offsets, start = _numbers(b, 1 + size, n + 1, size), 1 + size * (n + 2)
        return [b[start + i : start + j].decode() for i, j in zip(offsets, offsets[1:], strict=False)]

    def _value(self, b: bytes, at: int, names: list[str], shared: dict[bytes, Shared]):
        """The value at a place."""
        head = b[at]
        basic, rest = head & 3, head >> 2
        if basic == 1:
            return b[at + 1 : at + 1 + rest].decode()
        if basic == 0:
            return _PRIMITIVES[rest](b, at)
        size, large = (rest & 3) + 1, rest >> (4 if basic == 2 else 2) & 1
        n, ids = (int.from_bytes(b[at + 1 : at + 5], "little"), at + 5) if large else (b[at + 1], at + 2)
        if basic == 3:
            offsets, start = _numbers(b, ids, n + 1, size), ids + (n + 1) * size
            return [self._value(b, start + o, names, shared) for o in offsets[:n]]
        wide = (rest >> 2 & 3) + 1
        start = ids + n * wide + (n + 1) * size
        end = start + (b[start - 1] if size == 1 else int.from_bytes(b[start - size : start], "little"))
        small = at > 0 and end - at <= self.SMALL
        if small:
            raw = b[at:end]
            if (known := shared.get(raw)) is not None:
                return known
        members = {}
        for i, o in zip(_numbers(b, ids, n, wide), _numbers(b, ids + n * wide, n, size), strict=True):
            h = b[o := start + o]
            members[names[i]] = b[o + 1 : o + 1 + (h >> 2)].decode() if h & 3 == 1 else self._value(b, o, names, shared)
        if not small:
            return members
        if self.kept >= self.MOST:
            self.kept = 0
            for _, objects in self.known.values():
                objects.clear()
        self.kept += 1
        members = shared[raw] = Shared(members)
        members.found = {}
        return members


# Writing


def _width(n: int) -> int:
    return max(1, (n.bit_length() + 7) // 8)


def _primitive(value) -> bytes:
    if value is None or value is True or value is False:
        return bytes([{None: 0, True: 1, False: 2}[value] << 2])
    if isinstance(value, int):
        size, kind = next((s, k) for s, k in ((1, 3), (2, 4), (4, 5), (8, 6)) if -(1 << 8 * s - 1) <= value < 1 << 8 * s - 1)
        return bytes([kind << 2]) + value.to_bytes(size, "little", signed=True)
    if isinstance(value, float):
        return bytes([7 << 2]) + struct.pack("<d", value)
    if isinstance(value, str):
        raw = value.encode()
        return (bytes([len(raw) << 2 | 1]) if len(raw) < 64 else bytes([16 << 2]) + struct.pack("<I", len(raw))) + raw
    if isinstance(value, Decimal):
        sign, digits, exponent = value.as_tuple()
        number = int("".join(map(str, digits))) * (-1 if sign else 1) * 10 ** max(exponent, 0)
        size, kind = next((s, k) for s, k, most in ((4, 8, 9), (8, 9, 18), (16, 10, 38)) if max(len(str(abs(number))), -exponent) <= most)
        return bytes([kind << 2, max(-exponent, 0)]) + number.to_bytes(size, "little", signed=True)
    return value.raw


def written(value) -> tuple[bytes, bytes]:
    """The bytes of a value and of its metadata."""
    ids: dict[str, int] = {}

    def number(v) -> None:
        if isinstance(v, dict):
            for k, x in v.items():
                ids.setdefault(k, len(ids))
                number(x)
        elif isinstance(v, list):
            for x in v:
                number(x)

    def of(v) -> bytes:
        if not isinstance(v, dict | list):
            return _primitive(v)
        members = in_order(v) if isinstance(v, dict) else None
        parts = [of(x) for x in (members.values() if members is not None else v)]
        at, offsets = 0, [0]
        for p in parts:
            at += len(p)
            offsets.append(at)
        size, large, n = _width(at), len(parts) > 255, len(parts)
        body = b"".join(o.to_bytes(size, "little") for o in offsets) + b"".join(parts)
        count = n.to_bytes(4 if large else 1, "little")
        if members is None:
            return bytes([(large << 2 | size - 1) << 2 | 3]) + count + body
        wide = _width(max(len(ids) - 1, 0))
        return bytes([(large << 4 | wide - 1 << 2 | size - 1) << 2 | 2]) + count + b"".join(ids[k].to_bytes(wide, "little") for k in members) + body

    number(value)
    raw = [k.encode() for k in ids]
    ends = [0]
    for r in raw:
        ends.append(ends[-1] + len(r))
    size = _width(max(ends[-1], len(raw)))
    return of(value), bytes([1 | size - 1 << 6]) + b"".join(n.to_bytes(size, "little") for n in (len(raw), *ends)) + b"".join(raw)


# Texts

_ESCAPED = re.compile(r'["\\\x00-\x1f]')
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def float_text(value: float) -> str:
    """A double as Java spells it, with the fewest digits that tell it from others (of Java versions before 19 some have one more)."""
    if value != value or value in (float("inf"), float("-inf")):
        return "NaN" if value != value else "Infinity" if value > 0 else "-Infinity"
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        text = f"{Decimal(repr(value)):f}"
        return text if "." in text else text + ".0"
    sign, digits, exponent = Decimal(repr(value)).as_tuple()
    digits, power = "".join(map(str, digits)), exponent + len(digits) - 1
    return f"{'-' if sign else ''}{digits[0]}.{digits[1:].rstrip('0') or '0'}E{power}"


def quoted(text: str) -> str:
    return '"' + _ESCAPED.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04X}", text) + '"'


def to_json(value) -> str | None:
    """The text that Spark's to_json gives for a VARIANT; None if there is no value."""
    if value is ABSENT:
        return None
    if isinstance(value, str):
        return quoted(value)
    if value is None or value is True or value is False:
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, dict):
        return "{" + ",".join(f"{quoted(k)}:{to_json(v)}" for k, v in in_order(value).items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(to_json, value)) + "]"
    if isinstance(value, float):
        text = float_text(value)
        return text if text[-1].isdigit() else quoted(text)
    if isinstance(value, Decimal):
        return f"{value.normalize(WIDE):f}" if value else "0"
    if isinstance(value, Other):
        return value.text if value.kind == "FLOAT" and value.text[-1].isdigit() else quoted(value.text)
    return str(value)


# Columns


def values_of(column: pa.StructArray, reader: Reader):
    """The values of a column of VARIANT, one at a time; ABSENT for null."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEP))
    for there, value, metadata in zip(column.is_valid().to_pylist(), column.field("value").to_pylist(), column.field("metadata").to_pylist(), strict=True):
        yield reader(value, metadata) if there else ABSENT


def variants_of(rows: list[tuple[bytes, bytes] | None]) -> pa.Array:
    """A column of VARIANT from what written() gives, or None."""
    fields = [pa.field("value", pa.binary(), nullable=False), pa.field("metadata", pa.binary(), nullable=False, metadata={b"variant": b"true"})]
    columns = [pa.array([r[i] if r else b"" for r in rows], pa.binary()) for i in (0, 1)]
    return pa.StructArray.from_arrays(columns, fields=fields, mask=pa.array([r is None for r in rows]))


def lists_of(rows: list[list[tuple]], names: tuple[str, ...]) -> pa.Array:
    """A column of arrays of structs of texts, from tuples."""
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r))
    flat = [e for r in rows for e in r]
    columns = [pa.array([e[i] for e in flat], pa.string()) for i in range(len(names))]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=list(names)))
