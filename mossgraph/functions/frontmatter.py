"""Typed front-matter values: kinds, injective terms, filter literals, YAML and its rendering.

Numbers are kept as digits. A value's term is its kind and, but for numbers and booleans, its length in
UTF-16 units, so no two values share one.
"""

from __future__ import annotations

import json
import re
from typing import Any

import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import CONTRACT_KEYS, InvalidRequest
from .text import utf16_length

_INT = re.compile(r"-?(0|[1-9][0-9]*)")
_FLOAT = re.compile(r"-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?")
MAX_NESTING, MAX_ALIASES, MAX_BYTES = 20, 50, 1 << 20


class Number(str):
    """Digits of a number, as they are compared."""


def jvm_double(x: float) -> str:
    """A double as the JVM prints it."""
    if x != x:
        return "NaN"
    if x in (float("inf"), float("-inf")):
        return "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "-0.0" if str(x).startswith("-") else "0.0"
    if 1e-3 <= abs(x) < 1e7:
        s = format(x, "f") if "e" in repr(x) else repr(x)
        return s if "." in s else s + ".0"
    mantissa, _, exponent = f"{x:.17e}".partition("e")
    digits = repr(x).lower().partition("e")
    if digits[2]:
        mantissa, exponent = digits[0], digits[2]
    else:
        sign, body = ("-", digits[0][1:]) if digits[0].startswith("-") else ("", digits[0])
        whole, _, part = body.partition(".")
        stripped = (whole + part).lstrip("0")
        exponent = str(len(whole) - 1 if whole.strip("0") else -(len(part) - len(part.lstrip("0")) + 1))
        mantissa = sign + stripped[0] + "." + (stripped[1:].rstrip("0") or "0")
    return f"{mantissa if '.' in mantissa else mantissa + '.0'}E{int(exponent)}"


def canonical_number(text: str) -> Number | None:
    """The number that a plain literal states, or None if it stays text (0042, +42, 1_000, 0x1F, .5)."""
    if text in (".inf", "-.inf", ".nan"):
        return Number(text)
    if _INT.fullmatch(text):
        return Number("0" if text in ("0", "-0") else text)
    if _FLOAT.fullmatch(text):
        return Number(jvm_double(float(text)))
    return None


def literal(raw: str) -> str | Number | bool:
    """A filter's value: quoted text, true or false, a number in plain form, or else text."""
    if raw == "":
        raise InvalidRequest("empty filter value")
    if raw[0] in "\"'" or raw[-1] in "\"'":
        if len(raw) < 2 or raw[0] != raw[-1]:
            raise InvalidRequest(f"badly quoted filter value {raw!r}")
        return raw[1:-1]
    if raw in ("true", "false"):
        return raw == "true"
    number = canonical_number(raw)
    return raw if number is None else number


def _units(s: str) -> int:
    return len(s.encode("utf-16-le")) // 2


def term(value: Any) -> str:
    if isinstance(value, bool):
        return f"b:{str(value).lower()}"
    if isinstance(value, Number):
        return f"n:{value}"
    if isinstance(value, str):
        return f"s{_units(value)}:{value}"
    if isinstance(value, list):
        return f"l{len(value)}:" + "".join(map(term, value))
    return f"m{len(value)}:" + "".join(f"{_units(k)}:{k}{term(v)}" for k, v in value.items())


def leaves(value: Any) -> list[Any]:
    if isinstance(value, list):
        return [x for v in value for x in leaves(v)]
    if isinstance(value, dict):
        return [x for v in value.values() for x in leaves(v)]
    return [value]


def terms_of(value: Any) -> list[str]:
    """The whole value's term and, for a collection, every scalar's in it."""
    return list(dict.fromkeys([term(value), *map(term, leaves(value))]))


def text_term(value: Column) -> Column:
    return F.concat(F.lit("s"), utf16_length(value).cast("string"), F.lit(":"), value)


def number_term(value: Column) -> Column:
    """Of whole numbers as text digits, and of doubles as the JVM spells them."""
    return F.concat(F.lit("n:"), F.when(value.cast("string") == "-0", "0").otherwise(value.cast("string")))


def boolean_term(value: Column) -> Column:
    return F.concat(F.lit("b:"), value.cast("string"))


def canonical_number_column(text: Column) -> Column:
    """``canonical_number`` for columns; null where the literal stays text."""
    integer = F.rlike(text, F.lit("^-?(0|[1-9][0-9]*)$"))
    real = F.rlike(text, F.lit(r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"))
    return F.when(text.isin("0", "-0"), "0").when(integer | text.isin(".inf", "-.inf", ".nan"), text).when(real, text.cast("double").cast("string"))


def literal_term_column(text: Column) -> Column:
    """The term that a filter literal is compared by; null for errors."""
    quoted = F.rlike(text, F.lit("(?s)^(\".*\"|'.*')$")) & (F.length(text) >= 2)
    broken = (text == "") | F.rlike(text, F.lit("(?s)^[\"']|[\"']$"))
    number = canonical_number_column(text)
    return F.when(quoted, text_term(F.substring(text, F.lit(2), F.length(text) - 2))).when(broken, None).when(text.isin("true", "false"), F.concat(F.lit("b:"), text)).when(number.isNotNull(), F.concat(F.lit("n:"), number)).otherwise(text_term(text))


def fm_filter(fm_terms: Column, filters: dict[str, str]) -> Column:
    """All of ``filters`` on an array of key=term strings; typed fields have filters of their own."""
    out = F.lit(True)
    for key, raw in filters.items():
        if key in CONTRACT_KEYS:
            raise InvalidRequest(f"{key} is no front-matter filter")
        out &= F.array_contains(fm_terms, f"{key}={term(literal(raw))}")
    return out


# YAML


class _Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """YAML whose plain scalars follow the filter literals; dates stay text, and duplicate keys are errors."""


_Loader.yaml_implicit_resolvers = {}


def _scalar(loader: _Loader, node: yaml.ScalarNode) -> Any:
    return node.value if node.style or node.tag not in ("tag:yaml.org,2002:str", "!") else _plain(node.value)


def _plain(text: str) -> Any:
    """The value of a plain scalar."""
    if text in ("", "~", "null", "Null", "NULL"):
        return None
    if text in ("true", "True", "TRUE", "false", "False", "FALSE"):
        return text.lower() == "true"
    number = canonical_number(text)
    return text if number is None else number


def _mapping(loader: _Loader, node: yaml.MappingNode) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in node.value:
        if not isinstance(k, yaml.ScalarNode):
            raise yaml.YAMLError("a key must be a scalar")
        if k.value in out:
            raise yaml.YAMLError(f"duplicate key {k.value}")
        out[k.value] = loader.construct_object(v, deep=True)
    return {k: v for k, v in out.items() if v is not None}


_Loader.add_constructor("tag:yaml.org,2002:str", _scalar)
_Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
_Loader.add_constructor("tag:yaml.org,2002:seq", lambda loader, node: [x for v in node.value if (x := loader.construct_object(v, deep=True)) is not None])


def _depth(node: yaml.Node, path: tuple[int, ...] = ()) -> int:
    if id(node) in path:
        raise yaml.YAMLError("recursive value")
    below = [x for pair in node.value for x in pair] if isinstance(node, yaml.MappingNode) else node.value if isinstance(node, yaml.SequenceNode) else []
    return 1 + max((_depth(x, (*path, id(node))) for x in below), default=0)


_WORDS = "[A-Za-z0-9][A-Za-z0-9._/-]*(?: [A-Za-z0-9][A-Za-z0-9._/-]*)*"
_LINE = re.compile(rf"([A-Za-z][A-Za-z0-9_-]{{0,63}}): (?:({_WORDS})|\[({_WORDS}(?:, {_WORDS})*)\])")


def _of_lines(block: str) -> dict[str, Any] | None:
    """The values of a block of plain words and flat lists of such, which most are; None if it may be anything else."""
    out: dict[str, Any] = {}
    if len(block) > MAX_BYTES:
        return None
    for line in block.split("\n"):
        m = _LINE.fullmatch(line)
        if m is None or m[1] in out:
            return None
        out[m[1]] = _plain(m[2]) if m[3] is None else [v for x in m[3].split(", ") if (v := _plain(x)) is not None]
    return {k: v for k, v in out.items() if v is not None}


def parse_yaml(block: str) -> tuple[dict[str, Any], str | None]:
    """The values of a block and None, or no values and the error."""
    made = _of_lines(block)
    return _by_yaml(block) if made is None else (made, None)


def _by_yaml(block: str) -> tuple[dict[str, Any], str | None]:
    try:
        if len(block.encode()) > MAX_BYTES:
            raise yaml.YAMLError("too long")
        if block.count("*") > MAX_ALIASES and sum(isinstance(e, yaml.AliasEvent) for e in yaml.parse(block, Loader=_Loader)) > MAX_ALIASES:
            raise yaml.YAMLError("too many aliases")
        loader = _Loader(block)
        node = loader.get_single_node()
        if node is None:
            return {}, None
        if not isinstance(node, yaml.MappingNode):
            raise yaml.YAMLError("not a mapping")
        if _depth(node) > MAX_NESTING:
            raise yaml.YAMLError("nested too deep")
        values = loader.construct_document(node)
        if any(isinstance(x, str) and re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", x) for x in leaves(values)):
            raise yaml.YAMLError("control character")
        return values, None
    except (yaml.YAMLError, RecursionError) as e:
        return {}, str(e).splitlines()[0]


_BARE = re.compile(r"[A-Za-z][A-Za-z0-9_./-]*")
_RESERVED = {"true", "false", "null", "yes", "no", "on", "off"}


def _rendered(value: Any) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, list):
        return "[" + ", ".join(map(_rendered, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_rendered(k)}: {_rendered(v)}" for k, v in value.items()) + "}"
    if re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", value):
        raise InvalidRequest("control character in front matter")
    return value if _BARE.fullmatch(value) and value.lower() not in _RESERVED else json.dumps(value, ensure_ascii=False)


def render_yaml(values: dict[str, Any]) -> str:
    """A block with typed fields first, then the others in their order; lists and maps of scalars in block style."""
    lines: list[str] = []
    for key in [*(k for k in CONTRACT_KEYS if k in values), *(k for k in values if k not in CONTRACT_KEYS)]:
        value = values[key]
        flat = isinstance(value, list | dict) and value and not any(isinstance(x, list | dict) for x in (value.values() if isinstance(value, dict) else value))
        if flat and isinstance(value, list):
            lines += [f"{_rendered(key)}:", *(f"  - {_rendered(x)}" for x in value)]
        elif flat:
            lines += [f"{_rendered(key)}:", *(f"  {_rendered(k)}: {_rendered(v)}" for k, v in value.items())]
        else:
            lines.append(f"{_rendered(key)}: {_rendered(value)}")
    return "\n".join(lines) + "\n" if lines else ""


def render_document(values: dict[str, Any], body: str, verbatim: str | None = None) -> str:
    """A whole document; the block as it was written wins."""
    block = verbatim if verbatim is not None else render_yaml(values)
    return f"---\n{block}{'' if block.endswith(chr(10)) or not block else chr(10)}---\n{body}" if block or verbatim is not None else body


def from_json(text: str) -> dict[str, Any]:
    """JSON's object as typed values; digits of numbers are kept, nulls go, and typed fields must have their shape."""

    def value(x: Any) -> Any:
        if isinstance(x, list):
            return [y for v in x if (y := value(v)) is not None]
        if isinstance(x, dict):
            return {k: y for k, v in x.items() if (y := value(v)) is not None}
        return x

    number = lambda s: canonical_number(s) or Number(s)
    values = value(json.loads(text, parse_int=number, parse_float=number))
    for key in ("title", "author", "updated_at", "content_hash"):
        if key in values and (not isinstance(values[key], str) or isinstance(values[key], Number)):
            raise InvalidRequest(f"{key} must be text")
    for key in ("tags", "aliases"):
        if key in values and (not isinstance(values[key], list) or any(not isinstance(x, str) or isinstance(x, Number) for x in values[key])):
            raise InvalidRequest(f"{key} must be a list of texts")
    return values


def to_json(values: dict[str, Any]) -> str:
    def out(x: Any) -> str:
        if isinstance(x, bool):
            return str(x).lower()
        if isinstance(x, Number):
            return str(x) if not x.startswith((".", "-.")) and x not in ("NaN", "Infinity", "-Infinity") else json.dumps(str(x))
        if isinstance(x, list):
            return "[" + ",".join(map(out, x)) + "]"
        if isinstance(x, dict):
            return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{out(v)}" for k, v in x.items()) + "}"
        return json.dumps(x, ensure_ascii=False)

    return out(values)
