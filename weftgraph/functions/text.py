"""Scalar functions on text: type inference, ids, weights, times, lists, intervals, quoting.

Functions that end in `_col` are Column expressions; the others are plain Python for the parsers of whole files.
Patterns are anchored by \\A and \\z, as $ also matches before a trailing line feed.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

INTEGER = r"-?(?:0|[1-9][0-9]*)"
#: As int or float literals of JSON, with a leading plus or point allowed.
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
LEADING_ZERO = r"[+-]?0[0-9]+.*"
SAFE = 9_007_199_254_740_991
#: Widening order of inferred types.
WIDTHS = ("bool", "i32", "f64", "string", "json")


def infer_dtype(text: str) -> str:
    """bool, i32, f64 or string of a cell's text. `01` is a string, `+1` and `1.0` are f64, `1e400` is a string."""
    if text in ("true", "false"):
        return "bool"
    if re.fullmatch(INTEGER, text) and text != "-0" and -(2**31) <= int(text) < 2**31:
        return "i32"
    if re.fullmatch(NUMBER, text) and not re.fullmatch(LEADING_ZERO, text.split(".")[0].split("e")[0]) and math.isfinite(float(text)):
        return "f64"
    return "string"


def infer_dtype_col(c: Column) -> Column:
    """infer_dtype as an expression; null for null."""
    whole = lambda p: c.rlike(rf"\A(?:{p})\z")
    number = whole(NUMBER) & ~whole(r"[+-]?0[0-9]+(?:[.eE].*)?") & (F.abs(c.try_cast("double")) < float("inf"))
    return F.when(c.isNull(), None).when(c.isin("true", "false"), "bool").when(whole(INTEGER) & (c != "-0") & c.try_cast("int").isNotNull(), "i32").when(number, "f64").otherwise("string")


def widen(a: str, b: str) -> str:
    """The narrowest type that holds both."""
    return WIDTHS[max(WIDTHS.index(a), WIDTHS.index(b))]


def widest_col(c: Column) -> Column:
    """Aggregate: the type of a column of texts."""
    listed = F.array(*[F.lit(w) for w in WIDTHS])
    return F.element_at(listed, F.max(F.array_position(listed, infer_dtype_col(c))).cast("int"))


def parse_as(text: str, dtype: str):
    """A cell's value under a type; None if it doesn't fit."""
    if dtype == "bool":
        return {"true": True, "false": False}.get(text)
    if dtype == "i32":
        return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) and -(2**31) <= int(text) < 2**31 else None
    if dtype == "f64":
        return float(text) if re.fullmatch(NUMBER, text) else None
    return text


def infer_value(v) -> str:
    """The type of a JSON value."""
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "i32" if -(2**31) <= v < 2**31 else "f64"
    return "f64" if isinstance(v, float) else "string" if isinstance(v, str) else "json"


def number_text(x: float) -> str:
    """The shortest text of a number, without a fraction for whole ones below 10^21."""
    if x != x:
        return "NaN"
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    m = re.fullmatch(r"(-?)(\d)(?:\.(\d+))?e([+-])0*(\d+)", repr(x))
    if not m:
        return repr(x)
    e = int(m[5])
    if m[4] == "-" and e <= 6:  # plain down to 0.000001
        return f"{m[1]}0.{'0' * (e - 1)}{m[2]}{m[3] or ''}"
    return f"{m[1]}{m[2]}{'.' + m[3] if m[3] else ''}e{m[4]}{e}"


def f32_text(x: float) -> str:
    """The shortest text that reads back as the same FLOAT."""
    import numpy as np

    v = np.float32(x)
    return number_text(float(x)) if not np.isfinite(v) or v == int(v) and abs(v) < 1e21 else number_text(float(np.format_float_positional(v, unique=True, trim="0")) if 1e-6 <= abs(v) < 1e21 else float(np.format_float_scientific(v, unique=True)))


def coerce_to_text(v) -> str:
    """A cell's text when its column widens to string."""
    return ("true" if v else "false") if isinstance(v, bool) else number_text(float(v)) if isinstance(v, (int, float)) else v if isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)


# ids


def canonical_id(text: str):
    """Text that is the canonical form of a safe integer becomes that number; `-0` and all else stay text."""
    return int(text) if re.fullmatch(INTEGER, text) and text != "-0" and abs(int(text)) <= SAFE else text


def canonical_id_col(c: Column) -> Column:
    """The LONG of a canonical id, null for others."""
    n = c.try_cast("bigint")
    return F.when(c.rlike(rf"\A{INTEGER}\z") & (c != "-0") & (F.abs(n) <= SAFE), n)


def coerce_id(v, mode: str = "keep"):
    """keep, canonical, string or number. A value that can't be an id is None."""
    if v is None or isinstance(v, (dict, list, bool)) or (isinstance(v, float) and not math.isfinite(v)):
        return None
    if isinstance(v, float) and v == int(v) and abs(v) <= SAFE:
        v = int(v)
    if mode == "string":
        return v if isinstance(v, str) else number_text(float(v))
    if mode == "canonical":
        return canonical_id(v) if isinstance(v, str) else v
    if mode == "number" and isinstance(v, str):
        return coerce_id(float(v)) if re.fullmatch(NUMBER, v.strip()) else None
    return v


def parse_weight(text: str | None):
    """(value, ok): blank is an omitted weight (None); NaN and other text aren't ok. Infinity is."""
    t = (text or "").strip()
    if not t:
        return None, True
    m = re.fullmatch(r"([+-]?)(?:inf|infinity)", t, re.I)
    if m:
        return (-math.inf if m[1] == "-" else math.inf), True
    return (float(t), True) if re.fullmatch(NUMBER, t) else (None, False)


def parse_weight_col(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t.rlike(rf"\A{NUMBER}\z"), t.try_cast("double")).when(t.rlike(r"\A[+]?(?i:inf|infinity)\z"), F.lit(float("inf"))).when(t.rlike(r"\A-(?i:inf|infinity)\z"), F.lit(float("-inf")))


def parse_boolean(text: str):
    return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(text.strip().lower())


def parse_decimal(text: str):
    return float(text) if re.fullmatch(NUMBER, text.strip()) else None


def parse_json(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


# times

_DATE = re.compile(r"([+-]?\d{4,6})(?:-(\d\d)(?:-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?\s*(Z|[+-]\d\d:?\d\d)?)?)?)?")
_TIME = re.compile(r"(\d\d):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?\s*(Z|[+-]\d\d:?\d\d)?")


def _days(y: int, m: int, d: int) -> int:
    """Days from 1970-01-01 in the proleptic Gregorian calendar."""
    y -= m <= 2
    era = y // 400
    yoe = y - era * 400
    doy = (153 * (m + (-3 if m > 2 else 9)) + 2) // 5 + d - 1
    return era * 146097 + yoe * 365 + yoe // 4 - yoe // 100 + doy - 719468


def _month_days(y: int, m: int) -> int:
    return 29 if m == 2 and y % 4 == 0 and (y % 100 or y % 400 == 0) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _clock(h, mi, s, frac, zone):
    """Milliseconds of a day, UTC; hour 24 only as 24:00:00."""
    h, mi, s = int(h), int(mi), int(s or 0)
    ms = int(((frac or "") + "000")[:3])
    if h > 24 or mi > 59 or s > 59 or (h == 24 and (mi or s or ms)):
        return None
    shift = 0
    if zone and zone != "Z":
        sign, digits = (-1 if zone[0] == "-" else 1), zone[1:].replace(":", "")
        if int(digits[:2]) > 23 or int(digits[2:]) > 59:
            return None
        shift = sign * (int(digits[:2]) * 60 + int(digits[2:])) * 60_000
    return ((h * 60 + mi) * 60 + s) * 1000 + ms - shift


def parse_temporal(text: str):
    """Milliseconds from 1970 UTC of an ISO-8601 year, month, date or date-time; a number as it stands; else None."""
    t = text.strip()
    if m := _DATE.fullmatch(t):
        y, mo, d = int(m[1]), int(m[2] or 1), int(m[3] or 1)
        if m[2] is None and not re.fullmatch(r"\d{4}", t):
            return float(t) if re.fullmatch(NUMBER, t) else None
        if not 1 <= mo <= 12 or not 1 <= d <= _month_days(y, mo):
            return None
        clock = _clock(m[4], m[5], m[6], m[7], m[8]) if m[4] else 0
        return None if clock is None else float(_days(y, mo, d) * 86_400_000 + clock)
    return float(t) if re.fullmatch(NUMBER, t) else None


def parse_time(text: str):
    """Milliseconds of the day of hh:mm[:ss[.f]][zone]."""
    m = _TIME.fullmatch(text.strip())
    return _clock(*m.groups()) if m else None


def format_temporal(ms: float) -> str:
    """yyyy-mm-ddThh:mm:ss.fffZ, a date alone at midnight."""
    day, rest = divmod(int(ms), 86_400_000)
    z = day + 719468
    era = z // 146097
    doe = z - era * 146097
    yoe = (doe - doe // 1460 + doe // 36524 - doe // 146096) // 365
    doy = doe - (365 * yoe + yoe // 4 - yoe // 100)
    mp = (5 * doy + 2) // 153
    d, m = doy - (153 * mp + 2) // 5 + 1, mp + (3 if mp < 10 else -9)
    y = yoe + era * 400 + (m <= 2)
    date = f"{y:04d}-{m:02d}-{d:02d}"
    return date if not rest else f"{date}T{format_time(rest)}Z"


def format_time(ms: int) -> str:
    s, f = divmod(int(ms), 1000)
    out = f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
    return f"{out}.{f:03d}" if f else out


def parse_temporal_col(c: Column) -> Column:
    """DOUBLE milliseconds of ISO dates and date-times with a zone or none (UTC), and of numbers."""
    t = F.trim(c)
    iso = t.rlike(r"\A\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:Z|[+-]\d\d:\d\d)?)?\z")
    zoned = F.when(t.rlike(r"(?:Z|[+-]\d\d:\d\d)\z") & t.rlike("[T ]"), t).otherwise(F.concat(F.when(t.rlike("[T ]"), t).otherwise(F.concat(t, F.lit("T00:00:00"))), F.lit("Z")))
    return F.when(iso, F.unix_millis(F.try_to_timestamp(zoned)).cast("double")).when(t.rlike(rf"\A{NUMBER}\z"), t.try_cast("double"))


# lists and intervals


def split_list(text: str, style: str = "auto") -> list[str]:
    """Items of a list: in brackets by commas with quotes, or by the first of | ; , that occurs."""
    t = text.strip()
    if t.startswith("[") and t.endswith("]") or style == "bracket":
        body = t[1:-1] if t.startswith("[") else t
        out, now, quote, i, quoted = [], "", "", 0, False
        while i < len(body):
            ch = body[i]
            if quote:
                if ch == "\\" and i + 1 < len(body):
                    now += body[i + 1]
                    i += 1
                elif ch == quote:
                    quote = ""
                else:
                    now += ch
            elif ch in "\"'":
                quote, quoted, now = ch, True, now.lstrip()
            elif ch == ",":
                out.append(now if quoted else now.strip())
                now, quoted = "", False
            else:
                now += ch
            i += 1
        last = now if quoted else now.strip()
        return out + [last] if out or last or quoted else []
    if not t:
        return []
    sep = {"pipe": "|", "comma": ",", "semicolon": ";"}.get(style) or next((s for s in "|;," if s in t), None)
    return [x.strip() for x in t.split(sep)] if sep else [t]


def join_list(items: list[str], style: str = "bracket") -> str:
    if style != "bracket":
        return {"pipe": "|", "comma": ",", "semicolon": ";"}[style].join(items)
    plain = lambda s: s == s.strip() and s and not re.search(r"[\[\],\"'\\]", s)
    return "[" + ", ".join(s if plain(s) else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"' for s in items) + "]"


def parse_intervals(text: str) -> list[tuple[float, float]] | None:
    """`[1-5,7-*]`: pairs of bounds, * open to infinity; a lone number is both."""
    t = text.strip()
    t = t[1:-1] if t.startswith("[") and t.endswith("]") else t
    out = []
    for part in t.split(","):
        m = re.fullmatch(r"\s*(\*|-?\d+(?:\.\d+)?)\s*(?:-\s*(\*|-?\d+(?:\.\d+)?)\s*)?", part)
        if not m:
            return None
        a = -math.inf if m[1] == "*" else float(m[1])
        b = (math.inf if m[1] == "*" else a) if m[2] is None else math.inf if m[2] == "*" else float(m[2])
        if b < a:
            return None
        out.append((a, b))
    return out


def format_intervals(spells: list[tuple[float, float]]) -> str:
    one = lambda x: "*" if math.isinf(x) else number_text(x)
    return "[" + ",".join(one(a) if a == b else f"{one(a)}-{one(b)}" for a, b in spells) + "]"


def parse_intervals_col(c: Column) -> Column:
    """ARRAY<STRUCT<start, end>> of such text."""
    item = F.split(F.regexp_replace(c, r"[\[\]\s]", ""), ",")
    bound = lambda t, inf: F.when(t == "*", F.lit(inf)).otherwise(t.try_cast("double"))

    def one(p: Column) -> Column:
        a, b = F.regexp_extract(p, r"\A(\*|-?[0-9.]+)", 1), F.regexp_extract(p, r"\A(?:\*|-?[0-9.]+)-(\*|-?[0-9.]+)\z", 1)
        low = bound(a, float("-inf"))
        return F.struct(low.alias("start"), F.when(b == "", F.when(a == "*", F.lit(float("inf"))).otherwise(low)).otherwise(bound(b, float("inf"))).alias("end"))

    return F.when(c.isNotNull(), F.transform(item, one))


def parse_point(text: str) -> list[float] | None:
    """`{x: 1, y: 2}`, `POINT(1 2)` or `1,2[,3]`."""
    found = [float(x) for x in re.findall(NUMBER, re.sub(r"[A-Za-z]+\s*:|srid\s*:\s*\d+|POINT", " ", text))]
    return found if len(found) in (2, 3) else None


# quoting


def quote_csv(text: str, delimiter: str = ",") -> str:
    return '"' + text.replace('"', '""') + '"' if re.search(rf'["\r\n{re.escape(delimiter)}]', text) or text != text.strip() else text


def quote_csv_col(c: Column, delimiter: str = ",") -> Column:
    q = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(c.rlike(rf'["\r\n{re.escape(delimiter)}]') | (c != F.trim(c)), q).otherwise(c)


def escape_xml(text: str) -> str:
    """Text for XML, without the characters that XML can't hold."""
    text = re.sub(r"[^\t\n\r\x20-\uD7FF\uE000-\uFFFD\U00010000-\U0010FFFF]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def quote_dot(text: str) -> str:
    if re.fullmatch(r"[A-Za-z_\u0080-\uffff][A-Za-z0-9_\u0080-\uffff]*|-?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)", text) and text.lower() not in ("node", "edge", "graph", "digraph", "subgraph", "strict"):
        return text
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def quote_gml(text: str) -> str:
    out = text.replace("&", "&amp;").replace('"', "&quot;")
    return '"' + "".join(ch if 32 <= ord(ch) < 127 else f"&#{ord(ch)};" for ch in out) + '"'


def decode_gml(text: str) -> str:
    import html

    return html.unescape(text)


def quote_pajek(text: str) -> str:
    return '"' + text.replace('"', "'").replace("\n", " ").replace("\r", " ") + '"'


_NM = r"A-Za-z0-9_:.\-\u00B7\u00C0-\u02FF\u0370-\u1FFF\u200C\u200D\u3001-\uD7FF"


def is_nmtoken(text: str) -> bool:
    return bool(re.fullmatch(f"[{_NM}]+", text))


def mangle_nmtoken(text: str) -> str:
    """text with each other character as _xHEX_, and so an underscore that would read as such a mark; _x_ for none.
    Different texts stay different: see restore_nmtoken."""
    return re.sub(f"[^{_NM}]|_(?=x[0-9A-F]*_)", lambda m: f"_x{ord(m[0]):X}_", text) or "_x_"


def restore_nmtoken(text: str) -> str:
    """The text that mangle_nmtoken was given."""
    return re.sub("_x([0-9A-F]*)_", lambda m: chr(int(m[1], 16)) if m[1] else "", text)


def unique_name(name: str, taken: set[str], id_: str | None = None) -> str:
    """name, else name#id, else name#2, name#3, ..., the first that isn't taken."""
    if name not in taken:
        return name
    if id_ is not None and f"{name}#{id_}" not in taken:
        return f"{name}#{id_}"
    k = 2
    while f"{name}#{k}" in taken:
        k += 1
    return f"{name}#{k}"


# integer hashing for the directions of coincident nodes


def lowbias32_col(x: Column) -> Column:
    """A 32-bit integer mix in BIGINT arithmetic (fixed multipliers)."""
    m = F.lit(0xFFFFFFFF)
    shift = lambda v, n: F.shiftrightunsigned(v, n)
    # products of two 32-bit numbers wrap in 64 bits but keep their low half
    mul = lambda v, k: ((v.bitwiseAND(F.lit(0xFFFF)) * F.lit(k)) + F.shiftleft((shift(v, 16) * F.lit(k)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(m)
    x = x.bitwiseAND(m)
    x = x.bitwiseXOR(shift(x, 16))
    x = mul(x, 0x7FEB352D)
    x = x.bitwiseXOR(shift(x, 15))
    x = mul(x, 0x846CA68B)
    return x.bitwiseXOR(shift(x, 16))


def as_column(function: Callable, kind: str) -> Callable[[Column], Column]:
    """A function of one value as a function of a column, by Arrow batches; null for null. For the forms that have no
    expression of their own."""

    def of(c: Column) -> Column:
        to = to_arrow_type(_parse_datatype_string(kind))

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in batches:
                yield pa.array([None if v is None else function(v) for v in column.to_pylist()], to)

        return F.arrow_udf(run, kind)(c)

    return of


def parse_as_col(c: Column, dtype: str) -> Column:
    """parse_as as an expression: null where a cell's text doesn't fit the type."""
    if dtype == "bool":
        return F.when(c == "true", True).when(c == "false", False)
    if dtype == "i32":
        return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("int"))
    return F.when(c.rlike(rf"\A{NUMBER}\z"), c.try_cast("double")) if dtype == "f64" else c


def split_list_col(c: Column) -> Column:
    """Items of a list divided by the first of | ; , that occurs in it; a list in brackets is for split_list."""
    t = F.trim(c)
    items = lambda sep: F.transform(F.split(t, f"[{sep}]"), lambda x: F.trim(x))
    return F.when(t == "", F.array().cast("array<string>")).when(F.contains(t, F.lit("|")), items("|")).when(F.contains(t, F.lit(";")), items(";")).otherwise(items(","))
