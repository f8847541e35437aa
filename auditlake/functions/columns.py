
from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells that mean "no number", in tables and in timing summaries.
NO_NUMBER = ["", "NA", "N/A", "-", "--"]
NO_NUMBER_TIMING = ["NA", "N/A", "INF", "-INF"]


_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEYOND_ASCII = r"[^\x00-\x7f]"


def lower(text: Column | str) -> Column:
    """F.lower, by letter where all is ASCII: the rules of languages are dear to ask."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(_BEYOND_ASCII), F.lower(text)).otherwise(F.translate(text, _CAPITALS, _SMALL))


def upper(text: Column | str) -> Column:
    """F.upper, in the same way."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(_BEYOND_ASCII), F.upper(text)).otherwise(F.translate(text, _SMALL, _CAPITALS))


def initcap(text: Column) -> Column:
    """F.initcap of a text in lower case, in the same way where it is one word of letters."""
    return F.when(text.rlike("^[a-z]+$"), F.concat(F.translate(F.left(text, F.lit(1)), _SMALL, _CAPITALS), F.substring(text, 2, 1 << 20))).otherwise(F.initcap(text))


def to_float(value: Column) -> Column:
    """percent signs and commas go, then leading <, >, ~; what is no number is null."""
    text = F.trim(F.regexp_replace(value, "[%,]", ""))
    bare = F.regexp_replace(text, r"^[<>~]+", "")
    return F.when(upper(text).isin(NO_NUMBER), None).otherwise(bare.try_cast("double"))


def to_float_timing(value: Column) -> Column:
    """no sign handling; infinities are null too."""
    text = F.trim(value)
    return F.when(upper(text).isin(NO_NUMBER_TIMING), None).otherwise(text.try_cast("double"))


def to_int(value: Column) -> Column:
    """through a double, towards zero."""
    return to_float(value).try_cast("bigint")


def normalise_column(name: Column) -> Column:
    """report headers as column keys."""
    plain = F.regexp_replace(name, r"\((ns|MHz)\)", "")
    return lower(F.btrim(F.regexp_replace(plain, "[^0-9A-Za-z]+", "_"), F.lit("_")))


def severity_of(blocks_bringup: Column, blocks_signoff: Column, notable: Column | None = None) -> Column:
    """severity follows from what a finding blocks; it is never assigned."""
    mild = F.when(F.lit(True) if notable is None else notable, "WARNING").otherwise("INFO")
    return F.when(blocks_bringup, "BLOCKER").when(blocks_signoff, "CRITICAL").otherwise(mild)


def severity_rank(severity: Column) -> Column:
    """0 for the worst. Severities never sort as text."""
    order = ["BLOCKER", "CRITICAL", "WARNING", "INFO"]
    return F.coalesce(*(F.when(severity == s, i) for i, s in enumerate(order)), F.lit(len(order)))


def strip_comment(line: Column) -> Column:
    """// or # at the start or after white space, to the end of the line."""
    return F.regexp_replace(line, r"(^|\s)(//|#).*$", "$1")


def strip_comment_lines(text: Column) -> Column:
    """F10 of every line of a text whose lines end in LF."""
    return F.regexp_replace(text, r"(?m)(^|\s)(//|#).*$", "$1")


def strip_hdl_comments(text: Column, verilog: bool = True) -> Column:
    if verilog:
        return F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", " "), r"(?s)/\*.*?\*/", " ")
    return F.regexp_replace(text, r"--[^\n]*", " ")


def stem(path: Column) -> Column:
    """last part of a path, less its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def shorten(text: Column, width: int = 58) -> Column:
    """the tail of a long name."""
    return F.when(F.length(text) > width, F.concat(F.lit("..."), F.right(text, F.lit(width - 3)))).otherwise(text)


def mask_tokens(text: Column) -> Column:
    """F16: words with a slash or backslash, and words with a numbered index, are names, not layout: the whole word goes."""
    words = F.regexp_extract_all(text, F.lit(r"\S+|\s+"), F.lit(0))
    named = lambda w: w.contains("/") | w.contains("\\") | w.rlike(r".\[[0-9]+\]")
    return F.array_join(F.transform(words, lambda w: F.when(named(w), "<name>").otherwise(w)), "")


def porcelain_path(line: Column) -> Column:
    """the path of a status line; of a rename its destination; quotes off."""
    path = F.substring(line, 4, 1 << 20)
    target = F.when(path.contains(" -> "), F.substring_index(path, " -> ", -1)).otherwise(path)
    return F.btrim(target, F.lit('"'))


def file_stamp(timestamp: Column) -> Column:
    """an ISO timestamp as part of a file name."""
    return F.translate(timestamp, ":-T", "")


def glob_regex(pattern: str) -> str:
    """*, ? and [..] as a regular expression over a whole path; * crosses slashes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif end > 0:
            inner = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = end
        else:
            out.append(c if c.isalnum() or c in "_/ " else "\\" + c)
        i += 1
    return "^" + "".join(out) + "$"


def banner(status: Column, bringup_ok: Column, signoff_ok: Column, warnings: Column, waived: Column) -> Column:
    """the first reason that holds. bringup_ok null: there is no verdict."""
    return (
        F.when(bringup_ok.isNull(), F.when(status == 0, "WARN").otherwise("FAIL"))
        .when(~bringup_ok, "FAIL")
        .when(status != 0, "FAIL")
        .when(~signoff_ok, "WARN")
        .when((warnings > 0) | (waived > 0), "WARN")
        .otherwise("PASS")
    )


def fold_path(path: Column) -> Column:
    """a path without empty, . and .. parts; .. at the root of an absolute path stays there."""
    absolute = F.startswith(path, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        inside = (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        up = F.when(inside, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(F.lit(".."))))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    folded = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    whole = let(folded, lambda f: F.when(absolute, F.concat(F.lit("/"), f)).when(f == "", ".").otherwise(f))
    # A path without such parts is as it is.
    return F.when(path.rlike(r"^$|//|/$|(?:^|/)\.\.?(?:/|$)"), whole).otherwise(path)


def resolve_path(entry: Column, owner: Column) -> Column:
    """an entry of a list, relative to the folder of the list that names it."""
    folder = F.regexp_replace(owner, "[^/]*$", "")
    return let(F.when(F.startswith(entry, F.lit("/")), entry).otherwise(F.concat(folder, entry)), fold_path)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def number_text(x: Column) -> Column:
    """A double in the fewest digits that give it back: plain from 0.0001 to below 10^16, else with an exponent of two
    digits at least; a whole number keeps ".0"."""

    def digits_of(text: Column) -> Column:
        """Digits without zeros at either end, and how many of them stand before the point."""
        mantissa, power = F.substring_index(text, "E", 1), F.when(F.contains(text, F.lit("E")), F.substring_index(text, "E", -1).cast("int")).otherwise(0)
        whole = F.substring_index(mantissa, ".", 1)
        every = F.concat(whole, F.substring_index(mantissa, ".", -1))
        bare = F.ltrim(every, F.lit("0"))
        return F.struct(F.rtrim(bare, F.lit("0")).alias("digits"), (F.length(whole) + power - F.length(every) + F.length(bare)).alias("point"))

    def shorter(d: Column) -> Column:
        """The runtime may print a digit more than it takes: the two neighbours with one less are tried."""
        n = F.length(d["digits"]) - 1
        low = F.left(d["digits"], n)
        high = (low.cast("decimal(20,0)") + 1).cast("string")
        fits = lambda t: (n > 0) & (F.concat(t, F.lit("E"), (d["point"] - n).cast("string")).try_cast("double") == F.abs(x))
        as_digits = lambda t: F.struct(F.rtrim(t, F.lit("0")).alias("digits"), (d["point"] - n + F.length(t)).alias("point"))
        up = F.right(d["digits"], F.lit(1)) >= "5"
        return F.when(up & fits(high), as_digits(high)).when(fits(low), as_digits(low)).when(fits(high), as_digits(high)).otherwise(d)

    def laid_out(d: Column) -> Column:
        digits, point = d["digits"], d["point"]
        n = F.length(digits)
        zeros = lambda k: F.repeat(F.lit("0"), k)
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise("")
        power = F.when(F.abs(point - 1) < 10, F.concat(F.lit("0"), F.abs(point - 1).cast("string"))).otherwise(F.abs(point - 1).cast("string"))
        return (
            F.when(digits == "", "0.0")
            .when((point > 16) | (point < -3), F.concat(F.left(digits, F.lit(1)), tail, F.when(point < 1, "e-").otherwise("e+"), power))
            .when(point <= 0, F.concat(F.lit("0."), zeros(-point), digits))
            .when(point >= n, F.concat(digits, zeros(point - n), F.lit(".0")))
            .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
        )

    text = F.abs(x).cast("string")
    # No two decimals of 15 digits or fewer are one double, so such a text is the shortest; without an exponent it stands as it is.
    short = (F.length(text) <= 16) & ~F.contains(text, F.lit("E"))
    sign = F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise("")
    plain = F.concat(sign, let(digits_of(text), lambda d: let(shorter(d), laid_out)))
    return F.when(F.isnan(x), "NaN").when(short | (text == "Infinity"), x.cast("string")).otherwise(plain)


def fixed_digits(x: Column, digits: int) -> Column:
    """A double with so many digits after the point, rounded by its exact binary value, an exact half to the even digit.

    The runtime rounds the shortest decimal half up, which differs only where that decimal ends in a five right behind
    the last digit: there x = m * 2^-t is compared with it in whole numbers. From 10^15 on the runtime's own text stands.
    """
    size = F.abs(x)
    near = size.cast(f"decimal(38,{digits + 1})")
    scaled = (near * F.lit(10 ** (digits + 1))).cast("decimal(38,0)")
    half = (near.cast("double") == size) & (scaled % 10 == 5)
    t = F.greatest(F.lit(0), 52 - F.floor(F.log2(size))).cast("int")
    m = (size * F.pow(F.lit(2.0), t)).cast("bigint")
    two_to = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), n).cast("decimal(19,0)")
    power = two_to((t / 2).cast("int")) * two_to(t - (t / 2).cast("int"))
    exact, tie = m.cast("decimal(19,0)") * F.lit(10 ** (digits + 1)).cast("decimal(10,0)"), scaled.cast("decimal(19,0)") * power.cast("decimal(19,0)")
    low = (scaled - 5) / 10
    up = (exact > tie) | ((exact == tie) & (low.cast("decimal(38,0)") % 2 == 1))
    whole = F.when(half, low.cast("decimal(38,0)") + F.when(up, 1).otherwise(0)).otherwise((size.cast(f"decimal(38,{digits})") * F.lit(10**digits)).cast("decimal(38,0)"))
    text = F.lpad(whole.cast("string"), F.greatest(F.length(whole.cast("string")), F.lit(digits + 1)), F.lit("0"))
    cut = F.length(text) - digits
    plain = F.concat(F.substring(text, F.lit(1), cut), F.lit("."), F.substring(text, cut + 1, F.lit(digits))) if digits else text
    signed = F.concat(F.when(F.startswith(x.cast("string"), F.lit("-")), "-").otherwise(""), plain)
    # A text of 15 digits at most, with no more of them after the point than are asked for, is filled up with zeros.
    short, point = x.cast("string"), F.instr(x.cast("string"), ".")
    filled = (point > 0) & (F.length(short) - point <= digits) & (F.length(short) <= 16) & ~F.contains(short, F.lit("E"))
    return F.when(filled, F.rpad(short, point + digits, F.lit("0"))).when(size < 1e15, signed).when(x.isNotNull(), F.format_string(f"%.{digits}f", x))


def json_string(text: Column) -> Column:
    """A string as JSON: quotes, backslashes and control characters are escaped, everything else stands as it is."""
    marks = [c for x in [*map(chr, range(32)), '"', "\\"] for c in (F.lit(x), F.lit(json.dumps(x)[1:-1]))]
    escaped = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(F.create_map(*marks), c), c)), "")
    return F.concat(F.lit('"'), F.when(text.rlike(r'[\x00-\x1f"\\]'), escaped).otherwise(text), F.lit('"'))


def canonical_json(value: Column, kind: T.DataType) -> Column:
    """F8, H4: a value of any type as JSON text: keys sorted, nulls kept, ", " and ": " between, doubles as number_text."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ": "), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(value, lambda v: canonical_json(v, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(json_string(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        by_key = F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        text = F.concat(F.lit("{"), F.array_join(F.transform(by_key, entry), ", "), F.lit("}"))
    elif isinstance(kind, T.StringType):
        text = json_string(value)
    elif isinstance(kind, T.FractionalType):
        text = number_text(value.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = value.cast("string")
    else:
        text = F.lit("null") if isinstance(kind, T.NullType) else json_string(value.cast("string"))
    return F.coalesce(F.when(value.isNotNull(), text), F.lit("null"))


def evidence_digest(rule: Column, evidence: Column) -> Column:
    """F8: the first 12 hex digits of the sha256 of a finding's evidence, already canonical JSON, and id."""
    return F.left(F.sha2(F.concat(F.lit('{"evidence": '), evidence, F.lit(', "id": '), json_string(rule), F.lit("}")), 256), F.lit(12))


def variant_text(value: Column) -> Column:
    """A VARIANT as the text that another value is held against: strings as they are, whole numbers in digits,
    other numbers as number_text, True, False and None by name, lists and objects as compact JSON."""
    return F.when(value.isNotNull(), let(F.schema_of_variant(value), lambda kind: text_of_kind(value, kind)))


def text_of_kind(value: Column, kind: Column) -> Column:
    """variant_text of a VARIANT whose schema_of_variant is known and bound."""
    number = kind.rlike("^(DECIMAL|DOUBLE|FLOAT)") & ~kind.rlike(r"^DECIMAL\((19|[23]\d),0\)$")
    text = value.cast("string")
    return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(text)).when(number, let(text.try_cast("double"), number_text)).otherwise(text)


def ip_spec(name: Column) -> Column:
    """depth x width of a memory named after its shape, else null."""
    pattern = r"^blk_mem_gen_(\d+)x(\d+)$"
    return F.when(name.rlike(pattern), F.regexp_replace(name, pattern, "$1x$2"))


def has_prefix(rule: Column, prefixes: list[str]) -> Column:
    """An id that starts with any of the prefixes."""
    return F.greatest(F.lit(False), *(F.startswith(rule, F.lit(p)) for p in prefixes))


#: Operating systems and the versions of them that the tools support.
SUPPORTED_OS = {"rhel": ["8", "9"], "centos": ["8", "9"], "rocky": ["8", "9"], "almalinux": ["8", "9"], "ubuntu": ["20.04", "22.04"], "sles": ["15"], "opensuse-leap": ["15"]}


def os_supported(identifier: Column, version: Column) -> Column:
    """A supported version or a minor one of it; an unknown system is not, and no name is not known."""
    name, number = lower(F.coalesce(identifier, F.lit(""))), F.coalesce(version, F.lit(""))
    fits = lambda v: (number == v) | F.startswith(number, F.lit(v + "."))
    known = F.coalesce(*(F.when(name == n, F.greatest(F.lit(False), *map(fits, versions))) for n, versions in SUPPORTED_OS.items()))
    return F.when(name != "", F.coalesce(known, F.lit(False)))


def project_path(raw: Column, project: Column) -> Column:
    """a path of a project file, its two variables replaced, relative to the project's folder."""
    folder = F.regexp_replace(project, "/[^/]*$", "")
    expanded = F.replace(F.replace(raw, F.lit("$PSRCDIR"), F.concat(folder, F.lit("/"), stem(project), F.lit(".srcs"))), F.lit("$PPRDIR"), folder)
    return resolve_path(expanded, project)
