"""Parsers of whole texts, a text a row: its lines are told apart in Arrow columns, a batch of texts at once, so no line is
ever a row of Spark's, dealt, sorted or written. They tell the same as the parsers over lines of tables and reports.

In a line \\s is a blank or a tab, as all other white space of either kind of pattern ends lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.columns import NO_NUMBER, NO_NUMBER_TIMING
from auditlake.sources.reports import CLASSIFICATIONS, RESOURCES

#: As lines.LINE_BREAK, for the other kind of patterns.
_OTHER_BREAK = r"[\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_BREAK = r"\r\n|" + _OTHER_BREAK
#: Bytes of texts whose lines are held at a time; a longer text is held alone.
SLICE_BYTES = 4 << 20


@dataclass
class Lines:
    """The lines of some texts in order: value, file (the text's place), ln from 1; first and n by text."""

    value: pa.Array
    file: np.ndarray
    ln: np.ndarray
    first: np.ndarray
    n: np.ndarray

    def take(self, where: np.ndarray) -> pa.Array:
        return self.value.take(pa.array(where))

    @cached_property
    def bare(self) -> pa.Array:
        """The lines from their first letter on."""
        return pc.ascii_ltrim(self.value, " \t")

    @cached_property
    def indent(self) -> np.ndarray:
        return np.diff(_offsets(self.value)) - np.diff(_offsets(self.bare))

    @cached_property
    def letter(self) -> np.ndarray:
        """The first byte of each line that is no blank, 0 where there is none."""
        at = _offsets(self.bare)
        data = np.frombuffer(self.bare.buffers()[2] or b"", np.uint8)
        return np.where(np.diff(at) > 0, data[np.minimum(at[:-1], len(data) - 1)], 0) if len(data) else np.zeros(len(self.bare), np.uint8)

    def begin(self, text: str) -> np.ndarray:
        """Lines that begin with a text, blanks before it aside, but no tabs."""
        some = np.flatnonzero(_bits(pc.starts_with(self.bare, text)))
        return some[_bits(pc.starts_with(pc.ascii_ltrim(self.take(some), " "), text))]


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)


def _plain(texts: pa.Array) -> bool:
    """Whether all bytes of texts are letters, tabs and LF, as most are."""
    at = _offsets(texts)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return not (((data < 32) & (data != 10) & (data != 9)) | (data > 126)).any()


def _bits(found: pa.Array) -> np.ndarray:
    return found.to_numpy(zero_copy_only=False)


def split_lines(texts: pa.Array) -> Lines:
    """As lines.lines_of: a final break opens no line, a text that is empty or null has none."""
    if not _plain(texts):
        other = pc.fill_null(pc.match_substring_regex(texts, _OTHER_BREAK), False)
        texts = pc.if_else(other, pc.replace_substring_regex(texts, _BREAK, "\n"), texts)
    parts = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    value, ends = parts.flatten(), np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))
    n = np.diff(ends, prepend=0)
    # The last part is empty where the text is, or ends in a break.
    drop = _bits(pc.equal(value.take(pa.array(ends - 1)), "")) if len(ends) else np.zeros(0, bool)
    if drop.any():
        keep = np.ones(len(value), bool)
        keep[ends[drop] - 1] = False
        value, n = value.filter(pa.array(keep)), n - drop
    first = np.cumsum(n) - n
    file = np.repeat(np.arange(len(n)), n)
    return Lines(value, file, np.arange(len(file)) - first[file] + 1, first, n)


def slices(texts: pa.Array) -> Iterator[pa.Array]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield texts.slice(at, to - at)
        at = to


def by_text(read: Callable[[Lines], pa.Array], kind: str) -> Callable[[Column | str], Column]:
    """A column function from texts to what read tells of each, from the lines of some texts at a time."""

    def run(texts: pa.Array) -> pa.Array:
        found = [read(split_lines(some)) for some in slices(texts)] or [read(split_lines(texts))]
        return pa.concat_arrays(found)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kind)


def _number(text: pa.Array) -> pa.Array:
    """As columns.to_float_timing, of what the patterns below take for a number."""
    bare = pc.ascii_ltrim(text, "+")
    try:
        return pc.cast(bare, pa.float64())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else float(x) for x in bare.to_pylist()], pa.float64())


def _whole(text: pa.Array) -> pa.Array:
    """Digits as a bigint, null where they are too many."""
    try:
        return pc.cast(text, pa.int64())
    except pa.ArrowInvalid:
        return pa.array([None if x is None or int(x) >= 1 << 63 else int(x) for x in text.to_pylist()], pa.int64())


def _parts(text: pa.Array, pattern: str, *names: str) -> list[pa.Array]:
    found = pc.extract_regex(text, pattern)
    return [pc.struct_field(found, name) for name in names]


def _least(file: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The least value of each text, infinity where there is none."""
    out = np.full(n, np.inf)
    np.minimum.at(out, file, value)
    return out


def _first(file: np.ndarray, n: int) -> np.ndarray:
    """The place of each text's first entry, -1 where there is none; entries stand in order."""
    out = np.full(n, -1)
    out[file[::-1]] = np.arange(len(file))[::-1]
    return out


def _at(values: pa.Array, place: np.ndarray) -> pa.Array:
    return values.take(pa.array(place, mask=place < 0))


# --- timing ------------------------------------------------------------------------------------

_N = r"[-+]?\d+(?:\.\d+)?"
_SLACK = rf"^\s*Slack\s*\((?P<status>VIOLATED|MET)\)\s*:\s*(?P<slack>{_N})ns"
_LABEL = r"^\s{2,}[A-Z][A-Za-z ]*$"
_LEADING = rf"^\s*(?P<x>{_N})ns"
_DATA_PATH = rf"^\s*{_N}ns\s*\(logic\s+(?P<logic>{_N})ns\s*\((?P<logic_pct>{_N})%\)\s+route\s+(?P<route>{_N})ns\s*\((?P<route_pct>{_N})%\)\)"
_LEVELS = r"^\s*(?P<n>\d+)\s*(?:\((?P<detail>.*)\))?"
#: The columns of a path: kind, and where a field gives them, its label.
PATH_KINDS = {
    "pos": "bigint", "status": "string", "slack_ns": "double", "delay_kind": "string", "line_start": "int", "line_end": "int", "source": "string", "source_clock": "string", "destination": "string", "destination_clock": "string", "path_group": "string", "path_type": "string",
    "requirement_ns": "double", "data_path_delay_ns": "double", "logic_delay_ns": "double", "logic_pct": "double", "route_delay_ns": "double", "route_pct": "double", "logic_levels": "bigint", "logic_levels_detail": "string", "clock_skew_ns": "double", "clock_uncertainty_ns": "double",
}
_LABELS = {
    "source": "Source", "destination": "Destination", "path_group": "Path Group", "path_type": "Path Type", "requirement_ns": "Requirement", "data_path_delay_ns": "Data Path Delay", "logic_delay_ns": "Data Path Delay", "logic_pct": "Data Path Delay",
    "route_delay_ns": "Data Path Delay", "route_pct": "Data Path Delay", "logic_levels": "Logic Levels", "logic_levels_detail": "Logic Levels", "clock_skew_ns": "Clock Path Skew", "clock_uncertainty_ns": "Clock Uncertainty",
}
_OF_DATA_PATH = {"logic_delay_ns": "logic", "logic_pct": "logic_pct", "route_delay_ns": "route", "route_pct": "route_pct"}


def _paths(lines: Lines, asked: list[str]) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(file of each path, its columns): what tables.timing_paths says of them."""
    value, total = lines.value, len(lines.value)
    slack = lines.begin("Slack")
    status, slack_text = _parts(lines.take(slack), _SLACK, "status", "slack")
    sound = _bits(pc.is_valid(status))
    heads, status, slack_text = slack[sound], status.filter(pa.array(sound)), slack_text.filter(pa.array(sound))
    n = len(heads)
    opens = np.zeros(total, bool)
    opens[heads] = True
    block, file = np.cumsum(opens) - 1, lines.file[heads]
    paths_of = np.bincount(file, minlength=len(lines.n))
    base = np.cumsum(paths_of) - paths_of
    #: A line before its text's first path is of none.
    inside = (block >= 0) & (file[np.maximum(block, 0)] == lines.file) if n else np.zeros(total, bool)
    out = {"pos": pa.array(np.arange(n) - base[file], pa.int64()), "status": status, "slack_ns": _number(slack_text), "line_start": pa.array(lines.ln[heads], pa.int32())}
    if "line_end" in asked:
        last = np.empty(n, np.int64)
        last[:-1] = lines.ln[heads[1:]] - 1
        final = np.append(file[1:] != file[:-1], True)[:n]
        last[final] = lines.n[file[final]]
        out["line_end"] = pa.array(last, pa.int32())
    if "delay_kind" in asked:
        kind = np.zeros(total, np.int8)
        kind[lines.begin("Min Delay Paths")] = 2
        kind[lines.begin("Max Delay Paths")] = 1
        seen = np.maximum.accumulate(np.where(kind > 0, np.arange(total), -1))[heads]
        place = np.where(seen >= lines.first[file], kind[np.maximum(seen, 0)], 0) - 1 if n else np.zeros(0, int)
        out["delay_kind"] = _at(pa.array(["max", "min"]), place)
    # What stands before a line's first colon is its label, the rest its field.
    colon = np.flatnonzero(inside & (lines.indent >= 2) & (lines.letter >= ord("A")) & (lines.letter <= ord("Z")))
    colon = colon[_bits(pc.match_substring(lines.take(colon), ":"))]
    sides = pc.split_pattern(lines.take(colon), ":", max_splits=1).flatten()
    left, right = sides.take(pa.array(np.arange(0, len(sides), 2))), sides.take(pa.array(np.arange(1, len(sides), 2)))
    told = _bits(pc.match_substring_regex(left, _LABEL))
    pins = lines.begin("Location")
    pins = pins[_bits(pc.match_substring(lines.take(pins), "Delay type"))]
    empty = opens.copy()
    empty[pins] = True
    at = colon[told]
    label, field = pc.ascii_trim(left.filter(pa.array(told)), " \t"), pc.ascii_trim(right.filter(pa.array(told)), " \t")
    names = sorted({_LABELS[c] for c in asked if c in _LABELS} | {"Source", "Destination"})
    code = pc.fill_null(pc.index_in(label, pa.array(names)), -1).to_numpy(zero_copy_only=False)
    code = np.where(empty[at], -1, code)

    def last_of(name: str) -> pa.Array:
        mine = np.flatnonzero(code == names.index(name))
        place = np.full(n, -1)
        place[block[at[mine]]] = mine
        return _at(field, place)

    fields = {name: last_of(name) for name in sorted({_LABELS[c] for c in asked if c in _LABELS})}
    if "source_clock" in asked or "destination_clock" in asked:
        clocked = np.flatnonzero(_bits(pc.match_substring(value, "clocked by")) & inside)
        (clock,) = _parts(lines.take(clocked), r"clocked by\s+(?P<x>\S+)", "x")
        owner, nth = np.full(total, -2), np.full(total, -1)
        owner[at], nth[clocked] = code, np.arange(len(clocked))
        owner[empty] = -1
        of_use = np.flatnonzero((owner > -2) | (nth >= 0))
        # The first clock below a label is its own, if the line has no label itself.
        takes = np.flatnonzero((owner[of_use[1:]] == -2) & (owner[of_use[:-1]] > -2) & inside[of_use[1:]]) + 1
        for side in ("source", "destination"):
            mine = takes[owner[of_use[takes - 1]] == names.index(side.capitalize())]
            place = np.full(n, -1)
            place[block[of_use[mine]]] = nth[of_use[mine]]
            out[f"{side}_clock"] = _at(clock, place)
    parts: dict[str, pa.Array] = {}
    if wanted := [c for c in asked if c in _OF_DATA_PATH]:
        parts |= zip(wanted, map(_number, _parts(fields["Data Path Delay"], _DATA_PATH, *(_OF_DATA_PATH[c] for c in wanted))), strict=True)
    for c in asked:
        if c in ("requirement_ns", "data_path_delay_ns", "clock_skew_ns", "clock_uncertainty_ns"):
            parts[c] = _number(*_parts(fields[_LABELS[c]], _LEADING, "x"))
        elif c == "logic_levels":
            parts[c] = pc.cast(_number(*_parts(fields["Logic Levels"], _LEVELS, "n")), pa.int64(), safe=False)
        elif c == "logic_levels_detail":
            (detail,) = _parts(fields["Logic Levels"], _LEVELS, "detail")
            detail = pc.ascii_trim(detail, " ")
            parts[c] = pc.if_else(pc.equal(detail, ""), pa.scalar(None, pa.string()), detail)
        elif c in _LABELS and c not in parts:
            parts[c] = fields[_LABELS[c]]
    out |= parts
    return file, {c: out[c] for c in asked}


def timing_paths(asked: list[str]) -> Callable[[Column | str], Column]:
    """An array of the paths of a timing report, their columns in the order of asked."""

    def read(lines: Lines) -> pa.Array:
        file, columns = _paths(lines, asked)
        ends = np.concatenate([[0], np.cumsum(np.bincount(file, minlength=len(lines.n)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), list(columns)))

    return by_text(read, f"array<struct<{', '.join(f'{c}: {PATH_KINDS[c]}' for c in asked)}>>")


#: What timing_facts tells of a report: numbers of its design summary, checks, the verdict line, the period by the setup paths or the
#: clocks, what the worst setup path has, and the pairs of the banner in order.
_NUMBERS = ["wns", "whs", "wpws", "tns_total_endpoints"]
_CHECKS = {"no_clock": ["no_clock"], "loops": ["loops"], "latch_loops": ["latch_loops"], "unconstrained": ["unconstrained_internal_endpoints"], "no_io_delay": ["no_input_delay", "no_output_delay"]}
FACT_KINDS = dict.fromkeys(_NUMBERS, "double") | dict.fromkeys(_CHECKS, "bigint") | {
    "constraints_met": "boolean", "period": "double", "route_pct": "double", "logic_levels": "bigint", "banner": "array<struct<key: string, value: string>>",
}
_CLOCK = rf"^\s*\S+\s+\{{[^}}]*\}}\s+(?P<period>{_N})\s+{_N}\s*$"
_BANNER = r"^\|\s*(?P<key>[^:|]+?)\s*:\s*(?P<value>.*?)\s*\|?\s*$"


@lru_cache(maxsize=1024)
def _layout(head: str, ruler: str) -> tuple[list[tuple[int, int]], list[str]]:
    """Places of a ruler's columns, and their names as columns.normalise_column has them."""
    spans = [m.span() for m in re.finditer("-+", ruler)]
    names = [re.sub(r"\((ns|MHz)\)", "", head[a:b].strip(" ")) for a, b in spans]
    return spans, [re.sub("[^0-9A-Za-z]+", "_", name).strip("_").lower() for name in names]


_PLAIN_NUMBER = re.compile(r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?[dDfF]?")
_SPECIAL = {"infinity": math.inf, "+infinity": math.inf, "-infinity": -math.inf, "+inf": math.inf, "nan": math.nan}


def _timing_number(text: str) -> float | None:
    """columns.to_float_timing."""
    bare = text.strip(" ")
    if _PLAIN_NUMBER.fullmatch(bare):
        return float(bare.rstrip("dDfF"))
    return None if bare.upper() in NO_NUMBER_TIMING else _SPECIAL.get(bare.lower())


def _summary(lines: Lines) -> list:
    """reports.design_summary: whether there is a WNS(ns) row, and the numbers of the first that the rules ask for."""
    some = np.flatnonzero(_bits(pc.starts_with(lines.bare, "WNS(ns)")))
    some = some[lines.ln[some] + 2 <= lines.n[lines.file[some]]]
    some = some[_bits(pc.match_substring_regex(lines.take(some + 1), r"^\s*-{2,}(?:\s+-{2,})+\s*$"))]
    first = _first(lines.file[some], len(lines.n))
    at = some[first[first >= 0]] if len(some) else some
    head, ruler, numbers = (lines.take(at + k) for k in range(3))
    layouts = pc.binary_join_element_wise(head, ruler, "\n").dictionary_encode()
    codes = layouts.indices.to_numpy(zero_copy_only=False)
    found = [np.full(len(at), np.nan) for _ in _NUMBERS]
    there = [np.zeros(len(at), bool) for _ in _NUMBERS]
    for code, layout in enumerate(layouts.dictionary.to_pylist()):
        mine = np.flatnonzero(codes == code)
        for told, some_told, column in zip(found, there, _summary_columns(*_layout(*layout.split("\n")), numbers.take(pa.array(mine))), strict=True):
            told[mine], some_told[mine] = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False), _bits(pc.is_valid(column))
    place = np.where(first >= 0, np.cumsum(first >= 0) - 1, -1)
    return [first >= 0, *(_at(pa.array(told, pa.float64(), mask=~some_told), place) for told, some_told in zip(found, there, strict=True))]


def _summary_columns(spans: list[tuple[int, int]], names: list[str], numbers: pa.Array) -> list[pa.Array]:
    """_NUMBERS of lines under one layout: all at once where they have as many words as it has columns, and plain numbers in these."""
    words = pc.ascii_split_whitespace(pc.ascii_trim(numbers, " "))
    usual = all(names.count(name) < 2 for name in _NUMBERS) and pc.all(pc.equal(pc.list_value_length(words), len(spans))).as_py() and not pc.any(pc.match_substring(numbers, "\t")).as_py()
    columns = [pc.list_element(words, names.index(name)) if name in names else pa.nulls(len(numbers), pa.string()) for name in _NUMBERS] if usual else []
    if usual and all(pc.all(pc.match_substring_regex(c, rf"^{_N}$")).as_py() in (True, None) for c in columns):
        return [_number(c) for c in columns]
    found: list[list[float | None]] = [[] for _ in _NUMBERS]
    for line in numbers.to_pylist():
        parts = re.split(r"[ \t]+", line.strip(" "))
        values = parts if len(parts) == len(spans) else [line[a:b] for a, b in spans]
        for told, wanted in zip(found, _NUMBERS, strict=True):
            here = [x for x in (_timing_number(v) for name, v in zip(names, values, strict=True) if name == wanted) if x is not None]
            told.append(max(here, default=None))
    return [pa.array(told, pa.float64()) for told in found]


def _checks(lines: Lines) -> list[pa.Array]:
    """tables.check_items: the greatest count of each check that the rules ask for."""
    some = np.flatnonzero((lines.letter >= ord("0")) & (lines.letter <= ord("9")))
    name, text = _parts(lines.take(some), r"^\s*\d+\.\s+checking\s+(?P<name>\w+)\s*\((?P<n>\d+)\)", "name", "n")
    count = _whole(text)
    sound = _bits(pc.is_valid(count))
    file, name, count = lines.file[some[sound]], name.filter(pa.array(sound)), count.filter(pa.array(sound)).to_numpy(zero_copy_only=False)

    def most(check: str) -> tuple[np.ndarray, np.ndarray]:
        mine = _bits(pc.equal(name, check)) if len(name) else np.zeros(0, bool)
        out = np.full(len(lines.n), -1)
        np.maximum.at(out, file[mine], count[mine])
        return np.maximum(out, 0), out >= 0

    out = []
    for checks in _CHECKS.values():
        found = [most(check) for check in checks]
        out.append(pa.array(sum(n for n, _ in found), pa.int64(), mask=~np.logical_or.reduce([there for _, there in found])))
    return out


def _shortest(lines: Lines) -> pa.Array:
    """reports.clocks: the least period, but for zero, of the first Clock Summary section."""
    bars = np.flatnonzero((lines.letter == ord("|")) & (lines.indent == 0))
    bars = bars[_bits(pc.match_substring_regex(lines.take(bars), r"^\|\s*[^-\s]"))]
    titled = np.flatnonzero(_bits(pc.match_substring_regex(pc.utf8_lower(lines.take(bars)), r"^\|\s*clock summary")))
    first = _first(lines.file[bars[titled]], len(lines.n))
    mine = np.where(first < 0, -1, titled[first]) if len(titled) else np.full(len(lines.n), -1)
    # A section goes on to the next bar, or the end of its text.
    ends = np.append(bars, len(lines.value))
    where = np.flatnonzero(mine >= 0)
    opens, closes = bars[mine[where]], np.minimum(ends[mine[where] + 1], (lines.first + lines.n)[where])
    size = closes - opens
    braced = np.repeat(opens - (np.cumsum(size) - size), size) + np.arange(size.sum())
    (period,) = _parts(lines.take(braced), _CLOCK, "period")
    period = pc.fill_null(_number(period), 0.0).to_numpy(zero_copy_only=False)
    least = _least(lines.file[braced[period != 0]], period[period != 0], len(lines.n))
    return pa.array(least, pa.float64(), mask=np.isinf(least))


def _met(lines: Lines) -> pa.Array:
    """reports.constraints_met: the first verdict line."""
    met, unmet = lines.begin("All user specified timing constraints are met"), lines.begin("Timing constraints are not met")
    some = np.sort(np.concatenate([met, unmet]))
    return _at(pa.array(np.isin(some, met), pa.bool_()), _first(lines.file[some], len(lines.n)))


def _banner(lines: Lines) -> pa.Array:
    """tables.banner_fields: pairs of the first 40 lines, in order."""
    some = np.flatnonzero((lines.letter == ord("|")) & (lines.indent == 0) & (lines.ln <= 40))
    key, value = _parts(lines.take(some), _BANNER, "key", "value")
    sound = _bits(pc.is_valid(key))
    ends = np.concatenate([[0], np.cumsum(np.bincount(lines.file[some[sound]], minlength=len(lines.n)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([key.filter(pa.array(sound)), value.filter(pa.array(sound))], ["key", "value"]))


def _setup(lines: Lines) -> list[pa.Array]:
    """rules._asked and rules._worst: the first requirement but for zero, and what the rules ask of the path of least slack."""
    file, columns = _paths(lines, ["slack_ns", "delay_kind", "requirement_ns", "route_pct", "logic_levels"])
    slack, asked = columns["slack_ns"].to_numpy(zero_copy_only=False), pc.fill_null(columns["requirement_ns"], 0.0).to_numpy(zero_copy_only=False)
    setup = _bits(pc.fill_null(pc.equal(columns["delay_kind"], "max"), False)) if len(file) else np.zeros(0, bool)
    own = np.flatnonzero(setup & (asked != 0))
    first = _first(file[own], len(lines.n))
    requirement = _at(columns["requirement_ns"].take(pa.array(own)), first)
    mine = np.flatnonzero(setup)
    mine = mine[slack[mine] == _least(file[mine], slack[mine], len(lines.n))[file[mine]]]
    worst = _first(file[mine], len(lines.n))
    return [requirement, *(_at(columns[c].take(pa.array(mine)), worst) for c in ("route_pct", "logic_levels"))]


def texts_facts(lines: Lines) -> pa.Array:
    """FACT_KINDS of timing reports, as arrays of one; a report without summary has none."""
    there, *numbers = _summary(lines)
    asked, *worst = _setup(lines)
    facts = [*numbers, *_checks(lines), _met(lines), pc.coalesce(asked, _shortest(lines)), *worst, _banner(lines)]
    ends = np.concatenate([[0], np.cumsum(there)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([c.filter(pa.array(there)) for c in facts], list(FACT_KINDS)))


def timing_facts(text: Column | str) -> Column:
    """texts_facts of a column."""
    return by_text(texts_facts, f"array<struct<{', '.join(f'{c}: {k}' for c, k in FACT_KINDS.items())}>>")(text)


# --- tables and blocks -------------------------------------------------------------------------

_EDGE, _DASHES = re.compile(r"\+[-+=]+\+"), re.compile(r"-{2,}(?:[ \t]+-{2,})+")
_ODD, _ODD_ASCII = re.compile("\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), "\r\x0b\x0c\x1c\x1d\x1e"
_HEAD = re.compile(r"[ \t]*([A-Z][A-Z0-9_]*-[0-9]+)#[0-9]+[ \t]+(Error|Critical Warning|Warning|Advisory)[ \t]*")
_DECLARED = re.compile(r"[ \t]*Violations found:[ \t]*([0-9]+)")


@dataclass
class Table:
    """A table of either kind: places of its columns by normalised name, and its rows with their numbers."""

    line_start: int
    names: dict[str, int] | None
    rows: list[tuple[int, list[str]]]

    def cell(self, cells: list[str], name: str) -> str | None:
        """As tables.cell."""
        place = self.names.get(name)
        return None if place is None else cells[place] if place < len(cells) else ""


def lines_in(text: str) -> list[str]:
    """The lines of one text, as split_lines tells them."""
    lines = (_ODD.sub("\n", text) if not text.isascii() or any(c in text for c in _ODD_ASCII) else text).split("\n")
    if lines[-1] == "":
        lines.pop()
    return lines


@lru_cache(maxsize=4096)
def _columns(header: tuple[str, ...]) -> dict[str, int]:
    names = [re.sub("[^0-9A-Za-z]+", "_", re.sub(r"\((ns|MHz)\)", "", name)).strip("_").lower() for name in header]
    return {name: i for i, name in reversed(list(enumerate(names)))}


@lru_cache(maxsize=4096)
def _spans(ruler: str) -> list[tuple[int, int | None]]:
    spans = [m.span() for m in re.finditer("-+", ruler)]
    return [*spans[:-1], (spans[-1][0], None)]


def tables_of(lines: list[str], ruled: bool = True) -> list[Table]:
    """The tables of a text that have rows, as tables.table_rows tells them; without ruled, pipe tables alone."""
    out: list[Table] = []
    box, under, spans, was_boxed, above = None, None, [], False, None
    for i, value in enumerate(lines):
        bare = value.strip(" \t")
        first = bare[:1]
        boxed = False
        if first == "|" and len(bare) > 1 and bare[-1] == "|":
            boxed = True
            cells = [c.strip(" ") for c in bare[1:-1].split("|")]
            if not was_boxed:
                box = Table(i + 1, None, [])
            if box.names is None:
                box.names = _columns(tuple(cells))
            else:
                if not box.rows:
                    out.append(box)
                box.rows.append((len(box.rows) + 1, cells))
        elif first == "+" and _EDGE.fullmatch(bare):
            boxed = True
            if not was_boxed:
                box = Table(i + 1, None, [])
            under = None
        if ruled and first == "-" and _DASHES.fullmatch(bare):
            under, spans = None, _spans(value)
            if above is not None and above.strip(" ") != "":
                header = tuple(above[a:b].strip(" ") for a, b in spans)
                if any(header):
                    under = Table(i, _columns(header), [])
        elif under is not None:
            if value.strip(" ") == "":
                under = None
            else:
                if not under.rows:
                    out.append(under)
                under.rows.append((i + 1 - under.line_start - 1, [value[a:b].strip(" ") for a, b in spans]))
        was_boxed, above = boxed, value
    return out


def _chosen(tables: list[Table], *wanted: list[str]) -> list[tuple[Table, list[str]]]:
    """(table, cells) of the first table, as tables.first_table has it, by row_no."""
    for names in wanted:
        if some := [t for t in tables if all(n in t.names for n in names)]:
            first = min(t.line_start for t in some)
            some = [t for t in some if t.line_start == first]
            rows = [(n, t, cells) for t in some for n, cells in t.rows]
            return [r[1:] for r in (rows if len(some) == 1 else sorted(rows, key=lambda x: x[0]))]
    return []


def _text(table: Table, cells: list[str], name: str) -> str:
    """As tables.cell, without null; cells are trimmed."""
    place = table.names.get(name, -1)
    return cells[place] if 0 <= place < len(cells) else ""


def number_of(text: str | None) -> float | None:
    """columns.to_float."""
    if text is None:
        return None
    text = text.replace("%", "").replace(",", "").strip(" ")
    if text.upper() in NO_NUMBER:
        return None
    bare = text.lstrip("<>~").strip()
    return float(bare.rstrip("dDfF")) if _PLAIN_NUMBER.fullmatch(bare) else (_SPECIAL | {"inf": math.inf, "-inf": -math.inf}).get(bare.lower())


def whole_of(text: str | None) -> int | None:
    """columns.to_int."""
    x = number_of(text)
    return None if x is None or math.isnan(x) or not -(2.0**63) <= x < 2.0**63 else int(x)


def utilization_of(lines: list[str]) -> list[tuple]:
    """(key, util_percent) of the first sound row of each resource."""
    found: dict[str, float] = {}
    for table in tables_of(lines, ruled=False):
        for _, cells in table.rows:
            key = RESOURCES.get((table.cell(cells, "site_type") or "").strip(" ").lower())
            if key is None or key in found:
                continue
            used, percent = whole_of(table.cell(cells, "used")), number_of(table.cell(cells, "util"))
            if percent is None and used is not None and (available := whole_of(table.cell(cells, "available"))):
                percent = 100.0 * used / available
            if used is not None and percent is not None:
                found[key] = percent
    return list(found.items())


def rules_of(lines: list[str]) -> list[tuple]:
    """(rule, n, severity, title, detail) of a report's violations by rule, as rules.group_rules has them."""
    blocks: list[tuple[str, str, list[str]]] = []
    for value in lines:
        bare = value.strip(" ")
        if bare == "":
            continue
        if "#" in bare and (head := _HEAD.fullmatch(value)):
            blocks.append((head[1], head[2], []))
        elif blocks:
            blocks[-1][2].append(bare)
    found: dict[str, list] = {}
    for rule, severity, parts in blocks:
        if rule in found:
            found[rule][1] += 1
        else:
            detail = " ".join(v for v in parts[1:] if not v.startswith("Related violations:"))
            found[rule] = [rule, 1, severity, parts[0] if parts else "", detail[:400]]
    return [tuple(r) for r in found.values()]


def _crossings(tables: list[Table]) -> list[tuple[Table, list[str], str, str]]:
    """(table, cells, severity, id) of the crossings of the detail table."""
    rows = ((t, cells, _text(t, cells, "severity"), _text(t, cells, "id")) for t, cells in _chosen(tables, ["severity", "id", "description"], ["severity", "id"]))
    return [r for r in rows if r[2] != "" and r[3] != ""]


@lru_cache(maxsize=4096)
def _capital(text: str) -> str:
    """columns.initcap of columns.lower."""
    return " ".join(w[:1].upper() + w[1:] for w in text.lower().split(" "))


def crossings_of(lines: list[str]) -> list[tuple]:
    """(severity, crossing, n, description, pairs), as rules.cdc_facts has them."""
    found: dict[tuple[str, str], list] = {}
    for table, cells, severity, name in _crossings(tables_of(lines)):
        key = (_capital(severity), name)
        n, description, pairs = found.setdefault(key, [0, "", set()])
        source = _text(table, cells, "source_clock")
        if source != "":
            pairs.add(f"{source} -> {_text(table, cells, 'destination_clock')}")
        found[key][:2] = [n + 1, description or _text(table, cells, "description")]
    return [(*key, n, description, sorted(pairs)[:6]) for key, (n, description, pairs) in found.items()]


def crossing_counts_of(lines: list[str]) -> list[tuple]:
    """(severity, n), from the summary table if it has any, else counted."""
    tables = tables_of(lines)
    told = {}
    for table, cells in _chosen(tables, ["severity", "count"]):
        severity, n = _text(table, cells, "severity"), whole_of(table.cell(cells, "count"))
        if severity != "" and n is not None:
            told[severity] = n
    if not told:
        for _, _, severity, _ in _crossings(tables):
            told[severity] = told.get(severity, 0) + 1
    return list(told.items())


def clocks_of(lines: list[str], most: int = 10) -> list[tuple]:
    """(n_unsafe, n_partial, unsafe_pairs, partial_pairs) where there is any pair, as rules.clock_facts has them."""
    pairs: dict[str | None, list[str]] = {"unsafe": [], "partial": []}
    some = False
    for table, cells in _chosen(tables_of(lines), ["source_clock", "destination_clock"]):
        source, destination = _text(table, cells, "source_clock"), _text(table, cells, "destination_clock")
        if source == "" or destination == "":
            continue
        some = True
        text = next((c for name in CLASSIFICATIONS if (c := table.cell(cells, name)) is not None), "").strip(" ").lower()
        kind = "unsafe" if "unsafe" in text or "no common" in text else "partial" if "partial false path" in text else None
        if kind:
            pairs[kind].append(f"{source} -> {destination}")
    return [(*(len(p) for p in pairs.values()), *(p[:most] or None for p in pairs.values()))] if some else []


def rows_found(kind: str, lines: list[str]) -> int:
    """How many rows the parser of a kind makes of a report; a rule report that declares no violation is one."""
    if kind == "utilization":
        return len(utilization_of(lines))
    if kind == "cdc":
        tables = tables_of(lines)
        return len(_crossings(tables)) or len(crossing_counts_of(lines))
    return len(rules_of(lines)) or next((int(int(m[1]) == 0) for m in map(_DECLARED.match, lines) if m), 0)


#: What report_facts tells, of whatever kind of report: the columns that the rules of each kind read, null in rows of others.
REPORT_FACTS = {"key": "string", "util_percent": "double", "rule": "string", "severity": "string", "n": "bigint", "crossing": "string", "pairs": "array<string>"} | dict.fromkeys(["n_unsafe", "n_partial"], "bigint") | dict.fromkeys(["unsafe_pairs", "partial_pairs"], "array<string>") | {"kind": "string", "checked": "boolean"}
_ARROW = {"string": pa.string(), "double": pa.float64(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
_TIMING_FACTS = {c: k for c, k in FACT_KINDS.items() if c not in ("banner", "constraints_met")}
_TOLD = {
    "utilization": (utilization_of, ["key", "util_percent"]), "drc": (rules_of, ["rule", "n", "severity"]), "cdc": (crossings_of, ["severity", "crossing", "n", None, "pairs"]),
    "clock_interaction": (clocks_of, ["n_unsafe", "n_partial", "unsafe_pairs", "partial_pairs"]),
}


def report_facts(expected: list[str]) -> Callable[..., Column]:
    """An array of facts of one run from its texts of utilization, drc, cdc, clock and timing: source, and REPORT_FACTS and
    _TIMING_FACTS; of each expected kind a row of source coverage says whether there is a text that is not blank."""
    columns = ["source", *REPORT_FACTS, *_TIMING_FACTS]

    def run(utilization: pa.Array, drc: pa.Array, cdc: pa.Array, clock: pa.Array, timing: pa.Array) -> pa.Array:
        texts = dict(zip(_TOLD, (a.to_pylist() for a in (utilization, drc, cdc, clock)), strict=True))
        kinds, parts, owners = REPORT_FACTS | _TIMING_FACTS, [], []

        def add(source: str, owner: np.ndarray, told: dict[str, pa.Array]) -> None:
            """Rows of one source by the place of their texts; columns of others are null."""
            every = [pa.array([source] * len(owner), pa.string()), *(told[c] if c in told else pa.nulls(len(owner), _ARROW[k]) for c, k in kinds.items())]
            parts.append(pa.StructArray.from_arrays(every, columns))
            owners.append(owner)

        for source, (read, names) in _TOLD.items():
            found = [read(lines_in(text)) if text else [] for text in texts[source]]
            values = list(zip(*(row for rows in found for row in rows), strict=True)) or [()] * len(names)
            told = {c: pa.array(v, _ARROW[kinds[c]]) for c, v in zip(names, values, strict=False) if c}
            add(source, np.repeat(np.arange(len(found)), [len(rows) for rows in found]), told)
        for kind in expected:
            checked = [(text or "").strip(" \t\n\x0b\x0c\r") != "" for text in texts.get(kind, [None] * len(timing))]
            add("coverage", np.arange(len(timing)), {"kind": pa.array([kind] * len(timing), pa.string()), "checked": pa.array(checked, pa.bool_())})
        facts = pa.concat_arrays([texts_facts(split_lines(some)) for some in slices(timing)] or [texts_facts(split_lines(timing))])
        timed = facts.flatten()
        add("timing", np.repeat(np.arange(len(timing)), facts.value_lengths().to_numpy(zero_copy_only=False)), {c: pc.struct_field(timed, c) for c in _TIMING_FACTS})
        owner = np.concatenate(owners)
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(timing)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(parts).take(pa.array(np.argsort(owner, kind="stable"))))

    run.__annotations__ = dict.fromkeys(["utilization", "drc", "cdc", "clock", "timing", "return"], pa.Array)
    return F.arrow_udf(run, f"array<struct<source: string, {', '.join(f'{c}: {k}' for c, k in (REPORT_FACTS | _TIMING_FACTS).items())}>>")


def of_lines(read: Callable[[list[str]], list[tuple]], kinds: dict[str, str]) -> Callable[[Column | str], Column]:
    """A column function from texts to arrays of the rows that read makes of the lines of each."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [[] if text is None else read(lines_in(text)) for text in texts.to_pylist()]
        columns = list(zip(*(r for some in rows for r in some), strict=True)) or [()] * len(kinds)
        ends = np.concatenate([[0], np.cumsum([len(some) for some in rows])])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds)))

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, f"array<struct<{', '.join(f'{c}: {k}' for c, k in kinds.items())}>>")


def crossing_counts(text: Column | str) -> Column:
    """An array of (severity, n)."""
    return of_lines(crossing_counts_of, {"severity": "string", "n": "bigint"})(text)


def rows_of(kind: str) -> Callable[[Column | str], Column]:
    """How many rows the parser of a kind makes of each text; a null text gives none."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([0 if text is None else rows_found(kind, lines_in(text)) for text in texts.to_pylist()], pa.int64())

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")
