"""Whole records of printed listings: every line of a document belongs to one part of it.

A task reads its documents one after the other, in Arrow batches sorted by document and line, and keeps the reader's state over
them; documents are spread over tasks. A part is given out as soon as it ends, so no document is held whole. What fits nothing is a
part too (`unparsed`), so no line is lost and nothing is inferred.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import designation

EQUATION = "struct<form:string,factor:string,a:double,b:double,k:double,c:double,hours:double,ratio_lo:double,ratio_hi:double,h_lo:double,h_hi:double,h_units:string,r_units:string>"
PART = (
    "document string, kind string, item string, sub string, line_no int, lines array<int>, label string, text string, hours array<double>, table_no int, units string,"
    f" condition string, ratios array<double>, values_in array<double>, cells array<string>, note string, equation {EQUATION}"
)

#: Words as printed.
FACTORS = {"w/d": "W/D", "a/p": "A/P", "m/d": "M/D", "hp/a": "Hp/A"}
MARKERS = {"NR", "N/A", "-", "—", "–"}
HOUR_WORDS, MINUTE_WORDS = {"hr", "hrs", "hour", "hours", "h"}, {"min", "mins", "minute", "minutes"}
UNIT_WORDS = {"mils": "mils", "mil": "mils", "mm": "mm", "in": "in", "inch": "in", "inches": "in"}
SHAPES = {
    "h=R/nX+n": ("h = R / (a*X + b)", "ab", 1), "h=R/nX-n": ("h = R / (a*X + b)", "ab", -1), "T=n/X": ("T = k / (X)", "k", 1),
    "h=R-n/nX": ("h = (R - c) / (k*X)", "ck", 1), "T=nX+n": ("T = a*(X) + b", "ab", 1), "T=nX-n": ("T = a*(X) + b", "ab", -1),
}
_TOKEN = re.compile(r"hp/a|[wam]/[dp]|\d*\.?\d+|[A-Za-z]+|\S", re.IGNORECASE)
_ITEM = re.compile(r"(\d{1,2}[A-Z]?)\.\s+(\S.*)")
_SUB = re.compile(r"([A-Z])\.\s+\S.*")
_DATE = re.compile(r"\d{1,2}/\d{1,2}/\d{4}")
_LONG_DATE = re.compile(r"[A-Z][a-z]+ \d{1,2}, \d{4}")
_DESIGN = re.compile(r"(?:Design No\.\s*|BXUV\.)([A-Z]{1,3}-?\d{3,4}[A-Z]?)\b")


#: Answers that `remembered` keeps, and the length of a text that it keeps one for.
KEPT, KEPT_LENGTH = 32_768, 64


def remembered(f: Callable) -> Callable:
    """`f` of one text, whose answers for short texts are kept: printed documents repeat their heads, sizes and cells."""
    seen = {}

    def answer(s: str):
        if s in seen:
            return seen[s]
        out = f(s)
        if len(s) <= KEPT_LENGTH:
            if len(seen) >= KEPT:
                seen.clear()
            seen[s] = out
        return out

    return answer


@remembered
def number(s: str) -> float | None:
    """'2', '0.62', '5/8' or '1-5/8' as a number, else None."""
    whole, _, part = s.rpartition("-") if "/" in s else ("", "", s)
    top, slash, bottom = part.partition("/")
    pieces = [x for x in (whole, top, bottom) if x]
    if not all(x.replace(".", "", 1).isdigit() and x.isascii() for x in pieces) or not top or (slash and (not bottom.isdigit() or not int(bottom))):
        return None
    return (float(whole) if whole else 0.0) + float(top) / (float(bottom) if slash else 1.0)


@remembered
def words(s: str) -> list[str]:
    return [w for w in (x.strip(",.:;()").lower() for x in s.split()) if w]


@remembered
def rating_head(s: str) -> float | None:
    """Hours of a column head such as '1-1/2 Hr', 'Min Thkns In. 2 Hr' or '90 min (mm)', else None."""
    found = words(s)
    at = next((i for i, w in enumerate(found) if number(w) is not None), None)
    if at is None or at > 3 or at + 1 >= len(found) or len(found) > at + 4 or not all(w.isalpha() for w in found[:at] + found[at + 1 :]):
        return None
    if set(found[at + 2 :]) - set(UNIT_WORDS) - MINUTE_WORDS - {"thickness"}:
        return None
    value = number(found[at])
    return value if found[at + 1] in HOUR_WORDS else value / 60 if found[at + 1] in MINUTE_WORDS else None


@remembered
def rating_title(s: str) -> str | None:
    """'hr' or 'min' where a line ends as the title of a column of ratings ('Rating, Hr', 'Rating Period (min)'), else None."""
    found = words(s)
    if len(found) < 2 or "=" in s or not set(found[-3:-1]) & {"rating", "ratings"}:
        return None
    return "hr" if found[-1] in HOUR_WORDS else "min" if found[-1] in MINUTE_WORDS else None


def units_of(lines: list[str]) -> str | None:
    found = [UNIT_WORDS[w] for s in lines for w in words(s) if w in UNIT_WORDS]
    return min(found, key=("mils", "mm", "in").index) if found else None


@remembered
def is_label(s: str) -> bool:
    """Whether a line is a member size: a designation, or a tube or pipe by its outer sizes."""
    core = s.lstrip("*").strip()
    if len(core) > 24:
        return False
    sizes = core.removesuffix("in.").removesuffix("in").strip().lower().split("x")
    head = sizes[0].lstrip("abcdefghijklmnopqrstuvwxyz ")
    return bool(designation.find(core)) or (len(sizes) in (2, 3) and all(number(x.strip()) is not None for x in [head, *sizes[1:]]) and (len(head) < len(sizes[0]) or len(sizes) == 3))


@remembered
def is_open_label(s: str) -> bool:
    """A size broken after its x, such as 'W16 x'."""
    return len(s) < 10 and s[-1] in "xX" and s.lstrip("*")[0].isupper() and is_label(s + "100")


def bare(s: str) -> str:
    """A printed cell without its marks: '1-1/2**' and '5/8 (1/2*)' as '1-1/2' and '5/8'."""
    return s.split("(")[0].strip().rstrip("*+#").strip()


@remembered
def is_cell(s: str) -> bool:
    return bool(bare(s)) and (bare(s) in MARKERS or number(bare(s)) is not None) and not _DATE.fullmatch(s)


def tokens(s: str) -> list[str]:
    return _TOKEN.findall(s.translate(str.maketrans("—–−×", "---*")))


def equation_in(found: list[str]) -> dict | None:
    """The equation that the tokens begin with, or None: its form, factor and constants."""
    shape, values, factor = "", [], None
    best = None
    for t in found:
        if t.lower() in FACTORS:
            factor, shape = FACTORS[t.lower()], shape + "X"
        elif t in ("h", "T", "R", "=", "/", "+", "-"):
            shape += t
        elif number(t) is not None:
            values.append(number(t))
            shape += "n"
        elif t not in "()[]*":
            break
        if shape in SHAPES:
            form, names, sign = SHAPES[shape]
            constants = dict(zip(names, values, strict=False))
            if "b" in constants:
                constants["b"] *= sign
            best = {"form": form, "factor": factor, **constants}
    return best


def equation_inside(s: str) -> dict | None:
    """The first equation that stands in a line."""
    found = tokens(s) if "=" in s else []
    return next((e for i, t in enumerate(found) if t in ("h", "T") and (e := equation_in(found[i:]))), None)


def spread(s: str) -> tuple[float, float, str | None] | None:
    """The range that a line prints ('0.30 to 0.55', '3/8 to 3-3/4 in'), with its unit."""
    found = [w.strip(",.;()") for w in s.split()]
    for i in range(1, len(found) - 1):
        low, high = number(found[i - 1]), number(found[i + 1])
        if found[i] in ("to", "-", "–", "—") and low is not None and high is not None:
            return low, high, UNIT_WORDS.get(found[i + 2].lower()) if i + 2 < len(found) else None
    return None


@dataclass
class Table:
    """A table being read. `stage` is heads, then rows; `fields` rating columns lead each row of a rating_rows table."""

    head: list[tuple[int, str]]
    no: int
    stage: str = "heads"
    kind: str = "size_wd"
    hours: list[float] = field(default_factory=list)
    ratio_names: list[str] = field(default_factory=list)
    units: str | None = None
    condition: str | None = None
    note: str | None = None
    fields: int = 0
    values: int = 0
    minutes: bool = False
    heads: list[tuple[int, str]] = field(default_factory=list)
    label: tuple[list[int], str] | None = None
    cells: list[tuple[int, str]] = field(default_factory=list)
    marks: list[tuple[int, str]] = field(default_factory=list)
    printed: set[str] = field(default_factory=set)


class Reader:
    """Reads lines (number, text) in order and gives out parts; `close` gives out what is open."""

    def __init__(self, document: str):
        self.document = document
        self.where, self.item, self.sub = "before", None, None
        self.furniture: list[tuple[int, str]] = []
        self.recent: list[tuple[int, str]] = []
        self.fraction: list[tuple[int, str]] = []
        self.maker: dict | None = None
        self.equation: dict | None = None
        self.table: Table | None = None
        self.last: Table | None = None
        self.under = False
        self.pending: str | None = None
        self.tables = 0
        self.broken: tuple[int, str] | None = None

    def part(self, kind: str, lines: list[int], **values) -> dict:
        out = {"kind": kind, "item": self.item, "sub": self.sub, "lines": sorted(lines), **values}
        if kind not in ("table", "row", "legend", "furniture"):
            self.under = False
        return out

    def feed(self, no: int, text: str | None) -> Iterator[dict]:
        s = " ".join((text or "").split())
        if not s:
            return
        if self.furniture or _DATE.fullmatch(s):
            self.furniture.append((no, s))
            page = s.split("/")
            if len(self.furniture) > 2 and len(page) == 2 and all(x.isdigit() for x in page):
                yield self.part("furniture", [n for n, _ in self.furniture], text="\n".join(t for _, t in self.furniture))
                self.furniture = []
            elif len(self.furniture) > 5:
                yield from self.release()
            return
        yield from self.line(no, s)

    def release(self) -> Iterator[dict]:
        held, self.furniture = self.furniture, []
        for n, t in held:
            yield from self.line(n, t)

    def line(self, no: int, s: str) -> Iterator[dict]:
        if self.where == "after":
            yield self.part("notice", [no], text=s)
            return
        if s.startswith("Last Updated on "):
            yield from self.end_all()
            self.where, self.item, self.sub = "after", None, None
            yield self.part("updated", [no], text=s, label=s.split()[3])
            return
        if self.where == "before":
            found = _DESIGN.match(s)
            self.where = "head" if found else "before"
            yield self.part("design", [no], text=s, label=found[1].replace("-", "")) if found else self.part("unparsed", [no], text=s)
            return
        if self.where == "head" and _LONG_DATE.fullmatch(s):
            yield self.part("design_date", [no], text=s, label=s)
            return
        if self.broken:
            (first, start), self.broken = self.broken, None
            if s.isdigit() and len(s) < 5:
                yield from self.body([first, no], f"{start} {s}")
                return
            yield from self.body([first], start)
        if is_open_label(s):
            self.broken = (no, s)
            return
        yield from self.body([no], s)

    def body(self, nos: list[int], s: str) -> Iterator[dict]:
        if self.table is not None:
            taken = False
            for p in self.in_table(nos, s):
                if p is None:
                    taken = True
                else:
                    yield p
            if taken:
                return
        yield from self.fraction_step(nos, s) if self.fraction or s == "R" or (s.startswith("R ") and tokens(s)[1:2] == ["-"] and len(tokens(s)) == 3) else self.plain(nos, s)

    def fraction_step(self, nos: list[int], s: str) -> Iterator[dict]:
        """R over h = over the bottom of a fraction, on three lines."""
        step = len(self.fraction)
        fits = step == 0 or (step == 1 and s.replace(" ", "") == "h=") or step == 2
        if fits and step < 2:
            yield from self.flush()
            self.fraction.append((nos[0], s))
            return
        held, self.fraction = self.fraction, []
        found = equation_in(["h", "=", *tokens(held[0][1]), "/", *tokens(s)]) if fits else None
        if found:
            yield from self.start_equation([n for n, _ in held] + nos, found, f"{held[0][1]} / h = / {s}")
            return
        for n, t in held:
            yield self.part("text", [n], text=t)
        yield from self.plain(nos, s)

    def plain(self, nos: list[int], s: str) -> Iterator[dict]:
        item, sub, open_maker, self.maker = _ITEM.fullmatch(s), _SUB.fullmatch(s), self.maker, None
        rating, dash, rest = s.partition(" — ")
        if item and item[1] != self.item:
            yield from self.end_all()
            self.where, self.item, self.sub, self.pending = "items", item[1], None, None
            yield self.part("item", nos, label=item[2].split(" — ")[0].strip(" —-"), text=s)
            if found := equation_inside(s):  # printed in the item's own line, which stays the item's
                yield from self.start_equation([], found, s, nos[0])
        elif self.item is None and dash and rating.split()[-1:] in (["Ratings"], ["Rating"]):
            yield self.part("rating", nos, label=rating, text=s, hours=[h for h in (number(w.strip(",.()")) for w in rest.split("(")[0].split()) if h is not None], note=rest.partition("(")[2].rstrip(". )") or None)
        elif self.item is None:
            yield self.part("unparsed", nos, text=s)
        elif sub and len(s) > 12:
            yield from self.end_all()
            self.sub = sub[1]
            yield self.part("sub_item", nos, label=sub[1], text=s)
            if found := equation_inside(s):
                yield from self.start_equation([], found, s, nos[0])
        elif dash and rest and rating == rating.upper() and len(rating) >= 4 and rating[0].isalpha():
            yield from self.end_all()
            self.maker = {"lines": nos, "label": rating, "text": rest}
        elif open_maker and (open_maker["text"].endswith((",", " and", " or"))) and len(s) <= 60 and s[0].isupper() and not dash:
            self.maker = {"lines": open_maker["lines"] + nos, "label": open_maker["label"], "text": f"{open_maker['text']} {s}"}
        else:
            if open_maker:
                yield self.part("maker", **open_maker)
            yield from self.inside(nos, s)
            return
        if open_maker and (self.maker is None or self.maker["label"] != open_maker["label"] or self.maker["lines"][0] != open_maker["lines"][0]):
            yield self.part("maker", **open_maker)

    def inside(self, nos: list[int], s: str) -> Iterator[dict]:
        """A line in an item that opens none: table heads, sizes below the last table, equations, text."""
        head = rating_head(s)
        if head is not None or rating_title(s):
            yield from self.end_equation()
            self.tables += 1
            self.table = Table(self.recent[-10:], self.tables)
            for n, t in self.recent[:-10]:
                yield self.part("text", [n], text=t)
            self.recent = []
            yield from (p for p in self.in_table(nos, s) if p is not None)
            return
        if self.last is not None and self.last.kind == "size_wd" and is_label(s):
            yield from self.flush()
            again = self.pending is not None
            self.tables += again
            self.table = Table([], self.tables, "rows", "size_wd", self.last.hours, self.last.ratio_names, self.last.units, self.pending or self.last.condition)
            if again:
                yield self.table_part(self.table)
            self.pending = None
            yield from (p for p in self.in_table(nos, s) if p is not None)
            return
        if found := equation_inside(s):
            yield from self.flush()
            yield from self.start_equation(nos, found, s)
            return
        self.add_range(s)
        if s.lower().rstrip(".:").endswith("table below") or "table below" in s.lower():
            yield from self.flush()
            self.pending = s
            yield self.part("condition", nos, text=s)
        elif len(s) <= 60 and not s[0].islower() and len(s.split()) <= 8 and len(nos) == 1:
            self.recent.append((nos[0], s))
            if len(self.recent) > 10:
                n, t = self.recent.pop(0)
                yield self.part("text", [n], text=t)
        else:
            yield from self.flush()
            yield self.part("text", nos, text=s)

    # equations

    def start_equation(self, nos: list[int], found: dict, text: str, at: int | None = None) -> Iterator[dict]:
        yield from self.end_equation()
        self.equation = {"lines": nos, "text": text, "equation": found, "line_no": min(nos, default=at)}
        self.add_range(text)
        hours = [number(b) for a, b, c in zip(["", *words(text)], words(text), [*words(text)[1:], ""], strict=False) if a == "for" and c in HOUR_WORDS]
        self.equation["equation"]["hours"] = hours[0] if hours else None

    def add_range(self, s: str) -> None:
        """What a line says of the open equation: the unit of R, the range of the ratio, that of the thickness."""
        if self.equation is None:
            return
        e, said, found = self.equation["equation"], words(s), spread(s)
        if s.startswith("R =") and not e.get("r_units"):
            e["r_units"] = "minutes" if set(said) & MINUTE_WORDS else "hours" if set(said) & HOUR_WORDS | {"hourly"} & set(said) else None
        if found and e.get("factor", "").lower() in said and "ratio_lo" not in e:
            e["ratio_lo"], e["ratio_hi"] = found[:2]
        elif found and found[2] in ("in", "mm") and "h_lo" not in e:
            e["h_lo"], e["h_hi"], e["h_units"] = found

    def end_equation(self) -> Iterator[dict]:
        if self.equation is not None:
            done, self.equation = self.equation, None
            yield self.part("equation", **done)

    # tables

    def table_part(self, t: Table) -> dict:
        return self.part("table", [n for n, _ in t.head], label=t.kind, text="\n".join(x for _, x in t.head), hours=t.hours, cells=t.ratio_names, units=t.units, condition=t.condition, note=t.note, table_no=t.no)

    def begin_rows(self, kind: str) -> dict:
        """Ends the heads of the open table: units, ratios and heading are what its lines say, else what was said before."""
        t, said = self.table, [x for _, x in self.table.head]
        t.stage, t.kind, t.units = "rows", kind, units_of(said)
        t.ratio_names = [FACTORS[x.lower().strip("()")] for x in said if x.lower().strip("()") in FACTORS]
        title = next((x for x in said if x.rstrip().endswith(":") or {"restrained", "unrestrained"} & set(words(x)) or ("," in x and {"columns", "beams", "joists", "pipes", "tubes"} & set(words(x)))), None)
        t.condition = title or self.pending
        if title and self.pending:
            t.note = f"introduced by: {self.pending}"
        elif t.condition is None and self.under and self.last is not None and self.last.condition and "rating_rows" not in (kind, self.last.kind):
            t.condition, t.note = self.last.condition, "heading of the table directly above"
        self.pending, self.last = None, t
        return self.table_part(t)

    def in_table(self, nos: list[int], s: str) -> Iterator[dict | None]:
        """Parts that the line ends; None among them says that the table took the line."""
        t = self.table
        if t.stage == "heads":
            head, title = rating_head(s), rating_title(s)
            if head is not None and not t.fields:
                t.hours.append(head)
                t.head.append((nos[0], s))
                yield None
            elif title:
                t.fields, t.minutes = t.fields + 1, title == "min"
                t.head.append((nos[0], s))
                yield None
            elif t.fields and is_cell(s) and not t.values and "." not in s:
                t.heads.append((nos[0], s))
                yield None
            elif t.fields and is_cell(s) and t.values:
                t.head, t.heads = t.head + t.heads, []
                yield self.begin_rows("rating_rows")
                yield from self.in_table(nos, s)
            elif (t.hours or len(t.heads) > 1) and (is_label(s) or (number(s) is not None and any(x.lower().strip("()") in FACTORS for _, x in t.head))):
                if not t.hours:
                    t.hours = [number(bare(x)) / (60 if t.minutes else 1) for _, x in t.heads if number(bare(x)) is not None]
                t.head, t.heads = t.head + t.heads, []
                yield self.begin_rows("size_wd" if is_label(s) else "ratio_rows")
                yield from self.in_table(nos, s)
            elif len(nos) == 1 and len(s) <= 60 and len(t.head) < 24 and (t.fields and not t.heads or not any(c.isdigit() for c in s)) and not _ITEM.match(s) and " — " not in s:
                t.values += bool(t.fields) and words(s)[-1:] != [] and words(s)[-1] in UNIT_WORDS
                t.head.append((nos[0], s))
                yield None
            else:
                yield from self.end_table()
            return
        n = len(t.hours)
        full = t.fields + t.values if t.kind == "rating_rows" else max(1, len(t.ratio_names)) + n
        legend, equals, _ = s.partition(" = ")
        if t.kind == "size_wd" and is_label(s):
            yield from self.end_row()
            t.label = (nos, s)
            yield None
        elif is_cell(s) and (t.label or t.kind != "size_wd"):
            if t.kind != "size_wd" and len(t.cells) == full:
                yield from self.end_row()
            t.cells.append((nos[0], s))
            yield None
        elif s[0] == "(" and s[-1] == ")" and t.cells and is_cell(s[1:-1]):
            t.marks.append((nos[0], s))
            yield None
        elif equals and len(legend) < 5 and any(legend in c for c in t.printed | {c for _, c in t.cells}):
            yield from self.end_row()
            yield self.part("legend", nos, label=legend, text=s, table_no=t.no)
            yield None
        elif rating_head(s) is not None or rating_title(s):
            yield from self.end_table()
        else:
            yield from self.end_table()

    def end_row(self) -> Iterator[dict]:
        t = self.table
        if not t.cells and t.label is None:
            return
        label, cells, marks = t.label, t.cells, t.marks
        t.label, t.cells, t.marks = None, [], []
        texts, n = [c for _, c in cells], len(t.hours)
        t.printed |= set(texts)
        nos = (label[0] if label else []) + [k for k, _ in cells + marks]
        if t.kind == "rating_rows":
            lead = t.fields if len(texts) == t.fields + t.values else None
        else:  # ratios that the heads name must be there; where they name none, a decimal in front is one
            lead = len(t.ratio_names) or int(bool(texts) and "." in texts[0])
            lead = lead if len(texts) == n + lead and all(number(x) is not None for x in texts[:lead]) else None
        printed = (label[1] + "\n" if label else "") + "\n".join(texts)
        if lead is None:
            yield self.part("unparsed", nos, text=printed, table_no=t.no, note="cells do not fit the heads")
            return
        values = [number(bare(x)) for x in texts[lead:]]
        scale = {"mils": 0.001, "mm": None}.get(t.units, 1.0)
        note = " ".join([x for x in texts if x[-1] in "*+#)"] + [x for _, x in marks] + ["*"] * bool(label and label[1].startswith("*"))) or None
        led = [number(bare(x)) for x in texts[:lead]]
        yield self.part(
            "row", nos, label=label[1].lstrip("* ") if label else None, text=printed, cells=texts, table_no=t.no, units=t.units, condition=t.condition, note=note,
            hours=led if t.kind == "rating_rows" else t.hours, ratios=[] if t.kind == "rating_rows" else led, values_in=[None if v is None or scale is None else v * scale for v in values],
        )

    def end_table(self) -> Iterator[dict]:
        t, self.table = self.table, None
        if t is None:
            return
        if t.stage == "heads":
            self.tables -= 1
            for n, x in sorted(t.head + t.heads):
                yield self.part("unparsed" if is_cell(x) or rating_head(x) is not None or rating_title(x) else "text", [n], text=x)
            return
        self.table = t
        yield from self.end_row()
        self.table, self.under = None, True

    # ends

    def flush(self) -> Iterator[dict]:
        held, self.recent = self.recent, []
        for n, t in held:
            yield self.part("text", [n], text=t)

    def end_all(self) -> Iterator[dict]:
        held, self.fraction = self.fraction, []
        yield from self.end_table()
        for n, t in held:
            yield self.part("text", [n], text=t)
        yield from self.flush()
        yield from self.end_equation()
        if self.maker is not None:
            done, self.maker = self.maker, None
            yield self.part("maker", **done)

    def close(self) -> Iterator[dict]:
        yield from self.release()
        if self.broken:
            (n, t), self.broken = self.broken, None
            yield from self.body([n], t)
        yield from self.end_all()


def _reading(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The parts of documents whose lines come past in order: document, line_no, text."""
    reader, out = None, []

    def hand_on() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)
        out.clear()
        return done

    def take(found: Iterator[dict]) -> None:
        for p in found:
            out.append({"line_no": p["lines"][0] if p["lines"] else None, "document": reader.document, **p})

    for batch in batches:
        for document, no, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if reader is None or reader.document != document:
                if reader is not None:
                    take(reader.close())
                reader = Reader(document)
            take(reader.feed(no, text))
            if len(out) >= 10_000:
                yield hand_on()
    if reader is not None:
        take(reader.close())
    yield hand_on()


def parts(lines: DataFrame) -> DataFrame:
    """The parts of each document of `lines` (document, line_no, text), one row each.

    Kinds: furniture of pages, design, design_date, rating, item, sub_item, maker, condition, table, row, legend,
    equation, text, unparsed, updated, notice. Each line that is not blank is in `lines` of one part. A table cut by a page
    end goes on behind the furniture; a table without rows is no table. Values in mils become inches, millimetres stay
    null. A continued table has no part of its own and keeps its number. Null and empty lines are left out.
    """
    rows = lines.select(F.col("document").cast("string").alias("document"), F.col("line_no").cast("int").alias("line_no"), "text")
    schema = to_arrow_schema(StructType.fromDDL(PART))
    return rows.repartition("document").sortWithinPartitions("document", "line_no").mapInArrow(lambda batches: _reading(batches, schema), PART)


def records(found: DataFrame) -> DataFrame:
    """One row for each document of `parts`: header, ratings, items with their text and makers, tables with their rows, equations, and the rest."""
    kind = F.col("kind")

    def listed(which: tuple[str, ...], *columns: str):
        return F.array_sort(F.collect_list(F.when(kind.isin(*which), F.struct("line_no", *columns))))

    first = lambda k: F.min_by(F.when(kind == k, F.col("label")), F.when(kind == k, F.col("line_no")))
    return found.groupBy("document").agg(
        first("design").alias("design"),
        first("design_date").alias("design_date"),
        first("updated").alias("last_updated"),
        F.min_by(F.when(kind == "furniture", F.split("text", "\n")[0]), F.when(kind == "furniture", F.col("line_no"))).alias("snapshot_date"),
        listed(("rating",), "label", "hours", "note").alias("ratings"),
        listed(("item",), "item", "label").alias("items"),
        listed(("item", "sub_item", "text", "condition"), "item", "sub", "text").alias("item_text"),
        listed(("maker",), "item", "label", "text").alias("makers"),
        listed(("table",), "table_no", "item", "label", "hours", "cells", "units", "condition", "note").alias("tables"),
        listed(("row",), "table_no", "label", "ratios", "values_in", "cells", "note").alias("rows"),
        listed(("equation",), "item", "equation", "text").alias("equations"),
        listed(("unparsed",), "text", "note").alias("unparsed"),
        listed(("notice",), "text").alias("notice"),
    )
