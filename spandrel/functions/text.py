"""Phrases, printed ratings and dimensions as built-in column expressions. What does not parse is null, never guessed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and slashes; the registered sign is dropped."""
    plain = F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("®"), F.lit(""))
    return F.regexp_extract_all(plain, F.lit("[a-z0-9/]+"), F.lit(0))


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))


def has_phrase(hay: Column, needle: Column) -> Column:
    """Whether the needle's words stand in the hay, adjacent and in order; an empty needle always does."""
    return (F.size(tokens(needle)) == 0) | F.contains(padded(hay), padded(needle))


def restraint_of(text: Column) -> Column:
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("unrestrained")), "unrestrained").when(F.contains(low, F.lit("restrained")), "restrained")


def application_of(text: Column) -> Column:
    """Half-flange-tip charts against contour charts, by the printed condition."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?i)half\s+flange"), "half_flange_tip").otherwise("contour")


def fraction(text: Column) -> Column:
    """'3', '3.5', '1/4', '3-1/2' or '3 1/2' as a number."""
    s = F.trim(text)
    part = lambda k: F.nullif(F.regexp_extract(s, r"^(?:(\d+)[ -])?(\d+)/(\d+)$", k), F.lit(""))
    ratio = F.try_divide(part(2).cast("double"), part(3).cast("double"))
    return F.when(s.rlike(r"^(?:\d+[ -])?\d+/\d+$"), F.coalesce(part(1).cast("double"), F.lit(0.0)) + ratio).when(s.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), s.cast("double"))


def rating_hours(label: Column) -> Column:
    """'1 Hr', '1-1/2 Hr', '3/4 Hr', '1-Hour', '90 min' as hours."""
    minutes = F.regexp_extract(label, r"(?i)^\s*(\d+)\s*min", 1)
    hours = F.regexp_extract(label, r"(?i)^\s*(\d+-\d+/\d+|\d+/\d+|\d+(?:\.\d+)?|\.\d+)\s*-?\s*(?:hr|hour)", 1)
    return F.when(minutes != "", minutes.cast("double") / 60).when(hours != "", fraction(hours))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is worked out once, so that expressions built on it stay small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _unit_marks(text: Column) -> Column:
    """`text` with feet as ' and inches as ", whatever marks or words are printed."""
    marks = F.translate(F.lower(F.trim(text)), "’′‘“”″", "'''\"\"\"")
    for word, mark in (("ft.", "'"), ("ft", "'"), ("in.", '"'), ("in", '"'), ("''", '"')):
        marks = F.replace(marks, F.lit(word), F.lit(mark))
    return marks


def _past(text: Column, mark: str) -> Column:
    """What stands behind the first `mark`, without a dash in front."""
    return F.trim(F.regexp_replace(F.trim(F.substr(text, F.instr(text, mark) + 1)), "^-", ""))


def dimension_inches(text: Column) -> Column:
    """28'-6", 28' - 6 1/2", 3/4", 12' as inches; anything else is null.

    What stands before the foot mark must be whole, what stands behind it must end in an inch mark.
    """

    def signed(marked: Column) -> Column:
        negative = marked.startswith("-")
        body = F.trim(F.when(negative, F.substr(marked, F.lit(2))).otherwise(marked))
        return bound(body, lambda x: F.when(negative, -unsigned(x)).otherwise(unsigned(x)))

    def unsigned(body: Column) -> Column:
        footed = F.contains(body, F.lit("'"))
        parts = F.struct(F.when(footed, F.trim(F.substring_index(body, "'", 1))).alias("feet"), F.when(footed, _past(body, "'")).otherwise(F.regexp_replace(body, "^- *", "")).alias("rest"))
        return bound(parts, lambda p: bound(inches_of(p["rest"]), lambda inches: total(p["feet"], p["rest"], inches)))

    def inches_of(rest: Column) -> Column:
        printed = F.regexp_replace(F.trim(F.rtrim(rest, F.lit('"'))), r"\s*[ -]\s*", "-")
        return bound(printed, lambda x: F.when(rest.endswith('"') & ~F.contains(x, F.lit(".")), fraction(x)))

    def total(feet: Column, rest: Column, inches: Column) -> Column:
        good = F.when(feet.isNotNull(), feet.rlike("^[0-9]+$") & ((rest == "") | inches.isNotNull())).otherwise(inches.isNotNull())
        return F.when(good, F.coalesce(feet.cast("double") * 12, F.lit(0.0)) + F.coalesce(inches, F.lit(0.0)))

    return bound(_unit_marks(text), signed)


def feet_inches(inches: Column, denominator: int = 16) -> Column:
    """28'-6 1/2" to the nearest 1/16, fractions in lowest terms."""
    units = F.round(F.abs(inches) * denominator).cast("long")
    feet, rest = (units / (12 * denominator)).cast("long"), units % (12 * denominator)
    whole, part = (rest / denominator).cast("long"), rest % denominator
    lowest = None
    power = denominator
    while power > 1:  # the largest power of two that divides the part
        share = F.concat(F.lit(" "), (part / power).cast("long").cast("string"), F.lit("/"), F.lit(str(denominator // power)))
        lowest = F.when(part % power == 0, share) if lowest is None else lowest.when(part % power == 0, share)
        power //= 2
    lowest = lowest.otherwise(F.concat(F.lit(" "), part.cast("string"), F.lit(f"/{denominator}")))
    sign = F.when(inches < 0, "-").otherwise("")
    return F.concat(sign, feet.cast("string"), F.lit("'-"), whole.cast("string"), F.when(part == 0, "").otherwise(lowest), F.lit('"'))


def inches_per_point(text: Column) -> Column:
    """A drawing scale as real inches per point of paper (1/72 in); 'not to scale' is null.

    Either paper = real around an equals sign, the last number before it and the feet (and inches) behind it, or a word such as 1:48.
    """
    return bound(F.split(_unit_marks(text), "="), lambda sides: _scale_of(text, sides))


def _scale_of(text: Column, sides: Column) -> Column:
    paper = F.filter(F.split(F.rtrim(F.trim(sides[0]), F.lit('" ')), r"[\s:(]+"), lambda w: w != "")
    last, before = F.try_element_at(paper, F.lit(-1)), F.try_element_at(paper, F.lit(-2))
    on_paper = fraction(F.when(F.contains(last, F.lit("/")) & ~F.contains(last, F.lit("-")) & before.rlike("^[0-9]+$"), F.concat(before, F.lit("-"), last)).otherwise(last))
    built = F.get(sides, F.lit(1))
    feet = F.when(F.contains(built, F.lit("'")), F.trim(F.substring_index(built, "'", 1)))
    more = F.nullif(F.regexp_extract(_past(built, "'"), "^[0-9]+", 0), F.lit(""))
    real = F.when(feet.rlike("^[0-9]+$"), feet.cast("double") * 12 + F.coalesce(more.cast("double"), F.lit(0.0)))
    pairs = F.transform(F.split(F.regexp_replace(text, r"\s*([:/])\s*", "$1"), r"[\s(),;]+"), lambda w: F.slice(F.split(w, "[:/]"), -2, 2))
    ratios = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[0] == "1") & p[1].rlike("^[0-9]{2,5}$"))
    ratio = F.get(F.get(ratios, F.lit(0)), F.lit(1)).cast("double")
    unscaled = text.rlike(r"(?i)\b(N\.?T\.?S\.?|NOT TO SCALE)(?![A-Z])")
    drawn = F.try_divide(real, on_paper) / 72
    return F.when(unscaled, F.lit(None).cast("double")).when(real.isNotNull() & on_paper.isNotNull(), F.when(drawn > 0, drawn)).when(ratio > 0, ratio / 72)


def keyword_hits(text: Column, keyword: str) -> Column:
    """Occurrences of a keyword with no letter or digit at its ends, any case."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in keyword)
    return F.regexp_count(text, F.lit(rf"(?i)(?<![A-Za-z0-9]){quoted}(?![A-Za-z0-9])"))


def white_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, without fragment and path parameters."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r";[^/?]*(?=$|\?)", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + 1))


def name_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def sniff(magic: Column, text: Column) -> Column:
    """Kind of a document by its first bytes and words."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(magic.startswith("25504446"), F.when(t.rlike(r"(?i)design\s+no\.?\s+[A-Z]\d{3}"), "listing").when(t.rlike(r"(?i)thickness") & t.rlike(r"(?i)\bW/D\b"), "chart").otherwise("pdf"))
        .when(magic.startswith("504B"), "workbook")
        .when(t.rlike(r"(?i)<html"), "page")
        .otherwise("unknown")
    )


def extracts(text: Column, most: int = 12) -> Column:
    """What a document mentions, each list distinct, sorted and up to `most`: ratings, designs, members, years, dates."""
    listed = lambda pattern, k=0: F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(k)))), 1, most)
    return F.struct(
        listed(r"(?i)\b(\d+(?:-\d+/\d+|/\d+|\.\d+)?)\s*-?\s*(?:hr|hour)s?\b", 1).alias("ratings"),
        listed(r"(?<![A-Za-z0-9])([A-Z]\d{3})(?![A-Za-z0-9])", 1).alias("designs"),
        listed(r"(?<![A-Za-z0-9])((?:W|HP|WT|MC|HSS)\d+[xX]\d+(?:[xX][\d/.]+)?)(?![A-Za-z0-9])", 1).alias("members"),
        listed(r"(?<![\d.])((?:19|20)\d{2})(?![\d.])", 1).alias("years"),
        listed(r"(?<!\d)(\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/(?:19|20)?\d{2})(?!\d)", 1).alias("dates"),
    )


def first_guess(text: Column, rules: dict[str, str], otherwise: str = "unknown") -> Column:
    """The name of the first rule, in order, whose pattern the text has."""
    out = None
    for name, pattern in rules.items():
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def not_rated(printed: Column) -> Column:
    """Whether a cell is printed as not rated."""
    return F.coalesce(F.upper(F.trim(printed)).isin("NR", "N/R", "N.R.", "-", "–", "—"), F.lit(False))


def file_name(url: Column) -> Column:
    """The decoded last path segment of a URL, or of its `file` or `name` parameter."""
    asked = F.regexp_extract(url, r"[?&](?:file|filename|name)=([^&#]+)", 1)
    last = F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]+.*?/([^/]+)/?$", 1)
    return F.nullif(F.try_url_decode(F.when(asked != "", asked).otherwise(last)), F.lit(""))


def evidence_text(document: Column, page: Column, sheet: Column, raw: Column) -> Column:
    """'document p3 sheet S-101: text', leaving out what is null."""
    where = F.concat_ws(" ", document, F.concat(F.lit("p"), page.cast("string")), F.concat(F.lit("sheet "), sheet))
    return F.concat_ws(": ", where, raw)
