"""Secret scans in built-in column functions only.

Base kinds are regular expressions; a kind's matches and the pieces between them come from one split and one
extraction, so positions are running sums of lengths (code points). The method adds kind ``entropy``: over each
candidate string a window of `WINDOW` characters slides, the counts of its characters over the class's alphabet
are updated by the one character that leaves and the one that enters, and with them the sum of c*log2(c) and so
the Shannon entropy. Base spans are blanked out before candidates are looked for; a piece of `WINDOW` characters
or more whose highest window entropy reaches its class's threshold is a secret, unless the allow-list knows it.
The allow-list has words such as `example`: a random string that holds one of them is taken for a placeholder,
and is reported only where a base kind finds it.

Work grows with the length of a text, however long its runs and however many its matches.

All of it stays in the scan's stage: no join, no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 20
#: Characters of the pieces into which a text is cut where spans are replaced.
PIECE = 1024
_REST = "__text_between_base_spans"


@dataclass(frozen=True)
class Kind:
    """A base kind: its pattern, and the least length of the group that decides (0: the match)."""

    name: str
    pattern: str
    group: int
    least: int


#: Fixed patterns of the base kinds, in the order in which spans that start together are listed. Where the whole
#: match decides, its least length is in the pattern: a run that is too short holds no longer one, so the matches are
#: the same and the many short runs cost nothing.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{32,}", 0, 32),
)


@dataclass(frozen=True)
class CharacterClass:
    """Candidates made of `alphabet`; `bits` is the entropy of a window from which they count."""

    name: str
    alphabet: str
    bits: float


_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: The first class that spells the whole candidate is its class.
CLASSES = (
    CharacterClass("hex", _DIGITS + "abcdef", 3.0),
    CharacterClass("HEX", _DIGITS + "ABCDEF", 3.0),
    CharacterClass("base32", _UPPER + _DIGITS, 3.4),
    CharacterClass("base36", _LOWER + _DIGITS, 3.4),
    CharacterClass("base64", _UPPER + _LOWER + _DIGITS + "+/_=-", 3.7),
)
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: What is never a secret: no digit or no letter, UUIDs, placeholders, runs of one character, paths and slugs of plain words.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|redacted|your[_-]?(key|token|secret)|0123456789|abcdefgh",
    r"([A-Za-z0-9])\1{7,}",
    r"^[/_=-]*+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+)(?:[/_=-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}+))*+[/_=-]*+$",
)


def _zero() -> Column:
    return F.lit(0).cast("int")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` worked out once: inside a lambda a plain column would be worked out for each element."""
    return F.transform(F.array(F.struct(value.alias("v"))), lambda h: use(h["v"]))[0]


def before(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """What `combine` makes of the elements before each element, from 0; by blocks of 256, so that long arrays stay cheap."""
    size = 256

    def scan(xs: Column, start: Column) -> Column:
        state = F.aggregate(
            xs,
            F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, x: F.struct(combine(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
        )
        return state["out"]

    def by_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(_zero(), F.greatest(F.ceil(F.size(v) / size).cast("int") - 1, _zero())), lambda b: F.slice(v, b * size + 1, F.lit(size)))
        totals = F.transform(blocks, lambda b: F.aggregate(b, _zero(), combine))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("b"), scan(totals, _zero()).alias("s")), lambda z: scan(z["b"], z["s"])))

    return bound(values, by_blocks)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of struct(start, end, value) of a pattern's matches, from left to right; `value` is the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    lengths = F.transform(F.arrays_zip(between.alias("p"), found.alias("m")), lambda z: F.length(z["p"]) + F.coalesce(F.length(z["m"]), _zero()))
    values = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(before(lengths, lambda a, x: a + x).alias("s"), between.alias("p"), found.alias("m"), values.alias("v"))
    spans = F.transform(
        F.slice(zipped, 1, F.size(found)),
        lambda z: F.struct((z["s"] + F.length(z["p"])).alias("start"), (z["s"] + F.length(z["p"]) + F.length(z["m"])).alias("end"), z["v"].alias("value")),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def spliced(text: Column, spans: Column, fill: Callable[[Column, Column], Column]) -> Column:
    """`text` with its spans, sorted by start, replaced: by fill(span, end of the spans before it) each.

    The text is cut once into pieces of `PIECE` characters, and what stands between spans is put together from these,
    so the work grows with the text and the number of spans and not with their product.
    """
    ends = before(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x))
    cuts = F.transform(
        F.arrays_zip(spans.alias("x"), ends.alias("e")),
        lambda z: F.struct(z["e"].alias("a"), F.greatest(z["x"]["start"], z["e"]).alias("b"), fill(z["x"], z["e"]).alias("fill")),
    )
    last = F.struct(F.array_max(F.transform(spans, lambda x: x["end"])).alias("a"), F.length(text).alias("b"), F.lit("").alias("fill"))
    held = F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"), F.concat(cuts, F.array(last)).alias("cuts"))

    def part(pieces: Column, c: Column) -> Column:
        i, j = F.call_function("div", c["a"], F.lit(PIECE)).cast("int"), F.call_function("div", c["b"], F.lit(PIECE)).cast("int")
        at = lambda k: F.coalesce(F.try_element_at(pieces, k + 1), F.lit(""))
        one = F.substring(at(i), c["a"] % PIECE + 1, c["b"] - c["a"])
        many = F.concat(F.substring(at(i), c["a"] % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(at(j), F.lit(1), c["b"] % PIECE))
        return F.concat(F.when(i == j, one).otherwise(many), c["fill"])

    return bound(held, lambda h: F.array_join(F.transform(h["cuts"], lambda c: part(h["pieces"], c)), ""))


def window_entropy(value: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of the windows of `value`; it spells its characters in `alphabet`.

    State: counts over the alphabet in fields of five bits, twelve to a long, the sum S of c*log2(c), the least S so
    far; entropy is log2(w) - S/w. The character that enters and the one that leaves come as one element, so a step
    costs the same wherever it stands.
    """
    if window > 31:
        raise ValueError("counts have five bits: a window has 31 characters at most")
    weights = F.array(*[F.lit(c * math.log2(c) if c > 1 else 0.0) for c in range(window + 2)])
    weight = lambda c: F.element_at(weights, c + 1)
    fields = F.array(*[F.struct(F.lit(k // 12).alias("at"), F.lit(k % 12 * 5).alias("shift"), F.lit(1 << k % 12 * 5).cast("long").alias("unit")) for k in range(len(alphabet))])
    spelled = F.transform(F.split(value, ""), lambda c: F.element_at(fields, F.instr(F.lit(alphabet), c)))
    none = F.array_repeat(F.lit(None).cast("struct<at:int,shift:int,unit:bigint>"), window)
    full = F.concat(F.array_repeat(F.lit(False), window - 1), F.array_repeat(F.lit(True), F.length(value) - (window - 1)))
    steps = F.arrays_zip(spelled.alias("enters"), F.slice(F.concat(none, spelled), F.lit(1), F.length(value)).alias("leaves"), full.alias("full"))
    count = lambda counts, f: F.call_function("shiftright", F.element_at(counts, f["at"] + 1), f["shift"]).bitwiseAND(F.lit(31)).cast("int")

    def step(s: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        moved = (enters["unit"] != leaves["unit"]) | (enters["at"] != leaves["at"])
        c_in = count(s["counts"], enters)
        c_out = F.when(leaves.isNotNull(), count(s["counts"], leaves)).otherwise(_zero())
        counts = F.transform(
            s["counts"], lambda c, k: c + F.when(k == enters["at"], enters["unit"]).otherwise(F.lit(0).cast("long")) - F.when(k == leaves["at"], leaves["unit"]).otherwise(F.lit(0).cast("long"))
        )
        total = s["sum"] + weight(c_in + 1) - weight(c_in) + F.when(c_out > 0, weight(F.greatest(c_out, F.lit(1)) - 1) - weight(c_out)).otherwise(F.lit(0.0))
        still = leaves.isNotNull() & ~F.coalesce(moved, F.lit(True))
        total = F.when(still, s["sum"]).otherwise(total)
        return F.struct(F.when(still, s["counts"]).otherwise(counts).alias("counts"), total.alias("sum"), F.when(x["full"], F.least(s["best"], total)).otherwise(s["best"]).alias("best"))

    empty = F.array_repeat(F.lit(0).cast("long"), (len(alphabet) + 11) // 12)
    start = F.struct(empty.alias("counts"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("best"))
    least = F.aggregate(steps, start, step)["best"]
    return F.lit(math.log2(window)) - least / window


def is_random(value: Column) -> Column:
    """Whether a candidate is not allowed and reaches the entropy of its class."""
    verdict = None
    for c in CLASSES:
        fits = value.rlike("^[" + c.alphabet.replace("-", r"\-") + "]+$")
        reaches = window_entropy(value, c.alphabet) >= c.bits - 1e-9
        verdict = F.when(fits, reaches) if verdict is None else verdict.when(fits, reaches)
    allowed = F.lit(False)
    for rule in ALLOWED:  # each by itself: joined, flags and group numbers of one would reach into others
        allowed = allowed | value.rlike(rule)
    return ~allowed & verdict.otherwise(F.lit(False))


_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _named(spans: Column, kind: str, rank: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"))).cast(_SPANS)


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["value"]) >= least)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with base_spans and spans: arrays of struct(start, rank, end, kind), by start, then kind as listed.

    Offsets are code points, ends exclusive. A null or empty text has no spans. Texts are scanned whole, rows
    are neither merged nor split; columns of these names are replaced.
    """
    common.require(docs, text)
    docs = docs.drop("base_spans", "spans")
    body = F.coalesce(F.col(text), F.lit(""))
    base = [_named(_long_enough(matches(body, k.pattern, k.group), k.least), k.name, i) for i, k in enumerate(KINDS)]
    docs = docs.withColumn("base_spans", F.array_sort(F.concat(*base)))
    blank = lambda x, e: F.repeat(F.lit("\n"), F.greatest(x["end"], e) - F.greatest(x["start"], e))
    rest = F.when(F.size("base_spans") > 0, spliced(body, F.col("base_spans"), blank)).otherwise(body)
    docs = docs.withColumn(_REST, rest)
    added = F.filter(matches(F.col(_REST), CANDIDATE), lambda m: is_random(m["value"]))
    return docs.withColumn("spans", F.array_sort(F.concat(F.col("base_spans"), _named(added, "entropy", len(KINDS))))).drop(_REST)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """`docs`, columns unchanged, with each secret in the text replaced by `mask`; overlapping spans become one.

    n_chars, where there is one, is counted anew for changed texts. A null text stays null.
    """
    scanned = scan(docs, text)
    rest = spliced(F.col(text), F.col("spans"), lambda x, e: F.when(x["start"] >= e, F.lit(mask)).otherwise(F.lit("")))
    found = F.size("spans") > 0
    out = scanned.withColumn("clean", F.when(found, rest).otherwise(F.col(text)))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col("clean").alias(text))
        elif c == "n_chars":
            columns.append(F.when(found, F.length("clean").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return out.select(*columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans, for all documents."""
    found = scan(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k.name).alias(f"n_{k.name}") for k in KINDS],
        F.sha2(listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
