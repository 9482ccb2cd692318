"""Secret scans in DataFrame expressions only.

Three patterns give the base spans. Beside them, every candidate string (a long run of token characters) is cut into
character classes, and a window slides over it: the counts of the class's characters in the window, and the sum of
c*log2(c) over them, change by the one character that comes and the one that goes. The entropy of a window of n
characters is log2(n) - sum/n. A candidate whose best window reaches the class's threshold is a span of kind `entropy`,
unless the allow-list suppresses it or a base span overlaps it.

No array grows in a fold: places are sums over blocks of blocks, so that a text of very many matches costs little more a
match than a short one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: The base patterns, in the order in which kinds sort.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: A long upper-case hex number is a candidate of its own, whatever token characters stand beside it; these make one too if
#: there are enough of them.
CANDIDATE = r"[0-9A-F]{24,}|(?=[A-Za-z0-9+/_=-]{24})(?![A-Za-z0-9+/_=-]{1,23}?(?<![0-9A-F])[0-9A-F]{24})[A-Za-z0-9+/_=-]{24,}?(?=(?<![0-9A-F])[0-9A-F]{24}|(?![A-Za-z0-9+/_=-]))"
#: What marks a candidate as a sample, a name or a path.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]",
    r"^[A-Za-z]+$",
    r"^[0-9]+$",
    r"^[=_/+-]+$|(.)\1{7,}",
    r"(?i)abcdefgh|01234567|12345678|qwerty",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
)


#: What parts a path or a name, and its first and its other parts. No pattern repeats a group: such a loop
#: recurses, and a long candidate would exhaust the stack.
PARTED, FIRST, OTHER = r"[/_=-]+", r"^[A-Za-z]{2,}$", r"^(?:[A-Za-z]{2,}|[0-9]{1,4})$"


@dataclass(frozen=True)
class CharacterClass:
    """A class's letters, the length of its window, and the entropy in bits from which a window counts."""

    letters: str
    window: int
    bits: float


CLASSES = (
    CharacterClass("0123456789ABCDEF", 24, 3.0),
    CharacterClass("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
)
SPAN = "array<struct<start:int,kind:int,end:int,found:string>>"


#: Values of a block; 2 to the power SHIFT. Counts that share a long, and the bits of each: a window has fewer than 32.
SHIFT = 6
PACKED, BITS = 12, 5
PIECE, WIDE = 12, 20  # powers of two: characters of the pieces that a text is cut from, and of what these are cut from


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is worked out once, however often then or its lambdas use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _before(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each place of an array the merge of all values before it; each is read some 2^SHIFT times."""
    block = 1 << SHIFT
    fold = lambda part: F.aggregate(part, zero, merge)

    def scan(x: Column, level: int) -> Column:
        if not level:
            return F.transform(x, lambda _, i: fold(F.slice(x, F.lit(1), i)))
        own = lambda heads: F.transform(x, lambda _, i: merge(F.get(heads, F.shiftright(i, SHIFT)), fold(F.slice(x, i - i.bitwiseAND(F.lit(block - 1)) + 1, i.bitwiseAND(F.lit(block - 1))))))
        totals = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(x) - 1, SHIFT)), lambda j: fold(F.slice(x, j * block + 1, F.lit(block))))
        return _let(totals, lambda t: _let(scan(t, level - 1), own))

    return F.when(F.size(values) > 0, _let(values, lambda x: scan(x, 2))).otherwise(F.transform(values, lambda _: zero))


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """The matches of a pattern with their places in code points: texts between matches and matches alternate."""
    pattern = F.lit(pattern)

    def placed(found: Column, gaps: Column) -> Column:
        ends = lambda before: F.transform(found, lambda x, i: F.struct((F.get(before, i) + F.get(gaps, i)).alias("start"), F.lit(kind).alias("kind"), (F.get(before, i) + F.get(gaps, i) + F.length(x)).alias("end"), x.alias("found")))
        return _let(_before(F.transform(found, lambda x, i: F.get(gaps, i) + F.length(x)), lambda a, x: a + x, F.lit(0)), ends)

    gaps = F.transform(F.split(text, pattern, -1), F.length)
    spans = _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda found: _let(gaps, lambda g: placed(found, g)))
    return F.when(F.regexp_like(text, pattern), spans).otherwise(F.array().cast(SPAN))


def windowed_entropy(candidate: Column, letters: CharacterClass) -> Column:
    """The largest entropy, in bits, of a window over the class's characters of a string; null if it has too few.

    Counts and their sum go from window to window by one character out and one in. Counts of PACKED characters share a long."""
    n, words = letters.window, -(-len(letters.letters) // PACKED)
    part = lambda count: F.when(count > 1, count * F.log2(count)).otherwise(F.lit(0.0))
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code["shift"])

    def best(codes: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            comes, goes = F.get(codes, i), F.get(codes, F.when(i >= n, i - n))
            held = lambda code: F.call_function("shiftright", F.get(state["counts"], code["word"]), code["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
            gain = part(held(comes) + 1) - part(held(comes))
            loss = F.when(goes.isNotNull(), part(held(goes)) - part(held(goes) - 1)).otherwise(F.lit(0.0))
            change = F.when((comes["word"] == goes["word"]) & (comes["shift"] == goes["shift"]), F.lit(0.0)).otherwise(gain - loss)
            more = lambda k, code: F.when(code["word"] == k, one(code)).otherwise(F.lit(0).cast("long"))
            counts = F.transform(state["counts"], lambda w, k: w + more(k, comes) - more(k, goes))
            total = state["total"] + change
            found = F.when(i >= n - 1, F.greatest(state["best"], F.log2(F.lit(float(n))) - total / n)).otherwise(state["best"])
            return F.struct(counts.alias("counts"), total.alias("total"), found.alias("best"))

        first = F.struct(F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("double").alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), first, step)["best"]

    kept = F.regexp_replace(candidate, "[^" + letters.letters.replace("-", "\\-") + "]", "")
    code = lambda place: F.struct(F.floor(place / PACKED).cast("int").alias("word"), (place % PACKED * BITS).alias("shift"))
    codes = lambda kept: F.transform(F.split(kept, ""), lambda c: code(F.instr(F.lit(letters.letters), c) - 1))
    return _let(kept, lambda k: F.when(F.length(k) >= n, _let(codes(k), best)))


def _high_entropy(candidate: Column) -> Column:
    held = F.lit(False)
    for letters in CLASSES:
        own = F.regexp_like(candidate, F.lit("^[0-9A-F]+$")) if len(letters.letters) == 16 else F.lit(True)
        held = held | (own & F.coalesce(windowed_entropy(candidate, letters) >= letters.bits, F.lit(False)))
    return held


def _named(candidate: Column) -> Column:
    """Whether a candidate is a path or a name: words and short numbers between signs, which may end it."""
    plain = lambda part: (part == "") | F.regexp_like(part, F.lit(OTHER))
    parts = F.split(F.regexp_replace(candidate, "^/", ""), PARTED)  # only the first and the last can be empty
    return _let(parts, lambda x: F.regexp_like(F.get(x, F.lit(0)), F.lit(FIRST)) & (F.size(x) > 1) & (F.get(x, F.lit(1)) != "") & F.forall(x, plain))


def _allowed(candidate: Column) -> Column:
    held = F.lit(False)
    for pattern in ALLOWED:
        held = held | F.regexp_like(candidate, F.lit(pattern))
    return held | _named(candidate)


def _apart(base: Column, runs: Column) -> Column:
    """The runs that no base span overlaps: none before ends behind their start, and none after starts before their end."""
    far = 2**31 - 1

    def kept(events: Column) -> Column:
        own = lambda s: s["kind"] < 3
        ends = F.transform(events, lambda s: F.when(own(s), s["end"]).otherwise(F.lit(0)))
        starts = F.transform(F.reverse(events), lambda s: F.when(own(s), -s["start"]).otherwise(F.lit(-far)))
        most = lambda a, x: F.greatest(a, x)
        alone = lambda before, behind: F.filter(events, lambda s, i: ~own(s) & (F.get(before, i) <= s["start"]) & (-F.get(behind, F.size(events) - 1 - i) >= s["end"]))
        return _let(_before(ends, most, F.lit(0)), lambda before: _let(_before(starts, most, F.lit(-far)), lambda behind: alone(before, behind)))

    return F.when((F.size(base) > 0) & (F.size(runs) > 0), _let(F.array_sort(F.concat(base, runs)), kept)).otherwise(runs)


def find_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and extra (arrays of start, kind, end, found; ends exclusive, in code points) to the rows of df.

    kind is a place in KINDS. A null text has no spans. Places are counted over the whole text, however long."""
    text_of = F.coalesce(F.col(text), F.lit(""))
    named = df.withColumn("_text", text_of)
    assign = F.when(F.regexp_like("_text", F.lit("(?i)pass|secret|token|api")), _spans(F.col("_text"), ASSIGN, 0)).otherwise(F.array().cast(SPAN))
    value = lambda s: F.regexp_extract(s["found"], ASSIGN, 2)
    named = named.withColumn("base", F.array_sort(F.concat(F.filter(assign, lambda s: F.length(value(s)) >= 6), _spans(F.col("_text"), ACCESS, 1), _spans(F.col("_text"), HEX, 2))))
    named = named.withColumn("_runs", _spans(F.col("_text"), CANDIDATE, 3))
    fresh = _let(F.col("base"), lambda base: _let(F.col("_runs"), lambda runs: _apart(base, runs)))
    extra = F.filter(fresh, lambda s: ~_allowed(s["found"]) & _high_entropy(s["found"]))
    named = named.withColumn("extra", F.when(F.size("_runs") > 0, extra).otherwise(F.array().cast(SPAN)))
    return named.drop("_text", "_runs")


def _said(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(df: DataFrame) -> DataFrame:
    """One row per row of df: doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    A null or empty text has no spans: zero counts, the digest of the empty string. Texts count whole, however long. Other
    columns are ignored, rows that repeat or have no doc_id stay, and an empty table gives no rows."""
    found = find_secrets(common.documents(df))
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(number(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.size("extra").cast("long").alias("n_entropy"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"),
        _said(F.array_sort(F.concat("base", "extra"))).alias("spans"),
    )


def _without(text: Column, spans: Column, mark: str) -> Column:
    """A text with a mark in place of its spans, which come sorted; what is between them is cut from pieces of the text."""
    cut = lambda x, bits, count: F.transform(F.sequence(F.lit(0), count), lambda j: F.substring(x, F.shiftleft(j, bits) + 1, F.lit(1 << bits)))
    pieces = F.flatten(F.transform(cut(text, WIDE, F.shiftright(F.length(text), WIDE)), lambda x: cut(x, PIECE, F.greatest(F.shiftright(F.length(x) - 1, PIECE), F.lit(0)))))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        i, j = F.shiftright(a, PIECE), F.shiftright(b, PIECE)
        at, to = a.bitwiseAND(F.lit((1 << PIECE) - 1)), b.bitwiseAND(F.lit((1 << PIECE) - 1))
        first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
        whole = F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, F.substring(first, at + 1, b - a)).otherwise(F.concat(F.substring(first, at + 1, F.lit(1 << PIECE)), whole, F.substring(last, F.lit(1), to)))

    def joined(pieces: Column, before: Column) -> Column:
        ends = F.transform(spans, lambda s, i: F.struct(F.get(before, i).alias("a"), s["start"].alias("b")))
        kept = F.transform(F.filter(ends, lambda x: x["b"] >= x["a"]), lambda x: F.concat(between(pieces, x["a"], x["b"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), between(pieces, F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text)))

    before = _before(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))
    return _let(pieces, lambda p: _let(before, lambda b: joined(p, b)))


def redact_secrets(df: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The rows of df with every span of text replaced by a mark; overlapping spans become one. Columns stay as they are,
    but n_chars, if there is one, is counted anew on the rows that change. A null text stays null, rows that repeat or have
    no doc_id stay, and an empty table gives no rows."""
    found = find_secrets(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("own"), F.col("text")))
    found = found.withColumn("spans", F.array_sort(F.concat("base", "extra")))
    clean = _let(F.col("spans"), lambda spans: _without(F.col("text"), spans, mark))
    found = found.select("own", (F.size("spans") > 0).alias("changed"), F.when(F.size("spans") > 0, clean).otherwise(F.col("text")).alias("text"))
    own = {c: F.col("own").getField(c) for c in df.columns} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("changed"), F.length("text").cast(df.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return found.select(*(column.alias(c) for c, column in own.items()))
