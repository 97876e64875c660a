"""Secret scans: base patterns, and a battery of randomness tests on long tokens.  DataFrame functions only.

A token of at least ``MIN_TOKEN`` characters whose characters mix letters and
digits is taken to be hex, base32, base36 or base64 text.  Three tests ask whether
its symbols look drawn evenly from that alphabet: chi-squared on the symbol counts
(Wilson-Hilferty normal form), runs above and below the middle of the alphabet,
and lag-one serial correlation.  A token that is not random fails one of them, so
non-random tokens are the discoveries, and their false-discovery rate is held at
``ALPHA`` over the corpus by a weighted Benjamini-Hochberg step: a token's p-value
is divided by its length over the mean length, since long tokens give the tests
more power.  Tokens that are not discovered stay as spans of kind ``random``.

The step-up threshold comes from a histogram of the p-values (a tenth of a decade
to a bin, a fixed number of bins), never from a sort of all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let

# Base patterns in the order of their kinds, least length of the group that counts, alphabets.
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}
HAS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
LONG = {"hex": "[0-9a-f]{24,}", "access": "AKIA[A-Z0-9]{16,}"}
TOKEN = "[A-Za-z0-9+/_-]{20,}"
MIN_TOKEN = 20
ALPHA = 0.05
BINS = 100
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", DIGITS + LOWER),
    ("BASE36", "^[0-9A-Z]+$", DIGITS + UPPER),
    ("base64", "^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/]+$", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", "^(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]+$", UPPER + LOWER + DIGITS + "-_"),
)
_SPAN = "array<struct<kind:string,start:int,end:int>>"
_RUN = 256


def match_spans(text: Column, kind: str, pattern: str, keep=None, group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches: matches and the gaps between them alternate, so lengths add up to places.

    They are added up in runs of ``_RUN`` matches, since an array that grows one by one is copied each time.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found

    def place(x: Column) -> Column:
        n = F.size(x["found"])
        length = lambda i: F.length(F.get(x["gaps"], i)) + F.length(F.get(x["found"], i))
        run = lambda c: F.sequence(c * _RUN, F.least((c + 1) * _RUN, n) - 1)
        sizes = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _RUN).cast("int")), lambda c: F.aggregate(run(c), F.lit(0), lambda acc, i: acc + length(i)))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, first, lambda acc, size: F.struct((acc["at"] + size).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")), lambda acc: acc["starts"])

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(x["gaps"], i))
            end = start + F.length(F.get(x["found"], i))
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"))
            keeps = keep(F.get(x["tested"], i)) if keep else F.lit(True)
            return F.struct(end.alias("at"), F.when(keeps, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

        spans = lambda at, c: F.aggregate(run(c), F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), step, lambda acc: acc["spans"])
        return F.flatten(F.transform(starts, spans))

    none = F.array().cast(_SPAN)
    struct = F.struct(found.alias("found"), gaps.alias("gaps"), tested.alias("tested"))
    return let(struct, lambda x: F.when(F.size(x["found"]) == 0, none).otherwise(place(x)))


def base_spans(text: Column) -> Column:
    """Spans of the base kinds by start, then kind in the order of KINDS."""
    none = F.array().cast(_SPAN)
    of = {
        "assign": match_spans(text, "assign", ASSIGN, lambda value: F.length(value) >= LEAST["assign"], group=2),
        "access": match_spans(text, "access", LONG["access"]),
        "hex": match_spans(text, "hex", LONG["hex"]),
    }
    spans = F.concat(*[F.when(text.rlike(HAS[k]), of[k]).otherwise(none) for k in KINDS[:3]])
    return _ordered(spans)


def _ordered(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s["kind"].alias("kind")))
    return F.transform(F.sort_array(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["c"].alias("end")))


def alphabet_of(token: Column) -> Column:
    """The alphabet the token seems written in, or null: letters and digits must both occur."""
    found = F.lit(None).cast("string")
    for _, pattern, alphabet in reversed(ALPHABETS):
        found = F.when(token.rlike(pattern), F.lit(alphabet)).otherwise(found)
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), found)


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the normal distribution (Abramowitz and Stegun 7.1.26)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def p_value(token: Column, alphabet: Column) -> Column:
    """Chance that a random token of this alphabet and length looks as uneven: the least of the three, times three."""

    def battery(x: Column) -> Column:
        n = F.length(x["t"]).cast("double")
        k = F.length(x["a"]).cast("double")
        symbols = F.transform(F.split(x["a"], ""), lambda c: F.pow(F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2)))
        chi = k / n * F.aggregate(symbols, F.lit(0.0), lambda acc, c: acc + c) - n
        df = k - 1
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        places = F.transform(F.split(x["t"], ""), lambda c: F.instr(x["a"], c).cast("double") - (k + 1) / 2)

        def order_tests(v: Column) -> Column:
            high = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + F.when(y > 0, 1.0).otherwise(0.0))
            low = n - high
            pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            runs = F.aggregate(pairs, F.lit(1.0), lambda acc, p: acc + F.when((p["a"] > 0) != (p["b"] > 0), 1.0).otherwise(0.0))
            mean = 2 * high * low / n + 1
            spread = F.sqrt((mean - 1) * (mean - 2) / (n - 1))
            z_runs = F.when(spread > 0, (runs - mean) / spread).otherwise(F.lit(9.0))
            square = F.aggregate(v, F.lit(0.0), lambda acc, y: acc + y * y)
            serial = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["a"] * p["b"])
            z_serial = F.when(square > 0, serial / square * F.sqrt(n)).otherwise(F.lit(9.0))
            return F.least(upper_tail(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_serial)))

        return F.least(F.lit(1.0), 3 * let(places, order_tests))

    return let(F.struct(token.alias("t"), alphabet.alias("a")), battery)


def _meets(spans: Column, s: Column) -> Column:
    """Whether s overlaps one of the spans, which are in order and apart: the last that starts before s ends is found by halving."""
    halve = lambda acc, _: let((acc["low"] + acc["high"] + 1).cast("int"), lambda both: let(F.floor(both / 2).cast("int"), lambda mid: F.when(
        F.get(spans, mid - 1)["start"] < s["end"], F.struct(mid.alias("low"), acc["high"].alias("high"))).otherwise(F.struct(acc["low"].alias("low"), (mid - 1).alias("high")))))
    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(spans).cast("long"))))
    last = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), lambda acc, x: F.when(acc["low"] < acc["high"], halve(acc, x)).otherwise(acc), lambda acc: acc["low"])
    return F.when(F.size(spans) == 0, False).otherwise(F.coalesce(F.get(spans, last - 1)["end"] > s["start"], F.lit(False)))


def _candidates(text: Column, base: Column) -> Column:
    """Array of (start, end, p) of tokens in a known alphabet that touch no base span."""
    spans = match_spans(text, "random", TOKEN)
    of_kind = lambda k: F.filter(base, lambda b: b["kind"] == k).alias(k)
    of = F.struct(*[of_kind(k) for k in KINDS[:3]])
    clear = let(of, lambda own: F.filter(spans, lambda s: ~(_meets(own["assign"], s) | _meets(own["access"], s) | _meets(own["hex"], s))))
    tokens = F.transform(clear, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("t")))
    named = F.filter(F.transform(tokens, lambda s: F.struct(s["start"], s["end"], s["t"], alphabet_of(s["t"]).alias("a"))), lambda s: s["a"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int,p:double>>")
    tested = F.transform(named, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), p_value(s["t"], s["a"]).alias("p")))
    return F.when(text.rlike(TOKEN), tested).otherwise(none)


def discovery_bin(counts: dict[int, int], alpha: float = ALPHA) -> int:
    """Least bin whose tokens are all discovered (p / weight at most 10 ** (-bin / 10)); BINS + 1 if none is."""
    total, so_far, found = sum(counts.values()), 0, BINS + 1
    for b in range(BINS, -1, -1):
        so_far += counts.get(b, 0)
        if so_far and total * 10 ** (-b / 10) / so_far <= alpha:
            found = b
    return found


def find_secrets(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), alpha: float = ALPHA) -> DataFrame:
    """(carried columns, base, spans): arrays of (kind, start, end) in code points, end exclusive.

    The texts are read once: what they hold is checkpointed as spans and p-values,
    and the corpus-wide threshold is then a literal.  Null and empty texts hold
    nothing; repeated rows are judged alike; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(*carry, let(text, lambda t: let(base_spans(t), lambda b: F.struct(b.alias("base"), _candidates(t, b).alias("tokens")))).alias("s"))
    found = checkpointed(found.select(*carry, "s.base", "s.tokens"))
    tokens = found.select(F.explode("tokens").alias("t")).select((F.col("t.end") - F.col("t.start")).alias("n"), F.col("t.p").alias("p"))
    mean = tokens.agg(F.avg("n").alias("n")).first()["n"] or 1.0
    bin_of = lambda p, n: F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-10 * F.log10(F.greatest(p * mean / n, F.lit(1e-30)))).cast("int")))
    counts = {r["b"]: r["count"] for r in tokens.groupBy(bin_of(F.col("p"), F.col("n")).alias("b")).count().collect()}
    cut = discovery_bin(counts, alpha)
    random = F.filter(F.col("tokens"), lambda t: bin_of(t["p"], t["end"] - t["start"]) < cut)
    more = F.transform(random, lambda t: F.struct(F.lit("random").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select(*carry, "base", _ordered(F.concat("base", more)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
