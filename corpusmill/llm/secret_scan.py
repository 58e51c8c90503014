"""Secret scans: fixed patterns, and a battery of randomness tests.

Native: DataFrame functions only. Three patterns give the base spans. Besides,
every run of ``LEAST`` or more letters, digits and + / _ = - is taken as a string
in the encoding its characters speak for (hexadecimal, base32, base64), and tested
for being random in that alphabet: chi-squared uniformity over equal parts of the
alphabet, the number of runs above and below its middle, and serial correlation of
neighbours, combined by Fisher's method into one p-value.

Which strings are not random is decided over the whole corpus, per encoding and
length class (a power of two): Benjamini-Hochberg at ``FALSE_RATE`` over the
class's p-values, so of the strings put aside as ordinary at most that share is
random. p-values are counted in halving steps, by partial sums; the threshold is
the largest step that fulfils the condition. The counts are at most encodings x
lengths x steps. What is not put aside is added to the spans.

Defined cases: null and empty texts have no spans; repeated rows are each
scanned and each counted; equal spans of several kinds are all given; extra
columns are ignored by ``report`` and kept by ``redacted``; an empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import let
from corpusmill.session import cut_lineage

# The base patterns, with the least length of what must be matched.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_KEY = r"(?i)(?:password|passwd|secret|token|api_?key)"
ASSIGN_LEAST = 6
# A run that is long enough is the same as the longest run being long enough.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

LEAST = 24
STRING = r"[A-Za-z0-9+/_=-]{24,}"
FALSE_RATE = 0.05
STEPS = 60
#: encoding: what the string must look like, its alphabet in order
ENCODINGS = {
    "hexadecimal": (r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": (r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": (
        r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+=*$",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    ),
}
KINDS = ["assign", "access", "hex", *(f"random-{e}" for e in ENCODINGS)]
_SPAN = "array<struct<a:long,b:long,m:string>>"


def located(text: Column, pattern: str, present: str | None = None, keep=None) -> Column:
    """Start, end (code points) and text of the leftmost non-overlapping matches.

    One pass gives what lies before each match and one the matches; lengths add
    up to places. Texts in which ``present`` isn't found are not searched."""
    gap = F.lit(rf"\G(?s)(.*?)({pattern})")  # \G: once there is no further match, no other start is tried
    pairs = F.arrays_zip(F.regexp_extract_all(text, gap, F.lit(1)).alias("g"), F.regexp_extract_all(text, gap, F.lit(2)).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        b = a + F.length(x["m"])
        one = F.array(F.struct(a.alias("a"), b.alias("b"), x["m"].alias("m")))
        return F.struct(b.alias("at"), (F.when(keep(x["m"]), F.concat(acc["out"], one)).otherwise(acc["out"]) if keep else F.concat(acc["out"], one)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))
    return F.when(text.rlike(present or pattern), F.aggregate(pairs, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Array of (a, order, b): the base spans, by start and then kind."""
    found = [
        located(text, ASSIGN, ASSIGN_KEY, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
        located(text, ACCESS),
        located(text, HEX),
    ]

    def marked(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["a"].alias("a"), F.lit(kind).alias("kind"), s["b"].alias("b")))

    return F.sort_array(F.concat(*[marked(x, k) for k, x in enumerate(found)]))


def _upper_normal(z: Column) -> Column:
    """P(Z > z), by a logistic curve (within 2e-4)."""
    return 1 / (1 + F.exp(F.least(F.lit(600.0), 1.5976 * z + 0.070566 * z * z * z)))


def p_value(string: Column, alphabet: str) -> Column:
    """The combined p-value of a string for being random over an alphabet."""
    size = len(alphabet)

    def of(x: Column) -> Column:
        n = F.size(x).cast("double")
        parts = F.when(n < 40, 4).when(n < 80, 8).otherwise(16)

        def chi(parts: Column) -> Column:
            expected = n / parts
            in_part = lambda k: F.size(F.filter(x, lambda v: F.floor(v * parts / size) == k))
            total = F.aggregate(F.sequence(F.lit(0), parts - 1), F.lit(0.0), lambda acc, k: acc + F.pow(in_part(k) - expected, 2) / expected)
            free = parts - 1
            z = (F.pow(total / free, 1 / 3) - (1 - 2 / (9.0 * free))) / F.sqrt(2 / (9.0 * free))
            return _upper_normal(z)

        high = F.size(F.filter(x, lambda v: v >= size // 2)).cast("double")
        changes = F.size(F.filter(x, lambda v, i: (i > 0) & ((v >= size // 2) != (F.get(x, i - 1) >= size // 2))))
        mean = 2 * high * (n - high) / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        runs = F.when((high == 0) | (high == n), F.lit(1e-9)).otherwise(2 * _upper_normal(F.abs((changes + 1 - mean) / spread)))

        def correlation(average: Column) -> Column:
            squares = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + (v - average) * (v - average))
            pairs = F.transform(x, lambda v, i: F.when(i > 0, (v - average) * (F.get(x, i - 1) - average)).otherwise(0.0))
            return let(squares, lambda s: F.when(s > 0, F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v) / s))

        average = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v) / n
        serial = let(let(average, correlation), lambda r: F.coalesce(2 * _upper_normal(F.abs(r) * F.sqrt(n)), F.lit(1e-9)))

        half = reduce(lambda a, b: a + b, (-F.log(F.greatest(F.lit(1e-30), p)) for p in (let(parts, chi), runs, serial)))
        return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))  # chi-squared with six degrees of freedom

    places = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(F.filter(places, lambda v: v >= 0), of)


def tested(text: Column) -> Column:
    """Array of (a, kind, b, length, p) of the strings in some encoding."""

    def tests(m: Column) -> Column:
        plain = F.rtrim(m, F.lit("="))
        tried = F.lit(None).cast("struct<kind:int,p:double>")
        for k, (shape, alphabet) in reversed(list(enumerate(ENCODINGS.values(), 3))):
            own = F.lower(plain) if k == 3 else F.translate(plain, "-_", "+/")
            tried = F.when(m.rlike(shape), F.struct(F.lit(k).alias("kind"), p_value(own, alphabet).alias("p"))).otherwise(tried)
        return tried

    judged = F.transform(
        located(text, STRING),
        lambda s: let(
            tests(s["m"]),
            lambda t: F.struct(s["a"].alias("a"), t["kind"].alias("kind"), s["b"].alias("b"), F.floor(F.log2(s["b"] - s["a"])).cast("int").alias("length"), t["p"].alias("p")),
        ),
    )
    return F.filter(judged, lambda s: s["kind"].isNotNull())


def thresholds(found: DataFrame) -> dict[tuple[int, int], float]:
    """Per (kind, length class): strings with a p-value up to this are ordinary.
    From rows with the column ``tested``."""
    strings = found.select(F.explode("tested").alias("s")).select("s.kind", "s.length", F.least(F.lit(STEPS), F.floor(-F.log2(F.greatest(F.col("s.p"), F.lit(1e-30))))).cast("int").alias("step"))
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for r in strings.groupBy("kind", "length", "step").count().collect():  # at most kinds x lengths x steps
        counts.setdefault((r.kind, r.length), {})[r.step] = r["count"]
    out = {}
    for group, by_step in counts.items():
        m = sum(by_step.values())
        below = {k: sum(n for s, n in by_step.items() if s >= k) for k in range(STEPS + 1)}  # p <= 2^-k
        fits = [k for k in range(STEPS + 1) if below[k] and 2.0**-k <= FALSE_RATE * below[k] / m]
        if fits:
            out[group] = 2.0 ** -min(fits)
    return out


def _random(tested_strings: Column, limits: dict[tuple[int, int], float]) -> Column:
    if not limits:
        return F.transform(tested_strings, lambda s: F.struct(s["a"], s["kind"], s["b"]))
    table = F.create_map(*[F.lit(x) for (kind, length), p in limits.items() for x in (kind * 100 + length, p)])
    ordinary = lambda s: s["p"] <= F.coalesce(F.try_element_at(table, s["kind"] * 100 + s["length"]), F.lit(0.0))
    return F.transform(F.filter(tested_strings, lambda s: ~ordinary(s)), lambda s: F.struct(s["a"].alias("a"), s["kind"].alias("kind"), s["b"].alias("b")))


def _named(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["a"], s["b"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_assign, n_access, n_hex, base_sha256, spans."""
    whole = F.coalesce(F.col(text), F.lit(""))
    found = cut_lineage(docs.select(F.col(key).alias("key"), base_spans(whole).alias("base"), tested(whole).alias("tested")))
    limits = thresholds(found)
    every = F.sort_array(F.concat("base", _random(F.col("tested"), limits)))

    def n(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select(F.col("key").alias(key), *map(n, range(3)), F.sha2(_named(F.col("base")), 256).alias("base_sha256"), _named(every).alias("spans"))


def redacted(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """All rows and columns of ``docs``; each secret, overlapping ones together,
    is replaced by "[secret]". ``length`` names a column with the text's number
    of characters, to be kept right."""
    whole = F.coalesce(F.col(text), F.lit(""))
    limits = thresholds(docs.select(tested(whole).alias("tested")))

    def rewrite(spans: Column) -> Column:
        def step(acc: Column, s: Column) -> Column:
            return F.when(s["a"] < acc["at"], F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["b"]).alias("at"))).otherwise(
                F.struct(F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), (s["a"] - acc["at"]).cast("int")), F.lit("[secret]")).alias("out"), s["b"].alias("at"))
            )

        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        made = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, (acc["at"] + 1).cast("int"), F.length(whole))))
        return F.when(F.size(spans) == 0, F.col(text)).otherwise(made)

    spans = F.sort_array(F.concat(base_spans(whole), _random(tested(whole), limits)))
    out = docs.withColumn(text, let(spans, rewrite))
    return out.withColumn(length, F.length(text).cast("long")) if length else out
