"""Secret scans by patterns and by a battery of randomness tests, in DataFrame functions only.

Three patterns give the base spans.  The battery looks at other long tokens with a digit: it infers the alphabet a token
is written in, and tests whether its symbols are uniform (chi-squared), whether low and high symbols alternate as chance
would have it (runs), and whether neighbours are independent (serial correlation).  Fisher's method joins the three
p-values.  Random tokens have uniform p-values, words and numbers have low ones; so in each stratum of alphabet and
length, twice the tokens above one half estimates the random ones, and the lowest threshold is taken above which no more
than a tenth of the tokens are expected not to be random.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.support import written

#: Kinds in their order, the pattern of each, the group measured and its least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}"
#: Alphabets in the order in which they are tried.
ALPHABETS = (
    ("digits", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("alnum", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
#: Bins of p, the share of false discoveries allowed, and the p-value below which no token counts as random.
BINS, FALSE_SHARE, LEAST_P = 20, 0.1, 0.05
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,end:int,ord:int,kind:string>>"


def spans_of(text: Column, pattern: str, group: int, least: int, order: int, kind: str) -> Column:
    """Leftmost non-overlapping matches whose group has at least `least` characters, as code-point spans.

    The pieces that split() leaves between the matches and the matches themselves alternate, so their lengths add up to
    every match's place.
    """
    rx = F.lit(pattern)
    pieces = F.split(text, pattern, -1)
    found, inner = F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group))
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), F.zip_with(found, inner, lambda a, b: F.struct(F.length(a).alias("n"), F.length(b).alias("g"), a.alias("s"))), lambda p, m: F.struct(F.length(p).alias("skip"), m["n"].alias("n"), m["g"].alias("g")))
    empty = F.array().cast(_SPAN)
    walk = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("pos"), empty.alias("out")),
        lambda acc, m: F.struct(
            (acc["pos"] + m["skip"] + m["n"]).alias("pos"),
            F.when(m["g"] >= least, F.concat(acc["out"], F.array(F.struct((acc["pos"] + m["skip"]).alias("start"), (acc["pos"] + m["skip"] + m["n"]).alias("end"), F.lit(order).alias("ord"), F.lit(kind).alias("kind"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(F.rlike(text, rx), walk).otherwise(empty)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by a logistic approximation that is within 0.0002."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def alphabet_of(s: Column) -> Column:
    """The name of the first alphabet that holds the token without its padding; null if none does."""
    body = F.rtrim(s, F.lit("="))
    out = F.lit(None).cast("string")
    for name, symbols in reversed(ALPHABETS):
        out = F.when(F.rlike(body, F.lit("^[" + symbols.replace("-", r"\-") + "]+$")), name).otherwise(out)
    return out


def battery(s: Column, kind: Column) -> Column:
    """Joint p-value of the three tests on one token, given its alphabet's name."""
    symbols = F.lit("")
    for name, letters in ALPHABETS:
        symbols = F.when(kind == name, letters).otherwise(symbols)
    body = F.rtrim(s, F.lit("="))
    base = F.struct(symbols.alias("abc"), F.filter(F.split(body, "", -1), lambda c: c != "").alias("chars"))
    # Bound once through a one-element array: a lambda's variable is evaluated once, a Column wherever it stands.
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)

    def tests(b: Column) -> Column:
        xs = F.transform(b["chars"], lambda c: F.call_function("instr", b["abc"], c).cast("double") - 1)
        return let(F.struct(xs.alias("x"), F.length(b["abc"]).cast("double").alias("k"), F.size(b["chars"]).cast("double").alias("n"), b["abc"].alias("abc"), b["chars"].alias("chars")), numbers)

    def numbers(v: Column) -> Column:
        x, k, n = v["x"], v["k"], v["n"]
        squares = F.aggregate(F.transform(F.sequence(F.lit(0), k.cast("int") - 1), lambda c: F.size(F.filter(x, lambda y: y == c)).cast("double")), F.lit(0.0), lambda a, m: a + m * m)
        pairs = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        mean = F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / n
        low = F.size(F.filter(x, lambda y: y < k / 2)).cast("double")
        turns = F.size(F.filter(pairs, lambda p: (p["a"] < k / 2) != (p["b"] < k / 2))).cast("double")
        return let(F.struct(k.alias("k"), n.alias("n"), (squares * k / n - n).alias("chi"), low.alias("low"), turns.alias("turns"), mean.alias("mean"), x.alias("x"), pairs.alias("pairs")), joined)

    def joined(v: Column) -> Column:
        n, df = v["n"], v["k"] - 1
        z1 = (F.pow(F.greatest(v["chi"], F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        mu = 2 * v["low"] * (n - v["low"]) / n
        var = mu * (mu - 1) / F.greatest(n - 1, F.lit(1.0))
        z2 = F.when(var > 0, F.abs(v["turns"] - mu) / F.sqrt(var)).otherwise(F.lit(8.0))
        spread = F.aggregate(v["x"], F.lit(0.0), lambda a, y: a + (y - v["mean"]) * (y - v["mean"]))
        lag = F.aggregate(v["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - v["mean"]) * (p["b"] - v["mean"]))
        z3 = F.when(spread > 0, F.abs(lag / spread + 1 / n) * F.sqrt(n)).otherwise(F.lit(8.0))
        p = [_tail(z1), F.least(F.lit(1.0), 2 * _tail(z2)), F.least(F.lit(1.0), 2 * _tail(z3))]
        half = -sum((F.log(F.greatest(x, F.lit(1e-300))) for x in p), F.lit(0.0))
        return F.exp(-half) * (1 + half + half * half / 2)  # chi-squared tail with six degrees of freedom

    return let(base, tests)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns of every row with base and added: arrays of (start, end, ord, kind), code points, end exclusive.

    base are the spans of KINDS, in order of start, then kind; added are tokens that the battery takes for random and
    that touch no base span, of kind "random".  Null and empty texts have none; repeated rows get theirs each.  Columns
    outside keep do not matter, whatever their names; keep can't hold base, added or names that begin with "__".
    One pass reads the texts; thresholds are a row per stratum, of which there are some hundreds at most.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.array_sort(F.concat(*(spans_of(t, rx, group, least, i, kind) for i, (kind, rx, group, least) in enumerate(KINDS))))
    tokens = spans_of(t, RANDOM, 0, 20, len(KINDS), "random")
    rows = docs.select(*(F.col(k) for k in keep), base.alias("base"), tokens.alias("__tokens"), *([t.alias("__text")] if text not in keep else []))
    body = F.col(text) if text in keep else F.col("__text")
    rows = rows.withColumn("__tokens", F.filter("__tokens", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))
    named = F.transform("__tokens", lambda c: F.struct(c.alias("span"), F.substring(body, c["start"] + 1, c["end"] - c["start"]).alias("s")))
    named = F.transform(named, lambda c: F.struct(c["span"].alias("span"), c["s"].alias("s"), alphabet_of(c["s"]).alias("abc")))
    tested = F.transform(F.filter(named, lambda c: c["abc"].isNotNull()), lambda c: F.struct(c["span"].alias("span"), battery(c["s"], c["abc"]).alias("p"), F.concat(c["abc"], F.lit(":"), F.floor(2 * F.log2(F.length(c["s"]))).cast("string")).alias("stratum")))
    rows = rows.withColumn("__tested", F.when(F.size("__tokens") > 0, tested)).drop("__tokens", "__text")
    rows = written(rows, "secrets")

    # Of each stratum the lowest bin above which few are expected not to be random.
    bins = rows.select(F.explode("__tested").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).alias("bin")).count()
    per = bins.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("m"))
    above = lambda b: F.aggregate(F.sequence(b, F.lit(BINS - 1).cast("long")), F.lit(0).cast("long"), lambda a, i: a + F.coalesce(F.element_at("m", i), F.lit(0)))
    random_above = lambda b: 2 * above(F.lit(BINS // 2).cast("long")) * (1 - b / BINS)
    first = F.filter(F.sequence(F.lit(int(LEAST_P * BINS)).cast("long"), F.lit(BINS - 1).cast("long")), lambda b: random_above(b) >= (1 - FALSE_SHARE) * above(b))
    cuts = per.select("stratum", (F.coalesce(F.get(first, F.lit(0)), F.lit(BINS)) / BINS).alias("cut"))
    cut = cuts.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "cut"))).alias("cuts")).scalar()
    added = F.transform(F.filter("__tested", lambda c: c["p"] >= F.element_at("__cuts", c["stratum"])), lambda c: c["span"])
    rows = rows.withColumn("__cuts", cut).withColumn("added", F.coalesce(added, F.array().cast(_SPAN)))
    return rows.drop("__tested", "__cuts")


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with every maximal run of sorted spans replaced by the mask."""
    walk = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("pos"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["pos"], s["end"]).alias("pos"),
            F.when(s["start"] < a["pos"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["pos"] + 1, s["start"] - a["pos"]), F.lit(mask))).alias("out"),
        ),
    )
    whole = F.element_at(F.transform(F.array(walk), lambda a: F.concat(a["out"], F.substring(text, a["pos"] + 1, F.length(text)))), 1)
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every secret of its texts masked; other columns, null texts and the number of rows stay."""
    names = docs.columns
    plain = docs.toDF(*(f"__column{i}" for i in range(len(names))))  # as docs may have columns named like scan's own
    own = plain.columns[names.index(text)]
    out = scan(plain, own, tuple(plain.columns))
    every = F.array_sort(F.concat("base", "added"))
    return out.withColumn(own, masked(F.col(own), every)).select(*plain.columns).toDF(*names)
