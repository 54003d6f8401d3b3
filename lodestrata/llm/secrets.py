"""Operator 1, secret scans: base patterns, and a randomness test battery with false-discovery control.

Native: built-in functions only. Candidates for the battery are runs of token characters, without what base spans cover,
and, as a slash is both a symbol of base 64 and a separator of paths, also the pieces of a run between slashes; both
readings are tested, and of a run and its pieces that are found random the run is reported. Runs whose short pieces are
words are paths. Each is taken for the narrowest encoding that it fits (hexadecimal, base 32, base 64), and four tests compare it with that
encoding's uniform random strings: chi-squared of the symbol counts, the same of the counts in quarters of the alphabet,
runs above and below the middle of the alphabet, and the lag-1 correlation of symbol values. Each test gives a p-value of
non-randomness; Bonferroni's minimum joins them. The Benjamini-Hochberg rule, with every string counted by its length,
says which candidates are not random; RATE bounds the share of random strings among those, not the share of others among
the reported. The rest is reported as ``random`` if it is long enough for the tests to have told: if the plainest strings
of its encoding (digits for hexadecimal, text in one case for the others) of that length would have been found out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table
from .spans import count_of, joined, let, matches, ordered, running

NAME = "op1_secret_scan"

ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}+"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
LEAST = 20
#: Between slashes, words and numbers of so many symbols in all mark a path; random symbols do that once in 200 times.
PLAIN = 6
WORD_OR_NUMBER = "^(?:[A-Za-z]?[a-z]*|[0-9]+)$"
KINDS = ["assign", "access", "hex", "random"]

#: False-discovery rate of calling a string non-random; bins of -log10 p by which the rule is evaluated.
RATE = 0.05
BINS = 400
PER_DECADE = 20
#: Name, pattern, alphabet; and of the plainest strings the chance that two symbols agree, and that their quarters do.
ENCODINGS = [
    ("hex", r"^[0-9a-fA-F]+$", "0123456789abcdef", 0.1, 0.36),
    ("base32", r"^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.065, 0.31),
    ("base64", r"", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.065, 0.50),
]
TESTS = 4


def normal_tail(z: Column) -> Column:
    """P(N > z): Zelen and Severo's polynomial, error below 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, upper).otherwise(1 - upper)


def chi2_tail(x: Column, df: Column) -> Column:
    """P(chi-squared with df degrees > x), Wilson and Hilferty's cube root."""
    v = 2.0 / (9.0 * df)
    return normal_tail((F.pow(x / df, F.lit(1 / 3)) - (1 - v)) / F.sqrt(v))


def _chi2(squares: Column, n: Column, cells: Column) -> Column:
    """The chi-squared statistic of counts in equally likely cells, from the sum of their squares."""
    return F.greatest(squares * cells / n - n, F.lit(0.0))


def battery(candidates: DataFrame) -> DataFrame:
    """Add ``encoding, p, told, n`` to rows with a ``value``: the smaller p, the less it looks like random symbols.

    ``told`` is the p that the encoding's plainest strings of ``n`` symbols would have on average.
    """
    core = F.translate(F.rtrim("value", F.lit("=")), "-_", "+/")  # both base-64 alphabets are one
    pick = F.struct(*[F.lit(x).alias(c) for c, x in zip(("name", "symbols", "same", "near"), (ENCODINGS[-1][0], *ENCODINGS[-1][2:]), strict=True)])
    for kind, pattern, *rest in reversed(ENCODINGS[:-1]):
        one = F.struct(*[F.lit(x).alias(c) for c, x in zip(("name", "symbols", "same", "near"), (kind, *rest), strict=True)])
        pick = F.when(F.regexp_like(core, F.lit(pattern)), one).otherwise(pick)
    rows = candidates.withColumn("e", pick).withColumn("k", F.length("e.symbols").cast("double"))
    rows = rows.withColumn("symbols", F.split(F.when(F.col("e.name") == "hex", F.lower(core)).otherwise(core), ""))
    rows = rows.withColumn("v", F.transform("symbols", lambda c: F.instr(F.col("e.symbols"), c).cast("double") - (F.col("k") + 1) / 2))
    rows = rows.withColumn("n", F.size("v").cast("double"))
    # runs, products of neighbours and counts of quarters in one pass over the string, and the symbols' counts in another
    names = ("last", "high", "runs", "product", "q1", "q2", "q3")
    start = F.struct(*[F.lit(1.0 if c == "runs" else 0.0).alias(c) for c in names])
    one = lambda c: c.cast("double")

    def step(a: Column, x: Column) -> Column:
        quarter = F.floor((x + F.col("k") / 2) * 4 / F.col("k"))
        new = (
            x,
            a["high"] + one(x > 0),
            a["runs"] + one((a["last"] != 0) & ((a["last"] > 0) != (x > 0))),
            a["product"] + a["last"] * x,
            *[a[f"q{i}"] + one(quarter == i) for i in (1, 2, 3)],
        )
        return F.struct(*[y.alias(c) for c, y in zip(names, new, strict=True)])

    text = F.array_join("symbols", "")
    squares = F.aggregate(F.array_distinct("symbols"), F.lit(0.0), lambda a, c: a + F.pow(F.length(text) - F.length(F.replace(text, c, F.lit(""))), F.lit(2.0)))
    rows = rows.withColumn("w", F.aggregate("v", start, step)).withColumn("squares", squares)
    n, k, high, q = F.col("n"), F.col("k"), F.col("w.high"), [F.col(f"w.q{i}") for i in (1, 2, 3)]
    quarters = sum((x * x for x in q), F.pow(n - q[0] - q[1] - q[2], F.lit(2.0)))
    rows = rows.withColumn("mean", 1 + 2 * high * (n - high) / n)
    spread = F.sqrt(F.greatest((F.col("mean") - 1) * (F.col("mean") - 2) / (n - 1), F.lit(1e-9)))
    rows = rows.withColumn("z1", F.abs(F.col("w.runs") - F.col("mean")) / spread)
    rows = rows.withColumn("z2", F.abs(F.col("w.product")) / (F.sqrt(n - 1) * ((k * k - 1) / 12)))
    four = F.lit(4.0)
    p_chi = F.least(chi2_tail(_chi2(F.col("squares"), n, k), k - 1), chi2_tail(_chi2(quarters, n, four), four - 1))
    p_runs = F.when((high == 0) | (high == n), F.pow(F.lit(0.5), n - 1)).otherwise(2 * normal_tail(F.col("z1")))
    p = F.least(F.lit(1.0), TESTS * F.least(p_chi, p_runs, 2 * normal_tail(F.col("z2"))))
    plain = lambda agree, cells: chi2_tail(_chi2(n + n * (n - 1) * agree, n, cells), cells - 1)
    told = F.least(F.lit(1.0), TESTS * F.least(plain(F.col("e.same"), k), plain(F.col("e.near"), four)))
    return rows.select(*candidates.columns, F.col("e.name").alias("encoding"), p.alias("p"), told.alias("told"), "n")


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * PER_DECADE), F.lit(BINS - 1)).cast("int")


def threshold(tested: DataFrame, rate: float = RATE) -> int:
    """Bin of -log10 p from which candidates are rejected as non-random: weighted Benjamini-Hochberg over all candidates.

    ``tested`` has ``p`` and ``n``. P-values are taken at the lower edge of their bin's significance, so the rule is
    exact for them; only the histogram, BINS rows at most, comes to the driver.
    """
    rows = tested.groupBy(_bin(F.col("p")).alias("b")).agg(F.sum("n").alias("w")).collect()
    total = sum(r["w"] for r in rows)
    seen, found = 0.0, BINS
    for r in sorted(rows, key=lambda r: -r["b"]):
        seen += r["w"]
        if 10 ** (-r["b"] / PER_DECADE) <= rate * seen / total:
            found = r["b"]
    return found


def scan(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` of every document.

    Base spans are the matches of the three patterns that pass their length rules; ``random`` spans are added where the
    battery finds a random string of LEAST or more code points outside all base spans. Positions are code points, ends
    exclusive. A null text counts as empty and has no spans; null and repeated ids pass through, extra columns are
    ignored, an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    value = lambda m: F.regexp_extract(m, ASSIGN_VALUE, 1)
    base = F.concat(
        matches(text, ASSIGN, "assign", lambda m: F.length(value(m)) >= 6),
        matches(text, ACCESS, "access", lambda m: F.length(m) >= 20),
        matches(text, HEX, "hex", lambda m: F.length(m) >= 24),
    )
    more = matches(text, CANDIDATE, "random", lambda m: F.lit(True))
    found = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", ordered(base, KINDS).alias("base"), more.alias("more"))
    found = durable(found)
    runs = found.where(F.size("more") > 0).select("rid", F.explode(F.flatten(F.transform("more", _outside))).alias("c"))
    strings = runs.select("rid", F.struct("c.start", "c.end").alias("run"), F.explode(_readings(F.col("c"))).alias("s"))
    tested = durable(battery(strings.select("rid", "run", "s", F.col("s.value").alias("value"))).select("rid", "run", "s", "encoding", "p", "told", "n"))
    cut = threshold(tested, rate)
    random = tested.where((_bin(F.col("p")) < cut) & (_bin(F.col("told")) >= cut))
    whole = F.max(F.when((F.col("s.start") == F.col("run.start")) & (F.col("s.end") == F.col("run.end")), F.col("s")))
    random = random.groupBy("rid", "run").agg(F.collect_list("s").alias("parts"), whole.alias("whole"))
    random = random.groupBy("rid").agg(F.flatten(F.collect_list(F.when(F.col("whole").isNull(), F.col("parts")).otherwise(F.array("whole")))).alias("extra"))
    out = found.join(random, "rid", "left").withColumn("extra", F.coalesce("extra", F.slice("base", 1, 0)))
    return out.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]],
        F.size("extra").cast("long").alias("n_random"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(ordered(F.concat("base", "extra"), KINDS)).alias("spans"),
    )


def _outside(c: Column) -> Column:
    """The parts of a candidate between the base spans that touch it, of LEAST code points or more."""
    over = F.filter("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    starts = F.concat(F.array(c["start"]), F.transform(over, lambda b: b["end"]))
    ends = F.concat(F.transform(over, lambda b: b["start"]), F.array(c["end"]))
    parts = F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), F.lit("random").alias("kind"), z.alias("end"), F.substring(c["value"], a - c["start"] + 1, z - a).alias("value")))
    # spans may lie within each other; what still overlaps one is none
    return F.filter(parts, lambda p: (p["end"] - p["start"] >= LEAST) & ~F.exists(over, lambda b: (b["start"] < p["end"]) & (b["end"] > p["start"])))


def _readings(c: Column) -> Column:
    """What may be a key in a run of token characters: the run, and its pieces of LEAST code points or more between slashes.

    The run is a path, and its pieces are all that may, if what is shorter are words or numbers of PLAIN symbols in all.
    """

    def pieces(parts: Column) -> Column:
        ends = running(F.transform(parts, lambda v: F.length(v) + 1))
        placed = F.zip_with(
            parts, ends, lambda v, e: F.struct((c["start"] + e - 1 - F.length(v)).alias("start"), c["kind"].alias("kind"), (c["start"] + e - 1).alias("end"), v.alias("value"))
        )
        return F.filter(placed, lambda x: F.length(x["value"]) >= LEAST)

    short = F.filter(F.split(c["value"], "/"), lambda v: (F.length(v) > 0) & (F.length(v) < LEAST))
    words = let(short, lambda x: (F.length(F.array_join(x, "")) >= PLAIN) & F.forall(x, lambda v: F.regexp_like(v, F.lit(WORD_OR_NUMBER))))
    whole = F.when(words, F.slice(F.array(c), 1, 0)).otherwise(F.array(c))
    return F.array_distinct(F.concat(whole, let(F.split(c["value"], "/"), pieces)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    return scan(table(spark, sf_dir, "documents"))
