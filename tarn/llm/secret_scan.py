"""Secret scans: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Patterns find `assign`, `access` and `hex` spans. The battery judges every run of 20 or more characters of
[A-Za-z0-9+/_-]: an encoding is inferred (hex, base32 and base36 of one case, with -, _ and / as separators that don't count;
else base64; folded32 is base32 of lower case or letters only, where prose of one case is found), and the run is tested for
 - uniformity: Pearson's chi-squared over the alphabet of the encoding, which has k letters;
 - runs: z of Wald and Wolfowitz, above and below the middle of the alphabet;
 - serial correlation at lag 1, as z.
The statistic is the sum of chi-squared and the squares of both z, some k + 1 for random text, and more for words, the more
the longer. Its null distribution, `no secret`, is simulated: SIMULATED runs of words in the forms that identifiers, paths
and dates have go through the same battery. For each encoding the cube root of statistic / (k + 1), which is nearly normal,
is fitted as a line in the root of the length, and the lower tail of the residuals is the one p-value of the three tests.
The Benjamini-Hochberg rule at RATE then holds the share of false discoveries within each stratum of length, so that the
many short runs don't lend their threshold to the few long ones. P-values enter it as whole numbers -10 log10 p, at most
MAX_SCORE, counted per stratum: a table of bounded size however large the corpus is.

All of it is built-in expressions. Texts are read once; what goes on (spans and scores) is staged.

Defined results: a null text is empty; empty texts have no spans and the checksum of the empty string. Spans count code
points, end exclusive. Long texts are read whole, in time nearly in proportion to their matches, equal rows get equal results, extra columns are not read, an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, prefix_sums, stage_table, text_of

# The base patterns.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more characters
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more characters

RUN = r"[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "folded32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
SIMULATED = 8000
RATE = 0.01
MAX_SCORE = 400
#: z of a test that a run of one kind of letters does not allow.
DEGENERATE = 9.0
STRATA = (24, 32, 40, 48, 64, 96, 128, 256, 1024)
# Common words of four languages, from which the null distribution is simulated.
WORDS = """
the and for with that this from have not you are was all can one out about time people year good some could them other than
then now look only come over think also back after use two how our work first well way even new want because any give day most
house garden report music travel market local history international home page search contact online service info product news
help user data system file index image video account public version project center school water family business company
und der die das ist nicht mit auf eine auch werden aus bei nach wie noch nur oder haben kann wird sind einen unter zeit jahr
les des une est pour dans par sur pas plus avec tout faire leur bien aussi comme mais nous vous
los las por con para como pero sus este entre cuando todo esta hasta desde nos donde tiempo
""".split()
KINDS = ("assign", "access", "hex", "random")


def _found(text: Column, pattern: str) -> Column:
    """Matches as (start, match), in code points. The text between matches gives the places."""
    none = F.array().cast("array<struct<start:int,match:string>>")

    def placed(s: Column) -> Column:
        length = lambda name, k: F.length(F.element_at(s[name], k + 1))
        sizes = F.transform(s.matches, lambda m, k: length("between", k) + F.length(m))
        return let(prefix_sums(sizes), lambda before: F.transform(s.matches, lambda m, k: F.struct((F.element_at(before, k + 1) + length("between", k)).alias("start"), m.alias("match"))))

    parts = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("between"))
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (x.start + F.length(x["match"])).alias("end")))


def _listed(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s.kind), s.start, s.end)), ",")


def normal_tail(z: Column) -> Column:
    """Lower tail of the standard normal, by a logistic approximation that is monotone over all z."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), -(1.5976 * z + 0.070566 * z * z * z))))


def _bare(run: Column) -> Column:
    """The run without separators."""
    return F.translate(run, "-_/", "")


def _encoding(run: Column) -> Column:
    bare = _bare(run)
    out = F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$") & bare.rlike("[2-7].*[2-7]"), "base32")
    return out.when(bare.rlike("^(?:[A-Z2-7]+|[a-z2-7]+)$"), "folded32").when(bare.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$"), "base36").otherwise("base64")


def battery(run: Column) -> Column:
    """Struct of encoding, n (letters), uniform (chi-squared), runs and serial (z), and k (size of the alphabet)."""
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda acc, x: acc + f(x))

    def setting(encoding: Column) -> Column:
        pick = lambda values: F.when(encoding == "hex", values["hex"]).when(encoding == "base32", values["base32"]).when(encoding == "folded32", values["folded32"]).when(encoding == "base36", values["base36"]).otherwise(values["base64"])
        letters = pick({k: F.lit(v) for k, v in ALPHABETS.items()})
        body = pick({"hex": F.lower(_bare(run)), "base32": _bare(run), "folded32": F.upper(_bare(run)), "base36": F.upper(_bare(run)), "base64": F.translate(run, "-_", "+/")})
        return F.struct(encoding.alias("encoding"), letters.alias("letters"), body.alias("body"), F.length(letters).cast("double").alias("k"), F.length(body).cast("double").alias("n"))

    def uniform(s: Column) -> Column:
        squares = total(F.split(s.letters, ""), lambda c: F.pow(s.n - F.length(F.replace(s.body, c, F.lit(""))), F.lit(2.0)))
        return F.when(s.n > 0, s.k / s.n * squares - s.n).otherwise(F.lit(0.0))

    def sums(s: Column) -> Column:
        values = F.transform(F.split(s.body, ""), lambda c: F.instr(s.letters, c).cast("double"))

        def one_pass(v: Column) -> Column:
            pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            return let(
                pairs,
                lambda p: F.struct(
                    total(v, lambda x: (x > s.k / 2).cast("double")).alias("upper"),
                    total(p, lambda x: ((x.a > s.k / 2) != (x.b > s.k / 2)).cast("double")).alias("changes"),
                    total(v, lambda x: x).alias("sum"),
                    total(v, lambda x: x * x).alias("squares"),
                    total(p, lambda x: x.a * x.b).alias("products"),
                    (F.element_at(v, 1) + F.element_at(v, -1)).alias("ends"),
                ),
            )

        return let(values, one_pass)

    def tested(s: Column) -> Column:
        def with_sums(t: Column) -> Column:
            both = 2 * t.upper * (s.n - t.upper)
            z_runs = F.when(both > s.n, (t.changes - both / s.n) / F.sqrt(both * (both - s.n) / (s.n * s.n * (s.n - 1)))).otherwise(F.lit(DEGENERATE))
            mean = t.sum / s.n
            spread = t.squares - s.n * mean * mean
            lagged = t.products - mean * (2 * t.sum - t.ends) + (s.n - 1) * mean * mean
            z_serial = F.when(spread > 1e-9, (lagged / spread + 1 / s.n) * F.sqrt(s.n)).otherwise(F.lit(DEGENERATE))
            return F.struct(s.encoding.alias("encoding"), s.n.alias("n"), s.k.alias("k"), uniform(s).alias("uniform"), z_runs.alias("runs"), z_serial.alias("serial"))

        return let(sums(s), with_sums)

    return let(let(_encoding(run), setting), tested)


def _root(t: Column) -> Column:
    """The cube root of the statistic over its mean for random text."""
    return F.cbrt((t.uniform + t.runs * t.runs + t.serial * t.serial) / (t.k + 1))


def simulated_runs(spark: SparkSession, runs: int = SIMULATED, words: list[str] | None = None, seed: int = 1) -> DataFrame:
    """(run): words that stand together in the forms of identifiers, paths and dates, 20 or more characters long."""
    pool = F.split(F.lit(" ".join(words or WORDS)), " ")
    draw = lambda what, i, n: F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id"), i), F.lit(n)).cast("int")
    one = F.lit(1)
    chosen = F.transform(F.sequence(one, draw("size", one, 12) + 3), lambda i: F.element_at(pool, draw("word", i, len(words or WORDS)) + 1))
    numbered = lambda every, numbers: F.array_join(F.transform("words", lambda w, i: F.when(F.pmod(i, F.lit(every)) == 1, F.concat(w, numbers(i))).otherwise(w)), "")
    two = lambda what, i, n: F.lpad((draw(what, i, n) + 1).cast("string"), 2, "0")
    dates = F.array_join(F.transform(F.slice("words", F.lit(1), F.greatest(F.size("words") / 2, F.lit(2)).cast("int")), lambda w, i: F.concat_ws("-", (draw("year", i, 41) + 1990).cast("string"), two("month", i, 12), two("day", i, 28))), "-")
    camel = F.replace(F.initcap(F.array_join("words", " ")), F.lit(" "), F.lit(""))
    forms = [
        F.array_join("words", ""),
        F.array_join("words", "-"),
        F.upper(F.array_join("words", "_")),
        camel,
        F.array_join("words", "/"),
        F.concat(camel, (draw("number", one, 2030) + 1).cast("string")),
        numbered(4, lambda i: draw("counter", i, 100).cast("string")),
        F.upper(numbered(3, lambda i: (draw("digit", i, 6) + 2).cast("string"))),
        dates,
    ]
    form = F.lit(None).cast("string")
    for k, f in enumerate(forms):
        form = F.when(F.pmod("id", F.lit(len(forms))) == k, f).otherwise(form)
    return spark.range(runs).select("id", chosen.alias("words")).select(form.alias("run")).filter(F.length("run") >= 20)


#: The null distribution by encoding: (intercept, slope, deviation). It depends on nothing but the constants above.
_null: dict[str, tuple[float, float, float]] = {}


def null_distribution(spark: SparkSession) -> dict[str, tuple[float, float, float]]:
    """Simulated once in a driver; a row for each encoding comes back."""
    if not _null:
        tested = simulated_runs(spark).select(battery(F.col("run")).alias("t")).select("t.encoding", _root(F.col("t")).alias("y"), F.sqrt("t.n").alias("x"))
        fit = tested.groupBy("encoding").agg(F.regr_intercept("y", "x").alias("a"), F.regr_slope("y", "x").alias("b"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"), F.regr_sxx("y", "x").alias("sxx"), F.count("y").alias("n"))
        _null.update({r["encoding"]: (r["a"], r["b"], ((r["syy"] - r["sxy"] ** 2 / r["sxx"]) / r["n"]) ** 0.5) for r in fit.collect()})
    return _null


def score(run: Column, null: dict[str, tuple[float, float, float]]) -> Column:
    """-10 log10 of the p-value of `no secret`, 0 to MAX_SCORE."""

    def of(t: Column) -> Column:
        z = F.lit(99.0)
        for encoding, (a, b, deviation) in null.items():
            z = F.when(t.encoding == encoding, (_root(t) - (a + b * F.sqrt(t.n))) / deviation).otherwise(z)
        return let(z, lambda x: F.floor(F.least(F.lit(float(MAX_SCORE)), -10 * F.log10(normal_tail(x)))).cast("int"))

    return F.when(F.length(_bare(run)) > 1, let(battery(run), of)).otherwise(F.lit(0))


def stratum(length: Column) -> Column:
    out = F.lit(len(STRATA))
    for k in reversed(range(len(STRATA))):
        out = F.when(length < STRATA[k], k).otherwise(out)
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Return doc_id, base spans and candidate runs with their scores, one row per document, staged."""
    text = text_of(text_col)
    null = null_distribution(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    assign = F.filter(_found(F.col("text"), ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 1)) >= 6)
    rows = rows.select("doc_id", assign.alias("assign"), _found(F.col("text"), ACCESS).alias("access"), _found(F.col("text"), HEX).alias("hex"), _found(F.col("text"), RUN).alias("runs"))
    return stage_table(
        rows.select(
            "doc_id",
            *(_spans(F.col(k), k).alias(k) for k in KINDS[:3]),
            F.transform("runs", lambda x: F.struct(x.start.alias("start"), (x.start + F.length(x["match"])).alias("end"), score(x["match"], null).alias("score"))).alias("runs"),
        ),
        "secret-spans",
    )


def thresholds(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The least score that counts as a discovery, for each stratum of length that has any. At most
    len(STRATA) + 1 rows of MAX_SCORE + 1 counts come to the driver's plan, one row per stratum to the driver."""
    runs = scanned.select(F.explode("runs").alias("r")).select(stratum(F.col("r.end") - F.col("r.start")).alias("stratum"), F.col("r.score").alias("score"))
    counts = runs.groupBy("stratum", "score").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("stratum")
    at_least = F.sum("n").over(whole.orderBy(F.desc("score")))  # runs with a p-value as small
    passed = counts.select("stratum", "score", at_least.alias("rank"), F.sum("n").over(whole).alias("total")).filter(F.pow(F.lit(10.0), -F.col("score") / 10) <= rate * F.col("rank") / F.col("total"))
    return {r["stratum"]: r["least"] for r in passed.filter("score > 0").groupBy("stratum").agg(F.min("score").alias("least")).collect()}


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """Return doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random."""
    scanned = scan(docs, id_col, text_col)
    least = thresholds(scanned, rate)
    kept = F.filter("runs", lambda r: _at_least(r, least))
    random = F.transform(kept, lambda r: F.struct(r.start.alias("start"), F.lit(KINDS.index("random")).alias("kind"), r.end.alias("end")))
    base = F.concat("assign", "access", "hex")
    return scanned.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.concat(base, random)).alias("spans"),
        F.size(kept).cast("long").alias("n_random"),
    )


def _at_least(r: Column, least: dict[int, int]) -> Column:
    out, of = F.lit(False), stratum(r.end - r.start)
    for k, v in least.items():
        out = out | ((of == k) & (r.score >= v))
    return out
