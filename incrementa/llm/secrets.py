"""Secret scanning: fixed patterns, and a battery of randomness tests for tokens of unknown make.

Assignments, access keys and long hexadecimal runs are found by pattern. Other long tokens that mix
letters and digits are tested, each over the alphabet of its inferred encoding: chi-squared for
uniform use of the alphabet, runs of one kind of character (a case, digits, signs), and serial
correlation, joined by Fisher's method into one p-value of the hypothesis that the token is random.
Among the distinct tokens of a length class, the Benjamini-Hochberg procedure at that class's level says
which are not random, so that the level bounds the share of random tokens among those dismissed; a
shorter class has a higher level, as its tests tell less apart. What it does not reject is a span of
kind ``random``. Only DataFrame functions are used.

Edge cases: null text is empty; a text without matches has no spans; repeated rows are judged each,
while a token counts once in its class; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from incrementa.llm.common import settle
from incrementa.llm.spans import checked, clear_of, found, named, placed, replaced

#: kinds in the order of listing
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]++",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
#: fixed values: alphabets by encoding, in the order in which they are tried
ALPHABETS = {
    "hexadecimal": "0123456789abcdef",
    "HEXADECIMAL": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "alphanumeric": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
#: first length of a class and its false-discovery level
CLASSES = ((20, 0.05), (24, 0.05), (32, 0.02), (48, 0.01), (64, 0.01))
P_STEPS = 400
_FROM = ALPHABETS["alphanumeric"] + "+/-_"
_TO = "0" * 10 + "A" * 26 + "a" * 26 + "-" * 4


def valid(kind: str, value: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(value, _VALUE, 1)) >= 6
    if kind == "access":
        return F.length(value) >= 20
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text where there is a span, an array of spans for each kind, ``tokens``: candidates outside them)."""
    every = PATTERNS | {"tokens": CANDIDATE}
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *(found(F.col("text"), p).alias(f"m_{k}") for k, p in every.items()))
    rows = rows.select("rid", "doc_id", "text", *(checked(placed(F.col("text"), F.col(f"m_{k}"), p), k, valid).alias(k) for k, p in every.items()))
    mixed = F.filter("tokens", lambda t: t["value"].rlike("[0-9]") & t["value"].rlike("[A-Za-z]"))
    rows = rows.withColumn("tokens", clear_of(mixed, F.concat(*PATTERNS)))
    touched = sum((F.size(k) for k in every), F.lit(0)) > 0
    return settle(rows.select("rid", "doc_id", *every, F.when(touched, F.col("text")).alias("text")), "secrets")


def _share(alphabet: str, power: int) -> float:
    """Chance that ``power`` independent characters of the alphabet are of one kind."""
    kinds = [_TO[_FROM.index(c)] for c in alphabet]
    return sum((kinds.count(c) / len(kinds)) ** power for c in set(kinds))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail of ``z``, by the logistic approximation of the normal distribution."""
    a = F.least(F.abs(z), F.lit(12.0))
    return 2 / (1 + F.exp(1.5976 * a + 0.070565992 * a * a * a))


def battery(tokens: DataFrame) -> DataFrame:
    """(value, encoding, p) of distinct ``tokens(value)``: p of being random over the inferred alphabet."""
    core = F.regexp_replace("value", "=+$", "")
    encoding = F.coalesce(*(F.when(core.rlike(f"^[{a.replace('-', '')}{'-' * ('-' in a)}]+$"), F.lit(n)) for n, a in ALPHABETS.items()), F.lit("base64url"))
    t = tokens.select("value", core.alias("core"), encoding.alias("encoding"))
    alphabet = F.coalesce(*(F.when(F.col("encoding") == n, F.lit(a)) for n, a in ALPHABETS.items()))
    t = t.withColumn("alphabet", alphabet).withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("core").cast("double"))
    t = t.withColumn("v", F.transform(F.split("core", "(?!^)(?!$)"), lambda c: F.instr(F.col("alphabet"), c).cast("double") - 1))
    t = t.withColumn("mean", F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.col("n"))
    square = F.aggregate(F.array_distinct("v"), F.lit(0.0), lambda s, x: s + F.pow(F.size(F.filter(F.col("v"), lambda y: y == x)).cast("double"), 2))
    pairs = F.zip_with(F.slice("v", F.lit(1), F.col("n").cast("int") - 1), F.slice("v", F.lit(2), F.col("n").cast("int") - 1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    kinds = F.split(F.translate("core", _FROM, _TO), "(?!^)(?!$)")
    steady = F.size(F.filter(F.zip_with(F.slice(kinds, F.lit(1), F.col("n").cast("int") - 1), F.slice(kinds, F.lit(2), F.col("n").cast("int") - 1), lambda x, y: x == y), lambda same: same)).cast("double")
    cross = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["x"] - F.col("mean")) * (p["y"] - F.col("mean")))
    spread = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(x - F.col("mean"), 2))
    t = t.select("value", "encoding", "n", "k", square.alias("square"), steady.alias("steady"), cross.alias("cross"), spread.alias("spread"))
    n, k = F.col("n"), F.col("k")
    z_uniform = (k / n * F.col("square") - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    p_uniform = F.when(z_uniform > 0, two_sided(z_uniform) / 2).otherwise(1 - two_sided(z_uniform) / 2)
    # neighbours of one kind of character (lower case, upper case, digit, sign): their number tells that of the runs
    same, thrice = (F.coalesce(*(F.when(F.col("encoding") == name, F.lit(_share(a, power))) for name, a in ALPHABETS.items())) for power in (2, 3))
    var = (n - 1) * same * (1 - same) + 2 * (n - 2) * (thrice - same * same)
    z_runs = (F.col("steady") - (n - 1) * same) / F.sqrt(F.when(var > 0, var).otherwise(1.0))
    p_runs = F.when(var <= 0, 0.5).when(z_runs > 0, two_sided(z_runs) / 2).otherwise(1 - two_sided(z_runs) / 2)
    p_serial = F.when(F.col("spread") > 0, two_sided((F.col("cross") / F.when(F.col("spread") > 0, F.col("spread")).otherwise(1.0) + 1 / (n - 1)) * F.sqrt(n))).otherwise(0.0)
    half = -sum((F.log(F.greatest(p, F.lit(1e-30))) for p in (p_uniform, p_runs, p_serial)), F.lit(0.0))
    return t.select("value", "encoding", "n", F.least(F.lit(1.0), F.exp(-half) * (1 + half + half * half / 2)).alias("p"))


def random_tokens(base: DataFrame) -> DataFrame:
    """(value) of the tokens that their class's procedure does not take for other than random."""
    tokens = base.select(F.explode("tokens.value").alias("value")).distinct()
    tested = battery(tokens)
    cls = sum(((F.col("n") >= first).cast("int") for first, _ in CLASSES), F.lit(-1))
    level = F.coalesce(*(F.when(F.col("cls") == i, F.lit(a)) for i, (_, a) in enumerate(CLASSES)), F.lit(CLASSES[0][1]))
    # p in steps of a tenth of its logarithm, rounded up: as many rows as classes times steps, whatever the corpus
    tested = settle(tested.select("value", cls.alias("cls"), F.greatest(F.lit(-P_STEPS), F.ceil(F.log("p") * 10)).cast("int").alias("step")), "tested")
    steps = tested.groupBy("cls", "step").agg(F.count("*").alias("n"))
    ranked = steps.select("cls", "step", F.sum("n").over(W.partitionBy("cls").orderBy("step")).alias("rank"), F.sum("n").over(W.partitionBy("cls")).alias("m"))
    cut = settle(ranked.where(F.exp(F.col("step") / 10) <= level * F.col("rank") / F.col("m")).groupBy("cls").agg(F.max("step").alias("cut")), "cut")
    return settle(tested.join(cut, "cls", "left").where("cut is null or step > cut").select("value"), "random")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, the spans by kind (``random`` last), ``clean``: the text with secrets masked (null where nothing was found)."""
    base = base_spans(docs)
    placed_tokens = base.select("rid", F.explode("tokens").alias("t")).select("rid", "t.start", "t.end", "t.value")
    random = settle(placed_tokens.join(random_tokens(base), "value").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end", "value"))).alias("random")), "placed")
    rows = base.join(random, "rid", "left").withColumn("random", F.coalesce("random", F.array().cast("array<struct<start:int,end:int,value:string>>")))
    rows = rows.withColumn("spans", listed([*PATTERNS, "random"]))
    return rows.select("doc_id", *PATTERNS, "random", F.when(F.col("text").isNotNull(), replaced(F.col("text"), F.col("spans"), "kind")).alias("clean"))


def listed(kinds: list[str]) -> Column:
    """Spans of all kinds by start, then by place in ``kinds``."""
    return F.array_sort(F.concat(*(named(F.col(k), k, i) for i, k in enumerate(kinds))))


def joined(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then by place in ``kinds``, comma-joined."""
    return F.concat_ws(",", F.transform(listed(kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
