"""Secret scans: known forms by pattern, unknown ones by a battery of randomness tests.

Base spans are matches of three patterns (``BASE``). Beside them every run of encoding
characters (``TOKEN``) is tested, DataFrame functions only:

1. The smallest encoding whose alphabet holds the token is inferred (``ENCODINGS``).
2. Battery, per encoding: chi-squared uniformity over the alphabet (two-sided, by the cube
   root of Wilson and Hilferty), Wald-Wolfowitz runs of codes above and below the middle of
   the alphabet, and the serial correlation of neighbouring codes. Fisher's sum of the three
   gives the probability that random characters fare as badly; under ``reject`` the token is
   no secret. Words, dates and counted-up ids fail here where they are long enough.
3. Against written text: repeats of letters, and changes between small letters, capitals and
   digits, have an expected number and a spread that follow from the token's length and from
   all tokens of word shape in the table (a prior stands in where there are few). Fisher's sum
   of both gives the probability that written text of that length looks as random. Short
   tokens cannot reach small values, so length counts by itself.
4. Benjamini and Hochberg's step-up, at ``false_discoveries``, inside each length class over all
   tested tokens, from a histogram of the logarithms of 3 (classes x bins rows, a fixed bound).

Tokens that pass 2 and 4 and overlap no base span become spans of kind ``random``.

Positions are code points, ends exclusive: a text is split at a pattern's matches, and running
sums of the pieces and matches of one document give their places.

Defined cases: a null text is empty; repeated rows and ids are separate documents; documents
without spans are listed with zeros, an empty ``spans`` and the hash of the empty string; long
texts and tokens count whole; an empty table gives no rows; columns of ``docs`` other than doc_id
and text are ignored, whatever their names."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, require

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Kind: pattern, group that carries the secret, its least length. A match whose group is shorter is dropped.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}
KINDS = [*BASE, "random"]
#: Runs of encoding characters, base64 padding included.
TOKEN = "[A-Za-z0-9+/_-]{16,}={0,2}"
#: Encoding and alphabet, the first that holds a token counts.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + _LOWER[:6],
    "hex_upper": _DIGITS + _UPPER[:6],
    "base32": "234567" + _UPPER,
    "base36": _DIGITS + _LOWER,
    "base36_upper": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _DIGITS + _UPPER + _LOWER + "+/",
    "base64url": _DIGITS + _UPPER + _LOWER + "-_",
}
WORDS = "^([A-Z]?[a-z]+|[A-Z]+)([+/_-]([A-Z]?[a-z]+|[A-Z]+))*$"
#: Written text where a table has few words: chances that two and three letters agree, and of a change of class.
TWO_AGREE, THREE_AGREE, CHANGE = 0.066, 0.0056, 0.1
PRIOR = 10_000
BINS_A_NAT, LAST_BIN = 8, 800
LAST_CLASS = 40


@dataclass(frozen=True)
class SecretParams:
    #: Battery probabilities under this are no random characters; so many true ones are lost.
    reject: float = 0.001
    false_discoveries: float = 0.01


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """The matches of a pattern: structs of kind, the code points before it since the last match, its own, whether it is long enough, and a token's characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    secrets = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else matches
    both = F.zip_with(pieces, matches, lambda piece, match: F.struct(F.length(piece).alias("gap"), match.alias("match")))

    def item(x: Column, secret: Column) -> Column:
        token = F.rtrim(secret, F.lit("=")) if kind == "random" else F.lit(None).cast("string")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            x["gap"].cast("long").alias("gap"),
            F.length(x["match"]).cast("long").alias("size"),
            (F.length(secret) >= least).alias("long_enough"),
            token.alias("token"),
        )

    found = F.zip_with(both, secrets, item)
    return F.when(text.rlike(pattern), found).otherwise(F.slice(found, 1, 0))


def _items(docs: DataFrame) -> DataFrame:
    """One row per match of any pattern, in the text's order per kind, and one with a null kind for a document without any; row numbers the documents."""
    text = F.coalesce("text", F.lit(""))
    # [0-9a-f]{16,} and AKIA[A-Z0-9]{14,} find just the long enough matches: a shorter run holds no longer one
    bounded = {"access": "AKIA[A-Z0-9]{14,}", "hex": "[0-9a-f]{16,}"}
    arrays = [_found(text, kind, bounded.get(kind, pattern), group, least) for kind, (pattern, group, least) in BASE.items()]
    arrays.append(_found(text, "random", TOKEN, 0, 0))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.concat(*arrays).alias("items"))
    return rows.select("doc_id", "row", F.posexplode_outer("items").alias("place", "item")).select("doc_id", "row", "place", "item.*")


def _ln_erfc(x: Column) -> Column:
    """ln erfc(x) for x >= 0 by the rational form of Chebyshev fit, relative error 1.2e-7 (fixed values)."""
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    t = F.lit(1.0) / (F.lit(1.0) + x / 2)
    return F.log(t) - x * x + reduce(lambda inner, a: F.lit(a) + t * inner, reversed(terms[:-1]), F.lit(terms[-1]))


def _two_sided(z: Column) -> Column:
    """ln of the normal probability of a value at least as far from zero."""
    return _ln_erfc(F.abs(z) / 2**0.5)


def _upper(z: Column) -> Column:
    """ln of the normal probability of a value at least as large."""
    tail = _ln_erfc(F.abs(z) / 2**0.5) - F.log(F.lit(2.0))
    return F.when(z >= 0, tail).otherwise(F.log1p(-F.exp(tail)))


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + f(x))


def _neighbours(values: Column, f) -> Column:
    """Sum of f over neighbouring values."""
    n = F.size(values) - 1
    return _sum(F.zip_with(F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n), f), lambda x: x)


def battery(items: DataFrame) -> DataFrame:
    """Adds, where token is not null: encoding, n, words (word shape), ln_random (ln probability of the battery),
    letters, pairs and triples of equal letters, steps between letters or digits and changes of class among them."""
    token = F.col("token")
    fits = lambda a: token.rlike("^[" + a.replace("-", "\\-") + "]+$")
    name = F.coalesce(*(F.when(fits(a), F.lit(e)) for e, a in ENCODINGS.items()))
    alphabet = F.coalesce(*(F.when(F.col("encoding") == e, F.lit(a)) for e, a in ENCODINGS.items()))
    out = items.withColumn("encoding", name).withColumn("alphabet", alphabet).withColumn("n", F.length("token"))
    k, n, df = F.length("alphabet"), F.col("n"), (F.length("alphabet") - 1).cast("double")
    counted = lambda text, symbols: F.transform(F.split(symbols, ""), lambda s: (F.length(text) - F.length(F.replace(text, s))).cast("double"))
    codes = F.transform(F.split("token", ""), lambda c: F.instr(F.col("alphabet"), c).cast("double"))
    out = out.withColumn("codes", codes)
    out = out.withColumn("chi", k / n * _sum(counted(token, F.col("alphabet")), lambda c: c * c) - n)
    root = F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / df, F.lit(1 / 3))
    chi = (root - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    high = _sum(F.col("codes"), lambda c: (c > k / 2).cast("double"))
    low = n - high
    expected = 2 * high * low / n + 1
    spread = (expected - 1) * (expected - 2) / (n - 1)
    turns = 1 + _neighbours(F.col("codes"), lambda a, b: ((a > k / 2) != (b > k / 2)).cast("double"))
    runs = F.when(spread > 0, (turns - expected) / F.sqrt(spread)).otherwise(F.sqrt(n))
    mean = _sum(F.col("codes"), lambda c: c) / n
    square = _sum(F.col("codes"), lambda c: c * c) - n * mean * mean
    ends = F.element_at("codes", 1) + F.element_at("codes", -1)
    lagged = _neighbours(F.col("codes"), lambda a, b: a * b) - mean * (2 * n * mean - ends) + (n - 1) * mean * mean
    serial = F.when(square > 1e-9, (lagged / square + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
    h = -(_two_sided(chi) + _two_sided(runs) + _two_sided(serial))
    out = out.withColumn("ln_random", -h + F.log(1 + h + h * h / 2))
    lowered = F.lower("token")
    equal = counted(F.col("lowered"), F.lit(_LOWER))
    classes = F.translate("token", _LOWER + _UPPER + _DIGITS + "+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "    ")
    out = out.withColumn("lowered", lowered).withColumn("equal", equal).withColumn("classes", F.split(classes, ""))
    return out.withColumns(
        {
            "words": token.rlike(WORDS),
            "letters": _sum(F.col("equal"), lambda c: c),
            "pairs": _sum(F.col("equal"), lambda c: c * (c - 1) / 2),
            "triples": _sum(F.col("equal"), lambda c: c * (c - 1) * (c - 2) / 6),
            "steps": _neighbours(F.col("classes"), lambda a, b: ((a != " ") & (b != " ")).cast("double")),
            "changes": _neighbours(F.col("classes"), lambda a, b: ((a != " ") & (b != " ") & (a != b)).cast("double")),
        }
    ).drop("alphabet", "codes", "chi", "lowered", "equal", "classes")


def _against_text(tested: DataFrame) -> DataFrame:
    """Adds class (of length) and bin (of the probability that written text looks as random as the token)."""
    v = F.col("letters")
    two, three = v * (v - 1) / 2, v * (v - 1) * (v - 2) / 6
    sums = tested.where("words").agg(*(F.coalesce(F.sum(x), F.lit(0.0)) for x in (F.col("pairs"), two, F.col("triples"), three, F.col("changes"), F.col("steps")))).first()
    s2 = (sums[0] + PRIOR * TWO_AGREE) / (sums[1] + PRIOR)
    s3 = (sums[2] + PRIOR * THREE_AGREE) / (sums[3] + PRIOR)
    change = max((sums[4] + PRIOR * CHANGE) / (sums[5] + PRIOR), CHANGE)
    spread = two * s2 * (1 - s2) + 6 * three * max(s3 - s2 * s2, 0.0)
    repeats = F.when(spread > 0, (two * s2 - F.col("pairs") - 0.5) / F.sqrt(spread)).otherwise(F.lit(0.0))
    shifts = F.when(F.col("steps") > 0, (F.col("changes") - F.col("steps") * change - 0.5) / F.sqrt(F.col("steps") * change * (1 - change))).otherwise(F.lit(0.0))
    h = -(_upper(repeats) + _upper(shifts))
    nats = h - F.log(1 + h)
    return tested.withColumns(
        {
            "length_class": F.least(F.floor(2 * F.log2(F.col("n").cast("double"))), F.lit(LAST_CLASS)).cast("int"),
            "bin": F.least(F.floor(nats * BINS_A_NAT), F.lit(LAST_BIN)).cast("int"),
        }
    )


def thresholds(tested: DataFrame, false_discoveries: float) -> DataFrame:
    """(length_class, least_bin): step-up over the histogram of bins, whose upper ends stand for the probabilities."""
    counts = tested.where("token IS NOT NULL").groupBy("length_class", "bin").agg(F.count("*").alias("rows"))
    down = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("length_class")
    ranked = counts.select("length_class", "bin", F.sum("rows").over(down).alias("above"), F.sum("rows").over(whole).alias("tests"))
    passed = F.exp(-F.col("bin") / BINS_A_NAT) <= false_discoveries * F.col("above") / F.col("tests")
    return ranked.where(passed).groupBy("length_class").agg(F.min("bin").alias("least_bin"))


def spans(docs: DataFrame, p: SecretParams = SecretParams()) -> DataFrame:
    """(row, doc_id, kind, start, stop, encoding) of every span; documents without any have one row with a null kind.
    row tells documents with one id apart. Written to the shared folder."""
    require(docs, "doc_id", "text")
    items = materialize(battery(_items(docs)), "secret-items")
    tested = _against_text(items)
    least = thresholds(tested, p.false_discoveries)  # at most LAST_CLASS rows
    judged = tested.join(F.broadcast(least), "length_class", "left")
    random = F.col("encoding").isNotNull() & ~F.col("words") & (F.exp("ln_random") >= p.reject) & (F.col("bin") >= F.col("least_bin"))
    base = F.col("kind") < KINDS.index("random")
    order = Window.partitionBy("row", "kind").orderBy("place")
    placed = judged.select(
        "row", "doc_id", "kind", "size", "encoding", (F.sum(F.col("gap") + F.col("size")).over(order)).alias("stop"),
        F.coalesce(F.when(base, F.col("long_enough")).otherwise(random), F.lit(False)).alias("kept"), F.coalesce(base, F.lit(False)).alias("base"),
    ).withColumn("start", F.col("stop") - F.col("size"))
    own = F.col("kept") & F.col("base")
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    met = placed.withColumn("reached", F.max(F.when(own, F.col("stop"))).over(before)).withColumn("coming", F.min(F.when(own, F.col("start"))).over(after))
    apart = (F.coalesce(F.col("reached"), F.lit(0)) <= F.col("start")) & (F.coalesce("coming", "stop") >= F.col("stop"))
    kept = F.col("kept") & (F.col("base") | apart)
    first = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("good"), "start")) == 1
    found = met.withColumn("good", kept).withColumn("first", first).where("good OR first")
    blank = lambda c: F.when(F.col("good"), F.col(c)).alias(c)
    names = F.when(F.col("good"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)).alias("kind")
    out = materialize(found.select("row", "doc_id", names, blank("start"), blank("stop"), F.when(F.col("good") & ~F.col("base"), F.col("encoding")).alias("encoding")), "secret-spans")
    release(items)
    return out


def digest(found: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, and spans as text."""
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = F.struct("start", place.alias("place"), F.concat_ws(":", "kind", "start", "stop").alias("text"))
    listed = found.groupBy("row", "doc_id").agg(
        *(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in KINDS),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"),
    )
    text = lambda a: F.concat_ws(",", F.transform(a, lambda x: x["text"]))
    base = F.filter("all", lambda x: x["place"] <= len(BASE))
    return listed.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("all")).alias("spans"))
