"""URL filters: rules, and a logistic regression for the urls that none fits.

In DataFrame functions and Spark's own machine learning only.  The model sees
hashed character n-grams of host and path and is trained from a small labelled
table of urls, in which a url is bad by its host, by its path or by both.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import free_name, prepare

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NGRAMS = (3, 4, 5)
FEATURES = 1 << 16
MOST_RULES = 1000
#: Set on held-out folds of the table: precision 0.99 and recall 0.93 there.
THRESHOLD = 0.4
#: One penalty for all n-grams: rare ones would else get off lightly.
REGULARIZED = 2e-4

Rule = tuple[str, str, str]  # verdict, host, path

#: Names are pairs of words: one of a kind with another one of its kind or a plain one.
BLOCKED_WORDS = ("casino", "slots", "jackpot", "poker", "lotto", "bets", "betting", "bonus", "spins", "pills", "viagra", "meds", "pharma", "adult", "cams", "xxx", "porn", "sex", "hookup", "spam", "seo", "ads", "popup", "clicks", "loans", "payday", "crypto", "giveaway", "replica", "warez", "keygen", "crack")
ALLOWED_WORDS = ("news", "herald", "library", "museum", "garden", "lectures", "science", "history", "cooking", "travel", "university", "code", "weather", "health", "parliament", "school", "film", "music", "bird", "sports", "review", "archive", "recipes", "council", "trains", "art", "books", "forum", "theory", "notes", "diary", "press")
PLAIN_WORDS = ("online", "best", "live", "club", "shop", "world", "center", "daily", "my", "top", "home", "fast")
#: Syllables of plain names: all of them can follow each other, so an unknown name is no evidence.
ONSETS = ("b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "r", "s", "t", "v", "w", "y", "z", "th", "sh", "ch", "st", "tr", "pr", "br", "cl", "gr", "pl", "fl", "wh", "qu", "")
VOWELS = ("a", "e", "i", "o", "u", "ea", "ou", "ee", "ai", "y")
CODAS = ("", "", "", "n", "r", "s", "t", "l", "d", "m", "ng", "nt", "st", "ck", "rd", "sh", "th")
ENDINGS = ("", "", "", "ing", "tion", "ble", "ly", "er", "ed", "es")
PLAIN_NAMES, NAMES = 2400, 32
PREFIXES = ("", "www.", "m.", "blog.", "", "shop.", "static.", "en.")
SUFFIXES = (".example.com", ".example.net", ".example.org", ".test", ".com", ".net", ".org", ".co.uk", ".io", ".de")
LANGUAGES = ("en", "de", "fr", "es", "it", "pl")
ENDS = ("", "/", ".html", ".php", "/page/2", "?id=3")
FOLDS = 4
SEED = 7


def plain_name(rnd: random.Random) -> str:
    """Two or three syllables, one time in four two of them with a hyphen between."""
    part = lambda n: "".join(rnd.choice(ONSETS) + rnd.choice(VOWELS) + rnd.choice(CODAS) for _ in range(n)) + rnd.choice(ENDINGS)
    return f"{part(1)}-{part(rnd.randint(1, 2))}" if rnd.random() < 0.25 else part(rnd.randint(2, 3))


def plain_path(rnd: random.Random) -> str:
    """A path that says nothing: a language and a number, a date, a plain name or word, or nothing at all."""
    kind, number = rnd.randrange(6), str(rnd.randrange(10 ** rnd.randint(1, 6)))
    word = rnd.choice(ALLOWED_WORDS) if rnd.random() < 0.4 else plain_name(rnd)
    return ("/", f"/{rnd.choice(LANGUAGES)}/{number}", f"/20{rnd.randint(10, 29)}/{rnd.randint(1, 12):02d}/{word}", f"/{word}/{number}", f"/{rnd.choice(LANGUAGES)}/{word}", f"/{number}")[kind] + rnd.choice(ENDS)


def names(words: Sequence[str], rnd: random.Random) -> list[str]:
    """``NAMES`` names for each word: with a plain word, one of its kind or a plain name, before or behind, with and without a hyphen."""
    out = []
    for word in words:
        for k in range(NAMES):
            other = (rnd.choice(PLAIN_WORDS), rnd.choice(words), plain_name(rnd))[k % 3]
            pair = (word, other) if rnd.random() < 0.5 else (other, word)
            out.append(("" if k % 4 == 3 else "-").join(pair))
    return out


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label, fold) with 1 for block: made-up names, and names of known words as hosts and as paths.

    A bad host is bad under any path, and a bad path under any host.  ``fold``
    deals the names out so that each word comes in all folds: what is held out
    are new names of known words and new plain names.
    """
    rnd = random.Random(SEED)
    plain = [plain_name(rnd) for _ in range(PLAIN_NAMES)]
    bad, good = names(BLOCKED_WORDS, rnd), names(ALLOWED_WORDS, rnd)
    rows = []

    def add(host: str, path: str, label: float, fold: int) -> None:
        rows.append((f"https://{rnd.choice(PREFIXES)}{host}{rnd.choice(SUFFIXES)}{path}", label, fold))

    for i, host in enumerate(plain):
        add(host, plain_path(rnd), 0.0, i % FOLDS)
    for label, own in ((1.0, bad), (0.0, good)):
        for i, name in enumerate(own):
            fold = (i + i // NAMES) % FOLDS
            add(name, rnd.choice((plain_path(rnd), f"/{rnd.choice(good)}{rnd.choice(ENDS)}")), label, fold)
            add(rnd.choice((rnd.choice(plain), rnd.choice(good))), f"/{rnd.choice(('', rnd.choice(LANGUAGES) + '/'))}{name}{rnd.choice(ENDS)}", label, fold)
    return spark.createDataFrame(rows, "url string, label double, fold int").coalesce(1)


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for a null or where ``://`` is missing."""
    url = F.coalesce(url, F.lit(""))
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(after, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits: struct(length, rule, verdict), null if none does.

    A rule fits its host and all subdomains.  Rules are a small list by
    contract; ties go to the rule that sorts last.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = [F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h) + len(p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))) for verdict, h, p in rules]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length: int, rule: string, verdict: string>")


def ngrams(host: Column, path: Column) -> Column:
    """Tagged character n-grams; the host has marks at both ends."""

    def tagged(tag: str, s: Column, n: int) -> Column:
        at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.concat(F.lit(tag), F.substring(s, i, F.lit(n))))

    marked = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(*[tagged("h", marked, n) for n in NGRAMS], *[tagged("p", path, n) for n in NGRAMS])


def trained(labelled: DataFrame, url: str = "url", label: str = "label") -> PipelineModel:
    host, path = parts(F.col(url))
    rows = labelled.select(F.col(label).cast("double").alias("label"), ngrams(host, path).alias("grams"))
    stages = [HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features"), LogisticRegression(maxIter=100, regParam=REGULARIZED, standardization=False)]
    return Pipeline(stages=stages).fit(rows)


def judged(df: DataFrame, model: PipelineModel, rules: Sequence[Rule] = (), url: str = "url", threshold: float = THRESHOLD) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with host, path, rule, verdict and the model's probability, under free names.

    Null and odd urls have an empty host and path; the model judges them too
    (it allows what it knows nothing about).  Every row comes back once,
    repeated ones with equal verdicts; very long urls are read whole.
    """
    prepare(df.sparkSession)
    n = {c: free_name(df, f"url_{c}") for c in ("host", "path", "rule", "verdict", "p", "row")}
    host, path = parts(F.col(url))
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).withColumn("grams", ngrams(F.col("host"), F.col("path")))
    rows = model.transform(rows).withColumn("p", vector_to_array("probability")[1])
    verdict = F.coalesce("fit.verdict", F.when(F.col("p") >= threshold, "block").otherwise("allow"))
    return rows.select("row.*", F.col("host").alias(n["host"]), F.col("path").alias(n["path"]), F.col("fit.rule").alias(n["rule"]), verdict.alias(n["verdict"]), F.col("p").alias(n["p"])), n
