"""URL filter: longest matching rule first, else logistic regression on hashed character n-grams of host and path.

Everything a row meets is a DataFrame expression: host and path are cut out, n-grams are hashed to ``BUCKETS`` weights by
xxhash64, the margin is a sum over them. The model is fitted on a small labelled table (at most ``MOST_LABELLED`` rows): the same
expressions turn it into bucket lists, and gradient steps on those few rows are plain arithmetic of the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serialake.llm.common import col, others, unused

BUCKETS = 1 << 13
SIZES = (3, 4)
MOST_LABELLED = 10_000

#: (host, path prefix, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

#: Site names of the labelled table used when none is given. No host of a judged table may be among them: the tests assert it for the test tables.
BLOCKED_NAMES = (
    "buy-viagra", "discount-pharma", "cheap-meds", "online-pharmacy", "diet-pills", "pills-shop", "cheap-watches", "replica-bags", "miracle-cure", "weight-loss-now",
    "online-casino", "casino-royal", "vegas-slots", "poker-night", "big-casino", "lucky-win", "win-prizes", "jackpot-city", "sports-bets", "bets-online", "bonus-bets", "live-betting",
    "free-spins", "free-money", "free-followers", "payday-loans", "quick-cash", "cheap-likes", "spam-links", "seo-spam", "link-farm", "content-farm", "mass-mail",
    "adult-cams", "xxx-adult", "adult-videos", "adult-dating", "hot-singles", "ads-server", "click-ads", "banner-ads", "ad-tracker", "track-clicks", "pixel-track",
)
ALLOWED_NAMES = (
    "garden", "library", "recipes", "weather", "university", "cooking", "museum", "history", "newspaper", "football", "science", "travel", "village", "music", "architecture",
    "school", "hospital", "railway", "theatre", "nation", "thunder", "northern-lights", "mathematics", "brother", "feather", "athletics", "earth-watch", "truth", "breathing",
    "station", "tradition", "education", "painting", "knitting", "sailing", "writing", "hathaway", "leather", "teaching", "method", "city-library", "old-town", "book-club",
    "farmers-market", "open-data", "night-train", "street-theatre", "winter-sports", "track-and-field", "readings", "therapy", "anthem", "thesis", "thanet", "pathways",
    "letters", "orchestra", "harbour", "cathedral", "forest", "mountain", "river", "bakery", "pottery", "chess", "astronomy", "geology", "botany", "folklore", "the-herald",
)
DOMAINS = ("example.org", "example.net", "example.com", "test")
SUBDOMAINS = ("", "www.", "m.", "blog.")
PATHS = ("/en/12", "/fr/360/", "/de/5.html", "/es/901", "/en/7")


def _labelled(names: Sequence[str]) -> tuple[str, ...]:
    """Two urls per name; domains, subdomains and paths go round alike for both labels, so only names tell them apart."""
    return tuple(f"http://{SUBDOMAINS[(i + j) % 4]}{name}.{DOMAINS[(i + 2 * j) % 4]}{PATHS[(i + j) % 5]}" for i, name in enumerate(names) for j in range(2))


BLOCKED, ALLOWED = _labelled(BLOCKED_NAMES), _labelled(ALLOWED_NAMES)


@dataclass
class UrlModel:
    bias: float
    weights: list[float]  # one per bucket


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.regexp_extract(_after(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def buckets(host: Column, path: Column) -> Column:
    """Bucket numbers of the character 3- and 4-grams of ``^host$`` and ``^path$``, repeats included; none for empty parts."""
    def grams(kind: str, part: Column, size: int) -> Column:
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        starts = F.when(F.size(chars) >= size, F.sequence(F.lit(0), F.size(chars) - size)).otherwise(F.array().cast("array<int>"))
        gram = lambda i: F.concat(*[F.get(chars, i + j) for j in range(size)])
        hashed = F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(kind), gram(i)), F.lit(BUCKETS)).cast("int"))
        return F.when(part == "", F.array().cast("array<int>")).otherwise(hashed)

    return F.concat(*[grams(kind, part, size) for kind, part in (("host", host), ("path", path)) for size in SIZES])


def fit(labelled: DataFrame, *, url_column: str = "url", blocked_column: str = "blocked", steps: int = 400, rate: float = 4.0, decay: float = 1e-4) -> UrlModel:
    """Weights from a small labelled table; rows with a null url or label teach nothing, more than ``MOST_LABELLED`` rows raise an error.

    An example's features are its bucket counts over the root of their number, so long urls weigh like short ones.
    """
    url = col(url_column)
    rows = (labelled.where(url.isNotNull() & col(blocked_column).isNotNull())
            .select(buckets(host_of(url), path_of(url)).alias("b"), col(blocked_column).cast("int").alias("y")).limit(MOST_LABELLED + 1).collect())
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled rows")
    examples = []
    for r in sorted(rows, key=lambda r: (r["y"], r["b"])):
        counts: dict[int, float] = defaultdict(float)
        for b in r["b"]:
            counts[b] += 1 / math.sqrt(len(r["b"]))
        examples.append((counts, float(r["y"])))
    bias, weights = 0.0, [0.0] * BUCKETS
    for _ in range(steps):
        slope, bias_slope = defaultdict(float), 0.0
        for counts, y in examples:
            margin = bias + sum(weights[b] * v for b, v in counts.items())
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, margin)))) - y
            bias_slope += error
            for b, v in counts.items():
                slope[b] += error * v
        bias -= rate * bias_slope / max(1, len(examples))
        for b, g in slope.items():
            weights[b] -= rate * (g / len(examples) + decay * weights[b])
    return UrlModel(bias, weights)


def default_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, blocked int")


def margin(model: UrlModel, host: Column, path: Column) -> Column:
    """Log odds of being blocked."""
    table = F.split(F.lit(",".join(repr(round(w, 6)) for w in model.weights)), ",").cast("array<double>")
    found = buckets(host, path)
    total = F.aggregate(found, F.lit(0.0), lambda s, b: s + F.get(table, b))
    return F.lit(float(model.bias)) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (host and path prefix) that fits, as struct(rule, verdict); null if none. A rule fits its host and all subdomains."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ordered):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(df: DataFrame, model: UrlModel, *, url_column: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``df`` with host, path, score (model's probability of block), rule and verdict (the rule's, else block at a score of 0.5 or more).

    A null url or one without ``://`` has empty host and path, fits no rule, and its score is that of the bias alone. Existing columns of the
    added names are replaced, all others kept; no row is dropped.
    """
    new = ("host", "path", "score", "rule", "verdict")
    url = col(url_column)
    names = unused(df, "own_host", "own_path", "own_score", "own_rule")
    host, path, score, rule = map(F.col, names)
    parts = df.select(*others(df), F.coalesce(host_of(url), F.lit("")).alias(names[0]), F.coalesce(path_of(url), F.lit("")).alias(names[1]))
    scored = parts.withColumn(names[2], 1 / (1 + F.exp(-margin(model, host, path)))).withColumn(names[3], rule_of(host, path, rules))
    verdict = F.coalesce(rule["verdict"], F.when(score >= 0.5, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select(*others(df, *new), host.alias("host"), path.alias("path"), score.alias("score"), rule["rule"].alias("rule"), verdict.alias("verdict"))
