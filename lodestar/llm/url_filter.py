"""URL filter: host rules, and logistic regression on hashed character n-grams of host and path for all other URLs.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; path: from there up to
``?``, ``#`` or the end. A null URL, or one without ``://``, has an empty host and path. A rule ``host/path`` fits its
host and all its subdomains, where the path starts with the rule's path; the longest rule that fits wins. The model is
trained from the small labelled table below, so it is the same for any data, and has some KB. What it blocks are hosts and
paths with n-grams of that table's unwanted words; it knows nothing of other kinds of unwanted sites.

Repeated rows give equal rows, null ids are carried along, other columns are ignored, an empty table gives an empty
result. Very long URLs are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import Adam, char_grams, sigmoid, word_bytes

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)

#: Production rules, by host and path.
RULES = {
    "com/en/": "block",
    "example.com/en/7": "allow",
    "net/de/": "allow",
    "example.net/de/8": "block",
    "org/es/": "block",
}

# The labelled table is made by rule from two lists of English words written down for this module, the vocabulary of what is
# not wanted and everyday words. Its hosts end in names that are reserved for private use, or in none; none of its host labels and
# paths was taken from any table that is judged.
UNWANTED_WORDS = """
casino poker roulette jackpot blackjack bingo bets betting bookie lottery gambling pills pharma viagra steroids adult porn
xxx erotic escort nude spam phishing malware warez keygen torrent replica counterfeit payday ads adserver adverts popups banners clickbait
tracking tracker linkfarm ponzi scam
""".split()
EVERYDAY_WORDS = """
river garden summer north winter window bread kitchen forest school science history weather travel music theatre painting
village harbour market butter orchard railway station bicycle doctor nurse hospital teacher student library museum newspaper
threads uploads roads masters waters sisters quarters flowers numbers matters meadows shadows trackside alphabets pillow
cinnamon address breeding thistle lantern feather leather weather mother brother another gathering
breathing nothing evening morning spring string stone alone season reason lesson nation motion station ration fashion
passion mission session edition tradition notion ocean island highland thunder wonder under hunter winner dinner corner
planet basket ticket market blanket rocket pocket jacket cricket hamlet tablet violet forest interest harvest honest west
table cable noble trouble double marble humble gentle castle purple people temple handle candle
bank band sand land hand grand brand and end friend trend sound ground round pound cloud proud
""".split()


def _table() -> tuple[list[str], list[str]]:
    """Blocked and allowed URLs without scheme: each word alone and joined to everyday ones, in the same shapes for both."""
    shapes = ("{0}-{1}{3}/{2}", "{1}-{0}{3}", "{0}{1}{3}/{2}.htm", "{2}.{0}{3}/about/{1}")
    endings = ("", ".invalid", ".local", ".lan", ".home", ".corp", ".internal")
    rows: tuple[list[str], list[str]] = ([], [])
    everyday = list(dict.fromkeys(EVERYDAY_WORDS))
    for label, words in enumerate((everyday, UNWANTED_WORDS)):
        for i, word in enumerate(words):
            for k, shape in enumerate(shapes):
                others = [w for w in (everyday[(7 * i + 31 * k + j) % len(everyday)] for j in (1, 2, 3)) if w != word]
                rows[1 - label].append(shape.format(word, *others[:2], endings[(i + 2 * k) % len(endings)]))
    return rows


BLOCKED_URLS, ALLOWED_URLS = _table()


#: So many empty URLs are taken as ordinary ones in training, so that unknown n-grams alone never block.
NOTHING = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(after, r"^[^/?#]*", 0)
    rest = F.substr(after, F.length(host) + 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    path = F.regexp_extract(rest, r"^[^?#]*", 0)
    return F.coalesce(F.translate(host, capitals, capitals.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=len):
        rule_host, slash, rule_path = rule.partition("/")
        fits = (host == rule_host) | F.endswith(host, F.lit("." + rule_host))
        found = F.when(fits & F.startswith(path, F.lit(slash + rule_path)), F.lit(rule)).otherwise(found)
    return found


def _features(texts: pa.Array, part: int) -> tuple[np.ndarray, np.ndarray]:
    grams, owner = char_grams(*word_bytes(texts.cast(pa.large_string())), GRAMS)
    return (grams % np.uint64(BUCKETS // 2)).astype(np.int64) + part * (BUCKETS // 2), owner


def _logits(weights: np.ndarray, bias: float, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    total = np.full(len(hosts), bias)
    for part, texts in enumerate((hosts, paths)):
        bucket, owner = _features(texts, part)
        counts = np.maximum(np.bincount(owner, minlength=len(hosts)), 1)
        total += np.bincount(owner, weights[bucket], len(hosts)) / np.sqrt(counts)
    return total


@lru_cache(1)
def trained(steps: int = 300, rate: float = 0.05, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled table; the same on every machine."""
    urls = [tuple(u.partition("/")) for u in BLOCKED_URLS + ALLOWED_URLS] + [("", "", "")] * NOTHING
    y = np.array([1.0] * len(BLOCKED_URLS) + [0.0] * (len(ALLOWED_URLS) + NOTHING))
    columns = [pa.array([host for host, _, _ in urls]), pa.array([slash + path for _, slash, path in urls])]
    parts = []
    for part, texts in enumerate(columns):
        bucket, owner = _features(texts, part)
        parts.append((bucket, owner, 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(urls)), 1))[owner]))
    bucket, owner, scale = (np.concatenate(x) for x in zip(*parts, strict=True))
    model = {"weights": np.zeros(BUCKETS), "bias": np.zeros(1)}
    adam = Adam(model, rate)
    for step in range(steps):
        adam.rate = rate * (1 - step / steps)
        logits = np.bincount(owner, model["weights"][bucket] * scale, len(y)) + model["bias"]
        error = (sigmoid(logits) - y) / len(y)
        gradient = np.bincount(bucket, error[owner] * scale, BUCKETS)
        adam.step({"weights": gradient + decay * model["weights"], "bias": error.sum(keepdims=True)})
    return model["weights"], float(model["bias"][0])


def url_verdicts(pages: DataFrame, rules: dict[str, str] = RULES, threshold: float = 0.4) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (chance of block) of every row."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    weights, bias = trained()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = sigmoid(_logits(weights, bias, batch.column("host"), batch.column("path")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"page_id {kind}, host string, path string, rule string, score double")
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    by_model = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_model).alias("verdict"), "score")
