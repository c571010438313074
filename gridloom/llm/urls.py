"""URL filters: host and path rules, then logistic regression on hashed character n-grams.

A url's host and path are cut out and matched against rules; where no rule fits, a model decides that is
trained on a small table of labelled urls. Its features are hashed n-grams (3 to 5 characters) of the host and
of the path (digits count alike), each side with its own hashes and scaled to unit length; the score is the
logistic of their weights. Rules are DataFrame expressions; scoring runs vectorised over Arrow batches and
has no shuffle, so hot hosts do not matter.

Edge cases: a null url or one without ``://`` has empty host and path and goes to the model, whose score of
nothing is its intercept; repeated rows are judged alike; ties in rule length cannot fit the same url unless
the rules are equal, then the first wins; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import MIX_B, mix64

DIMENSIONS = 1 << 15
GRAMS = (3, 4, 5)
UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    rule: str  # host, then path from its first slash

    @property
    def host(self) -> str:
        return self.rule.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.split("/", 1)[1]


# The rules of the query.
RULES = (
    Rule("block", "com/en/"),
    Rule("allow", "example.com/en/7"),
    Rule("allow", "net/de/"),
    Rule("block", "example.net/de/8"),
    Rule("block", "org/es/"),
)

# Words in names of unwanted hosts (gambling, adult, advertising and tracking, medicines, spam, fraud).
UNWANTED = (
    "casino", "casinos", "poker", "slots", "roulette", "bet", "bets", "betting", "sportsbook", "bookie", "wager", "jackpot", "bingo", "gambling",
    "adult", "adults-only", "xxx", "porn", "sex", "sexy", "nude", "escort", "erotic", "webcams",
    "ads", "ad-server", "adserver", "banner-ads", "popup-ads", "track", "tracker", "tracking", "click-counter", "affiliate",
    "pills", "viagra", "cialis", "pharmacy", "meds", "diet-pills", "no-prescription",
    "spam", "spammer", "link-farm", "click-farm", "backlinks", "bulk-mail",
    "payday-loans", "quick-cash", "prize-winner", "lottery", "keygen", "warez", "cracked", "replica", "phishing", "hacked", "miracle-cure",
)
# Words in names of ordinary hosts, some of which hold pieces of the others.
ORDINARY = (
    "library", "council", "university", "weather", "garden", "farm", "farm-museum", "adventure", "address", "alphabet", "better", "winter", "window", "racetrack", "track-and-field",
    "pillow", "adulthood", "madrid", "soup", "travel", "data", "science", "history", "music", "chess", "birds", "mountain", "river", "news", "football",
    "software", "linux", "math", "physics", "church", "choir", "art", "film", "book", "car", "bicycle", "coffee", "tea", "doctor", "dental",
    "health", "train", "harbour", "island", "photo", "poetry", "language", "kitchen", "wood", "star", "ocean", "freedom", "sussex", "spa", "padstow",
    "cooking", "fishing", "painting", "building", "reading", "spring", "morning", "kingdom", "nation", "education", "station", "mother", "brother", "earth", "thread", "north", "thinking", "round", "under", "hand",
    "table", "noble", "ready", "fresh", "english", "interest", "orient", "andes", "error", "theatre", "rational", "heritage", "stonework", "sailing", "walking", "landing", "lighthouse", "thunder", "ground", "blend",
)
# Words that stand beside both kinds.
BESIDE = ("club", "shop", "online", "best", "free", "my", "house", "world", "guide", "daily", "top", "live", "new", "city", "zone", "center", "cheap", "win", "x", "hub", "fast", "group", "site", "page")
BEFORE, DOMAINS = ("", "www.", "blog.", "m."), ("example.com", "example.net", "example.org")
PATHS = ("", "/", "/en/12", "/about", "/de/731?ref=x", "/page/3", "/item/99.html", "/fr/40#top", "/news/2024/05/", "/es/8")
LURES = ("/win/bonus", "/buy/pills", "/track/click", "/adult/free", "/casino/play", "/bets/odds", "/claim/prize")  # paths of unwanted hosts only
SYLLABLES = ("ka", "mo", "rin", "tel", "su", "var", "lo", "den", "pi", "gar", "nu", "shel", "to", "mar", "bri", "fen")


def made_up_names(n: int) -> list[str]:
    """Names of two to four syllables, of which an ordinary host may have any."""
    return ["".join(SYLLABLES[(i * 7 + 5 * k * k + i * k) % len(SYLLABLES)] for k in range(2 + i % 3)) for i in range(n)]


def labelled_urls() -> list[tuple[str, int]]:
    """The small table that the model learns from (1: block): words beside others, before or after them, with varying subdomains, domains and paths."""
    rows = [("", 0)]  # without host and path: nothing speaks against it
    for label, words in ((1, UNWANTED), (0, ORDINARY)):
        for i, word in enumerate(words):
            a, b, c = (BESIDE[(5 * i + 7 * k) % len(BESIDE)] for k in range(3))
            for k, name in enumerate((f"{a}-{word}", f"{word}-{b}", f"{word}{c}", word)):
                rows.append((f"http://{BEFORE[(i + k) % 4]}{name}.{DOMAINS[(i + k) % 3]}{PATHS[(3 * i + 5 * k) % len(PATHS)]}", label))
    for i, name in enumerate(made_up_names(2 * len(ORDINARY))):
        rows.append((f"http://{BEFORE[i % 4]}{name}.{DOMAINS[i % 3]}{PATHS[3 * i % len(PATHS)]}", 0))
    rows += [(f"https://{BEFORE[i % 4]}{UNWANTED[8 * i]}.{DOMAINS[i % 3]}{path}", 1) for i, path in enumerate(LURES)]
    return rows


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url as columns; both empty without ``://``."""
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWERED), path


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):  # the last one wraps the others
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.rule).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def _side(texts: list[str], side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hashed feature and unit-length value of each n-gram of the texts."""
    lines = ["^" + t.replace("\n", " ").replace("\0", " ") + "$" for t in texts]
    data = np.frombuffer("\n".join(lines).encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint64)
    data = np.where((data >= 48) & (data <= 57), np.uint64(48), data)
    end = data == 10
    row_of = np.cumsum(end)
    rows, keys = [], []
    for n in GRAMS:
        if len(data) < n:
            continue
        h = np.zeros(len(data) - n + 1, dtype=np.uint64)
        broken = np.zeros(len(h), dtype=bool)
        for i in range(n):
            h = h * MIX_B + data[i : len(data) - n + 1 + i]
            broken |= end[i : len(data) - n + 1 + i]
        h = mix64(h + np.uint64(1000 * side + n))[~broken]
        rows.append(row_of[: len(broken)][~broken])
        keys.append((h % np.uint64(DIMENSIONS)).astype(np.int64))
    row, key = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (rows, keys))
    count = np.bincount(row, minlength=len(texts))
    return row, key, 1.0 / np.sqrt(np.maximum(count, 1))[row]


def _features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_side(hosts, 1), _side(paths, 2)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))  # type: ignore[return-value]


def train(labelled: Sequence[tuple[str, int]] | None = None, steps: int = 3000, rate: float = 6.0, ridge: float = 1e-5) -> tuple[float, np.ndarray]:
    """Intercept and weights by full-batch gradient descent on labelled_urls() or other rows."""
    labelled = labelled_urls() if labelled is None else labelled
    hosts, paths = zip(*(_split(u) for u, _ in labelled), strict=True)
    y = np.array([label for _, label in labelled], dtype=float)
    row, key, value = _features(list(hosts), list(paths))
    share = 1.0 / len(y)
    b, w = 0.0, np.zeros(DIMENSIONS)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(b + np.bincount(row, value * w[key], len(y)))))
        err = share * (p - y)
        b -= rate * err.sum()
        w -= rate * (np.bincount(key, value * err[row], DIMENSIONS) + ridge * w)
    return float(b), w


def _split(url: str) -> tuple[str, str]:
    """host_and_path for one url in Python."""
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
    return rest[:n].translate(str.maketrans(UPPER, LOWERED)), rest[n:m]


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, labelled: Sequence[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the model's, for every url)."""
    intercept, weights = train(labelled)

    @F.pandas_udf("double")
    def score(sides: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in sides:
            row, key, value = _features(hosts.tolist(), paths.tolist())
            yield pd.Series(1 / (1 + np.exp(-(intercept + np.bincount(row, value * weights[key], len(hosts))))))

    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("score", score("host", "path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
