"""URL filters: rules first, then logistic regression on character n-grams.

A rule is (verdict, host, path): it fits its host and every subdomain if the URL's
path starts with the rule's; the longest fitting rule decides.  URLs no rule fits
get the verdict of a model trained on a small labelled table: the n-grams of host
and path are hashed apart from each other into one weight vector.

A null URL, or one without ``://``, has an empty host and path, which no rule
fits; the model judges the empty strings.  Of two rules for one place the one that allows
holds.  Very long URLs are judged whole, repeated ones alike, an empty table gives an empty
table; other columns are passed on.
"""

from __future__ import annotations

import bisect
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Shipped, as_strings, ascii_lower, free_name, mix64, quoted

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
GRAMS = (3, 4, 5)
WEIGHTS = 1 << 15

# The labelled table: URLs of kinds a text corpus wants, and of kinds it does not.
ALLOW = """https://docs.python.example.org/3/library/re.html
https://en.encyclopedia.example.org/wiki/History_of_printing
https://www.university.example.edu/research/papers/2021/optics.html
https://blog.engineering.example.com/posts/how-we-test
https://news.city.example.com/2020/05/12/council-meeting
https://www.library.example.org/books/catalogue/1123
https://forum.gardening.example.net/thread/tomatoes-in-spring
https://developer.example.com/reference/strings
https://m.cooking.example.org/recipes/bread
https://www.museum.example.org/en/exhibitions/glass
https://recettes.example.fr/fr/soupe-aux-legumes
https://www.zeitung.example.de/de/artikel/wahlen
https://noticias.example.es/es/2019/ciencia
https://blog.travel.example.org/en/walking-in-wales
http://science.example.org/articles/8812.html
http://www.school.example.edu/courses/algebra
http://tutorial.example.net/en/sql/joins
https://health.example.gov/topics/vaccines
https://archive.example.org/details/letters1890
https://www.weather.example.gov/en/forecast/7
http://history.example.com/en/article/3391
http://m.stories.example.net/en/55120
https://review.example.com/books/fiction/201
https://manual.example.org/de/kapitel/3""".split()
BLOCK = """http://casino-bonus.example.com/play/free-spins
http://online-casino.example.net/jackpot/slots
https://best-pills.example.com/cheap/viagra
https://pharmacy-discount.example.net/buy/pills-online
http://xxx-videos.example.com/watch/hot
https://adult-cams.example.net/live/sexy
http://free-porn.example.org/tube/9
https://ads.tracker.example.com/click?id=77
http://adserver.example.net/banner/pixel.gif
https://track.example.com/affiliate/redirect
http://download-crack.example.net/keygen/serial
https://torrent-warez.example.org/download/full-movie
http://fast-loans.example.com/payday/apply-now
https://win-prize.example.net/claim/gift-card
http://replica-watches.example.com/cheap/rolex
https://betting-tips.example.net/odds/bet-now
http://hot-singles.example.com/dating/adult
https://cheap-seo-links.example.com/buy/backlinks
http://login-verify.example.net/account/password-reset
https://crypto-double.example.com/free-bitcoin
http://poker-slots.example.org/bonus/casino
https://spam-offers.example.net/click/unsubscribe
http://escort-xxx.example.com/sexy/girls
https://malware-download.example.net/free/setup.exe""".split()


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Between the first ``://`` and the next ``/``, ``?``, ``#``; and on to ``?`` or ``#``."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


class Rules:
    """(verdict, host, path) rules, looked up by each ending of a host and each length of path that
    a rule has, so the work for a URL does not grow with their number."""

    def __init__(self, rules=RULES):
        # of two rules for one place the smaller verdict holds
        self.verdicts = {(at, prefix): verdict for verdict, at, prefix in sorted(rules, reverse=True)}
        self.lengths = sorted({len(prefix) for _, prefix in self.verdicts})

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule as host and path joined, its verdict) of the longest that fits, else nulls."""
        found, at = [], 0
        while at >= 0:
            ending = host[at:]
            for n in self.lengths[:bisect.bisect_right(self.lengths, len(path))]:
                verdict = self.verdicts.get((ending, path[:n]))
                if verdict is not None:
                    found.append((-len(ending) - n, verdict, ending, path[:n]))
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        _, verdict, ending, prefix = min(found, default=(0, None, None, None))
        return (None if verdict is None else ending + prefix), verdict


def grams(host: str, path: str) -> np.ndarray:
    """Places of the weights of the n-grams of host and path."""
    out = []
    for salt, text in ((1, host), (2, path)):
        data = np.frombuffer(b"^" + text.encode() + b"$", np.uint8).astype(np.uint64)
        for n in GRAMS:
            if len(data) >= n:
                code = np.zeros(len(data) - n + 1, np.uint64)
                for i in range(n):
                    code = (code << np.uint64(8)) | data[i:len(data) - n + 1 + i]
                out.append(mix64(code * np.uint64(31) + np.uint64(salt * 7 + n)) % np.uint64(WEIGHTS))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def _split(url: str) -> tuple[str, str]:
    _, found, rest = url.partition("://")
    rest = rest if found else ""
    rest = rest.split("?")[0].split("#")[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


@functools.lru_cache(maxsize=4)
def train(labelled: tuple[tuple[str, int], ...] | None = None, rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights and, last, the bias.  ``labelled``: (url, 1 to block) rows."""
    labelled = labelled or tuple([(u, 0) for u in ALLOW] + [(u, 1) for u in BLOCK])
    rows = [grams(*_split(u)) for u, _ in labelled]
    y = np.array([b for _, b in labelled], float)
    x = np.zeros((len(rows), WEIGHTS + 1))
    for i, at in enumerate(rows):
        np.add.at(x[i], at, 1 / max(1, len(at)) ** 0.5)
        x[i, -1] = 1
    w = np.zeros(WEIGHTS + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        w -= rate * (x.T @ (p - y) / len(y) + decay * w)
    return w


def score(weights: np.ndarray, host: str, path: str) -> float:
    at = grams(host, path)
    z = float(weights[at].sum() / max(1, len(at)) ** 0.5 + weights[-1])
    return float(1 / (1 + np.exp(-z)))


def with_verdict(pages: DataFrame, url: str = "url", out: str = "url_filter", rules=RULES, labelled=None, threshold: float = 0.5) -> tuple[DataFrame, str]:
    """``pages`` with a struct host, path, rule, verdict, score; and its name."""
    held = Shipped(pages.sparkSession, (train(labelled), Rules(rules)))

    @F.arrow_udf("rule string, decided string, score double")
    def judged(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        weights, known = held.get()
        pairs = list(zip(as_strings(hosts).to_pylist(), as_strings(paths).to_pylist()))
        each = {p: (*known.find(*p), score(weights, *p)) for p in set(pairs)}  # repeated URLs once
        columns = list(zip(*[each[p] for p in pairs])) or [(), (), ()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.float64()))],
                                          names=["rule", "decided", "score"])

    out = free_name(pages, out)
    host, path = host_and_path(quoted(url))
    parts = pages.withColumn(out, F.struct(host.alias("host"), path.alias("path")))
    o = quoted(out)
    found = parts.withColumn(out, F.struct(o.host.alias("host"), o.path.alias("path"), judged.asNondeterministic()(o.host, o.path).alias("j")))
    verdict = F.coalesce(o.j.decided, F.when(o.j.score >= threshold, "block").otherwise("allow"))
    return found.withColumn(out, F.struct(o.host.alias("host"), o.path.alias("path"), o.j.rule.alias("rule"),
                                          verdict.alias("verdict"), o.j.score.alias("score"))), out
