"""URL filter: host and path rules, and logistic regression on hashed character n-grams.

The rules are Column expressions.  The model is trained from ``LABELLED``, a small
table of URLs with a verdict; its weights are a vector of fixed length, so they
travel with the task.  Scoring is one narrow pass over Arrow batches.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules: verdict, host, start of the path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_BLOCKED_NAMES = (
    "casino casino-win best-casino casino-royale online-casino free-bets bets-now sports-bet bet365x poker-win pokerstars lucky-slots"
    " cheap-pills pills-direct buy-viagra online-pharmacy rx-meds diet-pills ads-track ad-server adclick tracker-ads banner-ads popads"
    " spam-farm link-farm seo-spam spamlinks adult-x xxx-video adult-cams sex-chat porn-tube hot-girls payday-loan quick-loans"
    " free-iphone win-prize lottery-win crack-keys warez-download replica-watches fake-bags"
)
_ALLOWED_NAMES = (
    "news daily-post city-library museum university biology-notes cooking garden weather history-hub travel-notes science open-data"
    " physics-today math-notes chess-club bird-watch reading-room football-news cinema recipes school hospital government parliament"
    " law-review economics health-advice music theatre poetry photography hiking railway architecture astronomy linguistics"
    " bakery school-board gallery village-hall botany geology newsroom library-journal magazine dictionary encyclopedia translation teachers"
    " students orchestra festival heritage nature insurance transport engineering carpentry furniture veterinary pediatrics conference"
    " the-herald the-times the-tribune theology thesis-archive mother-tongue northern-region southern-coast western-railway eastern-college"
    " weather-station brothers-garage other-worlds athletics authors editors painters lawyers farmers readers gardeners engineers nations"
    " stations regions traditions foundation institution education tourism restaurant hotel marina harbour mountain river forest island"
    " technology mathematics chemistry philosophy psychology literature sociology medicine nursing dentist pharmacology clinic workshop"
)
_BLOCKED_PATHS = ("/win/bonus", "/free/spins", "/buy/cheap-pills", "/click?", "/track/ad", "/xxx/1", "/promo/casino", "/article/12", "/index.html", "/")
_ALLOWED_PATHS = ("/article/12", "/index.html", "/posts/new-bridge/", "/contact", "/docs/start", "/about", "/archive/2019/05", "/", "/wiki/Page", "/events/")


def labelled() -> list[tuple[str, str, bool]]:
    """The labelled table: host, path, blocked."""
    ends = ("example.com", "example.org", "example.net")
    rows = []
    for names, paths, blocked in ((_BLOCKED_NAMES, _BLOCKED_PATHS, True), (_ALLOWED_NAMES, _ALLOWED_PATHS, False)):
        for i, name in enumerate(names.split()):
            for j, front in enumerate(("", "www.", "m.", "blog.")):
                rows.append((f"{front}{name}.{ends[(i + j) % 3]}", paths[(i + 3 * j) % len(paths)], blocked))
    return rows


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest rule that fits; both null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, rule_verdict).otherwise(verdict)
    return name, verdict


class UrlModel:
    """Logistic regression; host and path are averaged bags of hashed n-grams."""

    def __init__(self, bits: int = 14, sizes: tuple[int, ...] = (3, 4, 5)):
        self.bits, self.sizes = bits, sizes
        self.weights, self.bias = np.zeros(1 << bits), 0.0

    def features(self, kind: str, text: str) -> np.ndarray:
        """Hashed n-grams of a host or path of any length, repeats included."""
        text = f"^{text}$"
        grams = (text[i : i + n] for n in self.sizes for i in range(len(text) - n + 1))
        return np.array([zlib.crc32(f"{kind}{g}".encode()) & ((1 << self.bits) - 1) for g in grams], np.int64)

    def part(self, kind: str, text: str) -> float:
        at = self.features(kind, text)
        return float(self.weights[at].sum()) / math.sqrt(len(at)) if len(at) else 0.0

    def fit(self, rows: list[tuple[str, str, bool]], rounds: int = 600, rate: float = 20.0, ridge: float = 1e-4) -> UrlModel:
        at, row, value = [], [], []
        for i, (host, path, _) in enumerate(rows):
            for kind, text in (("h", host), ("p", path)):
                found = self.features(kind, text)
                at.append(found)
                row.append(np.full(len(found), i))
                value.append(np.full(len(found), 1 / math.sqrt(max(1, len(found)))))
        at, row, value = np.concatenate(at), np.concatenate(row), np.concatenate(value)
        wanted = np.array([float(blocked) for *_, blocked in rows])
        for _ in range(rounds):
            logits = np.bincount(row, self.weights[at] * value, len(rows)) + self.bias
            error = (1 / (1 + np.exp(-logits)) - wanted) / len(rows)
            self.weights -= rate * (np.bincount(at, error[row] * value, 1 << self.bits) + ridge * self.weights)
            self.bias -= rate * error.sum()
        return self


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    labelled_urls: list[tuple[str, str, bool]] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every page.

    A rule decides where one fits; elsewhere the model blocks from ``threshold`` on.
    ``score`` is the model's probability of a block for every row.  A null url and one
    without ``://`` have empty host and path, fit no rule and are allowed with score 0.
    Null ids and repeated rows stay; other columns are ignored; an empty table gives
    an empty result.
    """
    model = UrlModel().fit(labelled_urls if labelled_urls is not None else labelled())
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    names = parts.schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host_part = lru_cache(65_536)(lambda text: model.part("h", text))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            scores = [
                round(1 / (1 + math.exp(-max(-50.0, min(50.0, host_part(h) + model.part("p", p) + model.bias)))), 9) if h or p else 0.0
                for h, p in zip(hosts, paths)
            ]
            verdicts = [v or ("block" if s >= threshold else "allow") for v, s in zip(batch.column(4).to_pylist(), scores)]
            columns = [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "host", "path", "rule", "verdict", "score"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names.fields)
    return parts.mapInArrow(score, f"{kinds}, score double")
