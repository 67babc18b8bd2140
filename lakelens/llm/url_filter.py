"""URL verdicts: longest host-and-path rule first, else a weighted vocabulary.

Rules are plain Column expressions. Urls that no rule decides are scored with
one Aho-Corasick pass over the lower-cased url: a term counts where no ASCII
letter or digit touches it; one strict term, or several distinct soft terms,
whose weights reach a limit, reject the url.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: One of these in a url is enough.
STRICT = tuple(
    """
    bestiality blackjack bukkake camgirl camgirls casino casinos cialis creampie cumshot escort escorts fleshlight gangbang hardcoresex hentai
    incest jailbait keygen keygens kamagra levitra malware milf milfs nudes onlinecasino phentermine phishing porn porno pornos pornstar pornstars
    ransomware serialz sexcam sexcams sexshop slutty spyware sportsbook striptease torrent torrents tramadol upskirt viagra warez xanax xxx
    """.split()
)
#: Weights of terms that are only telling together, 1 for words that clean urls have too, 2 for others.
SOFT = dict.fromkeys(
    """
    action ads banner bargain bet bonus buy cam cams cash cheap click coupon coupons crack credit date dating deal deals discount download earn
    farm fast finance free gift hot instant link links loan loans lose money offer offers online order outlet pills play popup price prize
    promo promos rates rich sale sales sexy spin sponsor sponsored stream sweet teen teens track tracker trial unlimited weight win winner winners
    """.split(),
    1,
) | dict.fromkeys(
    """
    adult adults affiliate babes betting bets boobs booty clickbait clickbank counterfeit cracked doubleclick erotic erotica fetish forex gambling
    giveaway hookup jackpot lingerie lottery lotto naked nude nudity nulled payday pharmacy poker replica replicas roulette seo sex slot slots
    spam steroids swingers topless webcam webcams
    """.split(),
    2,
)
#: Weight from which at least two distinct soft terms reject.
SOFT_LIMIT = 3

#: Fixed values of the host-and-path query: rule and verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty without ``://`` or for a null url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[str]) -> Column:
    """The longest rule ``host/path`` whose host is the url's or a parent and whose path starts the url's; else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


class Vocabulary:
    """Strict and weighted soft terms in one automaton."""

    def __init__(self, strict=STRICT, soft=SOFT, limit=SOFT_LIMIT):
        self.limit, self.soft, self.strict = limit, dict(soft), set(strict)
        self.automaton = ahocorasick.Automaton()
        for term in [*self.strict, *self.soft]:
            self.automaton.add_word(term, term)
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, url: str) -> tuple[set[str], set[str]]:
        """Distinct strict and soft terms that stand alone in the url."""
        text = url.translate(_LOWERED)
        found = set()
        for end, term in self.automaton.iter(text) if len(self.automaton) else ():
            at = end + 1 - len(term)
            if (at == 0 or text[at - 1] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
                found.add(term)
        return found & self.strict, {t for t in found - self.strict if t in self.soft}

    def rejects(self, url: str) -> bool:
        return self.decides(*self.hits(url))

    def decides(self, strict: set[str], soft: set[str]) -> bool:
        return bool(strict) or len(soft) > 1 and sum(self.soft[t] for t in soft) >= self.limit


_LOWERED = str.maketrans(UPPER, LOWER)
_ALNUM = frozenset(LOWER + "0123456789")


def judge(pages: DataFrame, rules: dict[str, str] | None = None, vocabulary: Vocabulary | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: id, host, path, rule, verdict, n_strict and n_soft.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is judged by its text alone (null: allow). A url of any length is read
    whole. Repeated rows and rows without an id are judged alike; only the two
    named columns are read, so others cannot clash; an empty table gives an empty result.
    """
    importable(pages.sparkSession)
    rules, voc = RULES if rules is None else rules, vocabulary or Vocabulary()
    strict, soft, limit = voc.strict, voc.soft, voc.limit

    @F.pandas_udf("n_strict int, n_soft int, rejected boolean")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = Vocabulary(strict, soft, limit)  # one automaton a task
        for urls in parts:
            found = [v.hits(u or "") for u in urls]
            yield pd.DataFrame({"n_strict": [len(a) for a, _ in found], "n_soft": [len(b) for _, b in found], "rejected": [v.decides(a, b) for a, b in found]})

    host, path = host_and_path(F.col("url"))
    out = pages.select(F.col(id_col), F.col(url_col).cast("string").alias("url")).select(id_col, "url", host.alias("host"), path.alias("path"))
    out = out.withColumn("rule", matching_rule(F.col("host"), F.col("path"), list(rules))).withColumn("s", score("url"))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules.items():
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    verdict = F.coalesce(by_rule, F.when(F.col("s.rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(id_col, "host", "path", "rule", verdict.alias("verdict"), F.col("s.n_strict").alias("n_strict"), F.col("s.n_soft").alias("n_soft"))


def oracle_sql() -> str:
    """The same judgement in DuckDB SQL."""
    lit = lambda s: "'" + s.replace("'", "''") + "'"
    cases = []
    for rule in sorted(RULES, key=lambda r: (-len(r), r)):
        h, _, p = rule.partition("/")
        cases.append(f"WHEN (host = {lit(h)} OR ends_with(host, {lit('.' + h)})) AND starts_with(path, {lit('/' + p)}) THEN {lit(rule)}")
    hit = lambda t: f"CAST(regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INT)"
    strict, soft = " + ".join(map(hit, STRICT)), " + ".join(map(hit, SOFT))
    weight = " + ".join(f"{w} * {hit(t)}" for t, w in SOFT.items() if w != 1)
    light = " + ".join(hit(t) for t, w in SOFT.items() if w == 1)
    by_rule = " ".join(f"WHEN rule = {lit(r)} THEN {lit(v)}" for r, v in RULES.items())
    return f"""
WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
  CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, CASE {' '.join(cases)} END AS rule, {strict} AS n_strict, {soft} AS n_soft, {light} + {weight} AS weight FROM b)
SELECT page_id, host, path, rule, CASE {by_rule} WHEN n_strict > 0 OR (n_soft > 1 AND weight >= {SOFT_LIMIT}) THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n_strict AS INT) AS n_strict, CAST(n_soft AS INT) AS n_soft FROM c"""
