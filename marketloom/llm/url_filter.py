"""URL filtering: host and path rules first, then a weighted vocabulary of terms.

The vocabulary is matched by one Aho-Corasick automaton over the whole URL, its
``%xx`` and ``xn--`` labels decoded. A hit counts only if it stands between
characters that are neither letters nor digits (or the ends of the URL; in the
host digits may stand beside it), but for terms of scripts that don't space words.
One strict term rejects a URL, wherever it stands; soft terms reject it when the
weights of the distinct ones found outside of tracking parameters add up to a
threshold that none has alone. A strict term of double meaning counts as a soft
one where a word like ``education`` or ``filter`` stands in the URL too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import unquote

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import with_columns

#: Rules ``(verdict, host and path)``; the longest that fits a URL decides.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Terms that reject a URL on their own.
STRICT = tuple(
    """
    adult camgirl camgirls casino casinos escort escorts hentai malware milf phishing porn porno pornos spam viagra cialis warez xxx
    kasino spielautomaten pornofilme erotikfilme sexkontakte
    pornographie videoporno tragamonedas apuestas pornografia
    gokkasten pornofilmy kasyno bahis
    порно казино эскорт проститутки
    色情 赌博 賭博 赌场 賭場 成人视频 アダルト動画 出会い系 카지노 야동
    """.split()
)
#: Strict terms of double meaning, the words that tell the harmless one, and the weight that such a term has then.
AMBIGUOUS = frozenset("adult escort escorts malware phishing spam".split())
HARMLESS = frozenset(
    """
    analysis anti awareness blocker children class classes colour color defence defense detection education fiction filter filters food ford
    learning literacy nursing prevention protect protection recipe removal report research scanner school security training warning
    """.split()
)
AMBIGUOUS_WEIGHT = 3
#: Soft terms by weight: 3 for trades that filters exist for, 2 for their wares and lures, 1 for words that are common elsewhere too.
SOFT_BY_WEIGHT = {
    3: """ads adserver adclick affiliates bets betting clickbait gambling hardcore jackpot keygen meds nude nudes nulled payday pharmacy pills poker
          popunder roulette sex slots torrent torrents
          wetten glücksspiel erotik schlüsseldienst medikamente paris-sportifs érotique apuesta erótica scommesse apostas cassino gokken kumar zakłady
          секс ставки таблетки""",
    2: """affiliate bet bonus cams crack cracked dating freebie girls gratis keno loan loans lottery pill popup promo replica serial
          steroids tracker weightloss
          kredit kredite potenzmittel gewinnspiel rencontres crédit prêt préstamo citas prestito incontri empréstimo lening kredyt
          бонус кредит знакомства""",
    1: """ad bargain cam cash cheap coupon deal deals discount download farm free hot instant offer offers rich track win winner
          billig kostenlos rabatt gratuit promotion barato descuento grátis sconto goedkoop tani дешево скидка бесплатно""",
}
SOFT = {term: weight for weight, terms in SOFT_BY_WEIGHT.items() for term in terms.split()}
#: Weight of distinct soft terms from which a URL is rejected; no term has it alone.
SOFT_LIMIT = 4
#: Parameters that name where a visitor came from and say nothing of the page.
TRACKING = r"([?&])(utm_[A-Za-z0-9_]*|ref|gclid|fbclid|msclkid)=[^&#]*"
#: From this character on scripts write words without spaces or with endings: their terms count inside longer runs too.
UNSPACED = "\u2e80"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """``(rule, verdict)`` of the longest rule that fits, null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


_LABEL = re.compile(r"xn--[a-z0-9-]+")
_HOST = re.compile(r"://([^/?#]*)")


def _unpunycode(label: re.Match) -> str:
    try:
        return label.group()[4:].encode("ascii").decode("punycode")
    except (UnicodeError, OverflowError):
        return label.group()


def build_automaton(strict=STRICT, soft=SOFT) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for word in HARMLESS:
        automaton.add_word(word, (word, 0))
    for term in strict:
        automaton.add_word(term, (term, None))
    for term, weight in soft.items():
        automaton.add_word(term, (term, weight))
    automaton.make_automaton()
    return automaton


def _found(url: str, automaton: ahocorasick.Automaton) -> dict[str, int | None]:
    """Distinct terms of a URL with their weights (None: strict, 0: a harmless word)."""
    low, found = unquote(url).lower(), {}
    host = _HOST.search(low)
    if host and "xn--" in host.group():
        low = low[: host.start(1)] + _LABEL.sub(_unpunycode, host.group(1)) + low[host.end(1) :]
        host = _HOST.search(low)
    first, last = host.span(1) if host else (0, 0)

    def apart(at: int) -> bool:
        return at < 0 or at >= len(low) or not low[at].isalnum() or first <= at < last and low[at].isdigit()

    for end, (term, weight) in automaton.iter(low):
        if term >= UNSPACED or apart(end - len(term)) and apart(end + 1):
            found[term] = weight
    return found


def term_hits(url: str | None, bare: str | None, automaton: ahocorasick.Automaton) -> tuple[list[str], list[str], int]:
    """Distinct strict terms of a URL, distinct soft ones of it without tracking parameters, and the weight of these."""
    whole = _found(url or "", automaton)
    told = whole if bare == url else _found(bare or "", automaton)
    # what softens a term must not come from a tracking parameter
    softened = AMBIGUOUS if 0 in told.values() else frozenset()
    strict = {t for t, weight in whole.items() if weight is None and t not in softened}
    soft = {t: AMBIGUOUS_WEIGHT if weight is None else weight for t, weight in told.items() if weight != 0 and t not in strict}
    return sorted(strict), sorted(soft), sum(soft.values())


def vocabulary_column(url_col: str, strict=STRICT, soft=SOFT) -> Column:
    """Struct ``strict_terms, soft_terms, soft_weight`` of a URL column."""

    @F.pandas_udf("strict_terms array<string>, soft_terms array<string>, soft_weight int")
    def hits(urls: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        automaton = build_automaton(strict, soft)
        for whole, bare in urls:
            yield pd.DataFrame([term_hits(u, b, automaton) for u, b in zip(whole, bare)], columns=["strict_terms", "soft_terms", "soft_weight"])

    return hits(F.col(url_col), F.regexp_replace(url_col, TRACKING, "$1"))


def judge_urls(pages: DataFrame, *, url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """All columns of ``pages`` plus ``host, path, rule, verdict, strict_terms, soft_terms, soft_weight``.

    The verdict is that of the longest rule that fits host and path; without one
    it is the vocabulary's. A null URL, or one without ``://``, has an empty host
    and path and is judged by the vocabulary (null: allow). Input columns named
    like an added one give way; empty tables stay empty; rows are independent, so
    repeated ones get the same verdict. A URL of any length is matched whole, in
    time linear in it. Nothing is shuffled. ``strict`` (terms) and ``soft`` (terms
    and weights) take another vocabulary, such as one read from a table.
    """
    url = F.col(url_col)
    hit = with_columns(pages, host=host_of(url), path=path_of(url), __hits=vocabulary_column(url_col, strict, soft))
    ruled = hit.withColumn("__rule", rule_for(F.col("host"), F.col("path"), rules))
    rejected = (F.size("__hits.strict_terms") > 0) | (F.col("__hits.soft_weight") >= soft_limit)
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(rejected, "block").otherwise("allow"))
    out = with_columns(ruled, rule=F.col("__rule.rule"), verdict=verdict, strict_terms=F.col("__hits.strict_terms"), soft_terms=F.col("__hits.soft_terms"), soft_weight=F.col("__hits.soft_weight"))
    return out.drop("__hits", "__rule")
