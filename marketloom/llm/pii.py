"""Personal data: fixed patterns, and terms that give protected values away.

The patterns find e-mail addresses, IP addresses, card and phone numbers; each
distinct value is a protected entity. Co-occurrence over the whole corpus then
tells how much a term reveals an entity e: its pointwise mutual information with
e against e's own information content, PMI(e; t) = IC(e) + log2 P(e | t). A term
whose PMI comes within ``SLACK_BITS`` of the whole information content leaves a
reader next to no doubt, and its occurrences become spans too. Such terms are
generalised to a marker of the entity's kind, or removed where they name one
entity almost surely.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import ahocorasick
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm._shared import durable, with_columns

#: The order in which kinds are listed; ``term`` is the method's own.
KINDS = ("email", "ip", "card", "phone", "term")
#: Words on either side of a protected value that count as its context.
CONTEXT_WORDS = 6
#: Different contexts in which a term must meet an entity before it can be judged.
LEAST_CONTEXTS = 3
#: A term discloses e if PMI(e; t) >= IC(e) - SLACK_BITS, which is P(e | t) >= 2 ** -SLACK_BITS.
SLACK_BITS = 1.0
#: From this P(e | t) on a term is removed, not generalised.
REMOVED_FROM = 0.9
#: Terms that are sent to the executors; more are joined to the texts instead.
MOST_TERMS = 500_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits is taken whole: a shorter start inside it can't match more
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# letters, digits and what holds a login or key together; a character of a script without spaces is a word
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3005-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+(?:[.'’-][^\W{_UNSPACED}]+)*")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Addresses, leftmost first: each ``@`` takes all that can precede it, then its domain.

    Going from one ``@`` to the next keeps long runs of letters linear.
    """
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            last = domain.end()
            out.append(("email", begin, last))
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_byte(digits: str) -> bool:
    """Whether a run of digits of any length is at most 255."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """All spans of the fixed patterns, by kind as listed, then by start; a match that fails its check is dropped."""
    out = emails(text) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_is_byte(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = re.sub(r"[ -]", "", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def _entity(text: str, span: Span) -> str:
    return f"{span[0]}:{xxhash.xxh64_hexdigest(text[span[1] : span[2]].lower().encode('utf-8', 'surrogatepass'))}"


def words_of(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Begin and end of each word that lies outside the spans."""
    out, ordered, at = [], sorted((b, e) for _, b, e in spans), 0
    for m in _WORD.finditer(text):
        begin, end = m.span()
        while at < len(ordered) and ordered[at][1] <= begin:
            at += 1
        # spans of different kinds may overlap: those after the next one begin later than it
        if at == len(ordered) or ordered[at][0] >= end:
            out.append((begin, end))
    return out


def _adjacent(text: str, left: tuple[int, int], right: tuple[int, int]) -> bool:
    """Whether two words form one name: nothing or one space stands between."""
    return left[1] == right[0] or (right[0] - left[1] == 1 and text[left[1]] == " ")


def terms_among(text: str, words: list[tuple[int, int]]) -> set[str]:
    """The words and pairs of adjacent words, in lower case."""
    out = {text[b:e].lower() for b, e in words}
    out |= {text[x[0] : y[1]].lower() for x, y in pairwise(words) if _adjacent(text, x, y)}
    return out


def contexts(text: str, spans: list[Span]) -> list[tuple[str, int, list[str]]]:
    """``(entity, hash of the context, its distinct terms)`` for each protected value of a text.

    The context are the six words before the value and the six after it, however
    far away; terms are words and pairs of adjacent ones.
    """
    words, out = words_of(text, spans), []
    begins, ends = [b for b, _ in words], [e for _, e in words]
    for span in spans:
        k, j = bisect_right(ends, span[1]), bisect_left(begins, span[2])
        before, after = words[max(0, k - CONTEXT_WORDS) : k], words[j : j + CONTEXT_WORDS]
        near = " ".join(text[b:e].lower() for b, e in before + after)
        terms = terms_among(text, before) | terms_among(text, after)
        out.append((_entity(text, span), xxhash.xxh64_intdigest(near.encode("utf-8", "surrogatepass"), seed=1) >> 1, sorted(terms)))
    return out


#: Counters that a task holds before it hands them on.
HELD = 50_000


def _batch(schema: pa.Schema, rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for batch in batches:
        yield from (t for t in batch.column(0).to_pylist() if t)


_MET = pa.schema([("entity", pa.string()), ("term", pa.string()), ("context", pa.int64()), ("n", pa.int64())])


def _count_meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a partition: rows with an entity, rows with both or with the term in any context, each different context."""
    seen: Counter = Counter()
    for text in _texts(batches):
        met: set[tuple[str | None, str | None, int | None]] = set()
        for entity, context, terms in contexts(text, base_spans(text)):
            met.add((entity, None, None))
            for t in terms:
                met |= {(entity, t, None), (entity, t, context), (None, t, None)}
        seen.update(met)
        if len(seen) > HELD:
            yield _batch(_MET, ((*k, n) for k, n in seen.items()))
            seen.clear()
    yield _batch(_MET, ((*k, n) for k, n in seen.items()))


def may_hold(terms: Iterable[str]) -> Callable[[str], bool]:
    """Whether any of the terms stands anywhere in a text, by one automaton: most texts hold none and needn't be cut into words."""
    automaton = ahocorasick.Automaton()
    for t in terms:
        automaton.add_word(t.replace("ς", "σ"), True)  # the one letter whose lower case hangs on what follows
    if not len(automaton):
        return lambda text: False
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text.lower().replace("ς", "σ")), None) is not None


_TERM = pa.schema([("term", pa.string()), ("n", pa.int64())])


def _count_terms(wanted):
    """Rows that hold a term, by term: of the wanted ones, or of all if there are too many to send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = wanted.value if wanted else None, Counter()
        may = (lambda text: True) if known is None else may_hold(known)
        for text in _texts(batches):
            if not may(text):
                continue
            own = terms_among(text, words_of(text, base_spans(text)))
            seen.update(own if known is None else own & known)
            if len(seen) > HELD:
                yield _batch(_TERM, seen.items())
                seen.clear()
        yield _batch(_TERM, seen.items())

    return run


def disclosing_terms(docs: DataFrame, *, text_col: str = "text", least_contexts: int = LEAST_CONTEXTS, slack_bits: float = SLACK_BITS, most_terms: int = MOST_TERMS) -> DataFrame:
    """``term, kind, entities, probability, bits`` of the terms that reveal an entity, from counts over all documents.

    ``probability`` is the largest P(entity | term), the share of the rows with
    the term in which it stands near the entity; ``bits`` the PMI behind it.
    Copies of a text repeat its contexts, and repeated contexts count once
    towards ``least_contexts``. A term is in at least as many rows as it is near
    any entity, which rules out nearly all pairs before terms are counted over
    whole texts; none is lost. Counts are combined in each task before any shuffle.
    """
    texts = docs.select(text_col)
    counts = durable(texts.mapInArrow(_count_meetings, "entity string, term string, context long, n long").groupBy("entity", "term", "context").agg(F.sum("n").alias("n")))
    total = docs.count()
    pairs = counts.filter("entity IS NOT NULL AND term IS NOT NULL").groupBy("entity", "term")
    both = pairs.agg(F.sum(F.when(F.col("context").isNull(), F.col("n"))).alias("n_both"), F.count("context").alias("n_contexts")).filter(F.col("n_contexts") >= least_contexts)
    near = counts.filter("entity IS NULL").select("term", F.col("n").alias("n_near"))
    least = 2.0**-slack_bits
    possible = durable(both.join(near, "term").filter(F.col("n_both") >= F.lit(least) * F.col("n_near")))
    wanted = durable(possible.select("term").distinct())
    few = wanted.count() <= most_terms
    sent = docs.sparkSession.sparkContext.broadcast({r["term"] for r in wanted.collect()}) if few else None
    of_term = texts.mapInArrow(_count_terms(sent), "term string, n long").join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n_term"))
    of_entity = counts.filter("term IS NULL").select("entity", F.col("n").alias("n_entity"))
    judged = possible.join(of_term, "term").join(of_entity, "entity")
    probability = F.least(F.lit(1.0), F.col("n_both") / F.col("n_term"))
    content = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    # the same rule as PMI >= IC - slack, without the rounding of logarithms
    judged = judged.withColumn("probability", probability).filter(F.col("probability") >= least).withColumn("bits", content + F.log2("probability"))
    # a pair one of whose words gives the value away says nothing more
    alone = durable(judged)
    words = F.when(F.col("term").contains(" "), F.split("term", " ")).when(F.col("term").rlike(f"^[{_UNSPACED}]{{2}}$"), F.split("term", ""))
    parts = alone.select(F.col("term").alias("pair"), "entity", F.explode(words).alias("term")).join(alone.select("term", "entity"), ["term", "entity"], "left_semi")
    judged = alone.join(parts.select(F.col("pair").alias("term"), "entity"), ["term", "entity"], "left_anti")
    kind = F.substring_index("entity", ":", 1)
    return judged.groupBy("term").agg(F.max_by(kind, F.struct("probability", "entity")).alias("kind"), F.count(F.lit(1)).alias("entities"), F.max("probability").alias("probability"), F.max("bits").alias("bits"))


def term_spans(text: str, base: list[Span], terms) -> list[Span]:
    """Where terms stand outside the base spans, from the left; a pair of words goes before its first word."""
    out, words, i = [], words_of(text, base), 0
    while i < len(words):
        begin, end = words[i]
        if i + 1 < len(words) and _adjacent(text, words[i], words[i + 1]) and text[begin : words[i + 1][1]].lower() in terms:
            out.append(("term", begin, words[i + 1][1]))
            i += 2
            continue
        if text[begin:end].lower() in terms:
            out.append(("term", begin, end))
        i += 1
    return out


def sanitised(text: str, spans: list[Span], terms: dict[str, str]) -> str:
    """The text with base spans and terms replaced; where spans overlap, the longest from the left wins."""
    out, at = [], 0
    for kind, begin, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= at:
            out += [text[at:begin], terms[text[begin:end].lower()] if kind == "term" else f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{begin}:{end}" for kind, begin, end in spans)


def replacements(terms: DataFrame) -> DataFrame:
    """``term, r``: what replaces each disclosing term."""
    r = F.when(F.col("probability") >= REMOVED_FROM, F.lit("")).otherwise(F.concat(F.lit("["), F.col("kind"), F.lit(" context]")))
    return terms.select("term", r.alias("r"))


_FOUND = "n_email long, n_ip long, n_card long, n_phone long, n_term long, base_sha256 string, spans string, sanitised_text string"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]


def _found(text: str | None, terms: dict[str, str], with_text: bool) -> tuple:
    text = text or ""
    base = base_spans(text)
    more = term_spans(text, base, terms) if terms else []
    n = Counter(kind for kind, _, _ in base)
    digest = hashlib.sha256(joined(base).encode()).hexdigest()
    clean = sanitised(text, base + more, terms) if with_text else None
    return n["email"], n["ip"], n["card"], n["phone"], len(more), digest, joined(base + more), clean


def find_personal_data(docs: DataFrame, *, text_col: str = "text", with_text: bool = True, most_terms: int = MOST_TERMS) -> DataFrame:
    """All columns of ``docs`` plus ``n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans, sanitised_text``.

    ``spans`` lists ``kind:start:end`` (code points, end exclusive) by kind as in
    ``KINDS``, then by start; ``base_sha256`` is the digest of the same list
    without terms. ``with_text=False`` leaves ``sanitised_text`` null. The corpus
    is read three times: for co-occurrence, for the rows of the terms that can
    disclose, and to find spans; documents aren't shuffled. If there are more
    disclosing terms than ``most_terms``, they aren't sent to the tasks: each
    different text is joined to its own ones by its digest instead.

    A null text is an empty one (no spans). Input columns named like an added one
    give way; empty tables stay empty; repeated rows get the same spans.
    """
    terms = durable(replacements(disclosing_terms(docs, text_col=text_col, most_terms=most_terms)))
    text = F.col(text_col)
    if terms.count() <= most_terms:
        shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["r"] for r in terms.collect()})

        @F.pandas_udf(_FOUND)
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = shared.value
            may = may_hold(own)
            for batch in batches:
                yield pd.DataFrame([_found(t, own if t and may(t) else {}, with_text) for t in batch], columns=_FOUND_NAMES)

        held = with_columns(docs, __found=find(text))
    else:

        @F.pandas_udf(_FOUND)
        def find_own(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, own in batches:
                rows = [_found(t, {x["term"]: x["r"] for x in ([] if x is None else x)}, with_text) for t, x in zip(texts, own, strict=True)]
                yield pd.DataFrame(rows, columns=_FOUND_NAMES)

        key = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
        in_texts = docs.select(key.alias("__key"), text.alias("t")).mapInArrow(_terms_of_texts, "__key string, term string").distinct()
        own = in_texts.join(terms, "term").groupBy("__key").agg(F.collect_list(F.struct("term", "r")).alias("__own"))
        keyed = with_columns(docs, __key=key)
        found = keyed.join(own, "__key", "left").withColumn("__found", find_own(text, F.col("__own")))
        held = found.select(*[f"`{c}`" for c in docs.columns], "__found")
    return with_columns(held, **{c: F.col(f"__found.{c}") for c in _FOUND_NAMES}).drop("__found")


_KEYED = pa.schema([("__key", pa.string()), ("term", pa.string())])


def _terms_of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's digest with each of its terms, each different text once per batch."""
    for batch in batches:
        texts = dict(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for key, text in texts.items():
            if text:
                terms = terms_among(text, words_of(text, base_spans(text)))
                yield _batch(_KEYED, ((key, t) for t in terms))
