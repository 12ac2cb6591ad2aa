r"""Personal data by fixed patterns and by weakly supervised labelers, in native expressions.

Base kinds (email, ip, card, phone) are found by their patterns and checks and always stay. Further candidates
(local phone numbers, social security numbers, bank accounts, secrets) come from broad patterns. Five labelers
vote on each: its format, a gazetteer, words before it that speak for it, words before it that speak against it,
and its shape. Spark counts the vote patterns over all documents; from these counts, at most 3^5 for a kind,
expectation-maximisation estimates how reliable each labeler is and trains the span classifier that decides
every candidate.

A pattern's places follow from the gaps between its matches. Repetitions are possessive and matches may begin only
where a run begins or the match before ends, so that long runs take linear time and no deep recursion.

Defined cases: null text has no spans; each row is searched whole and by itself; overlapping kinds all count;
without candidates the model is empty and adds nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelode.llm.common import let, whole
from tracelode.session import cut

BASE = ("email", "ip", "card", "phone")
BASE_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has no span of the kind.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{1,2}+", "phone": r"\+[0-9]"}
EXTRA_PATTERNS = {
    "local_phone": r"(?<![0-9+.-])(?<!\) )(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
EXTRA_HINTS = {"local_phone": r"[0-9]{3}[ .-][0-9]{4}", "ssn": r"[0-9]-[0-9]{2}-[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9_/+=-]{20}"}
KINDS = (*BASE, *EXTRA_PATTERNS)
#: Code points before a candidate that its context labelers see.
CONTEXT = 48
YES, NO, NONE = "2", "1", "0"
FORMAT = {
    "local_phone": r"^\(?[2-9][0-9]{2}\)?[ .-]?[2-9]",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{12,34}$",
    "secret": r"^(?=.*[0-9])(?=.*[A-Za-z])",
}
#: Countries with bank account numbers of this form, area codes without subscribers, and beginnings of keys.
GAZETTEER = {
    "local_phone": r"^\(?(?:800|888|877|866|855|844|833|555)",
    "ssn": r"^(?:078-05-1120|219-09-9999|123-45-6789)",
    "iban": r"^(?:AD|AE|AL|AT|BA|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IL|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SA|SE|SI|SK|TR)",
    "secret": r"^(?:sk-|pk-|ghp_|gho_|AKIA|ASIA|xox[bp]-|eyJ|AIza)",
}
#: What a hit in the gazetteer means for the kind.
GAZETTEER_VOTE = {"local_phone": NO, "ssn": NO, "iban": YES, "secret": YES}
FOR = {
    "local_phone": r"(?i)(?:phone|tel|call|mobile|cell|fax|contact)[^0-9]{0,20}$",
    "ssn": r"(?i)(?:ssn|social|security|taxpayer)[^0-9]{0,20}$",
    "iban": r"(?i)(?:iban|account|bank|konto|compte|cuenta)[^0-9]{0,20}$",
    "secret": r"(?i)(?:token|key|secret|passw|pwd|credential|bearer|auth)[^0-9]{0,12}$",
}
AGAINST = r"(?i)(?:order|part|serial|item|page|version|line|ref|https?:|www\.)[^\n]{0,12}$|/$"
SHAPE = {
    "local_phone": r"^\([0-9]{3}\)", "ssn": r"^[0-9]", "iban": r"[0-9]{4}",
    "secret": r"^[0-9a-f]{32,}$|^(?=.*[0-9].*[0-9].*[0-9].*[0-9])(?=.*[A-Z])(?=.*[a-z])",
}
ACCEPT = 0.5
SPAN = "array<struct<start: bigint, end: bigint, match: string, before: string>>"


def located(text: Column, pattern: str, hint: str) -> Column:
    """start, end, match and the text before of every match, in code points; nothing where the hint is not found."""

    def place(m: Column, g: Column) -> Column:
        ends = F.aggregate(
            F.sequence(F.lit(0), F.size(m) - 1), F.array(F.lit(0).cast("bigint")),
            lambda acc, i: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(F.get(g, i)) + F.length(F.get(m, i)))))
        return let(ends, lambda e: F.transform(m, lambda x, i: F.struct(
            (F.get(e, i + 1) - F.length(x)).alias("start"), F.get(e, i + 1).alias("end"), x.alias("match"),
            F.right(F.get(g, i), F.lit(CONTEXT)).alias("before"))))

    def all_of(m: Column) -> Column:
        return F.when(F.size(m) == 0, F.array().cast(SPAN)).otherwise(let(F.split(text, pattern, -1), lambda g: place(m, g)))

    found = let(F.regexp_extract_all(text, F.lit(pattern), 0), all_of)
    return F.when(text.rlike(hint), found).otherwise(F.array().cast(SPAN)).cast(SPAN)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """Whether the digits pass the check sum."""

    def total(d: Column) -> Column:
        values = F.transform(F.split(F.reverse(d), ""), lambda c, i: let(
            c.cast("int") * (1 + i % 2), lambda v: F.when(v > 9, v - 9).otherwise(v)))
        return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0

    return let(digits(match), total)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": luhn,
    "phone": lambda m: F.length(digits(m)).between(8, 15),
}


def _checked(kind: str, found: Column) -> Column:
    return F.filter(found, lambda s: CHECKS[kind](s["match"]))


def base_spans(text: Column) -> list[Column]:
    """The checked spans of each base kind, in order of kinds."""
    return [_checked(kind, located(text, BASE_PATTERNS[kind], HINTS[kind])) for kind in BASE]


def votes(kind: str, match: Column, before: Column) -> Column:
    """The labelers' votes, one character each."""
    yes = lambda c, other=NONE: F.when(c, YES).otherwise(other)
    return F.concat(
        yes(match.rlike(FORMAT[kind]), NO),
        F.when(match.rlike(GAZETTEER[kind]), GAZETTEER_VOTE[kind]).otherwise(NO if kind == "iban" else NONE),
        yes(before.rlike(FOR[kind])),
        F.when(before.rlike(AGAINST), NO).otherwise(NONE),
        yes(match.rlike(SHAPE[kind]), NO if kind == "secret" else NONE),
    )


def _voted(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), votes(kind, s["match"], s["before"]).alias("votes")))


def candidates(text: Column) -> list[Column]:
    """start, end and votes of each kind's candidates."""
    return [_voted(kind, located(text, EXTRA_PATTERNS[kind], EXTRA_HINTS[kind])) for kind in EXTRA_PATTERNS]


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def search(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans of each kind and the candidates of each further kind; stored, without the text."""
    text = whole("text")
    return cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[bare(s).alias(k) for k, s in zip(BASE, base_spans(text), strict=True)],
        *[c.alias(k) for k, c in zip(EXTRA_PATTERNS, candidates(text), strict=True)],
    ))


def expectation_maximisation(x: np.ndarray, kind: np.ndarray, n: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(personal data) of each vote pattern: class priors by kind, and each labeler's votes given the truth.

    x has the votes (0 none, 1 no, 2 yes) of each pattern, n how often it occurs. The first guess is the majority.
    """
    p = np.clip(0.5 + 0.2 * ((x == 2).sum(1) - (x == 1).sum(1)), 0.05, 0.95)
    weight = n.astype(float)
    for _ in range(rounds):
        kinds = kind.max() + 1
        prior = (np.bincount(kind, weight * p, kinds) + 1) / (np.bincount(kind, weight, kinds) + 2)
        log = np.stack([np.log(1 - prior[kind]), np.log(prior[kind])], 1)
        for j in range(x.shape[1]):
            for y, q in enumerate((1 - p, p)):
                rate = np.bincount(x[:, j], weight * q, 3) + 0.5 + (np.arange(3) == (1, 2)[y])
                log[:, y] += np.log(rate / rate.sum())[x[:, j]]
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if np.abs(new - p).max() < 1e-6:
            return new
        p = new
    return p


def span_classifier(x: np.ndarray, kind: np.ndarray, n: np.ndarray, p: np.ndarray, rounds: int = 50) -> np.ndarray:
    """A logistic classifier of votes and kind, trained on the estimated labels; its probability of each pattern."""
    columns = [x == 1, x == 2, kind[:, None] == np.arange(kind.max() + 1)]
    f = np.hstack(columns).astype(float)
    w = np.zeros(f.shape[1])
    weight = n / n.sum() * min(n.sum(), 1e6)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))
        slope = f.T @ (weight * (q - p)) + 0.1 * w
        step = np.linalg.solve((f * (weight * q * (1 - q))[:, None]).T @ f + 0.1 * np.eye(len(w)), slope)
        w -= np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(f @ w, -30, 30)))


def learn(found: DataFrame) -> dict[tuple[str, str], float]:
    """The classifier's probability for each kind and vote pattern that the corpus has."""
    rows = None
    for kind in EXTRA_PATTERNS:
        one = found.select(F.lit(kind).alias("kind"), F.explode(kind).alias("c")).select("kind", "c.votes")
        rows = one if rows is None else rows.union(one)
    # At most 3^5 patterns for a kind.
    counts = sorted((r["kind"], r["votes"], r["n"]) for r in rows.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return {}
    kinds = sorted({k for k, _, _ in counts})
    x = np.array([[int(c) for c in v] for _, v, _ in counts])
    kind, n = np.array([kinds.index(k) for k, _, _ in counts]), np.array([c for _, _, c in counts])
    p = span_classifier(x, kind, n, expectation_maximisation(x, kind, n))
    return {(k, v): float(q) for (k, v, _), q in zip(counts, p, strict=True)}


def accepted(model: dict[tuple[str, str], float]) -> dict[str, list[str]]:
    """The vote patterns that make a candidate of a kind a span."""
    out: dict[str, list[str]] = {k: [] for k in EXTRA_PATTERNS}
    for (kind, pattern), p in model.items():
        if p >= ACCEPT:
            out[kind].append(pattern)
    return out


def written(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def passed(kind: str, found: Column, patterns: dict[str, list[str]]) -> Column:
    """The candidates of a kind that the classifier takes."""
    return bare(F.filter(found, lambda s: s["votes"].isin(*patterns[kind]) if patterns[kind] else F.lit(False)))


def report(found: DataFrame, model: dict[tuple[str, str], float]) -> DataFrame:
    """One row per document: counts and hash of the base spans, and all spans."""
    patterns = accepted(model)
    base = F.flatten(F.array(*[written(k, F.col(k)) for k in BASE]))
    extra = F.flatten(F.array(*[written(k, passed(k, F.col(k), patterns)) for k in EXTRA_PATTERNS]))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, extra), ",").alias("spans"))


def detect(docs: DataFrame) -> DataFrame:
    found = search(docs)
    return report(found, learn(found))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def merged(spans: Column) -> Column:
    """Sorted spans with overlapping ones made one, of the first base kind among them, else of the first kind."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        kind = F.when(last["kind"].isin(*BASE) | ~s["kind"].isin(*BASE), last["kind"]).otherwise(s["kind"])
        one = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), kind.alias("kind"))
        return F.when(s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start: bigint, end: bigint, kind: string>>"), add)


def masked(text: Column, model: dict[tuple[str, str], float]) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans are replaced as one."""
    patterns = accepted(model)
    kinds = [*zip(BASE, base_spans(text), strict=True), *[(k, passed(k, c, patterns)) for k, c in zip(EXTRA_PATTERNS, candidates(text), strict=True)]]
    spans = merged(F.array_sort(F.flatten(F.array(*[_named(k, s) for k, s in kinds]))))
    start = F.struct(F.lit(0).cast("bigint").alias("end"), F.array().cast("array<string>").alias("parts"))

    def add(acc: Column, s: Column) -> Column:
        part = F.concat(F.substring(text, (acc["end"] + 1).cast("int"), (s["start"] - acc["end"]).cast("int")), F.lit("<"), s["kind"], F.lit(">"))
        return F.struct(s["end"].alias("end"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, (acc["end"] + 1).cast("int"), F.length(text)))
    return let(spans, lambda s: F.when(F.size(s) == 0, text).otherwise(F.aggregate(s, start, add, rest)))
