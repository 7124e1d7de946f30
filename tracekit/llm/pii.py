"""Personal data by weak supervision, in DataFrame functions only.

Method
* Candidates: leftmost non-overlapping matches of one pattern for each kind. The base kinds (email, ip, card, phone)
  are kept as they are; the candidates of the other kinds (a phone number without country code, a number grouped like a social
  security number) are kept if the classifier accepts them.
* Labelers vote yes, no or nothing on each candidate: strict formats (regex), gazetteers (top-level domains, calling codes, issuer
  and area numbers), and context (cue words before it, letters or digits that touch it).
* Expectation-maximisation over the counts of vote patterns (kinds times votes, a few hundred at most) estimates each labeler's
  reliability and the share of true candidates, and so each pattern's probability.
* A naive Bayes span classifier is trained on these probabilities with the candidate's own features (kind, length, shape, neighbours),
  and scores every candidate as one expression.

The text is read once; nothing but counts of vote patterns and of feature values reaches the driver. Offsets are code points: the
lengths of the gaps between matches and of the matches are added up in blocks.

Defined results: null text has no spans; repeated rows give repeated results; ids may be null; an empty table
gives an empty result; with no candidates at all there is nothing to learn and nothing to add.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tracekit.llm.common import settle, ship

ship(__name__)

BASE = ("email", "ip", "card", "phone")
# Leftmost matches as the contract words them. Possessive quantifiers and the look-behind only spare retries inside a run that has
# failed from its start; a match may begin inside a run where another one has just ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "local": r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z+.()-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
KINDS = tuple(PATTERNS)
CONTEXT = 32
PREFIX_BLOCK = 256
EM_ROUNDS = 50
THRESHOLD = 0.5
# gazetteers, fixed values
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu", "ch", "at", "it", "nl")
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
           "52", "54", "55", "61", "81", "86", "91")
CUES = {
    "email": "mail|contact|kontakt|correo|courriel|write",
    "ip": "ip|host|server|address|adresse",
    "card": "card|karte|carte|tarjeta|visa|credit|pay",
    "phone": "phone|tel|call|mobile|handy|fax|anruf|appel|llam",
    "local": "phone|tel|call|mobile|handy|fax|anruf|appel|llam",
    "ssn": "ssn|social|security",
}


def running_sum(lengths: Column) -> Column:
    """The sums of the first 1, 2, 3... numbers of an array, in blocks so that long arrays are not copied for each element."""
    def sums(a: Column) -> Column:
        return F.aggregate(a, F.array(F.lit(0).cast("long")), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    last = F.floor((F.size(lengths) - 1) / PREFIX_BLOCK).cast("int")
    blocks = F.transform(F.when(F.size(lengths) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")),
                         lambda i: sums(F.slice(lengths, i * PREFIX_BLOCK + 1, F.lit(PREFIX_BLOCK))))
    before = sums(F.transform(blocks, lambda b: F.element_at(b, -1)))
    return F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, F.lit(2), F.size(b) - 1), lambda x: x + F.get(before, i))))


def _passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _matches(text: Column, kind: str) -> Column:
    """(found, gaps): the matches of a kind's pattern and the texts before, between and after them."""
    none = F.array().cast("array<string>")
    sign = {"email": "@", "phone": "+", "ssn": "-"}.get(kind)
    there = F.lit(True) if sign is None else F.instr(text, sign) > 0
    found = F.when(there, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none)
    gaps = F.when(there, F.split(text, PATTERNS[kind], -1)).otherwise(none)
    return F.struct(F.coalesce(found, none).alias("found"), F.coalesce(gaps, none).alias("gaps"))


def _ends(kind: str) -> Column:
    """Where each match of a kind ends."""
    found, gaps = F.col(f"{kind}.found"), F.col(f"{kind}.gaps")
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
    return running_sum(both)


def _spans(kind: str) -> Column:
    """The matches that pass, as (kind, start, end, match, left, right)."""
    found, gaps, ends = F.col(f"{kind}.found"), F.col(f"{kind}.gaps"), F.col(f"{kind}_ends")
    rows = F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), (F.get(ends, i) - F.char_length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("match"),
        F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("right")))
    return F.filter(rows, lambda x: _passes(kind, x["match"]))


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all candidates of each text; those of an added kind that touch a base span are left out."""
    rows = docs.select("doc_id", "text")
    rows = rows.select("doc_id", *[_matches(F.col("text"), k).alias(k) for k in KINDS])
    rows = rows.select("doc_id", *KINDS, *[_ends(k).alias(f"{k}_ends") for k in KINDS])
    rows = rows.select("doc_id", *[_spans(k).alias(k) for k in KINDS])
    base = F.concat(*[F.col(k) for k in BASE])
    rows = rows.select("doc_id", base.alias("base"), F.concat(*[F.col(k) for k in KINDS if k not in BASE]).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return rows.select("doc_id", F.concat("base", apart).alias("spans"))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "y").when(no, "n").otherwise("-")


def labelers(x: Column) -> list[Column]:
    """Each labeler's vote on a candidate: y, n or - for none."""
    kind, match, left, right = x["kind"], x["match"], x["left"], x["right"]
    digits = F.regexp_replace(match, "[^0-9]", "")
    mails, numbers, cards = kind == "email", kind.isin("phone", "local"), kind == "card"
    domain = F.lower(F.regexp_extract(match, r"\.([A-Za-z0-9-]+)$", 1))
    tidy = (F.when(mails, match.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$"))
            .when(kind == "ip", ~match.rlike(r"(^|\.)0[0-9]"))
            .when(cards, match.rlike(r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})$"))
            .when(kind == "phone", match.rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[0-9 .-]+$")).otherwise(F.lit(True)))
    known = (F.when(mails, domain.isin(list(DOMAINS)))
             .when(kind == "ip", ~match.rlike(r"^(?:0|127|255)\."))
             .when(cards, digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"))
             .when(kind == "phone", digits.rlike(f"^(?:{'|'.join(CALLING)})"))
             .when(kind == "local", digits.rlike("^[2-9][0-9]{2}[2-9]"))
             .otherwise(~digits.rlike("^(?:000|666|9)") & ~digits.rlike("0000$|^...00")))
    cue = F.lit(False)
    for k, words in CUES.items():
        cue = F.when(kind == k, F.lower(left).rlike(words)).otherwise(cue)
    touched = left.rlike(r"[A-Za-z0-9_.@/#=-]$") | right.rlike(r"^(?:[A-Za-z0-9_@/#=-]|\.[0-9])")
    alone = (left.rlike(r"(?:^|[\s(\"'<:;,])$")) & (right.rlike(r"^(?:$|[\s)\"'>:;,.!?])"))
    rounds = digits.rlike(r"^(\d)\1*$") & ~mails
    return [_vote(tidy, ~tidy), _vote(known, ~known), _vote(cue, F.lit(False)), _vote(alone, touched), _vote(F.lit(False), rounds)]


def estimate(counts: Mapping[tuple[str, str], int], rounds: int = EM_ROUNDS) -> tuple[dict[tuple[str, str], float], list[dict[str, dict[str, float]]]]:
    """EM on counts of (kind, votes): the probability that a candidate with these votes is true, and each
    labeler's probabilities of a vote given truth ("t") and given falsehood ("f").

    Labelers are independent given the truth; the share of true candidates is estimated for each kind. It starts from
    the majority of votes, and every probability is smoothed by one observation.
    """
    width = len(next(iter(counts))[1]) if counts else 0
    prob = {c: 0.5 + 0.4 * (c[1].count("y") - c[1].count("n")) / max(1, width - c[1].count("-")) for c in counts}
    rates: list[dict[str, dict[str, float]]] = []
    for _ in range(rounds):
        rates = []
        for j in range(width):
            sums = {"t": dict.fromkeys("yn-", 1 / 3), "f": dict.fromkeys("yn-", 1 / 3)}
            for c, n in counts.items():
                sums["t"][c[1][j]] += n * prob[c]
                sums["f"][c[1][j]] += n * (1 - prob[c])
            rates.append({s: {v: x / sum(by.values()) for v, x in by.items()} for s, by in sums.items()})
        share = {}
        for kind in {k for k, _ in counts}:
            own = [(c, n) for c, n in counts.items() if c[0] == kind]
            share[kind] = (sum(n * prob[c] for c, n in own) + 0.5) / (sum(n for _, n in own) + 1)
        for c in counts:
            odds = math.log(share[c[0]] / (1 - share[c[0]])) + sum(math.log(rates[j]["t"][v] / rates[j]["f"][v]) for j, v in enumerate(c[1]))
            prob[c] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return prob, rates


def features(x: Column) -> list[Column]:
    """Few-valued features of a candidate, each as text."""
    near = lambda c: (F.when(c == "", "end").when(c.rlike(r"[0-9]"), "digit").when(c.rlike(r"\s"), "space")
                      .when(c.rlike(r"[A-Za-z]"), "letter").otherwise("sign"))
    size = F.least(F.char_length(x["match"]), F.lit(40)).cast("string")
    digits = F.regexp_replace(x["match"], "[^0-9]", "")
    shape = F.regexp_replace(F.regexp_replace(x["match"], "[0-9]+", "9"), "[A-Za-z]+", "a")
    return [F.concat(F.lit(f"{name}="), x["kind"], F.lit("/"), value) for name, value in (
        ("kind", F.lit("")), ("size", size), ("left", near(F.right(x["left"], F.lit(1)))), ("right", near(F.left(x["right"], F.lit(1)))),
        ("distinct", F.size(F.array_distinct(F.split(digits, ""))).cast("string")),
        ("cue", labelers(x)[2]), ("signs", F.left(F.regexp_replace(shape, "[9a]", ""), F.lit(4))))]


def train(spans: DataFrame) -> tuple[dict[str, float], list]:
    """(weights by feature value, labeler reliabilities) from the candidates of all documents."""
    rows = spans.select(F.explode("spans").alias("x"))
    votes = F.concat(*labelers(F.col("x")))
    # at most kinds * 3 ** labelers rows
    counts = {(r["kind"], r["votes"]): r["n"] for r in rows.groupBy(F.col("x.kind").alias("kind"), votes.alias("votes")).agg(F.count("*").alias("n")).collect()}
    prob, rates = estimate(dict(sorted(counts.items())))
    if not counts:
        return {}, rates
    # whole numbers, so that the sums do not depend on their order
    pattern = F.create_map(*[F.lit(v) for (k, s), p in prob.items() for v in (f"{k}/{s}", round(p * 1_000_000))])
    soft = F.element_at(pattern, F.concat("x.kind", F.lit("/"), votes)).cast("long")
    sums = (rows.select(soft.alias("p"), F.explode(F.array(*features(F.col("x")))).alias("f"))
            .groupBy("f").agg(F.sum("p").alias("t"), F.count("*").alias("n")).collect())  # features have few values
    total = {k: [0.0, 0.0] for k in KINDS}
    for (k, s), n in counts.items():
        total[k][0] += n * prob[k, s]
        total[k][1] += n * (1 - prob[k, s])
    weights = {}
    for r in sums:
        name, _, rest = r["f"].partition("=")
        kind = rest.partition("/")[0]
        true, false = r["t"] / 1e6, max(0.0, r["n"] - r["t"] / 1e6)
        if name == "kind":
            weights[r["f"]] = math.log((true + 1) / (false + 1))
        else:
            weights[r["f"]] = math.log((true + 1) / (total[kind][0] + 2)) - math.log((false + 1) / (total[kind][1] + 2))
    return weights, rates


def probability(x: Column, weights: Mapping[str, float]) -> Column:
    table = F.create_map(*[F.lit(v) for k, w in sorted(weights.items()) for v in (k, float(w))]) if weights else None
    odds = F.lit(0.0)
    for f in features(x) if weights else []:
        odds = odds + F.coalesce(F.try_element_at(table, f), F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def find_personal_data(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans): base spans and the added ones the classifier accepts, by start, then kind as listed."""
    found = settle(find_candidates(docs))
    weights, _ = train(found)
    order = F.array(*[F.lit(k) for k in KINDS])
    kept = F.filter("spans", lambda x: x["kind"].isin(list(BASE)) | (probability(x, weights) >= threshold))
    sort = F.sort_array(F.transform(kept, lambda x: F.struct(x["start"], F.array_position(order, x["kind"]).alias("at"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return found.select("doc_id", F.transform(sort, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))
