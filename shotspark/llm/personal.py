"""Personal data in texts: labelers vote on spans, expectation-maximisation weighs them.

Everything here is column expressions.  Patterns mark candidate spans; regular expressions,
checksums, word lists and the words before a span vote on each; the counts of vote patterns
(a table as large as the number of patterns, whatever the corpus) give every labeler's
reliability, and the resulting beliefs train a logistic classifier that decides on the spans
beyond the base patterns.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotspark.session import durable

# Base patterns.  Runs are possessive and start where no earlier character could start them, so
# that the leftmost match is the same as with plain repetition while long runs cost linear time.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,}+(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
#: What a text must hold for a pattern to be tried at all.
HINTS = {"email": "@", "ip": ".", "phone": "+"}

# Public endings of domains, first digits of card issuers, words that announce a kind.
ENDINGS = ("com", "org", "net", "edu", "gov", "int", "info", "io", "de", "fr", "es", "uk", "eu", "us")
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68])"
ANNOUNCED = {
    "email": r"(e-?mail|mail|contact|write|address)\W*$", "ip": r"\b(ip|host|server|address|from)\W*$",
    "card": r"(card|visa|mastercard|credit|payment|account)\W*(no|number|nr)?\W*$",
    "phone": r"(phone|tel|call|mobile|fax|cell)\W*$",
    "secret": r"(token|key|secret|password|passwd|pwd|credential|auth)\W*$",
}

SPAN = "struct<start:int,stop:int,found:string,before:string,after:string>"
LABELERS = ("shape", "check", "gazetteer", "context", "border")


def marked_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches: start, stop (code points), match and its surroundings.

    Matches are put between two control characters; those of the text itself are masked
    before by a third, which no pattern matches either.
    """
    masked = F.translate(text, "\x01\x02", "\x03\x03")
    parts = F.split(F.regexp_replace(masked, f"({pattern})", "\x01$1\x02"), "\x01", -1)
    empty = F.array().cast(f"array<{SPAN}>")

    def follow(so_far: Column, part: Column) -> Column:
        found = F.substring_index(part, "\x02", 1)
        rest = part.substr(F.length(found) + 2, F.length(part))
        at = so_far["at"]
        span = F.struct(
            at.alias("start"), (at + F.length(found)).alias("stop"), found.alias("found"),
            so_far["before"].alias("before"), F.left(rest, F.lit(1)).alias("after"),
        )
        return F.struct(
            (at + F.length(part) - 1).alias("at"), F.right(rest, F.lit(24)).alias("before"),
            F.concat(so_far["spans"], F.array(span)).alias("spans"),
        )

    start = F.struct(
        F.length(parts[0]).alias("at"), F.right(parts[0], F.lit(24)).alias("before"), empty.alias("spans")
    )
    spans = F.aggregate(F.slice(parts, 2, F.size(parts)), start, follow, lambda s: s["spans"])
    return F.when(F.size(parts) > 1, spans).otherwise(empty)


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    places = F.sequence(F.lit(1), F.length(digits))
    at = lambda i: F.reverse(digits).substr(i, F.lit(1)).cast("int")
    doubled = lambda i: (at(i) * 2) % 10 + F.floor(at(i) / 5).cast("int")
    value = F.transform(places, lambda i: F.when(i % 2 == 1, at(i)).otherwise(doubled(i)))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def passes(kind: str, found: Column) -> Column:
    """The rest of a base definition, beyond its pattern."""
    if kind == "ip":
        part = lambda x: F.ltrim(x, F.lit("0"))
        return F.forall(F.split(found, r"\."), lambda x: (F.length(part(x)) < 3) | ((F.length(part(x)) == 3) & (part(x) <= "255")))
    if kind == "card":
        digits = _digits(found)
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def votes(kind: str, span: Column) -> list[Column]:
    """1 for, 0 against, null to abstain; in the order of LABELERS."""
    found, size = span["found"], F.length(span["found"])
    digits = _digits(found)
    shape = {
        "email": F.regexp_like(found, F.lit(r"^[A-Za-z0-9._%+-]{1,64}@.{3,250}$")),
        "ip": size <= 15,
        "card": F.length(digits).between(13, 19),
        "phone": F.regexp_like(found, F.lit(r"^\+[0-9]{1,3}[ .-]?(\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}([ .-]?[0-9]{2,5})*$")),
        "secret": size.isin(32, 40, 48, 56, 64, 96, 128),
    }[kind]
    check = {
        "email": ~F.contains(found, F.lit("..")),
        "secret": F.regexp_like(found, F.lit("[0-9]")) & F.regexp_like(found, F.lit("[A-Fa-f]")),
    }.get(kind, passes(kind, found))
    gazetteer = {
        "email": F.lower(F.substring_index(found, ".", -1)).isin(*ENDINGS),
        "card": F.regexp_like(digits, F.lit(ISSUERS)),
        "phone": F.regexp_like(digits, F.lit("^[1-9]")),
    }.get(kind, F.lit(None).cast("boolean"))
    announced = F.regexp_like(F.lower(span["before"]), F.lit(ANNOUNCED[kind]))
    inside = F.regexp_like(F.right(span["before"], F.lit(1)), F.lit(r"[\p{L}\p{N}]")) | F.regexp_like(
        span["after"], F.lit(r"[\p{L}\p{N}]")
    )
    context = F.when(announced, F.lit(True))
    return [c.cast("int") for c in (shape, check, gazetteer, context, ~inside)]


def candidates(records: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``kept``, a struct of the columns to keep, and ``spans``: all candidate spans with their votes.

    Texts are read whole.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    columns = []
    for kind in KINDS:
        spans = marked_spans(F.col("text"), PATTERNS[kind])
        if kind in HINTS:
            spans = F.when(F.contains(F.col("text"), F.lit(HINTS[kind])), spans).otherwise(
                F.array().cast(f"array<{SPAN}>")
            )
        columns.append(spans.alias(kind))
    kept = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.lit(None)
    found = records.select(kept.alias("kept"), whole.alias("text")).select("kept", *columns)

    def judged(kind: str) -> Column:
        def one(span: Column) -> Column:
            cast = votes(kind, span)
            bits = F.least(F.floor(F.log2(span["stop"] - span["start"])), F.lit(8)).cast("int")
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), span["start"].alias("start"), span["stop"].alias("stop"),
                (F.lit(kind in BASE) & passes(kind, span["found"])).alias("base"), bits.alias("size"),
                *(v.alias(name) for v, name in zip(cast, LABELERS, strict=True)),
            )

        return F.transform(F.col(kind), one)

    return found.select("kept", F.concat(*(judged(kind) for kind in KINDS)).alias("spans"))


def reliabilities(patterns: list[tuple[int, tuple, int]], rounds: int = 60) -> tuple[list[float], list[tuple[float, float]]]:
    """Share of true spans per kind, and (P(for | true), P(for | false)) of each labeler.

    ``patterns`` lists (kind, votes, count).  Labelers are taken as independent given the truth;
    the first guess is the majority of votes, and every count starts with one made-up vote.
    """
    belief = [
        (sum(1 for v in cast if v) + 1) / (sum(1 for v in cast if v is not None) + 2) for _, cast, _ in patterns
    ]
    share, rates = [0.5] * len(KINDS), [(0.8, 0.2)] * len(LABELERS)
    for _ in range(rounds):
        for k in range(len(KINDS)):
            own = [(b, n) for b, (kind, _, n) in zip(belief, patterns, strict=True) if kind == k]
            share[k] = (1 + sum(b * n for b, n in own)) / (2 + sum(n for _, n in own))
        for j in range(len(LABELERS)):
            hit, true, miss, false = 4.0, 5.0, 1.0, 5.0
            for b, (_, cast, n) in zip(belief, patterns, strict=True):
                if cast[j] is not None:
                    true, false = true + b * n, false + (1 - b) * n
                    hit, miss = hit + b * n * cast[j], miss + (1 - b) * n * cast[j]
            rates[j] = (hit / true, miss / false)
        belief = [posterior(share[kind], rates, cast) for kind, cast, _ in patterns]
    return share, rates


def posterior(share: float, rates: list[tuple[float, float]], cast: tuple) -> float:
    """Belief that a span is true, given its votes."""
    odds = math.log(share / (1 - share))
    for (p, q), vote in zip(rates, cast, strict=True):
        if vote is not None:
            odds += math.log(p / q) if vote else math.log((1 - p) / (1 - q))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))


def _inputs(kind: int, size: int, cast: tuple) -> list[float]:
    known = [0.0 if v is None else 2.0 * v - 1 for v in cast]
    return [1.0, size / 8, *(float(kind == k) for k in range(len(KINDS))), *known]


def train_classifier(patterns: list[tuple[int, int, tuple, int]], rounds: int = 400, penalty: float = 1e-3) -> list[float]:
    """Weights of a logistic model of (kind, size, votes), fitted to the beliefs of the vote model."""
    share, rates = reliabilities([(kind, cast, n) for kind, _, cast, n in patterns])
    rows = [
        (_inputs(kind, size, cast), posterior(share[kind], rates, cast), math.sqrt(n)) for kind, size, cast, n in patterns
    ]
    total = sum(n for *_, n in rows) or 1.0
    weights = [0.0] * (2 + len(KINDS) + len(LABELERS))
    for _ in range(rounds):
        slope = [penalty * w for w in weights]
        for x, target, n in rows:
            z = sum(w * v for w, v in zip(weights, x, strict=True))
            miss = n / total * (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target)
            slope = [s + miss * v for s, v in zip(slope, x, strict=True)]
        weights = [w - 2.0 * s for w, s in zip(weights, slope, strict=True)]
    return weights


def _believed(span: Column, weights: list[float]) -> Column:
    known = [F.coalesce(2.0 * span[name] - 1, F.lit(0.0)) for name in LABELERS]
    kinds = F.element_at(F.array(*map(F.lit, weights[2 : 2 + len(KINDS)])), span["kind"] + 1)
    terms = [F.lit(weights[0]), F.lit(weights[1]) * span["size"] / 8, kinds]
    terms += [F.lit(w) * v for w, v in zip(weights[2 + len(KINDS) :], known, strict=True)]
    return reduce(lambda a, b: a + b, terms) >= 0


def find_personal_data(records: DataFrame, key: str = "source_event_id", text: str = "payload") -> DataFrame:
    """Personal data of every text: ``key, spans ARRAY<STRUCT<kind, start, stop, base>>``.

    The library's records with free text are rejected messages (``source_event_id``,
    ``payload``); any other key and text column can be named.  Kinds are email, ip, card and
    phone, and secret (long hexadecimal tokens), which only the method can find.  ``start``
    and ``stop`` (exclusive) count code points.  Every match of a base definition stays with
    ``base`` true; a candidate that fails one, or is a secret, is added with ``base`` false
    where the trained classifier believes it and it overlaps no base span.  Spans are ordered
    by kind, then start.  Null and empty texts give no spans; repeated rows give repeated
    rows; further columns are ignored.
    """
    found = durable(candidates(records, [key], text))
    return _decided(found, learnt(found)).select(F.col(f"kept.`{key}`").alias(key), "spans")


def learnt(found: DataFrame) -> list[float]:
    """Classifier weights from the vote patterns of all candidates."""
    spread = found.select(F.explode("spans").alias("s")).select("s.kind", "s.size", *(f"s.{x}" for x in LABELERS))
    # As many rows as vote patterns: kinds x sizes x 3^labelers at most.
    counted = spread.groupBy("kind", "size", *LABELERS).count().orderBy("kind", "size", *LABELERS).collect()
    return train_classifier([(r["kind"], r["size"], tuple(r[x] for x in LABELERS), r["count"]) for r in counted])


def _decided(found: DataFrame, weights: list[float]) -> DataFrame:
    """Candidates turned into the final spans, ordered by kind and start."""
    base = F.filter("spans", lambda s: s["base"])
    added = F.filter(
        "spans",
        lambda s: ~s["base"] & _believed(s, weights)
        & ~F.exists(F.col("base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    named = F.array(*map(F.lit, KINDS))
    bare = lambda s: F.struct(
        s["kind"].alias("at"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base")
    )
    ordered = F.array_sort(F.transform(F.concat("base", added), bare))
    spans = F.transform(
        ordered,
        lambda s: F.struct(
            F.element_at(named, s["at"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"),
            s["base"].alias("base"),
        ),
    )
    return found.withColumn("base", base).select("kept", spans.alias("spans"))


def mask_personal_data(records: DataFrame, text: str = "payload") -> DataFrame:
    """The records, with all their columns, with every span of their text replaced by its kind.

    Reliabilities are learnt in one pass and texts masked where they lie in a second; a null
    text stays null.
    """
    weights = learnt(candidates(records, [], text))
    found = _decided(candidates(records, records.columns, text), weights)
    old = F.col(f"kept.`{text}`")
    changed = F.when(F.size("spans") > 0, masked(old.cast("string"), F.col("spans"))).otherwise(old)
    return found.select(
        *(changed.alias(c) if c == text else F.col(f"kept.`{c}`").alias(c) for c in records.columns)
    )


def spelt(spans: Column) -> Column:
    """``kind:start:stop`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping ones the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cover(so_far: Column, s: Column) -> Column:
        put = F.concat(so_far["out"], text.substr(so_far["at"] + 1, s["start"] - so_far["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < so_far["at"], so_far).otherwise(F.struct(s["stop"].alias("at"), put.alias("out")))

    return F.aggregate(
        ordered, begin, cover, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text) + 1))
    )
