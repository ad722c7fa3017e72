"""Personal data spans by weak supervision, as DataFrame functions only.

Candidate spans come from exact patterns (the *base* spans, always kept) and from looser ones: what
an exact pattern misses because it runs on into the number behind it (two cards, a phone and an
address), writes out (``(at)``) or has no plus sign. A looser card whose check digit fails, or that stands
inside a word, is no candidate. A regex, a gazetteer and a context labeler vote
on every candidate (yes 1, no -1, abstain 0), base or not: the first by its form and check digit, the
second by number blocks and domains, the third by what stands before it. Expectation-maximisation
over the counted vote patterns estimates how reliable each labeler is; the resulting probabilities
train a final logistic classifier over votes and shape, which decides about the looser candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, persist_table

#: Kinds in the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Lookbehinds and possessive repeats keep them linear; they match what the plain
#: forms do: a run of characters is tried from its start (or from the end of the match before) only.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms, offered to the labelers, and a cheap sign that a text holds one.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{2,63}+){1,4}",
    "card": r"(?<![0-9A-Za-z.])(?:[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{2,7}|[0-9]{14,19})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+().-])(?:\+?[0-9]{1,3}[-. ])?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])",
}
SIGNS = {
    "email": r"[\[(](?:at|AT)[\])]",
    "card": r"[0-9](?:[\x20-]?[0-9]){13}",
    "phone": r"[0-9]{3}[-. ][0-9]{4}",
}
#: Forms that the regex labeler takes for genuine.
FORMS = {
    "email": r"(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z]{2,24}$",
    "card": r"^(?:[0-9]{4}[\x20-]?){3}[0-9]{2,7}$",
    "phone": r"^(?:\+?[0-9]{1,3}[-. ])?(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}$",
}
#: Gazetteer: common top-level domains; first digits of card issuers; number blocks that no public host
#: has (this network, loopback, multicast and above); subscriber block of fictional phone numbers.
DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "info", "io", "de", "fr", "es", "it", "nl", "uk", "eu", "ch", "at")
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30|36|38|35|60|62|64|65)"
NO_HOST = r"^(?:0|127|22[4-9]|2[3-5][0-9])\."
FICTIONAL = r"555[-. ][0-9]{4}$"
#: Words that speak for a kind when they stand shortly before a span, and those that speak against all.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|courriel|correo)\W",
    "ip": r"(?i)(?:\bip\b|host|server|address|login)",
    "card": r"(?i)(?:card|visa|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|\btel|call|mobile|fax|contact|telefon|teléfono)",
}
AGAINST = r"(?i)(?:order|invoice|serial|isbn|version|build|article|item|ticket|id)\W*(?:no\W*|number\W*|#\W*)?$"
CONTEXT = 40
#: Spans that one loop over a text's spans takes.
BLOCK = 128
ROUNDS, PRIOR = 40, 0.5


_SPANS = "array<struct<start:int,end:int,kind:int,base:boolean,body:string,before:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it stands inside loops."""
    return F.transform(F.array(value), use)[0]


def _blocks(items: Column) -> Column:
    """An array as an array of arrays of BLOCK elements: loops that append stay short, however many there are."""

    def cut(xs: Column) -> Column:
        last = F.ceil(F.size(xs) / BLOCK).cast("int") - 1
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(xs), 1, 0))

    return _let(items, cut)


def _before(totals: Column, join) -> Column:
    """For each number of an array what ``join`` makes of 0 and all numbers before it."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, n: F.struct(join(acc["pos"], n).alias("pos"), F.array_append(acc["out"], acc["pos"]).alias("out"))
    return F.aggregate(totals, start, step, lambda acc: acc["out"])


def _at(text: Column, pattern: str, kind: str, base: bool) -> Column:
    """Array of (start, end, kind, base, body, before) of all matches; positions in code points.

    The pieces between the matches and the matches themselves have the same order, so starts are
    running sums of their lengths: of blocks first, then inside each block.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    joined = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, body: F.struct(gap.alias("gap"), body.alias("body")))
    length = lambda x: F.char_length(x["gap"]) + F.char_length(x["body"])
    totals = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + length(x)))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["pos"] + F.char_length(x["gap"])
        end = begin + F.char_length(x["body"])
        span = F.struct(
            begin.alias("start"), end.alias("end"), F.lit(KINDS.index(kind)).alias("kind"), F.lit(base).alias("base"),
            x["body"].alias("body"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"),
        )
        return F.struct(end.alias("pos"), F.array_append(acc["out"], span).alias("out"))

    placed = lambda block, pos: F.aggregate(block, F.struct(pos.alias("pos"), F.array().cast(_SPANS).alias("out")), add, lambda acc: acc["out"])
    return _let(_blocks(joined), lambda blocks: F.flatten(F.zip_with(blocks, _before(totals(blocks), lambda a, n: a + n), placed)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda n, d: n + d) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _valid(span: Column, kind: str) -> Column:
    body = span["body"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: F.regexp_like(p, F.lit(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")))
    n = F.length(_digits(body))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(_digits(body))).otherwise(False)
    return n.between(10, 15)


def _checker(kind: str):
    return lambda s: _valid(s, kind)


def _some(text: Column, kind: str) -> Column:
    """A cheap sign that a pattern of the kind can match at all."""
    if kind == "email":
        return F.contains(text, F.lit("@"))
    if kind == "phone":
        return F.contains(text, F.lit("+"))
    return F.regexp_like(text, F.lit(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){13}"))


def candidates(text: Column) -> Column:
    """All candidate spans of a text, base ones first."""
    none = F.array().cast(_SPANS)
    base = []
    for kind in KINDS:
        exact = F.when(_some(text, kind), F.filter(_at(text, PATTERNS[kind], kind, True), _checker(kind))).otherwise(none)
        base.append(F.coalesce(exact, none))
    place = lambda s: s["start"].cast("long") * 2**31 + s["end"]

    def with_looser(known: Column) -> Column:
        parts = []
        for kind in LOOSE:
            more = F.coalesce(F.when(F.regexp_like(text, F.lit(SIGNS[kind])), F.filter(_at(text, LOOSE[kind], kind, False), _looser(kind))).otherwise(none), none)
            parts.append(more)
        # what the base has already goes by its place, through a hash set
        more = F.concat(*parts)
        fresh = lambda xs: F.array_except(F.transform(xs, place), F.transform(known, place))
        left = lambda xs: _let(fresh(xs), lambda f: F.when(F.size(f) == F.size(xs), xs).when(F.size(f) == 0, F.slice(xs, 1, 0)).otherwise(F.filter(xs, _among(f, place))))
        return F.concat(known, _let(more, left))

    return _let(F.concat(*base), with_looser)


def _among(places: Column, place):
    return lambda s: F.array_contains(places, place(s))


def _looser(kind: str):
    """A failed check digit, or a number of digits that no phone has, is a veto: nothing outvotes it."""
    return lambda s: F.lit(True) if kind == "email" else _valid(s, kind)


def votes(span: Column) -> list[Column]:
    """Votes of the regex, gazetteer and context labelers, and the shape of the span."""
    body, before, kind = span["body"], span["before"], span["kind"]
    like = lambda c, pattern: F.regexp_like(c, F.lit(pattern))
    genuine = (
        F.when(kind == 0, like(F.substring(body, 1, 1), "^[A-Za-z0-9]") & like(F.right(body, F.lit(32)), FORMS["email"]))
        .when(kind == 1, _valid(span, "ip"))
        .when(kind == 2, like(body, FORMS["card"]) & _valid(span, "card"))
        .otherwise(like(body, FORMS["phone"]))
    )
    last = F.lower(F.regexp_extract(F.right(body, F.lit(32)), r"([A-Za-z0-9-]+)$", 1))
    known = (
        F.when(kind == 0, F.when(last.isin(*DOMAINS), 1).otherwise(-1))
        .when(kind == 1, F.when(like(body, NO_HOST), -1).otherwise(1))
        .when(kind == 2, F.when(like(_digits(body), ISSUERS), 1).otherwise(0))
        .otherwise(F.when(like(body, FICTIONAL), 1).otherwise(0))
    )
    cue = F.coalesce(*[F.when((kind == i) & like(before, CUES[k]), 1) for i, k in enumerate(KINDS)], F.when(like(before, AGAINST), -1), F.lit(0))
    shape = F.when(like(body, r"[()\[\]+]"), 1).otherwise(0)
    return [F.when(genuine, 1).otherwise(-1).alias("regex"), known.alias("gazetteer"), cue.alias("context"), shape.alias("shape")]


def vote_table(own: list[dict], belief: list[float]) -> tuple[list[float], dict[tuple, float]]:
    """Shares of false and true spans, and the probability of each (labeler, vote, truth)."""
    total, table = [0.0, 0.0], {}
    for c, p in zip(own, belief, strict=True):
        for t, q in ((0, 1 - p), (1, p)):
            total[t] += q * c["n"]
            for x in ("regex", "gazetteer", "context"):
                table[x, c[x], t] = table.get((x, c[x], t), 0.0) + q * c["n"]
    prior = lambda v, t: 2.0 if (v > 0) == (t == 1) else 1.0
    made = {
        (x, v, t): (table.get((x, v, t), 0.0) + prior(v, t)) / (total[t] + sum(prior(k, t) for k in (-1, 0, 1)))
        for x in ("regex", "gazetteer", "context") for v in (-1, 0, 1) for t in (0, 1)
    }
    return [(n + 1) / (sum(total) + 2) for n in total], made


def reliabilities(counts: list[dict]) -> dict[tuple, float]:
    """Probability of each (kind, regex, gazetteer, context, shape) pattern by EM, then logistic fit.

    ``counts`` has a row for each pattern with its number n: at most 4 * 3 * 3 * 3 * 2 rows. Each
    labeler has a probability of each vote in true and in false spans, which sum to one; votes are
    independent given the truth. One count for each vote, and one more for a vote that agrees with
    the truth, keep single-class data finite.
    """
    names = ("regex", "gazetteer", "context")
    out: dict[tuple, float] = {}
    for kind in range(len(KINDS)):
        own = [c for c in counts if c["kind"] == kind]
        if not own:
            continue
        belief = [min(0.95, max(0.05, PRIOR + 0.2 * sum(c[x] for x in names))) for c in own]
        for _ in range(ROUNDS):
            share, table = vote_table(own, belief)
            like = lambda c, t: math.prod(table[x, c[x], t] for x in names) * share[t]  # noqa: E731, B023
            belief = [like(c, 1) / (like(c, 1) + like(c, 0)) for c in own]
        # the classifier: logistic regression on votes and shape with the beliefs as soft labels
        w = [0.0] * 5
        rows = [([1.0, c["regex"], c["gazetteer"], c["context"], c["shape"]], p, c["n"]) for c, p in zip(own, belief, strict=True)]
        size = sum(n for _, _, n in rows)
        for _ in range(400):
            grad = [1e-3 * v for v in w]
            for x, p, n in rows:
                guess = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))))
                for i in range(5):
                    grad[i] += (guess - p) * x[i] * n / size
            w = [a - 0.8 * g for a, g in zip(w, grad, strict=True)]
        for c, (x, _, _) in zip(own, rows, strict=True):
            z = sum(a * b for a, b in zip(w, x, strict=True))
            out[kind, c["regex"], c["gazetteer"], c["context"], c["shape"]] = 1 / (1 + math.exp(-z))
    return out


def find_spans(docs: DataFrame, column: str = "text") -> DataFrame:
    """Personal data of every row: the columns of ``docs`` except the text, and ``found``.

    ``found`` is an array of (start, end, kind, base) by start, then kind in the order of KINDS, in
    code points, end exclusive. Base spans are always in it. Null and empty texts have an empty
    array. Repeated rows are each returned. The result reads a table of the candidates, so texts
    are searched once.
    """
    others = [c for c in docs.columns if c != column]
    # a caller's columns may have any name but found: what is added here gets a name of its own
    own = free_name("_spans", docs)
    rest = [F.col(f"`{c}`") for c in others]
    cand = persist_table(docs.select(*rest, candidates(F.coalesce(F.col(column), F.lit(""))).alias(own)))
    span = F.col("s")
    seen = (
        cand.where(F.size(own) > 0)
        .select(F.explode(own).alias("s"))
        .select(span["kind"].alias("kind"), *votes(span))
        .groupBy("kind", "regex", "gazetteer", "context", "shape")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = sorted((r.asDict() for r in seen.collect()), key=lambda r: [r[k] for k in ("kind", "regex", "gazetteer", "context", "shape")])
    sure = [k for k, p in reliabilities(rows).items() if p >= 0.5]

    def keep(s: Column) -> Column:
        v = votes(s)
        hit = F.lit(False)
        for kind, *pattern in sure:
            one = s["kind"] == kind
            for c, x in zip(v, pattern, strict=True):
                one = one & (c == x)
            hit = hit | one
        return s["base"] | hit

    def clear(s: Column) -> Column:
        """Looser spans give way to base spans that they overlap."""
        return s["base"] | ~F.exists(own, lambda o: o["base"] & (o["start"] < s["end"]) & (s["start"] < o["end"]))

    chosen = F.when(F.size(own) > 0, F.filter(F.when(F.exists(own, lambda s: ~s["base"]), F.filter(own, clear)).otherwise(F.col(own)), lambda s: keep(s) if sure else s["base"]))
    ordered = F.sort_array(F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,base:boolean>>")
    return cand.select(*rest, F.coalesce(ordered, none).alias("found"))


def listing(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def hidden(block: Column, at: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            gap = F.substring(at["piece"], acc["pos"] - at["pos"] + 1, s["start"] - acc["pos"])
            fresh = s["start"] >= acc["pos"]
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], gap, F.element_at(names, s["kind"] + 1))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block, F.struct(at["pos"].alias("pos"), F.lit("").alias("out")), add, lambda acc: acc["out"])

    def pieces(blocks: Column) -> Column:
        """A block's piece of the text: from the last end before it to the last end in it."""
        ends = F.transform(blocks, lambda b: F.array_max(F.transform(b, lambda s: s["end"])))
        piece = lambda a, e: F.struct(a.alias("pos"), F.substring(text, a + 1, F.greatest(e - a, F.lit(0))).alias("piece"))
        return _let(ends, lambda e: F.zip_with(_before(e, F.greatest), e, piece))

    rest = F.substring(text, F.array_max(F.transform(found, lambda s: s["end"])) + 1, F.lit(2**31 - 1))
    return F.when(F.size(found) > 0, F.concat(_let(_blocks(found), lambda b: F.array_join(F.zip_with(b, pieces(b), hidden), "")), rest)).otherwise(text)
