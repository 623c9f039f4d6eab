"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans: the four base kinds, and looser ones that are mostly something
else (numbers as long as a card's whatever their check digit, national phone numbers,
addresses with the signs spelled out, account and identity numbers).  Labelers vote on
each: the strict pattern, a checksum, a gazetteer, the words before it, what it stands
next to, how it is laid out and how varied its characters are; a vote is yes, no or none.
Votes and features of the spans are counted over all documents, expectation-maximisation
estimates each labeler's reliability from the counts of votes, and a logistic classifier
on kind, votes and features, fitted on the resulting probabilities, decides the spans.
Spans of the four base kinds stay whatever it says; of the looser kinds only those it
accepts are added.

What reaches the driver is a table of counts: at most (number of kinds) * 3 to the number
of labelers * (number of features' values) rows, whatever the number of documents.

Null and empty texts have no spans.  Offsets count code points, ends are exclusive.
Repeated rows each get their result.  Of overlapping looser spans the earlier kind stays.
Work on a text grows with its length, except where looser spans overlap base ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.llm.common import stored

#: The kinds in their order, base kinds first.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "national_phone", "id_number", "loose_card", "iban", "spelled_email")
#: Patterns that take what the plain ones take, written so that a scan is linear in the text.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "national_phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)|0[0-9]{1,4}|[0-9]{3})[\x20./-][0-9]{3,4}[\x20.-][0-9]{4}(?![0-9])",
    "id_number": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "loose_card": r"(?<![0-9.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "spelled_email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[(\[{](?:at|@)[)\]}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[{](?:dot|punkt|point|punto)[)\]}])\x20?[A-Za-z0-9-]++)++",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": r"\+[0-9]", "national_phone": "[0-9]{4}", "id_number": "[0-9]{3}-", "loose_card": "[0-9](?:[\\x20-]?[0-9]){12}", "spelled_email": r"(?i)[(\[{](?:at|@)[)\]}]", "iban": "[A-Z]{2}[0-9]{2}", "ip": "[0-9][.][0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]"}
IP_OK = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
#: Gazetteers (issuer digits, country codes, private and special networks, endings of host names) as patterns.
GAZETTEER = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|ch|at|it|nl)$",
    "ip": r"^(?!0|127\.|255\.|22[4-9]\.|23[0-9]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
    "loose_card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "id_number": r"^(?!000|666|9)",
    "national_phone": r"^(?:0|\(?[2-9][0-9]{2})",
    "iban": r"^(?:DE|FR|ES|IT|NL|GB|CH|AT|BE|PT|PL|SE)",
    "spelled_email": r"(?i)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|ch|at|it|nl)$",
}
#: How spans are usually laid out; kinds without a usual layout have none.
LAYOUT = {
    "email": r"^[A-Za-z]", "ip": r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", "card": r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}(?:\1[0-9]{4}){2,3}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?[0-9]+(?:[\x20.-][0-9]+)*$", "loose_card": r"^(?:[0-9]+|[0-9]{4}([\x20-])[0-9]{4}(?:\1[0-9]{4}){2,3}|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5})$",
}
#: Words before a span that speak for or against personal data.
FOR = r"(?i)\b(?:e-?mail|mail|contact|kontakt|contacto|correo|courriel|phone|tel|telefon|t[ée]l[ée]phone|tel[ée]fono|mobile?|call|fax|card|visa|karte|carte|tarjeta|ip|host|address|adresse|ssn|social|passport|iban|konto|account)\b[^A-Za-z]*$"
AGAINST = r"(?i)(?:\b(?:version|v|ver|isbn|issn|order|build|release|section|chapter|page|license|rev|no|nr|id|sku|figure|table)\b[\s.:#]*|[#$€£])$"
LABELERS = ("strict", "checksum", "gazetteer", "context", "boundary", "layout", "variety")
#: Features of a span and the number of their values: length, separators, first character, what stands before it.
FEATURES = {"length": 6, "separators": 3, "first": 4, "before": 4}
#: Matches whose places are summed at once.
BLOCK = 256
#: Characters before a span that the context labeler reads.
CONTEXT = 24


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _accepts(kind: str, s: Column) -> Column:
    """Is a match of a pattern of the kind well-formed?"""
    d = digits(s)
    if kind == "ip":
        return s.rlike(IP_OK)
    if kind == "card":
        return F.length(d).between(16, 19) & luhn(d)
    if kind == "phone":
        return F.length(d).between(8, 15)
    if kind == "loose_card":
        return ~_accepts("card", s)
    return F.lit(True)


def _found(df: DataFrame, kind: str) -> DataFrame:
    """Column ``kind``: the accepted matches (kind, start, end, s, before, after) in the column ``text``.

    What lies between the matches gives their places: no position function is needed.
    """
    k, pattern = KINDS.index(kind), PATTERNS[kind]
    tried = F.col("text").rlike(NEEDS[kind])
    nothing = F.array().cast("array<string>")
    df = df.withColumn("_m", F.when(tried, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(nothing))
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)).otherwise(nothing))
    # running sums by blocks, so that no list is copied for every match
    steps = F.transform(F.arrays_zip(F.col("_m").alias("m"), F.slice("_g", 1, F.size("_m")).alias("g")), lambda x: F.length(x["g"]) + F.length(x["m"]))
    df = df.withColumn("_n", steps)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_n") - 1) / BLOCK).cast("int")), lambda b: F.slice("_n", b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda block: F.aggregate(block, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))))
    df = df.withColumn("_w", F.when(F.size("_n") > 0, sums).otherwise(F.array().cast("array<array<int>>")))
    df = df.withColumn("_o", F.aggregate("_w", F.array(F.lit(0)), lambda a, w: F.concat(a, F.array(F.element_at(a, -1) + F.element_at(w, -1)))))
    ends = F.flatten(F.transform("_w", lambda w, b: F.transform(F.slice(w, F.lit(2), F.size(w)), lambda x: x + F.get("_o", b))))
    df = df.withColumn("_e", ends)
    spans = F.transform(
        "_m",
        lambda m, i: F.struct(
            F.lit(k).alias("kind"),
            (F.get("_e", i) - F.length(m)).alias("start"),
            F.get("_e", i).alias("end"),
            m.alias("s"),
            F.right(F.get("_g", i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get("_g", i + 1), F.lit(1)).alias("after"),
        ),
    )
    return df.withColumn(kind, F.filter(spans, lambda x: _accepts(kind, x["s"]))).drop("_m", "_g", "_n", "_w", "_o", "_e")


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(x: Column) -> list[Column]:
    """The labelers' votes on a candidate, in the order of LABELERS."""
    kind, s = x["kind"], x["s"]
    strict = F.when(kind < len(BASE), 1).otherwise(0)
    numbers = kind.isin(KINDS.index("card"), KINDS.index("loose_card"))
    mails = kind.isin(KINDS.index("email"), KINDS.index("spelled_email"))
    checksum = F.when(numbers, F.when(luhn(digits(s)), 1).otherwise(-1)).when(kind == KINDS.index("ip"), 1).otherwise(0)
    gazetteer = _by_kind(GAZETTEER, kind, s)
    context = vote(x["before"].rlike(FOR), x["before"].rlike(AGAINST))
    joined = x["before"].rlike(r"[\p{L}0-9_./-]$") | x["after"].rlike(r"^[\p{L}0-9_/-]")
    boundary = F.when(joined, -1).otherwise(1)
    # placeholders repeat one character or count on: 1111..., 1234...
    several = F.size(F.array_distinct(F.split(F.when(mails, s).otherwise(digits(s)), "")))
    variety = F.when(kind.isin(KINDS.index("ip"), KINDS.index("spelled_email")), 0).when(several < 4, -1).when(digits(s).rlike("^(?:0?123456789?0?)+[0-9]{0,4}$"), -1).otherwise(1)
    return [strict, checksum, gazetteer, context, boundary, _by_kind(LAYOUT, kind, s), variety]


def _by_kind(patterns: dict[str, str], kind: Column, s: Column) -> Column:
    """The vote of a table of patterns by kind; none for other kinds."""
    out = F.lit(0)
    for name, pattern in patterns.items():
        out = F.when(kind == KINDS.index(name), F.when(s.rlike(pattern), 1).otherwise(-1)).otherwise(out)
    return out


def described(x: Column) -> list[Column]:
    """The values of FEATURES of a candidate."""
    s, before = x["s"], x["before"]
    length = F.least(F.floor(F.length(s) / 5), F.lit(5)).cast("int")
    separators = F.when(s.rlike("^[A-Za-z0-9]+$"), 0).when(s.rlike(r"\x20"), 1).otherwise(2)
    first = F.when(s.rlike("^[4]"), 0).when(s.rlike("^[0-9]"), 1).when(s.rlike("^[A-Za-z]"), 2).otherwise(3)
    place = F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike("[\"'(<\\[:=]$"), 2).otherwise(3)
    return [length, separators, first, place]


def candidates(docs: DataFrame, text: Column, *ids: Column) -> DataFrame:
    """(ids, base, loose): for each document its base spans and its looser candidates, each with start, end and votes."""
    df = docs.select(*ids, F.coalesce(text, F.lit("")).alias("text"))
    names = df.columns[: len(ids)]
    for kind in KINDS:
        df = _found(df, kind)
    df = df.select(*names, F.concat(*BASE).alias("_b"), F.concat(*KINDS[len(BASE) :]).alias("_l"))
    # a looser candidate must not touch a base span; of two that overlap the earlier kind stays
    apart = lambda x, y: (x["end"] <= y["start"]) | (y["end"] <= x["start"])
    covers = lambda spans: F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["end"] - 1)))
    # places are looked up in a hash first: spans are compared one by one only where some overlap
    df = df.withColumn("_both", F.when(F.size("_l") > 0, F.arrays_overlap(covers("_b"), covers("_l"))).otherwise(False))
    df = df.withColumn("_l", F.when(F.col("_both"), F.filter("_l", lambda x: F.forall("_b", lambda y: apart(x, y)))).otherwise(F.col("_l")))
    df = df.withColumn("_twice", F.size(F.array_distinct(covers("_l"))) < F.size(covers("_l")))
    df = df.withColumn("_l", F.when(F.col("_twice"), F.filter("_l", lambda x: F.forall("_l", lambda y: apart(x, y) | (y["kind"] >= x["kind"])))).otherwise(F.col("_l")))

    def judged(x: Column) -> Column:
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*votes(x)).alias("votes"), F.array(*described(x)).alias("features"))

    return df.select(*names, F.transform("_b", judged).alias("base"), F.transform("_l", judged).alias("loose"))


#: A kind and its votes; for the classifier also the values of FEATURES.
Pattern = tuple[int, tuple[int, ...]]
Full = tuple[int, tuple[int, ...], tuple[int, ...]]


def reliabilities(counts: dict[Pattern, float], rounds: int = 60) -> dict[Pattern, float]:
    """The probability of each vote pattern by expectation-maximisation.

    Two classes; each labeler has, for either class, a probability to say yes where it
    votes at all; without votes both are as likely.  Starts from the majority of the votes and is smoothed, so a
    labeler that never votes counts for nothing.
    """
    if not counts:
        return {}
    n = np.array(list(counts.values()))
    cast = np.array([p[1] for p in counts])
    yes, no = (cast == 1).astype(float), (cast == -1).astype(float)
    prob = 1 / (1 + np.exp(-1.5 * cast.sum(axis=1)))
    for _ in range(rounds):
        weight = np.stack([n * prob, n * (1 - prob)])
        said_yes, said_no = weight @ yes + [[6.0], [2.0]], weight @ no + [[2.0], [6.0]]
        rate = np.log([said_yes / (said_yes + said_no), said_no / (said_yes + said_no)])
        odds = yes @ (rate[0][0] - rate[0][1]) + no @ (rate[1][0] - rate[1][1])
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved = np.abs(new - prob).max()
        prob = new
        if moved < 1e-9:
            break
    return dict(zip(counts, prob.tolist()))


def features(p: Full) -> list[float]:
    """Kind, votes and features as zeros and ones."""
    kind, vs, fs = p
    values = [float(f == v) for f, n in zip(fs, FEATURES.values()) for v in range(n)]
    return [*(float(v == 1) for v in vs), *(float(v == -1) for v in vs), *(float(kind == k) for k in range(len(KINDS))), *values, 1.0]


def classifier(counts: dict[Full, float], prob: dict[Pattern, float], steps: int = 400, decay: float = 0.002) -> list[float]:
    """Weights of a logistic regression on the estimated probabilities, each pattern with the logarithm of its count."""
    if not counts:
        return [0.0] * (2 * len(LABELERS) + len(KINDS) + sum(FEATURES.values()) + 1)
    patterns = sorted(counts)
    x, y = np.array([features(p) for p in patterns]), np.array([prob[p[:2]] for p in patterns])
    n = np.log1p([counts[p] for p in patterns])
    n /= n.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        e = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y
        w -= decay * w + (n * e) @ x
    return w.tolist()


def fit(found: DataFrame) -> list[float]:
    """The classifier's weights, from the votes and features of the candidates of all documents."""
    each = found.select(F.explode(F.concat("base", "loose")).alias("x"))
    rows = each.groupBy(*(F.col(f"x.{c}").alias(c) for c in ("kind", "votes", "features"))).agg(F.count(F.lit(1)).alias("n")).collect()
    full = {(r["kind"], tuple(r["votes"]), tuple(r["features"])): float(r["n"]) for r in rows}
    counts: dict[Pattern, float] = {}
    for p, n in full.items():
        counts[p[:2]] = counts.get(p[:2], 0.0) + n
    return classifier(full, reliabilities(counts))


def _logit(x: Column, w: list[float]) -> Column:
    n = len(LABELERS)
    total = F.lit(w[-1])
    for k in range(n):
        v = F.get(x["votes"], F.lit(k))
        total = total + F.when(v == 1, w[k]).when(v == -1, w[n + k]).otherwise(0.0)
    at = 2 * n
    sizes = (len(KINDS), *FEATURES.values())
    for value, size in zip((x["kind"], *(F.get(x["features"], F.lit(k)) for k in range(len(FEATURES)))), sizes):
        total = total + F.get(F.array(*(F.lit(y) for y in w[at : at + size])), value)
        at += size
    return total


def rendered(spans: Column) -> Column:
    """kind:start:end of spans in the order kind, start, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    keys = F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("k"), x["start"].alias("s"), x["end"].alias("e"))))
    return F.array_join(F.transform(keys, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, text: Column, *ids: Column) -> DataFrame:
    """(ids, base, added): the base spans of each document and the looser ones that the classifier accepts.

    Spans are structs of kind (a place in KINDS), start, end, the votes and the features.
    """
    found = stored(candidates(docs, text, *ids))
    w = fit(found)
    names = found.columns[: len(ids)]
    return found.select(*names, "base", F.filter("loose", lambda x: _logit(x, w) >= 0).alias("added"))


def masked(text: Column, spans: Column, mask: str = "[PII]") -> Column:
    """The text with each of the spans replaced; the spans of one text must not overlap."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), x["end"].alias("e"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(
            F.greatest(a["at"], x["e"]).alias("at"),
            F.when(x["s"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substring(text, a["at"] + 1, x["s"] - a["at"]), F.lit(mask))).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
