"""Personal data by weak supervision, in DataFrame operations only.

Base spans are what the patterns find and their checks accept. Around them looser patterns
propose further candidates. Labelers (strict shape, checks, gazetteers, context words, edges)
vote for or against each candidate or abstain. Expectation-maximisation over the counts of
vote patterns estimates how reliable each labeler is and how likely a pattern means personal
data; with these soft labels a naive Bayes span classifier is trained on hashed features of the
span and what surrounds it. Loose candidates that it accepts are added; base spans always stay,
and a candidate that a base rule refused stays refused.

Fitting reads all documents and hands the driver two tables of fixed size: counts by kind and
vote pattern, and sums by hashed feature. Spans are found inside each row, so neither texts nor
spans are shuffled, and a source or group of copies of any size is just more rows.

Rules for odd input: null texts count as empty and have no spans; positions count code points;
repeated rows are judged alike; without any candidate the model adds nothing; an empty table
gives an empty result. Patterns are written so that long runs of one kind of character take
linear time. Columns of other names are carried through.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.common import filled

#: Kinds in their order. The first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "name")
BASE_KINDS = KINDS[:4]

# The given patterns. Possessive repeats cannot change a match that nothing follows, and a
# match starts where its run of characters or the search (\G) does, so the same spans are
# found without trying each place in a run.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(]at[\])]\x20?"
             r"[A-Za-z0-9-]{1,64}+(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,64}+)++",
    "phone": r"(?<![A-Za-z0-9+.-])(?:\+?[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])"
             r"[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.\x20[A-Z][a-z]{1,30}+(?:\x20[A-Z][a-z]{1,30}+)?",
}
#: What a text must have for the pattern to be tried.
_NEEDS = {
    "email": "@", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]",
    "loose_email": r"(?i)[\[(]at[\])]", "loose_phone": "[0-9]{3}", "loose_ssn": "[0-9]-[0-9]",
    "loose_name": r"(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z]",
}
_STRICT = {
    "email": r"^[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}$",
    "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$",
    "card": r"^(?:[0-9]{13,16}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^\+?[0-9]{0,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"^[A-Z][a-z]+\. [A-Z][a-z]+ [A-Z][a-z]+$",
}
#: Kinds of which all loose matches have the strict shape and pass the check, or none does.
_IMPLIED = ("email", "phone")
# gazetteers: endings of common domains, leading digits of card issuers, calling codes in
# common use, common given names
_KNOWN = {
    "email": r"(?i)(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl)$",
    "ip": r"^(?!0|127\.|255\.|24[0-9]\.|25[0-4]\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6)",
    "phone": r"^(?:\+?(?:1|33|34|39|41|43|44|49|61|81|86|91)\b|\()",
    "ssn": r"^(?!9)",
    "name": r"\. (?:James|John|Robert|Michael|David|Mary|Anna|Maria|Peter|Paul|Jean|Hans|Juan|Linda|"
            r"Susan|Thomas|Laura|Carlos|Sarah|Karl)",
}
_FOR = (
    r"(?i)\b(?:e-?mail|mail|contact|call|phone|tel|telephone|mobile|fax|reach|write|card|visa|"
    r"mastercard|paid|account|ip|address|login|ssn|social security|name|patient|customer)\b\W*\w{0,12}\W*$"
)
_AGAINST = (
    r"(?i)(?:\b(?:version|release|isbn|order|invoice|serial|build|token|hash|id|example|page|"
    r"section|chapter|figure)\b|[=#$/])\W*\w{0,3}\W*$"
)
LABELERS = 5
FEATURES = 4096
ACCEPT = 0.5
#: Reliability that EM starts from and is drawn towards, with the weight of so many votes.
_PRIOR_RIGHT, _PRIOR_WEIGHT, _EM_STEPS = 0.8, 10.0, 50
_CHUNK = 256


def _running(array: str) -> str:
    """SQL: for each element the sum of those before it."""
    return (
        f"aggregate({array}, named_struct('sum', 0L, 'out', cast(array() as array<bigint>)), "
        "(s, x) -> named_struct('sum', s.sum + x, 'out', concat(s.out, array(s.sum)))).out"
    )


def _found(docs: DataFrame, name: str, pattern: str) -> DataFrame:
    """Adds ``name``: start, end, match and what stands next to it, of every match in ``_text``.

    Positions are sums over the lengths of matches and of what lies between them, taken in
    chunks so that many matches in a text do not cost the square of their number.
    """
    needed = F.col("_text").rlike(_NEEDS[name])
    none = "cast(array() as array<string>)"
    c = f"cast(size(_match) / {_CHUNK} as int)"
    return (
        docs.withColumn("_match", F.when(
            needed, F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        ).otherwise(F.expr(none)))
        .withColumn("_gap", F.expr(
            f"CASE WHEN size(_match) > 0 THEN split(_text, '{_quoted(pattern)}', -1) ELSE {none} END"
        ))
        .withColumn("_step", F.expr(
            f"transform(sequence(0, {c}), c -> transform("
            f"slice(_match, c * {_CHUNK} + 1, {_CHUNK}), "
            f"(m, i) -> cast(length(m) + length(_gap[c * {_CHUNK} + i]) as bigint)))"
        ))
        .withColumn("_first", F.expr(
            _running("transform(_step, s -> aggregate(s, 0L, (a, x) -> a + x))")
        ))
        .withColumn("_before", F.expr(
            f"flatten(zip_with(_step, _first, (s, f) -> transform({_running('s')}, x -> x + f)))"
        ))
        .withColumn(name, F.expr(
            "transform(_match, (m, i) -> named_struct("
            "'start', _before[i] + length(_gap[i]), 'end', _before[i] + length(_gap[i]) + length(m), "
            "'match', m, 'before', right(_gap[i], 40), 'after', left(_gap[i + 1], 1)))"
        ))
        .drop("_match", "_gap", "_step", "_first", "_before")
    )


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


_DIGITS = "regexp_replace(x.match, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (a, i) -> a + "
    f"CASE WHEN i % 2 = 1 THEN cast(substring(reverse({_DIGITS}), i, 1) as int) "
    f"ELSE cast(substring(reverse({_DIGITS}), i, 1) as int) * 2 "
    f"- CASE WHEN substring(reverse({_DIGITS}), i, 1) >= '5' THEN 9 ELSE 0 END END) % 10 = 0"
)
#: Checks of the base rules, as SQL over a match x.
_CHECKS = {
    "email": "true",
    "ip": r"x.match rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": f"(length({_DIGITS}) between 12 and 19) and {_LUHN}",
    "phone": f"length({_DIGITS}) between 9 and 15",
    "ssn": "true",
    "name": "true",
}
#: Matches of base patterns that are worth a labeler's look.
_LOOKED_AT = {
    "email": "true", "ip": "true", "phone": "true",
    "card": f"length({_DIGITS}) between 12 and 19",
}


def _vote(yes: str, no: str) -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def _candidate(kind: str, origin: str) -> str:
    """SQL: the match x as a candidate with votes and features.

    ``origin``: base (accepted by the base rule), refused, or loose. A labeler whose vote
    follows from the pattern that proposed the candidate says nothing about it and abstains.
    """
    strict, known = _quoted(_STRICT[kind]), _quoted(_KNOWN[kind])
    implied = origin == "'loose'" and kind in _IMPLIED
    votes = [
        "0" if implied else _vote(f"x.match rlike '{strict}'", "true"),
        "0" if implied or kind in ("email", "ssn", "name") else _vote(_CHECKS[kind], "true"),
        _vote(f"x.match rlike '{known}'", "true"),
        _vote(f"x.before rlike '{_quoted(_FOR)}'", f"x.before rlike '{_quoted(_AGAINST)}'"),
        _vote("not (right(x.before, 1) rlike '[A-Za-z0-9]' or x.after rlike '[A-Za-z0-9@]')", "true"),
    ]
    shape = (
        "substring(regexp_replace(regexp_replace(regexp_replace(x.match, '[0-9]', '9'), "
        "'[A-Za-z]+', 'a'), '9{5,}', '9+'), 1, 30)"
    )
    word = "lower(regexp_extract(x.before, '([A-Za-z]+)[^A-Za-z]*$', 1))"
    features = [
        f"concat('{kind} shape ', {shape})", f"concat('{kind} word ', {word})",
        f"concat('{kind} next ', regexp_replace(x.after, '[A-Za-z0-9]', 'w'))",
        f"concat('{kind} length ', cast(least(length(x.match), 40) div 4 as string))",
        f"concat('{kind} last ', regexp_replace(right(x.before, 1), '[A-Za-z0-9]', 'w'))",
    ]
    hashed = ", ".join(f"cast(pmod(xxhash64({f}), {FEATURES}) as int)" for f in features)
    return (
        f"named_struct('start', x.start, 'rank', {KINDS.index(kind)}, 'end', x.end, "
        f"'kind', '{kind}', 'origin', {origin}, 'votes', concat_ws(',', {', '.join(votes)}), "
        f"'features', array({hashed}))"
    )


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` as a struct ``_doc`` with arrays ``_base`` (accepted by base rules) and
    ``_other`` (refused or loose, the latter without those that touch a base span)."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("_doc"),
                       filled(docs[text]).alias("_text"))
    for kind, pattern in BASE.items():
        rows = _found(rows, kind, pattern)
    for kind, pattern in LOOSE.items():
        rows = _found(rows, f"loose_{kind}", pattern)
    looked = ", ".join(
        f"transform(filter({k}, x -> {_LOOKED_AT[k]}), x -> "
        + _candidate(k, f"CASE WHEN {_CHECKS[k]} THEN 'base' ELSE 'refused' END") + ")"
        for k in BASE
    )
    rows = rows.withColumn("_looked", F.expr(f"concat({looked})"))
    rows = rows.withColumn("_base", F.expr("array_sort(filter(_looked, c -> c.origin = 'base'))"))
    loose = ", ".join(
        f"transform(loose_{k}, x -> " + _candidate(k, "'loose'") + ")" for k in LOOSE
    )
    rows = rows.withColumn("_loose", F.expr(f"concat({loose})"))
    free = "not exists(_base, b -> b.start < c.end and c.start < b.end)"
    return rows.withColumn("_other", F.expr(
        f"concat(filter(_looked, c -> c.origin = 'refused'), filter(_loose, c -> {free}))"
    )).select("_doc", "_text", "_base", "_other")


@dataclass(frozen=True)
class Model:
    """Probability of each (kind, votes), right-vote rates of labelers, feature weights."""

    patterns: dict[tuple[str, str], float]
    reliabilities: tuple[tuple[float, float], ...]
    bias: float
    weights: tuple[float, ...]

    def probability(self, features: str) -> str:
        """SQL: what the span classifier gives for an array of hashed features."""
        weights = f"from_json('{json.dumps(self.weights)}', 'array<double>')"
        score = f"aggregate({features}, double({self.bias!r}), (a, f) -> a + {weights}[f])"
        return f"1 / (1 + exp(-({score})))"


def em(counts: dict[tuple[str, str], int]) -> tuple[dict[tuple[str, str], float], tuple[tuple[float, float], ...]]:
    """Two-class latent model of independent labelers over counts of (kind, votes).

    Returns P(personal) by pattern, and for each labeler how often it is right on personal
    and on other candidates when it votes. Each kind has its own share of personal data.
    """
    votes = {p: [int(v) for v in p[1].split(",")] for p in counts}
    right = [(_PRIOR_RIGHT, _PRIOR_RIGHT)] * LABELERS
    share = dict.fromkeys({k for k, _ in counts}, 0.5)
    chance: dict[tuple[str, str], float] = {}
    for _ in range(_EM_STEPS):
        for p in counts:
            yes, no = math.log(share[p[0]]), math.log(1 - share[p[0]])
            for (on_yes, on_no), v in zip(right, votes[p], strict=True):
                if v:
                    yes += math.log(on_yes if v > 0 else 1 - on_yes)
                    no += math.log(1 - on_no if v > 0 else on_no)
            chance[p] = 1 / (1 + math.exp(min(700.0, max(-700.0, no - yes))))
        rates = []
        for i in range(LABELERS):
            sums = [_PRIOR_RIGHT * _PRIOR_WEIGHT, _PRIOR_WEIGHT] * 2
            for p, n in counts.items():
                v = votes[p][i]
                if v:
                    sums[0] += n * chance[p] * (v > 0)
                    sums[1] += n * chance[p]
                    sums[2] += n * (1 - chance[p]) * (v < 0)
                    sums[3] += n * (1 - chance[p])
            # a labeler is taken to be better than a coin
            rates.append(tuple(min(0.999, max(0.5, a / b)) for a, b in (sums[:2], sums[2:])))
        right = rates
        for k in share:
            of = [(n, chance[p]) for p, n in counts.items() if p[0] == k]
            mass = sum(n * c for n, c in of)
            share[k] = (mass + 1) / (sum(n for n, _ in of) + 2)
    return chance, tuple(right)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Fit on every candidate of ``docs``. What reaches the driver: at most a row per kind
    and vote pattern (6 * 3^5) and per hashed feature (4,096)."""
    found = with_candidates(docs.select(docs[text].alias("text")))
    each = found.select(F.explode(F.concat("_base", "_other")).alias("c")).select("c.*")
    # one pass over the texts: features by pattern, from which both tables are summed up
    by_feature = each.select(
        "kind", "votes", F.explode(F.concat(F.array(F.lit(-1)), "features")).alias("feature")
    ).groupBy("kind", "votes", "feature").agg(F.count("*").alias("n"))
    rows = by_feature.collect()  # patterns times features: bounded, and far fewer occur
    counts = {(r.kind, r.votes): r.n for r in rows if r.feature < 0}
    chance, right = em(counts)
    yes, no = [1.0] * FEATURES, [1.0] * FEATURES
    for r in rows:
        if r.feature >= 0:
            yes[r.feature] += r.n * chance[r.kind, r.votes]
            no[r.feature] += r.n * (1 - chance[r.kind, r.votes])
    all_yes = 1.0 + sum(n * chance[p] for p, n in counts.items())
    all_no = 1.0 + sum(n * (1 - chance[p]) for p, n in counts.items())
    weights = tuple(
        round(math.log(a / all_yes) - math.log(b / all_no), 6) if a + b > 2 else 0.0
        for a, b in zip(yes, no, strict=True)
    )
    return Model(chance, right, round(math.log(all_yes / all_no), 6), weights)


def with_spans(docs: DataFrame, model: Model, text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``_doc``, ``_text``, ``_base`` and ``_spans``: base spans and accepted loose ones by
    start, then kind. Loose candidates that overlap an earlier accepted one are left out."""
    likely = model.probability("c.features")
    added = (
        "aggregate(array_sort(filter(_other, c -> c.origin = 'loose' and "
        f"{likely} >= {accept})), filter(_base, c -> false), (a, c) -> "
        "CASE WHEN exists(a, b -> b.start < c.end and c.start < b.end) THEN a "
        "ELSE concat(a, array(c)) END)"
    )
    return with_candidates(docs, text).withColumn(
        "_spans", F.when(F.size("_other") > 0, F.expr(f"array_sort(concat(_base, {added}))"))
        .otherwise(F.col("_base"))
    ).drop("_other")


def _as_text(spans: str) -> Column:
    return F.expr(
        f"array_join(transform({spans}, c -> concat(c.kind, ':', c.start, ':', c.end)), ',')"
    )


def report(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256
    and spans (all spans as kind:start:end)."""
    counts = [
        F.expr(f"cast(size(filter(_base, c -> c.kind = '{k}')) as bigint)").alias(f"n_{k}")
        for k in BASE_KINDS
    ]
    return with_spans(docs, fit(docs, text), text).select(
        F.col(f"_doc.`{id_column}`").alias("doc_id"), *counts,
        F.sha2(_as_text("_base"), 256).alias("base_sha256"), _as_text("_spans").alias("spans"),
    )


def redacted(
    docs: DataFrame, model: Model | None = None, text: str = "text", length: str | None = "n_chars"
) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets and ``length``, if there
    is such a column, set anew. Of spans that overlap the first names the place, and all of
    them go. Texts without spans, null ones too, stay as they are."""
    spans = with_spans(docs, model or fit(docs, text), text)
    # spans that overlap make one
    merged = F.expr(
        "aggregate(_spans, cast(array() as array<struct<start: bigint, end: bigint, kind: string>>), "
        "(a, c) -> CASE WHEN size(a) > 0 AND c.start < a[size(a) - 1].end "
        "THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', a[size(a) - 1].start, "
        "'end', greatest(a[size(a) - 1].end, c.end), 'kind', a[size(a) - 1].kind))) "
        "ELSE concat(a, array(named_struct('start', c.start, 'end', c.end, 'kind', c.kind))) END)"
    )
    pieces = F.expr(
        "array_join(transform(_merged, (c, i) -> concat("
        "substring(_text, cast(CASE WHEN i = 0 THEN 1 ELSE _merged[i - 1].end + 1 END as int), "
        "cast(c.start - CASE WHEN i = 0 THEN 0 ELSE _merged[i - 1].end END as int)), "
        "'<', upper(c.kind), '>')), '')"
    )
    rest = F.expr("substring(_text, cast(_merged[size(_merged) - 1].end + 1 as int))")
    touched = spans.withColumn("_merged", F.when(F.size("_spans") > 0, merged))
    new_text = F.when(F.size("_spans") > 0, F.concat(pieces, rest)).otherwise(F.col(f"_doc.`{text}`"))
    touched = touched.withColumn("_new", new_text)
    columns = []
    for c, kind in docs.dtypes:
        old = F.col(f"_doc.`{c}`")
        if c == text:
            old = F.col("_new")
        elif c == length:
            old = F.when(F.size("_spans") > 0, F.char_length("_new").cast(kind)).otherwise(old)
        columns.append(old.alias(c))
    return touched.select(*columns)
