"""Url verdicts: rules first, else trust and distrust spread over the links between hosts.

Trust starts at hosts whose pages the rules mostly allow and follows links; distrust starts at
hosts whose pages they mostly block and follows links backwards, since a host that links to
bad ones is itself suspect. Both are personalised PageRank over host edges. A host whose
distrust has more than ``threshold`` of the sum of both is blocked; all others, also those
that neither reaches, are allowed. DataFrame operations only.

Rules for odd input: a null url or one without ``://`` has an empty host and path and no
rule; hosts without text take no part in the graph, so such pages are allowed. Null html has
no links. Links of a host to itself count for nothing. Repeated pages count as often as they
occur; an empty table gives an empty result. Only url, html and the id are read.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.session import cut_lineage

#: Host, path and verdict of the rules in use (fixed values).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_LINK = r"(?i)(?:href|src)\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s<>]+)"
DAMPING = 0.85
THRESHOLD = 0.5
TOLERANCE = 1e-6
#: Rounds of the SQL: a round moves ``DAMPING`` times what the one before moved at most, and the
#: first at most 2, so after these the tolerance is reached.
_SQL_STEPS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(
        F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit("")
    )


def path_of(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def _fitting(rules: Sequence[tuple[str, str, str]], value) -> Column:
    """``value(rule)`` of the longest rule that fits the row's host and path, else null."""
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    choice = F.lit(None).cast("string")
    for rule in reversed(longest_first):
        host, path, _ = rule
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col(
            "path"
        ).startswith(path)
        choice = F.when(fits, F.lit(value(rule))).otherwise(choice)
    return choice


def judged_by_rule(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
    id_column: str = "page_id", url: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, rule_verdict (null where none fits)."""
    return pages.select(
        F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")
    ).select(
        "*", _fitting(rules, lambda r: r[0] + r[1]).alias("rule"),
        _fitting(rules, lambda r: r[2]).alias("rule_verdict"),
    )


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst, weight: number of links between two different hosts.

    Links are summed per task before they are shuffled, so a host with a third of all pages
    sends one row per target and task.
    """
    links = F.regexp_extract_all(F.col(html), F.lit(_LINK), F.lit(1))
    lowered = F.translate("dst", string.ascii_uppercase, string.ascii_lowercase)
    return (
        pages.select(host_of(url).alias("src"), F.explode(links).alias("dst"))
        .withColumn("dst", lowered).where("src <> '' and dst <> '' and src <> dst")
        .groupBy("src", "dst").agg(F.count("*").alias("weight"))
    )


def seeds(judged: DataFrame) -> DataFrame:
    """host, trusted, blocked: start weights that sum to 1 each (0 everywhere without seeds).

    A host is a seed if rules allow (block) more than half of its pages.
    """
    share = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    hosts = judged.where("host <> ''").groupBy("host").agg(
        (share("allow") > 0.5).cast("double").alias("t"),
        (share("block") > 0.5).cast("double").alias("b"),
    )
    total = hosts.agg(F.sum("t").alias("sum_t"), F.sum("b").alias("sum_b")).first()
    return hosts.select(
        "host", (F.col("t") / max(total.sum_t or 0.0, 1.0)).alias("trusted"),
        (F.col("b") / max(total.sum_b or 0.0, 1.0)).alias("blocked"),
    )


def _sums(edges: DataFrame, scores: DataFrame, frm: str, to: str, total: str, score: str) -> DataFrame:
    """host, got: what ``score`` sends along the edges from ``frm`` to ``to``."""
    sent = F.col(score) * F.col("weight") / F.col(total)
    return (
        edges.join(scores.select(F.col("host").alias(frm), score).where(F.col(score) > 0), frm)
        .groupBy(F.col(to).alias("host")).agg(F.sum(sent).alias(f"got_{score}"))
    )


def propagate(
    edges: DataFrame, start: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
) -> DataFrame:
    """host, trust, distrust once a round moves no more than ``tolerance`` in sum. As a round
    moves ``damping`` times what the one before moved at most, that takes some 90 rounds with
    the default numbers, whatever the graph.

    Each round is one join and one sum per direction over host edges, written to the shared
    folder, which cuts the lineage and is what a lost executor starts again from. Hosts that
    are only linked to start with no weight.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("sent"))
    into = edges.groupBy("dst").agg(F.sum("weight").alias("received"))
    edges = cut_lineage(edges.join(out, "src").join(into, "dst"))
    linked = edges.select(F.col("dst").alias("host")).unionAll(
        edges.select(F.col("src").alias("host"))
    ).distinct()
    start = cut_lineage(
        start.join(linked, "host", "full").na.fill(0.0, ["trusted", "blocked"])
    )
    keep = 1.0 - damping
    scores = start.select(
        "host", (F.col("trusted") * keep).alias("trust"), (F.col("blocked") * keep).alias("distrust")
    )
    while True:
        trust = _sums(edges, scores, "src", "dst", "sent", "trust")
        distrust = _sums(edges, scores, "dst", "src", "received", "distrust")
        old = scores.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        got = (
            start.join(old, "host").join(trust, "host", "left").join(distrust, "host", "left")
            .na.fill(0.0, ["got_trust", "got_distrust"])
        )
        new = cut_lineage(got.select(
            "host", "t0", "d0",
            (F.col("trusted") * keep + F.col("got_trust") * damping).alias("trust"),
            (F.col("blocked") * keep + F.col("got_distrust") * damping).alias("distrust"),
        ))
        moved = new.agg(
            F.sum(F.abs(F.col("trust") - F.col("t0")) + F.abs(F.col("distrust") - F.col("d0")))
        ).first()[0]
        scores = new.select("host", "trust", "distrust")
        if (moved or 0.0) <= tolerance:
            return scores


def verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES,
    damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
    id_column: str = "page_id", url: str = "url", html: str = "html",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust (of the host).

    The host scores are a stored table with one row per host; pages meet them in a plain
    join, in which Spark splits the rows of a very common host.
    """
    judged = judged_by_rule(pages, rules, id_column, url)
    scores = propagate(host_edges(pages, url, html), seeds(judged), damping, tolerance)
    bad = F.coalesce(
        F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")), F.lit(False)
    )
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def _verdict_sql() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))

    def choice(value) -> str:
        whens = " ".join(
            f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') "
            f"THEN '{value((h, p, v))}'" for h, p, v in longest
        )
        return f"CASE {whens} END"

    steps = []
    for i in range(1, _SQL_STEPS + 1):
        steps.append(f"""
    s{i} AS MATERIALIZED (
      SELECT s.host, {1 - DAMPING} * trusted + {DAMPING} * coalesce(t.got, 0) AS trust,
             {1 - DAMPING} * blocked + {DAMPING} * coalesce(d.got, 0) AS distrust
      FROM start s
      LEFT JOIN (SELECT dst AS host, sum(x.trust * weight / sent) AS got
                 FROM edges JOIN s{i - 1} x ON x.host = src GROUP BY dst) t ON t.host = s.host
      LEFT JOIN (SELECT src AS host, sum(x.distrust * weight / received) AS got
                 FROM edges JOIN s{i - 1} x ON x.host = dst GROUP BY src) d ON d.host = s.host)""")
    link = _LINK.replace("(?i)", "").replace("'", "''")
    lower = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    return f"""
WITH p AS MATERIALIZED (
      SELECT page_id, html,
             translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), {lower}) AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
      FROM pages),
    judged AS MATERIALIZED (
      SELECT page_id, host, path, {choice(lambda r: r[0] + r[1])} AS rule,
             {choice(lambda r: r[2])} AS rule_verdict FROM p),
    links AS (
      SELECT src, dst, count(*) AS weight FROM (
        SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1, 'i')), {lower}) AS dst
        FROM p) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
    edges AS MATERIALIZED (
      SELECT *, sum(weight) OVER (PARTITION BY src) AS sent,
             sum(weight) OVER (PARTITION BY dst) AS received FROM links),
    hosts AS (
      SELECT host,
             CASE WHEN avg(CASE WHEN rule_verdict = 'allow' THEN 1.0 ELSE 0 END) > 0.5 THEN 1.0 ELSE 0 END AS t,
             CASE WHEN avg(CASE WHEN rule_verdict = 'block' THEN 1.0 ELSE 0 END) > 0.5 THEN 1.0 ELSE 0 END AS b
      FROM judged WHERE host <> '' GROUP BY host),
    named AS (SELECT src AS host FROM edges UNION SELECT dst FROM edges UNION SELECT host FROM hosts),
    start AS MATERIALIZED (
      SELECT host, coalesce(t, 0)::DOUBLE / greatest(1, (SELECT sum(t) FROM hosts)) AS trusted,
             coalesce(b, 0)::DOUBLE / greatest(1, (SELECT sum(b) FROM hosts)) AS blocked
      FROM named LEFT JOIN hosts USING (host)),
    s0 AS (SELECT host, {1 - DAMPING} * trusted AS trust, {1 - DAMPING} * blocked AS distrust FROM start),
    {",".join(steps)}
SELECT page_id, j.host, path, rule,
       coalesce(rule_verdict, CASE WHEN distrust > {THRESHOLD} * (trust + distrust)
                                   THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN s{_SQL_STEPS} ON s{_SQL_STEPS}.host = j.host
"""


VERDICT_SQL = _verdict_sql()
