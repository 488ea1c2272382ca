"""URL filters: rules where they fit, else the standing of the host in the link graph; DataFrame operations only.

A rule is host/path with a verdict.  It fits its host and all subdomains, for urls whose path starts with its own; of
the rules that fit the longest wins.

Where none fits, trust and distrust of the host decide.  Hosts link to the hosts that their pages refer to (absolute and
protocol-relative urls in links, forms, sources, bases, canonical references and redirects; a port belongs to the host,
a user does not), and a host and its parent domain, as one owner holds both, link to each other once.  Trust is a personalised PageRank from hosts with allowed
pages along the links; distrust one from hosts with blocked pages against the links: who refers to blocked hosts is
suspect.  A seed's mass is the share of its pages that rules allow or block.  What a host gets is set against what would
reach it, the same way, if all pages of all hosts were seeds: so its shares of trusted and distrusted mass lie between 0
and 1 whatever its degree, and a domain with many subdomains, which pools their mass, has no more than their mean.  A host
is blocked where its distrusted share exceeds its trusted share by ``least``.  Mass that reaches a host without links is
not passed on.

The graph is a table of distinct host pairs with counts, the ranks one row per host; each iteration is one join
and one sum, staged every few iterations, until what each of the ranks still lacks of its limit is in sum
within ``tolerance`` of its seeds' mass; only the sums of the moves are collected.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule and gets the default verdict
if its (empty) host has no standing; a null page has no links; rows that repeat are judged alike; an empty table gives
an empty result; other columns pass through, and result columns replace columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, others, path_of, staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The authority of an absolute or protocol-relative url in an attribute or a redirect.
REFERENCE = r"""(?i)\b(?:href|src|action|cite|data|url)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>\\]+)"""
#: A host of three labels or more that has a parent domain; not an address of four numbers.
SUBDOMAIN = r"^(?!\d+\.\d+\.\d+\.\d+(?::\d+)?$)[^.\[\]]+\.([^.\[\]]+\.[^\[\]]*[^.\[\]])$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(url.contains("://"), F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.greatest(F.length(rest), F.lit(1))), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none; ``rules``: (verdict, host/path), a list of bounded length."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def standing(pages: DataFrame, *, html: str, damping: float, rounds: int | None, tolerance: float, every: int = 8, most: int = 400) -> DataFrame:
    """(host, trust, distrust, reach, back) from pages with ``__host``, ``__verdict`` (of the rules) and their html; ``reach``
    and ``back`` are what trust and distrust would be if all pages were seeds.

    ``rounds``: so many iterations; None: until what each rank still lacks is in sum within ``tolerance`` of its seeds' mass;
    raises after ``most``.  A table of ranks goes once the next is written."""
    kinds = {"trust": True, "distrust": False, "reach": True, "back": False}  # whether along the links
    new = [f"new_{kind}" for kind in kinds]
    seeds = pages.groupBy(F.col("__host").alias("host")).agg(*(F.avg(F.when(F.col("__verdict") == v, 1.0).otherwise(0.0)).alias(f"{v}ed") for v in ("allow", "block")))
    named = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(REFERENCE), F.lit(1))
    linked = pages.select(F.col("__host").alias("a"), F.explode(named).alias("b")).select("a", F.translate(F.regexp_replace("b", "^.*@", ""), UPPER, LOWER).alias("b"))
    linked = linked.where("a <> b and a <> '' and b <> ''").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    hosts = seeds.select("host").union(linked.select("b")).distinct().select("host", F.regexp_extract("host", SUBDOMAIN, 1).alias("parent")).where("parent <> ''")
    family = hosts.select(F.col("host").alias("a"), F.col("parent").alias("b"), F.lit(1).cast("long").alias("n"))
    links = staged(linked.union(family).union(family.select("b", "a", "n")).groupBy("a", "b").agg(F.sum("n").alias("n")), "host-links")
    out, back = links.groupBy("a").agg(F.sum("n").alias("all")), links.groupBy("b").agg(F.sum("n").alias("all"))
    arcs = staged(
        links.join(out, "a").select(F.col("a").alias("u"), F.col("b").alias("v"), (F.col("n") / F.col("all")).alias("w"), F.lit(True).alias("forward"))
        .union(links.join(back, "b").select(F.col("b").alias("u"), F.col("a").alias("v"), (F.col("n") / F.col("all")).alias("w"), F.lit(False).alias("forward"))),
        "host-arcs",
    )
    base = seeds.select("host", F.col("allowed").alias("trust"), F.col("blocked").alias("distrust"), F.lit(1.0).alias("reach"), F.lit(1.0).alias("back"))
    unseen = arcs.select(F.col("v").alias("host")).distinct().join(base, "host", "left_anti").select("host", *(F.lit(0.0).alias(kind) for kind in kinds))
    rank = written = staged(base.union(unseen).select("*", *(F.col(kind).alias(f"new_{kind}") for kind in kinds)), "host-seeds")
    own = rank.select(F.col("host").alias("u"), F.col("host").alias("v"), F.lit(1.0).alias("w"), F.lit(None).cast("boolean").alias("forward"))
    arcs = staged(arcs.union(own), "host-arcs")  # over its own arc a host keeps its rank, so that each iteration reads ranks once
    mass = [max(x or 0.0, 1e-12) for x in rank.agg(*(F.sum(kind) for kind in kinds)).first()]
    for k in range(1, (most if rounds is None else rounds) + 1):
        gone = {kind: F.when(F.col("forward") == along, damping * F.col(f"new_{kind}") * F.col("w")).otherwise(0.0) for kind, along in kinds.items()}
        kept = {kind: F.when(F.col("forward").isNull(), F.col(kind)).otherwise(0.0) for kind in kinds}
        sent = rank.join(arcs, rank["host"] == arcs["u"]).select(F.col("v").alias("host"), *(kept[kind].alias(kind) for kind in kinds), *(gone[kind].alias(f"new_{kind}") for kind in kinds))
        summed = sent.groupBy("host").agg(*(F.sum(c).alias(c) for c in (*kinds, *new)))
        rank = summed.select("host", *((F.col(kind) + F.col(f"new_{kind}")).alias(kind) for kind in kinds), *new)
        if k % every == 0 or k == rounds:
            rank = staged(rank, "host-ranks")
            drop_staged(pages.sparkSession, path_of(written))
            written = rank
            # ranks only grow, and what is still to come is in sum at most damping / (1 - damping) of the last moves
            moved = [x or 0.0 for x in rank.agg(*(F.sum(c) for c in new)).first()]
            if rounds is None and all(x * damping <= tolerance * m * (1 - damping) for x, m in zip(moved, mass, strict=True)):
                return rank
    if rounds is None:
        raise RuntimeError(f"ranks of hosts did not settle in {most} rounds")
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str]], *, url: str = "url", html: str = "html", damping: float = 0.85, rounds: int | None = None, tolerance: float = 0.01, least: float = 0.25, default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict``, the host's ranks ``trust`` and ``distrust``, its shares of trusted
    and distrusted mass, and ``decided_by`` (rule, distrust, trust or default); ``keep``: input columns to pass through."""
    if len(rules) > 1000:
        raise ValueError("rules are one expression; join a table of more than 1000")
    new = ("host", "path", "rule", "verdict", "trust", "distrust", "trust_share", "distrust_share", "decided_by")
    host, path = host_and_path(F.coalesce(url, F.lit("")))
    known = pages.withColumns({"__host": host, "__path": path})
    rule, verdict = rule_for(F.col("__host"), F.col("__path"), rules)
    known = known.withColumns({"__rule": rule, "__verdict": verdict})
    ranks = standing(known, html=html, damping=damping, rounds=rounds, tolerance=tolerance)
    ranks = ranks.select(F.col("host").alias("__of"), *(F.col(c).alias(f"__{c}") for c in ("trust", "distrust", "reach", "back")))
    passed = others(pages.columns if keep is None else keep, new)
    own = known.select(*passed, "__host", "__path", "__rule", "__verdict").join(ranks, F.col("__host") == F.col("__of"), "left")
    trust, distrust = F.coalesce("__trust", F.lit(0.0)), F.coalesce("__distrust", F.lit(0.0))
    # sums of floats come in any order; at nine digits reruns agree
    share = lambda part, whole: F.round(F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0.0)), F.lit(0.0)), 9)
    good, bad = share("__trust", "__reach"), share("__distrust", "__back")
    by = F.when(F.col("__verdict").isNotNull(), "rule").when(bad - good >= least, "distrust").when(good > bad, "trust").otherwise("default")
    said = F.coalesce("__verdict", F.when(by == "distrust", "block").when(by == "trust", "allow").otherwise(default))
    return own.select(*passed, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), said.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"), good.alias("trust_share"), bad.alias("distrust_share"), by.alias("decided_by"))
