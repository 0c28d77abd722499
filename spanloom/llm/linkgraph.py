"""URL verdicts by rules, and by trust and distrust that links carry between hosts.

Pages that a rule fits have the rule's verdict. The hosts of allowed pages are seeds of trust, those of
blocked pages seeds of distrust, weighed by their pages. Trust flows along links by personalised PageRank,
distrust against them, each returning to its seeds; a host whose share of distrust in both exceeds a
threshold has its other pages blocked. Links are counted per pair of hosts before they are shuffled, a hub's
are dealt to several tasks, and each pass is written out, so that the plan stays short and a lost executor
costs a reread. DataFrame operations alone.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed;
a null html has no links; a host without links or seeds has neither trust nor distrust and is allowed;
repeated rows count as pages each; other columns are passed over; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free, stash


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with its subdomains, and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

DAMPING = 0.85
#: The part of a host's own rank that a pass may still add when ``settle`` ends.
TOLERANCE = 1e-12
#: Links of a host with as many other hosts are dealt to several tasks.
HUB_LINKS = 100_000
MOST_DISTRUST = 0.5
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


def ascii_lower(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. The rules are a short list, sorted here."""
    text, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = text.when(fits, F.lit(r.text)), verdict.when(fits, F.lit(r.verdict))
    return text, verdict


def host_links(pages: DataFrame, html: str) -> DataFrame:
    """``src``, ``dst`` and the number of links, without links within a host."""
    targets = F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(LINK), F.lit(1))
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(targets).alias("__to"))
    return links.select("src", ascii_lower(F.col("__to")).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))


def _shares(links: DataFrame, hub_links: int) -> tuple[DataFrame, DataFrame]:
    """(``src``, ``dst``, each link's part of all of src's and of all to dst, ``s`` and ``e``: parts of a hub's links; the hubs)."""
    both = links.select(F.col("src").alias("host"), F.lit(True).alias("out"), "n").unionByName(links.select(F.col("dst").alias("host"), F.lit(False).alias("out"), "n"))
    sums = stash(both.groupBy("host", "out").agg(F.sum("n").alias("all"), F.count("*").alias("links")), "link-sums")
    hubs = stash(sums.groupBy("host").agg(F.ceil(F.max("links") / hub_links).cast("int").alias("parts")).where("parts > 1"), "hubs")
    dealt = links
    for end, other, part in (("src", "dst", "s"), ("dst", "src", "e")):
        dealt = dealt.join(hubs.withColumnRenamed("host", end), end, "left")
        dealt = dealt.withColumn(part, F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    out, into = (spread(sums.where(F.col("out") == o).drop("out", "links"), hubs).withColumnsRenamed({"host": end, "all": all_, "part": part}) for o, end, all_, part in ((True, "src", "all_out", "s"), (False, "dst", "all_in", "e")))
    found = dealt.join(out, ["src", "s"]).join(into, ["dst", "e"])
    return stash(found.select("src", "s", "dst", "e", (F.col("n") / F.col("all_out")).alias("down"), (F.col("n") / F.col("all_in")).alias("up")), "link-shares"), hubs


def spread(rows: DataFrame, hubs: DataFrame) -> DataFrame:
    """``rows`` by host, those of hubs once for each ``part``."""
    return rows.join(hubs, "host", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def settle(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, hub_links: int = HUB_LINKS) -> DataFrame:
    """``host``, ``trust`` and ``distrust`` from ``links`` (src, dst, n) and ``seeds`` (host, good, bad: sums of 1 each).

    One grouped sum for each pass carries both: trust from src to dst in shares of src's links, distrust from
    dst to src in shares of the links to dst, each damped. What hosts without links would send returns to the
    seeds, so it scales all ranks alike: it is left out here, and the ranks are scaled to the seeds' sum at the
    end. What still moves is kept apart from the ranks; hosts it has passed are out of it, so a graph without
    cycles takes one pass more than its longest path. A host has settled when a pass adds less than
    ``tolerance`` of its own rank, however small that is: one more link from the seeds is never too far. Raises
    if this isn't so after twice as many passes as there are hosts and passes that damp a movement to the
    tolerance.
    """
    shares, hubs = _shares(links, hub_links)
    moving = stash(seeds.groupBy("host").agg(F.sum("good").alias("t"), F.sum("bad").alias("d")).where("t > 0 or d > 0"), "moving")
    sums = moving.agg(F.sum("t"), F.sum("d")).first()
    ranks = stash(moving.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust")), "ranks")
    most = None
    passes, due, sent = 0, 1, []
    part = lambda x, of: F.when(F.col(x) > 0, F.col(x) / F.col(of)).otherwise(0.0)
    while True:
        here = spread(moving, hubs)
        down = shares.join(here.where("t > 0"), (F.col("src") == F.col("host")) & (F.col("s") == F.col("part"))).select(F.col("dst").alias("host"), (damping * F.col("t") * F.col("down")).alias("t"), F.lit(0.0).alias("d"))
        up = shares.join(here.where("d > 0"), (F.col("dst") == F.col("host")) & (F.col("e") == F.col("part"))).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (damping * F.col("d") * F.col("up")).alias("d"))
        moving = stash(down.unionByName(up).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "moving")
        sent.append(moving)
        passes += 1
        if passes < due:
            continue
        # ranks are summed after passes 1, 2, 4 and 8, and every 8 from there
        due = passes + min(passes, 8)
        added = ranks
        for x in sent:
            added = added.unionByName(x.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust")))
        before, ranks = ranks, stash(added.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
        free(before, *sent[:-1])
        sent = []
        moved = moving.join(ranks, "host").agg(F.max(F.greatest(part("t", "trust"), part("d", "distrust")))).first()[0]
        if moved is None or moved < tolerance:
            break
        if most is None:
            hosts = shares.select(F.explode(F.array("src", "dst")).alias("host")).distinct().count()
            most = 2 * (hosts + math.ceil(math.log(tolerance) / math.log(damping)))
        if passes >= most:
            raise RuntimeError(f"ranks of hosts haven't settled after {passes} passes: {moved} of a host's still moved")
    total = ranks.agg(F.sum("trust"), F.sum("distrust")).first()
    scale = [(s or 0.0) / t if t else 0.0 for s, t in zip(sums, total, strict=True)]
    scaled = ranks.select("host", (F.col("trust") * scale[0]).alias("trust"), (F.col("distrust") * scale[1]).alias("distrust"))
    others = seeds.select("host").unionByName(shares.select(F.explode(F.array("src", "dst")).alias("host"))).distinct()
    return others.join(scaled, "host", "left").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url", html: str = "html", most_distrust: float = MOST_DISTRUST) -> DataFrame:
    """Per page: key, ``host``, ``path``, ``rule`` and ``verdict``."""
    host, path = parts(F.col(url))
    split = pages.select(F.col(key), F.col(html), host.alias("host"), path.alias("path"))
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    ruled = split.withColumns({"rule": rule, "__ruled": verdict})
    seeds = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("__ruled") == "allow").alias("a"), F.count_if(F.col("__ruled") == "block").alias("b"))
    seeds = stash(seeds, "seeds")
    sums = seeds.agg(F.sum("a"), F.sum("b")).first()
    share = lambda c, total: (F.col(c) / float(total) if total else F.lit(0.0))
    weighed = seeds.select("host", share("a", sums[0]).alias("good"), share("b", sums[1]).alias("bad"))
    links = stash(host_links(split, html), "host-links")
    ranks = settle(links, weighed)
    both = F.col("trust") + F.col("distrust")
    blocked = stash(ranks.where((both > 0) & (F.round(F.col("distrust") / both, 9) > most_distrust)).select(F.col("host").alias("__bad")), "blocked")
    judged = ruled.drop(html).join(blocked, F.col("host") == F.col("__bad"), "left")
    method = F.when(F.col("__bad").isNotNull(), "block").otherwise("allow")
    return judged.select(key, "host", "path", "rule", F.coalesce("__ruled", method).alias("verdict"))
