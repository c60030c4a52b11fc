"""URL verdicts: rules first, else trust and distrust propagated over host edges.

Host edges come from the pages' links (absolute and protocol-relative ``href``
and ``src`` values) and from the host hierarchy: a host and its parent domain
link to each other as long as two labels are left.  Hosts whose pages the rules
allow are trusted seeds, hosts with blocked pages are distrust seeds, each with
the share of its pages concerned.  Trust is a personalised PageRank from the
trusted seeds along the edges, distrust the same from the blocked seeds against
the edges.  After ``ROUNDS`` rounds at most ``DAMPING ** ROUNDS`` (a millionth) of
the seeds' weight has not been passed on; what reaches a host without edges ends
there.  A host is blocked where distrust is more than ``LIMIT`` of trust plus
distrust; a host that neither reaches is allowed.

DataFrame functions only.  Edges are summed per host pair before they are
joined; a host with very many pages is one row of the graph.

Nulls and urls without ``://`` have an empty host and path, fit no rule and are
allowed.  Repeated pages count once each in a seed's share, and get a row each.
Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS, LIMIT = 0.5, 20, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?:href|src|HREF|SRC)[ \t\r\n]*=[ \t\r\n]*["']?(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#"'<> \t\r\n]+)"""


def rest(url: Column) -> Column:
    """What follows the first ://, else empty."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def judged_pages(pages: DataFrame, rules=RULES) -> DataFrame:
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    base = base.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    name, verdict = match_rule(F.col("host"), F.col("path"), rules)
    return base.select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, with the hierarchy's edges (n = 1 each way)."""
    page = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.col("html").cast("string").alias("html"))
    links = page.where("src <> '' and contains(html, '//')").select("src", F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = page.select(F.col("src").alias("host")).where("host <> ''").distinct()
    label = F.split("host", r"\.")
    # every suffix of a host with two labels at least, as a chain of parent links
    chain = hosts.select(F.transform(F.sequence(F.lit(1), F.greatest(F.size(label) - 1, F.lit(1))), lambda k: F.array_join(F.slice(label, k, F.size(label)), ".")).alias("c"))
    up = chain.select(F.explode(F.expr("transform(sequence(1, greatest(size(c) - 1, 1)), k -> struct(try_element_at(c, k) as a, try_element_at(c, k + 1) as b))")).alias("e")).select("e.*").where("a is not null and b is not null").distinct()
    both = up.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(up.select(F.col("b").alias("src"), F.col("a").alias("dst"))).withColumn("n", F.lit(1.0))
    return links.unionByName(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust; seeds: host, trusted, blocked (shares)."""
    ways = edges.select(F.lit("t").alias("kind"), "src", "dst", "n").unionByName(edges.select(F.lit("d").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    step = cut(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("p")))
    start = seeds.select(F.lit("t").alias("kind"), "host", F.col("trusted").alias("w")).unionByName(seeds.select(F.lit("d").alias("kind"), "host", F.col("blocked").alias("w"))).where("w > 0")
    start = cut(start.select("kind", "host", (F.col("w") * (1 - damping)).alias("w")))
    rank = start
    for k in range(rounds):
        flow = step.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("w") * F.col("p") * damping).alias("w"))
        rank = flow.unionByName(start).groupBy("kind", "host").agg(F.sum("w").alias("w"))
        # the plan stays short, however many rounds there are
        if k % 5 == 4:
            rank = cut(rank)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("w"))), F.lit(0.0))
    return rank.groupBy("host").agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, spam (distrust as a share of both)."""
    judged = judged_pages(pages, rules)
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    ranks = propagate(host_edges(pages), seeds)
    spam = ranks.select("host", F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 9).alias("spam"))
    # a written table on this side, so that a host with very many pages can be split
    spam = cut(spam.where(F.col("spam") > 0)).hint("merge")
    own = F.when(F.coalesce("spam", F.lit(0.0)) > limit, "block").otherwise("allow")
    return judged.join(spam, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.coalesce("spam", F.lit(0.0)).alias("spam"))


def sql() -> str:
    """The same in SQL, its rounds written out."""
    name, verdict = "null::varchar", "null::varchar"
    for what, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
        name = f"case when {fits} then '{h}{p}' else {name} end"
        verdict = f"case when {fits} then '{what}' else {verdict} end"
    rounds = ""
    for k in range(ROUNDS):
        rounds += f""",
r{k + 1} as (select kind, host, sum(w) w from (
  select s.kind, s.dst host, r.w * s.p * {DAMPING} w from step s join r{k} r on s.kind = r.kind and s.src = r.host
  union all select kind, host, w from r0) group by all)"""
    return f"""
with u as (select page_id, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end x from pages),
b as (select page_id, html, coalesce(translate(regexp_extract(x, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') host,
  coalesce(regexp_extract(x, '^[^/?#]*([^?#]*)', 1), '') path from u),
j as (select page_id, html, host, path, {name} rule, {verdict} ruled from b),
seeds as (select host, avg(case when ruled = 'allow' then 1.0::double else 0 end) trusted, avg(case when ruled = 'block' then 1.0::double else 0 end) blocked
  from j where host <> '' group by host),
links as (select host src, translate(unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)), '{UPPER}', '{LOWER}') dst from b where host <> ''),
parts as (select distinct host, string_split(host, '.') l from b where host <> ''),
up as (select distinct array_to_string(l[k:], '.') a, array_to_string(l[k + 1:], '.') b
  from (select l, unnest(range(1, greatest(len(l) - 1, 1))) k from parts)),
edges as (select src, dst, sum(n)::double n from (
  select src, dst, count(*) n from links where src <> dst group by all
  union all select a, b, 1 from up union all select b, a, 1 from up) group by all),
ways as (select 't' kind, src, dst, n from edges union all select 'd', dst, src, n from edges),
step as (select kind, src, dst, n / sum(n) over (partition by kind, src) p from ways),
r0 as (select kind, host, w * {1 - DAMPING} w from (
  select 't' kind, host, trusted w from seeds union all select 'd', host, blocked from seeds) where w > 0){rounds},
ranks as (select host, coalesce(sum(w) filter (kind = 't'), 0) trust, coalesce(sum(w) filter (kind = 'd'), 0) distrust from r{ROUNDS} group by host),
spam as (select host, round(distrust / (trust + distrust), 9) spam from ranks)
select page_id, j.host, path, rule, coalesce(ruled, case when coalesce(spam, 0) > {LIMIT} then 'block' else 'allow' end) verdict, coalesce(spam, 0)::double spam
from j left join spam on j.host = spam.host
"""
