"""URL verdicts from rules and, where none fits, from the reputation of the host.

Reputation is empirical Bayes.  A labelled page came out bad or good.  The share of bad pages of a suffix is shrunk towards that of the
whole table, a registered domain's towards its suffix, a host's towards its domain: each level's shares follow a beta distribution
around the level above, whose strength is fitted by moments to how far the level's counts scatter beyond chance, and the posterior of
each is beta again.  A host is blocked when even the lower bound of its posterior is above ``LIMIT``: a few bad pages of an otherwise
unknown host move its bound little, hundreds move it up to its own share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skyledger.llm.common import lower_ascii
from skyledger.session import materialise

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of two labels under which names are registered, besides all of one label.
SECOND_LEVEL = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "co.kr", "co.nz", "co.za")
#: Share of bad pages that a host's lower bound must exceed, and the number of standard deviations from posterior mean to bound (95 %, one-sided).
LIMIT = 0.25
DEVIATIONS = 1.645
#: Least and largest strength of a prior, in pages.
STRENGTH = (10.0, 1000.0)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: from there up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    split = lambda group: F.coalesce(F.regexp_extract(rest, "^([^/?#]*)([^?#]*)", group), F.lit(""))
    return lower_ascii(split(1)), split(2)


def names(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host; an address is its own domain under the empty suffix."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", ""), "\\.+$", "")
    parts = F.split(bare, "\\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - (n - 1)), n), ".")
    address = bare.rlike("^[0-9]+(\\.[0-9]+){3}$") | bare.startswith("[")
    two = last(F.lit(2)).isin(*SECOND_LEVEL)
    domain = F.when(address, bare).when(two, last(F.lit(3))).otherwise(last(F.lit(2)))
    suffix = F.when(address, "").when(two, last(F.lit(2))).otherwise(last(F.lit(1)))
    return domain, suffix


def _shrunk(groups: DataFrame, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """``groups`` (n, bad, prior) with share and strength of their beta posteriors.

    The strength s of the common prior comes from moments: sum (bad - n prior)^2 / n - prior (1 - prior) is expected to be
    sum (n - 1) prior (1 - prior) / (s + 1).  A level that shows no scatter to measure gets the largest strength.
    """
    spread = F.col("prior") * (1 - F.col("prior"))
    over = F.sum(F.pow(F.col("bad") - F.col("n") * F.col("prior"), F.lit(2)) / F.col("n") - spread)
    over, room = groups.filter("n > 0").agg(over, F.sum((F.col("n") - 1) * spread)).first()
    least, most = strength
    s = most if not room or not over or over <= 0 else min(most, max(least, room / over - 1))
    return groups.withColumns({"share": (F.col("bad") + F.lit(s) * F.col("prior")) / (F.col("n") + s), "strength": F.col("n") + s})


def reputation(pages: DataFrame, outcomes: DataFrame, deviations: float = DEVIATIONS, strength: tuple[float, float] = STRENGTH) -> DataFrame:
    """host, n, bad, share, bound per host of ``pages`` (page_id, host); ``outcomes`` has (page_id, bad 0 or 1), each page_id once.

    n, bad: labelled pages and bad ones; share, bound: posterior mean and its lower bound in the normal form.  Without any labelled
    page share and bound are 0.
    """
    counted = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = names(F.col("host"))
    hosts = materialise(counted.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    total = hosts.agg(F.sum("bad"), F.sum("n")).first()
    whole = total[0] / total[1] if total[1] else 0.0
    sums = [F.sum(c).alias(c) for c in ("n", "bad")]
    suffixes = _shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("prior", F.lit(whole)), strength)
    domains = hosts.groupBy("domain", "suffix").agg(*sums).join(suffixes.select("suffix", F.col("share").alias("prior")), "suffix")
    domains = _shrunk(domains, strength)
    out = hosts.join(domains.select("domain", "suffix", F.col("share").alias("prior")), ["domain", "suffix"])
    out = _shrunk(out, strength)
    bound = F.col("share") - deviations * F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("strength") + 1))
    return materialise(out.select("host", "n", "bad", "share", F.greatest(F.lit(0.0), bound).alias("bound")), "reputation")


def rule_table(spark, rules=RULES) -> DataFrame:
    rows = [F.struct(*[F.lit(v).alias(c) for v, c in zip(rule, ("verdict", "host", "path"))]) for rule in rules]
    shape = "array<struct<verdict: string, host: string, path: string>>"
    return spark.range(1).select(F.inline(F.array(*rows).cast(shape)))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, ruled for those of the distinct ``urls`` (host, path) that a rule (verdict, host, path) fits.

    A rule fits its host and all subdomains if the path starts with the rule's.  The longest rule wins, at equal length that of the
    longer host, and of equal rules the block.  No url is held against each rule: endings of hosts, as many as rules have labels, meet
    rule hosts by equality, and starts of paths, of the lengths these hosts' rules have, meet rule paths by equality.
    """
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block is after allow
    lengths = rules.groupBy(F.col("host").alias("ending")).agg(F.collect_set(F.char_length("path")).alias("lengths"))
    labels = rules.agg(F.max(F.size(F.split("host", "\\.")))).first()[0] or 0
    parts = F.split("host", "\\.")
    endings = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(max(1, labels)))), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    near = urls.select("host").distinct().withColumn("ending", F.explode(endings)).join(lengths, "ending")
    starts = urls.join(near, "host").withColumn("length", F.explode("lengths")).filter(F.char_length("path") >= F.col("length"))
    starts = starts.withColumn("start", F.substr("path", F.lit(1), F.col("length")))
    on = (F.col("u.ending") == F.col("r.host")) & (F.col("u.start") == F.col("r.path"))
    fits = starts.alias("u").join(rules.alias("r"), on)
    rule = F.concat("r.host", "r.path")
    best = F.max(F.struct(F.char_length(rule).alias("size"), F.char_length("r.host").alias("own"), rule.alias("rule"), F.col("r.verdict").alias("ruled")))
    return fits.groupBy("u.host", "u.path").agg(best.alias("best")).select("host", "path", "best.rule", "best.ruled")


def judge(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, limit: float = LIMIT, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of ``pages`` (page_id, url; other columns ignored).

    The verdict is that of the rule that fits (:func:`match_rules`), else ``block`` if the lower bound of the host's share of bad pages is
    above ``limit``, else ``allow``.  bound: that lower bound, to 6 places.

    A url that is null or without ``://`` has an empty host and path; all these share one reputation.  A null page_id has no outcome.
    Repeated pages each count and each get their row.  Without rules or outcomes everything not ruled out is allowed.  An empty table
    gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    rows = materialise(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    known = reputation(rows.select("page_id", "host"), outcomes, **how)
    ruled = match_rules(rows.select("host", "path").distinct(), rules)
    out = rows.join(ruled, ["host", "path"], "left").join(known.select("host", "bound"), "host")
    own = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), F.round("bound", 6).alias("bound"))


def label_outcomes(labels: DataFrame) -> DataFrame:
    """page_id, bad from labels (doc_id, quality, toxic): bad is toxic or of no quality; of several labels of a page the worst counts."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))


def _posterior(level: str, groups: str) -> str:
    s = f"""{level}_s AS (SELECT CASE WHEN over_ IS NULL OR over_ <= 0 OR room = 0 THEN {STRENGTH[1]} ELSE least({STRENGTH[1]}, greatest({STRENGTH[0]}, room / over_ - 1)) END AS s
  FROM (SELECT sum(pow(bad - n * prior, 2) / n - prior * (1 - prior)) AS over_, sum((n - 1) * prior * (1 - prior)) AS room FROM {groups} WHERE n > 0))"""
    return s + f""",
{level} AS (SELECT *, (bad + s * prior) / (n + s) AS share, n + s AS strength FROM {groups}, {level}_s)"""


SQL = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
rules AS (SELECT * FROM (VALUES {", ".join(map(repr, RULES))}) r(verdict, host, path)),
fits AS (
  SELECT u.host, u.path, r.host || r.path AS rule, r.verdict FROM (SELECT DISTINCT host, path FROM split) u
  JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY u.host, u.path ORDER BY length(r.host || r.path) DESC) = 1),
outcomes AS (
  SELECT doc_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels
  WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
bare AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS b
  FROM split LEFT JOIN outcomes ON doc_id = page_id GROUP BY host),
parts AS (
  SELECT *, string_split(b, '.') AS p, regexp_matches(b, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(b, '[') AS address FROM bare),
counted AS (
  SELECT *, CASE WHEN array_to_string(p[-2:], '.') IN ({", ".join(map(repr, SECOND_LEVEL))}) THEN 2 ELSE 1 END AS k FROM parts),
hosts AS (
  SELECT host, n, bad, CASE WHEN address THEN b WHEN k = 2 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
    CASE WHEN address THEN '' WHEN k = 2 THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM counted),
by_suffix AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) FROM hosts) AS prior FROM hosts GROUP BY suffix),
{_posterior("suffixes", "by_suffix")},
by_domain AS (
  SELECT h.domain, h.suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(s.share) AS prior FROM hosts h JOIN suffixes s ON s.suffix = h.suffix GROUP BY h.domain, h.suffix),
{_posterior("domains", "by_domain")},
by_host AS (SELECT h.host, h.n, h.bad, d.share AS prior FROM hosts h JOIN domains d ON d.domain = h.domain AND d.suffix = h.suffix),
{_posterior("posteriors", "by_host")},
bounds AS (SELECT host, greatest(0, share - {DEVIATIONS} * sqrt(share * (1 - share) / (strength + 1))) AS bound FROM posteriors)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.verdict, CASE WHEN b.bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(b.bound, 6) AS bound
FROM split s JOIN bounds b ON b.host = s.host LEFT JOIN fits f ON f.host = s.host AND f.path = s.path
"""
