"""Operator 9, URL filters: fixed host and path rules first, then empirical-Bayes reputation of the host.

Each labelled page is an outcome (bad if toxic or of low quality). Labels name a ``doc_id``, which is taken for the
page_id of the page that the document was made from: the tables have one space of ids. A host's rate of bad pages is
shrunk to that of its registered domain, the domain's to that of its suffix, the suffix's to the rate of all: at every
level the prior is a beta distribution with the parent's posterior mean and a strength taken from the spread of the
groups of that level (the one-way ANOVA estimate of the intraclass correlation). A page is blocked if its host's rate
exceeds ``times`` the labelled rate of all (0.95 at most) with a posterior probability of ``sure``, that is, if the
lower quantile of the host's beta posterior lies above that bound. The quantile is integrated over ``CELLS`` cells
within nine standard deviations of the mean.

The suffix is the last label of the host without its port, or the last two where a country's two letters follow one of
``SECOND`` (co.uk, com.br); the registered domain is the suffix and one label more. Hosts of digits and dots are domains
of their own, with an empty suffix.

All of it is DataFrame code. Null URLs and those without ``://`` have an empty host and path and count as one host; URLs
are read whole, however long. Labels that are null are left out; a page labelled twice counts once, as bad if any is.
No labels: everything is allowed. Every row comes back, repeated rows too, each counting as a page; of rules of equal
length the first in the alphabet wins. Extra columns are ignored; an empty table gives an empty result.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiffra.llm._common import documents, join_groups, stored

#: (rule, verdict): the query's contract.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Labels that stand for a kind of holder under a country's domain.
SECOND = "ac co com edu go gob gouv gov gv id ltd me mil mod ne net nhs nic nom or org plc police sch web".split()
#: Cells of the integral over a posterior, and the standard deviations that they span on either side of the mean.
CELLS, SPAN = 256, 9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise(F.lit(""))
    rest = F.substring_index(F.coalesce(rest, F.lit("")), "?", 1)
    slash = F.instr(rest, "/")
    host = F.when(slash > 0, F.substr(rest, F.lit(1), slash - 1)).otherwise(rest)
    path = F.when(slash > 0, F.substr(rest, slash)).otherwise(F.lit(""))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict); null where none does."""
    name, verdict = None, None
    for rule, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        name = name.when(fits, rule) if name is not None else F.when(fits, rule)
        verdict = verdict.when(fits, what) if verdict is not None else F.when(fits, what)
    return name, verdict


def _strength(groups: DataFrame) -> float:
    """Prior strength from groups (n, k): (1 - rho) / rho with the ANOVA estimate of rho, between 1 and 1000."""
    g = groups.where("n > 0").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if g["g"] < 2 or g["n"] <= g["g"]:
        return 10.0
    between = (g["kk"] - g["k"] * g["k"] / g["n"]) / (g["g"] - 1)
    within = (g["k"] - g["kk"]) / (g["n"] - g["g"])
    n0 = (g["n"] - g["nn"] / g["n"]) / (g["g"] - 1)
    den = between + (n0 - 1) * within
    rho = (between - within) / den if den > 0 else 0.0
    rho = min(0.5, max(0.001, rho))
    return round((1 - rho) / rho, 9)


def domain_of(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host"""
    bare = F.substring_index(host, ":", 1)
    labels = F.split(bare, r"\.")
    two = (F.size(labels) >= 2) & F.element_at(labels, -1).rlike("^[a-z]{2}$") & F.try_element_at(labels, F.lit(-2)).isin(*SECOND)
    number = bare.rlike(r"^[0-9.]+$")
    suffix = F.when(number, "").when(two, F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    return F.when(number, bare).when(two, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2)), suffix


def lower_quantile(a: Column, b: Column, q: float) -> Column:
    """The quantile ``q`` of a beta distribution, by the midpoint rule."""
    mean = a / (a + b)
    sd = F.sqrt(mean * (1 - mean) / (a + b + 1))
    lo, hi = F.greatest(mean - SPAN * sd, F.lit(0.0)), F.least(mean + SPAN * sd, F.lit(1.0))
    step = (hi - lo) / CELLS
    density = lambda x: F.exp((a - 1) * F.ln(x / mean) + (b - 1) * F.ln((1 - x) / (1 - mean)))
    cells = F.sequence(F.lit(0), F.lit(CELLS - 1))
    w = F.transform(cells, lambda i: density(lo + step * (i + 0.5)))

    def read(w: Column) -> Column:
        goal = q * F.aggregate(w, F.lit(0.0), lambda s, x: s + x)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("at"))
        end = F.aggregate(w, start, lambda s, x: F.struct((s["sum"] + x).alias("sum"), (s["at"] + F.when(s["sum"] >= goal, 0.0).when(s["sum"] + x >= goal, (goal - s["sum"]) / x).otherwise(1.0)).alias("at")))
        return lo + step * end["at"]

    return F.element_at(F.transform(F.array(w), read), 1)  # binds the weights once


def reputations(pages: DataFrame, labels: DataFrame, sure: float = 0.95) -> tuple[DataFrame, float]:
    """((host, pages, n, k, risk, risk_low) of every host of ``pages`` (page_id, host); the labelled rate of all)"""
    marks = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).otherwise(0)).alias("bad"))
    hosts = pages.join(marks, "page_id", "left").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    domain, suffix = domain_of(F.col("host"))
    hosts = stored(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("hosts")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("domains"))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"), F.sum("domains").alias("domains")).first()
    rate = (total["k"] + 1) / (total["n"] + 2)
    mh, md, ms = _strength(hosts), _strength(domains), _strength(suffixes)
    mean = lambda m, prior: (F.col("k") + m * prior) / (F.col("n") + m)
    s = suffixes.select("suffix", "domains", mean(ms, F.lit(rate)).alias("suffix_risk"))
    # A suffix with a third of all domains, or a domain with a third of all hosts, is spread by these joins.
    d = join_groups(domains, s, ["suffix"], "domains", total["domains"] or 0).select("domain", "hosts", mean(md, F.col("suffix_risk")).alias("domain_risk"))
    out = join_groups(hosts.drop("suffix"), d, ["domain"], "hosts", hosts.count()).withColumn("risk", mean(mh, F.col("domain_risk")))
    low = lower_quantile(F.col("k") + mh * F.col("domain_risk"), F.col("n") - F.col("k") + mh * (1 - F.col("domain_risk")), 1 - sure)
    return out.select("host", "pages", "n", "k", "risk", low.alias("risk_low")), rate


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, times: float = 2.0, sure: float = 0.95) -> DataFrame:
    """page_id, host, path, rule, verdict, risk_low of every row of ``pages`` (page_id, url)."""
    host, path = split_url(F.col("url"))
    cut = stored(pages.select("page_id", host.alias("host"), path.alias("path")), "urls")
    hosts, rate = reputations(cut, labels, sure)
    hosts = stored(hosts, "reputations")
    total = hosts.agg(F.coalesce(F.sum("pages"), F.lit(0))).first()[0]
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = join_groups(cut, hosts, ["host"], "pages", total)
    own = F.when(F.round("risk_low", 9) > min(0.95, times * rate), "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "risk_low")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(documents(spark, sf_dir, "pages").select("page_id", "url"), documents(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    cases = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    fits = []
    for rule, _ in cases:
        h, _, p = rule.partition("/")
        fits.append(f"(host = '{h}' or host like '%.{h}') and starts_with(path, '/{p}')")
    name = " ".join(f"when {f} then '{r}'" for f, (r, _) in zip(fits, cases, strict=True))
    what = " ".join(f"when rule = '{r}' then '{v}'" for r, v in cases)
    strength = lambda t: f"""(select case when g < 2 or n <= g then 10.0 else
      round((1 - rho) / rho, 9) end from (select *, least(0.5, greatest(0.001, case when b + (n0 - 1) * w > 0 then (b - w) / (b + (n0 - 1) * w) else 0 end)) rho
      from (select g, n, (kk - k * k / n) / nullif(g - 1, 0) b, (k - kk) / nullif(n - g, 0) w, (n - nn / n) / nullif(g - 1, 0) n0
      from (select count(*)::double g, sum(n)::double n, sum(k)::double k, sum(n * n)::double nn, sum(k * k / n::double) kk from {t} where n > 0))))"""  # noqa: E731
    return f"""
with cut0 as (select page_id, case when instr(url, '://') > 0 then split_part(split_part(substr(url, instr(url, '://') + 3), '#', 1), '?', 1) else '' end rest from pages),
cut as (select page_id, translate(case when instr(rest, '/') > 0 then substr(rest, 1, instr(rest, '/') - 1) else rest end, '{UPPER}', '{LOWER}') host,
  case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end path from (select page_id, coalesce(rest, '') rest from cut0)),
marks as (select doc_id page_id, max(case when toxic = 1 or quality = 0 then 1 else 0 end) bad from labels where doc_id is not null and (toxic is not null or quality is not null) group by 1),
hosts0 as (select host, count(bad) n, coalesce(sum(bad), 0) k, split_part(host, ':', 1) bare from cut left join marks using (page_id) group by host),
hosts1 as (select *, string_split(bare, '.') ls, regexp_matches(bare, '^[0-9.]+$') ip from hosts0),
hosts2 as (select *, case when ip then 0 when len(ls) >= 2 and regexp_matches(ls[-1], '^[a-z]{{2}}$') and ls[-2] in ({", ".join(f"'{x}'" for x in SECOND)}) then 2 else 1 end suf from hosts1),
hosts as (select *, case when ip then bare else array_to_string(list_slice(ls, -suf - 1, -1), '.') end as "domain", case when ip then '' else array_to_string(list_slice(ls, -suf, -1), '.') end suffix from hosts2),
domains as (select "domain", suffix, sum(n) n, sum(k) k from hosts group by 1, 2),
suffixes as (select suffix, sum(n) n, sum(k) k from domains group by 1),
m as (select {strength("hosts")} mh, {strength("domains")} md, {strength("suffixes")} ms, (select (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2)::double from suffixes) rate),
s as (select suffix, (k + ms * rate) / (n + ms) sr from suffixes, m),
d as (select domain, (k + md * sr) / (n + md) dr from domains join s using (suffix), m),
h as (select host, k + mh * dr a, n - k + mh * (1 - dr) b, rate from hosts join d using (domain), m),
h1 as (select *, a / (a + b) mean, sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) sd from h),
h2 as (select *, greatest(mean - {SPAN} * sd, 0.0) lo, (least(mean + {SPAN} * sd, 1.0) - greatest(mean - {SPAN} * sd, 0.0)) / {CELLS} step from h1),
g as (select *, exp((a - 1) * ln((lo + step * (i + 0.5)) / mean) + (b - 1) * ln((1 - lo - step * (i + 0.5)) / (1 - mean))) w from h2, range({CELLS}) t(i)),
c as (select *, sum(w) over (partition by host order by i) run, 0.05 * sum(w) over (partition by host) goal from g),
r as (select host, any_value(rate) rate, arg_min(lo + step * (i + (goal - run + w) / w), i) low from c where run >= goal group by host),
j as (select page_id, host, path, case {name} end as rule, low, rate from cut join r using (host))
select page_id, host, path, rule, coalesce(case {what} end, case when round(low, 9) > least(0.95, 2.0 * rate) then 'block' else 'allow' end) verdict from j"""


SQL = {"op9_url_filter": _sql()}
