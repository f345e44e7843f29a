"""URL filter: allow and block rules first, then empirical-Bayes host reputation.

Reputation of a host is the posterior of its share of good pages. Labelled outcomes
are shrunk level by level: the prior of a suffix is the mean of all others, the prior of
a registered domain the posterior mean of its suffix, the prior of a host that of its
domain, each without the outcomes of the group itself, so that none counts twice. How strongly each level holds on to its prior is estimated from the labelled
outcomes by the method of moments of the beta-binomial distribution. A suffix is the last
label, a general second label below a country (``co.uk``), or one of a stated list of suffixes
below which anyone may register (``github.io``); a registered domain has one label more. Logins,
ports and closing dots of a host count for neither; an address is its own domain, and all
addresses share one suffix. A host is blocked when even the upper bound of its posterior is below the wanted share, so a
host of which little is known stays. Only DataFrame functions are used.

Defined results: a null url, or one without ``://``, has an empty host and path and is
judged as host ''; labels that are null or belong to no page are left out; without any
label every page is allowed; repeated pages give repeated rows; an empty table gives an
empty table; columns named like the added ones are replaced, all others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from faultspark.functions.iterate import cut_lineage
from faultspark.plans.registry import R

#: (verdict, rule); a rule is a host and a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Pages of a host with a good share below this are not wanted.
WANTED = 0.5
#: Standard deviations of the posterior between its mean and its bound.
BOUND = 1.96
#: Bad outcomes, beside one good, that an empty corpus counts as seen.
UNSEEN_BAD = 0.25
#: Correlation inside a group is held between these; strength of a prior over fewer than two groups.
LEAST_RHO, MOST_RHO, FEW = 1e-4, 0.95, 2.0
#: Second labels that are general below a two-letter country, and longer suffixes open to everyone.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gouv", "gov", "gv", "mil", "ne", "net", "nom", "or", "org", "sch")
SUFFIXES = ("appspot.com", "blogspot.com", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev", "vercel.app", "web.app", "wordpress.com")
ADDRESS = "#address"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty without ``://``."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(__url, locate('://', __url) + 3)")).otherwise("")
    bare = F.regexp_extract(rest, r"^([^?#]*)", 1)
    host = F.regexp_extract(bare, r"^([^/]*)", 1)
    return F.translate(host, UPPER, LOWER), F.substring(bare, F.length(host) + 1, F.length(bare))


def host_levels(host: Column, suffixes: tuple[str, ...] = SUFFIXES, second: tuple[str, ...] = SECOND) -> Column:
    """Registered domain and suffix of a host, as a struct; a host that is a suffix itself is its own domain.

    Each step is a lambda over an array of one value, so that no step's text is repeated in the next.
    """
    bare = F.regexp_replace(F.regexp_replace(F.substring_index(host, "@", -1), r":[0-9]*\z", ""), r"\.+\z", "")

    def counted(b: Column) -> Column:
        label = F.split(b, r"\.")
        listed = F.array_max(F.transform(F.filter(F.array(*map(F.lit, suffixes)).cast("array<string>"), lambda s: b.endswith(F.concat(F.lit("."), s))), lambda s: F.size(F.split(s, r"\."))))
        general = (F.length(F.element_at(label, -1)) == 2) & F.coalesce(F.try_element_at(label, F.lit(-2)).isin(*second), F.lit(False)) & (F.size(label) > 2)
        address = b.rlike(r"^[0-9]+(\.[0-9]+){3}\z") | b.startswith("[")
        return F.struct(b.alias("bare"), label.alias("label"), F.coalesce(listed, F.when(general, 2).otherwise(1)).alias("k"), address.alias("address"))

    def levels(c: Column) -> Column:
        def last(k: Column) -> Column:
            return F.concat_ws(".", F.slice(c["label"], F.greatest(F.size(c["label"]) - k + 1, F.lit(1)), k))

        return F.struct(F.when(c["address"], c["bare"]).otherwise(last(c["k"] + 1)).alias("domain"), F.when(c["address"], ADDRESS).otherwise(last(c["k"])).alias("suffix"))

    return F.transform(F.transform(F.array(bare), counted), levels)[0]


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (verdict, rule); null if none does.

    The rules are a short stated policy and become one CASE expression, longest first.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        then = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out


def _strength(groups: DataFrame) -> float:
    """How many outcomes the prior of a level is worth, from groups with n, good and prior.

    Under the beta-binomial the expected sum of n * (good / n - prior)^2 is that of
    prior * (1 - prior) * (1 + (n - 1) / (strength + 1)).
    """
    p = F.col("prior") * (1 - F.col("prior"))
    gap = F.col("good") / F.col("n") - F.col("prior")
    spread, noise, both, k = groups.agg(F.sum(F.col("n") * gap * gap), F.sum(p), F.sum(F.col("n") * p), F.count(F.lit(1))).first()
    if k < 2 or not both:
        return FEW
    rho = min(max((spread - noise) / max(both - noise, 1e-9), LEAST_RHO), MOST_RHO)
    return 1.0 / rho - 1.0


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, good, mean, low, high) for every host of ``pages``.

    ``pages`` has page_id and host; ``outcomes`` has page_id and good (1, 0).
    """
    o = outcomes.filter("good IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("good").alias("good"))
    counted = pages.select("page_id", "host").join(o, "page_id", "left")
    hosts = counted.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("double").alias("good"))
    hosts = cut_lineage(hosts.select("*", F.inline(F.array(host_levels(F.col("host"), suffixes)))))
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()

    def rest(parent: str, strength: Column) -> Column:
        """Posterior mean of the parent from all outcomes but the group's own."""
        return (F.col(f"{parent}_good") - F.col("good") + strength * F.col(f"{parent}_prior")) / (F.col(f"{parent}_n") - F.col("n") + strength)

    def under(groups: DataFrame, parents: DataFrame, key: str) -> DataFrame:
        s = _strength(parents.filter("n > 0"))
        p = parents.select(key, *[F.col(c).alias(f"{key}_{c}") for c in ("n", "good", "prior")])
        return groups.join(p, key).withColumn("prior", rest(key, F.lit(s)))

    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumn("prior", (F.lit(float(good or 0)) - F.col("good") + 1) / (F.lit(float(n or 0)) - F.col("n") + 1 + UNSEEN_BAD))
    domains = under(hosts.groupBy("domain", "suffix").agg(*sums), suffixes, "suffix")
    ranked = under(hosts, domains.select("domain", "n", "good", "prior"), "domain")
    s = _strength(ranked.filter("n > 0"))
    a, b = F.col("good") + F.lit(s) * F.col("prior"), F.col("n") - F.col("good") + F.lit(s) * (1 - F.col("prior"))
    out = ranked.select("host", "domain", "suffix", "n", "good", a.alias("a"), b.alias("b"))
    both = F.col("a") + F.col("b")
    sd = F.sqrt(F.col("a") * F.col("b") / (both * both * (both + 1)))
    m = F.col("a") / both
    return out.select("host", "domain", "suffix", "n", "good", m.alias("mean"), F.greatest(m - BOUND * sd, F.lit(0.0)).alias("low"), F.least(m + BOUND * sd, F.lit(1.0)).alias("high"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]] = RULES, wanted: float = WANTED, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """Adds host, path, rule, verdict, reputation and reputation_high to the pages."""
    new = ["host", "path", "rule", "verdict", "reputation", "reputation_high"]
    host, path = url_parts(F.col("__url"))
    p = pages.drop(*new).withColumn("__url", F.col("url"))
    p = p.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit(""))).drop("__url")
    rank = host_reputation(p, outcomes, suffixes).select(F.col("host").alias("__host"), F.col("mean").alias("reputation"), F.col("high").alias("reputation_high"))
    j = p.join(rank, p["host"] == rank["__host"], "left").withColumn("__m", match_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("reputation_high") < F.lit(float(wanted)), F.lit("block")).otherwise(F.lit("allow"))
    return j.withColumn("rule", F.col("__m.rule")).withColumn("verdict", F.coalesce(F.col("__m.verdict"), by_method)).select(*[c for c in pages.columns if c not in new], *new)


def _sql_level(name: str, source: str) -> str:
    return f"""{name}_s AS (SELECT CASE WHEN count(*) < 2 OR sum(n * prior * (1 - prior)) IS NULL OR sum(n * prior * (1 - prior)) = 0 THEN {FEW}
    ELSE 1.0 / least(greatest((sum(n * (good / n - prior) ** 2) - sum(prior * (1 - prior))) / greatest(sum(n * prior * (1 - prior)) - sum(prior * (1 - prior)), 1e-9), {LEAST_RHO}), {MOST_RHO}) - 1.0 END AS s
    FROM {source} WHERE n > 0)"""


#: Pages of the test tables; a page's outcome is the quality label of the document with its number.
SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^([^?#]*)', 1) ELSE '' END AS bare FROM pages),
p AS (SELECT page_id, translate(regexp_extract(bare, '^([^/]*)', 1), '{UPPER}', '{LOWER}') AS host, substr(bare, length(regexp_extract(bare, '^([^/]*)', 1)) + 1) AS path FROM u),
o AS (SELECT doc_id AS page_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, count(good) AS n, coalesce(sum(good), 0)::DOUBLE AS good, regexp_replace(regexp_replace(string_split(host, '@')[-1], ':[0-9]*\\z', ''), '[.]+\\z', '') AS bare FROM p LEFT JOIN o USING (page_id) GROUP BY host),
m AS (SELECT *, string_split(bare, '.') AS l, CASE {" ".join(f"WHEN ends_with(bare, '.{s}') THEN {s.count('.') + 1}" for s in sorted(SUFFIXES, key=lambda s: (-s.count('.'), s)))}
  WHEN length(string_split(bare, '.')[-1]) = 2 AND string_split(bare, '.')[-2] IN {SECOND} AND len(string_split(bare, '.')) > 2 THEN 2 ELSE 1 END AS k,
  regexp_matches(bare, '^[0-9]+([.][0-9]+){{3}}\\z') OR starts_with(bare, '[') AS address FROM h),
hosts AS (SELECT host, n, good, CASE WHEN address THEN '{ADDRESS}' ELSE array_to_string(l[greatest(len(l) - k + 1, 1):], '.') END AS suffix,
  CASE WHEN address THEN bare ELSE array_to_string(l[greatest(len(l) - k, 1):], '.') END AS domain FROM m),
suf AS (SELECT suffix, sum(n) AS n, sum(good) AS good, ((SELECT sum(good) FROM hosts) - sum(good) + 1) / ((SELECT sum(n) FROM hosts) - sum(n) + 1 + {UNSEEN_BAD}) AS prior FROM hosts GROUP BY suffix),
{_sql_level("suf", "suf")},
dom AS (SELECT d.domain, d.n, d.good, (s.good - d.good + x.s * s.prior) / (s.n - d.n + x.s) AS prior
        FROM (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL) d JOIN suf s USING (suffix), suf_s x),
{_sql_level("dom", "dom")},
ranked AS (SELECT h.host, h.n, h.good, (d.good - h.good + x.s * d.prior) / (d.n - h.n + x.s) AS prior FROM hosts h JOIN dom d USING (domain), dom_s x),
{_sql_level("ranked", "ranked")},
post AS (SELECT host, good + s * prior AS a, n - good + s * (1 - prior) AS b FROM ranked, ranked_s),
bound AS (SELECT host, a / (a + b) AS mean, least(a / (a + b) + {BOUND} * sqrt(a * b / ((a + b) ** 2 * (a + b + 1))), 1.0) AS high FROM post),
rules(verdict, rule, rh, rp) AS (VALUES {", ".join(f"('{v}', '{r}', '{r[: r.index('/')]}', '{r[r.index('/'):]}')" for v, r in RULES)}),
fits AS (SELECT page_id, host, path, arg_max(verdict, length(rule)) AS v, arg_max(rule, length(rule)) AS rule FROM (SELECT DISTINCT page_id, host, path FROM p) q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.v, CASE WHEN b.high < {WANTED} THEN 'block' ELSE 'allow' END) AS verdict, {R("b.mean")} AS reputation, {R("b.high")} AS reputation_high
FROM p LEFT JOIN fits f ON p.page_id IS NOT DISTINCT FROM f.page_id AND p.host = f.host AND p.path = f.path JOIN bound b ON p.host = b.host
"""
