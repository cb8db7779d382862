"""Screening of observed URLs against the threat table, and grouping of threats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hooktrace.functions.scoring import HOSTING_PLATFORMS
from hooktrace.functions.urls import base_domain, url_host
from hooktrace.operators.graph import connected_components
from hooktrace.operators.presence import key_bits, may_hold, word_of
from hooktrace.operators.skew import balanced_left_join
from hooktrace.sinks.shared import staged

# Match levels from the closest to the widest.
LEVELS = ("url", "domain", "base_domain")

# The size of a key filter, and so the bound of what is broadcast: this many words for each level.
FILTER_WORDS = 1 << 18


def site(domain: Column) -> Column:
    """The widest name that still means one owner.

    An IP address is itself. On a hosting platform every customer has a name of their own, so the
    platform counts as a public suffix. Else the registrable domain.
    """
    is_address = domain.rlike(r"^[0-9.]+$") | F.contains(domain, F.lit(":"))
    owner = F.when(is_address, domain)
    for platform in HOSTING_PLATFORMS:
        owner = owner.when(domain.endswith(platform), F.substring_index(domain, ".", -platform.count(".") - 1))
    return owner.otherwise(base_domain(domain))


def _with_keys(rows: DataFrame) -> DataFrame:
    if "domain" not in rows.columns:
        rows = rows.withColumn("domain", url_host(F.col("url")))
    return rows.withColumn("base_domain", site(F.col("domain")))


def screen_urls(observed: DataFrame, threats: DataFrame) -> DataFrame:
    """Observed URLs with the closest match level (NULL for none) and the highest score there.

    Threats are cut down to one score per key first, so a join never pairs many threats with many
    observations. A filter of the keys of each level tells most observations without any match where
    they are read; only the others are shuffled: distinct URLs are matched, and the matches joined
    back once. Adaptive execution splits a hot URL, as they are the left side of a left join.
    """
    best = best_scores(threats)
    best_of = lambda level: best.where(F.col("__level") == level).select(
        F.col("__named").alias(level), F.col("__best").alias(f"__{level}")
    )
    passed = may_match(observed, best)
    hit = passed.where("__may_match").drop("__may_match")
    has_domain = "domain" in observed.columns
    keys = ["url", "domain"] if has_domain else ["url"]
    matched = _with_keys(hit.select(*keys).distinct())
    for level in LEVELS:
        matched = matched.join(best_of(level), level, "left")
    found = [F.col(f"__{level}") for level in LEVELS]
    level = F.lit(None).cast("string")
    for name, score in reversed(list(zip(LEVELS, found))):
        level = F.when(score.isNotNull(), name).otherwise(level)
    matched = matched.where(F.coalesce(*found).isNotNull()).select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], level.alias("match_level"), F.coalesce(*found).alias("match_score")
    )
    same = F.col("url") == F.col("__k_url")
    if has_domain:
        same = same & F.col("domain").eqNullSafe(F.col("__k_domain"))
    screened = hit.join(matched, same, "left").drop(*[f"__k_{k}" for k in keys])
    return screened.unionByName(passed.where(~F.col("__may_match")).drop("__may_match"), allowMissingColumns=True)


def best_scores(threats: DataFrame) -> DataFrame:
    """The highest score of every URL, domain and site of the threats: ``__level``, ``__named``, ``__best``."""
    known = _with_keys(threats)
    row = lambda level, score: (F.lit(level).alias("__level"), F.col(level).alias("__named"), F.col(score).alias("__best"))
    best_url = known.groupBy("url").agg(F.max("risk_score").alias("score"))
    named = known.where(F.col("domain").isNotNull())
    best_domain = named.groupBy("domain").agg(F.max("risk_score").alias("score"))
    # The site follows from the domain, so its best score does too.
    best_base = best_domain.groupBy(site(F.col("domain")).alias("base_domain")).agg(F.max("score").alias("score"))
    parts = [t.select(*row(n, "score")) for n, t in zip(LEVELS, (best_url, best_domain, best_base))]
    # Used by the filters and by the joins.
    return staged(parts[0].union(parts[1]).union(parts[2]).where("__named IS NOT NULL"), "threat-keys")


def may_match(observed: DataFrame, best: DataFrame) -> DataFrame:
    """Observations with ``__may_match``: false where no level has their key, without a shuffle of them.

    The filter of a level has at most ``FILTER_WORDS`` rows of 12 bytes, however many threats there are, so
    it is sent to every task. It knows few other keys by chance up to some 2 million threats; with
    many more, more observations pass and are matched as they would be without it.
    """
    domain = F.col("domain") if "domain" in observed.columns else url_host(F.col("url"))
    rows = observed.withColumn("__url", F.col("url")).withColumn("__domain", domain)
    rows = rows.withColumn("__base_domain", site(F.col("__domain")))
    passes = F.lit(False)
    for level in LEVELS:
        bits = key_bits(best.where(F.col("__level") == level), "__named", words=FILTER_WORDS)
        bits = bits.select(F.col("word").alias(f"__word_{level}"), F.col("bits").alias(f"__bits_{level}"))
        key = F.col(f"__{level}")
        rows = rows.join(F.broadcast(bits), word_of(key, words=FILTER_WORDS) == F.col(f"__word_{level}"), "left")
        passes = passes | (key.isNotNull() & may_hold(F.col(f"__bits_{level}"), key))
    return rows.select(*observed.columns, passes.alias("__may_match"))


def campaigns(threats: DataFrame, by: str = "base_domain") -> DataFrame:
    """Threats that share infrastructure, as one summary row per shared key.

    ``by`` is ``base_domain``, ``ip_address`` or ``asn_brand`` (ASN and target
    brand together). An IP host is its own domain, and so is a customer's name on
    a hosting platform. Members are counted, not collected: the exact distinct
    counts are formed per (group, value) first, so a group that holds a third
    of all threats is spread over the tasks.
    """
    if by == "base_domain":
        keyed = _with_keys(threats)
        keys = ["base_domain"]
    elif by == "ip_address":
        keyed, keys = threats, ["ip_address"]
    elif by == "asn_brand":
        keyed, keys = threats, ["asn", "target_brand"]
    else:
        raise ValueError(f"cannot group by {by!r}")
    known = keyed.where(F.col(keys[0]).isNotNull() & F.col(keys[-1]).isNotNull())
    # Rows that repeat what is counted are summed up first; only what is left is counted four ways.
    counted = [c for c in ("url", "source_feed", "target_brand", "ip_address") if c not in keys]
    known = known.groupBy(*keys, *counted).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("risk_score").alias("risk_score"),
    )
    return known.groupBy(*keys).agg(
        F.sum("rows").alias("sightings"),
        F.countDistinct("url").alias("urls"),
        F.countDistinct("source_feed").alias("feeds"),
        F.countDistinct("target_brand").alias("brands"),
        F.countDistinct("ip_address").alias("ips"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("risk_score").alias("max_score"),
    )


# What two threats can have in common, and the mark that keeps names of different kinds apart.
_LINKS = {"base_domain": "s:", "ip_address": "i:", "asn_brand": "b:"}


def _link_names(threats: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Threats with ``__links``, the names of what they share with others; the first one names the row.

    A threat without a site stands under its URL, so all rows of a URL are in one campaign.
    """
    keyed = _with_keys(threats)
    own = F.coalesce(F.concat(F.lit("s:"), "base_domain"), F.concat(F.lit("u:"), "url"))
    names = {
        "base_domain": own,
        "ip_address": F.concat(F.lit("i:"), "ip_address"),
        "asn_brand": F.concat_ws(":", F.lit("b"), F.col("asn").cast("string"), "target_brand"),
    }
    names["asn_brand"] = F.when(F.col("asn").isNotNull() & F.col("target_brand").isNotNull(), names["asn_brand"])
    # Without sites as links a URL alone holds its rows together.
    first = own if "base_domain" in by else F.concat(F.lit("u:"), "url")
    rest = [names[k] for k in by if k != "base_domain"]
    return keyed.where(first.isNotNull()).withColumn("__links", F.array_compact(F.array(first, *rest)))


def campaign_members(threats: DataFrame, by: tuple[str, ...] = tuple(_LINKS), **options) -> DataFrame:
    """(url, campaign) of every URL: threats linked over shared sites, addresses or ASN and brand, and on from there.

    The campaign is the smallest name it holds (``s:`` site, ``i:`` address, ``b:`` ASN and brand,
    ``u:`` URL). Rows without a URL are left out. Nodes are names, not rows: a third of all threats on one
    address is one edge per site. ``options`` go to ``connected_components``.
    """
    if not by or set(by) - set(_LINKS):
        raise ValueError(f"links are {', '.join(_LINKS)}")
    linked = _link_names(threats.where(F.col("url").isNotNull()), tuple(by))
    linked = staged(linked.select("url", "__links"), "linked")  # read twice
    first = F.col("__links")[0]
    # A row ties its first name to each of its names, itself among them, so every name is a node.
    edges = linked.select(first.alias("a"), F.explode("__links").alias("b")).distinct()
    root = connected_components(staged(edges, "links"), **options)
    urls = linked.select("url", first.alias("node")).distinct()
    return balanced_left_join(urls, root, "node", F.col("url")).select("url", F.col("root").alias("campaign")).distinct()


def campaign_components(threats: DataFrame, by: tuple[str, ...] = tuple(_LINKS), **options) -> DataFrame:
    """One summary row per campaign of ``campaign_members``: its size, span and highest score.

    Rows are summed up by URL and address before they meet their campaign; members are counted,
    never collected.
    """
    keyed = _with_keys(threats.where(F.col("url").isNotNull()))
    used = ("url", "domain", "base_domain", "ip_address", "asn", "target_brand", "first_seen", "last_seen", "risk_score")
    # Threats may be costly to compute, so they are computed once, in one pass.
    keyed = staged(keyed.select(*[c for c in used if c in keyed.columns]), "threats")
    members = campaign_members(keyed, by, **options)
    keyed = keyed.groupBy("url", "base_domain", "ip_address").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("risk_score").alias("risk_score"),
    )
    return keyed.join(members, "url").groupBy("campaign").agg(
        F.sum("rows").alias("sightings"),
        F.countDistinct("url").alias("urls"),
        F.countDistinct("base_domain").alias("sites"),
        F.countDistinct("ip_address").alias("ips"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("risk_score").alias("max_score"),
    )
