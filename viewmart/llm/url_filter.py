"""Allow and block verdicts for urls: stated rules first, then association rules mined from labelled urls.

1. A url is cut into host and path; of the stated rules that fit it the longest gives its verdict.
2. These verdicts are the labels. FP-growth mines combinations of url tokens together with a label; those with
   a token that is not among the most telling ones of each of its urls are grown by joins, without a bound.
3. Combinations are pruned by support and confidence, and where leaving a token out is no worse.
4. A rule is filed under its rarest token. A url without a verdict meets only rules filed under one of its
   tokens, and the most confident rule whose tokens it holds decides.
"""

import math
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from viewmart.llm.common import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
#: Marks the label among the tokens; tokens have another letter before the colon.
LABEL = "v:"


@dataclass(frozen=True)
class UrlRule:
    """A stated rule: a host, meant with its subdomains, and how the path starts."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: list[UrlRule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, NULL if none does; of equally long ones the first stated."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda rule: len(rule.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """The distinct tokens of a url, sorted: what it is made of, each kind under its own letter.

    s: scheme, h: host labels from the right with their place, p: path parts with their place, e: the
    last part's extension, q: query keys, f: a fragment. Runs of digits count as one ``#``.
    """
    scheme = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    labels = F.reverse(F.split(host, r"\."))
    parts = F.filter(F.split(path, "/"), lambda part: part != "")
    typed = lambda text: F.regexp_replace(text, r"\d+", "#")
    placed = lambda letter: lambda part, i: F.concat(F.lit(letter), i.cast("string"), F.lit(":"), typed(part))
    keys = F.filter(F.transform(F.split(query, "&"), lambda pair: F.split(pair, "=")[0]), lambda key: key != "")
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    some = lambda held, token: F.when(held, F.array(token)).otherwise(F.array().cast("array<string>"))
    tokens = F.concat(
        some(scheme != "", F.concat(F.lit("s:"), scheme)),
        F.when(host != "", F.transform(labels, placed("h"))).otherwise(F.array().cast("array<string>")),
        F.transform(parts, placed("p")),
        some(extension != "", F.concat(F.lit("e:"), extension)),
        F.transform(keys, lambda key: F.concat(F.lit("q:"), typed(key))),
        some(url.rlike("(?s)://[^#]*#"), F.lit("f:")),
    )
    return F.coalesce(F.sort_array(F.array_distinct(tokens)), F.array().cast("array<string>"))


def telling_tokens(labelled: DataFrame, min_rows: float) -> DataFrame:
    """(id, verdict, token, place) for the frequent tokens of each url that can tell verdicts apart.

    A token is kept if ``min_rows`` urls hold it, but not all. ``place`` counts a url's tokens from 0 on: those go
    first whose share of blocked urls differs most from the share among all, weighted by their number.
    """
    total = labelled.agg(F.count("*").alias("all"), F.avg(F.when(F.col("verdict") == BLOCK, 1.0).otherwise(0.0)).alias("share"))
    held = labelled.select("id", "verdict", F.explode("tokens").alias("token"))
    counted = held.groupBy("token").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("verdict") == BLOCK, 1.0).otherwise(0.0)).alias("blocked")
    )
    # One row stands beside each; a token of every url tells nothing.
    counted = counted.join(F.broadcast(total)).where((F.col("n") >= min_rows) & (F.col("n") < F.col("all")))
    weight = F.abs(F.col("blocked") - F.col("n") * F.col("share")) / F.sqrt(F.col("n"))
    weighed = settle(counted.select("token", F.round(weight, 9).alias("weight")), "url-tokens")
    ranked = held.join(weighed, "token").groupBy("id", "verdict").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "token"))).alias("ranked")
    )
    return ranked.select("id", "verdict", F.posexplode("ranked.token").alias("place", "token"))


def _fewer(tokens: str) -> Column:
    """The sets with one token less."""
    return F.transform(tokens, lambda out: F.filter(tokens, lambda token: token != out))


def sets_beyond_core(marked: DataFrame, core_sets: DataFrame, least: int) -> DataFrame:
    """(tokens, verdict, n, held) of the sets with a token outside the core, of all that can be rules.

    ``marked`` is (id, verdict, token, core), ``core_sets`` (tokens, held, top) the sets of core tokens alone, with
    the number of urls that hold them and of those that bear their most frequent verdict. Sets grow by one token at a
    time, by a join of the sets of each url. A set is not grown if it has ``least`` urls of no verdict; if all its
    urls bear one verdict, as no larger one is surer; or if leaving out a token gives a set of the same urls, as then
    that holds of all larger ones. None of these loses a rule, and tokens that stand together do not multiply.
    """
    spark = marked.sparkSession
    # Tokens outside the core go first, so the first token of a set tells whether it has one.
    marks = lambda core, token: F.concat(F.when(core, "1").otherwise("0"), token)
    beyond = F.col("tokens")[0].startswith("0")
    of_core = core_sets.select(F.transform("tokens", lambda token: marks(F.lit(True), token)).alias("tokens"), "held", "top")
    of_core = of_core.where("top < held").select("tokens", "held")
    sets = marked.select("id", "verdict", F.array(marks(F.col("core"), F.col("token"))).alias("tokens"))
    found, base, size = spark.createDataFrame([], "tokens array<string>, verdict string, n bigint, held bigint"), None, 1
    while True:
        counted = settle(sets.groupBy("tokens", "verdict").agg(F.count("*").alias("n")), "url-counts")
        known = counted.groupBy("tokens").agg(F.sum("n").alias("held"), F.max("n").alias("top")).where(F.col("top") >= least)
        if base is not None:
            parts = known.select("tokens", "held", F.explode(_fewer("tokens")).alias("fewer"))
            wider = parts.join(base.select(F.col("tokens").alias("fewer"), F.col("held").alias("more")), "fewer").where("more > held")
            free = wider.groupBy("tokens").agg(F.count("*").alias("wider")).where(F.col("wider") == size).select("tokens")
            known = known.join(free, "tokens")
        known = settle(known, "url-known")
        found = found.unionByName(
            counted.where((F.col("n") >= least) & beyond).join(known, "tokens").select("tokens", "verdict", "n", "held")
        )
        grown = known.where("top < held").select("tokens", "held")
        if grown.where(beyond).isEmpty():
            break
        base = grown.unionByName(of_core.where(F.size("tokens") == size)) if size > 1 else grown
        kept = sets.join(grown.select("tokens"), "tokens").select(
            "id", "verdict", "tokens", F.slice("tokens", 1, size - 1).alias("first"), F.col("tokens")[size - 1].alias("last")
        )
        other = kept.select("id", "first", F.col("last").alias("next"))
        pairs = kept.where(beyond).join(other, ["id", "first"]).where(F.col("last") < F.col("next"))
        sets = settle(pairs.select("id", "verdict", F.concat("tokens", F.array("next")).alias("tokens")), "url-longer")
        size += 1
    plain = F.sort_array(F.transform("tokens", lambda token: F.substring(token, 2, 1 << 30)))
    return found.withColumn("tokens", plain)


def mine_rules(
    labelled: DataFrame,
    min_support: float = 0.002,
    min_rows: int = 5,
    min_confidence: float = 0.75,
    max_items: int = 10,
) -> DataFrame:
    """(tokens, verdict, confidence, support, rarest) of the association rules of (tokens, verdict).

    A rule counts if at least ``min_support`` of the labelled urls, and ``min_rows``, hold its tokens and
    bear its verdict, if ``min_confidence`` of the urls that hold its tokens bear it, and if no rule with
    one token less is as confident; rules of one token must beat the verdict's share among all.
    Without labelled urls there are no rules.

    FP-growth takes the tokens that are among the ``max_items`` most telling ones of every url that holds them, so it
    makes 2 ** max_items combinations of a url at most. Combinations with another token come from ``sets_beyond_core``.
    """
    spark = labelled.sparkSession
    labelled = settle(labelled.select(F.monotonically_increasing_id().alias("id"), "tokens", "verdict"), "labelled-urls")
    total = labelled.count()
    none = "tokens array<string>, verdict string, confidence double, support bigint, rarest string"
    if not total:
        return spark.createDataFrame([], none)
    support = max(min_support, min_rows / total)
    if support > 1:
        return spark.createDataFrame([], none)
    telling = settle(telling_tokens(labelled, support * total), "telling-tokens")
    core = telling.groupBy("token").agg((F.max("place") < max_items).alias("core"), F.count("*").alias("held"))
    core = settle(core, "core-tokens")
    marked = telling.join(core.select("token", "core"), "token").select("id", "verdict", "token", "core")
    chosen = F.collect_list(F.when(F.col("core"), F.col("token")))
    items = marked.groupBy("id", "verdict").agg(F.concat(chosen, F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    items = settle(items.select("items"), "url-items")
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=1.0).fit(items).freqItemsets
    # Each set is known by its sorted items; with the label taken out it is a rule's left side.
    sets = settle(found.select(F.sort_array("items").alias("items"), F.col("freq").cast("long").alias("n")), "url-sets")
    is_label = lambda item: item.startswith(LABEL)
    label = F.get(F.filter("items", is_label), F.lit(0))
    sides = sets.where(label.isNotNull()).select(
        F.filter("items", lambda item: ~is_label(item)).alias("tokens"), F.substring(label, len(LABEL) + 1, 1 << 20).alias("verdict"), "n"
    )
    alone = sets.where(label.isNull()).select(F.col("items").alias("tokens"), F.col("n").alias("held"))
    everything = spark.createDataFrame([([], total)], "tokens array<string>, held bigint")
    held = alone.unionByName(everything)
    counts = sides.join(held, "tokens").select("tokens", "verdict", "n", "held")
    if not core.where("not core").isEmpty():
        by_core = settle(counts.where(F.size("tokens") > 0).groupBy("tokens").agg(F.max("held").alias("held"), F.max("n").alias("top")), "core-sets")
        least = math.ceil(support * items.count())  # as FP-growth has it
        counts = counts.unionByName(sets_beyond_core(settle(marked, "marked-tokens"), by_core, least))
    rules = settle(counts.select("tokens", "verdict", "n", (F.col("n") / F.col("held")).alias("confidence")), "url-rules")

    shorter = rules.where(F.size("tokens") > 0).select("tokens", "verdict", "confidence", F.explode(_fewer("tokens")).alias("fewer"))
    base = rules.select(F.col("tokens").alias("fewer"), F.col("verdict").alias("v"), F.col("confidence").alias("base"))
    worse = shorter.join(base, (shorter["fewer"] == base["fewer"]) & (shorter["verdict"] == base["v"]))
    worse = worse.where("base >= confidence").select("tokens", "verdict").distinct()
    sure = rules.where((F.size("tokens") > 0) & (F.col("confidence") >= min_confidence)).join(worse, ["tokens", "verdict"], "left_anti")

    rarest = (
        sure.select("tokens", "verdict", F.explode("tokens").alias("token")).join(core.select("token", "held"), "token")
        .groupBy("tokens", "verdict").agg(F.min(F.struct("held", "token"))["token"].alias("rarest"))
    )
    out = sure.join(rarest, ["tokens", "verdict"]).select("tokens", "verdict", "confidence", F.col("n").alias("support"), "rarest")
    return settle(out, "url-index")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of each distinct set of tokens that holds all tokens of a rule.

    The rule of greatest confidence decides, then of greatest support, then the longest, then block.
    """
    asked = token_sets.select("tokens", F.explode("tokens").alias("token"))
    rule = rules.select(F.col("rarest").alias("token"), F.col("tokens").alias("needed"), "confidence", "support", F.col("verdict").alias("v"))
    fits = asked.join(rule, "token").where(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("needed").alias("size"), "v"))
    return fits.groupBy("tokens").agg(best.alias("best")).select("tokens", F.col("best.v").alias("verdict"))


def url_verdicts(
    pages: DataFrame,
    rules: list[UrlRule],
    default: str = ALLOW,
    min_support: float = 0.002,
    min_confidence: float = 0.75,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (whether a mined rule decided), for every row.

    The longest stated rule that fits decides (``rule``, like ``net/``). Elsewhere a rule mined from the
    verdicts of stated rules does, and where none fits, ``default``. Repeated urls are one url to the
    miner. A NULL url and one without ``://`` have an empty host and path, so no stated rule. Rows with
    NULL or repeated ids are judged each; further columns are ignored; an empty table gives an empty result.
    Rules are joined as a table, so Spark broadcasts them only if they are small.
    """
    page = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    cut = page.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    text, verdict = stated_rule(F.col("host"), F.col("path"), rules)
    tokens = url_tokens(F.col("url"), F.col("host"), F.col("path"))
    judged = settle(cut.withColumns({"rule": text, "stated": verdict, "tokens": tokens}), "urls")

    labelled = judged.where("stated is not null").groupBy("url").agg(
        F.first("tokens").alias("tokens"), F.first("stated").alias("verdict")  # functions of the url
    )
    mined = mine_rules(labelled, min_support, min_confidence=min_confidence)
    open_sets = judged.where("stated is null").select("tokens").distinct()
    matched = settle(match_rules(open_sets, mined).withColumnRenamed("verdict", "found"), "url-verdicts")
    # Rows with a stated rule look nothing up, so they meet no hot key.
    key = F.when(F.col("stated").isNull(), F.col("tokens"))
    rows = judged.withColumn("key", key).join(matched.withColumnRenamed("tokens", "key"), "key", "left")
    return rows.select(
        "page_id", "host", "path", "rule",
        F.coalesce("stated", "found", F.lit(default)).alias("verdict"),
        (F.col("stated").isNull() & F.col("found").isNotNull()).alias("mined"),
    )
