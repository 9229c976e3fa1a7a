"""Duplicates across pages: shared titles and descriptions, equal and nearly equal content, domain variants.

Groups are aggregations joined back; near duplicates are found by three bands of the hash, of which two hashes at distance 2 or less share one, or by balls around the hashes where a band is crowded, and not by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as X
from siteloom.functions import urls as U
from siteloom.model import ERROR, INFO, WARNING, Crawl
from siteloom.operators.base import rows, rule, small, standard
from siteloom.plans.lineage import checkpoint

#: (first bit, bits) of the bands.
BANDS = [(0, 22), (22, 21), (43, 21)]
NEAR = 2
#: Hashes of a band's bucket up to which they are compared.
CROWD = 512


def final_hops(crawl: Crawl) -> DataFrame:
    """(project_id, from_norm, to_norm, permanent): where each redirecting page ends."""
    last = crawl.redirects.groupBy("url_id").agg(F.max_by(F.struct("to_url", "status_code"), "position").alias("x"))
    return last.join(crawl.urls.select("url_id", "project_id", "address"), "url_id").select("project_id", U.normalize(F.col("address")).alias("from_norm"), U.normalize(F.col("x.to_url")).alias("to_norm"), F.col("x.status_code").isin(301, 308).alias("permanent")).distinct()


def members(own: DataFrame, key: str, hops: DataFrame) -> DataFrame:
    """``own`` rows of groups of more than one page: n in the group, and of the others how many a permanent or temporary redirect (either way) relates.

    Redirect pairs are few and are joined to the group's rows; the group's pairs are never formed.
    """
    window = Window.partitionBy("project_id", key)
    grouped = own.withColumn("n", F.count("*").over(window)).where("n > 1").withColumn("norm", U.normalize(F.col("page")))
    either = hops.select("project_id", F.col("from_norm").alias("norm"), F.col("to_norm").alias("other"), "permanent").unionByName(hops.select("project_id", F.col("to_norm").alias("norm"), F.col("from_norm").alias("other"), "permanent"))
    related = grouped.select("project_id", key, "url_id", "norm").join(either, ["project_id", "norm"]).join(grouped.select("project_id", key, F.col("norm").alias("other"), F.col("url_id").alias("other_id")), ["project_id", key, "other"]).where("url_id != other_id").groupBy("url_id").agg(F.count_distinct(F.when(F.col("permanent"), F.col("other_id"))).alias("n_permanent"), F.count_distinct(F.when(~F.col("permanent"), F.col("other_id"))).alias("n_temporary"))
    return grouped.join(related, "url_id", "left").fillna(0, ["n_permanent", "n_temporary"])


def others(grouped: DataFrame, key: str, k: int) -> DataFrame:
    """(url_id, other): up to k other pages of a page's group, by address; only each group's first k + 1 are gathered."""
    first = Window.partitionBy("project_id", key).orderBy("page", "url_id")
    head = grouped.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).groupBy("project_id", key).agg(F.array_sort(F.collect_list("page")).alias("head"))
    return grouped.select("project_id", key, "url_id", "page").join(head, ["project_id", key]).select("url_id", F.array_join(F.slice(F.array_remove("head", F.col("page")), 1, k), ", ").alias("others"))


def shared_values(crawl: Crawl, own: DataFrame) -> DataFrame:
    """Titles and descriptions that several pages share."""
    hops = final_hops(crawl)
    base = own.select("project_id", "url_id", "page", "t", "d", F.lower("t").alias("t_key"), F.lower("d").alias("d_key"))
    shared = {"Title": F.col("t"), "MetaDescription": F.col("d")}
    same = members(base.where("t != ''"), "t_key", hops)
    left = F.when(F.col("n_permanent") + F.col("n_temporary") == 0, F.col("n")).otherwise(F.least(F.col("n") - 1 - F.col("n_permanent") - F.col("n_temporary"), F.lit(5)) + 1)
    title = rows(same.join(others(same, "t_key", 5), "url_id").withColumn("left", left), "TitlesMeta", [
        rule(F.col("left") > 1, F.format_string("Duplicate Title (%d pages)", F.col("left")), ERROR, F.concat(F.lit("Also on "), F.col("others")), Length=F.length("t"), **shared),
        rule(F.col("n_temporary") > 0, "Duplicate Title (Temporary Redirects)", WARNING, "", Length=F.length("t"), **shared),
    ])
    described = base.where("d != ''").withColumn("n", F.count("*").over(Window.partitionBy("project_id", "d_key"))).where("n > 1")
    return title.unionByName(rows(described, "TitlesMeta", [rule(F.lit(True), F.format_string("Duplicate Meta Description (%d pages)", F.col("n")), WARNING, "", Length=F.length("d"), **shared)]))


def near_pairs(hashes: DataFrame) -> DataFrame:
    """(project_id, a, b, distance) of distinct hashes (project_id, hash) 1 to NEAR bits apart, a < b.

    Three bands leave one untouched by two flips, so a pair meets in a band's bucket. Buckets of up to CROWD hashes are compared; hashes of a larger one (of hashes that leave bits unused all share a band) meet in ``ball_pairs``, whose
    cost is that of the hashes and the pairs found.
    """
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.expr(f"shiftrightunsigned(hash, {low}) & {(1 << n) - 1}L").alias("part")) for i, (low, n) in enumerate(BANDS)))
    banded = hashes.select("project_id", "hash").distinct().select("project_id", "hash", F.explode(bands).alias("x")).select("project_id", "hash", "x.*")
    crowds = banded.groupBy("project_id", "band", "part").count().where(F.col("count") > CROWD).select("project_id", "band", "part", F.lit(True).alias("crowd"))
    quiet = F.when(F.col("crowd").isNull(), F.struct("band", "part"))
    own = checkpoint(banded.join(crowds, ["project_id", "band", "part"], "left").groupBy("project_id", "hash").agg((F.count("crowd") > 0).alias("crowded"), F.collect_list(quiet).alias("quiet")))
    met = own.select("project_id", "hash", "crowded", F.inline("quiet"))
    left, right = (met.withColumnsRenamed({"hash": x, "crowded": f"crowded_{x}"}) for x in "ab")
    near = left.join(right, ["project_id", "band", "part"]).where("a < b and not (crowded_a and crowded_b)").withColumn("distance", X.hamming(F.col("a"), F.col("b"))).where(F.col("distance").between(1, NEAR))
    return near.select("project_id", "a", "b", "distance").distinct().unionByName(ball_pairs(own.where("crowded").select("project_id", "hash")))


def ball_pairs(hashes: DataFrame) -> DataFrame:
    """``near_pairs`` of distinct hashes by the balls of radius 1 around them: two hashes meet in a key if and only if they are at most 2 bits apart, and a key has 65 members at most.

    Only bits in which a project's hashes differ are flipped. Of the two keys in which a pair meets, one has the flips in order of the hashes.
    """
    differ = hashes.groupBy("project_id").agg(F.expr("bit_or(hash) ^ bit_and(hash)").alias("bits"))
    flips = F.expr("concat(array(named_struct('flip', -1, 'key', hash)), transform(filter(sequence(0, 63), i -> shiftrightunsigned(bits, i) & 1L = 1L), i -> named_struct('flip', i, 'key', hash ^ shiftleft(1L, i))))")
    balls = hashes.join(small(differ), "project_id").select("project_id", "hash", F.inline(flips))
    left, right = (balls.withColumnsRenamed({"hash": x, "flip": f"flip_{x}"}) for x in "ab")
    return left.join(right, ["project_id", "key"]).where("a < b and flip_a < flip_b").select("project_id", "a", "b", F.when(F.col("flip_a") < 0, 1).otherwise(2).alias("distance"))


def contents(ctx: DataFrame) -> DataFrame:
    """Standard pages with the hash of their visible text."""
    return standard(ctx).where("visible != ''").withColumn("content_hash", X.sha256(F.col("visible")))


def exact(crawl: Crawl, own: DataFrame, arrival: bool = False) -> DataFrame:
    """Pages of equal content, from (project_id, url_id, page, content_hash). ``arrival``: a page sees only the pages of smaller id, as if pages were analysed in that order."""
    same = members(own.select("project_id", "url_id", "page", "content_hash"), "content_hash", final_hops(crawl))
    if arrival:
        same = same.withColumn("n", F.count("*").over(Window.partitionBy("project_id", "content_hash").orderBy("url_id").rowsBetween(Window.unboundedPreceding, 0)))
    left = F.when(F.col("n_permanent") + F.col("n_temporary") == 0, F.col("n")).otherwise(F.least(F.col("n") - 1 - F.col("n_permanent"), F.lit(10)) + 1)
    return rows(same.join(others(same, "content_hash", 10), "url_id").withColumn("left", left), "DuplicateContent", [
        rule(F.col("left") > 1, F.format_string("Exact Duplicate (%d pages)", F.col("left")), ERROR, "Equal text.", DuplicateOf=F.col("others"), Similarity=100),
        rule(F.col("n_temporary") > 0, "Duplicate (Temporary Redirects)", WARNING, "Redirect permanently.", DuplicateOf=F.col("others"), Similarity=100),
    ])


def exact_on_arrival(crawl: Crawl, ctx: DataFrame) -> DataFrame:
    """``exact`` in order of arrival; texts are hashed once and no other rule is computed."""
    return exact(crawl, checkpoint(contents(ctx).select("project_id", "url_id", "page", "content_hash")), arrival=True)


def duplicates(crawl: Crawl, ctx: DataFrame, arrival: bool = False) -> DataFrame:
    """``arrival``: see ``exact``. Fingerprints are told once; what follows reads no texts."""
    own = checkpoint(contents(ctx).select("project_id", "url_id", "page", "content_hash", X.simhash(F.col("visible")).alias("simhash"), "depth", "body_length", "main_length"))
    base = own.select("project_id", "url_id", "page", "content_hash", "simhash")
    hashes = base.where("simhash != 0").groupBy("project_id", F.col("simhash").alias("hash")).agg(F.count("*").alias("n"), F.min("page").alias("first"))
    pairs = near_pairs(hashes)
    both = pairs.select("project_id", F.col("a").alias("hash"), F.col("b").alias("other"), "distance").unionByName(pairs.select("project_id", F.col("b").alias("hash"), F.col("a").alias("other"), "distance"))
    about = both.join(hashes.select("project_id", F.col("hash").alias("other"), "n", "first"), ["project_id", "other"]).groupBy("project_id", "hash").agg(F.sum("n").alias("n_near"), F.min_by("first", F.struct("distance", "first")).alias("nearest"), F.min("distance").alias("distance"))
    near = base.withColumnRenamed("simhash", "hash").join(about, ["project_id", "hash"]).withColumn("percent", X.similarity(F.col("distance")))
    close = rows(near, "DuplicateContent", [rule(F.lit(True), F.format_string("Near Duplicate (%d pages, %.0f%% similar)", F.col("n_near"), "percent"), WARNING, "", DuplicateOf=F.col("nearest"), Similarity=F.col("percent").cast("int"))])
    share = F.col("main_length") / F.col("body_length")
    thin = rows(own, "DuplicateContent", [rule((F.col("depth") <= 2) & (F.col("body_length") >= 100) & (share < 0.4), F.format_string("High Boilerplate Ratio (%d%%)", ((1 - share) * 100).cast("int")), WARNING, "", DuplicateOf="", Similarity=0)])
    return exact(crawl, base, arrival).unionByName(close).unionByName(thin).unionByName(domain_variants(crawl))


def domain_variants(crawl: Crawl) -> DataFrame:
    """What probes of a site's other three addresses found."""
    probes = crawl.variant_probe.join(small(crawl.projects.select("project_id", "base_url")), "project_id").withColumns({"url_id": F.lit(None).cast("long"), "page": F.col("base_url")})
    status, target = F.col("status"), F.col("location")
    right = (U.origin(target) == U.origin(F.col("base_url")))
    moved, permanent = status.between(300, 399), status.isin(301, 308)
    r = lambda when, issue, severity: rule(when, F.format_string(issue, status) if "%" in issue else issue, severity, "", DuplicateOf=F.col("variant_url"), Similarity=0)
    return rows(probes, "DuplicateContent", [
        r((F.col("failure") == "timeout"), "Domain Variant Timeout", WARNING),
        r((F.col("failure") == "unreachable"), "Domain Variant Unreachable", WARNING),
        r(F.col("failure").isNotNull() & ~F.col("failure").isin("timeout", "unreachable"), "Domain Variant Error", WARNING),
        r(F.col("failure").isNull() & permanent & right, "Domain Variant Correct (%d)", INFO),
        r(F.col("failure").isNull() & permanent & ~right, "Domain Variant Wrong Target", WARNING),
        r(F.col("failure").isNull() & moved & ~permanent, "Domain Variant Temporary Redirect (%d)", ERROR),
        r(F.col("failure").isNull() & status.between(200, 299), "Domain Variant Duplicate Content", ERROR),
        r(F.col("failure").isNull() & (status >= 400), "Domain Variant Error (HTTP %d)", WARNING),
    ])
