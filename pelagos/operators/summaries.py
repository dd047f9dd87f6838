"""Summaries of corpora, screens, sensors and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pelagos.functions.scalars import wilson


def ranked_members(df: DataFrame, key: str, members: Column, n: int) -> DataFrame:
    """(member, n_papers, pct, pct_known, rank): in how many rows each member of an array occurs, once a row, the highest first, ties by name; shares of all rows and of rows with any member."""
    each = df.select(key, F.explode(F.array_distinct(members)).alias("member")).where("member is not null and member <> ''")
    counts = each.groupBy("member").agg(F.count("*").alias("n_papers"))
    sizes = df.agg(F.count("*").alias("_all"), F.count(F.when(F.size(F.coalesce(members, F.array().cast("array<string>"))) > 0, 1)).alias("_known"))
    top = counts.orderBy(F.desc("n_papers"), "member").limit(n)
    out = top.crossJoin(F.broadcast(sizes))  # one row on the right
    rank = F.row_number().over(Window.orderBy(F.desc("n_papers"), "member"))  # the limited rows alone
    return out.select("member", "n_papers", F.round(100 * F.col("n_papers") / F.col("_all"), 2).alias("pct"), F.round(100 * F.col("n_papers") / F.col("_known"), 2).alias("pct_known"), rank.alias("rank"))


def notices_by_venue(notices: DataFrame, venues: DataFrame, since: Column) -> DataFrame:
    """Per venue (key): notices by nature, retractions since a date, and the three most frequent reasons of retractions. Venues (key, name) match the notices' journal by its normalised name, once a key; notices: journal, nature, day, reasons (array)."""
    names = venues.where("name <> ''").select("key", "name").distinct()
    hit = notices.join(names, notices["journal"] == names["name"]).select("key", "nature", "day", "reasons")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    counts = hit.groupBy("key").agg(F.count("*").alias("notices"), n(F.col("nature") == "Retraction", "retractions"), n((F.col("nature") == "Retraction") & (F.col("day") >= since), "retractions_since"), n(F.col("nature") == "Expression of concern", "concerns"), n(F.col("nature") == "Correction", "corrections"))
    why = hit.where("nature = 'Retraction'").select("key", F.explode("reasons").alias("reason")).where("reason <> ''").groupBy("key", "reason").agg(F.count("*").alias("c"))
    top = why.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("c"), "reason"))).where("r <= 3")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "reason", "c"))), lambda x: F.concat(x["reason"], F.lit(" ("), x["c"].cast("string"), F.lit(")"))), "; ")
    out = venues.select("key").distinct().join(counts, "key", "left").join(top.groupBy("key").agg(text.alias("top_reasons")), "key", "left")
    return out.na.fill(0).na.fill("", ["top_reasons"])


def structures(detections: DataFrame) -> DataFrame:
    """One row per structure: median place, most frequent label (the smallest of equals), the confidence of the last date that has one, first and last dates, detections, whether it has no end, months seen."""
    label = detections.where("label is not null").groupBy("structure_id", "label").agg(F.count("*").alias("c")).groupBy("structure_id").agg(F.min_by("label", F.struct((-F.col("c")).alias("c"), "label")).alias("label"))
    g = detections.groupBy("structure_id").agg(
        F.median("lon").alias("lon"), F.median("lat").alias("lat"), F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.struct("day", "confidence"))).alias("confidence"),
        F.min("start_day").alias("start_day"), F.max("end_day").alias("end_day"), F.count("*").alias("n"), F.max("day").alias("last_day"),
    )
    months = F.round(F.datediff(F.coalesce("end_day", "last_day"), "start_day") / 30.44, 1)
    return g.join(label, "structure_id", "left").withColumns({"ongoing": F.col("end_day").isNull(), "months": months})


def rate_per_area(df: DataFrame, by: list[str], count: Column, area: Column, least: float) -> DataFrame:
    """(by, n, area, rate): events per thousand units of area, null under the least area."""
    g = df.groupBy(*by).agg(F.sum(count).alias("n"), F.sum(area).alias("area"))
    return g.withColumn("rate", F.when(F.col("area") >= least, 1000 * F.col("n") / F.col("area")))


def acceptance(df: DataFrame, keys: list[str], accepted: Column, score: str, medians: list[str]) -> DataFrame:
    """Rows for each value of each key on its own, and one for all: n, accepted, share with its interval, score quartiles, medians."""
    labels = F.explode(F.array(F.struct(F.lit("all").alias("grp"), F.lit("all").alias("value")), *(F.struct(F.lit(k).alias("grp"), F.col(k).cast("string").alias("value")) for k in keys)))
    each = df.select("*", accepted.alias("_ok")).select(labels.alias("_g"), "_ok", score, *medians)
    q = F.percentile(score, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = each.groupBy(F.col("_g.grp").alias("grp"), F.col("_g.value").alias("value")).agg(F.count("*").alias("n"), F.count(F.when(F.col("_ok"), 1)).alias("accepted"), q.alias("_q"), *(F.median(m).alias(f"{m}_median") for m in medians))
    low, high = wilson(F.col("accepted"), F.col("n"))
    return g.withColumns({"share": F.col("accepted") / F.col("n"), "low": low, "high": high, **{f"q{p}": F.col("_q")[i] for i, p in enumerate((25, 50, 75))}}).drop("_q")


def fill_rates(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """(by, name, n, filled, rate) of each column."""
    long = df.select(by, F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).isNotNull())))).alias("name", "has"))
    return long.groupBy(by, "name").agg(F.count("*").alias("n"), F.count(F.when(F.col("has"), 1)).alias("filled")).withColumn("rate", F.col("filled") / F.col("n"))


def stratified_share(df: DataFrame, stratum: str, population: DataFrame, hit: Column) -> DataFrame:
    """One row: the share of hits in a population (stratum, size) estimated from a sample within strata, its standard error, and the weighted total."""
    s = df.groupBy(stratum).agg(F.count("*").alias("n"), F.count(F.when(hit, 1)).alias("k")).join(population, stratum)
    total = population.agg(F.sum("size").alias("_t"))
    s = s.crossJoin(F.broadcast(total))  # one row on the right
    w, p = F.col("size") / F.col("_t"), F.col("k") / F.col("n")
    var = F.when(F.col("n") > 1, w * w * p * (1 - p) / (F.col("n") - 1)).otherwise(0.0)
    return s.agg(F.sum(w * p).alias("share"), F.sqrt(F.sum(var)).alias("se"), F.sum(F.col("k") * F.col("size") / F.col("n")).alias("total"))


def bootstrap_share(df: DataFrame, key: str, hit: Column, weight: Column, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """One row: the weighted share of hits and its percentile interval over seeded replicates; a row's multiplicity in a replicate comes from a hash of its key (Poisson of mean 1)."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cdf, times, p = 0.0, F.lit(9), 0.36787944117144233
    bounds = []
    for k in range(9):
        cdf += p
        bounds.append(cdf)
        p /= k + 1
    for k in range(8, -1, -1):
        times = F.when(u < bounds[k], k).otherwise(times)
    x = df.select(key, hit.alias("_h"), weight.alias("_w")).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_m", times)
    each = x.groupBy("rep").agg((F.sum(F.when(F.col("_h"), F.col("_w") * F.col("_m")).otherwise(0)) / F.nullif(F.sum(F.col("_w") * F.col("_m")), F.lit(0))).alias("s"))
    q = F.percentile("s", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2)))
    own = df.agg((F.sum(F.when(hit, weight).otherwise(0)) / F.sum(weight)).alias("share"))
    return own.crossJoin(each.agg(q.alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))  # single rows


def linear_fit(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, slope, intercept, r2) of least squares."""
    return df.groupBy(*by).agg(F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def matched_difference(df: DataFrame, bin_: Column, side: str, values: tuple[str, str], score: str) -> DataFrame:
    """(bin, n_a, n_b, difference) of a score's mean between two sides within bins that both have."""
    g = df.groupBy(bin_.alias("bin")).agg(*(F.count(F.when(F.col(side) == v, 1)).alias(n) for v, n in zip(values, ("n_a", "n_b"), strict=True)), *(F.avg(F.when(F.col(side) == v, F.col(score))).alias(n) for v, n in zip(values, ("_a", "_b"), strict=True)))
    return g.where("n_a > 0 and n_b > 0").select("bin", "n_a", "n_b", (F.col("_a") - F.col("_b")).alias("difference"))


def judged_precision(sample: DataFrame, judgments: DataFrame, key: str, themes: Column) -> DataFrame:
    """(theme, judged, relevant, precision) of the sample, per theme and for all; only rows judged relevant or not count."""
    j = sample.join(judgments.where("judgment in ('relevant', 'not relevant')"), key)
    each = j.select("judgment", F.explode(F.array_union(F.array(F.lit("all")), themes)).alias("theme"))
    return each.groupBy("theme").agg(F.count("*").alias("judged"), F.count(F.when(F.col("judgment") == "relevant", 1)).alias("relevant")).withColumn("precision", F.col("relevant") / F.col("judged"))


def day_gaps(df: DataFrame, day: str) -> DataFrame:
    """One row: different days, the median and the largest gap between consecutive ones. Days of a recording are few."""
    d = df.select(F.to_date(day).alias("d")).distinct()
    gap = F.datediff("d", F.lag("d").over(Window.orderBy("d")))  # days of a recording
    return d.withColumn("g", gap).agg(F.count("*").alias("days"), F.median("g").alias("median_gap"), F.max("g").alias("max_gap"))


def covered(venues: DataFrame, ids: DataFrame, issns: DataFrame, titles: DataFrame, pattern: str) -> DataFrame:
    """``venues`` (id, issns array, title) with covered: its id, any of its ISSNs or its title is known, or the title fits the pattern."""
    by_id = venues.join(ids.select("id").distinct(), "id", "left_semi").select("id")
    each = venues.select("id", F.explode("issns").alias("issn"))
    by_issn = each.join(issns.select("issn").distinct(), "issn", "left_semi").select("id")
    by_title = venues.join(titles.select("title").where("title <> ''").distinct(), "title", "left_semi").select("id")
    known = by_id.unionByName(by_issn).unionByName(by_title).distinct().withColumn("_k", F.lit(True))
    return venues.join(known, "id", "left").withColumn("covered", F.coalesce("_k", F.col("title").rlike(pattern), F.lit(False))).drop("_k")


def match_by_issn_then_title(seeds: DataFrame, table: DataFrame) -> DataFrame:
    """``seeds`` (id, issns array, title) with the table row (row_id, issns array, title) that shares an ISSN, else the title; ties to the smallest row_id; status says how."""
    a = seeds.select("id", F.explode("issns").alias("issn")).join(table.select("row_id", F.explode("issns").alias("issn")), "issn").groupBy("id").agg(F.min("row_id").alias("_i"))
    left = seeds.join(a, "id", "left")
    t = table.where("title <> ''").groupBy("title").agg(F.min("row_id").alias("_t"))
    out = left.join(t, "title", "left")
    status = F.when(F.col("_i").isNotNull(), "issn").when(F.col("_t").isNotNull(), "title").otherwise("none")
    return out.select("id", F.coalesce("_i", "_t").alias("row_id"), status.alias("status"))


def top_venues(df: DataFrame, n: int, count: str, no_source: Column) -> DataFrame:
    """Rows by count, the highest first, until ``n`` real ones: rows without a source that rank among them are kept and flagged, but do not count."""
    flag = df.withColumn("no_source", no_source)
    real = flag.where("not no_source").orderBy(F.desc(count), "name").limit(n)
    last = real.agg(F.max(F.struct((-F.col(count)).alias("c"), "name")).alias("_l"))
    kept = flag.crossJoin(F.broadcast(last)).where(F.struct((-F.col(count)).alias("c"), F.col("name")) <= F.col("_l"))  # one row on the right
    return kept.drop("_l")


def seeded_mask(df: DataFrame, key: str, eligible: Column, n: int, seed: int) -> DataFrame:
    """``df`` with chosen: a seeded sample of ``n`` eligible rows that does not depend on their order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    picked = df.where(eligible).select(key).distinct().orderBy(h, key).limit(n).withColumn("chosen", F.lit(True))
    return df.join(picked, key, "left").na.fill(False, ["chosen"])


def capped_per_group(df: DataFrame, group: str, key: str, caps: dict[str, int], kind: str, seed: int) -> DataFrame:
    """At most ``caps[kind]`` rows of each kind per group, by a seeded hash of the key."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(group, kind).orderBy(h, key))
    cap = F.lit(0)
    for k, n in caps.items():
        cap = F.when(F.col(kind) == k, n).otherwise(cap)
    return df.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def largest_remainder(strata: DataFrame, total: int, stratum: str, size: str) -> DataFrame:
    """(stratum, size, quota): ``total`` dealt out in proportion to size, what rounding leaves to the largest remainders, ties by name. Strata are few."""
    sums = strata.agg(F.sum(size).alias("_s"))
    x = strata.crossJoin(F.broadcast(sums)).withColumn("_e", F.lit(total) * F.col(size) / F.col("_s"))  # one row on the right
    x = x.withColumns({"quota": F.floor("_e"), "_f": F.col("_e") - F.floor("_e")})
    w = Window.orderBy(F.desc("_f"), stratum)  # strata alone
    left = F.lit(total) - F.sum("quota").over(Window.partitionBy())
    return x.withColumn("_left", left).withColumn("_r", F.row_number().over(w)).select(stratum, size, (F.col("quota") + F.when(F.col("_r") <= F.col("_left"), 1).otherwise(0)).alias("quota"))
