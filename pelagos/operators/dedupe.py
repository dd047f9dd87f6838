"""Entity resolution in ordered passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions import works
from pelagos.functions.scalars import normalise_doi, normalise_title
from pelagos.operators import passages
from pelagos.operators.graph import connected_components
from pelagos.storage import materialise


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the order given; rows of null keys are kept as they are one key."""
    names = df.columns
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*names), F.struct(*order)).alias("_row"))
    return packed.select("_row.*").select(*names)


def resolve(records: DataFrame, record_id: str, passes: list[tuple[str, Column]], rank: list[Column]) -> DataFrame:
    """Merge records that agree on any pass's key.

    Returns ``records`` with survivor (the best-ranked record of the component), and reason, the first pass in which a record
    shares a key with another (null for records that merge with none). Within a pass the members of a key are linked to its smallest id, so a
    key with very many records gives as many links, not all pairs; null keys link nothing.
    """
    keyed = records.select(record_id, F.explode(F.array(*(F.struct(F.lit(i).alias("pass"), F.lit(name).alias("reason"), key.cast("string").alias("key")) for i, (name, key) in enumerate(passes)))).alias("k"))
    keyed = keyed.select(record_id, "k.*").where("key is not null and key <> ''")
    first = keyed.groupBy("pass", "key").agg(F.min(record_id).alias("first"), F.count("*").alias("n")).where("n > 1")
    member = materialise(keyed.join(first, ["pass", "key"]).select(record_id, "pass", "reason", "first"), "members")
    roots = connected_components(member.select(F.col(record_id).alias("a"), F.col("first").alias("b")))
    why = member.groupBy(record_id).agg(F.min_by("reason", "pass").alias("reason"))
    named = records.join(roots.withColumnRenamed("node", record_id), record_id, "left").withColumn("_root", F.coalesce("root", record_id)).drop("root")
    best = named.groupBy("_root").agg(F.min_by(record_id, F.struct(*rank, F.col(record_id))).alias("survivor"))
    return named.join(best, "_root").join(why, record_id, "left").drop("_root")


def work_edges(records: DataFrame, least_title: int = 25, near_years: int = 1, far_years: int = 3, containment: float = 0.6) -> DataFrame:
    """(a, b, pass): pairs of works that one of six passes merges: same id's DOI, same title and year, a secondary and a primary record of one title within a
    year (within three if the first authors agree), a weak record whose title holds, or is held in, another's, same title and venue within a year.

    Records: id (a number), doi, title, year, kind, venue, source_type, author. Within a key of the first passes members are linked to the smallest id; the
    conditional passes compare kinds of records (equal in all that a pass looks at) of a title, whose members are linked to the kind's smallest id, and different
    weak titles meet others through a rare inner word, so no pass is all against all.
    """
    r = records.select("id", normalise_doi(F.col("doi")).alias("doi"), normalise_title(F.col("title")).alias("t"), "year", normalise_title(F.coalesce("venue", F.lit(""))).alias("v"), "author", works.is_secondary(F.col("kind"), F.col("doi"), F.col("venue"), F.col("source_type")).alias("secondary"), works.is_weak(F.col("doi"), F.col("venue")).alias("weak"))
    kind = F.md5(F.to_json(F.struct("t", "year", "v", "author", "secondary", "weak")))
    r = materialise(r.withColumn("long", F.length("t") >= least_title).withColumn("kind", kind), "works")
    # All that the conditional passes look at: records of a kind are linked to the same others, and to each other if their kind meets itself.
    kinds = materialise(r.where("long").groupBy("kind", "t", "year", "v", "author", "secondary", "weak").agg(F.min("id").alias("id"), F.count("*").alias("n")), "kinds")
    members = r.where("long").select("kind", F.col("id").alias("member")).join(kinds.select("kind", "id"), "kind").where("member <> id").select("id", "member")

    def same(n: int, key: Column) -> DataFrame:
        keyed = r.select("id", key.alias("key")).where("key is not null and key <> ''")
        first = keyed.groupBy("key").agg(F.min("id").alias("a"))
        return keyed.join(first, "key").where("id <> a").select("a", F.col("id").alias("b"), F.lit(n).alias("pass"))

    other = kinds.select(*(F.col(c).alias(f"o_{c}") for c in kinds.columns))
    gap = F.abs(F.col("year") - F.col("o_year"))
    known = F.col("year").isNotNull() & F.col("o_year").isNotNull()
    kin, agree = works.same_first_author(F.col("author"), F.col("o_author")), works.authors_agree(F.col("author"), F.col("o_author"))
    several = (F.col("id") != F.col("o_id")) | (F.col("n") > 1)
    titled = kinds.join(other, F.col("t") == F.col("o_t")).where(several)

    def linked(df: DataFrame, n: int) -> DataFrame:
        found = df.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct()
        ends = found.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        every = found.where("a <> b").unionByName(members.join(ends, "id").select(F.col("id").alias("a"), F.col("member").alias("b")))
        return every.withColumn("pass", F.lit(n))

    fourth = linked(titled.where(F.col("secondary") & ~F.col("o_secondary") & known & (((gap <= near_years) & kin) | ((gap <= far_years) & agree))), 3)
    sixth = linked(titled.where((F.col("v") == F.col("o_v")) & (F.col("v") != "") & known & (gap <= 1) & kin & (F.col("id") <= F.col("o_id"))), 5)
    names = kinds.select(F.col("t").alias("doc_id"), F.col("t").alias("text")).distinct()
    weak = kinds.where("weak").select(F.col("t").alias("item_id"), F.col("t").alias("text")).distinct()
    held = passages.containing(names, weak).select(F.col("item_id").alias("x"), F.col("doc_id").alias("y"))
    holds = passages.containing(weak.toDF("doc_id", "text"), names.toDF("item_id", "text")).select(F.col("doc_id").alias("x"), F.col("item_id").alias("y"))
    fits = F.least(F.length("x"), F.length("y")) >= containment * F.greatest(F.length("x"), F.length("y"))
    both = held.unionByName(holds).distinct().where(fits).join(kinds.where("weak"), F.col("x") == F.col("t")).join(other, F.col("y") == F.col("o_t")).where(several)
    fifth = linked(both.where(known & (gap <= near_years) & kin), 4)
    out = same(0, F.col("doi")).unionByName(same(1, F.when(F.col("long") & F.col("year").isNotNull(), F.concat_ws("|", "t", F.col("year").cast("string")))))
    return out.unionByName(fourth).unionByName(fifth).unionByName(sixth)


#: Why a record was merged, by pass.
REASONS = ("same_doi", "same_title_year", "secondary_of_title", "weak_record_title_variant", "same_title_venue")


def dedupe_works(records: DataFrame) -> DataFrame:
    """``records`` (also cited) with survivor, the best record of what hangs together (no preprint, no repository copy, with DOI, with venue, most cited, earliest, smallest id), and the reason of a merged one: its first pass."""
    edges = materialise(work_edges(records), "edges_of_works")
    roots = connected_components(edges.select("a", "b"))
    named = records.join(roots, records["id"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "id")).drop("node", "root")
    flag = lambda c: F.when(c, 1).otherwise(0)
    rank = F.struct(flag(works.is_preprint(F.col("kind"), F.col("doi"))), flag(F.coalesce(F.col("source_type") == "repository", F.lit(False))), flag(normalise_doi(F.col("doi")).isNull()), flag(F.coalesce("venue", F.lit("")) == ""), -F.coalesce("cited", F.lit(0)), F.coalesce("year", F.lit(9999)), "id")
    best = named.groupBy("_root").agg(F.min_by("id", rank).alias("survivor"))
    ends = edges.select(F.col("a").alias("id"), "pass").unionByName(edges.select(F.col("b").alias("id"), "pass")).groupBy("id").agg(F.min("pass").alias("_p"))
    place = F.when(F.col("_p") < 2, F.col("_p")).otherwise(F.col("_p") - 1)
    out = named.join(best, "_root").join(ends, "id", "left").withColumn("reason", F.when(F.col("survivor") != F.col("id"), F.get(F.array(*(F.lit(x) for x in REASONS)), place.cast("int"))))
    return out.drop("_root", "_p")
