"""The read service on tables: filters by parameters, records of fixed shape, search over kinds, decisions on leads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.functions.scalars import iso_z
from pelagos.operators import filters, paging

# The states of a lead, what may follow what, and the reasons that closing asks for.
CLOSED = ("closed_explained", "closed_unexplained", "closed_false_alarm")
ALLOWED = {"new": ("reviewing", *CLOSED), "reviewing": CLOSED, **{c: ("reviewing",) for c in CLOSED}}
REASONS = {
    "closed_explained": ("no carriage requirement (size or type)", "VMS fleet", "outside AIS reach", "weather or sea clutter", "fixed structure", "fishing lights", "pilot or supply transfer", "other"),
    "closed_false_alarm": ("sea clutter", "rain cell", "fixed structure", "ambiguity or sidelobe", "duplicate", "other"),
}


def _plain(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "_", " ")
    return F.trim(F.regexp_replace(bare, r"\(note required\)$", ""))


def canonical_reason(to_state: Column, reason: Column) -> Column:
    """The listed reason that a text means (any case, underscores for spaces, the part before a bracket will do), else null."""
    out = F.lit(None).cast("string")
    for state, reasons in REASONS.items():
        for r in reversed(reasons):
            low = r.lower()
            out = F.when((to_state == state) & _plain(reason).isin(low, low.split(" (")[0]), r).otherwise(out)
    return out


def decision_problem(from_state: Column, to_state: Column, reason: Column, note: Column) -> Column:
    """Code of what is wrong with a decision, else null."""
    allowed = F.lit(False)
    for a, follow in ALLOWED.items():
        allowed = allowed | ((from_state == a) & to_state.isin(*follow))
    no_note = F.trim(F.coalesce(note, F.lit(""))) == ""
    named = canonical_reason(to_state, reason)
    return (
        F.when(~F.coalesce(allowed, F.lit(False)), "transition_not_allowed")
        .when(to_state.isin(*REASONS) & named.isNull(), "reason_required")
        .when(to_state.isin(*REASONS) & (named == "other") & no_note, "note_required")
        .when((to_state == "closed_unexplained") & no_note, "note_required")
        .when((to_state == "reviewing") & from_state.isin(*CLOSED) & no_note, "note_required")
    )


def replay(log: DataFrame, lead: str, order: str, first: str = "new") -> DataFrame:
    """(lead, state, n_applied): the state after all entries of a log in order; entries that do not follow from the state they find are passed by. A lead's log is short; it is folded in one expression."""
    rows = F.array_sort(F.collect_list(F.struct(order, "to_state", "reason", "note")))

    def step(acc: Column, x: Column) -> Column:
        good = decision_problem(acc["state"], x["to_state"], x["reason"], x["note"]).isNull()
        return F.struct(F.when(good, x["to_state"]).otherwise(acc["state"]).alias("state"), (acc["n"] + F.when(good, 1).otherwise(0)).alias("n"))

    folded = F.aggregate("rows", F.struct(F.lit(first).alias("state"), F.lit(0).alias("n")), step)
    return log.groupBy(lead).agg(rows.alias("rows")).select(lead, folded.alias("f")).select(lead, F.col("f.state").alias("state"), F.col("f.n").alias("n_applied"))


def list_query(df: DataFrame, params: dict[str, str], equals: dict[str, str], ranges: dict[str, tuple[str, str]], ts: str | None = None, sort: tuple[str, tuple[str, ...], str] | None = None) -> DataFrame:
    """Rows by request parameters: ``equals`` maps a parameter (comma-separated values) to a column, ``ranges`` to (column, 'min' or 'max'); bbox, since, until, sort, limit and offset as everywhere. Unknown parameters are an error."""
    known = {*equals, *ranges, "bbox", "since", "until", "sort", "limit", "offset"}
    if odd := set(params) - known:
        raise filters.BadParameter("bad_parameter", f"unknown parameters: {sorted(odd)}")
    out = df
    if ts or "bbox" in params:
        out = out.where(filters.mask_window(F.col(ts) if ts else F.current_timestamp(), F.col("lon"), F.col("lat"), params.get("since"), params.get("until"), filters.parse_bbox(params.get("bbox"))))
    for p, c in equals.items():
        if p in params:
            values = [x.strip() for x in params[p].split(",") if x.strip()]
            flag = dict(df.dtypes)[c] == "boolean"
            out = out.where(F.col(c).isin(*([filters.parse_bool(x) for x in values] if flag else values)))
    for p, (c, side) in ranges.items():
        if p in params:
            out = out.where(F.col(c) >= float(params[p]) if side == "min" else F.col(c) <= float(params[p]))
    if sort:
        default, allowed, tie = sort
        out = paging.page(paging.order_by(out, params.get("sort", default), allowed, tie), int(params.get("limit", 100)), int(params.get("offset", 0)))
    return out


def records(df: DataFrame, fields: list[tuple[str, str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """Records of a fixed order and shape: each field (name, kind) from its column, its default or null; times as text, NaN as null."""
    cols = []
    for name, kind in fields:
        x = F.col(name) if name in df.columns else F.lit((defaults or {}).get(name))
        if name in df.columns and defaults and name in defaults:
            x = F.coalesce(x, F.lit(defaults[name]))
        if kind == "time":
            x = iso_z(x)
        elif kind == "double":
            x = F.nanvl(x.cast("double"), F.lit(None).cast("double"))
        else:
            x = x.cast(kind)
        cols.append(x.alias(name))
    return df.select(*cols)


def search(kinds: list[tuple[str, DataFrame, str, str, float]], text: str, limit: int, short: int = 6) -> DataFrame:
    """(kind, id, label, score) over ``kinds`` (kind, table, id column, label column, score): ids that begin with the text, exact ones only for short texts; whole labels count 1, parts 0.6. The best ``limit``, ties by kind and id."""
    up = text.strip().upper()
    out = None
    for kind, df, key, label, score in kinds:
        ident, name = F.upper(F.col(key).cast("string")), F.upper(F.col(label).cast("string"))
        hit = (ident == up) if len(up) < short else ident.startswith(up)
        part = df.where(hit | name.contains(up)).select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.when(hit, score).when(name == up, 1.0).otherwise(0.6).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.desc("score"), "kind", "id").limit(limit)
