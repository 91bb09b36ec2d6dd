"""Facts of a budget's hierarchy and the reviewed details below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from centime.operators.hierarchy import mark_excluded
from centime.operators.paths import ancestor, node_path, under_scopes

KEY = ("year", "stage", "measure", "budget", "mission", "program")
LEVELS = ("mission", "program", "action", "subaction")


def facts_of(groups: DataFrame, parent: str = "parent", parents: str = "parents") -> DataFrame:
    """The distinct published facts that groups of details refer to; null ones are none."""
    one = groups.select(F.col(parent).alias("p"))
    several = groups.select(F.explode(parents).alias("p"))
    return one.unionByName(several).where("p IS NOT NULL").select("p.*").distinct()


def remap(rows: DataFrame, lineages: DataFrame, keys: list[str], column: str) -> DataFrame:
    """rows with a column replaced where a lineage names another value for it: keys, to_<column>, note. One row a key."""
    met = rows.join(lineages, keys, "left")
    return met.withColumn(column, F.coalesce(f"to_{column}", column)).drop(f"to_{column}")


def level_of(*levels: str) -> Column:
    """How many levels are filled, up to the first blank one."""
    depth = F.lit(len(levels))
    for i, c in reversed(list(enumerate(levels))):
        depth = F.when(F.coalesce(F.col(c), F.lit("")) == "", i).otherwise(depth)
    return depth


def nodes_of(groups: DataFrame) -> DataFrame:
    """Programme, actions and subactions of each group as rows: record_id, path, parent_path, depth (2 to 4), label, cents, source, page."""
    base = node_path("mission", "program")
    cents = F.coalesce(F.col("x.cents"), F.col("x.euros") * 100)
    program = groups.select("record_id", base.alias("path"), F.lit(None).cast("string").alias("parent_path"), F.lit(2).alias("depth"), F.col("parent.program_label").alias("label"),
                            (F.col("published_total_euros") * 100).alias("cents"), "source", "page")
    first = groups.select("record_id", base.alias("base"), "source", F.explode("actions").alias("x")).where("x IS NOT NULL")
    action = first.select("record_id", node_path("base", "x.code").alias("path"), F.col("base").alias("parent_path"), F.lit(3).alias("depth"), "x.label", cents.alias("cents"), "source", "x.page")
    second = first.select("record_id", node_path("base", "x.code").alias("above"), "source", F.explode("x.subactions").alias("x")).where("x IS NOT NULL")
    below = second.select("record_id", node_path("above", "x.code").alias("path"), F.col("above").alias("parent_path"), F.lit(4).alias("depth"), "x.label", cents.alias("cents"), "source", "x.page")
    return program.unionByName(action).unionByName(below)


def labelled_groups(rows: DataFrame, scope: str, depth: int, path: str = "path", label: str = "label", year: str = "year") -> DataFrame:
    """(node, label, rows): the nodes one level below a scope of `depth` levels, each with the label of its latest year (of several the greatest)."""
    from centime.operators.paths import within

    inside = rows.where(within(F.col(path), scope) & (F.size(F.split(path, "/")) > depth))
    named = F.max(F.when(F.size(F.split(path, "/")) == depth + 1, F.struct(year, label)))
    return inside.groupBy(ancestor(F.col(path), depth + 1).alias("node")).agg(named[label].alias("label"), F.count(F.lit(1)).alias("rows"))


def scope_cells(facts: DataFrame, scopes: DataFrame, years: DataFrame, stages: DataFrame, counted: tuple[str, ...]) -> DataFrame:
    """One cell for each scope, year and stage: value, programs, expected programs, status.

    Programs expected in a year are those of any stage in `counted`. Fewer than
    expected: partial, the value stays. No fact: missing, no value. Facts meet the
    scopes that hold them by their ancestors, so no pair of all is built.
    """
    held = under_scopes(facts, scopes)
    sums = held.groupBy("scope", "year", "stage").agg(F.sum("cents").alias("value"), F.countDistinct("program").alias("programs"))
    expected = held.where(F.col("stage").isin(*counted)).groupBy("scope", "year").agg(F.countDistinct("program").alias("expected"))
    grid = scopes.coalesce(1).crossJoin(years.coalesce(1)).crossJoin(stages.coalesce(1))  # three small dimensions, parameters of the query
    met = grid.join(sums, ["scope", "year", "stage"], "left").join(expected, ["scope", "year"], "left")
    programs, wanted = F.coalesce("programs", F.lit(0)), F.coalesce("expected", F.lit(0))
    status = F.when(F.col("value").isNull(), "missing").when(programs < wanted, "partial").otherwise("ok")
    return met.select("scope", "year", "stage", "value", programs.alias("programs"), wanted.alias("expected"), status.alias("status"))


def _print(row: Column | str, names: list[str]) -> Column:
    of = F.col(row) if isinstance(row, str) else row
    return F.concat_ws("|", *(F.coalesce(of[n].cast("string"), F.lit("~")) for n in names))


def review_status(groups: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    """(record_id, status): whether a group's details still hold.

    attached: the facts of the group's key are, as a multiset, exactly the parents it
    was reviewed against, and its source is there under its hash. Else
    parents_changed, or source_changed. sources: source, sha256. Parents are
    compared by all their members; a group without parents is parents_changed.
    """
    names = facts.columns
    listed = F.when(F.size(F.filter("parents", lambda p: p.isNotNull())) > 0, F.filter("parents", lambda p: p.isNotNull())).otherwise(F.array("parent"))
    wanted = groups.select("record_id", F.col("fiscal_year").alias("year"), "stage", "measure", "budget", "mission", "program", "source", "sha256",
                           F.array_sort(F.transform(F.filter(listed, lambda p: p.isNotNull()), lambda p: _print(p, names))).alias("_wanted"))
    held = facts.groupBy(*KEY).agg(F.array_sort(F.collect_list(_print(F.struct(*names), names))).alias("_held"))
    known = sources.select(F.col("source"), F.col("sha256").alias("_sha")).distinct()
    met = wanted.join(held, list(KEY), "left").join(known, "source", "left")
    same = (F.col("_wanted") == F.col("_held")) & (F.size("_wanted") > 0)
    status = F.when(F.coalesce(same, F.lit(False)), F.when(F.col("_sha") == F.col("sha256"), "attached").otherwise("source_changed")).otherwise("parents_changed")
    return met.groupBy("record_id").agg(F.min(status).alias("status"))


def merge_siblings(facts: DataFrame, active: DataFrame) -> DataFrame:
    """Facts of one key joined into one, but only for active keys: title and category blank, cents added, approximate if any is.

    Other facts stay as they are, with merged 1. An active key with one fact stays too.
    """
    marked = facts.join(active.select(*KEY).distinct().withColumn("_active", F.lit(True)), list(KEY), "left")
    part = F.when(F.col("_active"), F.lit("")).otherwise(F.concat_ws("|", F.coalesce("title", F.lit("~")), F.coalesce("category", F.lit("~")), "source", "line", "field", F.col("cents").cast("string")))
    grouped = marked.groupBy(*KEY, part.alias("_part")).agg(
        F.sum("cents").alias("cents"), F.max(F.coalesce("approximate", F.lit(0))).alias("approximate"), F.count(F.lit(1)).alias("merged"),
        F.when(F.count(F.lit(1)) > 1, F.lit("")).otherwise(F.max("title")).alias("title"),
    )
    return grouped.drop("_part")


def subtract(nodes: DataFrame, exclusions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(result, proofs) of taking exclusions (path) off the nodes of nodes_of.

    A branch whose parts are all excluded goes as a whole, with its own published
    figure and so its rounding residual; otherwise the excluded parts are taken off
    the parent. An exclusion inside another one has no effect. result: record_id,
    path, cents, status: fully_excluded (0), computed, unchanged, or
    detail_unavailable where an exclusion below the programme names no node of it,
    or a part to be taken off has no figure. proofs: record_id, path, cents
    (signed), operation: the published figure, and each part taken off.
    """
    marked = mark_excluded(nodes, exclusions).withColumnRenamed("_gone", "gone")
    sub = marked.where("depth = 4").groupBy("record_id", F.col("parent_path").alias("path")).agg(
        F.count(F.lit(1)).alias("_all"), F.count(F.when(F.col("gone"), 1)).alias("_gone"), F.sum(F.when(F.col("gone"), F.col("cents"))).alias("_off"),
        F.count(F.when(F.col("gone") & F.col("cents").isNull(), 1)).alias("_unknown"),
    )
    action = marked.where("depth = 3").join(sub, ["record_id", "path"], "left")
    whole = F.col("gone") | F.coalesce(F.col("_gone") == F.col("_all"), F.lit(False))
    off = F.when(whole, F.col("cents")).when(F.coalesce("_gone", F.lit(0)) > 0, F.col("_off"))
    unknown = F.when(whole, F.col("cents").isNull()).otherwise(F.coalesce(F.col("_unknown") > 0, F.lit(False)))
    action = action.select("record_id", "path", "parent_path", "cents", whole.alias("whole"), off.alias("off"), unknown.alias("unknown"))
    sums = action.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("_actions"), F.count(F.when(F.col("whole"), 1)).alias("_whole"), F.sum("off").alias("_off"), F.count("off").alias("_parts"), F.count(F.when(F.col("unknown"), 1)).alias("_unknown")
    )
    # exclusions strictly below a programme that no node of the group is
    outer = exclusions.select("path").distinct()
    inner = outer.withColumn("_up", F.explode(F.filter(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda d: ancestor(F.col("path"), d)), lambda a: a != F.col("path"))))
    inner = inner.join(outer.select(F.col("path").alias("_up")), "_up", "left_semi").select("path")
    fine = outer.join(inner, "path", "left_anti").withColumn("_base", ancestor(F.col("path"), 2)).where("_base <> path")
    program = marked.where("depth = 2").select("record_id", "path", "cents", "gone")
    asked = program.select("record_id", F.col("path").alias("_base")).join(fine, "_base")
    lost = asked.join(marked.select("record_id", "path"), ["record_id", "path"], "left_anti").select("record_id").distinct().withColumn("_lost", F.lit(True))
    met = program.join(sums, "record_id", "left").join(lost, "record_id", "left")
    full = F.col("gone") | F.coalesce(F.col("_whole") == F.col("_actions"), F.lit(False))
    unclear = F.coalesce("_lost", F.lit(False)) | (F.coalesce("_unknown", F.lit(0)) > 0)
    status = F.when(F.col("gone"), "fully_excluded").when(unclear, "detail_unavailable").when(full, "fully_excluded").when(F.coalesce("_parts", F.lit(0)) > 0, "computed").otherwise("unchanged")
    result = met.withColumn("status", status).select(
        "record_id", "path", F.when(F.col("status") == "fully_excluded", F.lit(0).cast("bigint")).when(F.col("status") == "computed", F.col("cents") - F.col("_off")).when(F.col("status") == "unchanged", F.col("cents")).alias("cents"), "status"
    )
    computed = result.where("status = 'computed'").select("record_id")
    taken = action.where("whole").select("record_id", "path", "cents")
    parts = marked.where("depth = 4 AND gone").select("record_id", "path", "parent_path", "cents").join(action.where("whole").select("record_id", F.col("path").alias("parent_path")), ["record_id", "parent_path"], "left_anti")
    taken = taken.unionByName(parts.select("record_id", "path", "cents")).join(computed, "record_id", "left_semi")
    kept = result.where("status <> 'detail_unavailable' AND status <> 'fully_excluded'").select("record_id").join(program, "record_id").select("record_id", "path", "cents", F.lit("published").alias("operation"))
    proofs = kept.unionByName(taken.select("record_id", "path", (-F.col("cents")).alias("cents"), F.lit("subtract").alias("operation")))
    return result, proofs


def apply_changes(current: DataFrame, changes: DataFrame, key: list[str], value: str) -> DataFrame:
    """Each change (key, before, after) against the current rows of its key: applied, value_changed, missing or ambiguous, and the impact in cents.

    A change applies only where exactly one current row has its key and still has
    the value the change was reviewed on.
    """
    held = current.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.max(value).alias("_value"))
    met = changes.join(held, key, "left")
    status = F.when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").when(F.col("_value").eqNullSafe(F.col("before")), "applied").otherwise("value_changed")
    met = met.withColumn("status", status)
    return met.withColumn("impact", F.when(F.col("status") == "applied", F.col("after") - F.col("before"))).drop("_n", "_value")


def numbered(rows: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Places from 1 within groups, for orders that are part of a result."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
