"""Who may see what: policies, scopes, visibility, and the kinds and families that records go by.

Rules are columns, or plans over all users, queries and documents at once. A policy is a struct of
residency, external_retrieval, runtimes, locations and tags.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Residencies from the freest to the strictest; statuses of documents that nobody sees; record kinds; source families; what counts as false.
RESIDENCIES = ("cloud_allowed", "local_preferred", "local_required")
HIDDEN = ("retired", "expired", "deleted", "inactive")
KINDS = ("doc_summary", "section_summary", "asset_summary", "grounded_doc", "grounded_section", "grounded_asset")
FAMILIES = ("dense", "sparse", "hybrid", "asset", "lexical", "fallback", "grounding", "unknown")
FALSE = ("0", "false", "no", "off")


def lits(*values: str) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def policy(residency: Column, external: Column, runtimes: Column, locations: Column, tags: Column) -> Column:
    return F.struct(residency.alias("residency"), external.alias("external_retrieval"), runtimes.alias("runtimes"), locations.alias("locations"), tags.alias("tags"))


def narrowed(a: Column, b: Column) -> Column:
    """Both policies at once: common runtimes and locations, the stricter residency, denial wins, all tags.

    null where no runtime or no location is common: such policies can't be narrowed.
    """
    runtimes, locations = (F.array_sort(F.array_intersect(a[c], b[c])) for c in ("runtimes", "locations"))
    strict = F.greatest(*(F.array_position(lits(*RESIDENCIES), p["residency"]) for p in (a, b)))
    external = F.when((a["external_retrieval"] == "deny") | (b["external_retrieval"] == "deny"), "deny").otherwise("allow")
    both = policy(F.element_at(lits(*RESIDENCIES), strict.cast("int")), external, runtimes, locations, F.array_sort(F.array_union(a["tags"], b["tags"])))
    return F.when((F.size(runtimes) > 0) & (F.size(locations) > 0), both)


def narrowed_or_fail(a: Column, b: Column) -> Column:
    """As `narrowed`, but an error where that is null."""
    return F.coalesce(narrowed(a, b), F.raise_error(F.lit("no runtime or location is left")))


def hinted(local_only: Column, no_external: Column) -> Column:
    """The policy that a query's hints ask for; null without a hint."""
    whole = policy(
        F.when(local_only, "local_required").otherwise("cloud_allowed"), F.when(local_only | no_external, "deny").otherwise("allow"), lits("deep", "fast"),
        F.when(local_only, lits("local")).otherwise(lits("cloud", "local")), lits(),
    )
    return F.when(local_only | no_external, whole)


def truthy(value: Column, default: bool = True) -> Column:
    """Whether a text says yes: all but 0, false, no and off; null is the default."""
    return F.when(value.isNull(), F.lit(default)).otherwise(~F.lower(F.trim(value.cast("string"))).isin(*FALSE))


def visible(is_active: Column, index_ready: Column, status: Column) -> Column:
    """Active, indexed and of no hidden status; an unknown flag counts as set."""
    return F.coalesce(is_active, F.lit(True)) & F.coalesce(index_ready, F.lit(True)) & ~F.lower(F.trim(F.coalesce(status, F.lit("")))).isin(*HIDDEN)


def desired_tier(is_active: Column, index_ready: Column, status: Column) -> Column:
    """cold for a document that is inactive, retired or not indexed."""
    cold = ~is_active | (F.lower(F.coalesce(status, F.lit(""))) == "retired") | ~index_ready
    return F.when(cold, "cold").otherwise("hot")


def tier_moves(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, tier, is_active, index_ready, status) whose tier isn't the desired one: doc_id, tier, wanted."""
    wanted = desired_tier(F.col("is_active"), F.col("index_ready"), F.col("status"))
    return documents.withColumn("wanted", wanted).where(~F.col("tier").eqNullSafe(F.col("wanted"))).select("doc_id", "tier", "wanted")


def guardrail(whitelist: Column | None = None, user: Column | None = None) -> Column:
    """What every search is filtered by: active and indexed rows, the documents of a whitelist, and the user's own condition."""
    out = F.col("is_active") & F.col("index_ready")
    for more in (whitelist, user):
        out = out if more is None else out & more
    return out


# --- scopes ------------------------------------------------------------------------------------


def allowed_documents(views: DataFrame, sources: DataFrame, documents: DataFrame) -> DataFrame:
    """user_id, doc_id that users may see: those of their views (user_id, doc_ids), and for a user without a
    view those of the sources (source_id, owner_id) that they own among documents (doc_id, source_id).

    Blank ids in a view don't count.
    """
    seen = views.select("user_id", F.explode("doc_ids").alias("doc_id")).where(F.trim(F.col("doc_id").cast("string")) != "")
    owned = sources.select(F.trim("owner_id").alias("user_id"), "source_id").join(documents.select("doc_id", "source_id"), "source_id").select("user_id", "doc_id")
    return seen.unionByName(owned.join(views.select("user_id").distinct(), "user_id", "left_anti")).distinct()


def authorized(requests: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of requests (user_id, doc_id, ...) that `allowed` (user_id, doc_id) has; a user of whom it has none isn't restricted.

    A null user_id is nobody in particular, who isn't restricted either.
    """
    known = allowed.select("user_id").distinct().withColumn("__known", F.lit(True))
    ok = allowed.select("user_id", "doc_id").distinct().withColumn("__ok", F.lit(True))
    marked = requests.join(known, "user_id", "left").join(ok, ["user_id", "doc_id"], "left")
    return marked.where(F.col("__known").isNull() | F.col("__ok")).select(*requests.columns)


def final_gate(evidence: DataFrame, documents: DataFrame, allowed: DataFrame, views: DataFrame, of_query: Column, of_document: Column) -> DataFrame:
    """The last check before an answer, of evidence (user_id, doc_id, ...).

    A named user whose view isn't resolved (not in `views`: user_id) gets nothing. Else a row stays if
    its document is there, visible (is_active, index_ready, status), allowed, and its policy can be
    narrowed by the query's; a null policy can.
    """
    resolved = views.select("user_id").distinct().withColumn("__resolved", F.lit(True))
    rows = authorized(evidence, allowed).join(resolved, "user_id", "left").where(F.col("user_id").isNull() | F.col("__resolved")).drop("__resolved")
    shown = documents.where(visible(F.col("is_active"), F.col("index_ready"), F.col("status")))
    ok = of_document.isNull() | of_query.isNull() | narrowed(of_query, of_document).isNotNull()
    return rows.join(shown.where(ok).select("doc_id").distinct(), "doc_id", "left_semi").select(*evidence.columns)


# --- candidates --------------------------------------------------------------------------------


def in_scope(tokens: Column, scope: Column) -> Column:
    """Whether one of a row's ids is in the scope; an empty scope has all."""
    return (F.size(scope) == 0) | F.arrays_overlap(tokens, scope)


def permitted(external: Column, external_policy: Column, runtimes: Column, mode: Column, locations: Column, allowed_locations: Column) -> Column:
    """External candidates need the policy's leave; a candidate's own runtimes and locations, where it has any, must suit."""
    return (~external | (external_policy == "allow")) & (runtimes.isNull() | F.array_contains(runtimes, mode)) & (locations.isNull() | F.arrays_overlap(locations, allowed_locations))


def pages_match(first: Column, last: Column, numbers: Sequence[int] = (), ranges: Sequence[tuple[int, int]] = ()) -> Column:
    """Whether pages first..last have one of the numbers or meet one of the ranges; without pages, or without a wish, all match."""
    lo, hi = F.coalesce(first, last), F.coalesce(last, first)
    met = [((lo <= n) & (hi >= n)) for n in numbers] + [((lo <= b) & (hi >= a)) for a, b in ranges]
    if not met:
        return F.lit(True)
    out = met[0]
    for m in met[1:]:
        out = out | m
    return lo.isNull() | out


def metadata_match(source_type: Column, file_name: Column, source_types: Sequence[str] = (), file_names: Sequence[str] = (), titles: Sequence[str] = ()) -> Column:
    """A null attribute passes."""
    out = F.lit(True)
    for value, wanted in ((source_type, source_types), (file_name, file_names), (file_name, titles)):
        if wanted:
            out = out & (value.isNull() | value.isin(*wanted))
    return out


def structure_match(path: Column, terms: Sequence[str]) -> Column:
    """Whether the joined path has one of the terms; a candidate without a path passes, and so do all without terms."""
    if not terms:
        return F.lit(True)
    text = F.lower(F.array_join(path, " "))
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(text, F.lit(t.lower()))
    return path.isNull() | (F.size(path) == 0) | found


def record_family(kind: Column, record_type: Column, channels: Column) -> Column:
    has = lambda *x: F.arrays_overlap(channels, lits(*x))
    asset = F.coalesce(F.startswith(record_type, F.lit("asset")), F.lit(False))
    return (
        F.when(kind == "external", "external").when(asset | has("special", "section", "metadata"), "multimodal").when((kind == "graph") | has("local", "global"), "kg")
        .when(has("vector") & has("sparse"), "hybrid").when(has("sparse"), "sparse").otherwise("vector")
    )


def candidate_kind(explicit: Column, target_kind: Column, target_asset: Column, asset_id: Column) -> Column:
    """The kind that is given, if it is one, else that of the target, else by whether there is an asset."""
    by_target = F.when((target_kind == "asset") | target_asset.isNotNull(), "asset_summary").when(target_kind == "doc", "doc_summary").otherwise("section_summary")
    return F.when(explicit.isin(*KINDS), explicit).when(target_kind.isNotNull(), by_target).when(asset_id.isNotNull(), "asset_summary").otherwise("section_summary")


def candidate_id(explicit: Column, kind: Column, target: Column, asset_id: Column, section_id: Column, item_id: Column, evidence_id: Column, doc_id: Column) -> Column:
    """An id by what is known, in this order: the given one, the target's (a struct of kind, asset_id, section_id, doc_id), asset, section, item, evidence, document."""
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    given = lambda c: F.when(F.length(c.cast("string")) > 0, F.concat(kind, F.lit(":"), c.cast("string")))
    return F.coalesce(
        F.when(F.length(explicit) > 0, explicit), F.when(target.isNotNull(), F.coalesce(name("asset:", target["asset_id"]), name("section:", target["section_id"]), name("doc:", target["doc_id"]))),
        name("asset:", asset_id), name("section:", section_id), given(item_id), given(evidence_id), F.concat(kind, F.lit(":doc:"), F.coalesce(doc_id, F.lit(0)).cast("string")),
    )


def source_family(explicit: Column, kind: Column, channels: Column, external: Column) -> Column:
    has = lambda *x: F.arrays_overlap(channels, lits(*x))
    return (
        F.when(explicit.isin(*FAMILIES), explicit).when((kind == "asset_summary") | has("asset", "special"), "asset").when(has("hybrid"), "hybrid").when(has("full_text"), "lexical")
        .when(has("sparse", "bm25"), "sparse").when(has("dense", "vector"), "dense").when(external, "fallback").otherwise("unknown")
    )


def rendered_candidate(title: Column, path: Column, parent_text: Column, text: Column) -> Column:
    """What a reranker reads: title, path, parent text and text, where there are any, apart by blank lines."""
    parts = F.array(*(F.trim(F.coalesce(c, F.lit(""))) for c in (title, F.array_join(F.coalesce(path, lits()), " > "), parent_text, text)))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n\n")


# --- contracts and invariants ------------------------------------------------------------------


def contract_differences(stored: Column, current: Column, keys: Sequence[str]) -> Column:
    """The keys on which two maps differ, those that one lacks included."""
    return F.filter(lits(*keys), lambda k: ~F.try_element_at(stored, k).eqNullSafe(F.try_element_at(current, k)))


def broken_ranges(**ranges: tuple[Column, Column]) -> Column:
    """Names of the ranges (first, end) that are empty, reversed or begin below 0; a range that is null in both is none."""
    bad = lambda a, b: ~(a.isNull() & b.isNull()) & ~F.coalesce((a >= 0) & (b > a), F.lit(False))
    return F.array_compact(F.array(*(F.when(bad(a, b), F.lit(n)) for n, (a, b) in ranges.items())))
