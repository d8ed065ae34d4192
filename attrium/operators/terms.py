"""Synonym groups: weighted frequencies, preferred terms and their use in names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from .core import cut
from .matching import cut_at_terms, find_terms

#: Labels of actions, and what a reason says of terms that were unified.
KEPT, NORMALIZED = "유지", "정규화"
UNIFIED = "용어 통일 빈도 기준 "


def check_rules(glossary: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Issues of rule tables: code and name. glossary: source, target; synonyms: group_id, candidate."""
    many = lambda df, key, code: df.groupBy(key).count().filter("count > 1").select(F.lit(code).alias("code"), F.col(key).alias("name"))
    out = many(glossary, "source", "duplicate_source")
    out = out.unionByName(glossary.filter(F.coalesce(F.trim("target"), F.lit("")) == "").select(F.lit("empty_target").alias("code"), F.col("source").alias("name")))
    per = synonyms.groupBy("group_id").agg(F.count_distinct("candidate").alias("k"), F.count("*").alias("n"))
    out = out.unionByName(per.filter("k < 2").select(F.lit("few_candidates").alias("code"), F.col("group_id").alias("name")))
    out = out.unionByName(per.filter("n > k").select(F.lit("duplicate_candidate").alias("code"), F.col("group_id").alias("name")))
    return out.unionByName(many(synonyms.select("group_id", "candidate").distinct(), "candidate", "candidate_in_two_groups"))


def synonym_frequency(units: DataFrame, synonyms: DataFrame) -> DataFrame:
    """units: source_id, units (array), weight. Weighted number of units that are each candidate; zero if none."""
    counts = units.select("weight", F.explode("units").alias("candidate")).groupBy("candidate").agg(F.sum("weight").alias("n"))
    return synonyms.join(counts, "candidate", "left").select("group_id", "candidate", "candidate_order", F.coalesce("n", F.lit(0)).cast("long").alias("frequency"))


#: A tie rule: gets the winners (array, as listed) and gives one of them, or null to leave it to the context.
Resolver = Callable[[Column], Column]


def first_listed(winners: Column) -> Column:
    return winners[0]


def _resolved(winners: Column, resolver: Resolver | None) -> Column:
    """What the resolver says, which must be a winner; null without one."""
    if resolver is None:
        return F.lit(None).cast("string")
    said = resolver(winners)
    return F.when(said.isNull() | F.array_contains(winners, said), said).otherwise(F.raise_error("the tie rule gave none of the winners").cast("string"))


def term_groups(frequency: DataFrame) -> DataFrame:
    """Of each group: candidates and winners (those of the greatest frequency) as listed, frequency, frequencies."""
    rows = frequency.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("candidate_order", "candidate", "frequency"))).alias("c"))  # a group is a handful of words
    rows = rows.withColumn("top", F.array_max(F.transform("c", lambda x: x["frequency"])))
    return rows.select(
        "group_id",
        F.transform("c", lambda x: x["candidate"]).alias("candidates"),
        F.transform(F.filter("c", lambda x: x["frequency"] == F.col("top")), lambda x: x["candidate"]).alias("winners"),
        F.col("top").alias("frequency"),
        F.map_from_arrays(F.transform("c", lambda x: x["candidate"]), F.transform("c", lambda x: x["frequency"])).alias("frequencies"),
    )


def select_preferred_term(frequency: DataFrame, resolver: Resolver | None = None) -> DataFrame:
    """The most frequent candidate of each group; among equals what the resolver says, else the first in order."""
    tied, said = F.size("winners") > 1, _resolved(F.col("winners"), resolver)
    return term_groups(frequency).select(
        "group_id",
        F.when(tied, F.coalesce(said, F.array_min("winners"))).otherwise(F.col("winners")[0]).alias("selected_term"),
        "frequency",
        tied.alias("tied"),
        F.when(~tied, "frequency").when(said.isNotNull(), "context_resolver").otherwise("deterministic_fallback").alias("selection_source"),
    )


#: Candidates that go to all rows with their groups; of more, each row gets those that it has.
MOST_CANDIDATES = 10_000


def _all_rules(results: DataFrame, groups: DataFrame) -> DataFrame:
    """results with _of, the group of each candidate, and _rules, what is known of each group: the same maps for all rows."""
    of = groups.select(F.explode("candidates").alias("candidate"), "group_id").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "group_id"))).alias("_of"))
    rules = groups.agg(F.map_from_entries(F.collect_list(F.struct("group_id", F.struct("group_id", "winners", "frequency", "frequencies")))).alias("_rules")).crossJoin(of)  # one row a side
    return results.crossJoin(F.broadcast(rules))


def _own_rules(results: DataFrame, groups: DataFrame) -> DataFrame:
    """The same with maps of each row's own candidates and groups. Rows without any aren't shuffled for them."""
    rows, groups = cut(results.withColumn("_row", F.monotonically_increasing_id())), cut(groups)
    of = groups.select("group_id", F.explode("candidates").alias("candidate"))
    hits = cut(rows.select("_row", F.explode(F.array_distinct("units")).alias("candidate")).join(of, "candidate"))
    own = hits.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("candidate", "group_id"))).alias("_of"))
    rules = hits.select("_row", "group_id").distinct().join(groups, "group_id")
    rules = rules.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("group_id", F.struct("group_id", "winners", "frequency", "frequencies")))).alias("_rules"))
    return rows.join(own.join(rules, "_row"), "_row", "left").drop("_row")


#: Points of a tied term for each column of its row that holds it.
EVIDENCE = {"original_description": 8, "table_name": 3, "table_description": 2, "units": 1}


def reconcile_terms(results: DataFrame, synonyms: DataFrame, population: DataFrame | None = None, resolver: Resolver | None = None, most: int = MOST_CANDIDATES, evidence: dict[str, int] = EVIDENCE) -> tuple[DataFrame, DataFrame]:
    """results with each unit that is a candidate replaced by its group's preferred term, and the decisions.

    results: source_id, units, weight, and where they matter original_description, table_name,
    table_description, action, reason. Frequencies come from population (units, weight), by default results.
    A tie is settled by the resolver, else by the row's own texts (evidence: the points of each; empty: they
    aren't asked), else in order. Adds name (the units joined) and replaced;
    a changed row that was kept counts as normalised, and its reason says so. Decisions: source_id, group_id,
    selected_term, frequency, frequencies, tied, selection_source, for the groups that a row has units of.

    With up to `most` candidates rows aren't shuffled: the rules go to them. More candidates meet the units in a join."""
    groups = term_groups(synonym_frequency(population if population is not None else results, synonyms))
    ruled = (_all_rules if synonyms.count() <= most else _own_rules)(results, groups)
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in results.columns else F.lit("")

    def score(winners: Column, term: Column) -> Column:
        holds = lambda c: F.array_contains("units", term) if c == "units" else X.contains_distinct(text(c), term, winners)
        return reduce(Column.__add__, [F.when(holds(c), points).otherwise(0) for c, points in evidence.items()])

    def by_context(winners: Column) -> Column:
        if not evidence:
            return F.lit(None).cast("string")
        scored = F.transform(winners, lambda t: F.struct(score(winners, t).alias("s"), t.alias("t")))
        return X.let(scored, lambda z: X.let(F.filter(z, lambda x: (x["s"] > 0) & (x["s"] == F.array_max(F.transform(z, lambda y: y["s"])))), lambda best: F.when(F.size(best) == 1, best[0]["t"])))

    def decision(g: Column) -> Column:
        winners, tied = g["winners"], F.size(g["winners"]) > 1
        said = F.struct(_resolved(winners, resolver).alias("r"), by_context(winners).alias("c"))

        def made(x: Column) -> Column:
            term = F.when(~tied, winners[0]).otherwise(F.coalesce(x["r"], x["c"], F.array_min(winners)))
            source = F.when(~tied, "frequency").when(x["r"].isNotNull(), "context_resolver").when(x["c"].isNotNull(), "context_evidence").otherwise("deterministic_fallback")
            return F.struct(g["group_id"].alias("group_id"), term.alias("selected_term"), g["frequency"].alias("frequency"), g["frequencies"].alias("frequencies"), tied.alias("tied"), source.alias("selection_source"))

        return F.when(tied, X.let(said, made)).otherwise(made(F.struct(F.lit(None).cast("string").alias("r"), F.lit(None).cast("string").alias("c"))))

    rows = ruled.withColumn("_hits", F.transform("units", lambda u: F.try_element_at("_of", u)))
    rows = rows.withColumn("_decisions", F.transform(F.array_sort(F.array_distinct(F.array_compact("_hits"))), lambda g: X.let(F.try_element_at("_rules", g), decision)))
    to = F.map_from_arrays(F.transform("_decisions", lambda d: d["group_id"]), F.transform("_decisions", lambda d: d["selected_term"]))
    # bound by let(), as the optimiser would work the map out again for each unit
    parts = F.struct(to.alias("to"), F.col("units").alias("units"), F.col("_hits").alias("hits"))

    def taken(u: Column, term: Column, h: Column) -> Column:
        """The unit that comes, and the group if it is another one."""
        return F.struct(F.coalesce(term, u).alias("unit"), F.when(term != u, h).alias("group"))

    changes = X.let(parts, lambda z: F.zip_with(z["units"], z["hits"], lambda u, h: F.when(h.isNull(), F.struct(u.alias("unit"), F.lit(None).cast("string").alias("group"))).otherwise(taken(u, F.try_element_at(z["to"], h), h))))
    rows = rows.withColumn("_changes", F.when(F.size("_decisions") > 0, changes))
    rows = rows.withColumns({"_new": F.coalesce(F.col("_changes")["unit"], F.col("units")), "_groups": F.coalesce(F.array_compact(F.col("_changes")["group"]), F.array().cast("array<string>"))})
    rows = rows.withColumn("replaced", F.size("_groups"))
    # a reason names the groups that changed a unit
    changed = X.let(F.struct(F.array_distinct("_groups").alias("groups"), F.col("_decisions").alias("all")), lambda z: F.filter(z["all"], lambda d: F.array_contains(z["groups"], d["group_id"])))
    note = F.concat(F.lit(UNIFIED), F.array_join(F.transform(changed, lambda d: F.concat(d["group_id"], F.lit(":"), d["selected_term"], F.lit(" ("), d["selection_source"], F.lit(")"))), ", "))
    rows = rows.withColumn("_note", note)
    new = {"units": F.col("_new"), "name": F.array_join("_new", "")}
    if {"action", "reason"} <= set(results.columns):
        kept, why = F.col("action") == KEPT, F.coalesce("reason", F.lit(""))
        new["reason"] = F.when(F.col("replaced") == 0, F.col("reason")).when(kept | (why == ""), note).otherwise(F.concat(why, F.lit("; "), note))
        new["action"] = F.when((F.col("replaced") > 0) & kept, NORMALIZED).otherwise(F.col("action"))
    out = rows.withColumns(new).select(*[c for c in results.columns if c != "name"], "name", "replaced")
    return out, rows.select("source_id", F.explode("_decisions").alias("d")).select("source_id", "d.*")


def units_at_terms(df: DataFrame, rules: DataFrame, text_col: str = "name") -> DataFrame:
    """df with units: the text cut at the candidates of rules, of any number, the longest first; what lies between them
    stays whole, and a text without any is one unit."""
    return cut_at_terms(df, rules, text_col)


def surface_sources(df: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """term, source_id, n: longest-first, non-overlapping occurrences of terms in each description. terms: a list, or a
    table of candidates of any size."""
    rules = terms.select("candidate") if isinstance(terms, DataFrame) else df.sparkSession.createDataFrame([(t,) for t in terms], "candidate string")
    each = find_terms(df, rules.withColumn("group_id", F.lit("")))
    return each.groupBy(F.col("candidate").alias("term"), "source_id").agg(F.count("*").alias("n"))


def surface_frequency(df: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """Occurrences of terms in descriptions, and how many rows hold them (surface_sources has which)."""
    return surface_sources(df, terms).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("n_sources"))


def comment_issues(results: DataFrame) -> DataFrame:
    """results: source_id, column_description, original_description, name, action, reason; review_reasons,
    added_concepts and removed_concepts may be left out and then count as empty. Rules on source, characters,
    numbers, action and slashes: code and severity. Without a name nothing further is looked at."""
    source, name = F.coalesce("column_description", F.lit("")), F.coalesce("name", F.lit(""))
    named, kept = name != "", F.coalesce(F.col("action") == KEPT, F.lit(False))
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0 if c in results.columns else F.lit(False)
    reasoned, slash = X.trim_all(F.coalesce("reason", F.lit(""))) != "", F.contains(source, F.lit("/"))
    alternatives = F.filter(F.split(source, "/"), lambda p: p != "")
    tests = {
        "empty_source_description": X.trim_all(source) == "",
        "original_description_mismatch": ~F.col("original_description").eqNullSafe(F.col("column_description")),
        "empty_korean_attribute_name": ~named,
        "whitespace_not_allowed": named & F.rlike(name, F.lit(r"(?U)\s")),
        "noncanonical_unicode": named & (X.nfkc(name) != name),
        "english_not_allowed": named & (F.size(X.invalid_english_tokens(name)) > 0),
        "symbol_not_allowed": named & (F.size(X.symbols_in(name)) > 0),
        "invalid_character": named & F.rlike(X.nfkc(name), F.lit(rf"(?U)[^A-Za-z0-9{X.HANGUL}\s\p{{P}}\p{{S}}]")),
        "numeric_sequence_mismatch": named & ~X.digits_preserved(source, name),
        "keep_result_changed": named & kept & (name != source),
        "change_reason_missing": named & ~kept & ~reasoned,
        "semantic_scope_change_reported": named & (filled("added_concepts") | filled("removed_concepts")),
        "slash_selection_evidence_missing": named & slash & ~(reasoned & filled("review_reasons")),
        "slash_alternatives_not_resolved": named & slash & reasoned & filled("review_reasons") & F.forall(alternatives, lambda p: F.contains(name, p)),
    }
    codes = F.filter(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    out = results.select("source_id", F.explode(codes).alias("code"))
    return out.withColumn("severity", F.when(F.col("code") == "semantic_scope_change_reported", "warning").otherwise("error"))
