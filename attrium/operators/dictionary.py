"""Abbreviation dictionaries: mining, unification, senses, segmentation and naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X
from .core import consistency, cut, dedup_sources, fan_out, issue, merged, union_issues

KEY = ["abbreviation", "full_name", "korean_word"]
#: Names at the end of which the last abbreviation scores higher.
SUFFIXES = ("CD", "NO", "DT", "HMS", "AMT", "CT", "YN", "NM", "SEQ", "SNO", "SEQNO", "FLGCD")


def canonical_dictionary(df: DataFrame) -> DataFrame:
    """Of each (abbreviation, Korean key) the entry with the highest count, the first row among equals."""
    rows = df.withColumns({"abbreviation": X.upper_trim(F.col("abbreviation")), "korean_key": X.normalize_korean_key(F.col("korean_word"))})
    best = rows.groupBy("abbreviation", "korean_key").agg(F.min_by(F.struct("full_name", "occurrence_count"), F.struct(-F.col("occurrence_count"), F.col("row_no"))).alias("e"))
    return best.select("abbreviation", "korean_key", "e.full_name", "e.occurrence_count")


def canonical_lookup(candidates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """candidates with canonical: the dictionary's full name for their abbreviation and Korean key, if it has one."""
    known = canonical_dictionary(dictionary).select(F.col("abbreviation").alias("_a"), "korean_key", F.col("full_name").alias("canonical"))
    rows = candidates.withColumns({"_a": X.upper_trim(F.col("abbreviation")), "korean_key": X.normalize_korean_key(F.col("korean_word"))})
    return rows.join(known, ["_a", "korean_key"], "left").select(*candidates.columns, "canonical")


def reconcile_full_name(candidates: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Candidates with one full name for each (abbreviation, Korean key): the dictionary's, else that of
    most distinct sources, the smallest among equals. cause: dictionary, majority or '' (unchanged)."""
    rows = candidates.withColumn("korean_key", X.normalize_korean_key(F.col("korean_word")))
    votes = rows.groupBy("abbreviation", "korean_key", "full_name").agg(F.count_distinct("source_id").alias("n"))
    target = votes.groupBy("abbreviation", "korean_key").agg(F.min_by("full_name", F.struct(-F.col("n"), F.col("full_name"))).alias("majority"))
    if dictionary is not None:
        known = canonical_dictionary(dictionary).select("abbreviation", "korean_key", F.col("full_name").alias("known"))
        target = target.join(known, ["abbreviation", "korean_key"], "left")
    else:
        target = target.withColumn("known", F.lit(None).cast("string"))
    out = rows.join(target, ["abbreviation", "korean_key"])
    new = F.coalesce("known", "majority")
    cause = F.when(F.col("full_name") == new, "").when(F.col("known").isNotNull(), "dictionary").otherwise("majority")
    return out.select("source_id", "abbreviation", new.alias("full_name"), "korean_word", cause.alias("cause"))


def aggregate_dictionary(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy(*KEY).agg(F.count_distinct("source_id").alias("occurrence_count"))


def mine_dictionary(sources: DataFrame, candidates: DataFrame, dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Proposals of representatives to a counted dictionary, and the failed rows: fan out, unify, check, take
    what the checks recommend, check again, part, count. Proposals for unknown ids are left out."""
    aliases = dedup_sources(sources, "mapping")
    own = fan_out(candidates.join(sources.select("source_id").distinct(), "source_id", "left_semi"), aliases)
    unified = cut(reconcile_full_name(own, dictionary).drop("cause"))
    corrected = cut(recommended_corrections(unified, mapping_issues(sources, unified, dictionary)))
    failed, good = partition_failed(sources, corrected, mapping_issues(sources, corrected, dictionary))
    return aggregate_dictionary(good), failed


def dictionary_index(df: DataFrame) -> DataFrame:
    rows = df.dropDuplicates([*KEY, "occurrence_count"])
    rank = F.row_number().over(Window.partitionBy("abbreviation").orderBy(F.desc("occurrence_count"), "full_name", "korean_word"))
    return rows.select(*KEY, "occurrence_count", rank.alias("rank"))


def ambiguous(df: DataFrame, value: str) -> DataFrame:
    return consistency(df, ["abbreviation"], F.col(value)).select("abbreviation", "n_values")


def dictionary_profile(df: DataFrame) -> DataFrame:
    per = df.groupBy("abbreviation").agg(F.count("*").alias("n"), F.count_distinct("korean_word").alias("k"), F.count_distinct("full_name").alias("f"))
    return per.agg(F.sum("n").alias("entries"), F.count("*").alias("abbreviations"), F.count_if(F.expr("k > 1")).alias("ambiguous_korean"), F.count_if(F.expr("f > 1")).alias("ambiguous_full_name"))


def resolve_sense(fragments: DataFrame, dictionary: DataFrame) -> DataFrame:
    """fragments: fragment, table_name, table_description. The best sense of each, with its context score
    (log count, +8 if the table's description holds the Korean word, both without spaces and the like, +2 if its
    name and the full name share a part of A-Z and 0-9), and
    whether it is ambiguous: tied here, or of several meanings anywhere."""
    d = dictionary.dropDuplicates([*KEY, "occurrence_count"])
    many = d.groupBy("abbreviation").agg((F.count_distinct("korean_word", "full_name") > 1).alias("many"))
    rows = fragments.distinct().join(d, F.col("fragment") == F.col("abbreviation")).drop("fragment")
    word = X.normalize_korean_key(F.col("korean_word"))
    in_text = F.coalesce((word != "") & F.contains(X.normalize_korean_key(F.col("table_description")), word), F.lit(False))
    parts = lambda c: F.filter(F.split(c, "[^A-Z0-9]+"), lambda x: x != "")
    shared = F.coalesce(F.arrays_overlap(parts(F.col("full_name")), parts(F.upper("table_name"))), F.lit(False))
    score = F.bround(F.log1p(F.col("occurrence_count").cast("double")) + 8 * in_text.cast("int") + 2 * shared.cast("int"), 6)
    rows = rows.withColumn("score", score)
    by = Window.partitionBy("abbreviation", "table_name", "table_description")
    best = rows.select("*", F.row_number().over(by.orderBy(F.desc("score"), F.desc("occurrence_count"), "full_name", "korean_word")).alias("k")).filter("k = 1").drop("k")
    return best.join(many, "abbreviation").withColumnRenamed("abbreviation", "fragment")


WIDE = 24  # ways that are kept from each place of a token to its end

#: A way through a token or a name: what it is ranked by (most covered, highest score, fewest components, then their
#: texts), the score itself and how many of its senses are ambiguous.
PART = "struct<fragment:string,full:string,korean:string,origin:string>"
WAY = f"struct<covered:int,rank:double,size:int,parts:array<{PART}>,score:double,ambiguity:int>"


def _way(covered: Column, score: Column, parts: Column, ambiguity: Column) -> Column:
    return F.struct(covered.cast("int").alias("covered"), (-F.round(score, 6)).alias("rank"), F.size(parts).alias("size"), parts.alias("parts"), score.alias("score"), ambiguity.cast("int").alias("ambiguity"))


def _none() -> Column:
    """The way through nothing."""
    return F.array(_way(F.lit(0), F.lit(0.0), F.array().cast(f"array<{PART}>"), F.lit(0)))


def _steps(token: Column, edges: Column) -> Column:
    """Of each place of the token the steps that begin there: dictionary entries, a run of digits, and the letter itself
    as unknown."""
    n = F.length(token)
    part = lambda fragment, full, korean, origin: F.struct(fragment.alias("fragment"), full.alias("full"), korean.alias("korean"), F.lit(origin).alias("origin"))
    step = lambda end, covered, score, what, many: F.struct(end.cast("int").alias("end"), covered.cast("int").alias("covered"), score.cast("double").alias("score"), what.alias("part"), many.cast("int").alias("many"))

    def entry(e: Column) -> Column:
        size, many = e["end"] - e["start"], F.coalesce(e["many"], F.lit(False)).cast("int")
        fragment = F.substring(token, e["start"] + 1, size)
        last = (e["end"] == n) & fragment.isin(*SUFFIXES)
        return step(e["end"], size, 10 * size + size * size + F.log1p(e["n"].cast("double")) - 1 - 3 * many + F.when(last, 4).otherwise(0), part(fragment, e["full_name"], e["korean_word"], "mapping"), many)

    def at(i: Column) -> Column:
        digits = F.regexp_extract(F.substring(token, i + 1, n), "^[0-9]+", 0)
        letter, size = F.substring(token, i + 1, F.lit(1)), F.length(digits)
        own = F.array(step(i + 1, F.lit(0), F.lit(-20.0), part(letter, letter, F.lit(""), "inference"), F.lit(0)))
        run = F.when(digits != "", F.array(step(i + size, size, 0.5 * size, part(digits, digits, digits, "numeric"), F.lit(0)))).otherwise(F.slice(own, 1, 0))
        return F.concat(F.transform(F.filter(edges, lambda e: e["start"] == i), entry), run, own)

    return F.transform(F.sequence(F.lit(0), n - 1), at)


def _token_ways(token: Column, edges: Column, k: int) -> Column:
    """The k best ways through a token. From its end to its start, each place has the WIDE best ways of its steps with
    the ways from where they end; unknown letters that follow each other are one component."""
    n = F.length(token)

    def with_tail(step: Column, tail: Column) -> Column:
        first = F.try_element_at(tail["parts"], F.lit(1))
        merge = (step["part"]["origin"] == "inference") & F.coalesce(first["origin"] == "inference", F.lit(False))
        joined = F.concat(step["part"]["fragment"], first["fragment"])
        one = F.struct(joined.alias("fragment"), joined.alias("full"), F.lit("").alias("korean"), F.lit("inference").alias("origin"))
        parts = F.when(merge, F.concat(F.array(one), F.slice(tail["parts"], 2, 1 << 20))).otherwise(F.concat(F.array(step["part"]), tail["parts"]))
        return _way(tail["covered"] - step["covered"], tail["score"] + step["score"], parts, tail["ambiguity"] + step["many"])

    def place(tails: Column, steps: Column) -> Column:
        # tails: of this place's right neighbour first, of the end last
        to = lambda step: F.element_at(tails, (step["end"] - n + F.size(tails)).cast("int"))
        found = F.flatten(F.transform(steps, lambda step: F.transform(to(step), lambda tail: with_tail(step, tail))))
        return F.concat(F.array(F.slice(F.array_sort(found), 1, WIDE)), tails)

    start = F.array(_none()).cast(f"array<array<{WAY}>>")
    return F.slice(F.aggregate(F.reverse(_steps(token, edges)), start, lambda tails, steps: place(tails, steps).cast(f"array<array<{WAY}>>"))[0], 1, k)


def _name_ways(tokens: Column, k: int) -> Column:
    """The k best combinations of the ways of a name's tokens; the rank adds up, so pruning to k at each is exact."""
    both = lambda a, b: _way(a["covered"] + b["covered"], a["score"] + F.round(b["score"], 6), F.concat(a["parts"], b["parts"]), a["ambiguity"] + b["ambiguity"])
    more = lambda done, ways: F.slice(F.array_sort(F.flatten(F.transform(done, lambda a: F.transform(ways, lambda b: both(a, b))))), 1, k)
    return F.aggregate(tokens, _none().cast(f"array<{WAY}>"), lambda done, ways: more(done, ways).cast(f"array<{WAY}>"))


def segment_names(names: DataFrame, dictionary: DataFrame, k: int = 8) -> DataFrame:
    """names: column_name, table_name, table_description. The k best segmentations of each distinct name.

    Substrings of distinct tokens, no longer than the longest abbreviation, meet the dictionary in an
    equi-join; senses are resolved once for each (fragment, table). Each (token, table) then has its lattice of
    edges in one row. Ways are worked out once for each distinct lattice, and those of names once for each distinct
    list of lattices; a hash of 128 bits stands for either, so that neither goes through a shuffle but once. Null names and
    tables count as empty; a name without A-Z0-9
    has no row. Columns: the inputs, rank, covered (characters in dictionary or digit pieces), score,
    fragments, full_names, korean_words, origins, ambiguity."""
    key = ["column_name", "table_name", "table_description"]
    rows = names.select(*[F.coalesce(c, F.lit("")).alias(c) for c in key]).distinct()
    tokens = rows.select(*key, F.posexplode(F.regexp_extract_all(F.upper("column_name"), F.lit("[A-Z0-9]+"), 0)).alias("pos", "token"))
    each = tokens.select("token", "table_name", "table_description").distinct()
    n = F.length("token")
    longest = F.broadcast(dictionary.agg(F.coalesce(F.max(F.length("abbreviation")), F.lit(1)).alias("longest")))  # one row
    starts = each.crossJoin(longest).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("start"))
    parts = starts.select("*", F.explode(F.sequence(F.col("start") + 1, F.least(n, F.col("start") + F.col("longest")))).alias("end")).withColumn("fragment", F.expr("substring(token, start + 1, end - start)"))
    parts = parts.filter((F.length("fragment") > 1) | (n == 1)).drop("longest")
    known = dictionary.select(F.col("abbreviation").alias("fragment")).distinct()
    hits = parts.join(known, "fragment", "left_semi")
    senses = resolve_sense(hits.select("fragment", "table_name", "table_description"), dictionary)
    edges = hits.join(merged(senses), ["fragment", "table_name", "table_description"]).select(
        "token", "table_name", "table_description", F.struct("start", "end", "full_name", "korean_word", F.col("occurrence_count").cast("int").alias("n"), "many").alias("e")
    )
    lattice = each.join(merged(edges.groupBy("token", "table_name", "table_description").agg(F.sort_array(F.collect_list("e")).alias("edges"))), ["token", "table_name", "table_description"], "left")
    lattice = lattice.withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<start:int,end:int,full_name:string,korean_word:string,n:int,many:boolean>>")))
    lattice = cut(lattice.withColumn("lattice", F.md5(F.to_json(F.struct("token", "edges")))))
    ways = lattice.groupBy("lattice").agg(F.any_value("token").alias("token"), F.any_value("edges").alias("edges")).select("lattice", _token_ways(F.col("token"), F.col("edges"), k).alias("ways"))
    of_name = tokens.join(merged(lattice.select("token", "table_name", "table_description", "lattice")), ["token", "table_name", "table_description"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lattice"))), lambda x: x["lattice"]).alias("lattices"))
    of_name = cut(of_name.withColumn("name", F.md5(F.array_join("lattices", ""))))
    each_name = of_name.groupBy("name").agg(F.any_value("lattices").alias("lattices")).select("name", F.posexplode("lattices").alias("pos", "lattice"))
    found = each_name.join(ways, "lattice").groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ways"))), lambda x: x["ways"]).alias("tokens"))
    found = found.select("name", _name_ways(F.col("tokens"), k).alias("found"))
    out = of_name.join(found, "name").select(*key, F.posexplode("found").alias("rank", "p"))
    said = F.col("p.parts")
    return out.select(
        *key,
        (F.col("rank") + 1).alias("rank"),
        (-F.col("p.covered")).alias("covered"),
        F.round("p.score", 6).alias("score"),
        said["fragment"].alias("fragments"),
        said["full"].alias("full_names"),
        said["korean"].alias("korean_words"),
        said["origin"].alias("origins"),
        F.col("p.ambiguity").alias("ambiguity"),
    )


#: Fixed value: what stands for a Korean name that nothing is known of.
PLACEHOLDER = "미정"


def direct_baseline(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Names split at `_` only, the best sense for each token: names, confidence 25, 65 or 80, stratum. A token
    that the dictionary lacks stands for itself and has the placeholder; so has a name without a token."""
    key = ["source_id", "column_name", "table_name", "table_description"]
    rows = df.select("source_id", *[F.coalesce(c, F.lit("")).alias(c) for c in key[1:]])
    tokens = rows.select(*key, F.posexplode(F.filter(F.split(F.upper("column_name"), "_"), lambda x: x != "")).alias("pos", "fragment"))
    senses = resolve_sense(tokens.select("fragment", "table_name", "table_description"), dictionary)
    found = tokens.join(senses, ["fragment", "table_name", "table_description"], "left")
    part = F.struct("pos", F.coalesce("full_name", "fragment").alias("full"), F.coalesce("korean_word", F.lit(PLACEHOLDER)).alias("korean"), F.coalesce("many", F.lit(False)).alias("many"), F.col("full_name").isNull().alias("open"))
    parts = rows.select("source_id").join(found.groupBy("source_id").agg(F.array_sort(F.collect_list(part)).alias("c")), "source_id", "left")
    parts = parts.withColumn("c", F.coalesce("c", F.array().cast("array<struct<pos:int,full:string,korean:string,many:boolean,open:boolean>>")))
    words = F.filter(F.transform("c", lambda x: F.regexp_replace(x["korean"], r"(?U)[\s_]+", "")), lambda x: x != "")
    once = F.aggregate(words, F.array().cast("array<string>"), lambda a, x: F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(x), a).otherwise(F.concat(a, F.array(x))))
    opened, many = F.exists("c", lambda x: x["open"]), F.exists("c", lambda x: x["many"])
    name = F.array_join(once, "")
    return parts.select(
        "source_id",
        F.array_join(F.transform("c", lambda x: x["full"]), " ").alias("english_full_name"),
        F.when(name == "", PLACEHOLDER).otherwise(name).alias("korean_attribute_name"),
        F.when(opened, 25).when(many, 65).otherwise(80).alias("confidence"),
        F.when(opened, "unmapped_inference").when(many, "mapping_ambiguity").otherwise("deterministic").alias("review_stratum"),
    )


CONTEXT = ("column_name", "table_name", "table_description", "data_type")


def deterministic_results(df: DataFrame, dictionary: DataFrame) -> DataFrame:
    """source_id with names, components, evidence, confidence, coverage and stratum of the best segmentation;
    each distinct name and table is solved once. Null names and tables count as empty; a name that has no
    segmentation is one component of unknown meaning."""
    key = ["column_name", "table_name", "table_description"]
    best = segment_names(df, dictionary)
    size = F.length(F.regexp_replace(F.upper("column_name"), "[^A-Z0-9]", ""))
    best = best.withColumns({"coverage": F.col("covered") / size, "open": F.array_contains("origins", "inference")})
    full = (F.col("coverage") == 1) & ~F.col("open")
    firsts = best.groupBy(*key).agg(
        F.min_by(F.struct("coverage", "open", "ambiguity", "fragments", "full_names", "korean_words", "origins"), "rank").alias("b"),
        F.array_sort(F.collect_list(F.when(full, F.struct("rank", "fragments")))).alias("complete"),  # of at most k
    )
    rows = df.select("source_id", "row_no", *[F.coalesce(c, F.lit("")).alias(c) for c in CONTEXT if c in df.columns])
    rows = rows.join(merged(firsts), key, "left")
    b, whole, one = F.col("b"), F.col("column_name"), lambda x: F.array(x)
    found = F.arrays_zip(b["fragments"].alias("fragment"), b["full_names"].alias("full"), b["korean_words"].alias("korean"), b["origins"].alias("origin"))
    found = F.when(b.isNull(), F.arrays_zip(one(whole).alias("fragment"), one(whole).alias("full"), one(F.lit("")).alias("korean"), one(F.lit("inference")).alias("origin"))).otherwise(found)
    said = F.transform(found, lambda x: F.struct(x["fragment"].alias("fragment"), x["full"].alias("full"), F.when((x["origin"] == "inference") & (x["korean"] == ""), PLACEHOLDER).otherwise(x["korean"]).alias("korean"), x["origin"].alias("origin")))
    rows = rows.withColumn("components", said).withColumns(
        {"coverage": F.coalesce(b["coverage"], F.lit(0.0)), "open": F.coalesce(b["open"], F.lit(True)), "ambiguity": F.coalesce(b["ambiguity"], F.lit(0)), "complete": F.coalesce("complete", F.array().cast("array<struct<rank:int,fragments:array<string>>>"))}
    )
    n = F.size("complete")
    split = (n > 1) & (F.try_element_at("complete", F.lit(1))["fragments"] != F.try_element_at("complete", F.lit(2))["fragments"])
    stratum = F.when(F.col("open"), "unmapped_inference").when(F.col("ambiguity") > 0, "mapping_ambiguity").when(split, "segmentation_ambiguity").otherwise("deterministic")
    korean = X.join_korean_name(F.transform("components", lambda x: x["korean"]))
    return rows.select(
        "source_id", "row_no", *[c for c in CONTEXT if c in rows.columns],
        X.join_full_name(F.transform("components", lambda x: x["full"])).alias("english_full_name"),
        F.when(korean == "", PLACEHOLDER).otherwise(korean).alias("korean_attribute_name"),
        X.evidence_text(F.col("components")).alias("evidence"),
        F.bround("coverage", 6).alias("coverage"),
        X.confidence_score(F.col("coverage"), F.col("open"), F.col("ambiguity"), n, split).alias("confidence"),
        stratum.alias("review_stratum"),
        "components",
    )


def segmentation_profile(results: DataFrame) -> DataFrame:
    """Rows, rows whose name is one entry of the dictionary, rows that it covers whole, rows of each ambiguity, distinct
    unresolved pieces."""
    open_ = F.explode_outer(F.transform(F.filter("components", lambda c: c["origin"] == "inference"), lambda c: c["fragment"]))
    tokens = results.select(open_.alias("t")).agg(F.count_distinct("t").alias("unresolved_tokens"))
    direct = (F.size("components") == 1) & (F.try_element_at("components", F.lit(1))["origin"] == "mapping")
    rows = results.agg(F.count("*").alias("n_rows"), F.count_if(direct).alias("directly_mapped"), F.count_if(F.expr("coverage = 1")).alias("segmentable"), F.count_if(F.expr("review_stratum = 'segmentation_ambiguity'")).alias("split_ambiguous"), F.count_if(F.expr("review_stratum = 'mapping_ambiguity'")).alias("meaning_ambiguous"))
    return rows.crossJoin(tokens)  # one row a side


def assign_strata(results: DataFrame, few: int = 5, threshold: int = 85) -> DataFrame:
    """Names found in more than one context become duplicate_context. Of the others that aren't confirmed, the
    first few in order become review_needed: deterministic ones first, then any."""
    context = [c for c in CONTEXT if c in results.columns]
    contexts = consistency(results, ["column_name"], F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in context])).select("column_name")
    rows = results.join(contexts.withColumn("dup", F.lit(True)), "column_name", "left")
    plain = F.col("review_stratum") == "deterministic"
    picked = rows.filter(F.col("dup").isNull() & ~(plain & (F.col("confidence") >= threshold)))
    picked = picked.orderBy(~plain, "row_no").limit(few).select("source_id", F.lit(True).alias("pick"))
    out = rows.join(F.broadcast(picked), "source_id", "left")
    return out.withColumn("review_stratum", F.when(F.col("dup"), "duplicate_context").when(F.col("pick"), "review_needed").otherwise(F.col("review_stratum"))).drop("dup", "pick")


def mapping_issues(sources: DataFrame, candidates: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """All rules on mined mappings: format, meaning, coverage, duplicates and conflicts. Issues of a candidate
    carry its abbreviation, full_name and korean_word; those of a source don't.

    Candidates meet their sources once, in a full join; what the dictionary and the votes of all candidates say of their
    keys is looked up, and the codes of a row are put out together."""
    word = X.normalize_korean_key(F.col("korean_word"))
    own = candidates.select("source_id", *KEY, word.alias("korean_key"), F.lit(True).alias("_mapped"))
    votes = candidates.groupBy("source_id", *KEY).count().groupBy(*KEY).agg(F.count("source_id").alias("n"))
    best = votes.groupBy("abbreviation", "korean_word").agg(F.count("*").alias("names"), F.min_by("full_name", F.struct(-F.col("n"), F.col("full_name"))).alias("recommended")).filter("names > 1")
    own = own.join(best.drop("names"), ["abbreviation", "korean_word"], "left")
    if dictionary is not None:
        known = canonical_dictionary(dictionary).select("abbreviation", "korean_key", F.col("full_name").alias("known"))
        own = own.join(known, ["abbreviation", "korean_key"], "left")
    else:
        own = own.withColumn("known", F.lit(None).cast("string"))
    rows = own.join(sources.select("source_id", "column_name", "column_description", F.lit(True).alias("_source")), "source_id", "full")
    mapped, sourced = F.col("_mapped").isNotNull(), F.col("_source").isNotNull()
    both = mapped & sourced
    ok_abbr = F.rlike("abbreviation", F.lit("^[A-Z][A-Z0-9]*$"))
    ok_full = F.rlike("full_name", F.lit("^[A-Z][A-Z0-9]*( [A-Z0-9]+)*$"))
    inside = F.contains(X.compact_identifier(F.col("column_name")), F.col("abbreviation"))
    described = F.coalesce("column_description", F.lit("")) != ""
    said = X.normalize_korean_key(F.coalesce("column_description", F.lit("")))
    tests = [
        (both & ~ok_abbr, "invalid_abbreviation", "abbreviation"),
        (both & ok_abbr & ~inside, "abbreviation_not_in_column", "abbreviation"),
        (both & ~ok_full, "invalid_full_name", "full_name"),
        (both & (F.col("korean_key") == ""), "empty_korean_word", "abbreviation"),
        (both & (F.col("korean_key") != "") & described & ~F.contains(said, F.col("korean_key")), "korean_word_not_in_description", "korean_word"),
        (both & ok_abbr & ok_full & (F.col("full_name") != F.col("known")), "noncanonical_full_name", "known"),
        (mapped & (F.col("full_name") != F.col("recommended")), "conflicting_full_name", "recommended"),
        (mapped & ~sourced, "unknown_source_id", "abbreviation"),
        (sourced & ~mapped, "missing_source_mapping", None),
    ]
    none = F.lit(None).cast("string")
    codes = F.array_compact(F.array(*[F.when(t, F.struct(F.lit(code).alias("code"), (F.col(of) if of else none).alias("details"))) for t, code, of in tests]))
    each = rows.select("source_id", F.explode(codes).alias("i"), *KEY)
    return union_issues(each.select("source_id", "i.code", F.lit("error").alias("severity"), "i.details", *KEY), duplicate_mapping(candidates))


def duplicate_mapping(candidates: DataFrame) -> DataFrame:
    """One warning on the whole, with how many candidates repeat another; none if none does."""
    total = candidates.groupBy("source_id", *KEY).count().agg((F.sum("count") - F.count("*")).alias("n")).filter("n > 0")
    return total.select(F.lit(None).cast("string").alias("source_id"), F.lit("duplicate_mapping").alias("code"), F.lit("warning").alias("severity"), F.col("n").cast("string").alias("details"))


def recommended_corrections(candidates: DataFrame, issues: DataFrame) -> DataFrame:
    """Candidates with the full names that conflicts (first) and the dictionary recommend for their
    abbreviation and Korean key; the smallest, if a key has several."""
    targets = issues.filter("code in ('conflicting_full_name', 'noncanonical_full_name') and coalesce(details, '') != ''")
    rank = F.struct(F.col("code") != "conflicting_full_name", F.col("details"))
    targets = targets.groupBy("abbreviation", X.normalize_korean_key(F.col("korean_word")).alias("_key")).agg(F.min_by("details", rank).alias("_target"))
    rows = candidates.withColumn("_key", X.normalize_korean_key(F.col("korean_word"))).join(targets, ["abbreviation", "_key"], "left")
    return rows.withColumn("full_name", F.coalesce("_target", "full_name")).select(*candidates.columns)


def partition_failed(sources: DataFrame, candidates: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed rows and the candidates that are left.

    An error on a candidate fails that one; an error on a source fails all its candidates, or gives one row
    without a candidate if it has none. Failed rows: source_id, the candidate, issue_codes in order. Sources
    that aren't known have no failed row."""
    errors = issues.filter("severity = 'error'").join(sources.select("source_id").distinct(), "source_id", "left_semi")
    own = errors.filter("abbreviation is not null or full_name is not null or korean_word is not null").select("source_id", *KEY, "code")
    whole = errors.filter("abbreviation is null and full_name is null and korean_word is null").select("source_id", "code")
    each = candidates.select("source_id", *KEY).distinct()
    spread = own.unionByName(whole.join(each, "source_id", "left").select("source_id", *KEY, "code"))
    failed = spread.groupBy("source_id", *KEY).agg(F.array_join(F.array_sort(F.collect_set("code")), ", ").alias("issue_codes"))
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"f.{c}")) for c in KEY]
    valid = candidates.alias("c").join(failed.alias("f"), [F.col("c.source_id") == F.col("f.source_id"), *same], "left_anti")
    return failed, valid


def apply_status(results: DataFrame, issues: DataFrame, threshold: int = 85) -> DataFrame:
    """Status of each result: failed on an error, confirmed if confident and deterministic, else to review."""
    codes = issues.groupBy("source_id").agg(F.max((F.col("severity") == "error").cast("int")).alias("failed"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("validation_codes"))
    rows = results.join(merged(codes), "source_id", "left")
    status = F.when(F.col("failed") == 1, "검증실패").when((F.col("confidence") >= threshold) & (F.col("review_stratum") == "deterministic"), "자동확정").otherwise("검토필요")
    return rows.select("source_id", status.alias("status"), "confidence", "review_stratum", F.coalesce("validation_codes", F.lit("")).alias("validation_codes"))


def naming_issues(results: DataFrame, threshold: int = 85) -> DataFrame:
    k = F.coalesce("korean_attribute_name", F.lit(""))
    return union_issues(
        issue(results.filter(F.coalesce(F.trim("english_full_name"), F.lit("")) == ""), "empty_full_name"),
        issue(results.filter(k == ""), "empty_korean_name"),
        issue(results.filter((k != "") & ~X.is_valid_name(k)), "invalid_korean_name_format"),
        issue(results.filter(F.rlike(k, F.lit("미정|불명|알수없음"))), "placeholder_korean_name"),
        issue(results.filter((F.col("confidence") < 0) | (F.col("confidence") > 100)), "confidence_out_of_range"),
        issue(results.filter(F.col("confidence") < threshold), "low_confidence", "warning"),
    )
