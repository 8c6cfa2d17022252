"""Fuzzy matching of CRM leads to stations.

A pair of names scores 1.0 when equal after normalising, 0.85 when one contains
the other, else by shared words over the smaller word count. The last two get
0.15 more, up to 1.0, when the lead's city is part of the station name. Each
lead takes its best station, the earliest one on ties.

Only the best station is wanted, so lead-station pairs are never formed on a
common word, where one frequent word would make the join quadratic. Instead:

* equal names are an equi-join of distinct names;
* containment looks up the pieces of the longer name among the shorter names,
  so its cost is bounded by the length of each name;
* up to ``INDEXED`` shared words are answered by an index from word subsets of that
  size to the earliest station that has the subset, built by a partial aggregate. A
  lead looks up its own subsets. The subset equal to the true intersection gives the
  true score and every other subset a lower one, so the maximum is exact;
* more shared words are sought by prefixes. With the words of every name sorted from
  rare to frequent, two names that share ``s`` words share ``PROBE`` of them among
  their first ``n - s + PROBE``. What is found so far bounds ``s`` from below, so
  a lead probes with the rarest words only that a better station must share. Pairs
  are scored where they meet; only those that reach the bound leave the join.

The first bounds are equal and containing names and, for names of many words, the
earliest station of each probe of the rarest words. Subsets that cannot reach the bound
are not made, so long names that resemble each other look up none of the index.

Containment outranks overlap even where overlap would score higher. A contained
station is therefore taken out of the overlap groups: if the earliest station
of a group is contained, the next one that is not is found by following
successors of contained stations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from heliospan import schemas
from heliospan.functions.energy import station_status
from heliospan.functions.numbers import first_truthy, round_n
from heliospan.functions.text import normalize_name, token_set
from heliospan.session import materialize

# Shared words up to this number are answered by the subset index alone; a name of n
# words has n * (n * n + 5) / 6 subsets of that size.
INDEXED = 3
# Words that prefixes of two names must share to be compared.
PROBE = 3
# Rarest words of a lead and of a station from which the first comparisons are drawn.
SEEDED = 6, 8
# Scores of equal fractions may differ by rounding once the bonus is taken off.
SLACK = 1e-9
# Successors are found within ranges of this many station ordinals, then across
# ranges, so a large overlap group is never sorted in one task.
ORDINAL_RANGE = 65536
ANCHOR = 3


def installed_stages(stages: DataFrame) -> DataFrame:
    """Stages that count as installed; all won stages when there is none."""
    name = F.col("name")
    hit = F.lit(False)
    for keyword in schemas.INSTALLED_KEYWORDS:
        hit = hit | name.ilike(f"%{keyword}%")
    hits = stages.filter(hit & ~name.contains(schemas.DEPRECATED_MARKER))
    return hits.unionByName(stages.filter(F.col("is_won") & ~hits.exists()))


def union_stage_hits(stages: DataFrame) -> DataFrame:
    """Distinct stages hit by any keyword, before the deprecated ones are removed."""
    hits = [stages.filter(F.col("name").ilike(f"%{k}%")) for k in schemas.INSTALLED_KEYWORDS]
    return hits[0].union(hits[1]).union(hits[2]).distinct()


def leads_in_stages(leads: DataFrame, stages: DataFrame) -> DataFrame:
    ids = stages.select(F.col("id").alias("_stage"))
    return leads.join(ids, leads["stage_id"]["id"] == ids["_stage"], "left_semi")


def lead_city() -> Column:
    return F.trim(F.coalesce(first_truthy(F.col("city"), F.col("x_studio_city_municipality")), F.lit("")))


def lead_names(leads: DataFrame) -> DataFrame:
    """Up to three names per lead with the normalised name and city."""
    fields = F.array(*[
        F.struct(F.lit(i).alias("name_ord"), F.trim(c).alias("lead_name"))
        for i, c in enumerate(("partner_name", "contact_name", "name"))
    ])
    rows = leads.select(F.col("id").alias("lead_id"), lead_city().alias("_city"), F.explode(fields).alias("n"))
    named = rows.select(
        "lead_id", "n.*", normalize_name(F.col("n.lead_name")).alias("lname"),
        normalize_name(F.col("_city")).alias("city_key"),
    )
    return named.filter("lname <> ''")


def station_names(stations: DataFrame) -> DataFrame:
    """Distinct normalised station names with the earliest station of each."""
    name = normalize_name(first_truthy(F.col("stationName"), F.col("sno")))
    return stations.select(name.alias("sname"), "ord").filter("sname <> ''").groupBy("sname").agg(
        F.min("ord").alias("ord")
    )


def contained_names(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (needle, text) where the needle is a substring of the text.

    Each position of a text is joined on its first characters with the lengths
    of the needles that start so; the pieces of those lengths are then looked
    up among the needles. No pair is formed that does not hold.
    """
    # Explodes below make far more rows than their estimated size tells: the few anchors are
    # written, so that their own size is known, and pieces are never taken for a small side.
    anchors = needles.groupBy(F.substring("needle", 1, ANCHOR).alias("anchor")).agg(
        F.collect_set(F.length("needle")).alias("lengths")
    )
    anchors = materialize(anchors, "anchors")
    positions = texts.select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("p"))
    starts = F.array_distinct(F.array(*[F.substr("text", "p", F.lit(n)) for n in range(1, ANCHOR + 1)]))
    at = positions.select("text", "p", F.explode(starts).alias("anchor")).join(anchors, "anchor")
    pieces = (
        at.select("text", "p", F.explode("lengths").alias("n"))
        .filter(F.col("p") + F.col("n") - 1 <= F.length("text"))
        .select("text", F.substr("text", "p", "n").alias("needle"))
        .distinct()
    )
    return pieces.hint("merge").join(needles, "needle")


def _named(names: DataFrame, source: str, target: str) -> DataFrame:
    return names.select(F.col(source).alias(target)).distinct()


def contained_pairs(lnames: DataFrame, snames: DataFrame) -> DataFrame:
    """Unequal name pairs where either contains the other."""
    inside = contained_names(_named(lnames, "lname", "needle"), _named(snames, "sname", "text"))
    around = contained_names(_named(snames, "sname", "needle"), _named(lnames, "lname", "text"))
    pairs = inside.select(F.col("needle").alias("lname"), F.col("text").alias("sname")).unionByName(
        around.select(F.col("text").alias("lname"), F.col("needle").alias("sname"))
    )
    return pairs.filter("lname <> sname")


def _shared_words(lnames: DataFrame, snames: DataFrame) -> DataFrame:
    """Words found on both sides, with their number of names and a number of their own."""

    def words(rows: DataFrame, name: str) -> DataFrame:
        exploded = rows.select(F.explode(token_set(F.col(name))).alias("word"))
        return exploded.groupBy("word").agg(F.count("*").alias("n"))

    left, right = words(lnames, "lname"), words(snames, "sname").withColumnRenamed("n", "m")
    both = left.join(right, "word").select("word", (F.col("n") + F.col("m")).alias("freq"))
    return materialize(both.withColumn("code", F.monotonically_increasing_id()), "words")


def _with_shared_words(rows: DataFrame, name: str, shared: DataFrame) -> DataFrame:
    """Names with the numbers of their shared words, rarest first, and their full word count."""
    exploded = rows.select(name, F.explode(token_set(F.col(name))).alias("word")).join(shared, "word")
    words = F.transform(F.sort_array(F.collect_list(F.struct("freq", "code"))), lambda w: w["code"])
    return exploded.groupBy(name).agg(words.alias("words")).withColumn("size", F.size(token_set(F.col(name))))


def _least_bounds(leads: DataFrame) -> list[tuple[int, float]]:
    """Least ``bound`` of the leads of each word count; at most as many rows as a name has words."""
    return [(r["size"], r["bound"]) for r in leads.groupBy("size").agg(F.min("bound").alias("bound")).collect()]


def _least_size(stations: DataFrame) -> int:
    return stations.agg(F.min("size").alias("size")).first()["size"] or 1


def _subsets(rows: DataFrame, others: list[tuple[Column, Column]]) -> DataFrame:
    """Subsets of the words of a name with at most ``INDEXED`` words that may reach a bound.

    ``others`` are word counts and bounds on the other side. A subset is left out where
    its score is below the bound for each of them.
    """
    # Both sides sort words the same way, so equal subsets give equal text.
    one = "transform(words, (a, i) -> struct(string(a) AS subset, 1 AS shared))"
    two = ("flatten(transform(words, (a, i) -> transform(slice(words, i + 2, size(words)), "
           "b -> struct(concat_ws(' ', string(a), string(b)) AS subset, 2 AS shared))))")
    three = ("flatten(flatten(transform(words, (a, i) -> transform(slice(words, i + 2, size(words)), (b, j) -> "
             "transform(slice(words, i + j + 3, size(words)), c -> struct(concat_ws(' ', string(a), string(b), string(c)) AS subset, 3 AS shared))))))")

    def may_win(shared: int) -> Column:
        return F.array_max(F.array(*[
            F.lit(shared) >= bound * F.least("size", F.greatest(size, F.lit(shared))) - F.lit(SLACK) for size, bound in others
        ]))

    subsets = F.concat(*[
        F.when(may_win(i + 1), F.expr(text)).otherwise(F.expr("array()")) for i, text in enumerate((one, two, three))
    ])
    return rows.withColumn("s", F.explode(subsets)).select(
        *[c for c in rows.columns if c != "words"], "s.subset", "s.shared"
    )


def _lead_subsets(leads: DataFrame, stations: DataFrame) -> DataFrame:
    found = _subsets(leads, [(F.lit(_least_size(stations)), F.col("bound"))])
    return found.drop("bound")


def _station_subsets(stations: DataFrame, leads: DataFrame) -> DataFrame:
    found = _subsets(stations, [(F.lit(n), F.lit(bound)) for n, bound in _least_bounds(leads)] or [(F.lit(1), F.lit(2.0))])
    return found.withColumnRenamed("size", "station_size")


def _probes(rows: DataFrame, limit: Column, *keep: str) -> DataFrame:
    """Hashes of ``PROBE`` words among the first ``limit``, with the rank of the most frequent one.

    Equal words give equal hashes; other names with an equal hash are only compared in vain.
    """
    triples = F.expr(
        "flatten(flatten(transform(_head, (a, i) -> transform(slice(_head, i + 2, size(_head)), (b, j) -> "
        "transform(slice(_head, i + j + 3, size(_head)), (c, k) -> struct(xxhash64(a, b, c) AS probe, i + j + k + 3 AS last))))))"
    )
    head = rows.withColumn("n", F.size("words")).withColumn("_head", F.slice("words", 1, F.greatest(limit, F.lit(0))))
    return head.withColumn("p", F.explode(triples)).select(*keep, "size", "n", "p.probe", "p.last")


def _overlap(pairs: DataFrame) -> DataFrame:
    """Overlap score of name pairs that reach ``bound``; those where one name contains the other are left out."""
    score = F.size(F.array_intersect("words", "m_words")) / F.least("size", "m_size")
    near = pairs.withColumn("score", score).filter(F.col("score") >= F.col("bound") - F.lit(SLACK))
    return near.filter(~F.contains("lname", "sname") & ~F.contains("sname", "lname"))


def _seed_pairs(leads: DataFrame, stations: DataFrame) -> DataFrame:
    """Overlap of each lead with the earliest station of each probe of its rarest words.

    These are only some pairs: a good score among them spares the search of low ones.
    """
    right = _probes(stations, F.lit(SEEDED[1]), "sname", "ord", "words")
    first = F.min(F.struct("ord", "sname", F.col("words").alias("m_words"), F.col("size").alias("m_size")))
    left = _probes(leads.filter(F.size("words") > INDEXED), F.lit(SEEDED[0]), "lname", "words")
    met = left.hint("merge").join(right.groupBy("probe").agg(first.alias("first")), "probe")
    return _overlap(met.select("lname", "words", "size", "first.*", F.lit(0.0).alias("bound")))


def _need(bound: Column, smaller: Column) -> Column:
    """Shared words that a score of ``bound`` takes, and more than ``INDEXED``."""
    return F.greatest(F.lit(INDEXED + 1), F.ceil(bound * smaller - F.lit(SLACK)).cast("int"))


def _compared(leads: DataFrame, stations: DataFrame, *keys: str) -> DataFrame:
    """Overlap of the pairs that share more than ``INDEXED`` words, agree in ``keys`` and reach the ``bound`` of the lead.

    A score of ``bound`` takes ``need`` shared words, and those take ``PROBE`` of the
    first ``n - need + PROBE`` words on either side. Pairs are scored where they meet
    and are never moved; one that meets on several probes is there several times.
    """
    leads, stations = (rows.filter(F.size("words") > INDEXED) for rows in (leads, stations))
    least_size, bounds = _least_size(stations), _least_bounds(leads)
    lead_need = _need(F.col("bound"), F.least("size", F.lit(least_size)))
    station_need = F.array_min(F.array(*[
        _need(F.lit(bound), F.least("size", F.lit(n))) for n, bound in bounds or [(1, 0.0)]
    ]))
    left = _probes(leads, F.size("words") - lead_need + PROBE, "lname", "words", "bound", *keys)
    right = _probes(stations, F.size("words") - station_need + PROBE, "sname", "words", "ord", *keys)
    right = right.withColumnsRenamed({"words": "m_words", "size": "m_size", "n": "m", "last": "m_last"})
    need = _need(F.col("bound"), F.least("size", "m_size"))
    met = left.hint("merge").join(right, ["probe", *keys]).filter(
        (F.col("last") <= F.col("n") - need + PROBE) & (F.col("m_last") <= F.col("m") - need + PROBE)
    )
    return _overlap(met.select("lname", "sname", "ord", "bound", "words", "m_words", "size", "m_size", *keys))


def _prefix_pairs(
    lead_words: DataFrame, station_words: DataFrame, bounds: DataFrame, contained: DataFrame
) -> DataFrame:
    """Overlap of the pairs that share more than ``INDEXED`` words and reach the ``bound`` of the lead.

    ``bounds`` has the least overlap score that can still win, by lead name. The pairs of
    ``contained`` are left out; the names of a pair tell, so they are not joined.
    """
    return _compared(lead_words.join(bounds, "lname"), station_words).select("lname", "sname", "score", "ord")


def _candidate(score: Column, ordinal: str = "ord") -> Column:
    return F.struct(score.alias("score"), (-F.col(ordinal)).alias("neg_ord"))


def _with_bonus(score: Column) -> Column:
    return F.least(F.lit(1.0), score + F.lit(schemas.CITY_BONUS))


def _overlap_score() -> Column:
    return F.col("shared") / F.least("size", "station_size")


def _successors(members: DataFrame, keys: list[str]) -> DataFrame:
    """Next ordinal of every member within its group."""
    ranged = members.withColumn("_range", F.floor(F.col("ord") / ORDINAL_RANGE))
    inside = Window.partitionBy(*keys, "_range").orderBy("ord")
    across = Window.partitionBy(*keys).orderBy("_range")
    starts = ranged.groupBy(*keys, "_range").agg(F.min("ord").alias("_start"))
    following = starts.select(*keys, "_range", F.lead("_start").over(across).alias("_next_start"))
    stepped = ranged.withColumn("_next", F.lead("ord").over(inside)).join(following, [*keys, "_range"])
    return stepped.select(*members.columns, F.coalesce("_next", "_next_start").alias("next_ord"))


def _overlap_base(lookups: DataFrame, members: DataFrame, contained: DataFrame) -> DataFrame:
    """Best overlap score per lead name, contained stations left out.

    ``lookups`` are lead subsets, ``members`` station subsets with ordinals and
    ``contained`` name pairs with the station ordinal.
    """
    group = ["subset", "station_size"]
    firsts = members.groupBy(*group).agg(F.min("ord").alias("ord"))
    found = lookups.hint("merge").join(firsts, "subset").withColumn("score", _overlap_score())
    above = F.col("score") > schemas.CONTAINED_SCORE
    taken = contained.select("lname", "ord", F.lit(True).alias("_taken"))
    low = found.filter(~above)
    high = found.filter(above).join(taken, ["lname", "ord"], "left")
    free = high.filter("_taken is null")
    # Groups whose earliest station is contained in, or contains, the lead name.
    blocked = high.filter("_taken is not null").select("lname", *group, "score")
    touched = members.hint("merge").join(blocked.select(*group).distinct(), group, "left_semi")
    steps = blocked.hint("merge").join(contained.select("lname", "ord"), "lname").hint("merge").join(
        _successors(touched.select(*group, "ord"), group), [*group, "ord"]
    )
    onward = steps.filter("next_ord is not null").select("lname", "score", F.col("next_ord").alias("ord"))
    onward = onward.hint("merge").join(taken, ["lname", "ord"], "left_anti")
    columns = ["lname", "score", "ord"]
    rows = low.select(*columns).unionByName(free.select(*columns)).unionByName(onward.select(*columns))
    return rows.groupBy("lname").agg(F.max(_candidate(F.col("score"))).alias("best"))


def name_candidates(names: DataFrame, stations: DataFrame) -> DataFrame:
    """Best candidate station per distinct lead name and city.

    ``names`` comes from ``lead_names`` and ``stations`` from ``station_names``.
    The tables below are each used several times, so they are written once.
    """
    keys = materialize(names.select("lname", "city_key").distinct(), "lead-keys")
    stations = materialize(stations, "station-names")
    lnames = keys.select("lname").distinct()
    cities = keys.select(F.col("city_key").alias("needle")).filter("needle <> ''").distinct()
    city_hits = contained_names(cities, stations.select(F.col("sname").alias("text")))
    in_city = materialize(city_hits.select(F.col("needle").alias("city_key"), F.col("text").alias("sname")), "cities")
    contained = materialize(contained_pairs(lnames, stations).join(stations, "sname"), "contained")

    shared = _shared_words(lnames, stations)
    lead_words = materialize(_with_shared_words(lnames, "lname", shared), "lead-words")
    station_words = materialize(_with_shared_words(stations, "sname", shared).join(stations, "sname"), "station-words")

    def best_of(*parts: DataFrame) -> DataFrame:
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy("lname").agg(F.max("best").alias("best"))

    # Without the city: one best candidate per lead name.
    equal = lnames.join(stations, F.col("lname") == F.col("sname")).select(
        "lname", _candidate(F.lit(schemas.EXACT_SCORE)).alias("best")
    )
    holding = contained.groupBy("lname").agg(F.min("ord").alias("ord")).select(
        "lname", _candidate(F.lit(schemas.CONTAINED_SCORE)).alias("best")
    )
    seeds = _seed_pairs(lead_words, station_words).select("lname", _candidate(F.col("score")).alias("best"))
    plain = materialize(best_of(equal, holding, seeds), "seeded")
    # What is found so far bounds the scores that are still sought.
    bound = F.coalesce(F.col("best.score"), F.lit(0.0)).alias("bound")
    seeded = lead_words.join(plain, "lname", "left").select(*lead_words.columns, bound)
    lookups, members = _lead_subsets(seeded, station_words), _station_subsets(station_words, seeded)
    plain = materialize(best_of(plain, _overlap_base(lookups, members, contained.select("lname", "ord"))), "indexed")
    wide = _prefix_pairs(lead_words, station_words, plain.select("lname", bound), contained)
    plain = materialize(best_of(plain, wide.select("lname", _candidate(F.col("score")).alias("best"))), "plain")

    # With the city in the station name: one best candidate per name and city, where the bonus may lift it above.
    lifted = keys.filter("city_key <> ''").join(plain, "lname").select(
        "lname", "city_key", (F.col("best.score") - F.lit(schemas.CITY_BONUS)).alias("bound")
    )
    city_leads = materialize(lifted.join(lead_words, "lname"), "city-leads")
    city_stations = materialize(station_words.join(in_city, "sname"), "city-stations")
    city_members = _station_subsets(city_stations, city_leads).groupBy("subset", "station_size", "city_key").agg(
        F.min("ord").alias("ord")
    )
    city_overlap = _lead_subsets(city_leads, city_stations).hint("merge").join(city_members, ["subset", "city_key"])
    city_holding = contained.join(in_city, "sname").groupBy("lname", "city_key").agg(F.min("ord").alias("ord"))

    def with_city(rows: DataFrame, score: Column) -> DataFrame:
        return rows.select("lname", "city_key", _candidate(_with_bonus(score)).alias("best"))

    boosted = with_city(city_overlap, _overlap_score()).unionByName(
        with_city(city_holding, F.lit(schemas.CONTAINED_SCORE))
    )
    boosted = boosted.unionByName(with_city(_compared(city_leads, city_stations, "city_key"), F.col("score")))
    boosted = boosted.groupBy("lname", "city_key").agg(F.max("best").alias("boosted"))
    plain = plain.withColumnRenamed("best", "plain")
    city_only = in_city.join(stations, "sname").groupBy("city_key").agg(F.min("ord").alias("ord")).select(
        "city_key", _candidate(F.lit(schemas.CITY_BONUS)).alias("city_only")
    )
    joined = keys.join(plain, "lname", "left").join(boosted, ["lname", "city_key"], "left").join(city_only, "city_key", "left")
    best = F.greatest("plain", "boosted", "city_only")
    chosen = joined.withColumn("_b", best).filter("_b is not null").select(
        "lname", "city_key", F.col("_b.score").alias("score"), (-F.col("_b.neg_ord")).alias("ord")
    )
    same = stations.select(F.col("sname").alias("lname"), F.col("ord").alias("_equal_ord"))
    return chosen.join(same, "lname", "left").select(
        "lname", "city_key", "score", "ord", F.coalesce(F.col("ord") == F.col("_equal_ord"), F.lit(False)).alias("is_equal")
    )


def best_match(leads: DataFrame, stations: DataFrame) -> DataFrame:
    """Best station, raw score and matched name of every lead that has any candidate."""
    names = lead_names(leads)
    found = names.join(name_candidates(names, station_names(stations)), ["lname", "city_key"])
    # Earliest station, then an equal name, then field order.
    ranked = found.groupBy("lead_id").agg(F.max(F.struct(
        "score", (-F.col("ord")).alias("neg_ord"), "is_equal",
        (-F.col("name_ord")).alias("neg_name"), F.col("lead_name").alias("matched_on"),
    )).alias("b"))
    return ranked.select(
        "lead_id", F.col("b.score").alias("score"), (-F.col("b.neg_ord")).alias("station_ord"), "b.matched_on"
    )


def match_type(score: Column) -> Column:
    """Class of a raw score; scores are rounded only afterwards."""
    return (
        F.when(score >= schemas.EXACT_SCORE, "exact")
        .when(score >= schemas.HIGH_SCORE, "high")
        .when(score >= schemas.PARTIAL_SCORE, "partial")
        .otherwise("unmatched")
    )


def route_matches(leads: DataFrame, stations: DataFrame, best: DataFrame) -> DataFrame:
    """Every lead with its match class; station fields only where it matched."""
    lead = leads.select(
        F.col("id").alias("lead_id"), "ord", F.col("name").alias("lead_name"), "partner_name", "contact_name",
        F.col("email_from").alias("email"), "phone", lead_city().alias("city"), F.col("stage_id.name").alias("stage"),
    )
    scored = lead.join(best, "lead_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    scored = scored.withColumn("match_type", match_type(F.col("score")))
    matched = scored["match_type"] != "unmatched"
    station = stations.select(
        F.col("ord").alias("station_ord"), F.col("id").alias("station_id"), F.col("stationName").alias("station_name"),
        F.col("sno").alias("station_sn"), F.col("capacity").alias("station_capacity_kw"),
        station_status(F.col("state")).alias("station_status"),
    )
    hit = scored.withColumn("station_ord", F.when(matched, F.col("station_ord")))
    return hit.join(station, "station_ord", "left").select(
        "lead_id", "ord", "lead_name", "partner_name", "contact_name", "email", "phone", "city", "stage",
        "match_type", "score", round_n(F.col("score"), 2).alias("match_score"),
        "station_id", "station_name", "station_sn", "station_capacity_kw", "station_status",
        F.when(hit["match_type"] != "unmatched", F.col("matched_on")).alias("matched_on"),
    )


def exact_matches(routed: DataFrame) -> DataFrame:
    return routed.filter("match_type in ('exact', 'high')")


def partial_matches(routed: DataFrame) -> DataFrame:
    return routed.filter("match_type = 'partial'")


def unmatched_leads(routed: DataFrame) -> DataFrame:
    return routed.filter("match_type = 'unmatched'")


def all_matches(routed: DataFrame) -> DataFrame:
    return exact_matches(routed).unionByName(partial_matches(routed))


def unmatched_stations(stations: DataFrame, routed: DataFrame) -> DataFrame:
    used = all_matches(routed).select(F.col("station_id").alias("id")).distinct()
    return stations.join(used, "id", "left_anti").select(
        F.col("id").alias("station_id"), F.col("stationName").alias("station_name"), F.col("sno").alias("station_sn"),
        F.col("capacity").alias("capacity_kw"), station_status(F.col("state")).alias("status"),
    )


def matches_by_score(routed: DataFrame) -> DataFrame:
    return routed.orderBy(F.desc("match_score"), "ord")


def match_summary(routed: DataFrame, stations: DataFrame) -> DataFrame:
    """Counts per outcome and shares of leads and stations, as one row."""
    kind = F.col("match_type")
    leads = routed.agg(
        F.count("*").alias("leads"),
        F.count_if(kind.isin("exact", "high")).alias("exact_matches"),
        F.count_if(kind == "partial").alias("partial_matches"),
        F.count_if(kind == "unmatched").alias("unmatched_leads"),
    ).withColumn("_k", F.lit(1))
    fleet = stations.agg(F.count("*").alias("stations")).withColumn("_k", F.lit(1))
    left = unmatched_stations(stations, routed).agg(F.count("*").alias("unmatched_stations")).withColumn("_k", F.lit(1))
    row = leads.join(fleet, "_k").join(left, "_k").drop("_k")

    def share(part: Column, whole: str) -> Column:
        return round_n(part / F.greatest(F.col(whole), F.lit(1)) * 100.0, 2)

    return row.select(
        "*",
        share(F.col("exact_matches"), "leads").alias("exact_pct"),
        share(F.col("partial_matches"), "leads").alias("partial_pct"),
        share(F.col("unmatched_leads"), "leads").alias("unmatched_pct"),
        share(F.col("unmatched_stations"), "stations").alias("unmatched_stations_pct"),
        share(F.col("exact_matches") + F.col("partial_matches"), "leads").alias("coverage_pct"),
    )
