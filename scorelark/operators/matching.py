"""Fuzzy, nearest and interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import dates_compatible
from ..functions.text import jaccard, key_words, normalize_text, subset_either_way, tokens

PAGE_DAYS, PAGE_SIMILARITY = 3, 0.5
AGREE_DAYS = 10
#: Different names with one word that meet its count in one place, about.
COMMON = 1000
# Which source and which precision is trusted before others.
SOURCE_RANK = {"calendar": 0, "eepro": 1, "scoring_dance": 1, "wdr": 1, "manual": 2, "registry": 3}
PRECISION_RANK = {"day": 0, "month": 1, "year": 2}


def rank_of(table: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c], F.lit(2))


def first_by(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in a total order."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def nearest(left: DataFrame, right: DataFrame, on: list[str], left_date: str, right_date: str, days: int, tie: list[str]) -> DataFrame:
    """Each row of left with the right row of the nearest date within ``days``; ``ambiguous`` if two are equally near.

    Both sides are merged in one order of dates, and every row of left takes the last right row before it and the first one after, so no pairs
    are formed and one shuffle is enough.  A key (``on``) is cut into blocks of time; right rows stand in all blocks that
    reach them, so a key with very many rows is many groups.  ``tie`` makes the order of right rows of one date total.
    """
    width = 4 * days + 1
    block = lambda c, n: F.floor((F.unix_date(c) + n) / width)
    payload = [c for c in right.columns if c not in on]
    here = left.where(F.col(left_date).isNotNull()).select(*on, block(left_date, 0).alias("_block"), F.col(left_date).alias("_date"), F.struct(*(c for c in left.columns if c not in on)).alias("_left"))
    there = right.where(F.col(right_date).isNotNull()).select(*on, F.explode(F.sequence(block(right_date, -days), block(right_date, days))).alias("_block"), F.col(right_date).alias("_date"), F.struct(*(F.col(c).alias(f"_t{i}") for i, c in enumerate(tie)), *payload).alias("_right"))
    both = here.unionByName(there, allowMissingColumns=True)
    group = ["_block", *on]
    # all windows are over these groups, or finer ones, so they share one exchange
    day = W.partitionBy(*group, "_date")
    both = both.repartition(*group).withColumns({"_best": F.min("_right").over(day), "_n": F.count("_right").over(day)})
    seen = F.when(F.col("_right").isNotNull(), F.struct("_date", "_best", "_n"))
    up, down = (W.partitionBy(*group).orderBy(o).rangeBetween(W.unboundedPreceding, W.currentRow) for o in (F.col("_date"), F.col("_date").desc()))
    both = both.withColumns({"_before": F.last(seen, ignorenulls=True).over(up), "_after": F.last(seen, ignorenulls=True).over(down)}).where("_left IS NOT NULL")
    back, ahead = F.datediff("_date", "_before._date"), F.datediff("_after._date", "_date")
    diff = F.least(back, ahead)
    # the day itself is before and after; of two days equally far the row that comes first by ``tie``
    take = F.when(ahead.isNull() | (back < ahead), F.col("_before._best")).when(back.isNull() | (ahead < back), F.col("_after._best")).otherwise(F.least("_before._best", "_after._best"))
    near = F.when(back == diff, F.col("_before._n")).otherwise(0) + F.when((ahead == diff) & (ahead > 0), F.col("_after._n")).otherwise(0)
    found = both.select(*on, "_left", take.alias("_take"), diff.alias("diff"), (near > 1).alias("ambiguous")).where(F.col("diff") <= days)
    return found.select(*on, *(F.col(f"_left.{c}") for c in left.columns if c not in on), *(F.col(f"_take.{c}") for c in payload), "diff", "ambiguous")


def near_in_time(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int, on: tuple[str, ...] = ()) -> DataFrame:
    """The right side stands in the buckets of all days around it, so it is an equi-join, on ``on`` too.

    Without ``on`` everything of a day meets: only for sides of which one is small on any day.
    """
    spread = right.withColumn("_day", F.explode(F.sequence(F.date_sub(right_date, days), F.date_add(right_date, days))))
    return left.withColumn("_day", F.col(left_date)).join(spread, ["_day", *on]).drop("_day")


def met_in_time(left: DataFrame, right: DataFrame, left_date: str, right_date: str, days: int, by: list[str], first: str) -> DataFrame:
    """By ``by`` of the right side, how many pairs ``near_in_time`` has (pairs) and the smallest ``first`` in them, without forming them: days meet, not rows."""
    here = left.where(F.col(left_date).isNotNull()).groupBy(F.col(left_date).alias("_day")).agg(F.count("*").alias("_l"))
    there = right.where(F.col(right_date).isNotNull()).groupBy(*by, F.col(right_date).alias("_at")).agg(F.count("*").alias("_r"), F.min(first).alias("_first"))
    spread = there.withColumn("_day", F.explode(F.sequence(F.date_sub("_at", days), F.date_add("_at", days))))
    return spread.join(here, "_day").groupBy(*by).agg(F.sum(F.col("_l") * F.col("_r")).alias("pairs"), F.min("_first").alias("first"))


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast: Spark's own choice goes by the size of compressed files, before words and days become rows, and a broadcast passes whole through the driver."""
    return df.hint("merge")


def similar_names(left: DataFrame, right: DataFrame, on: list[str], least: float) -> DataFrame:
    """Pairs of rows, equal in ``on``, whose word sets (a_words, b_words) have a Jaccard similarity of ``least`` or more.

    A prefix-filtered join of the different sets: words are ordered by how many names have them, the rarest first.  Sets of m and n words that
    are similar enough have at least ``common`` words in common, so they share one of the first m - common + 1 words of the one
    and n - common + 1 of the other.  Sets meet on their sizes too, so this number is exact for each pair of sizes: of two names of two words only
    the rarer word counts.  A pair counts where its first common prefix word is.  Rows follow their sets at the end, so copies
    of a name are compared once and only rows of similar names meet.
    """
    def sets(df: DataFrame, p: str) -> DataFrame:
        return df.where(F.size(p + "_words") > 0).select(*on, F.array_sort(p + "_words").alias("words")).distinct()

    a, b = sets(left, "a"), sets(right, "b")
    names = a.select("words").unionByName(b.select("words")).distinct()
    each = names.select("words", F.explode("words").alias("word"))
    count = each.groupBy("word").agg(F.count("*").alias("n"))
    # a word of very many names is cut into slots, so that their rows don't end in one task; of all rows such words are a COMMON-th part at most, so few are broadcast
    slots = F.ceil(F.col("n") / COMMON).cast("int")
    dealt = each.join(F.broadcast(count.where(F.col("n") > COMMON).select("word", slots.alias("_k"))), "word", "left").withColumn("_slot", F.pmod(F.xxhash64("words"), F.coalesce("_k", F.lit(1))).cast("int")).drop("_k")
    counted = count.withColumn("_slot", F.explode(F.sequence(F.lit(0), slots - 1)))
    ranked = dealt.join(shuffled(counted), ["word", "_slot"]).groupBy("words").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("ranked"))  # one name's own words

    def keyed(df: DataFrame, p: str, q: str, others: DataFrame) -> DataFrame:
        """A row for each size that a similar set of the other side can have, as far as there is one, and each word of that prefix."""
        sizes = others.agg(F.collect_set(F.size("words")).alias("sizes"))  # one row, a number for each length of names
        own = df.join(shuffled(ranked), "words").crossJoin(F.broadcast(sizes)).withColumn("m", F.size("words"))
        own = own.withColumn("o", F.explode(F.filter("sizes", lambda o: (o >= least * F.col("m")) & (F.col("m") >= least * o))))
        common = F.ceil((F.col("m") + F.col("o")) * (least / (1 + least)) - 1e-9)  # the small amount is against rounding of the product
        prefix = F.transform(F.slice("ranked", 1, (F.col("m") - common + 1).cast("int")), lambda x: x["word"])
        return own.select(*on, F.col("words").alias(p + "_words"), prefix.alias(p + "_prefix"), F.col("m").alias(p + "_size"), F.col("o").alias(q + "_size")).withColumn("_word", F.explode(p + "_prefix"))

    met = keyed(a, "a", "b", b).join(shuffled(keyed(b, "b", "a", a)), [*on, "_word", "a_size", "b_size"])
    met = met.where((F.get(F.array_intersect("a_prefix", "b_prefix"), F.lit(0)) == F.col("_word")) & (jaccard(F.col("a_words"), F.col("b_words")) >= least))
    pairs = met.select(*on, F.col("a_words").alias("_a"), F.col("b_words").alias("_b"))
    mine, theirs = left.withColumn("_a", F.array_sort("a_words")), right.withColumn("_b", F.array_sort("b_words"))
    return mine.join(shuffled(pairs), [*on, "_a"]).join(shuffled(theirs), [*on, "_b"]).drop("_a", "_b")


def pages_for_events(events: DataFrame, names: DataFrame, provider_events: DataFrame) -> DataFrame:
    """Id, provider, provider_key: linked pages, else those within three days whose name is half the same as any of the event's names.

    ``names`` has id and normalised name of every name an event goes by (S1).
    """
    linked = provider_events.where("event_id IS NOT NULL").select(F.col("event_id").alias("id"), "provider", "provider_key")
    open_ = events.join(shuffled(linked.select("id").distinct()), "id", "left_anti").where("start_date IS NOT NULL").select("id", F.col("start_date").alias("_day")).join(shuffled(names), "id")
    pages = provider_events.where("start_date IS NOT NULL").select("provider", "provider_key", tokens(normalize_text(F.col("name"))).alias("b_words"), F.explode(F.sequence(F.date_sub("start_date", PAGE_DAYS), F.date_add("start_date", PAGE_DAYS))).alias("_day"))
    similar = similar_names(open_.select("id", "_day", tokens(F.col("name_norm")).alias("a_words")), pages, ["_day"], PAGE_SIMILARITY)
    return linked.unionByName(similar.select("id", "provider", "provider_key").distinct())


def dates_agree(a: Column, b: Column) -> Column:
    """J16."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= AGREE_DAYS, F.lit(False))


def even_join(left: DataFrame, right: DataFrame, on: list[str], most: int = 1 << 20) -> DataFrame:
    """An inner join of which no key makes more than about ``most`` pairs in one place.

    Keys are counted on both sides.  A key with more pairs is cut into slots: its left rows are dealt out by a hash of the row,
    its right rows stand in every slot.  Other keys have one slot, so nothing is copied for them.
    """
    counts = left.groupBy(*on).agg(F.count("*").alias("_l")).join(right.groupBy(*on).agg(F.count("*").alias("_r")), on)
    hot = counts.select(*on, F.ceil(F.least(F.col("_l"), F.col("_l") * F.col("_r") / most)).cast("int").alias("_k")).where("_k > 1")
    slots = lambda df: df.join(hot, on, "left").withColumn("_k", F.coalesce("_k", F.lit(1)))
    dealt = slots(left).withColumn("_slot", F.pmod(F.xxhash64(*left.columns), F.col("_k")).cast("int")).drop("_k")
    copied = slots(right).withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    return dealt.join(copied, [*on, "_slot"]).drop("_slot")


def related_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of events of different sources in one year whose names are related and whose dates fit.

    Both sides: id, name, source, start_date, end_date, date_precision, each id and name once.  A smaller word set can only lie in a
    larger one that has its rarest word, so pairs meet on (year, that word) instead of all against all; years and
    words that very many names have are cut into slots.
    """

    def prepared(df: DataFrame, p: str) -> DataFrame:
        return df.where("start_date IS NOT NULL").select(*(F.col(c).alias(p + c) for c in ("id", "name", "source", "start_date", "end_date", "date_precision")), F.year("start_date").alias("year"), F.array_sort(key_words(F.col("name"))).alias(p + "words"))

    left, right = prepared(a, "a_"), prepared(b, "b_")
    word = lambda df, p: df.withColumn("word", F.explode(p + "words"))
    count = word(left, "a_").select("word").unionByName(word(right, "b_").select("word")).groupBy("word").agg(F.count("*").alias("_n"))

    def lead(df: DataFrame, p: str) -> DataFrame:
        return word(df, p).join(count, "word").groupBy(*df.columns).agg(F.min_by("word", F.struct("_n", "word")).alias("word"))

    # the side with fewer words, or the left one of two with as many, brings its rarest word
    size = F.size("a_words") <= F.size("b_words")
    fewer, more = even_join(lead(left, "a_"), word(right, "b_"), ["year", "word"]).where(size), even_join(lead(right, "b_"), word(left, "a_"), ["year", "word"]).where(~size)
    fits = dates_compatible(*(F.col(f"{p}_{c}") for p in "ab" for c in ("start_date", "end_date", "date_precision")))
    return fewer.unionByName(more).drop("word").where((F.col("a_id") != F.col("b_id")) & (F.col("a_source") != F.col("b_source")) & fits & subset_either_way(F.col("a_words"), F.col("b_words")))


def find_related(wanted: DataFrame, events: DataFrame) -> DataFrame:
    """ER5, W3: for each wanted event the best related one of another source: by precision, then source, then age."""
    pairs = related_pairs(wanted, events).select("a_id", "b_id", "b_date_precision", "b_source")
    aged = pairs.distinct().join(events.select(F.col("id").alias("b_id"), "created_at"), "b_id")
    return first_by(aged, ["a_id"], [rank_of(PRECISION_RANK, F.col("b_date_precision")), rank_of(SOURCE_RANK, F.col("b_source")), "created_at", "b_id"]).select(F.col("a_id").alias("id"), F.col("b_id").alias("related_id"))


def event_info(entries: DataFrame, events: DataFrame, provider_events: DataFrame) -> DataFrame:
    """Entries with their event's info, else the provider's own record (K9: merged events keep that fallback).

    ``events`` are already at the end of their merge chains.
    """
    info = events.select(F.col("id").alias("event_id"), F.col("name").alias("_en"), F.col("start_date").alias("_es"), F.col("end_date").alias("_ee"), F.col("date_precision").alias("_ep"), "city", "region", "country")
    own = provider_events.select("provider", F.col("provider_key").alias("provider_event_key"), F.col("name").alias("_pn"), F.col("start_date").alias("_ps"), F.col("end_date").alias("_pe"))
    joined = entries.join(info, "event_id", "left").join(own, ["provider", "provider_event_key"], "left")
    return joined.select(
        *entries.columns, F.coalesce("_en", "_pn", "provider_event_key").alias("event_name"), F.coalesce("_es", "_ps").alias("start_date"), F.coalesce("_ee", "_pe").alias("end_date"),
        F.coalesce("_ep", F.when(F.col("_ps").isNotNull(), "day")).alias("date_precision"), "city", "region", "country",
        F.coalesce("event_id", F.concat_ws(":", "provider", "provider_event_key")).alias("event_key"),
    )


def same_division(a: Column, b: Column) -> Column:
    return normalize_text(a) == normalize_text(b)


def merge_finals(sheet_finals: DataFrame, registry: DataFrame) -> DataFrame:
    """Finals of sheets with the registry's points where event, role and division agree; unmatched registry results follow.

    A registry result goes to the first such final; if several results meet one final, the last one's points stay.
    """
    key = lambda df, p: df.withColumns({p + "role": F.coalesce("role", F.lit("")), p + "div": normalize_text(F.col("division"))})
    finals = key(sheet_finals, "_").withColumn("_seq", F.row_number().over(W.partitionBy("event_id", "_role", "_div").orderBy("seq")))
    results = key(registry, "_")
    on = ["event_id", "_role", "_div"]
    meeting = results.groupBy(*on).agg(F.max_by("points", "seq").alias("_points"))
    first = F.col("_seq") == 1
    matched = finals.join(meeting.withColumn("_hit", F.lit(True)), on, "left")
    out = matched.withColumns({"points": F.when(first, F.col("_points")), "source": F.when(first & F.col("_hit"), "scoresheets+registry").otherwise("scoresheets")})
    alone = results.join(finals.where("event_id IS NOT NULL").select(*on).distinct(), on, "left_anti")
    code = F.upper(F.col("result"))
    alone = alone.withColumns({"round": F.lit("finals"), "place": F.when(code.rlike(r"^\d+$"), code.cast("int")), "source": F.lit("registry")})
    drop = ["_role", "_div", "_seq", "_points", "_hit"]
    return out.drop(*drop).unionByName(alone.drop(*drop), allowMissingColumns=True)


def judge_identity(marks: DataFrame, aliases: DataFrame) -> DataFrame:
    """Marks with the judge's key and name; unknown names stand for themselves."""
    known = aliases.select(F.col("alias_norm").alias("_norm"), "judge_key", "judge_name", "method")
    joined = marks.withColumn("_norm", normalize_text(F.col("judge"))).join(known, "_norm", "left")
    return joined.withColumns({"judge_key": F.coalesce("judge_key", "_norm"), "judge_name": F.coalesce("judge_name", "judge")}).drop("_norm")


def confirmed(rows: DataFrame, second_list: DataFrame) -> DataFrame:
    """Whether the second list has the same name, start and country; missing countries equal each other."""
    seen = second_list.select(F.col("normalized_name").alias("_n"), F.col("start_date").alias("_s"), F.col("country").alias("_c")).distinct().withColumn("_hit", F.lit(True))
    on = (F.col("normalized_name") == F.col("_n")) & (F.col("start_date") == F.col("_s")) & F.col("country").eqNullSafe(F.col("_c"))
    return rows.join(seen, on, "left").withColumn("confirmation_status", F.when(F.col("_hit"), "confirmed").otherwise("unconfirmed")).drop("_n", "_s", "_c", "_hit")
