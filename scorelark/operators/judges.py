"""Judge identities: constrained clustering of names (ER10-ER12, A17-A21, J21-J23)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import MIN_PREFIX, first_compatible, nickname_groups, normalize_text
from ..session import numbered, written
from .components import components
from .matching import even_join

REASONS = {
    "manual": ("manual", "merged by an admin"),
    "same": ("high", "same first and last name; middle name or initial differs"),
    "nickname": ("high", "forms of the same first name with the same last name"),
    "prefix": ("medium", "one first name begins the other, with the same last name"),
    "single": ("medium", "matches only one full-named judge, and never judged on the same panel"),
}
METHODS = {"manual": "manual", "same": "middle_name", "nickname": "nickname", "prefix": "first_name_prefix", "single": "first_name_only"}


def panels(marks: DataFrame) -> DataFrame:
    """Panel, judge (normalised), shown (as printed), n: from rows (sheet_url, section, judge)."""
    norm = marks.withColumn("name", normalize_text(F.col("judge"))).where("name <> ''")
    return norm.groupBy("sheet_url", "section", "name", F.col("judge").alias("shown")).agg(F.count("*").alias("n"))


def judges(shown: DataFrame) -> DataFrame:
    """Name, panels, display: the most frequent form as printed (ties: the smallest)."""
    forms = shown.groupBy("name", "shown").agg(F.sum("n").alias("n"))
    display = forms.groupBy("name").agg(F.min_by("shown", F.struct(-F.col("n"), "shown")).alias("display"))
    count = shown.select("sheet_url", "section", "name").distinct().groupBy("name").agg(F.count("*").alias("panels"))
    return display.join(count, "name")


def together(shown: DataFrame) -> DataFrame:
    """Pairs a < b of names that stood on one panel, and so are two people."""
    panel = shown.where("sheet_url IS NOT NULL AND section IS NOT NULL").groupBy("sheet_url", "section").agg(F.collect_set("name").alias("names"))
    each = panel.select("names", F.explode("names").alias("a"))
    return each.select("a", F.explode(F.filter("names", lambda b: b > F.col("a"))).alias("b")).distinct()


def first_keys(first: Column, begins: bool) -> Column:
    """Keys on which compatible first names (X11) meet, and no others do: one name brings all its beginnings (``begins``), the other itself whole.

    A name too short to begin others meets only the same one; nickname groups are keys of both sides.
    """
    whole = F.concat(F.lit("="), first)
    parts = F.transform(F.sequence(F.lit(MIN_PREFIX), F.length(first)), lambda n: F.concat(F.lit("="), F.substring(first, F.lit(1), n))) if begins else F.array(whole)
    return F.concat(F.when(F.length(first) < MIN_PREFIX, F.array(whole)).otherwise(parts), F.transform(nickname_groups(first), lambda g: F.concat(F.lit("#"), g.cast("string"))))


def candidates(names: DataFrame) -> DataFrame:
    """Pairs a, b that may be one person, with kind: both full (same last name), or b a lone first name of a full name a.

    Full names meet on the last name and ``first_keys``, frequent ones in slots, so only compatible ones meet however many share a last name.  Lone names
    meet full ones on first names: compatible first names are found once, by the same keys, and joined to both sides.
    """
    parts = names.select("name", F.split("name", " ").alias("p")).withColumns({"first": F.get("p", F.lit(0)), "last": F.element_at("p", -1), "n": F.size("p")})
    full, single = parts.where("n >= 2"), parts.where("n = 1")
    keyed = lambda df, keys, *columns: df.select(*columns, F.explode(keys).alias("key"))
    long_ = keyed(full, first_keys(F.col("first"), True), F.col("name").alias("x"), F.col("first").alias("fx"), "last")
    short = keyed(full, first_keys(F.col("first"), False), F.col("name").alias("y"), F.col("first").alias("fy"), "last")
    met = even_join(long_, short, ["last", "key"]).where("x <> y")
    swapped = F.col("x") > F.col("y")
    pick = lambda a, b: F.when(swapped, F.col(b)).otherwise(F.col(a))
    once = met.select(pick("x", "y").alias("a"), pick("y", "x").alias("b"), pick("fx", "fy").alias("fa"), pick("fy", "fx").alias("fb")).distinct()
    pairs = once.select("a", "b", first_compatible(F.col("fa"), F.col("fb")).alias("kind"))
    firsts = full.select(F.col("first").alias("fa")).distinct(), single.select(F.col("first").alias("fb")).distinct()
    sides = ([keyed(df, first_keys(F.col(c), begins), c) for df, c in zip(firsts, ("fa", "fb"), strict=True)] for begins in (True, False))
    (fa_begins, fb_begins), (fa_whole, fb_whole) = sides
    fits = fa_begins.join(fb_whole, "key").select("fa", "fb").unionByName(fa_whole.join(fb_begins, "key").select("fa", "fb")).distinct()
    lone = fits.join(full.select(F.col("name").alias("a"), F.col("first").alias("fa")), "fa").join(single.select(F.col("name").alias("b"), F.col("first").alias("fb")), "fb")
    return pairs.unionByName(lone.select("a", "b", F.lit("single").alias("kind")))


ALIASES = "alias_norm string, alias_name string, judge_key string, judge_name string, method string, confidence string, reason string, candidates array<string>, panels long"


def _rekeyed(df: DataFrame, columns: list[str], joined: DataFrame) -> DataFrame:
    """``df`` with the clusters in ``columns`` replaced where ``joined`` (old, new) says so."""
    for c in columns:
        df = df.join(joined.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return df


def _foes(apart: DataFrame, cluster: DataFrame) -> DataFrame:
    """x, y, in both directions: clusters of which two members are apart; a cluster that is so in itself has x = y."""
    of = lambda c: cluster.select(F.col("name").alias(c), F.col("cluster").alias("_" + c))
    known = apart.join(of("a"), "a").join(of("b"), "b").select(F.col("_a").alias("x"), F.col("_b").alias("y"))
    return known.unionByName(known.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct()


def stars(edge: DataFrame, foe: DataFrame) -> DataFrame:
    """One round of merges: t, a, b, kind, old, new of edges (t, a, b, kind, ca, cb; one for each pair of clusters) that a scan in order of t would take.

    Around a hub lie leaves whose first edge is the one to the hub.  The scan takes a hub's edges one by one as long as these all
    go to leaves, no leaf has another edge before, and none of the clusters that come together are foes; up to there the
    order doesn't matter, and all are taken at once.  The first edge of all always is.
    """
    ends = edge.select("t", F.col("ca").alias("node")).unionByName(edge.select("t", F.col("cb").alias("node")))
    least = ends.groupBy("node").agg(F.min("t").alias("m1"))
    second = ends.join(least, "node").groupBy("node").agg(F.first("m1").alias("m1"), F.min(F.when(F.col("t") > F.col("m1"), F.col("t"))).alias("m2"))
    end = lambda c: second.select(F.col("node").alias(c), F.col("m1").alias(c + "_1"), F.col("m2").alias(c + "_2"))
    full = edge.join(end("ca"), "ca").join(end("cb"), "cb")
    a_first, b_first = F.col("ca_1") == F.col("t"), F.col("cb_1") == F.col("t")
    a_hub = F.when(a_first & b_first, F.col("ca") < F.col("cb")).when(b_first, True).when(a_first, False)
    role = full.select("t", "a", "b", "kind", "ca", "cb", F.when(a_hub, F.col("ca")).when(~a_hub, F.col("cb")).alias("hub"), F.when(a_hub, F.col("cb")).when(~a_hub, F.col("ca")).alias("leaf"), F.when(a_hub, F.col("cb_2")).when(~a_hub, F.col("ca_2")).alias("then"))
    # a hub's run of leaves ends at its first other edge, or where a leaf of it has another one
    bound = role.select(F.explode(F.array("ca", "cb")).alias("node"), F.col("t"), "hub", "then").groupBy("node").agg(F.least(F.min(F.when(~F.col("hub").eqNullSafe(F.col("node")), F.col("t"))), F.min(F.when(F.col("hub") == F.col("node"), F.col("then")))).alias("end"))
    run = role.join(bound.withColumnRenamed("node", "hub"), "hub").where(F.col("end").isNull() | (F.col("t") < F.col("end")))
    member = run.select("hub", F.col("leaf").alias("node"), "t").unionByName(run.select("hub", F.col("hub").alias("node"), F.lit(-1).cast("long").alias("t")).distinct())
    met = member.join(foe.withColumnsRenamed({"x": "node"}), "node").select("hub", F.col("y").alias("node"), F.col("t").alias("_t")).join(member, ["hub", "node"])
    clash = met.groupBy("hub").agg(F.min(F.greatest("t", "_t")).alias("clash"))
    return run.join(clash, "hub", "left").where(F.col("clash").isNull() | (F.col("t") < F.col("clash"))).select("t", "a", "b", "kind", F.col("leaf").alias("old"), F.col("hub").alias("new"))


def _once(edge: DataFrame) -> DataFrame:
    """The first edge of each pair of clusters: a later one finds them joined, or foes as before."""
    first = edge.where("ca <> cb").withColumns({"_l": F.least("ca", "cb"), "_g": F.greatest("ca", "cb")}).groupBy("_l", "_g").agg(F.min(F.struct("t", "a", "b", "kind", "ca", "cb")).alias("e"))
    return first.select("e.*")


def full_names(pairs: DataFrame, apart: DataFrame, cluster: DataFrame) -> DataFrame:
    """t, a, b, kind of the merges that a scan over the pairs (a, b, kind), by a and b, makes; ``cluster``: name, cluster before it.

    Names that candidates connect without any two of them apart become one at once; the others take ``stars`` rounds, in
    which clusters, their edges and the table of foes are re-keyed.
    """
    at = lambda c, to: cluster.select(F.col("name").alias(c), F.col("cluster").alias(to))
    edge = written(numbered(pairs, ["a", "b", "kind"], "t", "ordered").join(at("a", "ca"), "a").join(at("b", "cb"), "b").select("t", "a", "b", "kind", "ca", "cb").where("ca <> cb"), "edges")
    group = written(components(edge.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "groups")
    of = lambda c: group.select(F.col("node").alias(c), F.col("component").alias("_" + c))
    foe = _foes(apart, cluster).where("x <> y").join(of("x"), "x").join(of("y"), "y").where("_x = _y")
    mixed = written(foe.select(F.col("_x").alias("component")).distinct(), "mixed")
    held = edge.join(of("ca"), "ca").withColumnRenamed("_ca", "component")
    taken = [held.join(mixed, "component", "left_anti").select("t", "a", "b", "kind")]
    edge, foe = held.join(mixed, "component", "left_semi").select("t", "a", "b", "kind", "ca", "cb"), written(foe.select("x", "y"), "foes")
    while True:
        edge = written(_once(edge).join(foe.withColumnsRenamed({"x": "ca", "y": "cb"}), ["ca", "cb"], "left_anti"), "edges")
        if edge.isEmpty():
            return reduce(DataFrame.unionByName, taken)
        merged = written(stars(edge, foe), "merged")
        taken.append(merged.select("t", "a", "b", "kind"))
        edge = _rekeyed(edge, ["ca", "cb"], merged)
        foe = written(_rekeyed(foe, ["x", "y"], merged).where("x <> y").distinct(), "foes")


def lone_names(pairs: DataFrame, apart: DataFrame, cluster: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b of merges, b and the options among which people have to choose) of lone first names b that may be a full name a.

    A scan takes them by name: one that fits a single cluster joins it.  What it finds depends only on those before it that
    touch one of its clusters, so in each round all those decide that are first wherever they touch.
    """
    at = lambda c, to: cluster.select(F.col("name").alias(c), F.col("cluster").alias(to))
    left = written(pairs.join(at("a", "cx"), "a").join(at("b", "cs"), "b").groupBy("b", "cs", "cx").agg(F.min("a").alias("a")), "options")
    foe = written(_foes(apart, cluster).join(left.select(F.col("cs").alias("x")).unionByName(left.select(F.col("cx").alias("x"))).distinct(), "x", "left_semi"), "foes")
    merged, review = [], []
    while True:
        left = written(left.join(foe.withColumnsRenamed({"x": "cs", "y": "cx"}), ["cs", "cx"], "left_anti").groupBy("b", "cs", "cx").agg(F.min("a").alias("a")), "options")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, merged) if merged else left.select("a", "b"), reduce(DataFrame.unionByName, review) if review else left.select("b", "a")
        touch = left.select("b", F.explode(F.array("cs", "cx")).alias("node")).distinct()
        free = touch.join(touch.groupBy("node").agg(F.min("b").alias("first")), "node").groupBy("b").agg(F.bool_and(F.col("first") == F.col("b")).alias("free"))
        now = written(left.join(free.where("free").select("b"), "b"), "free")
        number = now.groupBy("b").agg(F.count("*").alias("n"))
        one = now.join(number.where("n = 1"), "b").where("cs <> cx")
        merged.append(one.select("a", "b"))
        review.append(now.join(number.where("n > 1"), "b").select("b", "a"))
        joined = written(one.select(F.col("cs").alias("old"), F.col("cx").alias("new")), "merged")
        left = _rekeyed(left.join(now.select("b").distinct(), "b", "left_anti"), ["cs", "cx"], joined)
        foe = written(_rekeyed(foe, ["x", "y"], joined).distinct(), "foes")


def clusters(names: DataFrame, taken: DataFrame) -> DataFrame:
    """name, cluster (its smallest name) of all names after the merges ``taken`` (a, b)."""
    group = components(taken.select("a", "b")).select(F.col("node").alias("name"), "component")
    return written(names.select("name").join(group, "name", "left").select("name", F.coalesce("component", "name").alias("cluster")), "clusters")


def identities(names: DataFrame, pairs: DataFrame, apart: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """ER10: judge_aliases.  names (name, panels, display), pairs (a, b, kind), apart (a, b), overrides (id, action, name_a, name_b).

    Merges by hand come first, then full names in order of name, then lone names.  Two clusters join only if no member of one
    is apart from a member of the other.  Each stage runs in rounds of joins over all names at once.
    """
    nothing = pairs.where("false")
    forced = nothing
    if overrides is not None:
        o = overrides.select("action", normalize_text(F.col("name_a")).alias("a"), normalize_text(F.col("name_b")).alias("b")).where("a <> b")
        known = names.select("name")
        o = o.join(known.withColumnRenamed("name", "a"), "a", "left_semi").join(known.withColumnRenamed("name", "b"), "b", "left_semi")
        apart = apart.unionByName(o.where("action = 'separate'").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        forced = o.where("action = 'merge'").select("a", "b", F.lit("manual").alias("kind"))
    pairs, apart = written(pairs, "pairs"), written(apart, "apart")
    taken = written(forced.select(F.lit(0).alias("stage"), F.lit(0).cast("long").alias("t"), "a", "b", "kind"), "taken")
    alone = names.select("name", F.col("name").alias("cluster"))
    full = full_names(pairs.where("kind <> 'single'"), apart, alone if overrides is None else clusters(names, taken))
    taken = written(taken.unionByName(full.select(F.lit(1).alias("stage"), "t", "a", "b", "kind")), "taken")
    lone, review = lone_names(pairs.where("kind = 'single'").select("a", "b"), apart, clusters(names, taken))
    taken = written(taken.unionByName(lone.select(F.lit(2).alias("stage"), F.lit(0).cast("long").alias("t"), "a", "b", F.lit("single").alias("kind"))), "taken")
    how = taken.select(F.explode(F.array("a", "b")).alias("name"), F.struct("stage", "t", "kind").alias("at")).groupBy("name").agg(F.min("at")["kind"].alias("kind"))
    shown = names.select(F.col("name").alias("a"), "display")
    options = review.join(shown, "a").groupBy(F.col("b").alias("name")).agg(F.array_sort(F.collect_list("display")).alias("candidates"))
    each = names.join(clusters(names, taken), "name")
    best = each.groupBy("cluster").agg(F.max(F.struct((F.length("name") - F.length(F.replace("name", F.lit(" "), F.lit("")))).alias("blanks"), "panels", "name", "display")).alias("best"), F.count("*").alias("members"))
    whole = each.join(best, "cluster").join(how, "name", "left").join(options, "name", "left")
    kind = F.when(F.col("members") > 1, F.col("kind"))
    open_ = F.col("candidates").isNotNull() & (F.col("members") == 1)
    of = lambda table: F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[kind]
    return whole.select(
        F.col("name").alias("alias_norm"), F.col("display").alias("alias_name"), F.col("best.name").alias("judge_key"), F.col("best.display").alias("judge_name"),
        F.when(open_, "needs_review").otherwise(F.coalesce(of(METHODS), F.lit("exact"))).alias("method"), F.when(open_, "low").otherwise(F.coalesce(of({k: v for k, (v, _) in REASONS.items()}), F.lit("high"))).alias("confidence"),
        F.when(open_, "first name matches several judges").otherwise(of({k: v for k, (_, v) in REASONS.items()})).alias("reason"), "candidates", "panels",
    )


def rebuild(marks: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """ER10, ER11 from marks (sheet_url, section, judge): judge_aliases anew; after an override is appended this is run again."""
    shown = panels(marks)
    names = written(judges(shown), "judges")
    return identities(names, candidates(names), together(shown), overrides)


def judge_list(aliases: DataFrame) -> DataFrame:
    """One row per judge with all names, by name."""
    names = F.array_sort(F.collect_list(F.struct(F.col("alias_name").alias("name"), "method", "confidence", "reason", "panels")))
    return aliases.groupBy("judge_key").agg(F.min("judge_name").alias("judge"), F.sum("panels").alias("panels"), names.alias("names"), F.bool_or(F.col("method") == "needs_review").alias("needs_review")).orderBy(F.lower("judge"), "judge_key")


def review_list(aliases: DataFrame) -> DataFrame:
    return aliases.where("method = 'needs_review'").select(F.col("alias_name").alias("name"), "candidates", "panels")
