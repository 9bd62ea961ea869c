"""The verdict cascade over candidate pairs and incoming rows, as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions.paths import directory, mark_number, marks
from siftlake.functions.reasons import remembered_state
from siftlake.sources.shared import cut

from . import matching as M

# How much smaller, and how far apart in the mean, a copy may be.
SMALL_PIXEL, SMALL_SIZE, MEAN_GAP = 0.95, 0.66, 20.0
KEEPING = 300


def verdict(action: str, reason: str) -> Column:
    return F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))


def held_if(unsure: Column, action: str, reason: str) -> Column:
    """The verdict, but a hold where it isn't sure."""
    return F.struct(F.when(unsure, "hold").otherwise(action).alias("action"), F.lit(reason).alias("reason"))


def candidates(pairs: DataFrame, incoming: DataFrame, stored: DataFrame, listing: DataFrame, statistics: DataFrame) -> DataFrame:
    """Near-duplicate pairs(in_id, cat_id, p_distance) of rows with ``d_hash``, with the second distance and the factors that verdicts look at.

    Pairs grow faster than rows, so all that is of one row is joined to the row, and pairs meet each side once:
    the stored one first, so that they end by incoming row, as verdicts group them.
    """

    def side(rows, key, prefix, *more):
        found = statistics.select("doc_id", *[F.col(c).alias(f"{key}_{c}") for c in ("mean", "entropy", "quality")])
        fields = [F.col(c).alias(f"{prefix}_{c}") for c in ("size", "width", "height", "timestamp", "state")]
        own = rows.select("doc_id", F.col("d_hash").alias(f"{key}_d"), *fields, directory(F.col("from_path")).alias(f"{prefix}_dir"), *more)
        return M.shuffled(own.join(M.shuffled(found), "doc_id", "left").withColumnRenamed("doc_id", f"{key}_id"))

    places = M.exists(stored, listing).withColumnRenamed("present", "accessible")
    pairs = pairs.join(side(places, "cat", "c", "accessible"), "cat_id").join(side(incoming, "in", "i"), "in_id")
    pairs = pairs.withColumn("d_distance", M.hamming64(F.col("in_d"), F.col("cat_d"))).drop("in_d", "cat_d")
    pixels, stored_pixels = F.col("i_width") * F.col("i_height"), F.col("c_width") * F.col("c_height")
    sure = F.coalesce((F.col("p_distance") < M.P_EXACT) & (F.col("d_distance") < M.D_EXACT), F.lit(False))
    return pairs.withColumns({
        "same_dir": F.col("i_dir") == F.col("c_dir"),
        "small_pixel": pixels < stored_pixels * SMALL_PIXEL,
        "same_pixel": pixels == stored_pixels,
        "small_size": F.col("c_size") * SMALL_SIZE > F.col("i_size"),
        "newer": F.col("i_timestamp") > F.col("c_timestamp"),
        "valid": F.col("d_distance").isNotNull(),
        "may_be": ~sure,
        "will_keep": F.col("i_state") == KEEPING,
        "keeping": F.col("c_state") == KEEPING,
    })


def rejection() -> Column:
    """Why the incoming row is the worse copy; null if it isn't."""
    unsure = F.col("may_be")
    return (
        F.when(F.col("small_pixel"), held_if(unsure, "delete", "TYPE_P_HASH_REJECT_LOW_RESOLUTION"))
        .when(F.col("small_size"), held_if(unsure, "delete", "TYPE_P_HASH_REJECT_LOW_FILE_SIZE"))
        .when(F.col("newer") & F.col("same_pixel"), held_if(unsure, "delete", "TYPE_P_HASH_REJECT_NEWER"))
    )


def by_statistics() -> Column:
    """What the content's statistics say: another mean is another image if the hashes aren't sure. Null without statistics. Entropies compare to nine places, as sums differ beyond."""
    unsure, known = F.col("may_be"), F.col("in_mean").isNotNull() & F.col("cat_mean").isNotNull()
    return (
        F.when(known & (F.abs(F.col("in_mean") - F.col("cat_mean")) > MEAN_GAP), held_if(~unsure, "save", "TYPE_P_HASH_REJECT_DIFFERENT_MEAN"))
        .when(known & (F.round("cat_entropy", 9) > F.round("in_entropy", 9)), held_if(unsure, "delete", "TYPE_P_HASH_REJECT_LOW_ENTROPY"))
        .when(known & (F.col("cat_quality") * SMALL_SIZE > F.col("in_quality")), held_if(unsure, "delete", "TYPE_P_HASH_REJECT_LOW_QUALITY"))
    )


def judged(pairs: DataFrame) -> DataFrame:
    """Each candidate's action and reason before keep states count."""
    v = F.coalesce(
        F.when(~F.col("valid"), verdict("hold", "TYPE_PROCESS_ERROR")),
        rejection(),
        F.when(~F.col("accessible"), verdict("hold", "TYPE_P_HASH_MATCH_LOST_FILE")),
        by_statistics(),
        verdict("replace", "TYPE_P_HASH_MATCH"),
    )
    return pairs.withColumn("v", v).withColumn("action", F.col("v.action")).withColumn("reason", F.col("v.reason")).drop("v")


def remapped(pairs: DataFrame) -> DataFrame:
    """Keep states: no kept row is replaced, and no row that will be kept is deleted; what isn't sure is held."""
    action, will, keeping = F.col("action"), F.col("will_keep"), F.col("keeping")
    v = (
        F.when((action == "replace") & keeping, verdict("save", "TYPE_P_HASH_MATCH_KEEPING"))
        .when(will & (action == "delete") & ~keeping, verdict("save", "TYPE_P_HASH_MATCH_WILL_KEEP"))
        .when(will & (action == "replace"), verdict("transfer", "TYPE_P_HASH_MATCH_TRANSFER"))
        .otherwise(F.struct("action", "reason"))
    )
    rows = pairs.withColumn("v", v)
    return rows.withColumn("action", F.when(F.col("may_be"), "hold").otherwise(F.col("v.action"))).withColumn("reason", F.col("v.reason")).drop("v")


def near_verdicts(pairs: DataFrame, **more: Column) -> DataFrame:
    """One verdict an incoming row with candidates: first delete, else first replacement or transfer, else a hold with their number; a save is never chosen. more: what else is taken of a row's candidates at once."""
    pick = lambda *actions: F.min_by(F.struct("action", "cat_id", "reason"), F.when(F.col("action").isin(*actions), F.struct("p_distance", "cat_id")))
    out = pairs.groupBy("in_id").agg(pick("delete").alias("d"), pick("replace", "transfer").alias("r"), F.count("p_distance").alias("n"), *[c.alias(k) for k, c in more.items()])
    chosen = F.coalesce("d", "r")
    return out.select(
        "in_id",
        F.coalesce(chosen["action"], F.lit("hold")).alias("action"),
        chosen["cat_id"].alias("hit_id"),
        F.coalesce(chosen["reason"], F.lit("TYPE_P_HASH_MAY_BE")).alias("reason"),
        F.when(chosen.isNull(), F.col("n")).otherwise(0).cast("int").alias("n_candidates"),
        *more,
    )


def hit(action: str, reason: str, id_: Column | None = None, n: Column | None = None) -> Column:
    """A whole verdict: action, hit_id, reason, n_candidates."""
    id_ = F.lit(None) if id_ is None else id_
    n = F.lit(0) if n is None else n
    return F.struct(F.lit(action).alias("action"), id_.cast("long").alias("hit_id"), F.lit(reason).alias("reason"), n.cast("int").alias("n_candidates"))


def exact_verdict(state: Column, stored_id: Column, stored_state: Column, present: Column, needless: Column, recovery: bool = True, no_transfer: bool = False) -> Column:
    """A row whose hash is stored: a row to be kept takes the place of an accepted one, lost files are recovered, all else is deleted."""
    transfer = F.lit(not no_transfer) & (state == KEEPING) & (stored_state == M.ACCEPTED)
    recover = F.lit(recovery) & (stored_state >= M.ACCEPTED) & ~present & ~needless
    return F.when(transfer, hit("transfer", "TYPE_HASH_MATCH_TRANSFER", stored_id)).when(recover, hit("save", "TYPE_HASH_MATCH_RECOVERY", stored_id)).otherwise(hit("delete", "TYPE_HASH_MATCH"))


def relocation(stored_id: Column) -> Column:
    return F.when(stored_id.isNotNull(), hit("relocate", "TYPE_HASH_MATCH_RELOCATE", stored_id)).otherwise(hit("hold", "TYPE_HASH_MISMATCH_RELOCATE"))


def kind_verdict(kind: Column, source_there: Column) -> Column:
    """Rows that are no content: unknown ones are held, scrap and locks deleted, a cache is held while its source exists. Null for content."""
    return (
        F.when(kind == "UNKNOWN", hit("hold", "TYPE_UNKNOWN_FILE_TYPE"))
        .when(kind == "SCRAP", hit("delete", "TYPE_SCRAP_FILE_TYPE"))
        .when((kind == "CACHE") & source_there, hit("hold", "TYPE_KEEP_OWN_FILE"))
        .when(kind.isin("CACHE", "LOCK"), hit("delete", "TYPE_SWEEP_OWN_FILE"))
    )


def mark_verdict(path: Column, stored_state: Column, numbered: Column, first: Column, named: Column, library: str = "/lib/") -> Column:
    """What a row's marks say, in order of priority; null without marks.

    A block of an accepted row is held unless the row lies in the library. Replacements and
    transfers go to the candidate of the mark's number, else the first one; a replacement without
    candidates to the first row of the same name; else the row is saved.
    """
    given, target = marks(path), F.coalesce(numbered, first)
    has = lambda m: F.array_contains(given, m)
    held = has("block") & F.coalesce(stored_state >= M.ACCEPTED, F.lit(False)) & ~path.startswith(library)
    saved = hit("save", "TYPE_FILE_MARK_SAVE")
    replaced = F.when(target.isNotNull(), hit("replace", "TYPE_FILE_MARK_REPLACE", target)).when(named.isNotNull(), hit("replace", "TYPE_FILE_MARK_REPLACE", named)).otherwise(saved)
    return (
        F.when(has("hold") | held, hit("hold", "TYPE_FILE_MARK_HOLD"))
        .when(has("block"), hit("delete", "TYPE_FILE_MARK_BLOCK"))
        .when(has("dedupe"), hit("delete", "TYPE_FILE_MARK_DEDUPE"))
        .when(has("erase"), hit("delete", "TYPE_FILE_MARK_ERASE"))
        .when(has("replace"), replaced)
        .when(has("transfer"), F.when(target.isNotNull(), hit("transfer", "TYPE_FILE_MARK_TRANSFER", target)).otherwise(saved))
        .when(has("save"), saved)
    )


def evidence(rows: DataFrame, stored: DataFrame, listing: DataFrame, near: DataFrame, pairs: DataFrame, needless: DataFrame) -> DataFrame:
    """Incoming rows with what every step of the cascade looks at; each join brings one row an incoming row at most."""
    exact = M.exists(M.exact_lookup(rows, stored).join(stored.select(F.col("doc_id").alias("cat_id"), "to_path"), "cat_id"), listing)
    exact = exact.join(needless.select(F.col("doc_id").alias("cat_id"), F.lit(True).alias("needless")), "cat_id", "left")
    exact = exact.select("in_id", F.col("cat_id").alias("exact_id"), F.col("state").alias("exact_state"), "present", F.coalesce("needless", F.lit(False)).alias("needless"))
    rows = rows.withColumn("in_id", F.col("doc_id")).withColumn("asked", mark_number(F.col("from_path")))
    # only rows that ask for a number need their candidates in order
    first = pairs.groupBy("in_id").agg(F.min(F.struct("p_distance", "cat_id")).alias("first")).select("in_id", F.col("first.cat_id").alias("first_id"))
    numbered = M.ranked(pairs.join(rows.filter(F.col("asked").isNotNull()).select("in_id", "asked"), "in_id"))
    numbered = numbered.filter(F.col("rank") == F.col("asked")).select("in_id", F.col("cat_id").alias("numbered_id"))
    near = near.withColumnsRenamed({"action": "na", "reason": "nr", "hit_id": "nh", "n_candidates": "nn"})
    out = rows.join(exact, "in_id", "left").join(near, "in_id", "left").join(first, "in_id", "left").join(numbered, "in_id", "left")
    return out.join(M.name_counts(rows.drop("in_id"), stored), "in_id", "left")


def steps(ng: Column, quality: Column, source_there: Column, rejected: Column, failed: Column, instant_delete: bool = False, gate_deletes: bool = False, recovery: bool = True, no_transfer: bool = False) -> Column:
    """The cascade over rows of ``evidence``: path, kind, marks, quality, exact hash, classifier, near duplicate, name, save.

    Each step is a nullable verdict, and the first that isn't null holds. quality: the reason
    of a failed gate; rejected, failed: what the classifier said, or that it failed.
    """
    near = F.struct(F.col("na").alias("action"), F.col("nh").cast("long").alias("hit_id"), F.col("nr").alias("reason"), F.coalesce("nn", F.lit(0)).cast("int").alias("n_candidates"))
    poor = F.struct(F.lit("delete" if instant_delete else "hold").alias("action"), F.lit(None).cast("long").alias("hit_id"), quality.alias("reason"), F.lit(0).alias("n_candidates"))
    return F.coalesce(
        F.when(ng, hit("delete", "TYPE_NG_FILE_NAME")),
        kind_verdict(F.col("kind"), source_there),
        mark_verdict(F.col("from_path"), F.col("exact_state"), F.col("numbered_id"), F.col("first_id"), F.col("named")),
        F.when(quality.isNotNull(), poor),
        F.when(F.col("exact_id").isNotNull(), exact_verdict(F.col("state"), F.col("exact_id"), F.col("exact_state"), F.col("present"), F.col("needless"), recovery, no_transfer)),
        F.when(failed, hit("hold", "TYPE_DEEP_LEARNING")).when(rejected, hit("delete" if gate_deletes else "hold", "TYPE_DEEP_LEARNING")),
        F.when(F.col("na").isNotNull(), near),
        F.when(F.col("n_named") > 0, hit("hold", "TYPE_FILE_NAME_MATCH", n=F.col("n_named"))),
        hit("save", "TYPE_NO_PROBLEM"),
    )


def stored_by(action: Column, reason: Column, state: Column) -> Column:
    """State under which a verdict leaves the row's hash in the catalogue; null if it doesn't."""
    return F.when(action.isin("save", "replace", "transfer"), state).when(action == "delete", remembered_state(reason))


PLACE = ("timestamp", "from_path", "in_id")


def left_by(verdicts: DataFrame, rows: DataFrame) -> DataFrame:
    """hash, place, stored: what verdicts of rows leave for later rows of the same hash."""
    rows = rows.select(F.col("doc_id").alias("in_id"), "hash", "state", "timestamp", "from_path")
    found = verdicts.join(rows, "in_id").withColumn("stored", stored_by(F.col("action"), F.col("reason"), F.col("state")))
    return found.filter(F.col("stored").isNotNull()).select("hash", F.struct(*PLACE).alias("place"), F.col("stored").cast("long").alias("stored"))


def cascade(rows: DataFrame, verdict_of_row: Column, relocate: bool = False, earlier: DataFrame | None = None) -> DataFrame:
    """in_id, action, hit_id, reason, n_candidates of rows of ``evidence``; earlier: what former batches left.

    Rows of one hash come one after another, by time and path. The first one that the catalogue
    remembers is what those after it find stored: they are deleted as copies, or take its place
    if they are to be kept and it is only accepted. Rows before it, and those that an
    earlier step has decided, are judged on their own.
    """
    if relocate:
        return rows.select("in_id", relocation(F.col("exact_id")).alias("v")).select("in_id", "v.*")
    v = cut(rows.select("in_id", "hash", "state", "exact_id", F.struct(*PLACE).alias("place"), verdict_of_row.alias("v")), "verdicts")
    stored = stored_by(F.col("v.action"), F.col("v.reason"), F.col("state")).cast("long")
    # rows whose hash is in the catalogue have met their copy there
    fresh = v.filter(F.col("exact_id").isNull()).select("hash", "place", stored.alias("stored")).filter(F.col("stored").isNotNull())
    fresh = fresh if earlier is None else fresh.unionByName(earlier.select("hash", "place", "stored"))
    first = fresh.groupBy("hash").agg(F.min(F.struct("place", "stored")).alias("first"))
    later = (F.col("place") > F.col("first.place")) & F.col("exact_id").isNull() & F.col("v.reason").isin(AFTER_EXACT)
    again = exact_verdict(F.col("state"), F.col("first.place.in_id"), F.col("first.stored"), F.lit(True), F.lit(False))
    return v.join(first, "hash", "left").select("in_id", F.when(F.coalesce(later, F.lit(False)), again).otherwise(F.col("v")).alias("v")).select("in_id", "v.*")


#: Reasons of the steps after the exact hash.
AFTER_EXACT = [
    "TYPE_DEEP_LEARNING", "TYPE_P_HASH_MAY_BE", "TYPE_P_HASH_MATCH", "TYPE_P_HASH_MATCH_TRANSFER", "TYPE_FILE_NAME_MATCH", "TYPE_NO_PROBLEM",
    "TYPE_P_HASH_REJECT_LOW_RESOLUTION", "TYPE_P_HASH_REJECT_LOW_FILE_SIZE", "TYPE_P_HASH_REJECT_NEWER", "TYPE_P_HASH_REJECT_LOW_ENTROPY", "TYPE_P_HASH_REJECT_LOW_QUALITY",
]


def mutations(verdicts: DataFrame, rows: DataFrame, stored: DataFrame) -> DataFrame:
    """hash, op, state, from_path, to_path, row_of, hashes_of: what verdicts change in the catalogue. Holds change nothing.

    Hits may be stored rows or earlier rows of the batch. ``row_of`` is the document whose features
    are written, ``hashes_of`` the one whose similarity hashes are: a relocated row keeps the stored
    one's origin and hashes.
    """
    own_path = F.concat(F.lit("/lib/"), "type", F.lit("/"), "name", F.lit(".txt"))
    own = rows.select(F.col("doc_id").alias("in_id"), "hash", F.col("state").alias("in_state"), F.col("from_path").alias("own_from"), own_path.alias("own_path"))
    hits = stored.select(F.col("doc_id").alias("hit_id"), F.col("hash").alias("hit_hash"), F.col("from_path").alias("hit_from"), F.col("to_path").alias("hit_path"))
    hits = hits.unionByName(rows.select(F.col("doc_id").alias("hit_id"), F.col("hash").alias("hit_hash"), F.col("from_path").alias("hit_from"), own_path.alias("hit_path")))
    joined = verdicts.join(own, "in_id").join(hits, "hit_id", "left")

    def row(h, op, state, origin, path, of="in_id", hashes=None):
        to = F.col(path) if path else F.lit(None).cast("string")
        ids = [F.col(of).cast("long").alias("row_of"), F.col(hashes or of).cast("long").alias("hashes_of")]
        return F.struct(F.col(h).alias("hash"), F.lit(op).alias("op"), state.cast("long").alias("state"), F.col(origin).alias("from_path"), to.alias("to_path"), *ids)

    a, reason, state = F.col("action"), F.col("reason"), F.col("in_state")
    gone = row("hit_hash", "update", F.lit(100), "hit_from", "hit_path", "hit_id")
    nothing = F.array().cast("array<struct<hash:string,op:string,state:bigint,from_path:string,to_path:string,row_of:bigint,hashes_of:bigint>>")
    remembered = remembered_state(reason)
    plan = (
        F.when((a == "delete") & remembered.isNotNull(), F.array(row("hash", "insert", remembered, "own_from", None)))
        .when(a == "replace", F.array(gone, row("hash", "insert", state, "own_from", "hit_path")))
        .when(a == "transfer", F.array(gone, row("hash", "insert", state, "own_from", "own_path")))
        .when((a == "save") & (reason == "TYPE_HASH_MATCH_RECOVERY"), F.array(row("hash", "state", state, "own_from", "hit_path")))
        .when(a == "save", F.array(row("hash", "insert", state, "own_from", "own_path")))
        .when(a == "relocate", F.array(row("hash", "insert", state, "hit_from", "own_path", hashes="hit_id")))
        .otherwise(nothing)
    )
    return joined.select("in_id", F.explode(plan).alias("m")).select("in_id", "m.*")


def within_batch(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, first_id: each row of a batch with the earlier one that it repeats, as if rows came one after another.

    Rows are ranked by time and path; the first row of a hash stands for its copies. Among near
    pairs(a, b, distance) a row follows the nearest earlier row that is itself kept; rounds settle
    rows whose earlier partners are settled, until none is open.
    """
    order = Window.partitionBy("hash").orderBy("timestamp", "from_path", "doc_id")
    place = F.struct("timestamp", "from_path", "doc_id")
    first = rows.select("doc_id", "hash", place.alias("place"), F.first("doc_id").over(order).alias("first_id"))
    lead = first.filter(F.col("doc_id") == F.col("first_id")).select("doc_id", "place")
    side = lambda k: lead.select(F.col("doc_id").alias(k), F.col("place").alias(f"{k}_place"))
    links = pairs.select("a", "b", "distance").join(side("a"), "a").join(side("b"), "b")
    forth = F.col("a_place") < F.col("b_place")
    links = links.select(F.when(forth, F.col("b")).otherwise(F.col("a")).alias("late"), F.when(forth, F.col("a")).otherwise(F.col("b")).alias("early"), F.struct("distance", F.least("a_place", "b_place").alias("place")).alias("near")).distinct()
    kept = cut(lead.join(links.select(F.col("late").alias("doc_id")), "doc_id", "left_anti").select("doc_id"), "kept")
    dropped = links.limit(0).select(F.col("late").alias("doc_id"), F.col("early").alias("by"))
    open_ = cut(links, "open")
    while not open_.isEmpty():
        gone = dropped.select("doc_id")
        # a row is settled once all its earlier partners are: it follows the nearest kept one, else stays
        known = kept.select("doc_id", F.lit(True).alias("stays")).union(gone.select("doc_id", F.lit(False).alias("stays")))
        state = open_.join(known.select(F.col("doc_id").alias("early"), "stays"), "early", "left")
        settled = cut(state.groupBy("late").agg(F.bool_and(F.col("stays").isNotNull()).alias("known"), F.min_by("early", F.when(F.col("stays"), F.col("near"))).alias("by")).filter("known"), "settled")
        dropped = cut(dropped.union(settled.filter(F.col("by").isNotNull()).select(F.col("late").alias("doc_id"), "by")), "dropped")
        kept = cut(kept.union(settled.filter(F.col("by").isNull()).select(F.col("late").alias("doc_id"))), "kept")
        open_ = cut(open_.join(settled.select("late"), "late", "left_anti"), "open")
    return first.join(dropped.withColumnRenamed("doc_id", "first_id"), "first_id", "left").select("doc_id", F.coalesce("by", "first_id").alias("first_id"))
