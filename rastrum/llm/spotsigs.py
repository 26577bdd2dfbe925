"""SpotSigs document fingerprints in native column expressions.

A spot is a place where a common word (an anchor) stands before a content word; its signature is a hash of
the anchor and the chain of content words that follows, other anchors skipped. The set of signatures is
the fingerprint. Where a text has no anchors for RUN content words in a row, each further content word
starts a chain of its own, so lists and tables have signatures too, and they depend on the words around
only. A text without any content word has the hash of the whole text.

Sets are partitioned by their size: partition p holds the sizes from least ** -p on. Two sets in partitions
that are not neighbours, or in neighbouring ones with sizes too far apart, can't reach a similarity of least
and are not intersected; all others are compared by the Jaccard similarity. near_duplicates finds pairs in
the same way, within and between neighbouring partitions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from rastrum.session import checkpoint, partitions_of, settled

CHAIN = 3
RUN = 8
HEX = 12
LEAST = 0.2  # likeness below this counts as none
# The anchors, common words of English, German, French and Spanish.
ANCHORS = tuple(
    (
        "a an and are as at be been but by for from had has have he her his if in is it its not of on or she that the their there they this to was we were what when which who will with would you "
        "aber als am auch auf aus bei bin das dass dem den der des die durch ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sich sie sind so über um und von vor war wenn wer wie wir zu zum zur "
        "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais ne nous ou où par pas pour que qui sa se ses son sont sur un une vous "
        "al como con del desde e el ella ellos era esta este ha hay las lo los más mi muy no para pero por sin sobre su sus también te tiene todo y ya"
    ).split()
)


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted set of signatures of a text column that is not null."""
    held = ["_words", "_at", "_chains"]
    at = lambda c, i: F.get(F.col(c), i)
    word = lambda k: at("_words", at("_at", k))
    df = df.withColumn("_words", F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"))
    content = F.transform("_words", lambda w, i: F.when((w != "") & ~w.isin(*ANCHORS), i))
    df = df.withColumn("_at", F.filter(content, lambda i: i.isNotNull()))

    def chain(_, k):
        before = at("_words", at("_at", k) - 1)
        spot = (k == 0) | (at("_at", k) - at("_at", k - 1) > 1)
        bare = at("_at", k) - at("_at", k - RUN) == RUN
        words = [word(k + j) for j in range(CHAIN)]
        return F.when(spot, F.xxhash64(F.when(at("_at", k) > 0, before), *words)).when(bare, F.xxhash64(*words))

    df = df.withColumn("_chains", F.filter(F.transform("_at", chain), lambda h: h.isNotNull()))
    whole = F.when(F.col(text) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.col(text))))
    found = F.when(F.size("_at") > 0, F.array_distinct("_chains")).otherwise(whole)
    return df.withColumn(name, F.sort_array(F.transform(found, lambda h: h.bitwiseAND(F.lit((1 << (4 * HEX)) - 1))))).drop(*held)


def text_of(signatures: Column) -> Column:
    """A fingerprint as text: the sorted signatures, HEX digits each; empty for an empty text."""
    return F.lower(F.array_join(F.transform(signatures, lambda h: F.lpad(F.hex(h), HEX, "0")), ""))


def size_partition(n: Column, least: float) -> Column:
    """The partition of sets of n signatures: p holds the sizes from least ** -p on, so a partner at least alike is in the same or a neighbouring one; -1 for empty sets."""
    return F.when(n > 0, F.floor(F.log(n.cast("double")) / F.lit(-math.log(least) * (1 + 1e-9))).cast("int")).otherwise(F.lit(-1))


def likeness(a: Column, b: Column, least: float) -> Column:
    """Jaccard similarity of two signature sets, 0 if it is below least; 1 for two empty ones. Where the partitions or the sizes rule out least the sets are not intersected."""
    m, n = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    apart = F.abs(size_partition(F.size(a), least) - size_partition(F.size(b), least)) > 1
    shared = F.size(F.array_intersect(a, b))
    jaccard = shared / (m + n - shared).cast("double")
    return F.when(n == 0, F.lit(1.0)).when((m == 0) | apart | (m < (least - 1e-9) * n), F.lit(0.0)).otherwise(F.when(jaccard >= least - 1e-9, jaccard).otherwise(F.lit(0.0)))


def in_ranges(df: DataFrame, id_col: str, text_col: str, ranges: int) -> tuple[DataFrame, WindowSpec]:
    """df dealt by ranges of ids, and a window in which the next row by ascending id (nulls first, then a hash of the text, then the text) follows.

    After the last row comes the first. Rows are cut into ranges of ids at quantiles; an id that is on more
    rows than two ranges hold, or null if it is, has ranges of its own, cut by the hash, so no task gets all of
    them. The first row of each range is also sent to the range before it as a guest.
    """
    key = F.col(id_col)
    df = df.withColumn("_hash", F.shiftrightunsigned(F.xxhash64(text_col), 1))
    cuts = df.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("q"), F.min(id_col).alias("lo"), F.count("*").alias("n")).first()
    share = max(1, -(-cuts["n"] // ranges))
    hot = {r[id_col]: -(-r["n"] // share) for r in df.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 2 * share).collect()}  # half as many as ranges at most
    bounds = set((cuts["q"] or []) if ranges > 1 else []) - {cuts["lo"]}
    bounds = sorted(bounds | {b for h in hot if h is not None for b in (h, h + 1) if b < 1 << 63})
    # two levels of cuts, so that finding a range costs the root of their number
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b).cast("long") for b in bounds[::step]]) if bounds else F.array().cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(b).cast("long") for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)]) if bounds else F.array().cast("array<array<bigint>>")
    outer = F.size(F.filter(coarse, lambda b: b <= key))
    inner = F.when(outer > 0, (outer - 1) * step + F.size(F.filter(F.get(fine, outer - 1), lambda b: b <= key))).otherwise(F.lit(0))
    parts = F.lit(1)
    for h, k in hot.items():
        parts = F.when(key.isNull() if h is None else key == F.lit(h).cast("long"), k).otherwise(parts)
    at = F.floor(F.col("_hash") / F.lit(2.0**63) * parts)
    df = df.withColumns({"_range": F.when(key.isNull(), F.lit(-1 if None in hot else 0)).otherwise(inner).cast("int"), "_part": F.least(at, parts - 1).cast("int")})
    segment = ["_range", "_part"]
    found = df.groupBy(*segment).agg(F.min(F.struct(key.isNotNull().alias("known"), key.alias("id"), "_hash")).alias("first")).orderBy(*segment).collect()  # as many as ranges, about
    before = [(r["_range"], r["_part"], r["first"]["id"], r["first"]["_hash"], found[i - 1]["_range"], found[i - 1]["_part"]) for i, r in enumerate(found)]
    firsts = df.sparkSession.createDataFrame(before, "_range int, _part int, _first_id long, _first_hash long, _to_range int, _to_part int")
    held = df.join(F.broadcast(firsts), segment)
    is_first = key.eqNullSafe(F.col("_first_id")) & (F.col("_hash") == F.col("_first_hash"))
    copy = lambda r, p, guest: F.struct(F.col(r).alias("r"), F.col(p).alias("p"), F.lit(guest).alias("guest"))
    own, guest = copy("_range", "_part", False), copy("_to_range", "_to_part", True)
    sent = held.withColumn("_copy", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))))
    sent = sent.withColumns({"_range": F.col("_copy.r"), "_part": F.col("_copy.p"), "_guest": F.col("_copy.guest")}).drop("_copy", "_first_id", "_first_hash", "_to_range", "_to_part")
    order = Window.partitionBy(*segment).orderBy(F.col("_guest"), key.asc_nulls_first(), F.col("_hash"), F.col(text_col))
    return sent, order


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, sigs) of each row; a null text is empty."""
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_signatures(df, "text", "sigs")


def edit_robustness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's.

    The edited text keeps all but the last floor(n / 2) code points and goes on with as many of the next
    document by ascending id (all, if it has fewer); after the last comes the first. Null ids come first;
    rows with equal ids follow each other by a hash of the text; a single row is followed by itself. A null text is
    empty; two empty fingerprints are alike (1), and fingerprints with a likeness below least are not alike (0). size_partition is the partition of the fingerprint by its size. An empty table gives an
    empty result; other columns are ignored.
    """
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sent, order = in_ranges(df, "doc_id", "text", 4 * partitions_of(docs.sparkSession))
    rows = sent.withColumn("next_text", F.lead("text").over(order))
    rows = with_signatures(rows, "text", "sigs").withColumn("next_sigs", F.lead("sigs").over(order)).where(~F.col("_guest"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", 1, n - half), F.substring("next_text", 1, half)))
    rows = with_signatures(rows, "edited", "edited_sigs")
    out = rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sigs")).alias("fingerprint"),
        text_of(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs"), least).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs"), least).alias("near_next"),
        F.size("sigs").alias("n_signatures"),
        size_partition(F.size("sigs"), least).alias("size_partition"),
    )
    return settled(out)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): each row's class, and the pairs of classes whose sets have a similarity of least or more.

    classes has doc_id and class_id, the smallest id with the same set; pairs has a, b (class ids, a < b)
    and similarity, each pair once. Sets are partitioned by size: partition p holds the sizes from
    least ** -p on, so a partner is in the same or a neighbouring partition. In a partition, sets meet at
    the signatures that the prefix rule leaves, the rarest over all sets first. Rows with null ids have
    classes of their own only if no other id shares their set. Empty sets are one class without partners.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col).select("doc_id", "sigs"))
    sets = rows.groupBy(F.xxhash64("sigs").alias("h"), "sigs").agg(F.min("doc_id").alias("class_id"))
    sets = checkpoint(sets.withColumn("n", F.size("sigs")))
    counts = sets.select(F.explode("sigs").alias("s")).groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = sets.select("class_id", "n", F.explode("sigs").alias("s")).join(counts, "s")
    # signatures of one set only can't be shared; they still count in the prefix's length, before all others
    own = ranked.groupBy("class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"))
    keep = F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("shared"))
    prefix = own.where(keep > 0).select("class_id", "n", F.posexplode(F.slice("shared", F.lit(1), keep.cast("int"))).alias("i", "x")).select("class_id", "n", "i", F.col("x.s").alias("s"))
    left = prefix.withColumn("p", size_partition(F.col("n"), least))
    right = left.select(F.col("class_id").alias("b"), F.col("n").alias("m"), "s", F.explode(F.array(F.col("p"), F.col("p") + 1, F.col("p") - 1)).alias("p"))
    met = left.join(right, ["s", "p"]).where((F.col("class_id") < F.col("b")) & (F.least("n", "m") >= F.lit(least - 1e-9) * F.greatest("n", "m"))).select(F.col("class_id").alias("a"), "b").distinct()
    a, b = sets.select(F.col("class_id").alias("a"), F.col("sigs").alias("x")), sets.select(F.col("class_id").alias("b"), F.col("sigs").alias("y"))
    pairs = met.join(a, "a").join(b, "b").select("a", "b", likeness(F.col("x"), F.col("y"), least).alias("similarity")).where(F.col("similarity") >= least)
    classes = rows.join(sets.select("sigs", "class_id"), "sigs").select("doc_id", "class_id")
    return classes, pairs
