"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame operations alone.

Paragraphs, cut after `PIECE` code points, are hashed; each digest is added to one cell of each of three tables: its
count, digest and checksum. Subtracting the sketches of two versions leaves the digests they do not share, and
peeling takes them out one table after another: a cell with one digest gives it away, and it is taken from its
other cells. Where digests are left over, the sketches are built anew, larger and with other cells.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stopclock.llm.store import one_per_document, stored

PIECE = 64
#: Cells of each of the three tables of a fingerprint, and of a sketch to be subtracted: so many for each digest
#: of both versions, and at least so many.
CELLS, PER_DIGEST, LEAST = 5, 16, 256
TURNS = 6
RETRY = 16
#: Documents are handled in groups of consecutive ids, dealt over SPREAD times the session's shuffle partitions: a
#: document is many rows of cells.
GROUP_BITS, SPREAD = 10, 4


def digests(text: Column) -> Column:
    """Distinct hashes of the paragraphs of a text; null has none."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\n]{1,%d}" % PIECE), F.lit(0))
    return F.array_distinct(F.transform(pieces, lambda x: F.xxhash64(x)))


def _following(ids: DataFrame) -> DataFrame:
    """id, next: the next larger id of each id but the largest. Ids are ordered within groups of consecutive values;
    the groups are ordered the same way, one level up."""
    grouped = ids.select("id", F.shiftright("id", GROUP_BITS).alias("group"))
    inner = grouped.withColumn("next", F.lead("id").over(Window.partitionBy("group").orderBy("id")))
    groups = stored(grouped.groupBy("group").agg(F.min("id").alias("first")), "groups")
    if groups.limit(1 << GROUP_BITS).count() < 1 << GROUP_BITS:  # few enough to be put in one order
        above = groups.select("group", F.lead("group").over(Window.partitionBy(F.lit(0)).orderBy("group")).alias("group_"))
    else:
        above = _following(groups.select(F.col("group").alias("id"))).select(F.col("id").alias("group"), F.col("next").alias("group_"))
    after = above.join(groups.select(F.col("group").alias("group_"), "first"), "group_").select("group", "first")
    ends = inner.where("next is null").join(after, "group").select("id", F.col("first").alias("next"))
    return inner.select("id", "next").where("next is not null").unionByName(ends)


def _with_next(docs: DataFrame) -> DataFrame:
    """group, doc_id, text, next_text: each document with the text of the next doc_id, the last with the first's."""
    ids = stored(docs.select(F.col("doc_id").alias("id")), "ids")
    least, most = ids.agg(F.min("id"), F.max("id")).first()
    firsts = ids.select(F.shiftright("id", GROUP_BITS).alias("group")).distinct()
    order = _following(firsts.select(F.col("group").alias("id"))).select(F.col("id").alias("before"), F.col("next").alias("group"))
    if least is not None:
        ends = firsts.where(F.col("group") == F.shiftright(F.lit(least), GROUP_BITS)).select(F.shiftright(F.lit(most), GROUP_BITS).alias("before"), "group")
        order = order.unionByName(ends)
    order = stored(order, "order")
    per = Window.partitionBy("group").orderBy("doc_id")
    texts = docs.select(F.shiftright("doc_id", GROUP_BITS).alias("group"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.col("group").isNotNull())  # said here, the texts are shuffled once for both uses below
    texts = texts.repartition(SPREAD * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "group")
    texts = texts.withColumns({"next_text": F.lead("text").over(per), "place": F.row_number().over(per)})
    opening = texts.where("place = 1").select("group", F.col("text").alias("opening"))
    opening = opening.join(order, "group").select(F.col("before").alias("group"), "opening")
    # one row per group: the opening text of the next group
    out = texts.join(opening, "group", "left")
    return out.select("group", "doc_id", "text", F.coalesce("next_text", "opening", F.lit("")).alias("next_text"))


def _sketched(versions: DataFrame, growth: int, salt: int) -> DataFrame:
    """group, made: per group a map of doc_id to fingerprint, edited fingerprint, the numbers of digests, and for either
    pair how many digests were recovered and how many cells remain. No row leaves the partition of its group."""
    marked = [F.expr(f"transform({c}, k -> struct({w} as which, k as digest))") for w, c in enumerate(("own", "edited", "following"))]
    entry = F.explode(F.concat(*marked))
    each = versions.select("group", "doc_id", *[F.size(c).alias(f"n{w}") for w, c in enumerate(("own", "edited", "following"))], entry.alias("e"))
    each = each.select("group", "doc_id", "n0", "n1", "n2", "e.which", "e.digest")
    # kinds: 0 and 1 are fingerprints of the text and the edited text, 2 and 3 the differences to the edited and the next
    turns = {0: [0, 2, 3], 1: [1, 2], 2: [3]}
    spots = {w: F.array(*[F.lit(kind * 3 + table) for kind in kinds for table in range(3)]) for w, kinds in turns.items()}
    placed = each.withColumn("spot", F.explode(F.when(F.col("which") == 0, spots[0]).when(F.col("which") == 1, spots[1]).otherwise(spots[2])))
    placed = placed.withColumn("kind", F.floor(F.col("spot") / 3).cast("int")).withColumn("table", F.col("spot") % 3)
    other = F.when(F.col("kind") == 2, F.col("n1")).otherwise(F.col("n2"))
    width = F.when(F.col("kind") < 2, F.lit(CELLS)).otherwise(F.greatest(F.lit(LEAST), PER_DIGEST * (F.col("n0") + other)) * growth).cast("int")
    placed = placed.withColumn("width", width)

    def cell(digest: str, table: str, width: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64({digest}, {table}, {salt}), {width}) as int) * 3 + {table}")

    owner = ["group", "doc_id", "n0", "n1", "n2"]
    keys = [*owner, "kind", "cell"]
    sign = F.when((F.col("kind") >= 2) & (F.col("which") > 0), -1).otherwise(1)
    cells = placed.select(*owner, "kind", cell("digest", "table", "width").alias("cell"), sign.alias("n"), "digest", F.expr("hash(digest, 7)").alias("proof"))
    summed = [F.sum("n").cast("int").alias("n"), F.bit_xor("digest").alias("digest"), F.bit_xor("proof").alias("proof")]
    cells = cells.groupBy(*keys).agg(*summed).where("n <> 0 or digest <> 0 or proof <> 0").withColumn("found", F.lit(0))
    for turn in range(TURNS):
        table = turn % 3
        cells = cells.withColumn("width", width)
        pure = F.expr(
            f"kind >= 2 and cell >= 0 and cell % 3 = {table} and abs(n) = 1 and proof = hash(digest, 7) "
            f"and cell = cast(pmod(xxhash64(digest, {table}, {salt}), width) as int) * 3 + {table}"
        )
        taken = [F.struct(cell("digest", str(t), "width").alias("cell"), (-F.col("n")).alias("n"), "digest", "proof", F.lit(0).alias("found")) for t in range(3) if t != table]
        noted = F.struct(F.lit(-1).alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("digest"), F.lit(0).alias("proof"), F.lit(1).alias("found"))
        same = F.struct("cell", "n", "digest", "proof", "found")
        cells = cells.select(*owner, "kind", F.explode(F.when(pure, F.array(*taken, noted)).otherwise(F.array(same))).alias("c"))
        cells = cells.select(*owner, "kind", "c.*").groupBy(*keys).agg(*summed, F.sum("found").cast("int").alias("found"))
        cells = cells.where("n <> 0 or digest <> 0 or proof <> 0 or found > 0")
    shown = F.struct("cell", F.concat(F.hex(F.col("n").cast("long")), F.lit(":"), F.hex("digest"), F.lit(":"), F.substring(F.hex(F.col("proof").cast("long")), -8, 8)).alias("body"))
    out = [F.sort_array(F.collect_list(F.when(F.col("kind") == k, shown))).alias(f"cells{k}") for k in (0, 1)]
    for k in (2, 3):
        out.append(F.sum(F.when((F.col("kind") == k) & (F.col("cell") < 0), F.col("found")).otherwise(0)).alias(f"found{k}"))
        out.append(F.sum(F.when((F.col("kind") == k) & (F.col("cell") >= 0), 1).otherwise(0)).alias(f"left{k}"))
    told = [F.array_join(F.transform(f"cells{k}", lambda c: F.concat(c["cell"].cast("string"), F.lit("="), c["body"])), " ").alias(f"print{k}") for k in (0, 1)]
    made = cells.groupBy(*owner).agg(*out).select("group", "doc_id", F.struct(*told, "n0", "n1", "n2", "found2", "left2", "found3", "left3").alias("sketch"))
    return made.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("doc_id", "sketch"))).alias("made"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document's text by doc_id; after the last comes the first. A fingerprint lists the filled cells of a text's
    sketch. The likeness of two texts is 1 - d / n: d digests recovered from the difference of their sketches, n
    digests of both; of two texts without digests it is 1.

    Null texts are empty; empty texts have the empty fingerprint. One document alone is its own next. Rows without a
    doc_id have no place in the order and are left out; rows that repeat a doc_id are one document
    (`one_per_document`). Further columns are ignored. Texts differ in their digests if their paragraphs, cut after
    64 code points, do; repeated paragraphs count once.
    """
    docs = one_per_document(docs, "text").where("doc_id is not null")
    texts = _with_next(docs).withColumn("cut", F.expr("int(length(text) / 4)"))
    edited = F.expr("concat(left(text, length(text) - cut), left(next_text, cut))")
    versions = texts.select("group", "doc_id", digests(F.col("text")).alias("own"), digests(edited).alias("edited"), digests(F.col("next_text")).alias("following"))
    first = _sketched(versions, 1, 0)
    failed = F.expr("transform(filter(map_entries(made), e -> e.value.left2 + e.value.left3 > 0), e -> e.key)")
    again = first.select("group", failed.alias("again")).where(F.size("again") > 0)
    second = _sketched(versions.join(again, "group").where(F.array_contains("again", F.col("doc_id"))), RETRY, 1)

    out = texts.join(first, "group", "left").join(second.withColumnRenamed("made", "remade"), "group", "left")
    out = out.withColumn("sketch", F.try_element_at("made", F.col("doc_id")))
    out = out.withColumn("peeled", F.coalesce(F.try_element_at("remade", F.col("doc_id")), F.col("sketch")))

    def near(k: int, other: str) -> Column:
        total = F.col("sketch.n0") + F.col(f"sketch.{other}")
        likeness = F.when(total > 0, 1 - F.col(f"peeled.found{k}") / total).otherwise(1.0)
        return F.when(F.col(f"peeled.left{k}") > 0, F.raise_error(F.lit("the larger sketch could not be peeled either"))).otherwise(likeness)

    return out.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        edited.alias("edited"),
        F.coalesce("sketch.print0", F.lit("")).alias("fingerprint"),
        F.coalesce("sketch.print1", F.lit("")).alias("edited_fingerprint"),
        near(2, "n1").alias("near_edited"),
        near(3, "n2").alias("near_next"),
    )
