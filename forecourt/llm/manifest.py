"""Merkle manifest of a dataset: a proof for every row from bitmap ranks and slot arrays.

Each language is a group. Its doc_ids form a compressed bitmap, one table row
for every word of 64 ids that holds any; partial bitmaps of tasks merge by OR.
A directory counts the rows before each word, and a leaf's place is the count
of its word and the population count of the lower bits in it: no sort of rows.
Eight neighbours fill the slots of an array keyed by their place over eight,
whose digest is a node of the next level; four levels need one shuffle, and
rounds of four go on until each group has one node. The groups' nodes are
reduced in the same way. Siblings then come down level by level from rows that
hold whole runs, so no list of proofs is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from forecourt.llm.common import lowered, stored

#: Children of a node, and levels that a round reduces in one shuffle.
FAN, ROUND = 8, 4

#: Entries of one level of the directory below a common entry of the next, as a power of two.
DIRECTORY_BITS = 12

#: The word of rows without a doc_id: below all others, whose numbers take 58 bits.
NO_WORD = -(1 << 58)

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: list[Column]) -> Column:
    """SHA-256 in lower-case hex of the texts' byte counts and values; ``-`` for null."""
    sized = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.sha2(F.concat(*sized), 256)


def leaves(docs: DataFrame, tamper: bool) -> DataFrame:
    """Stored (doc_id, grp, leaf, other); ``other`` is the leaf of a tampered row, null where the row is as it was.

    ``grp`` names the language; the null one comes before all others.
    """
    text = {c: F.col(c).cast("string") for c in FIELDS}
    other = F.lit(None).cast("string")
    if tamper:
        changed = [lowered(text[c]) if c == "text" else text[c] for c in FIELDS]
        other = F.when(F.crc32(text["doc_id"].cast("binary")) % 3 == 0, digest(changed))
    return stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("1"), text["lang"]), F.lit("0")).alias("grp"),
            digest([text[c] for c in FIELDS]).alias("leaf"),
            other.alias("other"),
        )
    )


def _before(column: str, *keys: str, order: str) -> Column:
    """Sum of ``column`` over the earlier rows of the same keys."""
    over = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(over), F.lit(0).cast("long"))


def _directory(counts: DataFrame) -> DataFrame:
    """Rows (grp, word, n, ...) with ``before``, the sum of n over the group's smaller words.

    Sums go up by parts of the word until a group has few of them, then down
    again, so that no task adds up more than one entry's parts.
    """
    levels, parent = [counts], f"shiftright(word, {DIRECTORY_BITS})"
    while True:
        level = levels[-1]
        most = level.groupBy("grp").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0]
        if (most or 0) <= 1 << DIRECTORY_BITS:
            break
        levels.append(stored(level.groupBy("grp", F.expr(parent).alias("word")).agg(F.sum("n").alias("n"))))
    out = levels.pop().withColumn("before", _before("n", "grp", order="word"))
    while levels:
        up = out.select("grp", F.col("word").alias("up"), F.col("before").alias("up_before"))
        inside = levels.pop().withColumn("up", F.expr(parent)).withColumn("inside", _before("n", "grp", "up", order="word"))
        out = inside.join(up, ["grp", "up"]).withColumn("before", F.col("up_before") + F.col("inside"))
        out = out.drop("up", "up_before", "inside")
    return out


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, grp, leaf, other) with ``pos``, their place in the group by doc_id, and ``n``, the group's rows.

    Rows without a doc_id come first; rows of one doc_id follow each other by
    their leaves.
    """
    word = F.coalesce(F.shiftright("doc_id", 6), F.lit(NO_WORD))
    bit = "cast(coalesce(doc_id, 0) & 63 as int)"
    rows = rows.withColumn("word", word)
    bitmap = stored(
        rows.groupBy("grp", "word").agg(F.expr(f"bit_or(shiftleft(1L, {bit}))").alias("bits"), F.count("*").alias("n"))
    )
    sizes = bitmap.groupBy("grp").agg(F.sum("n").alias("group_n"))
    bitmap = stored(_directory(bitmap).join(sizes, "grp"))
    # A word with more rows than bits holds repeated ids; only their rows need the ranks of ties.
    crowded = (F.col("n") > F.bit_count("bits")) | (F.col("word") == NO_WORD)
    ranked = rows.join(bitmap, ["grp", "word"])
    columns = ["doc_id", "grp", "leaf", "other", "group_n"]
    single = ranked.filter(~crowded).select(
        *columns, F.expr(f"before + bit_count(bits & ~shiftleft(-1L, {bit}))").alias("pos")
    )
    # Equal rows are one row with a count until their places are known.
    ties = ranked.filter(crowded).groupBy(*columns, "word", "before").agg(F.count("*").alias("copies"))
    ties = stored(ties.withColumn("prefix", F.substring("leaf", 1, 4)).withColumn("id", F.coalesce("doc_id", F.lit(0))))
    same_id = ties.groupBy("grp", "word", "id").agg(F.sum("copies").alias("c"))
    same_id = same_id.withColumn("id_at", _before("c", "grp", "word", order="id")).drop("c")
    same_prefix = ties.groupBy("grp", "word", "id", "prefix").agg(F.sum("copies").alias("c"))
    same_prefix = same_prefix.withColumn("prefix_at", _before("c", "grp", "word", "id", order="prefix")).drop("c")
    ties = ties.withColumn("leaf_at", _before("copies", "grp", "word", "id", "prefix", order="leaf"))
    ties = ties.join(same_id, ["grp", "word", "id"]).join(same_prefix, ["grp", "word", "id", "prefix"])
    first = F.col("before") + F.col("id_at") + F.col("prefix_at") + F.col("leaf_at")
    ties = ties.withColumn("pos", F.explode(F.sequence(first, first + F.col("copies") - 1)))
    return single.unionByName(ties.select(single.columns)).withColumnRenamed("group_n", "n")


def _round(nodes: DataFrame) -> DataFrame:
    """Stored rows (grp, n, pos, digest, kids): up to ``FAN ** ROUND`` neighbours of ``nodes`` (grp, n, pos, digest, own) each.

    ``n`` counts the group's nodes below; ``kids`` nests the levels. A level
    where the group has one node passes it on.
    """
    level = nodes.withColumn("top", F.expr(f"pos div {FAN**ROUND}")).repartition("grp", "top")
    level = level.select("grp", "top", "n", "pos", "digest", F.col("own").alias("kids"))
    for k in range(ROUND):
        slots = level.groupBy("grp", "top", "n", F.expr(f"pos div {FAN}").alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct((F.col("pos") % FAN).cast("int").alias("slot"), "digest", "kids"))).alias("kids")
        )
        node = F.when(F.col("n") > FAN**k, F.sha2(F.array_join("kids.digest", ""), 256)).otherwise(F.col("kids")[0]["digest"])
        level = slots.withColumn("digest", node)
    return stored(level.select("grp", "n", "pos", "digest", "kids"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Rounds until every group has one node; at least one."""
    out = []
    while True:
        out.append(_round(nodes))
        top = out[-1]
        if (top.agg(F.max("n")).first()[0] or 0) <= FAN**ROUND:
            return out
        n = F.expr(f"(n + {FAN**ROUND - 1}) div {FAN**ROUND}")
        nodes = top.select("grp", n.alias("n"), "pos", "digest", F.lit(None).cast("int").alias("own"))


def _down(rounds: list[DataFrame], heads: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes at the bottom of ``rounds`` (grp, pos, digest, kids) with their siblings ``above``, nearest level first.

    ``heads`` (grp, above, and the ``carried`` columns) says what comes above
    each group. An entry of ``above`` has the digests left and right of the path.
    """
    level = rounds[-1].join(heads, "grp")
    for i in range(len(rounds) - 1, -1, -1):
        for k in range(ROUND - 1, -1, -1):
            level = level.select("grp", "n", "pos", "kids", "above", *carried, F.explode("kids").alias("kid"))
            left = F.array_join(F.filter("kids", lambda x: x["slot"] < F.col("kid.slot"))["digest"], "")
            right = F.array_join(F.filter("kids", lambda x: x["slot"] > F.col("kid.slot"))["digest"], "")
            entry = F.array(F.struct(left.alias("left"), right.alias("right")))
            above = F.when(F.col("n") > FAN**k, F.concat(entry, "above")).otherwise(F.col("above"))
            place = F.col("pos") * FAN + F.col("kid.slot")
            level = level.select(
                "grp", "n", place.alias("pos"), F.col("kid.digest").alias("digest"), F.col("kid.kids").alias("kids"), above.alias("above"), *carried
            )
        if i:
            level = rounds[i - 1].join(level.select("grp", "pos", "above", *carried), ["grp", "pos"])
    return level


def _in_order(groups: DataFrame) -> DataFrame:
    """``groups`` (grp, digest) with their places ``pos`` by name and their number ``n``, sorted by blocks of equal first bytes."""
    groups = groups.withColumn("first", F.substring(F.hex(F.col("grp").cast("binary")), 1, 6))
    blocks = groups.groupBy("first").agg(F.count("*").alias("c"))
    everything = W.partitionBy(F.lit(0))  # at most a row for each two first bytes of a name
    blocks = blocks.select(
        "first",
        F.coalesce(F.sum("c").over(everything.orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("at"),
        F.sum("c").over(everything).alias("n"),
    )
    inside = F.row_number().over(W.partitionBy("first").orderBy("grp")) - 1
    return groups.withColumn("inside", inside).join(blocks, "first").withColumn("pos", F.col("at") + F.col("inside"))


def manifest(docs: DataFrame, tamper: bool = False) -> DataFrame:
    """Leaf, subroot, root and proof of each row of ``docs`` (doc_id, source, lang, n_chars, text).

    ``proof_sha256`` digests the siblings from the leaf to the root;
    ``folded_root`` folds the leaf with them, and ``verified`` says if that is
    the root. With ``tamper``, rows whose id's checksum 3 divides fold the leaf
    of a changed text. Null ids come first in their language and are not
    tampered with; a null language is a group of its own, before all others;
    each repeated row is a leaf, rows of one id are in the order of their
    leaves; an empty table gives no rows; other columns are ignored.
    """
    rows = placed(leaves(docs, tamper))
    own = F.struct("doc_id", "other").alias("own")
    inner = _rounds(rows.select("grp", "n", "pos", F.col("leaf").alias("digest"), own))
    subroots = inner[-1].select("grp", "digest")
    named = _in_order(subroots)
    outer = _rounds(
        named.select(F.lit("").alias("grp"), "n", "pos", "digest", F.struct(F.col("grp").alias("name")).alias("own"))
    )
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    head = outer[-1].select("grp", F.col("digest").alias("root"), nothing.alias("above"))
    tops = _down(outer, head, ["root"])
    tops = stored(tops.select(F.col("kids.name").alias("grp"), "above", F.col("digest").alias("subroot"), "root"))
    found = _down(inner, tops, ["subroot", "root"])
    proof = F.array_join(F.transform("above", lambda a: F.concat(a["left"], a["right"])), "")
    start = F.coalesce("kids.other", "digest")
    folded = F.aggregate("above", start, lambda at, a: F.sha2(F.concat(a["left"], at, a["right"]), 256))
    return found.select(
        F.col("kids.doc_id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(proof, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
