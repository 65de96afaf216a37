"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Labels (shards) start from a hash of the id. In each round a join of the linked documents
with the label counts of their neighbours moves them to the labels most of their neighbours have, as many labels as their group needs given
the room in each (a shard's share less the linked documents there; unlinked ones can always give way). Quotas hold what may enter a shard to
its room (what is small beside the room by a hash of the group, else by a hash of the document). Moves go to strictly larger (count, hash) labels only,
so a round raises the sum of squared counts and rounds end; they stop when fewer than one document in 10,000 moved (``rounds`` is a
bound; the check tables take two or three). Last, exact quotas: shards above their share give rows to those below, unlinked ones first, so links are cut only where a
group exceeds a share.

Scale. The text is read once, into size, checksum and group; rounds shuffle five short columns. Counts by (group, shard) are
pre-aggregated, so a group with a third of all rows is at most ``n_shards`` rows; the join back to its documents is
one that adaptive execution can split. Ranks are dealt by (shard, salt), a large group over several salts. The driver sees n_shards numbers a round.

Law: ``rows``, counts differ by one at most. Defined results: a null text is empty (0 bytes, checksum of nothing) and linked to
other empty texts. Repeated rows come out each and are linked. A null id is left out. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import bucket_rank, durable, one_row_per_document, written

ROWS_PER_SALT = 4096
#: Rounds end when fewer than this part of the documents moved.
SETTLED = 1e-4


def _number(values: list, index: Column) -> Column:
    """values[index] as an expression."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _by_shard(df: DataFrame, column: str, n_shards: int) -> list[int]:
    """Rows of each shard: n_shards numbers."""
    found = {r[0]: r[1] for r in df.groupBy(column).count().collect()}
    return [found.get(s, 0) for s in range(n_shards)]


def homes_of(linked: DataFrame, room: list[float]) -> DataFrame:
    """grp, shard, n, to, part_to, whole: where the rows of a group's other shards should go.

    A group's shards in order of (count, hash) are its homes as long as those before can't hold all its members with their room. What lies
    elsewhere goes to the homes with room: if all of it is small beside the room of the first of them, to that one, else to all in proportion to their room.
    A group has at most n_shards rows here, so its window is bounded.
    """
    w = Window.partitionBy("grp").orderBy(F.desc("n"), F.desc("tie"), F.desc("shard"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    space = _number(room, F.col("shard"))
    ranked = linked.withColumn("space", space).withColumn("members", F.sum("n").over(Window.partitionBy("grp"))).withColumn("held", F.coalesce(F.sum(F.col("n") + F.col("space")).over(before), F.lit(0.0)))
    ranked = ranked.withColumn("home", F.col("held") < F.col("members")).withColumn("place", F.row_number().over(w))
    open_homes = ranked.where("home and space >= 1").select("grp", F.col("shard").alias("to"), F.col("space").alias("to_space"), F.col("place").alias("to_place"))
    moving = F.sum("n").over(Window.partitionBy("grp"))
    pairs = ranked.where("not home").select("grp", "shard", "n", moving.alias("moving")).join(open_homes, "grp")
    own = Window.partitionBy("grp", "shard")
    pairs = pairs.withColumn("first", F.min(F.struct("to_place", "to_space")).over(own)).withColumn("all", F.sum("to_space").over(own)).withColumn("whole", F.col("moving") <= F.col("first.to_space") / 8)
    kept = pairs.where("not whole or to_place = first.to_place")
    return kept.select("grp", "shard", "n", "to", F.when(F.col("whole"), F.lit(1.0)).otherwise(F.col("to_space") / F.col("all")).alias("part_to"), "whole")


def propagate(rows: DataFrame, n_shards: int, share: float, step: int) -> tuple[DataFrame, int]:
    """One round: linked rows move to their neighbours' most frequent labels with room. Returns the rows and the moves."""
    room = [max(0.0, share - n) for n in _by_shard(rows.where("linked"), "shard", n_shards)]
    linked = rows.where("linked").groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")).withColumn("tie", F.xxhash64("grp", "shard"))
    # one row per source: its homes, each with the upper end of its part in [0, 1] and the rows that ask for it
    wish = homes_of(linked, room).withColumn("end", F.sum("part_to").over(Window.partitionBy("grp", "shard").orderBy("to")))
    wish = written(wish.groupBy("grp", "shard", "whole").agg(F.array_sort(F.collect_list(F.struct("end", "to", (F.col("n") * F.col("part_to")).alias("asks")))).alias("homes")))
    asks = wish.select("whole", F.inline("homes")).groupBy("to").agg(F.sum(F.when(F.col("whole"), F.col("asks")).otherwise(0.0)), F.sum(F.when(F.col("whole"), 0.0).otherwise(F.col("asks"))))
    asked = {r[0]: (r[1], r[2]) for r in asks.collect()}
    if not asked:
        return rows, 0
    small, large = ([asked.get(s, (0.0, 0.0))[i] for s in range(n_shards)] for i in (0, 1))
    small_ratio = [min(1.0, r / max(1.0, w)) for r, w in zip(room, small)]
    large_ratio = [min(1.0, max(0.0, r - w) / max(1.0, x)) for r, w, x in zip(room, small, large)]
    chance = lambda *of: F.pmod(F.xxhash64(*of, F.lit(step)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    drawn = F.filter("homes", lambda h: chance("doc_id", F.lit("home")) < h["end"])
    pick = F.coalesce(F.get(drawn, F.lit(0)), F.element_at("homes", -1))["to"]
    moved = rows.join(wish, ["grp", "shard"], "left").withColumn("to", F.when(F.col("homes").isNotNull(), pick))
    taken = F.col("to").isNotNull() & F.when(F.col("whole"), chance("grp") < _number(small_ratio, F.col("to"))).otherwise(chance("doc_id") < _number(large_ratio, F.col("to")))
    out = durable(moved.select("doc_id", "size", "text_crc32", "grp", "linked", "part", F.when(taken, F.col("to")).otherwise(F.col("shard")).alias("shard"), F.coalesce(taken, F.lit(False)).alias("moved")))
    return out.drop("moved"), out.where("moved").count()


def settle(rows: DataFrame, n_shards: int) -> DataFrame:
    """Exact quotas: what is above a shard's share goes to shards below theirs, unlinked rows first, then whole groups in turn."""
    free, tied = (_by_shard(rows.where(x), "shard", n_shards) for x in ("not linked", "linked"))
    loads = [a + b for a, b in zip(free, tied)]
    total = sum(loads)
    share = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    over = [max(0, n - t) for n, t in zip(loads, share)]
    give_free = [min(o, f) for o, f in zip(over, free)]
    give_tied = [o - g for o, g in zip(over, give_free)]
    if not sum(over):
        return rows
    salts = max(1, -(-total // (n_shards * ROWS_PER_SALT)))
    # a group's rows follow each other, those of a large group over salts of their own
    salt = F.pmod(F.xxhash64("grp"), F.lit(salts)) * (1 << 32) + F.col("part")
    ranked = bucket_rank(rows, ["shard", "linked"], salt, [F.col("grp"), F.col("doc_id")], "place")
    # rows given away are numbered through: first the unlinked of each shard, then the linked
    from_free, from_tied = ([0, *accumulate(x)][:-1] for x in (give_free, give_tied))
    gives = F.col("place") < F.when(F.col("linked"), _number(give_tied, F.col("shard"))).otherwise(_number(give_free, F.col("shard")))
    number = F.col("place") + F.when(F.col("linked"), _number([sum(give_free) + x for x in from_tied], F.col("shard"))).otherwise(_number(from_free, F.col("shard")))
    ends = list(accumulate(max(0, t - n) for n, t in zip(loads, share)))
    to = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= number))
    return ranked.withColumn("shard", F.when(gives, to).otherwise(F.col("shard")).cast("int")).drop("place")


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", rounds: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: one row per row of ``docs`` with an id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = one_row_per_document(docs, id_col).select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("grp"))
    rows = durable(rows)
    groups = written(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    parts = F.ceil(F.coalesce("n", F.lit(1)) / F.lit(ROWS_PER_SALT))
    rows = rows.join(groups, "grp", "left").withColumn("linked", F.col("n").isNotNull()).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("part")), parts).cast("int")).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(n_shards)).cast("int"))
    rows = durable(rows.select("doc_id", "size", "text_crc32", "grp", "linked", "part", "shard"))
    total = rows.count()
    for step in range(rounds):
        rows, moves = propagate(rows, n_shards, total / n_shards, step)
        if moves <= SETTLED * total:
            break
    rows = durable(settle(rows, n_shards))
    salts = max(1, -(-total // (n_shards * ROWS_PER_SALT)))
    placed = bucket_rank(rows, ["shard"], F.pmod(F.xxhash64("doc_id"), F.lit(salts)), [F.col("doc_id")], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
