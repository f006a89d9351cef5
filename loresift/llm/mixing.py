"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Documents of a source are shuffled by a hash of their id and text and queue up `epochs` times, as packets of at most
`packet` words each. A packet's virtual finish time is the number of words that its source has sent by its
end, divided by the source's weight. All queues are merged in the order of finish time, and the mix is what
comes first, cut to the word where the total budget is spent. A source whose queue runs out leaves the rest
to the others by weight, without further rules.

Words sent are two-level prefix sums, over 4096 slots of the shuffle order per source and within a slot, so a
source that holds a third of all rows is spread over as many tasks as any. The merged order is summed by
slots of finish time first; only the packets of the one slot in which the budget ends are put in order one by
one (found in two levels), which gives the last packet and how much of it is taken. All other packets need no more than a comparison
with that one.

Defined results: a null text has no words and takes none; the null source is a source, last in order; rows
without an id, or with one id, are shuffled by their texts; equal rows are interchangeable; source names order by code point;
equal finish times order by source, then by the shuffle; an empty table gives an empty mix; other columns only
ride along where asked for. Reruns agree, since the shuffle is a hash of id, text and seed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import kept

WORD = r"[^\x20\x09-\x0D]+"
SLOT_DIGITS = 3  # hexadecimal: 4096 slots
#: Slots of finish time between the start and the longest queue's end.
TIMES = 1 << 16
PACKET = 256


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """Per source of (source, size): source_size, rank, weight, budget (of all together) and target in words,
    the fill levels of the sources at which the budget is spent. Windows run over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    one = one.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    one = one.withColumn("cap", F.col("source_size") * float(epochs)).withColumn("level", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    before = Window.orderBy("level", "rank").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "rank").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    one = one.withColumn("total", F.sum("source_size").over(every) * share)
    one = one.withColumn("time", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    # the first source, by level, that does not run out before the time at which the rest is spent
    first = F.min(F.when(F.col("level") >= F.col("time"), F.struct("level", "rank", "time"))).over(every)
    cut = F.coalesce(first["time"], F.max("level").over(every))
    one = one.withColumn("cut", cut).withColumn("horizon", F.max("level").over(every))
    return one.select("source", "source_size", "rank", "weight", "horizon", F.floor(F.col("total") + 1e-6).alias("budget"), F.least(F.col("cut") * F.col("weight"), F.col("cap")).alias("target"))


def plan(docs: DataFrame, *, weights=(5, 2, 1), share: float = 1.5, epochs: int = 2, packet: int = PACKET, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target (of its source), and passes, an array of
    (epoch, start, finish, taken), start and finish in virtual time, taken in words. With `carry`, `row` holds
    the whole input row."""
    shuffled = F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("")), F.md5(F.coalesce(docs[text_col], F.lit("")).cast("binary")), F.lit(str(seed)))
    base = docs.select(
        docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), F.md5(shuffled.cast("binary")).alias("key"),
        *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []),
    ).withColumn("slot", F.conv(F.substring("key", 1, SLOT_DIGITS), 16, 10).cast("int"))
    sizes = kept(base.select("doc_id", "source", "size", "key", "slot"), "sizes")
    slots = kept(sizes.groupBy("source", "slot").agg(F.sum("size").alias("words")), "slots")
    goal = targets(slots.select("source", F.col("words").alias("size")), weights=weights, share=share, epochs=epochs)
    ahead = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("ahead", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
    slots = slots.join(goal.withColumnRenamed("source", "g"), F.col("source").eqNullSafe(F.col("g")))
    slots = kept(slots.select(F.col("source").alias("s"), F.col("slot").alias("t"), "ahead", "source_size", "rank", "weight", "horizon", "budget", "target"), "queues")
    inside = Window.partitionBy("source", "slot").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def queued(rows):
        """Rows with `from`, the words that their source sends before them in its first epoch."""
        rows = rows.withColumn("upto", F.sum("size").over(inside))
        rows = rows.join(slots, rows["source"].eqNullSafe(slots["s"]) & (rows["slot"] == slots["t"]))
        return rows.withColumn("from", F.col("ahead") + F.col("upto") - F.col("size"))

    def finish(at):
        """Virtual finish time of words up to `at`."""
        return at / F.col("weight")

    epoch = F.sequence(F.lit(0), F.lit(epochs - 1))
    sent = kept(queued(sizes).where("size > 0"), "sent")
    packets = sent.select("*", F.explode(epoch).alias("epoch")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / packet))).alias("i"))
    words = F.least(F.lit(packet).cast("long"), F.col("size") - F.col("i") * packet)
    packets = packets.withColumn("words", words).withColumn("end", F.col("from") + F.col("epoch").cast("long") * F.col("source_size") + F.col("i") * packet + words)
    place = finish(F.col("end")) / F.col("horizon") * TIMES
    time = F.least(F.floor(place), F.lit(TIMES - 1))
    part = F.greatest(F.lit(0), F.least(F.floor((place - time) * TIMES), F.lit(TIMES - 1)))
    packets = packets.select("rank", "words", "end", "budget", finish(F.col("end")).alias("finish"), time.cast("int").alias("time"), part.cast("int").alias("part"))

    def slot_of_budget(rows, by, before):
        """(by, before): the slot in which the budget ends and the words sent before it, from TIMES rows."""
        sums = rows.groupBy(by).agg(F.sum("words").alias("w"), F.max("budget").alias("b"), F.max(before).alias("earlier"))
        running = sums.withColumn("before", F.col("earlier") + F.sum("w").over(Window.orderBy(by)) - F.col("w")).where("before < b")
        return running.agg(F.max(F.struct(by, "before")).alias("x")).select(F.col(f"x.{by}").alias(by), F.col("x.before").alias("before"))

    # two levels of slots, so that few packets are left to put in order whatever the size of the table
    inner = packets.join(F.broadcast(slot_of_budget(packets, "time", F.lit(0).cast("long"))), "time")
    final = inner.drop("before").join(F.broadcast(slot_of_budget(inner, "part", F.col("before"))), "part").withColumn("sum", F.col("before") + F.sum("words").over(Window.orderBy("finish", "rank", "end")))
    final = final.where(F.col("sum") - F.col("words") < F.col("budget"))
    # the last packet of the mix, and its words beyond the budget: one row
    over = F.greatest(F.lit(0).cast("long"), F.col("sum") - F.col("budget"))
    edge = final.agg(F.max(F.struct("finish", "rank", "end", over.alias("over"))).alias("edge")).head()["edge"]
    cut = {k: F.lit(v).cast("double" if k == "finish" else "long") for k, v in (edge.asDict() if edge else {}).items()}
    rows = queued(base) if carry else queued(sizes)

    def taken(at):
        """Words of a pass that stand in the mix: packets that end at or before the last packet in the merged
        order; less what the last one has beyond the budget."""
        most = F.floor(cut["finish"] * F.col("weight") + 1e-6).cast("long")  # words its source may have sent

        def early(end):
            at = finish(end)
            same = (F.col("rank") < cut["rank"]) | ((F.col("rank") == cut["rank"]) & (end <= cut["end"]))
            return (at < cut["finish"]) | ((at == cut["finish"]) & same)

        whole = F.least(F.col("size"), F.floor(F.greatest(most - at, F.lit(0)) / packet) * packet)
        # rounding may put the last packet on either side: try one more and one less
        tries = F.transform(F.array(F.lit(1), F.lit(0), F.lit(-1)), lambda k: F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), whole + k * packet)))
        n = F.get(F.filter(tries, lambda w: (w == 0) | early(at + w)), 0)
        return n - F.when((F.col("rank") == cut["rank"]) & (at + n == cut["end"]) & (n > 0), cut["over"]).otherwise(0)

    def one(e):
        at = F.col("from") + e.cast("long") * F.col("source_size")
        n = F.when(F.col("size") == 0, F.lit(0).cast("long")).otherwise(taken(at)) if cut else F.lit(0)
        return F.struct(e.alias("epoch"), finish(at).alias("start"), finish(at + F.col("size")).alias("finish"), n.cast("long").alias("taken"))

    return rows.select("doc_id", "source", "size", "source_size", "target", F.transform(epoch, one).alias("passes"), *(["row"] if carry else []))


def schedule(planned: DataFrame) -> DataFrame:
    """The planned documents in the order of the mix: a global range sort by virtual finish time."""
    return planned.orderBy(F.col("passes")[0]["finish"], "source", "doc_id")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows of `docs`, whole documents only: one row for every pass of which at least half is
    taken, so that a source misses its target by half a document at most. Documents without words go."""
    planned = plan(docs, carry=True, **options)
    rows = planned.select("row", "size", F.explode("passes").alias("p")).where((F.col("p.taken") > 0) & (F.col("p.taken") * 2 >= F.col("size")))
    return rows.orderBy("p.finish").select("row.*")
