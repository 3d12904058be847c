"""Mixing sources to target weights by blocks of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.llm.common import col, cut, fresh, let, shuffled, small, space_words, text_key, text_or_empty
from rowloom.llm.prefix import with_prefix

# Weights of the sources in code point order (repeating), the mix's size as a share of all words, and
# how often a source may be used.
WEIGHTS = (5, 2, 1)
MIX_SHARE = 1.5
MAX_EPOCHS = 2

BLOCK = 64
SLOTS_PER_SHARD = 4096
ROUNDS = 10
#: Parts of a slot that remainders are counted in.
GRAIN = 1 << 30
#: Slots that a task makes, on average.
SLOTS_PER_TASK = 100_000
SEED = 20


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = MIX_SHARE, epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes(source, source_size) -> (source, source_rank, source_size, target).

    Sources rank by code point, null last, and weigh ``weights`` in turn. ``share`` of all words is dealt by weight; a
    target stops at ``epochs`` times its source's size and the excess is dealt again by weight until no target is
    above. That fixpoint is solved directly: in the order of size by weight, a source stops exactly if its share of
    what the sources before it leave would reach its limit. Ranks and sums come from range partitions, so that no
    task sees all sources; sums are of whole numbers, so that reruns agree."""
    ranked = with_prefix(sizes, [F.col("source").asc_nulls_last()], {}, "source_rank")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_rank") % len(weights) + 1).cast("int")
    )
    w = ranked.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * epochs).cast("double"))
    w = w.withColumn("ratio", F.col("cap") / F.col("weight"))
    level = with_prefix(w, ["ratio", "source_rank"], {"cap": "caps", "weight": "weights"}, "by_ratio")
    words, heft = w.agg(F.sum("source_size"), F.sum("weight")).first()
    level = level.withColumn("level", ((words or 0) * share - F.col("caps")) / ((heft or 0.0) - F.col("weights")))
    # Past the first source that doesn't stop, all share its level.
    final = level.where("cap > level * weight").agg(F.min(F.struct("by_ratio", "level"))).first()[0]
    target = F.col("cap") if final is None else F.least("cap", F.lit(final["level"]) * F.col("weight"))
    return level.select("source", "source_rank", "source_size", target.alias("target"))


def permuted(index: Column, n: Column, keys: list[Column], rounds: int = ROUNDS) -> Column:
    """``index`` in 0 .. n-1 through a keyed pseudorandom permutation of that range.

    Swap-or-not rounds (Hoang, Morris and Rogaway, 2012): each pairs x with k - x (mod n) and swaps the pair on a hash
    bit that both ends share, so any n has a bijection and no table or sort is needed. The rounds are one fold: as
    nested columns they would double with each round when a filter is pushed through them."""

    def step(x: Column, r: Column) -> Column:
        def swap(mate: Column) -> Column:
            return F.when(F.xxhash64(r, F.greatest(x, mate), *keys).bitwiseAND(1) == 1, mate).otherwise(x)

        return let(F.pmod(F.xxhash64(-1 - r, *keys) - x, n), swap)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), index, step)


def _slots(targets: DataFrame, block: int, slots_per_shard: int, seed: int) -> DataFrame:
    """(out_shard, out_slot, source_rank, block, epoch): the mix as blocks, in output order.

    A source should fill as many slots as its target has mean blocks. Every output shard draws its sources' counts:
    each source's expected slots, rounded down, and the slots that this leaves by a multinomial draw with the
    remainders as weights. So counts vary from shard to shard, and a source's total by a few slots only. A source's
    slots are numbered; its k-th reads, in epoch k div n, the block at place k mod n of that epoch's permutation of the
    source's n blocks. Slots past MAX_EPOCHS epochs stay empty.

    All shards but the last have ``slots_per_shard`` slots, so two tables of a row for each source describe the draws."""
    blocks = F.ceil(F.col("source_size") / block).cast("bigint")
    quota = F.when(F.col("source_size") > 0, F.col("target") * blocks / F.col("source_size")).otherwise(0.0)
    wanted = targets.select("source_rank", blocks.alias("blocks"), quota.alias("quota")).where("quota > 0")
    # In thousandths, whose sums are exact in any order.
    total = wanted.agg(F.coalesce(F.sum(F.round(F.col("quota") * 1000).cast("bigint")), F.lit(0))).first()[0]
    slots = round(total / 1000)
    full = max(0, -(-slots // slots_per_shard) - 1)
    sizes = {"full": slots_per_shard, "last": slots - full * slots_per_shard}
    for name, n in sizes.items():
        expected = F.round(F.col("quota") * 1000).cast("bigint").cast("decimal(30,0)") * n / max(1, total)
        wanted = wanted.withColumn(f"{name}_base", F.floor(expected).cast("bigint")).withColumn(
            f"{name}_rest", F.floor((expected - F.floor(expected)) * GRAIN).cast("bigint")
        )
    sums = {f"{name}_{kind}": f"{name}_{kind}_before" for name in sizes for kind in ("base", "rest")}
    wanted = cut(with_prefix(wanted, ["source_rank"], sums, "nth"), "quotas")
    bases, rests = {}, {}
    for name, n in sizes.items():
        base, rest = wanted.agg(F.sum(f"{name}_base"), F.sum(f"{name}_rest")).first()
        bases[name], rests[name] = base or 0, rest or 0
    drawn = None
    for name, first, shards in (("full", 0, full), ("last", full, 1)):
        left = sizes[name] - bases[name]
        if left > 0 and shards and rests[name]:
            part = _draws(wanted, name, first, shards, left, bases[name], rests[name], seed)
            drawn = part if drawn is None else drawn.unionByName(part)
    run = 8192
    each = F.col("full_base") * full + F.col("last_base")
    runs = wanted.where(each > 0).select(
        "source_rank", "blocks", "full_base", "full_base_before", "last_base_before", each.alias("each"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((each - 1) / run))).alias("run"),
    )
    # A source's slots are made in runs, so a source with a third of all slots isn't one task's work; by number, since
    # adaptive execution would put these few rows in one task.
    tasks = max(1, slots // SLOTS_PER_TASK)
    made = runs.repartition(tasks, "source_rank", "run").withColumn(
        "k", F.explode(F.sequence(F.col("run") * run, F.least((F.col("run") + 1) * run, F.col("each")) - 1))
    )
    own, in_full = F.greatest("full_base", F.lit(1)), F.col("k") < F.col("full_base") * full
    made = made.select(
        "source_rank",
        "blocks",
        "k",
        F.when(in_full, F.floor(F.col("k") / own)).otherwise(full).alias("out_shard"),
        F.when(in_full, F.col("full_base_before") + F.col("k") % own)
        .otherwise(F.col("last_base_before") + F.col("k") - F.col("full_base") * full)
        .alias("out_slot"),
    )
    if drawn is not None:
        numbered = cut(with_prefix(drawn, ["source_rank", "out_shard", "out_slot"], {}, "place"), "drawn")
        starts = numbered.groupBy("source_rank").agg(F.min("place").alias("begin"))
        known = cut(wanted.join(shuffled(starts), "source_rank").select(F.col("source_rank").alias("of"), "blocks", each.alias("each"), "begin"), "starts")
        made = made.unionByName(
            numbered.join(small(known), F.col("source_rank") == F.col("of")).select(
                "source_rank", "blocks", (F.col("each") + F.col("place") - F.col("begin")).alias("k"), "out_shard", "out_slot"
            )
        )
    made = made.where(F.col("k") < F.col("blocks") * MAX_EPOCHS)
    epoch = F.floor(F.col("k") / F.col("blocks"))
    in_shard = F.when(F.col("out_shard") < full, F.lit(slots_per_shard)).otherwise(sizes["last"]).cast("bigint")
    return made.select(
        F.col("out_shard").cast("bigint").alias("out_shard"),
        permuted(F.col("out_slot").cast("bigint"), in_shard, [F.lit(seed + 1), F.col("out_shard")]).alias("out_slot"),
        "source_rank",
        permuted(F.col("k") % F.col("blocks"), F.col("blocks"), [F.lit(seed), F.col("source_rank"), epoch]).alias("block"),
        epoch.alias("epoch"),
    )


def _draws(wanted: DataFrame, name: str, first: int, shards: int, left: int, base: int, rest: int, seed: int) -> DataFrame:
    """(source_rank, out_shard, out_slot): the slots of ``shards`` shards that a multinomial draw fills, ``left`` in
    each, with a source's chance in proportion to its remainder.

    The remainders lie end to end on a line of length ``rest``; each slot's hash is a point on it, and the point's
    stretch of GRAIN finds the few sources there by an equality join."""
    begin, size = F.col(f"{name}_rest_before"), F.col(f"{name}_rest")
    cells = wanted.where(size > 0).select(
        "source_rank", begin.alias("begin"), (begin + size).alias("end"),
        F.explode(F.sequence(F.floor(begin / GRAIN), F.floor((begin + size - 1) / GRAIN))).alias("cell"),
    )
    points = wanted.sparkSession.range(first, first + shards).select(
        F.col("id").alias("out_shard"), F.explode(F.sequence(F.lit(0), F.lit(left - 1))).alias("i")
    )
    point = F.pmod(F.xxhash64(F.lit(seed + 2), "out_shard", "i"), F.lit(rest).cast("bigint"))
    points = points.withColumn("point", point).withColumn("cell", F.floor(F.col("point") / GRAIN))
    met = points.join(small(cut(cells, "cells")), "cell").where("point >= begin and point < end")
    return met.select("source_rank", "out_shard", (F.col("i") + base).cast("bigint").alias("out_slot"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    slots_per_shard: int = SLOTS_PER_SHARD,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """Documents with what the mix takes of them, and the mix's blocks.

    First result, a row for each row of ``docs``: (id, source, size, source_size, target, taken, rank, key, start,
    source_rank), where start is the document's first word in its source's stream. Second result: see ``_slots``.
    ``mixed_blocks`` has the blocks' words.

    A source's documents, ordered by id, key and size, make one stream of words, packed into blocks of ``block`` words
    (the last may be shorter); its streams' offsets come from per-partition totals. The slots are joined to the blocks
    by index, and a document's ``taken`` sums, over the blocks it lies in, its words there times the number of slots
    that read the block. A block is read at most twice, so no document exceeds twice its size; a source misses its
    target by the luck of the draws (see ``_slots``), a few blocks. Everything hangs on hashes of the seed: reruns
    agree.

    A null text has no words and is never taken; a null source is a source of its own, the last. Repeated rows are
    rows of their own. An empty table gives empty tables. Other columns are ignored, whatever their names."""
    text = text_or_empty(text_col)
    light = docs.select(col(id_col), col(source_col), F.size(space_words(text)).cast("bigint"), text_key(text)).toDF(
        "id", "source", "size", "key"
    )
    ranked = cut(
        with_prefix(light, [F.col("source").asc_nulls_last(), "id", "key", "size"], {"size": "before"}, "rank"), "ranked"
    )
    sizes = ranked.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("before").alias("source_from"))
    targets = cut(
        source_targets(sizes.select("source", "source_size")).join(
            sizes.select(F.col("source").alias("s"), "source_from"), F.col("source").eqNullSafe(F.col("s"))
        ).drop("s"),
        "targets",
    )
    slots = cut(_slots(targets, block, slots_per_shard, seed), "slots")
    reads = slots.groupBy("source_rank", "block").agg(F.count("*").alias("reads"))
    known = targets.withColumnRenamed("source", "s")
    placed = ranked.join(small(known), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("start", F.col("before") - F.col("source_from"))
    taken = (
        _in_blocks(placed, block, "rank")
        .join(shuffled(reads), ["source_rank", "block"])
        .groupBy("rank")
        .agg(
            F.sum(F.col("reads") * F.col("words_here")).alias("taken")
        )
    )
    result = placed.join(shuffled(taken), "rank", "left").select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        "rank",
        "key",
        "start",
        "source_rank",
    )
    return result, slots


def _in_blocks(placed: DataFrame, block: int, *keep: str) -> DataFrame:
    """(source_rank, block, at, words_here, ...): a row for each block that a document lies in; ``at`` is the first of
    the document's words that is in the block."""
    start, end = F.col("start"), F.col("start") + F.col("size")
    rows = placed.where("size > 0").select(
        "source_rank", "start", end.alias("end"), F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))).alias("block"), *keep
    )
    first = F.greatest(start, F.col("block") * block)
    return rows.select(
        "source_rank", "block", (first - start).alias("at"), (F.least("end", (F.col("block") + 1) * block) - first).alias("words_here"), *keep
    )


def mixed_blocks(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block: int = BLOCK,
    slots_per_shard: int = SLOTS_PER_SHARD,
    seed: int = SEED,
) -> DataFrame:
    """(out_shard, out_slot, source_rank, block, epoch, words): the mix itself, blocks of ``block`` words in the order
    of output (a source's last block may be shorter).

    Documents are cut at the borders of blocks, the pieces meet by block, and slots join the blocks by index. Rows as
    for ``mix``."""
    result, slots = mix(docs, id_col, text_col, source_col, block, slots_per_shard, seed)
    text = text_or_empty(text_col)
    texts = docs.select(text_key(text).alias("text_key"), text.alias("text")).groupBy("text_key").agg(F.first("text").alias("text"))
    pieces = (
        _in_blocks(result, block, "start", "key")
        .groupBy("key")
        .agg(F.collect_set(F.struct("source_rank", "block", "at", "words_here", "start")).alias("pieces"))
        .join(shuffled(texts), F.col("key") == F.col("text_key"))
        .select(
            let(
                space_words(F.col("text")),
                lambda w: F.transform(
                    "pieces",
                    lambda p: F.struct(
                        p["source_rank"].alias("source_rank"),
                        p["block"].alias("block"),
                        (p["start"] + p["at"]).alias("from"),
                        F.slice(w, (p["at"] + 1).cast("int"), p["words_here"].cast("int")).alias("words"),
                    ),
                ),
            ).alias("pieces")
        )
        .select(F.inline("pieces"))
    )
    blocks = pieces.groupBy("source_rank", "block").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("from", "words"))), lambda p: p["words"])).alias("words")
    )
    return slots.join(shuffled(blocks), ["source_rank", "block"]).select("out_shard", "out_slot", "source_rank", "block", "epoch", "words")


def resample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """``docs`` as the mix takes them, in whole documents: a document of which the mix takes t times its words is
    returned floor(t) or ceil(t) times, by a hash that is fair (so a source's expected words are the mix's).

    All columns are kept. Documents without words are not in a mix and go. Of rows that are equal in id and text, and
    so can't be told from one another, the first ones by the rest of the row are returned once more than the others
    where the copies that the mix takes of them don't come out even."""
    result, _ = mix(docs, id_col, text_col, source_col, seed=seed)
    chance = F.pmod(F.xxhash64(F.lit(seed), col(id_col), "key", "rank"), F.lit(1 << 20)) / float(1 << 20)
    n_id, n_key, n_times, n_rows = (fresh(docs, f"mix_{x}") for x in ("id", "key", "n", "rows"))
    copies = (
        result.where("taken > 0")
        .select(col(id_col).alias("id"), "key", F.floor(F.col("taken") / F.col("size") + chance).cast("int").alias("n"))
        .groupBy("id", "key")
        .agg(F.sum("n").alias("n"))
    )
    rows = result.groupBy(col(id_col).alias("row_id"), F.col("key").alias("row_key")).agg(F.count("*").alias("rows"))
    copies = cut(
        copies.where("n > 0").join(shuffled(rows), F.col("id").eqNullSafe(F.col("row_id")) & (F.col("key") == F.col("row_key"))).select("id", "key", "n", "rows"), "copies"
    )
    own_key, times = fresh(docs, "mix_own_key"), fresh(docs, "mix_times")
    columns = [col(c) for c in docs.columns]
    wide = docs.withColumn(own_key, text_key(text_or_empty(text_col)))
    same = col(id_col).eqNullSafe(F.col(n_id)) & (F.col(own_key) == F.col(n_key))

    def given(part: DataFrame) -> DataFrame:
        return wide.join(small(part.toDF(n_id, n_key, n_times, n_rows)), same)

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times).cast("int")))).select(*columns)

    out = repeated(given(copies.where("rows = 1")).withColumn(times, F.col(n_times)))
    several = cut(copies.where("rows > 1"), "several")
    if several.isEmpty():
        return out
    # whole rows are dealt to ranges here: those that are in the table more than once
    place, row, least = fresh(docs, "mix_place"), fresh(docs, "mix_row"), fresh(docs, "mix_least")
    rest = given(several).withColumn(row, F.xxhash64(*[col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])).withColumn(least, F.monotonically_increasing_id())
    numbered = cut(with_prefix(rest, [n_id, n_key, row, least], {}, place).drop(least), "numbered")
    first_id, first_key = fresh(numbered, "mix_first_id"), fresh(numbered, "mix_first_key")
    first = cut(numbered.groupBy(n_id, n_key).agg(F.min(place).alias(least)), "first").toDF(first_id, first_key, least)
    joined = numbered.join(small(first), F.col(n_id).eqNullSafe(F.col(first_id)) & (F.col(n_key) == F.col(first_key)))
    extra = F.col(place) - F.col(least) < F.col(n_times) % F.col(n_rows)
    return out.unionByName(repeated(joined.withColumn(times, F.floor(F.col(n_times) / F.col(n_rows)) + extra.cast("int"))))
