"""Splits, caps and samples that come out the same on every run: rows are ordered by a salted hash of a key, never at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import materialise

#: Bins in which rows are counted before only the bin at a cut is put in order.
BINS = 4096
#: Parts in which rows are numbered that all stand at a cut.
TIED_PARTS = 64


def ticket(*keys: str | Column, seed: int = 0) -> Column:
    """A row's place in a shuffle: md5 of seed and keys, the same in any SQL engine."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def _cuts(keyed: DataFrame, n: Column | int, keys: list[str]) -> DataFrame:
    """Of each group where the cut is: __g, __cut (the last place taken, as a struct; null: all are), __spare (rows at that very place that are too many).

    Three passes over what is small: counts by the tickets' first digits, the keys of the one bin that the cut is in, in order,
    and a row a group. Groups of which nothing is taken are left out.
    """
    counts = keyed.groupBy(F.col("__group").alias("__g"), F.col("__bin").alias("__b")).agg(F.count("*").alias("__n"))
    counts = materialise(counts, "bins")  # BINS rows a group
    run = Window.partitionBy("__g").orderBy("__b")
    total = F.sum("__n").over(Window.partitionBy("__g"))
    wanted = n(total, F.col("__g")) if callable(n) else F.lit(n)
    placed = counts.select("__g", "__b", "__n", (F.sum("__n").over(run) - F.col("__n")).alias("__before"), total.alias("__total"), wanted.cast("long").alias("__wanted"))
    placed = placed.where("__wanted > 0 AND __before < __wanted")
    every = placed.where("__total <= __wanted").select("__g").distinct()
    edge = placed.where("__total > __wanted AND __before + __n >= __wanted").select("__g", "__b", (F.col("__wanted") - F.col("__before")).alias("__left"))
    same = F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__bin") == F.col("__b"))
    place = F.struct("__ticket", *keys)
    within = keyed.join(F.broadcast(edge), same).groupBy("__g", "__left", place.alias("__cut")).agg(F.count("*").alias("__same"))
    so_far = F.sum("__same").over(Window.partitionBy("__g").orderBy("__cut"))
    last = within.withColumn("__so_far", so_far).where((F.col("__so_far") >= F.col("__left")) & (F.col("__so_far") - F.col("__same") < F.col("__left")))
    last = last.select("__g", "__cut", (F.col("__so_far") - F.col("__left")).alias("__spare"))
    return materialise(last.unionByName(every.select("__g", F.lit(None).cast(last.schema["__cut"].dataType).alias("__cut"), F.lit(0).cast("long").alias("__spare"))), "cuts")


def mark_first(df: DataFrame, n: Column | int, order: Column, *ties: str, group: str | None = None, mark: str = "is_first") -> DataFrame:
    """``df`` with ``mark``: whether a row is among the ``n`` first (of its ``group``) in the order of tickets (``order``), then ``ties``.

    Rows are marked where they are, by a broadcast of the place of each group's cut; only where several rows share that very
    place and not all are taken, those few are numbered. ``n``: a number, or what makes one of two columns, a group's number of
    rows and its name. Groups must be few, as classes, sets or families are. Runs small jobs at once.
    """
    own = F.col(group) if group else F.lit(0)
    keyed = df.withColumns({"__ticket": order, "__group": own}).withColumn("__bin", F.conv(F.substring("__ticket", 1, 3), 16, 10).cast("int"))
    cuts = _cuts(keyed, n, list(ties))
    place = F.struct("__ticket", *ties)
    met = keyed.join(F.broadcast(cuts), F.col("__group").eqNullSafe(F.col("__g")), "left")
    there = F.col("__g").isNotNull()
    taken = there & (F.col("__cut").isNull() | (place <= F.col("__cut")))
    if cuts.where("__spare > 0").isEmpty():
        return met.withColumn(mark, F.coalesce(taken, F.lit(False))).select(*df.columns, mark)
    tied = there & (F.col("__spare") > 0) & (place == F.col("__cut"))
    rest = met.where(~F.coalesce(tied, F.lit(False))).withColumn(mark, F.coalesce(taken, F.lit(False)))
    # equal rows are numbered from the end in parts of their own, so that one that is very frequent isn't one task's
    same = met.where(tied).withColumn("__part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(TIED_PARTS)))
    same = materialise(same, "tied")
    sizes = same.groupBy("__g", "__part").agg(F.count("*").alias("__size")).select(F.col("__g").alias("__h"), F.col("__part").alias("__p"), (F.sum("__size").over(Window.partitionBy("__g").orderBy("__part")) - F.col("__size")).alias("__ahead"))
    number = F.row_number().over(Window.partitionBy("__group", "__part").orderBy(F.lit(0))) + F.col("__ahead")
    same = same.join(F.broadcast(sizes), F.col("__group").eqNullSafe(F.col("__h")) & (F.col("__part") == F.col("__p"))).withColumn(mark, number > F.col("__spare"))
    return rest.select(*df.columns, mark).unionByName(same.select(*df.columns, mark))


def first_rows(df: DataFrame, n: Column | int, order: Column, *ties: str, group: str | None = None) -> DataFrame:
    """The ``n`` first rows (of each ``group``), as ``mark_first`` marks them."""
    return mark_first(df, n, order, *ties, group=group, mark="__first").where("__first").drop("__first")


def group_split(df: DataFrame, key: str, part: int = 10, seed: int = 0) -> DataFrame:
    """``df`` with ``is_test``: all rows of one key in ``part`` of the keys, rounded down. A null key is a key.

    Only distinct keys are shuffled, for their number; rows are marked where they are, by the place of the last test key.
    """
    keys = df.select(F.col(key).alias("__key")).distinct().withColumns({"__ticket": ticket("__key", seed=seed), "__group": F.lit(0)})
    keys = materialise(keys.withColumn("__bin", F.conv(F.substring("__ticket", 1, 3), 16, 10).cast("int")), "keys")
    cuts = _cuts(keys, lambda n, _: F.floor(n / part), ["__key"]).select("__g", "__cut")
    met = df.join(F.broadcast(cuts), F.col("__g") == 0, "left")
    place = F.struct(ticket(key, seed=seed).alias("__ticket"), F.col(key).alias("__key"))
    return met.withColumn("is_test", F.col("__g").isNotNull() & F.coalesce(F.col("__cut").isNull() | (place <= F.col("__cut")), F.lit(False))).drop("__g", "__cut")


def fraction_split(df: DataFrame, fraction: float, *keys: str, seed: int = 0) -> DataFrame:
    """``df`` with ``is_train`` for exactly floor(n * fraction) rows, in the order of ``keys``' tickets."""
    return mark_first(df, lambda n, _: F.floor(n * F.lit(fraction)), ticket(*keys, seed=seed), *keys, mark="is_train")


#: Chat models of which a cell is kept, and rows of a cell.
CHAT_MODELS = ["chatgpt", "gpt4", "cohere-chat", "llama-chat", "mistral-chat", "mpt-chat"]
CELL_ROWS = 500


def cell_cap(df: DataFrame, cell: list[str], key: str, most: int = CELL_ROWS, uncapped: Column | None = None, seed: int = 0) -> DataFrame:
    """All rows that are ``uncapped``, and of the others at most ``most`` of each cell.

    A cell's rows are thinned by hash first where it is far above the cap, so no task sorts a whole large cell.
    """
    free = uncapped if uncapped is not None else F.lit(False)
    capped = df.where(~free).withColumn("__ticket", ticket(key, seed=seed))
    bins = capped.groupBy(*cell, F.substring("__ticket", 1, 3).alias("__bin")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*cell).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = bins.withColumn("__before", before).where(F.col("__before") < most).select(*[F.col(c).alias(f"__{c}") for c in cell], F.col("__bin").alias("__b"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cell] + [F.substring("__ticket", 1, 3) == F.col("__b")]
    likely = capped.join(open_, same, "left_semi")
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy("__ticket", key))
    return df.where(free).unionByName(likely.withColumn("__rank", rank).where(F.col("__rank") <= most).select(*df.columns))


def class_cap(df: DataFrame, label: str, key: str, caps: dict[int, int], seed: int = 0) -> DataFrame:
    """At most ``caps[label]`` rows of each label; other labels go. One scan marks all classes."""
    most = lambda _, g: F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), g)
    return first_rows(df.where(F.col(label).isin(list(caps))), most, ticket(key, seed=seed), key, group=label)


def family_split(df: DataFrame, family: str, unseen: list[str], key: str, final: bool = False, fraction: float = 0.8, seed: int = 0) -> DataFrame:
    """``df`` with ``side``: train, or ``unseen`` for held-out families; in ``final`` mode a fifth of each such family is ``heldout``."""
    held = F.col(family).isin(unseen)
    if not final:
        return df.withColumn("side", F.when(held, "unseen").otherwise("train"))
    rest = df.where(~F.coalesce(held, F.lit(False))).withColumn("side", F.lit("train"))
    own = df.where(held)
    taught = mark_first(own, lambda n, _: F.floor(n * F.lit(fraction)), ticket(key, seed=seed), key, group=family, mark="__train")
    return rest.unionByName(taught.withColumn("side", F.when(F.col("__train"), "train").otherwise("heldout")).select(*df.columns, "side"))


def weighted_union(parts: list[tuple[DataFrame, int, float]], columns: list[str]) -> DataFrame:
    """The rows of all parts (rows, label, weight), with label and weight."""
    found = None
    for rows, label, weight in parts:
        one = rows.select(*columns, F.lit(label).alias("label"), F.lit(float(weight)).alias("weight"))
        found = one if found is None else found.unionByName(one)
    return found


def systematic(df: DataFrame, group: str, order: list[str], most: int = 25) -> DataFrame:
    """Of each group every floor(n / most)-th row (at least every one), at most ``most``."""
    # rows are sorted by ranges; a row's number is its place in its part, and the group's rows in the parts before
    parts = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumns({"__part": F.spark_partition_id(), "__no": F.monotonically_increasing_id()})
    parts = materialise(parts, "ranges")
    counts = parts.groupBy(F.col(group).alias("__g"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"), F.min("__no").alias("__least"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__g").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    step = F.greatest(F.floor(F.sum("__n").over(Window.partitionBy("__g")) / most), F.lit(1))
    starts = counts.select("__g", "__p", "__least", before.alias("__before"), step.alias("__step"))
    placed = parts.join(starts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__part") == F.col("__p"))).withColumn("__at", F.col("__before") + F.col("__no") - F.col("__least"))
    return placed.where((F.col("__at") % F.col("__step") == 0) & (F.col("__at") / F.col("__step") < most)).select(*df.columns)


def page_sample(df: DataFrame, source: str, row_no: str, n: int, page: int = 100, pages: int | None = None, seed: int = 0) -> DataFrame:
    """Of each source, rows of pages in hash order, page by page, the first ``n``; pages are ``page`` rows by ``row_no``.

    ``pages`` bounds the pages that are drawn; the rows within are filtered before this is called.
    """
    drawn = df.withColumn("__page", F.floor(F.col(row_no) / page)).withColumn("__ticket", ticket(source, "__page", seed=seed))
    if pages is not None:
        kinds = drawn.select(source, "__page", "__ticket").distinct()
        chosen = kinds.withColumn("__k", F.row_number().over(Window.partitionBy(source).orderBy("__ticket"))).where(F.col("__k") <= pages).select(F.col(source).alias("__s"), F.col("__page").alias("__p"))
        drawn = drawn.join(chosen, F.col(source).eqNullSafe(F.col("__s")) & (F.col("__page") == F.col("__p")), "left_semi")
    rank = F.row_number().over(Window.partitionBy(source).orderBy("__ticket", row_no))
    return drawn.withColumn("__rank", rank).where(F.col("__rank") <= n).select(*df.columns)


def prompt_grid(spark: SparkSession, genres: DataFrame, topics: DataFrame, lengths: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """genre, topic, length, prompt: every combination, or ``n`` drawn by hash. The lists are a user's own, short by nature."""
    grid = genres.select("genre").crossJoin(topics.select("topic")).crossJoin(lengths.select("length"))
    prompts = grid.withColumn("prompt", F.concat(F.lit("Write a "), "genre", F.lit(" about "), "topic", F.lit("."), "length"))
    return prompts if n is None else prompts.orderBy(ticket("prompt", seed=seed)).limit(n)
