"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys, from their id, size and text. Within each source, equal ranges of the key hold about
`per_range` rows each, however large the source is; sums by range, then by `per_range` ranges, and running totals of
both give every range its offset, and running sums inside the ranges give each row its place. A source's budget then
cuts exactly: whole epochs first, then every row before the cut, and the row at the cut in part.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; rows that
agree in source, doc_id and text are counted together and each gets its own place, one after another; an empty table
gives an empty result; reruns agree, as keys depend on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.scratch import stored

WEIGHTS = (3, 1, 2)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a table (source, source_size) with a row for each source.

    Targets are the weighted shares of `share` of all sizes; what exceeds `most` times a source's size goes to
    the others by weight. That fixed point gives each source min(most * size, level * weight): sources in order
    of most * size / weight are full until the level that the rest can share is below the next one's.
    """
    in_order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    rank = F.row_number().over(in_order) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (rank % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", most * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.select(
        "*",
        (share * F.sum("source_size").over(all_rows)).alias("total"),
        F.sum("w").over(all_rows).alias("w_all"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"),
    )
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    open_ = F.col("level") <= F.col("cap") / F.col("w")
    s = s.withColumn("final", F.min(F.when(open_, F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(all_rows)["level"])
    return s.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("final") * F.col("w"), F.col("cap"))).alias("target"))


def described(docs: DataFrame) -> list[Column]:
    """Of a row of docs: id, source, size, hash-random key in [0, 1), and alike, which names rows that agree in id, source and text."""
    id_, source, text = F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string")
    size, digest = n_words(text), F.md5(text.cast("binary"))
    named = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("-")), size.cast("string"), digest)
    # The first 13 hexadecimal digits of an MD5 are 52 bits, which a double holds exactly.
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    alike = F.unhex(F.md5(F.concat_ws(":", named, F.lit("source"), source).cast("binary")))
    return [id_, source, size, key, alike]


def running(rows: DataFrame, by: list[str], order: list[str], value: Column) -> Column:
    """The sum of value over the rows before each, in order, as a window by `by`."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))


def places(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, per_range: int) -> DataFrame:
    """A row for each kind of alike rows: alike, doc_id, source, size, copies, place of the first copy, source_size, target, epochs and rest (words of the last)."""
    names = ["doc_id", "source", "size", "key", "alike"]
    same = docs.select(*(c.alias(n) for c, n in zip(described(docs), names, strict=True))).groupBy("alike").agg(*(F.first(c).alias(c) for c in names[:4]), F.count("*").alias("copies"))
    same = stored(same)
    words = F.col("size") * F.col("copies")
    sizes = same.groupBy("source").agg(F.sum(words).alias("source_size"), F.count("*").alias("source_rows"))
    plan = source_targets(sizes.select("source", "source_size"), weights, share, most)
    plan = plan.join(sizes.select(F.col("source").alias("s2"), "source_rows"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    plan = plan.withColumns({"ranges": F.ceil(F.col("source_rows") / per_range), "epochs": epochs, "rest": budget - epochs * F.col("source_size")})
    plan = stored(plan)  # a row for each source
    keyed = same.join(plan.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    keyed = keyed.withColumn("part", F.floor(F.col("key") * F.col("ranges")))
    parts = keyed.groupBy("source", "part").agg(F.sum(words).alias("words")).withColumn("above", F.floor(F.col("part") / per_range))
    above = parts.groupBy("source", "above").agg(F.sum("words").alias("words"))
    above = above.select(F.col("source").alias("s3"), F.col("above").alias("a3"), running(above, ["source"], ["above"], F.col("words")).alias("far"))
    parts = parts.withColumn("near", running(parts, ["source", "above"], ["part"], F.col("words")))
    parts = parts.join(above, F.col("source").eqNullSafe(F.col("s3")) & (F.col("above") == F.col("a3")))
    parts = parts.select(F.col("source").alias("s2"), F.col("part").alias("p2"), (F.col("near") + F.col("far")).alias("offset"))
    placed = keyed.withColumn("before", running(keyed, ["source", "part"], ["key", "doc_id", "size", "alike"], words))
    placed = placed.join(parts, F.col("source").eqNullSafe(F.col("s2")) & (F.col("part") == F.col("p2")))
    return placed.select("alike", "doc_id", "source", "size", "copies", (F.col("offset") + F.col("before")).alias("place"), "source_size", "target", "epochs", "rest")


def taken(copy: Column) -> Column:
    """Words that the mix takes of a copy (from 0) of a row of `places`."""
    place = F.col("place") + copy * F.col("size")
    return (F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - place))).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, per_range: int = 2000) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes of the row, repeats counted)."""
    placed = places(docs, weights, share, most, per_range)
    # Numbers of copies in two steps, so that no array is longer than the root of their number, about.
    step = F.lit(10_000).cast("long")
    thousands = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, step))
    placed = placed.withColumn("begin", thousands).withColumn("copy", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + step, F.col("copies")) - 1)))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken(F.col("copy")).alias("taken"))


def taken_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, per_range: int = 2000) -> DataFrame:
    """docs as the mix takes them: each row once for every whole epoch, and once more cut to the words of the last.

    A row that is cut keeps its text up to the last word taken, and n_chars, if docs has it, follows. Rows of size 0
    appear once where an epoch of their source is whole or their source has no word at all, and else not. Alike rows
    take one place each; which takes which is told by a hash of all their columns. Columns are those of docs.
    """
    placed = places(docs, weights, share, most, per_range).select("alike", "size", "copies", "place", "epochs", "rest", "source_size")
    row = F.struct(*(F.col(c) for c in docs.columns))
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    joined = docs.select(described(docs)[4].alias("alike"), F.xxhash64(*plain).alias("rank"), row.alias("row")).join(placed, "alike")
    copy = F.row_number().over(Window.partitionBy("alike").orderBy("rank")) - 1
    joined = joined.withColumn("taken", taken(copy))
    size = F.col("size")
    whole = F.when(size > 0, F.floor(F.col("taken") / size)).otherwise(((F.col("epochs") > 0) | (F.col("source_size") == 0)).cast("long"))
    rest = F.when(size > 0, F.col("taken") % size).otherwise(F.lit(0))
    pieces = F.concat(F.array_repeat(size, whole.cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")))
    out = joined.withColumn("words", F.explode(pieces))
    # The words of a cut text as one match: so many words with what stands between them.
    cut = F.col("words") < size
    text = F.col("row")["text"]
    head = F.array_join(F.slice(F.regexp_extract_all(text.cast("string"), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.col("words").cast("int")), "")

    def column(name: str) -> Column:
        own = F.col("row")[name]
        if name == "text":
            return F.when(cut, head).otherwise(own).alias(name)
        if name == "n_chars":
            return F.when(cut, F.length(head).cast("long")).otherwise(own).cast(docs.schema[name].dataType).alias(name)
        return own.alias(name)

    return out.select(*map(column, docs.columns))
