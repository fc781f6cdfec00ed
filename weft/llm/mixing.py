"""Mixing sources to target weights by pivotal dependent rounding.

Sources in code-point order (null last) weigh 1, 2, 3, repeating, and share the corpus' words; a target stops
at LIMIT times its source's words and the excess is shared again by weight. A document's expected copies
are target / source words: the whole part is certain, the fraction is rounded dependently. Two fractional
documents of a source exchange mass, counted in words: at random (so that expectations stay) one gives the
other words until one of the two is integral; the other goes on. So a source's words never change by an
exchange. Documents of like size (half octaves) meet in blocks of about BLOCK; each block leaves one fractional
document, and these meet again in blocks of BLOCK block results, level by level: a reduction tree. The last
ones of a source, one for each size class, are rounded from large to small, each so that the words owed so
far become least.

Everything is DataFrame expressions; a fold runs over a block's sorted array. Block numbers come from a hash of a
document's id, source, text and number among its equals, so a source, or one id, with a third of all rows is spread over many
blocks. Targets come from one sort of the sources by the level at which each is full, summed up range by range.

Defined cases: a null text has no words and none are taken; a null source is a source of its own; repeated
rows are documents of their own (rounded by themselves); a corpus without words takes none; an empty
table gives an empty result; a very long text is one size like any other, texts never move; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.llm.common import WORD, fresh, identified, materialize, octets, text_parts
from weft.operators.ordering import running

WEIGHTS = (1, 2, 3)
LIMIT = 3
BLOCK = 64
SEED = 20240229

_DOC = "struct<neg:bigint,h:bigint,row:bigint,size:bigint,x:double>"
_STATE = f"struct<champ:{_DOC},owed:double,done:array<struct<row:bigint,bump:int>>>"


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _doc(d: Column, x: Column) -> Column:
    return F.struct(d["neg"].alias("neg"), d["h"].alias("h"), d["row"].alias("row"), d["size"].alias("size"), x.alias("x")).cast(_DOC)


def _state(champ: Column, owed: Column, done: Column) -> Column:
    return F.struct(champ.alias("champ"), owed.alias("owed"), done.alias("done")).cast(_STATE)


def _settle(done: Column, d: Column, bump: int | Column) -> Column:
    return F.concat(done, F.array(F.struct(d["row"].alias("row"), (F.lit(bump) if isinstance(bump, int) else bump).cast("int").alias("bump"))))


def _exchange(level: int) -> Callable[[Column, Column], Column]:
    """One pivotal step: the state's fractional document and the next one exchange words until one is integral."""

    def step(s: Column, d: Column) -> Column:
        c = s["champ"]
        has_c, room_c = c["x"] * c["size"], (1 - c["x"]) * c["size"]
        has_d, room_d = d["x"] * d["size"], (1 - d["x"]) * d["size"]
        u = F.shiftrightunsigned(F.xxhash64(c["h"], d["h"], F.lit(SEED + level)), 11) / F.lit(float(1 << 53))

        def moved(amounts: Column) -> Column:
            up, down = amounts["up"], amounts["down"]  # words that c can gain from d, or lose to d
            c_gains = u * (up + down) < down
            rise = F.when(c_gains, up).otherwise(-down)
            c_ends = F.when(c_gains, room_c <= has_d).otherwise(has_c <= room_d)
            left_d, left_c = d["x"] - rise / d["size"], c["x"] + rise / c["size"]
            return F.when(c_ends, _state(_doc(d, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left_d))), s["owed"], _settle(s["done"], c, F.when(c_gains, 1).otherwise(0)))).otherwise(
                _state(_doc(c, F.greatest(F.lit(0.0), F.least(F.lit(1.0), left_c))), s["owed"], _settle(s["done"], d, F.when(c_gains, 0).otherwise(1)))
            )

        fight = _bind(F.struct(F.least(room_c, has_d).alias("up"), F.least(has_c, room_d).alias("down")), moved)
        return F.when(c["row"].isNull(), _state(_doc(d, d["x"]), s["owed"], s["done"])).otherwise(fight)

    return step


def _last(s: Column, d: Column) -> Column:
    """Round the document so that the words owed become least."""
    owed = s["owed"] + d["x"] * d["size"]
    taken = owed * 2 >= d["size"]
    return _state(F.lit(None).cast(_DOC), owed - F.when(taken, d["size"]).otherwise(0), _settle(s["done"], d, F.when(taken, 1).otherwise(0)))


def _fold(rows: DataFrame, keys: list[str], step: Callable[[Column, Column], Column]) -> DataFrame:
    docs = F.sort_array(F.collect_list(F.struct("neg", "h", "row", "size", "x").cast(_DOC)))
    start = _state(F.lit(None).cast(_DOC), F.lit(0.0), F.array().cast("array<struct<row:bigint,bump:int>>"))
    return rows.groupBy(*keys).agg(docs.alias("docs")).select(*keys, F.aggregate("docs", start, step).alias("s")).select(*keys, "s.champ", "s.done")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """name, source_size and target of each source; sizes: name (sorts as the sources do) and size.

    A source is full at the level cap / weight. In the order of these levels, the first source whose own level is no
    less than what the fuller ones leave, shared by weight, sets the level for it and all after it."""
    sources = sizes.groupBy("name").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double")
    weighed = running(sources, ["name"], {}).select("name", "source_size", weight.alias("weight"), (F.col("source_size") * limit).cast("double").alias("cap"))
    weighed = materialize(weighed.withColumn("full_at", F.col("cap") / F.col("weight")), "weights")
    whole = weighed.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    ranked = running(weighed, ["full_at", "name"], {"caps": F.col("cap"), "used": F.col("weight")})
    share = (F.lit(float(whole["size"] or 0)) - F.col("caps")) / (F.lit(float(whole["weight"] or 1)) - F.col("used"))
    first = ranked.withColumn("level", share).where("level <= full_at").agg(F.min_by("level", "number").alias("level")).first()
    level = first["level"] if first["level"] is not None else float("inf")
    return weighed.select("name", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def equals_number(sizes: DataFrame) -> DataFrame | None:
    """(row, equal): numbers, from 0, of the rows whose h other rows share; None where there are none.

    Rows are numbered inside their scan task and shifted by the tasks before, so no value gathers its rows in one task."""
    shared = materialize(sizes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "shared")
    if shared.isEmpty():
        return None
    alike = materialize(sizes.select("h", "row", "task").join(shared, "h", "left_semi"), "alike")
    tasks = alike.groupBy("h", "task").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("h").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("h", "task").orderBy("row")) - 1
    shifts = tasks.select("h", "task", before.alias("shift"))
    return alike.withColumn("inside", inside).join(shifts, ["h", "task"]).select("row", (F.col("inside") + F.col("shift")).alias("equal"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken of every document, and those of its columns that keep names."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    name = F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))  # null sorts last
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.col(c).alias(f"kept{k}") for k, c in enumerate(keep)]
    h = F.xxhash64(F.col("doc_id").cast("long"), source, text, F.lit(SEED))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"), size.alias("size"), h.alias("h"), F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("task"), *kept)
    half_octave = F.when(F.col("size") > 0, F.floor(F.log2("size") * 2)).otherwise(-1).cast("int")
    sizes = materialize(rows.withColumn("class", half_octave), "sizes")
    targets = source_targets(sizes, weights, limit)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    kinds = sizes.groupBy("name", "class").agg(F.count("*").alias("n")).join(targets, "name").withColumn("whole", F.floor(rate)).withColumn("x", rate - F.floor(rate))
    kinds = materialize(kinds, "kinds")  # of known size, and free of a partitioning that would keep the join from splitting a large source
    rated = materialize(sizes.drop("task").join(kinds, ["name", "class"]), "rated")
    open_rows = rated.where((F.col("size") > 0) & (F.col("x") > 0))
    h = F.col("h")
    if (numbers := equals_number(sizes)) is not None:
        open_rows = open_rows.join(numbers.hint("merge"), "row", "left")
        h = F.when(F.coalesce("equal", F.lit(0)) > 0, F.xxhash64("h", "equal")).otherwise(h)
    block = F.pmod(F.xxhash64(h, F.lit(1)), F.ceil(F.col("n") / BLOCK)).cast("long")
    level_rows = open_rows.select("name", "class", block.alias("block"), (-F.col("size")).alias("neg"), h.alias("h"), "row", "size", "x")
    blocks = -(-(rated.agg(F.max("n").alias("n")).first()["n"] or 1) // BLOCK)
    decided, level = [], 0
    while True:
        folded = materialize(_fold(level_rows, ["name", "class", "block"], _exchange(level)), "level")
        decided.append(folded.select(F.explode("done").alias("d")))
        left = folded.where("champ.row is not null")
        level_rows = left.select("name", "class", F.floor(F.col("block") / BLOCK).alias("block"), "champ.*")
        level += 1
        if blocks == 1:
            break
        blocks = -(-blocks // BLOCK)
    decided.append(_fold(level_rows, ["name"], _last).select(F.explode("done").alias("d")))  # a row for each size class at most
    bumps = decided[0]
    for more in decided[1:]:
        bumps = bumps.unionByName(more)
    copies = F.col("whole") + F.coalesce("bump", F.lit(0))
    # the planner takes exploded arrays for small tables; this one grows with the corpus
    out = rated.join(bumps.select("d.row", "d.bump").hint("merge"), "row", "left").withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.least(F.lit(1), F.ceil(F.col("whole") + F.col("x")))).cast("long"))
    named = [F.col(f"kept{k}").alias(c) for k, c in enumerate(keep)]
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *named)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """The rows of docs, each as often as the mixture takes it; all columns, whatever their names."""
    file, place, copies, copy, of_file, of_place, size = fresh(docs, "file", "place", "copies", "copy", "of_file", "of_place", "octets")
    rows = identified(docs, file, place)
    taken = mixture(rows.withColumn(size, octets(rows)), weights, limit, (file, place, size))
    taken = materialize(taken.select(F.col(file).alias(of_file), F.col(place).alias(of_place), F.col("copies").alias(copies), size), "taken")
    n = text_parts(taken.agg(F.sum(F.col(size) * F.greatest(F.col(copies), F.lit(1)))).first()[0])
    taken = taken.where(F.col(copies) > 0).drop(size).repartition(n, of_file, of_place)
    several = rows.repartition(n, file, place).join(taken.hint("merge"), (F.col(file) == F.col(of_file)) & (F.col(place) == F.col(of_place)))
    return several.select(*_columns(docs), F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))).alias(copy)).drop(copy)


def _columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]
