"""Benchmark preparation and choice scoring (AGG3, AGG8, AGG9, J9-J13, STR6-STR10, TOP2, TOP3, SEQ16-SEQ18, V13)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from weft.functions.hashing import HASH_CELLS, uniform
from weft.functions.numeric import bind
from weft.functions.text import normalize_story
from weft.operators.ordering import running
from weft.operators.sequences import collapse_boundary
from weft.operators.validation import first_failure

LETTERS = ("A", "B", "C", "D")
NO_SCORE = -1e30
RESULT_STRETCH = 10_000


def story_pivot(rows: DataFrame, expected: int | None = None) -> DataFrame:
    """pair_id, prompt, chosen, rejected and the first problem: rows (place, pair_id, text, type, correctness).

    Each group has exactly one of each label; `expected` is the required number of groups."""
    label = F.when(F.col("type") == "prompt", F.lit("prompt")).otherwise(F.col("correctness"))
    one = lambda name: F.max(F.when(label == name, F.col("text")))
    n = lambda name: F.count_if(label == name)
    grouped = rows.groupBy("pair_id").agg(one("prompt").alias("prompt"), one("correct").alias("chosen"), one("incorrect").alias("rejected"), F.count("*").alias("n"), n("prompt").alias("n1"), n("correct").alias("n2"), n("incorrect").alias("n3"), F.min("place").alias("first"))
    problem = first_failure(("duplicate label", (F.col("n1") <= 1) & (F.col("n2") <= 1) & (F.col("n3") <= 1)), ("not three labels", (F.col("n") == 3) & (F.col("n1") == 1) & (F.col("n2") == 1) & (F.col("n3") == 1)))
    out = grouped.select("first", "pair_id", "prompt", "chosen", "rejected", problem.alias("problem"))
    if expected is not None:
        total = out.agg(F.count("*").alias("groups"))
        out = out.join(F.broadcast(total)).where(F.when(F.col("groups") == expected, True).otherwise(F.raise_error(F.lit(f"expected {expected} questions")).cast("boolean"))).drop("groups")
    return out


def _topic(subject: Column) -> Column:
    return F.replace(F.coalesce(F.nullif(subject, F.lit("")), F.lit("general")), F.lit("_"), F.lit(" "))


def choice_prompt(question: Column, options: Column, subject: Column) -> Column:
    """Multiple-choice prompt; the answer is a letter."""
    lines = F.array_join(F.transform(F.slice(options, 1, 4), lambda x, i: F.concat(F.get(F.array(*map(F.lit, LETTERS)), i), F.lit(". "), x)), "\n")
    return F.concat(F.lit("The following are multiple choice questions (with answers) about "), _topic(subject), F.lit(".\n\nQuestion: "), question, F.lit("\n"), lines)


def cloze_prompt(question: Column, subject: Column) -> Column:
    return F.concat(F.lit("The following are questions about "), _topic(subject), F.lit(".\nQuestion: "), question)


def letter_answer(letter: Column) -> Column:
    return F.concat(F.lit("\nAnswer: "), letter, F.lit("."))


def text_answer(option: Column) -> Column:
    return F.concat(F.lit("\nAnswer: "), option)


def story_options(chosen: Column, rejected: Column) -> Column:
    """A is the fitting ending."""
    return F.array(normalize_story(chosen), normalize_story(rejected))


#: The tasks that task_prompt knows.
TASKS = ("mmlu", "hellaswag", "sstorycloze", "tstorycloze")


def task_prompt(task: Column, sample: Column, form: str = "cloze", answer: str = "text") -> Column:
    """struct(prompt, continuations) by task (STR7, STR9): sample has question, options and subject.

    hellaswag takes context and endings as they are, the story tasks normalise both, mmlu has its own forms; options
    beyond the task's letters go. An unknown task is an error."""
    story = task.isin("sstorycloze", "tstorycloze")
    fitting = F.slice(sample["options"], 1, F.when(story, 2).otherwise(4))
    letters = F.transform(fitting, lambda _, i: letter_answer(F.get(F.array(*map(F.lit, LETTERS)), i)))
    mmlu_answers = letters if form == "mc" and answer == "letter" else F.transform(fitting, text_answer)
    mmlu = choice_prompt(sample["question"], sample["options"], sample["subject"]) if form == "mc" else cloze_prompt(sample["question"], sample["subject"])
    unknown = F.raise_error(F.concat(F.lit("unknown task: "), task))
    prompt = F.when(task == "mmlu", mmlu).when(task == "hellaswag", sample["question"]).when(story, normalize_story(sample["question"])).otherwise(unknown)
    continuations = F.when(task == "mmlu", mmlu_answers).when(story, F.transform(fitting, normalize_story)).otherwise(fitting)
    return F.struct(prompt.cast("string").alias("prompt"), continuations.alias("continuations"))


def explode_options(examples: DataFrame, options: str = "options") -> DataFrame:
    """One row an option: opt (from 0), letter and text (J9)."""
    return examples.select("*", F.posexplode(options).alias("opt", "option")).withColumn("letter", F.get(F.array(*map(F.lit, LETTERS)), F.col("opt"))).drop(options)


def pick_shots(examples: DataFrame, pool: DataFrame, shots: int, seed: int) -> DataFrame:
    """Per example `shots` others of the pool, in the order drawn: index, shot, other.

    The pool is put in one random order (by hash) for the seed; an example takes the `shots` entries after a drawn
    place on that ring, skipping itself: no pair beyond those chosen is ever made."""
    ring = running(pool.select(F.col("index").alias("other"), uniform(F.lit(seed), F.col("index"), "ring").alias("turn")), ["turn", "other"])
    ring = ring.select("other", F.col("number").alias("seat"))
    size = pool.agg(F.count("*").alias("pool"))
    seats = examples.select("index").join(F.broadcast(size)).select("index", "pool", F.explode(F.sequence(F.lit(0), F.lit(shots))).alias("step"))
    seats = seats.where("step < pool").select("index", "step", ((F.floor(uniform(F.lit(seed), F.col("index"), "seat") * F.col("pool")) + F.col("step")) % F.col("pool")).alias("seat"))
    found = seats.join(ring, "seat").where("index <> other")
    shot = F.row_number().over(Window.partitionBy("index").orderBy("step"))
    return found.select("index", "other", shot.alias("shot")).where(F.col("shot") <= shots)


def draw_shots(pool: DataFrame, shots: int, seed: int) -> DataFrame:
    """index, shot, other: for each entry of the pool `shots` different others, drawn independently of other entries (J10).

    The j-th draw is uniform over what is left: a number below the size less j, moved past the entries already taken
    (itself first) in ascending order. Seats are the pool's order by index, so one equi-join finds the drawn entries."""
    seated = running(pool.select("index"), ["index"]).withColumnRenamed("number", "seat")
    size = pool.agg(F.count("*").alias("pool"))  # one row
    rows = seated.join(F.broadcast(size))

    def draw(s: Column, j: Column) -> Column:
        low = F.floor(uniform(F.lit(seed), F.col("index"), j, "draw") * (F.col("pool") - j)).cast("long")
        moved = bind(F.array_sort(s["taken"]), lambda taken: F.aggregate(taken, low, lambda x, t: F.when(x >= t, x + 1).otherwise(x)))
        return bind(moved, lambda x: F.struct(F.concat(s["taken"], F.array(x)).alias("taken")))

    start = F.struct(F.array(F.col("seat").cast("long")).alias("taken"))
    possible = F.filter(F.sequence(F.lit(1), F.lit(max(shots, 1))), lambda j: (j < F.col("pool")) & (j <= shots))
    drawn = rows.select("index", F.posexplode(F.slice(F.aggregate(possible, start, draw)["taken"], 2, max(shots, 1))).alias("at", "seat"))
    return drawn.join(seated.select(F.col("index").alias("other"), "seat"), "seat").select("index", (F.col("at") + 1).alias("shot"), "other")


def shot_prompts(examples: DataFrame, shots: DataFrame, solved: DataFrame) -> DataFrame:
    """Solved examples and a blank line each, then the prompt (STR10): examples (index, prompt), solved (other, solved)."""
    joined = shots.join(solved, "other").groupBy("index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("shot", "solved"))), lambda x: F.concat(x["solved"], F.lit("\n\n"))), "").alias("shots"))
    return examples.join(joined, "index", "left").select("index", F.concat(F.coalesce("shots", F.lit("")), "prompt").alias("prompt"))


def eval_subset(examples: DataFrame, fraction: float, total: int, seed: int, cells: int = 4096, small: int = 10_000) -> DataFrame:
    """max(1, round half even(f * n)) examples without replacement, by smallest hash, ties by index (TOP3).

    The cut is found by counts of cells of the hash: the one cell that holds it is divided again until it has `small` rows at
    most. Rows below it pass without a sort; only that cell is sorted."""
    n = max(1, round(fraction * total))
    u = uniform(F.lit(seed), F.col("index"), "subset")
    rows = examples.withColumn("__u", F.floor(u * float(HASH_CELLS)).cast("long"))
    low, width, left = 0, HASH_CELLS, n
    while width > 1:
        part = max(1, width // cells)
        inside = rows.where((F.col("__u") >= low) & (F.col("__u") < low + width))
        held = 0
        for r in inside.groupBy(F.floor((F.col("__u") - low) / part).cast("long").alias("cell")).agg(F.count("*").alias("n")).orderBy("cell").collect():  # `cells` rows at most
            held = r["n"]
            if held >= left:
                low += r["cell"] * part
                break
            left -= held
        else:  # fewer rows than asked for
            return examples
        width = part
        if held <= small:
            break
    inside = rows.where((F.col("__u") >= low) & (F.col("__u") < low + width)).orderBy("__u", "index").limit(left)
    return rows.where(F.col("__u") < low).unionByName(inside).drop("__u")


def best_options(scores: DataFrame) -> DataFrame:
    """index and pred: scores (index, opt, logprob). First option of the best score; NaN and scores of NO_SCORE or less never win."""
    usable = F.col("logprob").isNotNull() & ~F.isnan("logprob") & (F.col("logprob") > NO_SCORE)
    return scores.groupBy("index").agg(F.max(F.when(usable, F.struct("logprob", (-F.col("opt")).alias("minus")))).alias("x")).select("index", (-F.col("x.minus")).cast("int").alias("pred"))


def accuracy(rows: DataFrame) -> DataFrame:
    """kept, correct and accuracy (0 if none) of rows with gold and pred."""
    hit = F.coalesce((F.col("gold") == F.col("pred")).cast("int"), F.lit(0))
    return rows.agg(F.count("*").alias("kept"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("correct"), F.coalesce(F.avg(hit), F.lit(0.0)).alias("accuracy"))


def variant(prompt: Column, continuation: Column, in_text: bool, out_text: bool, pad: int, switch: int | None, audio_pad: int) -> Column:
    """array<struct(text, audio, txt_in, aud_in, txt_pred, aud_pred)>: prompt, a switch where the modality changes, continuation.

    Prediction masks are true from the row before the continuation to the last but one, for the output modality."""
    uses = in_text != out_text and switch is not None
    row = lambda t, a: F.struct(t.cast("int").alias("text"), a.cast("int").alias("audio"))
    as_rows = lambda xs, text: F.transform(xs, lambda x: row(x, F.lit(audio_pad)) if text else row(F.lit(pad), x))
    middle = F.array(row(F.lit(switch), F.lit(audio_pad))) if uses else F.array().cast("array<struct<text:int,audio:int>>")
    rows = F.concat(as_rows(prompt, in_text), middle, as_rows(continuation, out_text))

    def masked(r: Column, i: Column, first: Column, n: Column) -> Column:
        predicts = (i >= first) & (i < n - 1)
        return F.struct(r["text"].alias("text"), r["audio"].alias("audio"), (r["text"] != pad).alias("txt_in"), (r["audio"] != audio_pad).alias("aud_in"), (predicts & F.lit(out_text)).alias("txt_pred"), (predicts & F.lit(not out_text)).alias("aud_pred"))

    first = F.size(prompt) + int(uses) - 1
    return bind(rows, lambda bound: bind(first, lambda f: bind(F.size(bound), lambda n: F.transform(bound, lambda r, i: masked(r, i, f, n)))))


def unit_variant(prompt: Column, continuation: Column, pad: int, audio_pad: int) -> Column:
    """variant() of two unit sequences that both close with an end: the prompt loses its end, the continuation keeps it and
    loses its first unit where that repeats the prompt's last (SEQ17, SEQ3)."""
    return bind(F.slice(prompt, 1, F.greatest(F.size(prompt) - 1, F.lit(0))), lambda p: variant(p, collapse_boundary(p, continuation), False, False, pad, None, audio_pad))


def write_results(rows: DataFrame, path: str, summary: dict) -> dict:
    """The evaluation's rows (index, gold, pred and more) as JSON lines in order of index, beside a summary with accuracy,
    count and the digest of the rows (SNK9); an existing target is refused. Returns the summary."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    lines = rows.select("index", line.alias("value"))
    lines.repartitionByRange("index").sortWithinPartitions("index").select("value").write.mode("errorifexists").text(f"{path}.rows")
    part = lines.groupBy(F.floor(F.col("index") / RESULT_STRETCH).alias("stretch")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", F.sha2("value", 256).alias("line")))), lambda x: x["line"]), ","), 256).alias("digest"))
    digest = part.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "digest"))), lambda x: x["digest"]), ","), 256)).first()[0]
    told = accuracy(rows).first()
    out = summary | {"format_version": 1, "accuracy": told["accuracy"], "num_examples": told["kept"], "rows_file": {"name": f"{path.rsplit('/', 1)[-1]}.rows", "sha256": digest}}
    rows.sparkSession.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return out
