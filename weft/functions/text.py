r"""Text functions (STR1, STR2, STR4, STR9, STR11-15, TOK1).

Java's \s has six ASCII characters; UNICODE_SPACE below has all that Python's str.split() uses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

MAX_VOCABULARY = 1_000_000
UNICODE_SPACE = r"[\s\x1c-\x1f\x85\p{Z}]+"
TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]+"
#: A text is a row of such pieces, whatever its characters. Bytes have the ids 0 to 255, the end comes next.
PIECE = rf"{TOKEN}|\s+"
END_ID = 256
#: Hebrew and Arabic letters, that write from right to left.
RTL = r"^[֐-ࣿיִ-﷿ﹰ-﻿]$"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{UNICODE_SPACE}", ""), f"{UNICODE_SPACE}$", "")


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """Characters with one folded character, these, and the characters that fold to several."""
    folds = {c: f for c in map(chr, range(0x110000)) if (f := c.casefold()) != c}
    single = {c: f for c, f in folds.items() if len(f) == 1}
    return "".join(single), "".join(single.values()), {c: f for c, f in folds.items() if len(f) > 1}


def casefold(text: Column) -> Column:
    """Full case folding of every code point, by Python's own table; texts without a character that becomes several take one pass."""
    keys, values, several = _folds()
    table = F.create_map(*(F.lit(x) for pair in several.items() for x in pair))
    letters = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    spelled = F.array_join(F.transform(letters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.translate(F.when(text.rlike(f"[{''.join(several)}]"), spelled).otherwise(text), keys, values)


def normalize_story(text: Column) -> Column:
    """Strip, drop final . ! ?, collapse white space, fold case."""
    out = F.regexp_replace(strip(text), r"[.!?]+$", "")
    return casefold(strip(F.regexp_replace(out, UNICODE_SPACE, " ")))


def alignment_words(text: Column) -> Column:
    """Lower-case words of a-z and ' (the curly one too)."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), "[^a-z' ]+", " ")
    return F.filter(F.split(out, " +"), lambda w: w != "")


def tokenizer_base(tokenizer: Column) -> Column:
    """org/base of a tokenizer id: org before the first /, base up to the last - after it."""
    tail = F.regexp_replace(tokenizer, "^[^/]*/", "")
    org = F.when(F.instr(tokenizer, "/") > 0, F.concat(F.substring_index(tokenizer, "/", 1), F.lit("/"))).otherwise("")
    return F.concat(org, F.regexp_replace(tail, "-[^-]*$", ""))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def _vocabulary(vocabulary: DataFrame) -> tuple[pa.Array, pa.Array]:
    """Tokens and ids, MAX_VOCABULARY at most."""
    rows = vocabulary.select("token", F.col("id").cast("int").alias("id")).limit(MAX_VOCABULARY + 1).collect()
    if len(rows) > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} tokens")
    return pa.array([r["token"] for r in rows], pa.string()), pa.array([r["id"] for r in rows], pa.int32())


def token_ids(df: DataFrame, text: str, vocabulary: DataFrame, out: str = "ids", unknown: int = 0, end: int | None = 1) -> DataFrame:
    """df with the ids of a text's tokens, the end id after them (TOK1, TOK2).

    vocabulary: token and id, at most MAX_VOCABULARY rows (more raise an error). It goes to the workers whole and whole
    Arrow batches of tokens are looked up at once; a token that is not there has the unknown id, a null text none."""
    names, numbers = _vocabulary(vocabulary)
    numbers = pa.concat_arrays([numbers, pa.array([unknown], pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["__tokens"]
            found = pc.fill_null(pc.index_in(lists.flatten(), names), len(names))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = numbers.take(found).to_numpy(zero_copy_only=False)
            if end is not None:
                ids = np.insert(ids, np.cumsum(sizes), end)
                sizes = sizes + 1
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
            kept = {c: batch[c] for c in batch.schema.names if c != "__tokens"}
            yield pa.record_batch({**kept, out: pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` array<int>"])
    return df.withColumn("__tokens", F.coalesce(tokens(F.col(text)), F.array().cast("array<string>"))).mapInArrow(run, schema)


def piece_ids(df: DataFrame, text: str, vocabulary: DataFrame, out: str = "ids", end: int | None = END_ID) -> DataFrame:
    """df with ids that hold a text whole (TOK1, TOK2): tokens of the vocabulary by their id, all else, white space too, by the ids
    0 to 255 of its bytes; the end id last. A null text is an empty one.

    vocabulary: token and id (above END_ID), at most MAX_VOCABULARY rows (more raise an error), looked up as in token_ids."""
    names, numbers = _vocabulary(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["__pieces"]
            flat = lists.flatten()
            found = pc.index_in(flat, names)
            spelled = pc.is_null(found)
            letters = flat.filter(spelled).cast(pa.binary())
            sizes = np.ones(len(flat), np.int64)
            sizes[spelled.to_numpy(zero_copy_only=False)] = pc.binary_length(letters).to_numpy(zero_copy_only=False)
            ids = np.zeros(int(sizes.sum()), np.int32)
            known = ~spelled.to_numpy(zero_copy_only=False)
            at = (np.cumsum(sizes) - sizes)[known]
            by_bytes = np.ones(len(ids), bool)
            by_bytes[at] = False
            ids[at] = numbers.take(found.filter(pc.is_valid(found))).to_numpy(zero_copy_only=False)
            ids[by_bytes] = np.frombuffer(b"".join(letters.to_pylist()), np.uint8)
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
            bounds = np.concatenate(([0], ends))
            if end is not None:
                ids = np.insert(ids, ends, end)
                bounds = bounds + np.arange(len(bounds))
            kept = {c: batch[c] for c in batch.schema.names if c != "__pieces"}
            yield pa.record_batch({**kept, out: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` array<int>"])
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0))
    return df.withColumn("__pieces", pieces).mapInArrow(run, schema)


def text_of_ids(df: DataFrame, ids: str, vocabulary: DataFrame, out: str = "text") -> DataFrame:
    """df with the text of piece_ids' ids; ids outside the vocabulary are an error, the end id adds nothing. Null ids give null."""
    names, numbers = _vocabulary(vocabulary)
    table = [bytes([b]) for b in range(256)] + [b""] + [None] * max(0, max([0, *numbers.to_pylist()]) - END_ID)
    for token, number in zip(names.to_pylist(), numbers.to_pylist(), strict=True):
        table[number] = token.encode()
    spelling = pa.array([*table, None], pa.binary())  # the last entry stands for all ids beyond

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch[ids]
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            found = spelling.take(pa.array(np.where((flat < 0) | (flat >= len(spelling)), len(spelling) - 1, flat)))
            if found.null_count:
                raise ValueError("an id outside the vocabulary")
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), found), b"")
            whole = pc.if_else(pc.is_null(lists), pa.scalar(None, pa.binary()), joined)
            yield pa.record_batch({**{c: batch[c] for c in batch.schema.names}, out: whole.cast(pa.string())})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"`{out}` string"])
    return df.mapInArrow(run, schema)


def padded_id(prefix: str, index: Column, width: int = 8) -> Column:
    return F.format_string(f"{prefix}%0{width}d", index)


def is_rtl(word: Column) -> Column:
    """At least two of the first, middle and last letters write from right to left."""
    core = F.regexp_replace(F.regexp_replace(word, r"^[\s\p{Punct}0-9]+", ""), r"[\s\p{Punct}0-9]+$", "")
    at = [F.lit(1), F.length(core), F.floor(F.length(core) / 2).cast("int") + 1]
    score = sum((F.coalesce(F.substring(core, p, F.lit(1)).rlike(RTL).cast("int"), F.lit(0)) for p in at), F.lit(0))
    return score >= 2


def bigrams(word: Column) -> Column:
    """Chunks of two characters; in right-to-left words each reversed, and their order too."""
    cut = F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)), F.lit(2)), lambda i: F.substring(word, i, F.lit(2))))
    return F.when(is_rtl(word), F.reverse(F.transform(cut, lambda x: F.reverse(x)))).otherwise(cut)


def is_speech(token: Column) -> Column:
    """A token with a letter or digit."""
    return token.rlike(r"[\p{L}\p{N}]")


#: Tasks of two endings.
STORY_TASKS = ("storycloze", "sstorycloze", "tstorycloze")


def options(dataset: Column) -> Column:
    """Answer letters of a benchmark: two for story endings, else four."""
    return F.when(dataset.isin(*STORY_TASKS), F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(*map(F.lit, "ABCD")))
